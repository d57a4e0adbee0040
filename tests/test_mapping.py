"""Mapping: planted places on both strands, chains against all ways through few hits, hits against a plain join."""

import random
from collections import Counter
from itertools import combinations
from math import log2

import numpy as np
import pytest

from spanweave.operators import mapping

COLUMNS = "id long, seq string"


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def test_planted_places_are_found(spark):
    rng = random.Random(2)
    genomes = [(100 + k, dna(rng, 4000)) for k in range(3)]
    reads, want = [], {}
    for k in range(14):
        g, at, size = rng.randrange(3), rng.randrange(0, 3000), rng.randint(500, 900)
        piece = [c if rng.random() > 0.03 else rng.choice("ACGT") for c in genomes[g][1][at : at + size]]
        piece = "".join(piece[:250] + piece[270:])  # and 20 positions lost
        turned = k % 2 == 1
        reads.append((k, rc(piece) if turned else piece))
        want[k] = 100 + g, at, at + size, not turned
    reads += [(50, dna(rng, 800)), (51, "ACG"), (52, None), (53, "")]
    got = mapping.map_sequences(spark.createDataFrame(reads, COLUMNS), spark.createDataFrame(genomes, COLUMNS)).collect()
    best = {}
    for r in got:
        if r.illu_id not in best or r.score > best[r.illu_id].score:
            best[r.illu_id] = r
    assert set(best) == set(want)
    for k, (g, lo, hi, same) in want.items():
        r = best[k]
        assert (r.nano_id, r.direction, r.n_len, r.i_len) == (g, same, 4000, len(reads[k][1]))
        assert lo <= r.n_start <= lo + 120 and hi - 120 <= r.n_end < hi
        assert 0 <= r.i_start <= 120 and r.i_len - 120 <= r.i_end_x <= r.i_len
        assert 0.4 * r.i_len < r.matches <= r.i_len
    both = mapping.map_sequences(spark.createDataFrame(reads[:4] + [(60, reads[0][1]), (61, rc(reads[1][1]))], COLUMNS)).collect()
    assert {(r.illu_id, r.nano_id, r.direction) for r in both} >= {(0, 60, True), (1, 61, False)}
    assert all(r.illu_id < r.nano_id for r in both)
    with pytest.raises(ValueError):
        mapping.map_sequences(spark.createDataFrame(reads, COLUMNS), k=14)


def test_a_frequent_minimizer_loses_nothing(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(9), at, rng.choice((7, 7, 7, 8, 9)), rng.random() < 0.5) for at in range(90)]
    df = spark.createDataFrame(rows, "id long, at long, mini long, forward boolean")
    got = Counter(map(tuple, mapping.hits(df, df, block=4, ordered=True).collect()))
    assert got == Counter((a[0], b[0], a[3] == b[3], a[1], b[1]) for a in rows for b in rows if a[2] == b[2] and a[0] < b[0])


def test_chains_are_the_best_ways():
    rng = random.Random(9)
    for _ in range(60):
        n = rng.randint(1, 8)
        spots = rng.sample([(a, b) for a in range(0, 90, 6) for b in range(0, 90, 7)], n)
        x, y = (np.array(c) for c in zip(*spots))
        top = 0.0
        for size in range(1, n + 1):
            for some in combinations(sorted(spots, key=lambda s: (s[1], s[0])), size):
                total = 11.0
                for (a, b), (c, d) in zip(some, some[1:]):
                    off = abs((c - a) - (d - b))
                    if not (c > a and d > b and c - a <= 60 and d - b <= 60 and off <= 30):
                        break
                    total += min(c - a, d - b, 11) - (0.01 * 11 * off + 0.5 * log2(off) if off else 0)
                else:
                    top = max(top, total)
        found = mapping.chain_hits(x, y, 11, 60, 30, 5)
        assert abs(found[0][1] - top) < 1e-9
        used = [i for chain, _ in found for i in chain.tolist()]
        assert len(used) == len(set(used))
        assert all((np.diff(x[c]) > 0).all() and (np.diff(y[c]) > 0).all() for c, _ in found)
