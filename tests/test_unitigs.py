"""Unitigs against a plain walk over both strands."""

import random
from collections import defaultdict

import pytest

from spanweave.operators.unitigs import unitigs


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def brute(seqs, k):
    kmers = {x for s in seqs for i in range(len(s) - k + 1) for x in (s[i : i + k], rc(s[i : i + k]))}
    after, before = defaultdict(list), defaultdict(list)
    for x in kmers:
        after[x[:-1]].append(x)
        before[x[1:]].append(x)
    step = {}
    for x in kmers:
        to = after[x[1:]]
        if len(to) == 1 and len(before[x[1:]]) == 1 and to[0] != rc(x):
            step[x] = to[0]
    into, out, seen = set(step.values()), set(), set()
    for x in sorted(kmers - into) + sorted(kmers):
        if x in seen:
            continue
        way = [x]
        while way[-1] in step and step[way[-1]] != x:
            way.append(step[way[-1]])
        seen |= set(way)
        mirror = rc(way[-1]) if x not in into else min(map(rc, way))
        if x < mirror:
            out.add(x + "".join(y[-1] for y in way[1:]))
    return out, kmers


@pytest.mark.parametrize(("k", "width"), [(5, 60), (7, 10)])
def test_unitigs(spark, k, width):
    rng = random.Random(k)
    ring = "".join(rng.choice("ACGT") for _ in range(40))
    seqs = ["".join(rng.choice("ACGT") for _ in range(rng.choice((3, 20, 90)))) for _ in range(6)] + [ring + ring[: k - 1], "A" * 12, "ACGTACGTACGT", "", None]
    seqs += seqs[:2] + [rc(seqs[2])]
    df = spark.createDataFrame(list(enumerate(seqs)), "id long, seq string").repartition(4)
    pieces = defaultdict(dict)
    for r in unitigs(df, k, width=width).collect():
        pieces[r.unitig][r.piece] = r.text
    got = {name: "".join(p[i] for i in range(len(p))) for name, p in pieces.items()}
    want, kmers = brute([s for s in seqs if s], k)
    assert set(got.values()) == want
    assert all(text.startswith(name) and all(len(p[i]) == width for i in range(len(p) - 1)) for name, text in got.items() for p in [pieces[name]])
    # every k-mer once, on one strand
    inside = [min(t[i : i + k], rc(t[i : i + k])) for t in got.values() for i in range(len(t) - k + 1)]
    assert len(inside) == len(set(inside)) and set(inside) == {min(x, rc(x)) for x in kmers}


def test_only_a_circle_and_nothing(spark):
    ring = "ACCTGGAATCGTTACGA"
    got = unitigs(spark.createDataFrame([(1, ring + ring[:4])], "id long, seq string"), 5).collect()
    want, _ = brute([ring + ring[:4]], 5)
    assert {r.text for r in got} == want and len(got) == len(want)
    assert unitigs(spark.createDataFrame([(1, "ACG")], "id long, seq string"), 5).count() == 0
    with pytest.raises(ValueError):
        unitigs(spark.createDataFrame([(1, "ACG")], "id long, seq string"), 4)
