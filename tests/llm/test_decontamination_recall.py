"""Recall of decontamination against the longest common subsequence over all windows, and its decomposition."""

import math
import random

import numpy as np
import pyarrow as pa

from spanweave.llm import decontaminate
from spanweave.llm.decontaminate import common_subsequence

COMMON = [f"c{k}" for k in range(200)]


def text(rng: random.Random, n: int) -> list[str]:
    return [rng.choice(COMMON) if rng.random() < 0.3 else f"w{int(rng.paretovariate(0.3)) % 6000}" for _ in range(n)]


def brute(docs, items, window=32, stride=8, overlap=0.6, tail=0.25):
    found = set()
    for d, words in docs:
        for i, item in enumerate(items):
            end = item[-max(1, math.ceil(tail * len(item))) :]
            for p in range(0, max(1, len(words) - window + stride), stride):
                around = words[max(0, p - len(item)) : p + window + len(item)]
                if common_subsequence(item, around)[-1] >= overlap * len(item) and common_subsequence(end, around)[-1] >= overlap * len(end):
                    found.add((d, i))
                    break
    return found


def planted(share: float, n: int = 120):
    rng = random.Random(int(share * 100))
    items = [text(rng, rng.randint(24, 40)) for _ in range(n)]
    docs = []
    for k, item in enumerate(items):
        changed = [f"x{rng.randrange(9000)}" if rng.random() < share else w for w in item]
        docs.append((k, text(rng, rng.randint(0, 60)) + changed + text(rng, rng.randint(0, 60))))
    docs += [(1000 + k, text(rng, 120)) for k in range(600)]
    return docs, items


def recall(spark, share):
    docs, items = planted(share)
    want = {(d, i) for d, i in brute(docs[: len(items)], items) if d == i}
    table = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.id, r.item_id) for r in decontaminate.contaminated(table, bench).collect()}
    return want, got


def test_few_that_the_subsequence_accepts_are_lost(spark):
    """At 35 percent of changed words the cosine still loses some."""
    for share, least in ((0.15, 1.0), (0.25, 1.0), (0.35, 0.95)):
        want, got = recall(spark, share)
        assert len(want) > 40
        assert len(want & got) >= least * len(want), (share, len(want), len(want - got))


def test_the_index_of_rare_words_loses_nothing(spark):
    """Without a bound on the cosine, what is found is what the subsequence accepts."""
    docs, items = planted(0.35, 40)
    docs = docs[:100]
    table = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.id, r.item_id) for r in decontaminate.contaminated(table, bench, cosine=0.0).collect()}
    assert brute(docs, items) <= got


def test_singular_values_and_vectors(spark):
    """Against a dense decomposition of the same weighted passages."""
    rng = random.Random(4)
    topics = [[f"t{t}x{k}" for k in range(12)] for t in range(6)]
    docs = [" ".join(rng.choice(topics[k % 6]) if rng.random() < 0.9 else rng.choice(COMMON) for _ in range(32)) for k in range(240)]
    table = spark.createDataFrame(list(enumerate(docs)), "id long, text string").repartition(3)
    space = decontaminate.latent_space(table, rank=6)
    words, first = decontaminate._passages(pa.array(docs), 32)
    a = np.zeros((len(words), decontaminate._COLUMNS))
    for i in range(len(words)):
        w = words[i][first[i]]
        np.add.at(a[i], w & (decontaminate._COLUMNS - 1), space.idf[w])
    a /= np.sqrt(np.array([(space.idf[words[i][first[i]]] ** 2).sum() for i in range(len(words))]))[:, None]
    values = np.linalg.svd(a, compute_uv=False)[:6]
    assert np.allclose(space.values, values, rtol=0.03)
    assert np.allclose(space.vectors.T @ space.vectors, np.eye(6), atol=1e-3)
    assert np.linalg.norm(a @ space.vectors) ** 2 > 0.97 * (values**2).sum()


def test_a_very_long_item_and_document(spark):
    rng = random.Random(9)
    item = [f"q{rng.randrange(10**6)}" for _ in range(20_000)]
    kept = [w if rng.random() < 0.8 else "other" for w in item]
    table = spark.createDataFrame([(1, " ".join(["lead"] * 500 + kept)), (2, " ".join(text(rng, 3000)))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "one")], "item_id long, text string")
    got = decontaminate.contaminated(table, bench).collect()
    assert [(r.id, r.item_id) for r in got] == [(1, 7)] and 0.75 < got[0].overlap < 0.85
