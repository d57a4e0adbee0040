"""Merkle manifests against the definition, and against DuckDB SQL."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from spanweave.llm import merkle
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k : k + fanout]) for k in range(0, len(out[-1]), fanout)])
    return out


def steps(tree, i, fanout):
    for level in tree[:-1]:
        run = i // fanout * fanout
        yield "".join(level[run:i]), "".join(level[i + 1 : run + fanout])
        i //= fanout


def brute(rows, fanout):
    """(id, source, leaf) -> (subroot, root, path)"""
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted(((i is not None, i or 0, leaf) for i, t, leaf in rows if t == s))
        trees[s] = ([x[2] for x in own], levels([x[2] for x in own], fanout))
    top = levels([trees[s][1][-1][0] for s in sources], fanout)
    out = []
    for k, s in enumerate(sources):
        leaves, tree = trees[s]
        out += [(leaf, tree[-1][0], top[-1][0], [*steps(tree, i, fanout), *steps(top, k, fanout)]) for i, leaf in enumerate(leaves)]
    return sorted(out)


@pytest.mark.parametrize(("fanout", "deep", "n", "sources"), [(3, 2, 400, 4), (2, 1, 60, 13), (3, 7, 30, 2), (4, 1, 1, 1), (3, 1, 25, 25)])
def test_equals_brute_force(spark, fanout, deep, n, sources):
    rng = random.Random(n)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, "", "é", *map(str, range(sources))][-sources - 1 :]), H(str(rng.randrange(n)))) for _ in range(n)]
    rows += rows[: n // 5]
    df = spark.createDataFrame([(i, s, h, 1, 2, "x") for i, s, h in rows], "doc_id long, source string, leaf string, number int, n int, path string").repartition(5)
    found = merkle.manifest(df, fanout, deep)
    assert found.columns == ["doc_id", "source", "leaf", "number", "n", "path", "subroot", "root"] or set(found.columns) == {"doc_id", "source", "leaf", "number", "n", "path", "subroot", "root"}
    got = found.withColumn("folded", merkle.fold_path(F.col("leaf"), F.col("path"))).collect()
    assert sorted((r.leaf, r.subroot, r.root, [tuple(x) for x in r.path]) for r in got) == brute(rows, fanout)
    assert all(r.folded == r.root and (r.number, r.n) == (1, 2) for r in got)
    changed = found.select(F.lit(H("other")).alias("leaf"), "path", "root").where(merkle.fold_path(F.col("leaf"), F.col("path")) == F.col("root"))
    assert changed.count() == 0


def test_empty(spark):
    assert merkle.manifest(spark.createDataFrame([], "doc_id long, source string, leaf string")).count() == 0


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_places_in_closed_form(fanout):
    for n in range(1, 130):
        leaves = [hashlib.sha256(bytes([k])).digest() for k in range(n)]
        top = merkle.height(n, fanout)
        log = [x.hex() for x in merkle.append_nodes(leaves, top, fanout)]
        tree = levels([x.hex() for x in leaves], fanout)
        assert len(log) == sum(map(len, tree))
        for level, nodes in enumerate(tree):
            at = merkle.postorder(level, np.arange(len(nodes)), n, top, fanout)
            assert [log[k] for k in at] == nodes


def test_same_rows_as_sql_with_nulls(spark, tmp_path):
    docs = [(i, t, lang, s, n) for i, (t, lang, s, n) in enumerate([("a\nb", "en", "x", 3), (None, None, None, None), ("", "", "", 0), ("\n", "en", "é", 1), ("a\nb", "en", "x", 3)] * 7)]
    docs += [(None, "lost\nrow", "en", "x", 8), (3, "other text of an id", "de", None, 1), (3, "other text of an id", "de", None, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(merkle.ORACLE)
    columns = [c[0] for c in want.description]
    got = merkle.op13_manifest(spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in got)
    for r in got:
        if r.doc_id is not None:
            text = docs[r.doc_id][1] if r.doc_id != 3 else None
            if text is not None:
                assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 2 == 1 or "\n" not in text)
