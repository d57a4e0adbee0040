"""A Merkle manifest of a table: a tree over the rows of each source, a tree over the sources' roots, a proof per row.

The rows of a source are numbered in their order; ``fanout**levels`` numbers in a row are an aligned block, whose
builder appends its nodes in the order in which they are completed, which is postorder. The roots of the blocks are the
items of the next tier, built in the same way, until one is left. A node's place in the log of its block follows in
closed form from the sizes of the subtrees before it, so a proof is read off the log without searching it: first for
the sources, then tier by tier down to the rows, where a block shares what lies above it.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from spanweave.session import materialize, read_table

_STEPS = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))
_ABOVE = [T.StructField("path", _STEPS), T.StructField("subroot", T.StringType()), T.StructField("root", T.StringType())]


def height(n: int, fanout: int) -> int:
    """Levels above the leaves of a tree with ``n`` of them."""
    up = 0
    while n > 1:
        n, up = -(-n // fanout), up + 1
    return up


def postorder(level: int, i: np.ndarray, n: int, top: int, fanout: int) -> np.ndarray:
    """Places in postorder of the ``i``-th nodes of ``level`` in a tree of ``n`` leaves and ``top`` levels: what the
    levels up to this one have completed when the node's last leaf is in, and what those above completed before."""
    end = np.minimum(n, (i + 1) * fanout**level)
    done = sum(-(-end // fanout**k) for k in range(level + 1))
    return done + sum((i // fanout ** (k - level) for k in range(level + 1, top + 1)), np.zeros_like(i)) - 1


def append_nodes(leaves: list[bytes], top: int, fanout: int) -> list[bytes]:
    """All nodes of one block in the order of completion. Digests enter a hash as lowercase hex."""
    log: list[bytes] = []
    open_: list[list[bytes]] = [[] for _ in range(top + 1)]

    def complete(level: int, node: bytes) -> None:
        log.append(node)
        if level < top:
            open_[level].append(node)
            if len(open_[level]) == fanout:
                close(level)

    def close(level: int) -> None:
        run, open_[level] = open_[level], []
        complete(level + 1, hashlib.sha256("".join(x.hex() for x in run).encode()).digest())

    for leaf in leaves:
        complete(0, leaf)
    for level in range(top):
        if open_[level]:
            close(level)
    return log


def leaf_digest(columns: list[Column]) -> Column:
    """sha256 of the columns one after the other: ``-`` for a null, else the UTF-8 bytes' number, ``:`` and the value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def numbered(items: DataFrame, group: str, order: list[str], tag: str) -> DataFrame:
    """``items`` with ``number``, from 0 in each group, and ``n``, the group's size. Rows are dealt by ranges of (group,
    order), so a large group is in many partitions; equal rows are told apart by where they were read."""
    keys = [group, *order, "_tie"]
    items = materialize(items.withColumn("_tie", F.monotonically_increasing_id()), f"{tag}-read")
    # the mark grows along the sorted table, by ones within a partition
    marked = items.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys).drop("_tie").withColumn("_mark", F.monotonically_increasing_id())
    marked = materialize(marked, f"{tag}-sorted").withColumn("_pid", F.shiftright("_mark", 33))
    runs = marked.groupBy(group, "_pid").agg(F.min("_mark").alias("_first"), F.count("*").alias("_n"))
    own = Window.partitionBy(group)  # a row a partition
    runs = runs.withColumn("_before", F.sum("_n").over(own.orderBy("_pid")) - F.col("_n")).withColumn("n", F.sum("_n").over(own))
    out = marked.join(runs, [group, "_pid"]).withColumn("number", F.col("_mark") - F.col("_first") + F.col("_before"))
    return out.drop("_pid", "_mark", "_first", "_before", "_n")


def build(items: DataFrame, fanout: int, levels: int, tag: str) -> tuple[list[DataFrame], DataFrame]:
    """From ``group_key, number, n, node`` the logs of all tiers (``group_key, block, n, nodes``) and the root of each
    group (``group_key, node``)."""
    size = fanout**levels

    def write(table: pa.Table) -> pa.Table:
        table = table.sort_by("number")
        n = table.column("n")[0].as_py()
        log = append_nodes(table.column("node").to_pylist(), levels if n > size else height(n, fanout), fanout)
        return pa.table({"group_key": table.column("group_key").slice(0, 1), "block": table.column("block").slice(0, 1), "n": pa.array([n], pa.int64()), "nodes": pa.array([b"".join(log)], pa.binary()), "node": pa.array([log[-1]], pa.binary())})

    logs, roots = [], []
    while True:
        blocks = items.select("group_key", F.expr(f"number div {size}").alias("block"), "number", "n", "node").groupBy("group_key", "block")
        log = materialize(blocks.applyInArrow(write, "group_key string, block long, n long, nodes binary, node binary"), f"{tag}-log")
        logs.append(log.drop("node"))
        roots.append(log.where(F.col("n") <= size).select("group_key", "node"))
        items = log.where(F.col("n") > size).select("group_key", F.col("block").alias("number"), F.ceil(F.col("n") / size).cast("long").alias("n"), "node")
        if not items.take(1):
            return logs, reduce(DataFrame.union, roots)


def extract(items: DataFrame, log: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``items`` (with ``group_key, number``) and, from their block's row in ``log`` (with ``path``, what lies above
    the block, and ``subroot, root``), their own path: at each level the siblings before and after, as hex."""
    size = fanout**levels
    rows = items.withColumn("block", F.expr(f"number div {size}"))
    fields = [f for f in rows.schema.fields if f.name != "block"]
    kept = [f.name for f in fields]
    schema = T.StructType([*fields, *_ABOVE])

    def read(own: pa.Table, logs: pa.Table) -> pa.Table:
        if not len(own):
            return pa.table([pa.array([], to_arrow_type(f.dataType)) for f in schema.fields], schema.names)
        log = logs.slice(0, 1).to_pylist()[0]
        n, block, data = log["n"], log["block"], log["nodes"]
        top, m = (levels if n > size else height(n, fanout)), min(size, n - block * size)
        nodes = np.array([data[k : k + 32].hex() for k in range(0, len(data), 32)] + [""], object)
        at = own.column("number").to_numpy() - block * size
        left, right = np.full((len(at), top), "", object), np.full((len(at), top), "", object)
        for level in range(top):
            i, width = at // fanout**level, -(-m // fanout**level)
            for k in range(fanout):
                j = i // fanout * fanout + k
                there = (j != i) & (j < width)
                sibling = nodes[np.where(there, postorder(level, np.minimum(j, width - 1), m, top, fanout), -1)]
                left[:, level] += np.where(j < i, sibling, "")
                right[:, level] += np.where(j > i, sibling, "")
        above = log["path"]
        flat = [np.concatenate([side, np.tile(np.array([x[name] for x in above], object), (len(at), 1))], axis=1).reshape(-1) for side, name in ((left, "left"), (right, "right"))]
        steps = pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in flat], ["left", "right"])
        path = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * (top + len(above)), pa.int32()), steps)
        same = lambda name: pa.array([log[name]] * len(at), pa.string())
        return pa.table([*(own.column(c) for c in kept), path, same("subroot"), same("root")], [*kept, "path", "subroot", "root"])

    return rows.groupBy("group_key", "block").cogroup(log.groupBy("group_key", "block")).applyInArrow(read, schema)


def descend(items: DataFrame, logs: list[DataFrame], tops: DataFrame, fanout: int, levels: int, tag: str) -> DataFrame:
    """``items`` with their path through all tiers and above; ``tops`` has ``group_key, path, subroot, root``."""
    size, above = fanout**levels, None
    for tier in range(len(logs) - 1, -1, -1):
        log = logs[tier].where(F.col("n") <= size).join(tops, "group_key")
        if above is not None:
            log = log.unionByName(logs[tier].where(F.col("n") > size).join(above.withColumnRenamed("number", "block"), ["group_key", "block"]))
        if tier == 0:
            return extract(items, log, fanout, levels)
        blocks = logs[tier - 1].where(F.col("n") > size).select("group_key", F.col("block").alias("number"))
        above = materialize(extract(blocks, log, fanout, levels), f"{tag}-paths")
    raise AssertionError("a tree has a tier")


def manifest(leaves: DataFrame, fanout: int = 3, levels: int = 7, id_col: str = "doc_id", source_col: str = "source", leaf_col: str = "leaf") -> DataFrame:
    """``leaves`` (an id, a source, a leaf as lowercase hex, other columns) with ``subroot``, ``root`` and ``path``, the
    proof of each row: for each level from the leaf to the root the digests of its run before and after it, joined.

    Leaves of a source ascend by id, null first; rows of one id by their leaf. A null source is a source, before the
    others. A run of ``fanout`` nodes, or what is left at the end of a level, makes one node while a level has several.
    A table of one row has an empty path; an empty table gives an empty result; repeated rows get a leaf each. Other
    columns stay, whatever their names; those named ``path``, ``subroot`` or ``root`` are replaced.
    """
    names = [f.name for f in _ABOVE]
    group = F.when(F.col(source_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source_col).cast("string")))
    rows = leaves.select(group.alias("group_key"), F.col(id_col).alias("id"), F.unhex(leaf_col).alias("node"), F.struct(*[c for c in leaves.columns if c not in names]).alias("row"))
    rows = materialize(numbered(rows, "group_key", ["id", "node"], "leaves"), "numbered-leaves")
    logs, subroots = build(rows, fanout, levels, "source")
    subroots = materialize(subroots, "subroots")
    sources = numbered(subroots.select(F.lit("").alias("all"), F.col("group_key").alias("source_key"), "node"), "all", ["source_key"], "subroots").withColumnRenamed("all", "group_key")
    sources = materialize(sources, "numbered-subroots")
    top_logs, root = build(sources, fanout, levels, "root")
    whole = root.select("group_key", F.expr("array()").cast("array<struct<left: string, right: string>>").alias("path"), F.lit("").alias("subroot"), F.lower(F.hex("node")).alias("root"))
    tops = descend(sources.select("group_key", "number", "source_key", "node"), top_logs, whole, fanout, levels, "root")
    tops = materialize(tops.select(F.col("source_key").alias("group_key"), "path", F.lower(F.hex("node")).alias("subroot"), "root"), "source-paths")
    return descend(rows.select("group_key", "number", "row"), logs, tops, fanout, levels, "source").select("row.*", *names)


def fold_path(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda h, step: F.sha2(F.concat(step["left"], h, step["right"]), 256))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    even = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 2 == 0
    tampered = leaf_digest([*columns, F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))])
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf_digest([*columns, F.col("text")]).alias("leaf"), tampered.alias("tampered"))
    found = manifest(leaves)
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    found = found.withColumn("folded_root", fold_path(F.col("tampered"), F.col("path"))).withColumn("proof_sha256", F.sha2(siblings, 256))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_FRONT = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
ORACLE = f"""
WITH RECURSIVE input AS (
  SELECT *, list_reduce([4294967295::BIGINT] || list_transform(list_filter(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda ch: ch <> ''), lambda ch: ord(ch)::BIGINT),
    lambda c, b: list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS g, sha256({_FRONT} || {_FIELD.format("text")}) AS leaf,
    sha256({_FRONT} || {_FIELD.format("CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")}) AS tampered FROM input),
numbered AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves),
tree(g, level, i, n, h) AS (
  SELECT g, 0, i, n, leaf FROM numbered UNION ALL
  SELECT g, level + 1, i // 3, max((n + 2) // 3), sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY g, level, i // 3),
subroots AS (SELECT g, h, level AS height, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
upper_tree(level, i, n, h) AS (
  SELECT 0, i, n, h FROM subroots UNION ALL
  SELECT level + 1, i // 3, max((n + 2) // 3), sha256(string_agg(h, '' ORDER BY i)) FROM upper_tree WHERE n > 1 GROUP BY level, i // 3),
all_nodes AS (SELECT g, level, i, n, h FROM tree UNION ALL SELECT NULL, level, i, n, h FROM upper_tree),
steps AS (
  SELECT a.g, a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS r
  FROM all_nodes a JOIN all_nodes b ON a.g IS NOT DISTINCT FROM b.g AND a.level = b.level AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY ALL),
fold(doc_id, g, leaf, up, level, i, h, siblings) AS (
  SELECT doc_id, g, leaf, g, 0, i, tampered, '' FROM numbered UNION ALL
  SELECT f.doc_id, f.g, f.leaf, CASE WHEN s.i IS NULL THEN NULL ELSE f.up END, CASE WHEN s.i IS NULL THEN 0 ELSE f.level + 1 END,
    CASE WHEN s.i IS NULL THEN t.i ELSE f.i // 3 END, CASE WHEN s.i IS NULL THEN f.h ELSE sha256(s.l || f.h || s.r) END, f.siblings || coalesce(s.l || s.r, '')
  FROM fold f LEFT JOIN steps s ON s.g IS NOT DISTINCT FROM f.up AND s.level = f.level AND s.i = f.i JOIN subroots t ON t.g = f.g
  WHERE s.i IS NOT NULL OR f.up IS NOT NULL),
ended AS (SELECT f.* FROM fold f WHERE f.up IS NULL AND f.level = (SELECT max(level) FROM upper_tree))
SELECT e.doc_id, e.leaf, t.h AS subroot, r.h AS root, sha256(e.siblings) AS proof_sha256, e.h AS folded_root, e.h = r.h AS verified
FROM ended e JOIN subroots t ON t.g = e.g CROSS JOIN (SELECT h FROM upper_tree WHERE n = 1) r
"""
