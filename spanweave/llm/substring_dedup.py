"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark; repeated windows merge
into maximal removal intervals.

How the plan stays linear in the text. Documents are dealt into blocks of a few megabytes by a hash of id and text.
Two equal windows share their *anchor*: the smallest hash among the word runs of ``anchor`` words inside the window.
So anchors (about one for every eight words) are counted first, and only windows whose anchor occurs twice are hashed
and counted themselves. An anchor that occurs twice within a slice of a task is known to be shared: it is told to the
others once for the slice, and its own rows need no counting. Windows are counted once for each block. So a passage that
a third of all documents share costs a row for each slice and block, not for each document, and no row is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanweave.llm import words as W
from spanweave.session import read_table

LOWEST = -(2**63)
_SLICE = 1 << 20  # bytes of a block's text that are worked on at once


def _smallest(a: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        a = np.minimum(a[:-step], a[step:])
        have += step
    return a


def _anchors(hashes: np.ndarray, first: np.ndarray, width: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, each one's anchor value, the distinct anchor values, at how many places each is."""
    starts = W.inside(first, width, len(hashes))
    if not len(starts):
        return starts, *[np.zeros(0, np.uint64)] * 2, np.zeros(0, np.int64)
    keep = np.uint64(2**64 - 256)
    runs = W.rolling(hashes, anchor, seed=1) & keep
    place = np.arange(len(runs), dtype=np.uint64) & np.uint64(255)
    span, at = width - anchor + 1, []
    for tie in (place, np.uint64(255) - place):  # an anchor that a window holds twice gives two places
        low = _smallest(runs | tie, span)[starts]
        place_of = (low & np.uint64(255)) if tie is place else np.uint64(255) - (low & np.uint64(255))
        at.append(starts + ((place_of.astype(np.int64) - starts) & 255))
    seen = np.zeros(len(runs), bool)
    for x in at:
        seen[x] = True
    values, counts = np.unique(runs[seen], return_counts=True)
    return starts, runs[at[0]], values, counts


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = W.text_buffer(texts)
    starts, ends, first = W.spans(data, offsets)
    return data, starts, ends, first, W.word_hashes(data, starts, ends)


def _member(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(ordered, x), max(len(ordered) - 1, 0))
    return ordered[at] == x if len(ordered) else np.zeros(len(x), bool)


def _kept_texts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, gone: np.ndarray) -> pa.Array:
    """Kept words of each text, joined by one space."""
    keep = ~gone
    lengths = (ends - starts)[keep]
    to = np.cumsum(lengths + 1) - (lengths + 1)
    out = np.full(int((lengths + 1).sum()), 0x20, np.uint8)
    out[W.ranges(to, lengths)] = data[W.ranges(starts[keep], lengths)]
    bounds = np.concatenate([to, [len(out)]])[np.concatenate([[0], np.cumsum(keep)])[first]]
    some = np.diff(bounds) > 0
    # the space after a text's last word goes: cut it by giving each text its own piece
    pieces = [out[b : e - 1].tobytes() if s else b"" for b, e, s in zip(bounds[:-1].tolist(), bounds[1:].tolist(), some.tolist(), strict=True)]
    return pa.array(pieces, pa.binary()).cast(pa.string())


def _runs(gone: np.ndarray, first: np.ndarray) -> pa.Array:
    """Maximal removed intervals of each text, as [start, end) in words of that text."""
    n = len(gone)
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    before = np.concatenate([[False], gone[:-1]]) & ~edge[:-1] if n else gone
    after = np.concatenate([gone[1:], [False]]) & ~edge[1:] if n else gone
    begin, end = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1
    at = np.searchsorted(begin, first)
    base = np.repeat(first[:-1], np.diff(at))
    items = pa.StructArray.from_arrays([pa.array((begin - base).astype(np.int32)), pa.array((end - base).astype(np.int32))], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), items)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] | None = None, width: int = 20, anchor: int = 6, block_bytes: int = 8 << 20) -> DataFrame:
    """One row for each row of ``docs``: ``row`` (a struct of the columns ``carry``, by default the id), ``n_words``,
    ``removed`` (maximal intervals [start, end) of words) and ``kept_text`` (kept words joined by one space).

    A word goes if it lies in a window of ``width`` words whose words also start earlier: in a document of a smaller
    id, or further to the front of the same one. Windows are judged on the input.

    A null text is an empty one; a null id counts as the smallest. Repeated rows (equal id and text) begin at the same
    place, so neither removes the other. A text of fewer than ``width`` words keeps all. An empty table gives an empty
    table. Other columns of ``docs`` don't matter, whatever their names. Equality of windows is equality of 96 bits of
    two independent rolling hashes.
    """
    if not anchor <= width <= 255 + anchor:
        raise ValueError("a window must hold its anchor, in one of 256 places")
    carry = list(carry or [id_col])
    base = docs.select(F.struct(*[docs[c] for c in carry]).alias("row"), docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    base = base.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))

    def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                _, _, _, first, hashes = _hashed(part.column("text"))
                starts, mine, values, counts = _anchors(hashes, first, width, anchor)
                if not len(starts):
                    continue
                # each anchor value once for each block of the slice
                block = part.column("block").to_numpy(zero_copy_only=False)
                owner = block[np.searchsorted(first, starts, side="right") - 1]
                order = np.lexsort((owner, mine))
                a, b = mine[order], owner[order]
                new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                a, b = a[new], b[new]
                sure = counts[np.searchsorted(values, a)] > 1
                tell = np.unique(a[sure])
                key = np.concatenate([np.where(sure, b.astype(np.uint64), a), tell])
                a, b = np.concatenate([a, tell]), np.concatenate([b, np.full(len(tell), -1)])
                told = np.concatenate([~sure, np.ones(len(tell), bool)])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(a.view(np.int64), mask=told), pa.array(b.astype(np.int32))], ["key", "anchor", "block"])

    # rows of anchors known to be shared hold them and are dealt by block; the others are counted, together with the
    # rows that tell them of a slice (block -1)
    found = base.select("block", "text").mapInArrow(find_anchors, "key long, anchor long, block int")
    found = found.withColumn("times", F.count("*").over(Window.partitionBy("key")))
    shared = found.where("block >= 0 AND (times > 1 OR anchor IS NOT NULL)").select("block", F.coalesce("anchor", "key").alias("anchor"))

    # a text that is carried along is dealt once
    texts = (base.drop("text") if text_col in carry else base).repartition(blocks, "block")

    def find_windows(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out, want = [], np.sort(right.column("anchor").to_numpy()).view(np.uint64)
        want.sort()
        for batch in left.combine_chunks().to_batches():
            for part in W.slices(W.with_text(batch, text_col), "text", _SLICE):
                _, _, _, first, hashes = _hashed(part.column("text"))
                starts, mine, _, _ = _anchors(hashes, first, width, anchor)
                at = starts[_member(mine, want)] if len(starts) else starts
                if len(at):
                    ids = pc.fill_null(part.column("id"), LOWEST).to_numpy()
                    own = np.searchsorted(first, at, side="right") - 1
                    out.append((W.rolling(hashes, width, 2)[at], (W.rolling(hashes, width, 3)[at] >> np.uint64(32)).astype(np.uint32), ids[own], at - first[own]))
        h, h2, ids, at = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))
        out.clear()
        order = np.lexsort((at, ids, h2, h))
        h, h2, ids, at = h[order], h2[order], ids[order], at[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])
        begin = np.flatnonzero(new)
        n = np.diff(np.concatenate([begin, [len(h)]]))
        return pa.table({"h": h[begin].view(np.int64), "h2": h2[begin].view(np.int32), "block": np.full(len(begin), key[0].as_py(), np.int32), "id": ids[begin], "at": at[begin].astype(np.int32), "n": n.astype(np.int32)})

    windows = texts.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(find_windows, "h long, h2 int, block int, id long, at int, n int")
    same = Window.partitionBy("h", "h2")
    windows = windows.withColumn("times", F.sum("n").over(same)).withColumn("lead", F.min(F.struct("id", "at")).over(same))
    # what a block must know: that a window of its own goes everywhere, or that all but the leading place go
    leads = (F.col("lead.id") == F.col("id")) & (F.col("lead.at") == F.col("at"))
    repeated = windows.where("times > 1").where(~leads | (F.col("n") > 1)).select("block", "h", "h2", F.when(leads, F.col("id")).otherwise(F.lit(LOWEST)).alias("lead_id"), F.when(leads, F.col("at")).otherwise(F.lit(-1)).alias("lead_at"))

    row_type = base.schema["row"].dataType
    schema = T.StructType([T.StructField("row", row_type), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))), T.StructField("kept_text", T.StringType())])

    def remove(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        h, h2 = right.column("h").to_numpy().view(np.uint64), right.column("h2").to_numpy().view(np.uint32)
        order = np.lexsort((h2, h))
        h, h2, lead_id, lead_at = h[order], h2[order], right.column("lead_id").to_numpy()[order], right.column("lead_at").to_numpy()[order]
        parts = []
        for batch in left.combine_chunks().to_batches():
            for part in W.slices(W.with_text(batch, text_col), "text", _SLICE):
                data, starts, ends, first, hashes = _hashed(part.column("text"))
                cover = np.zeros(len(hashes) + 1, np.int64)
                at = W.inside(first, width, len(hashes)) if len(h) else np.zeros(0, np.int64)
                if len(at):
                    mine = W.rolling(hashes, width, 2)[at]
                    hit = _member(mine, h)
                    at, mine = at[hit], mine[hit]
                if len(at):
                    mine2 = (W.rolling(hashes, width, 3)[at] >> np.uint64(32)).astype(np.uint32)
                    own = np.searchsorted(first, at, side="right") - 1
                    ids, place = pc.fill_null(part.column("id"), LOWEST).to_numpy()[own], at - first[own]
                    k, top = np.searchsorted(h, mine), np.searchsorted(h, mine, side="right")
                    later = np.zeros(len(at), bool)
                    while (k < top).any():  # one pass; more only where 64 bits agree and the other 32 don't
                        j = np.minimum(k, len(h) - 1)
                        later |= (k < top) & (h2[j] == mine2) & ((ids > lead_id[j]) | ((ids == lead_id[j]) & (place > lead_at[j])))
                        k = k + 1
                    np.add.at(cover, at[later], 1)
                    np.add.at(cover, at[later] + width, -1)
                gone = np.cumsum(cover)[:-1] > 0
                total_gone = np.concatenate([[0], np.cumsum(gone)])
                parts.append(pa.table([part.column("row"), pa.array(np.diff(first)), pa.array(np.diff(total_gone[first])), _runs(gone, first), _kept_texts(data, starts, ends, first, gone)], schema.names))
        return pa.concat_tables(parts) if parts else pa.table({f.name: pa.array([], t) for f, t in zip(schema.fields, [left.schema.field("row").type, pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string()], strict=True)})

    return texts.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(remove, schema)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS pos, words FROM w WHERE len(words) >= 20),
k AS (SELECT doc_id, pos, array_to_string(list_slice(words, pos, pos + 19), ' ') AS seq FROM p),
d AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY seq ORDER BY doc_id, pos) > 1 AS later FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS gone FROM d WHERE later),
l AS (SELECT doc_id, list(gone) AS gone FROM g GROUP BY doc_id),
r AS (SELECT w.doc_id, words, coalesce(gone, []) AS gone FROM w LEFT JOIN l USING (doc_id))
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(words, lambda x, i: NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM r
"""
