"""Mapping of sequences to sequences: shared minimizers of both strands, chained in order, as alignment rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanweave.functions.sequences import revcomp
from spanweave.operators.kmers import pieces
from spanweave.session import materialize


def stranded_minimizers(seqs: DataFrame, k: int = 15, w: int = 5) -> DataFrame:
    """``id, at, mini, forward``: the least canonical k-mer (by hash) of every ``w`` neighbouring places, its place from 0
    and whether the sequence has it as it is. Sequences are looked through in pieces, so a long one is many tasks' work;
    each place is given once."""
    span = k + w - 1
    cut = pieces(seqs.where("seq IS NOT NULL"), span).where(F.length("piece") >= span)
    rows = cut.select("id", "base", "piece", F.explode(F.sequence(F.lit(1), F.length("piece") - (k - 1))).alias("i"))
    rows = rows.select("id", "base", (F.col("base") + F.col("i") - 1).cast("long").alias("at"), F.substring("piece", F.col("i"), k).alias("x"))
    rows = rows.select("id", "base", "at", F.least("x", revcomp(F.col("x"))).alias("least"), "x").select("id", "base", "at", F.xxhash64("least").alias("h"), (F.col("least") == F.col("x")).alias("forward"))
    frame = Window.partitionBy("id", "base").orderBy("at").rowsBetween(0, w - 1)
    best = rows.withColumn("m", F.min(F.struct("h", "at", "forward")).over(frame)).withColumn("full", F.count("*").over(frame))
    return best.where(F.col("full") == w).select("id", F.col("m.at").alias("at"), F.col("m.h").alias("mini"), F.col("m.forward").alias("forward")).distinct()


def hits(query: DataFrame, target: DataFrame, block: int = 64, ordered: bool = False) -> DataFrame:
    """``q, t, same, x, y``: places of equal minimizers; ``same``: on the same strand. With ``ordered`` only q < t. The
    places of a frequent minimizer are dealt to blocks of about ``block`` on both sides and each pair of blocks is joined
    by itself, so none is left out and none is one task's work."""
    count = lambda df, n: df.groupBy("mini").agg(F.count("*").alias(n))
    sizes = count(query, "nq").join(count(target, "nt"), "mini").select("mini", F.ceil(F.col("nq") / block).alias("bq"), F.ceil(F.col("nt") / block).alias("bt"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    deal = lambda n: F.pmod(F.xxhash64("id", "at"), F.col(n))
    q = query.join(sizes, "mini").select("mini", deal("bq").alias("i"), every("bt").alias("j"), F.col("id").alias("q"), F.col("at").alias("x"), F.col("forward").alias("qf"))
    t = target.join(sizes, "mini").select("mini", every("bq").alias("i"), deal("bt").alias("j"), F.col("id").alias("t"), F.col("at").alias("y"), F.col("forward").alias("tf"))
    rows = q.join(t, ["mini", "i", "j"])
    return (rows.where("q < t") if ordered else rows).select("q", "t", (F.col("qf") == F.col("tf")).alias("same"), "x", "y")


def chain_hits(x: np.ndarray, y: np.ndarray, k: int, gap: int, band: int, least: float) -> list[tuple[np.ndarray, float]]:
    """Chains of hits that rise on both sequences, best first: hits in order, score. A hit adds what it doesn't share with
    the one before, less a cost of the difference of the two distances; steps of over ``gap`` and differences of over
    ``band`` aren't taken. Each hit is in one chain; a chain that meets another ends there. Scores under ``least`` go."""
    order = np.lexsort((x, y))
    x, y, n = x[order], y[order], len(x)
    best, parent, lo = np.full(n, float(k)), np.full(n, -1), 0
    for i in range(1, n):
        while y[i] - y[lo] > gap:
            lo += 1
        dx, dy = x[i] - x[lo:i], y[i] - y[lo:i]
        off = np.abs(dx - dy)
        ok = np.flatnonzero((dx > 0) & (dy > 0) & (dx <= gap) & (off <= band))
        if len(ok):
            cost = np.where(off[ok] > 0, 0.01 * k * off[ok] + 0.5 * np.log2(np.maximum(off[ok], 1)), 0.0)
            value = best[lo:i][ok] + np.minimum(np.minimum(dx[ok], dy[ok]), k) - cost
            top = int(value.argmax())
            if value[top] > k:
                best[i], parent[i] = value[top], lo + ok[top]
    used, found = np.zeros(n, bool), []
    for i in np.argsort(-best, kind="stable").tolist():
        if best[i] < least:
            break
        if used[i]:
            continue
        way, at = [], i
        while at >= 0 and not used[at]:
            used[at] = True
            way.append(at)
            at = int(parent[at])
        score = float(best[i] - (best[at] if at >= 0 else 0))
        if score >= least:
            found.append((order[way[::-1]], score))
    return found


def map_sequences(query: DataFrame, target: DataFrame | None = None, k: int = 15, w: int = 5, least: float = 100, gap: int = 10_000, band: int = 2_000) -> DataFrame:
    """``illu_id, i_len, i_start, i_end_x, direction, nano_id, n_len, n_start, n_end, matches, score``: where sequences
    of ``query`` (id, seq) are found on those of ``target``, as chains of shared minimizers with a score of at least
    ``least``; the columns are those of parse_paf(). Without ``target`` the sequences are mapped to each other, each
    pair once, from the smaller id.

    Ranges reach from the first to the last hit of a chain; ``matches`` counts positions under its hits. Both strands are
    looked at. The hits of two sequences are chained by one task: their lengths bound them. Null or short sequences and
    empty tables give nothing. Ids should be unique. ``k`` must be odd, so that a k-mer has one strand.
    """
    if k % 2 == 0:
        raise ValueError("k must be odd")
    mini = lambda s: materialize(stranded_minimizers(s.select("id", "seq"), k, w), "minimizers")
    q = mini(query)
    t = q if target is None else mini(target)
    lengths = lambda s, c, n: s.select(F.col("id").alias(c), F.length("seq").alias(n))
    found = hits(q, t, ordered=target is None).groupBy("q", "t", "same").agg(F.collect_list(F.struct("x", "y")).alias("hits")).where(F.size("hits") * k >= least)
    found = found.join(lengths(query, "q", "q_len"), "q").join(lengths(query if target is None else target, "t", "t_len"), "t")
    types = query.schema["id"].dataType.simpleString(), (query if target is None else target).schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, numbers = [], []
            same, q_len = batch.column("same").to_pylist(), batch.column("q_len").to_pylist()
            for row, lists in enumerate(batch.column("hits")):
                x, y = (lists.values.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
                x = x if same[row] else q_len[row] - k - x
                for chain, score in chain_hits(x, y, k, gap, band, least):
                    cx, cy = x[chain], y[chain]
                    start, end = int(cx[0]), int(cx[-1]) + k
                    if not same[row]:
                        start, end = q_len[row] - end, q_len[row] - start
                    under = k + int(np.minimum(np.minimum(np.diff(cx), np.diff(cy)), k).sum())
                    which.append(row)
                    numbers.append((start, end, int(cy[0]), int(cy[-1]) + k - 1, under, round(score, 3)))
            columns = list(zip(*numbers, strict=True)) if numbers else [()] * 6
            take = lambda c: batch.column(c).take(pa.array(which, pa.int64()))  # noqa: B023, E731
            ints = [pa.array(c, pa.int32()) for c in columns[:5]]
            yield pa.RecordBatch.from_arrays([take("q"), take("q_len"), ints[0], ints[1], take("same"), take("t"), take("t_len"), *ints[2:], pa.array(columns[5], pa.float64())], ["illu_id", "i_len", "i_start", "i_end_x", "direction", "nano_id", "n_len", "n_start", "n_end", "matches", "score"])

    return found.mapInArrow(run, f"illu_id {types[0]}, i_len int, i_start int, i_end_x int, direction boolean, nano_id {types[1]}, n_len int, n_start int, n_end int, matches int, score double")
