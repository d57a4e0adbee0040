"""Interval operators: coverage by event sweep, outlier cut, union of intervals, clipping. No dense arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coverage(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """``key, seg_start, seg_end, depth``: the stretches of constant depth (above 0) of the intervals [start, end]. The
    events of one position are summed before the window, so a crowded position is one row there."""
    events = rows.select(key, F.explode(F.array(F.struct(F.col(start).alias("pos"), F.lit(1).alias("d")), F.struct((F.col(end) + 1).alias("pos"), F.lit(-1).alias("d")))).alias("e"))
    events = events.groupBy(key, F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d")).where("d <> 0")
    w = Window.partitionBy(key).orderBy("pos")
    out = events.withColumn("depth", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("pos").over(w))
    return out.where("depth > 0").select(key, F.col("pos").alias("seg_start"), (F.col("next") - 1).alias("seg_end"), F.col("depth").cast("long").alias("depth"))


def max_coverage(rows: DataFrame, profile: DataFrame, key: str, reads: str) -> DataFrame:
    """``key, n_reads, max_cov``"""
    deepest = profile.groupBy(key).agg(F.max("depth").alias("max_cov"))
    return rows.groupBy(key).agg(F.count_distinct(reads).alias("n_reads")).join(deepest, key)


def quartile_cutoff(depths: DataFrame, column: str = "max_cov") -> DataFrame:
    """One row ``q1, q3, cutoff`` (Q3 + 1.5 IQR): exact interpolating percentiles, from counts of distinct values."""
    counts = depths.groupBy(column).count()
    q = counts.agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.75)), F.col("count")).alias("q"))
    return q.select(F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"), (F.col("q")[1] + 1.5 * (F.col("q")[1] - F.col("q")[0])).alias("cutoff"))


def coverage_outliers(deepest: DataFrame, key: str) -> DataFrame:
    """Keys whose depth is above the cutoff of all keys."""
    return deepest.join(F.broadcast(quartile_cutoff(deepest)), F.col("max_cov") > F.col("cutoff")).select(key, "max_cov", "cutoff", "q3")


def cut_peaks(profile: DataFrame, outliers: DataFrame, key: str, least: int = 500) -> DataFrame:
    """Maximal runs of outlier keys whose depth stays at or below Q3, if at least ``least`` long, numbered from 0."""
    segs = profile.join(outliers.select(key, "q3"), key).where("depth <= q3")
    w = Window.partitionBy(key).orderBy("seg_start")
    segs = segs.withColumn("new", F.when(F.lag("seg_end").over(w) + 1 == F.col("seg_start"), 0).otherwise(1))
    segs = segs.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = segs.groupBy(key, "island").agg(F.min("seg_start").alias("start"), F.max("seg_end").alias("end")).where(F.col("end") - F.col("start") + 1 >= least)
    return runs.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("start")) - 1).alias("piece"), "start", "end")


def interval_union(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """``key, start, end`` of the merged intervals; touching ends merge. Intervals of one start are folded first."""
    rows = rows.groupBy(key, F.col(start).alias("s")).agg(F.max(end).alias("e"))
    w = Window.partitionBy(key).orderBy("s")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(F.col("s") <= reach, 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "island").agg(F.min("s").alias("start"), F.max("e").alias("end")).select(key, "start", "end")


def clip_ends(merged: DataFrame, lengths: DataFrame, key: str, margin: int = 200) -> DataFrame:
    """Pieces of each read with ``margin`` off both of its ends, numbered from 0 before those go that this leaves
    nothing of."""
    out = merged.join(lengths.select(key, "length"), key).withColumn("piece", F.row_number().over(Window.partitionBy(key).orderBy("start", "end")) - 1)
    out = out.select(key, F.greatest("start", F.lit(margin)).alias("start"), F.least("end", F.col("length") - margin).alias("end"), "piece")
    return out.where("start <= end")
