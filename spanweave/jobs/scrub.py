"""Read cleaning as one job: what anchors and other reads cover of a read is kept, in pieces, without the read's ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.operators import alignments, intervals
from spanweave.session import materialize
from spanweave.sources import records


def covered_ranges(anchors: DataFrame, overlaps: DataFrame, least: int = 500, gap: int = 500, margin: int = 200) -> DataFrame:
    """``nano_id, piece, start, end``: the parts of each read that count as covered, inclusive, with ``margin`` off its
    ends, numbered from 0 before parts go that this leaves nothing of.

    ``anchors`` are alignments of anchors to reads, ``overlaps`` of reads (``illu_id``) to reads (``nano_id``), both with
    the columns of parse_paf(). Of an anchor's hits on a read of at least ``least`` positions the first line counts; of
    two reads' hits as long, those of the first line and what extends it (see merge_hits), on both sides. Hits of a read
    with itself, and of reads without an anchor, don't count. A covered part ends one position behind its hits, as the
    end of an alignment line is exclusive and this one isn't. A read's length is that of its first line. Rows with a
    null read count for nothing.

    Nothing is cut into batches: whichever reads are overlapped at once, a read's ranges are those of all its rows.
    """
    hits = anchors.where((F.col("i_end_x") - F.col("i_start") >= least) & F.col("nano_id").isNotNull())
    hits = materialize(hits.select("nano_id", "illu_id", "n_start", "n_end", "n_len", "line"), "anchor-hits")
    reads = hits.groupBy("nano_id").agg(F.min_by("n_len", "line").alias("length"))
    first = alignments.first_match(hits).select("nano_id", "n_start", (F.col("n_end") + 1).alias("n_end"))
    both = overlaps.where((F.col("i_end_x") - F.col("i_start") >= least) & (F.col("illu_id") != F.col("nano_id")))
    known = lambda df, c: df.join(reads.select(F.col("nano_id").alias(c)), c, "left_semi")
    both = known(known(both, "illu_id"), "nano_id")
    sides = both.select("nano_id", "illu_id", "n_start", (F.col("n_end") + 1).alias("n_end"), "direction", "line")
    sides = sides.union(both.select(F.col("illu_id").alias("nano_id"), F.col("nano_id").alias("illu_id"), F.col("i_start").alias("n_start"), F.col("i_end_x").alias("n_end"), "direction", "line"))
    merged = alignments.merge_hits(sides, gap).select("nano_id", "n_start", "n_end")
    parts = intervals.interval_union(first.union(merged), "nano_id", "n_start", "n_end")
    return intervals.clip_ends(parts, reads, "nano_id", margin)


def scrubbed(ranges: DataFrame, reads: DataFrame) -> DataFrame:
    """``id, seq`` of each piece (see covered_ranges): the read's id, '_' and the piece's number. A read's text is joined
    once, with all its ranges; reads that aren't there give nothing."""
    own = ranges.groupBy("nano_id").agg(F.collect_list(F.struct("piece", "start", "end")).alias("parts"))
    rows = own.join(reads.select(F.col("id").alias("nano_id"), "seq"), "nano_id").select("nano_id", "seq", F.explode("parts").alias("p"))
    return rows.select(F.concat_ws("_", F.col("nano_id").cast("string"), F.col("p.piece").cast("string")).alias("id"), F.substring("seq", F.col("p.start") + 1, F.col("p.end") - F.col("p.start") + 1).alias("seq"))


def scrub_files(spark: SparkSession, anchors: str, overlaps: str, reads: str, out: str, **limits) -> None:
    """From alignment files of anchors and of reads, and the reads' file (FASTA or FASTQ, by its suffix), the pieces as
    FASTA text in the folder ``out``."""
    ranges = covered_ranges(records.read_paf(spark, anchors), records.read_paf(spark, overlaps), **limits)
    records.fasta_lines(scrubbed(ranges, records.read_sequences(spark, reads))).write.text(out)
