"""Labelled rows for the classifiers: a bounded sample, chosen by a hash of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts`` (a null id: of the empty text)."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, may_learn: Column, most: int, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = 64 << 20, longest: int = 1 << 20) -> DataFrame:
    """``id, text, label`` of at most ``most`` labelled documents and ``most_bytes`` of their text (first by hash of
    the id; labels 0 and 1 only) that ``may_learn`` allows. Texts of over ``longest`` bytes (or ``most_bytes``, if that
    is less) are no examples; they take nothing from the others. An id with several labels has the smallest, an id with
    several texts the smallest of them. The labels are broadcast, ``most`` rows bound them; documents are only
    scanned."""
    chosen = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.min("label").alias("label"))
    chosen = chosen.where(may_learn).orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).where(F.octet_length("text") <= min(longest, most_bytes))
    found = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    # one partition, of at most ``most`` rows
    before = F.sum(F.octet_length("text").cast("long")).over(Window.orderBy(F.xxhash64("id"), "id"))
    return found.withColumn("bytes", before).where(F.col("bytes") <= most_bytes).drop("bytes")
