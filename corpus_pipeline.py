"""A corpus pipeline: each stage applies one operator to all that its predecessor kept.

quality classifier -> near-dedup -> substring dedup -> benchmark decontamination -> byte-level BPE. All stages but the
last return the columns of ``documents``; between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm.bpe import encode_and_check, tokenizer
from spanweave.llm.decontaminate import contaminated
from spanweave.llm.labels import fold
from spanweave.llm.near_dup import first_texts, text_key
from spanweave.llm.quality import learn_quality, score_quality
from spanweave.llm.substring_dedup import dedup_substrings
from spanweave.session import materialize, read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose quality score is at least 0.7; labels of held-out rows teach nothing."""
    model = learn_quality(docs, read_table(spark, sf_dir, "labels"), may_learn=fold("id", 4) != 2)
    return score_quality(docs.select(*COLUMNS), model, score_col="quality_score").where("quality_score >= 0.7").select(*COLUMNS)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each class of near duplicates: of its text with the smallest id, the row that comes first by
    id (null last), lang, source and length. An id with two texts of different classes keeps both; null texts stay,
    one row for each id."""
    rows = docs.select(*COLUMNS).withColumn("key", text_key())
    order = [F.col("doc_id").isNull().alias("last"), "doc_id", "lang", "source", "n_chars"]
    once = rows.groupBy("key").agg(F.min(F.struct(*order)).alias("r"), F.first("text").alias("text"))
    return once.join(first_texts(docs), "key").select("r.doc_id", "text", "r.lang", "r.source", "r.n_chars")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated windows of 20 words out of the texts; a text that loses nothing stays as it is."""
    out = dedup_substrings(docs, carry=COLUMNS)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("row.text"))
    return out.select("row.doc_id", text.alias("text"), "row.lang", "row.source", F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars")).alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows in whose text an item of the benchmark is found. Texts are told apart by a 64-bit hash, as an id
    may have several or be null."""
    rows = docs.select(*COLUMNS).withColumn("text_hash", F.xxhash64("text"))
    found = contaminated(rows, read_table(spark, sf_dir, "benchmark"), id_col="text_hash").select(F.col("id").alias("text_hash")).distinct()
    return rows.join(found, "text_hash", "left_anti").select(*COLUMNS)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether decoding gives the text back."""
    tokens = encode_and_check(docs.select("doc_id", "text", "lang", "source"), *tokenizer())
    return tokens.select("doc_id", "lang", "source", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), "round_trip")


STAGES = [
    ("quality classifier", keep_quality),
    ("near dedup", keep_one_of_each_class),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode_texts),
]

#: A trained classifier and a latent space are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
