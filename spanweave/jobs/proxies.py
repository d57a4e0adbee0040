"""Alignment, sequence and graph inputs derived from the order tables and documents, for queries and benches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.session import read_table

#: Rows are unique in all of these together; they order rows that agree in fewer.
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
READS = {"supplier": "l_suppkey", "customer": "o_custkey", "order": "l_orderkey"}


def align(spark: SparkSession, sf_dir: str, reads: str = "supplier") -> DataFrame:
    """Alignment rows: anchor (part) intervals on reads (suppliers, customers or orders); ``line`` orders them."""
    rows = read_table(spark, sf_dir, "lineitem")
    if reads == "customer":
        rows = rows.join(read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    q, d, t = F.col("l_quantity").cast("int"), F.round(F.col("l_discount") * 100).cast("int"), F.round(F.col("l_tax") * 100).cast("int")
    start = q * 20 + d * 30
    n_start = (F.col("l_partkey") * 40 + q * 3 + d).cast("int")
    return rows.select(
        F.col(READS[reads]).alias("nano_id"), F.col("l_partkey").alias("illu_id"), start.alias("i_start"), (start + 300 + t * 100).alias("i_end_x"),
        (200 + t * 120).alias("matches"), (F.col("l_returnflag") == "A").alias("direction"), n_start.alias("n_start"), (n_start + 299 + t * 100 + t).alias("n_end"),
        F.struct(*LINE).alias("line"),
    )


ALIGN_SQL = """
align AS (SELECT {read} AS nano_id, l_partkey AS illu_id, q*20+d*30 AS i_start, q*20+d*30+300+t*100 AS i_end_x, 200+t*120 AS matches,
  l_returnflag = 'A' AS direction, CAST(l_partkey*40+q*3+d AS INT) AS n_start, CAST(l_partkey*40+q*3+d+299+t*100+t AS INT) AS n_end,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
  FROM (SELECT *, CAST(l_quantity AS INT) AS q, CAST(round(l_discount*100) AS INT) AS d, CAST(round(l_tax*100) AS INT) AS t
        FROM lineitem{join}))"""


def align_sql(reads: str = "supplier") -> str:
    return ALIGN_SQL.format(read=READS[reads], join=" JOIN orders ON l_orderkey = o_orderkey" if reads == "customer" else "")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, seq``: the letters A, C, G and T of each document."""
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^acgtACGT]", "")).alias("seq"))


SEQ_SQL = "seqs AS (SELECT doc_id AS id, upper(regexp_replace(coalesce(text,''), '[^acgtACGT]', '', 'g')) AS seq FROM documents)"
