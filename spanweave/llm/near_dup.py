"""MinHash near-dedup: BagMinHash signatures of word-shingle multisets, banded, then verified by exact overlap.

Equal texts are folded into one first. In each bucket of a band every text is paired with the bucket's most central
text (that with the most company over all its buckets) and with its neighbours in the order of the next bands; in
small buckets that is every pair, in a large one it is linear in its size. Pairs are verified on the texts. Where a
large bucket then still holds texts of several classes, those outside its centre's class are compared with all its
members of other classes, in blocks, so that no link of a large bucket is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanweave.llm import bagminhash as B
from spanweave.llm import words as W
from spanweave.operators.graph import connected_components
from spanweave.session import materialize, read_table

_SMALL = 6  # all pairs up to this bucket size
_PART = 2048  # members of a large bucket in one task


def _overlap(a: tuple, b: tuple) -> float:
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = np.minimum(a[1], b[1][at])[b[0][at] == a[0]].sum()
    return both / (a[1].sum() + b[1].sum() - both)


def _bags(texts, width: int) -> list[tuple]:
    hashes, owner = B.shingles(texts, width)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    at = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [np.unique(hashes[lo:hi], return_counts=True) for lo, hi in zip(at[:-1], at[1:], strict=True)]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, bands: int = 24, rows: int = 5) -> DataFrame:
    """``id``, ``class_id`` for each row of ``docs``: classes are the connected components of texts whose multisets of
    ``width``-word shingles have a weighted Jaccard similarity of at least ``threshold``; ``class_id`` is the smallest
    id of the class.

    Equal texts are always of one class. A text of fewer than ``width`` words has one shingle of all of them, one
    without words is only like its equals, and a null text is a class of its own for each id. Rows with a null id have
    the class of their text, null if none of its rows has an id. An id with several texts has a row for each, with
    that text's class. Repeated rows each get their row. Empty tables give an empty table; other columns don't matter.
    A pair of exactly the threshold shares a band with a probability of 1 - (1 - threshold**rows)**bands, 0.9999.
    Between classes of a large bucket a pair is only compared on its texts if its signatures agree in at least five
    standard errors below the threshold, which a pair at the threshold misses with a probability under 1e-6.
    """
    signed, classes = _classes(docs, id_col, text_col, width, threshold, bands, rows)
    return signed.select("id", "key").join(classes, "key", "left").select("id", "class_id")


def text_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What tells texts apart: the digest of a text; null texts go by their id."""
    null = F.encode(F.concat(F.lit("null "), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))), "UTF-8")
    return F.when(F.col(text_col).isNull(), null).otherwise(F.unhex(F.sha2(F.col(text_col).cast("string"), 256)))


def first_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``key`` (see text_key) of one text of each class of near duplicates: that of the smallest id, of several texts
    of this id that with the smallest key; texts without an id come last."""
    _, classes = _classes(docs, id_col, text_col, **how)
    return classes.groupBy("component").agg(F.min(F.struct(F.col("first").isNull().alias("last"), "first", "key")).alias("f")).select("f.key")


def _classes(docs: DataFrame, id_col: str, text_col: str, width: int = 5, threshold: float = 0.8, bands: int = 24, rows: int = 5) -> tuple[DataFrame, DataFrame]:
    """The rows (id, key, ...), and of each text ``key, first`` (its smallest id) ``, component, class_id``."""
    size = bands * rows
    base = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).withColumn("key", text_key("id"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text", 2 << 20):
                hashes, owner = B.shingles(part.column("text"), width)
                _, h, o, w = B.weighted(hashes, owner)
                registers = B.signatures(h, o, w, len(part), size)
                n = np.bincount(owner, minlength=len(part))
                keys = B.band_hashes(registers, bands, rows)
                some = np.where(n > 0, bands, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some)]).astype(np.int32)), pa.array(keys[n > 0].reshape(-1)))
                brief = (W.mix(registers.view(np.uint64).reshape(-1)) >> np.uint64(48)).astype(np.uint16).reshape(len(part), size)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("key"), pa.array(n.astype(np.int64)), lists, pa.array([x.tobytes() for x in brief], pa.binary())], ["id", "key", "n", "bands", "brief"])

    signed = materialize(base.mapInArrow(sign, "id long, key binary, n long, bands array<long>, brief binary"), "signatures")
    texts = signed.groupBy("key").agg(F.min("id").alias("first"), F.min(F.struct("n", "bands", "brief")).alias("s"))
    # an id may have several texts, so texts are numbered
    texts = materialize(texts.select("key", "first", F.monotonically_increasing_id().alias("rep"), F.col("s.n").alias("n"), F.col("s.bands").alias("bands"), F.col("s.brief").alias("brief")), "texts")

    near = lambda k: F.element_at("bands", (F.col("band") + k) % bands + 1)
    rows_ = texts.where(F.size("bands") > 0).select("rep", "n", "bands", F.posexplode("bands").alias("band", "bucket"))
    rows_ = rows_.select("bucket", "rep", "n", near(1).alias("next1"), near(2).alias("next2"))
    sizes = texts.select(F.explode("bands").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = materialize(rows_.join(sizes, "bucket"), "buckets")
    company = members.groupBy("rep").agg(F.sum("size").alias("company"))
    members = members.join(company, "rep")
    centres = members.groupBy("bucket").agg(F.max(F.struct("company", (-F.col("rep")).alias("minus"), "n")).alias("c")).select("bucket", (-F.col("c.minus")).alias("centre"), F.col("c.n").alias("centre_n"))
    centres = materialize(centres, "centres")

    stars = members.join(centres, "bucket").select(F.col("rep").alias("a"), "n", F.col("centre").alias("b"), F.col("centre_n").alias("m"))
    parts = F.ceil(F.col("size") / _PART).cast("int")
    line = Window.partitionBy("bucket", "part").orderBy("next1", "next2", "rep")
    beside = members.withColumn("part", F.pmod(F.xxhash64("next1"), parts)).select("rep", "n", F.array(*[F.when((F.col("size") <= _SMALL) | F.lit(k == 1), F.struct(F.lead("rep", k).over(line).alias("b"), F.lead("n", k).over(line).alias("m"))) for k in range(1, _SMALL)]).alias("to"))
    beside = beside.select(F.col("rep").alias("a"), "n", F.explode("to").alias("t")).select("a", "n", "t.b", "t.m")
    pairs = stars.union(beside).where("b IS NOT NULL AND a <> b").where(F.least("n", "m") >= threshold * F.greatest("n", "m"))
    pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")

    needed = materialize(_texts_of(base, texts, pairs.select(F.col("a").alias("rep")).union(pairs.select("b"))), "pair-texts")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "ta", 2 << 20):
                like = B.jaccard(part.column("ta"), part.column("tb"), width)
                keep = pa.array(np.flatnonzero(like >= threshold))
                yield pa.RecordBatch.from_arrays([part.column("a").take(keep), part.column("b").take(keep)], ["a", "b"])

    text = lambda k, t: needed.select(F.col("rep").alias(k), F.col("text").alias(t)).hint("merge")
    links = materialize(pairs.join(text("a", "ta"), "a").join(text("b", "tb"), "b").select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long"), "near-links")
    classes = materialize(connected_components(links, u="a", v="b"), "classes")

    # large buckets that hold more than one class
    class_of = F.coalesce("component", F.col("rep"))
    large = members.where(F.col("size") > _SMALL).select("bucket", "rep", "n", "size").join(classes.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", class_of)
    heads = centres.select("bucket", F.col("centre").alias("id")).join(classes, "id", "left").select("bucket", F.coalesce("component", "id").alias("head"))
    large = materialize(large.join(heads, "bucket"), "large-buckets")
    others = large.where("component <> head")
    if others.take(1):
        links = links.unionByName(_across(large.join(others.select("bucket").distinct(), "bucket", "left_semi"), texts, base, width, threshold))
        classes = connected_components(links, u="a", v="b")
    of_text = materialize(texts.select("key", "first", "rep").join(classes.withColumnRenamed("id", "rep"), "rep", "left").select("key", "first", class_of.alias("component")), "text-classes")
    least = of_text.groupBy("component").agg(F.min("first").alias("class_id"))
    return signed, of_text.join(least, "component")


def _texts_of(base: DataFrame, texts: DataFrame, reps: DataFrame) -> DataFrame:
    """``rep, text`` of the texts with these numbers, read off the rows with a text's smallest id, so that copies of a
    common text aren't dealt to one task. The plan is the same at every size: the numbers are never broadcast."""
    at = lambda c: F.coalesce(c, F.lit(-(2**63))).alias("at")
    wanted = texts.select("rep", "key", at("first")).join(reps.distinct(), "rep")
    found = base.select("key", at("id"), "text").join(wanted.hint("shuffle_hash"), ["key", "at"])
    return found.groupBy("key", "at").agg(F.first("rep").alias("rep"), F.first("text").alias("text")).select("rep", "text")


def _across(large: DataFrame, texts: DataFrame, base: DataFrame, width: int, threshold: float) -> DataFrame:
    """Links (a, b) between each member outside its bucket's main class and all members of other classes: one for each
    pair of a text and a class, which is all that classes need."""
    full = materialize(_texts_of(base, texts, large.select("rep")).join(texts.select("rep", "brief"), "rep"), "large-texts")
    rows = large.join(full, "rep").withColumn("parts", F.ceil(F.col("size") / _PART).cast("long"))
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    there = rows.withColumn("part", F.pmod(F.xxhash64("rep"), "parts"))
    asking = rows.where("component <> head").withColumn("part", F.explode(every))
    asking = asking.withColumn("turn", F.pmod(F.xxhash64("rep", F.lit(1)), "parts"))
    there = there.withColumn("turn", F.explode(every))
    keep = ["bucket", "part", "turn", "rep", "n", "component", "text", "brief"]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        if len(left) and len(right):
            x, y = _bags(left.column("text"), width), _bags(right.column("text_"), width)
            sx, sy = (np.array([np.frombuffer(v, np.uint16) for v in c.to_pylist()]) for c in (left.column("brief"), right.column("brief_")))
            ids, comp, n = (right.column(c).to_numpy() for c in ("rep_", "component_", "n_"))
            for i, (rep, own, size) in enumerate(zip(*(left.column(c).to_pylist() for c in ("rep", "component", "n")), strict=True)):
                like = (sy == sx[i]).mean(axis=1)
                # five standard errors of the estimate below the threshold
                close = np.flatnonzero((comp != own) & (like >= threshold - 5 * (threshold * (1 - threshold) / sx.shape[1]) ** 0.5) & (np.minimum(n, size) >= threshold * np.maximum(n, size)))
                met: set[int] = set()
                for j in close[np.argsort(-like[close], kind="stable")].tolist():
                    if comp[j] not in met and _overlap(x[i], y[j]) >= threshold:
                        met.add(comp[j])
                        a.append(rep)
                        b.append(ids[j])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    keys = ["bucket", "part", "turn"]
    there = there.select(*[F.col(c).alias(f"{c}_") for c in keep]).groupBy(*[f"{c}_" for c in keys])
    return materialize(asking.select(*keep).groupBy(*keys).cogroup(there).applyInArrow(compare, "a long, b long"), "cross-links")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "class_id")
