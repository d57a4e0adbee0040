"""How far the sources of a language lie apart in their terms.

Equal texts of a language are folded into one with its multiplicity in each source, so that each is tokenised once and
its terms are counted with those weights. Only terms in enough documents of their language are kept. A pair of sources
is evaluated sparsely: with a count of zero a share depends on the group alone, so what a term adds to a pair is found
from (1) how many terms a source has with each count, against the other's share of an absent term, and (2) a correction
for the terms that both have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanweave.llm import words as W
from spanweave.session import materialize, read_table

_ONE = 1_000_000_000
_SLICE = 8 << 20  # bytes of text that a task counts at once
_PAIRS = 1 << 18  # pairs of sources that a task adds up at once
_SALT = 32
_GAP = np.ones(256, bool)  # bytes that are in no term
_GAP[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of all terms in the bytes of several texts."""
    mark = np.zeros(len(data) + 1, bool)
    mark[offsets] = True
    term, before, after = ~_GAP[data], np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = term[:-1], term[1:]
    return np.flatnonzero(term & (~before | mark[:-1])), np.flatnonzero(term & (~after | mark[1:])) + 1


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From distinct texts (``lang, text, copies: array<struct<source, n>>``) the rows ``lang, source, term, count,
    docs``: occurrences and documents, copies counted, added up for each slice of a batch."""
    for batch in batches:
        for part in W.slices(batch, "text", _SLICE):
            data, offsets = W.text_buffer(part.column("text"))
            starts, ends = _runs(data, offsets)
            if not len(starts):
                continue
            size = ends - starts
            at = np.zeros(len(size) + 1, np.int32)
            np.cumsum(size, out=at[1:])
            terms = pa.StringArray.from_buffers(len(size), pa.py_buffer(at), pa.py_buffer(_LOWER[data[~_GAP[data]]])).dictionary_encode()
            names, code = terms.dictionary, terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.searchsorted(offsets, starts, "right") - 1
            # how often each text has each of its terms
            key, often = np.unique(owner * len(names) + code, return_counts=True)
            owner, code = key // len(names), key % len(names)
            copies = part.column("copies")
            n = copies.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat, lang = copies.flatten(), part.column("lang").dictionary_encode()
            source = flat.field("source").dictionary_encode()
            first, weight = np.cumsum(n) - n, flat.field("n").to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(key)), n[owner])
            copy = W.ranges(first[owner], n[owner])
            group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[owner[row]] * len(source.dictionary) + source.indices.to_numpy(zero_copy_only=False)[copy]
            groups, group = np.unique(group, return_inverse=True)
            whole = group * len(names) + code[row]
            order = np.argsort(whole, kind="stable")
            whole = whole[order]
            cut = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]]))
            w = weight[copy][order]
            of, term = whole[cut] // len(names), whole[cut] % len(names)
            yield pa.RecordBatch.from_arrays(
                [lang.dictionary.take(pa.array(groups[of] // len(source.dictionary))), source.dictionary.take(pa.array(groups[of] % len(source.dictionary))), names.take(pa.array(term)), pa.array(np.add.reduceat(w * often[row][order], cut)), pa.array(np.add.reduceat(w, cut))],
                ["lang", "source", "term", "count", "docs"],
            )


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All groups (``lang, source``), and ``lang, source, term, count, docs`` of all terms. Nulls are read as ''."""
    read = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(k) for c, k in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    read = read.withColumn("digest", F.unhex(F.sha2("text", 256)))
    copies = materialize(read.groupBy("lang", "digest", "source").agg(F.count("*").alias("n")), "copies")
    by_text = copies.groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "n")).alias("copies"))  # a struct a source
    texts = read.groupBy("lang", "digest").agg(F.first("text").alias("text")).join(by_text.hint("shuffle_hash"), ["lang", "digest"])
    counted = texts.select("lang", "text", "copies").mapInArrow(count_terms, "lang string, source string, term string, count long, docs long")
    return copies.select("lang", "source").distinct(), counted.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 * (count + 2) / (total + 2 * terms)), in decimals; null without terms."""
    wide = F.lit(_ONE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    return F.when(terms > 0, F.call_function("div", wide, (total + 2 * terms).cast("decimal(20,0)")) + 1)


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / (p + q)); shares are at most 10**9 + 1, so all of it fits in 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def joint_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a row a term (``lang, sources: array<struct<id, p, p0>>``, sorted by id, ids are a group's number) the rows
    ``a, b, terms, more`` with a < b: terms that both have, and the correction of the pair's sum. The pairs of a
    term are taken in stretches and added up before they leave."""
    for batch in batches:
        lists = batch.column("sources")
        flat = lists.flatten()
        g, p, p0 = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("id", "p", "p0"))
        n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        # each entry is paired with those after it in its list
        after = np.repeat(np.cumsum(n), n) - np.arange(len(g)) - 1
        border = np.cumsum(after)
        lo = 0
        while lo < len(g):
            hi = max(lo + 1, int(np.searchsorted(border, (border[lo - 1] if lo else 0) + _PAIRS, "right")))
            i = np.repeat(np.arange(lo, hi), after[lo:hi])
            j = W.ranges(np.arange(lo, hi) + 1, after[lo:hi])
            lo = hi
            if not len(i):
                continue
            more = _distance(p[i], p[j]) - _distance(p[i], p0[j]) - _distance(p0[i], p[j])
            order = np.lexsort((g[j], g[i]))
            a, b = g[i][order], g[j][order]
            cut = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            yield pa.RecordBatch.from_arrays([pa.array(a[cut]), pa.array(b[cut]), pa.array(np.diff(np.append(cut, len(a)))), pa.array(np.add.reduceat(more[order], cut))], ["a", "b", "terms", "more"])


def divergence(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """``lang, source, part, item, value, rank`` for each group (lang, source) of ``docs``: part ``pair`` has each other
    source of the lang and the sum of the distances of all kept terms' shares, part ``term`` the ``top`` terms that the
    group has and uses more than its lang, by distance. Ranks are by value descending, then item.

    A term is a run of ASCII letters (A-Z lower-cased) and non-ASCII characters; kept if at least ``least_docs`` rows
    of its lang have it. Null and empty texts make a group without terms; a lang without kept terms has pairs of value
    0. Repeated rows count each. A lang with one source has no pairs. An empty table gives an empty result. Other
    columns don't matter. Counts up to 10**18 and totals are exact.
    """
    groups, counts = term_counts(docs)
    counts = materialize(counts, "term-counts")
    groups = materialize(groups.withColumn("id", F.monotonically_increasing_id()), "groups")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("lang_count"), F.collect_list(F.struct("source", "count")).alias("own")).where(F.col("docs") >= least_docs)
    kept = materialize(kept.drop("docs"), "kept-terms")
    langs = groups.select("lang").distinct().join(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_count").alias("lang_n")), "lang", "left").na.fill(0, ["v", "lang_n"])
    cells = kept.select("lang", "term", "lang_count", F.explode("own").alias("o")).select("lang", "term", "lang_count", "o.source", "o.count")
    totals = cells.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count("*").alias("has"))
    stats = groups.join(totals, ["lang", "source"], "left").na.fill(0, ["n", "has"]).join(langs, "lang")
    stats = materialize(stats.withColumn("p0", share(F.lit(0).cast("long"), F.col("n"), F.col("v"))), "group-stats")
    cells = cells.join(stats, ["lang", "source"])
    cells = materialize(cells.select("lang", "source", "id", "term", "p0", share(F.col("count"), F.col("n"), F.col("v")).alias("p"), share(F.col("lang_count"), F.col("lang_n"), F.col("v")).alias("q")), "cells")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = cells.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    # every term of a source, as if the other had it not: so often each share, against that of an absent term
    spread = cells.groupBy("lang", "id", "p").agg(F.count("*").alias("often")).withColumn("salt", F.pmod(F.xxhash64("id", "p"), F.lit(_SALT)))
    others = stats.select("lang", F.col("id").alias("other"), F.col("p0").alias("q0"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALT - 1).cast("long"))).alias("salt"))
    alone = spread.join(others, ["lang", "salt"]).where("id <> other")
    alone = alone.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), F.lit(0).cast("long").alias("terms"), (F.col("often") * distance(F.col("p"), F.col("q0"))).alias("more"))
    rows = cells.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("id", "p", "p0"))).alias("sources")).where(F.size("sources") > 1)
    both = rows.select("sources").mapInArrow(joint_terms, "a long, b long, terms long, more long")
    sums = alone.unionByName(both).groupBy("a", "b").agg(F.sum("terms").alias("both"), F.sum("more").alias("more"))

    side = lambda k: stats.select("lang", F.col("id").alias(k), F.col("source").alias(f"{k}_source"), F.col("has").alias(f"{k}_has"), F.col("p0").alias(f"{k}_p0"), *(["v"] if k == "a" else []))
    pairs = side("a").join(side("b"), "lang").where("a < b").join(sums, ["a", "b"], "left").na.fill(0, ["both", "more"])
    none = F.col("v") - F.col("a_has") - F.col("b_has") + F.col("both")
    value = F.when(F.col("v") == 0, F.lit(0).cast("long")).otherwise(F.col("more") + none * distance(F.col("a_p0"), F.col("b_p0")))
    pairs = pairs.withColumn("value", value).withColumn("to", F.explode(F.array(F.struct(F.col("a_source").alias("source"), F.col("b_source").alias("item")), F.struct(F.col("b_source").alias("source"), F.col("a_source").alias("item")))))
    pairs = pairs.select("lang", "to.source", F.lit("pair").alias("part"), "to.item", "value").withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(terms)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read_table(spark, sf_dir, "documents").select("lang", "source", "text"))


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
tokens AS (SELECT d, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lc FROM tokens GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
groups AS (SELECT DISTINCT lang, source FROM docs),
langs AS (SELECT g.lang, count(k.term) AS v, coalesce(sum(k.lc), 0)::HUGEINT AS ln FROM (SELECT DISTINCT lang FROM groups) g LEFT JOIN kept k ON k.lang = g.lang GROUP BY g.lang),
counts AS (SELECT lang, source, term, count(*) AS c FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY ALL),
cells AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, k.lc FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
totals AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM cells GROUP BY ALL),
shares AS (SELECT lang, source, term, c, 1 + (1000000000::HUGEINT * (c + 2)) // (n + 2 * v) AS p, 1 + (1000000000::HUGEINT * (lc + 2)) // (ln + 2 * v) AS q FROM cells JOIN totals USING (lang, source) JOIN langs USING (lang)),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(max(f.value), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f
    ON f.lang = a.lang AND f.source = a.source AND f.item = b.source GROUP BY ALL),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM shares WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pairs
UNION ALL SELECT * FROM (SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM terms) WHERE rank <= 10
"""
