"""Benchmark decontamination by latent semantic retrieval.

The corpus is cut into passages, which are rows of a TF-IDF matrix over hashed words, with document frequencies counted
over the whole corpus. Its randomised SVD takes two scans, however long the benchmark: the first counts words and
applies A'A to random vectors (without weights, as they aren't known yet), the second applies the weighted A'A to an
orthonormal basis of that, and the small eigenproblem of the projection gives singular vectors and values. Tasks send
packed partial sums, whose size doesn't depend on the input.

A third scan searches. Every benchmark passage is compared with the windows of the documents by cosine, in the latent
space and in all words (the larger counts); candidates are checked by their longest common subsequence of words and by
their answers. Windows that can't pass the subsequence check aren't compared: of an item's rarest words, so many must be
near each other that those missing could all be among the words that the check allows to be missing. An index of these
words is all that a token meets, so the cost follows the corpus, not corpus times benchmark, and nothing is lost by it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm import words as W
from spanweave.session import read_table

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x30:0x3A], _FOLD[0x61:0x7B], _FOLD[0x80:] = np.arange(0x30, 0x3A), np.arange(0x61, 0x7B), np.arange(0x80, 0x100)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def plain_words(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts and where each text's begin. Words are runs of letters and digits, in lower
    case (ASCII and Latin-1; other characters stay)."""
    data, offsets = W.text_buffer(texts)
    data = _FOLD[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, np.int64)
    upper = lead[(data[lead] <= 0x9E) & (data[lead] != 0x97)]
    data[upper] += 0x20
    starts, ends, first = W.spans(data, offsets)
    return W.word_hashes(data, starts, ends), first


def common_subsequence(a: list[int], b: list[int]) -> np.ndarray:
    """For each prefix of a: the length of its longest common subsequence with b, bit-parallel over a."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    v = full = (1 << len(a)) - 1
    for x in b:
        m = where.get(x, 0)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    bits = np.array([1 - ((v >> i) & 1) for i in range(len(a))], np.int64)
    return np.cumsum(bits)


_BITS, _RANK_BITS = 18, 15  # hashed words: for frequencies, and as columns of the matrix
_ALL, _COLUMNS = 1 << _BITS, 1 << _RANK_BITS
_PART = 1 << 13  # numbers of a partial sum in one row


def _passages(texts, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of each passage, sorted, one row each; and which of them come first among equals."""
    h, at = plain_words(texts)
    n = -(-np.diff(at) // window)
    lo = W.ranges(np.zeros(len(n), np.int64), n) * window + np.repeat(at[:-1], n)
    place = lo[:, None] + np.arange(window)
    there = place < np.repeat(at[1:], n)[:, None]
    words = np.full(place.shape, _ALL, np.int32)
    words[there] = (h & np.uint64(_ALL - 1)).astype(np.int32)[place[there]]
    words.sort(axis=1)
    first = words < _ALL
    first[:, 1:] &= words[:, 1:] != words[:, :-1]
    return words, first


def _gram(words: np.ndarray, weight: np.ndarray, basis: np.ndarray, into: np.ndarray) -> None:
    """Adds A'(A basis) of these passages, rows scaled to unit length, to ``into`` (columns first)."""
    for s in range(0, len(words), 4096):
        w, x = words[s : s + 4096] & (_COLUMNS - 1), weight[s : s + 4096]
        norm = np.sqrt((x * x).sum(axis=1))
        x = x / np.maximum(norm, 1e-12)[:, None]
        y = np.zeros((len(w), basis.shape[1]), np.float32)
        for k in range(w.shape[1]):
            y += x[:, k, None] * basis[w[:, k]]
        row, col = np.nonzero(x)
        w, x = w[row, col], x[row, col]
        for j in range(basis.shape[1]):
            into[j] += np.bincount(w, x * y[row, j], _COLUMNS)


def _rows(kind: int, sums: np.ndarray) -> pa.RecordBatch:
    flat = sums.astype(np.float64).reshape(-1)
    parts = [flat[k : k + _PART].tobytes() for k in range(0, len(flat), _PART)]
    return pa.RecordBatch.from_arrays([pa.array([kind << 32 | k for k in range(len(parts))], pa.int64()), pa.array(parts, pa.binary())], ["part", "sums"])


def _added(partial: DataFrame, tasks: int) -> dict[int, np.ndarray]:
    """Sums of each kind of ``part long, sums binary``. A task adds up the parts dealt to it as they come; what the
    driver gets has the size of one partial sum."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                x = np.frombuffer(raw)
                have[part] = have[part] + x if part in have else x
        yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.int64()), pa.array([x.tobytes() for x in have.values()], pa.binary())], ["part", "sums"])

    found = sorted(partial.repartition(tasks, "part").mapInArrow(add, "part long, sums binary").toArrow().to_pylist(), key=lambda r: r["part"])
    kinds = {r["part"] >> 32 for r in found}
    return {kind: np.concatenate([np.frombuffer(r["sums"]) for r in found if r["part"] >> 32 == kind]) for kind in kinds}


@dataclass
class Space:
    """TF-IDF weights of hashed words, and the right singular vectors of the passages (columns x rank) with their
    singular values."""

    idf: np.ndarray
    vectors: np.ndarray
    values: np.ndarray


def latent_space(texts: DataFrame, window: int = 32, rank: int = 24, spare: int = 8, seed: int = 11, tasks: int = 64) -> Space:
    """Randomised SVD of the passages (``window`` words each) of all rows of ``texts`` (a column ``text``)."""
    width = rank + spare
    omega = np.random.default_rng(seed).normal(size=(_COLUMNS, width)).astype(np.float32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, z = np.zeros(_ALL + 1, np.int64), np.zeros((width, _COLUMNS))
        for batch in batches:
            for part in W.slices(batch, "text", 1 << 20):
                words, first = _passages(part.column("text"), window)
                df += np.bincount(words[first], minlength=_ALL + 1)
                df[_ALL] += len(words)
                _gram(words, first.astype(np.float32), omega, z)
        if df[_ALL]:
            yield _rows(0, df)
            yield _rows(1, z)

    got = _added(texts.select("text").mapInArrow(count, "part long, sums binary"), tasks)
    if not got:
        return Space(np.ones(_ALL, np.float32), np.zeros((_COLUMNS, 0), np.float32), np.zeros(0))
    total = got[0][_ALL]
    idf = (np.log((total + 1) / (got[0][:_ALL] + 1)) + 0.1).astype(np.float32)
    basis = np.linalg.qr(got[1].reshape(width, _COLUMNS).T)[0].astype(np.float32)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, some = np.zeros((width, _COLUMNS)), False
        for batch in batches:
            for part in W.slices(batch, "text", 1 << 20):
                words, first = _passages(part.column("text"), window)
                some |= bool(len(words))
                _gram(words, np.where(first, idf[words & (_ALL - 1)], np.float32(0)), basis, z)
        if some:
            yield _rows(1, z)

    z = _added(texts.select("text").mapInArrow(project, "part long, sums binary"), tasks)[1].reshape(width, _COLUMNS).T
    # Q'A'AQ is small; its eigenvectors turn the basis into singular vectors of A
    small = basis.T.astype(np.float64) @ z
    squares, turn = np.linalg.eigh((small + small.T) / 2)
    keep = np.argsort(-squares)[:rank]
    keep = keep[squares[keep] > 1e-9 * max(squares.max(), 1e-12)]
    return Space(idf, (basis @ turn[:, keep]).astype(np.float32), np.sqrt(squares[keep]))


class Items:
    """Benchmark items with an index of the words that a place must hold for an item to be possible there."""

    def __init__(self, table: pa.Table, space: Space, overlap: float, passage: int = 48, least: float = 0.2):
        hashes, first = plain_words(table.column("text"))
        answers, answer_first = plain_words(table.column("answer"))
        some = np.flatnonzero(np.diff(first))
        self.words = [hashes[first[i] : first[i + 1]] for i in some]
        self.answers = [answers[answer_first[i] : answer_first[i + 1]].tolist() for i in some]
        self.ids = [table.column("item_id")[int(i)].as_py() for i in some]
        self.size = np.array([len(x) for x in self.words], np.int64)
        self.need = np.zeros(len(some), np.int64)
        self.passages: list[list[tuple]] = []
        index = []
        for i, x in enumerate(self.words):
            # so many places of the item may be unmatched; of that many and ``need`` more, ``need`` are matched
            spare = len(x) - math.ceil(overlap * len(x) - 1e-9)
            self.need[i] = need = max(1, math.ceil(least * len(x)))
            rare = np.lexsort((x, -space.idf[(x & np.uint64(_ALL - 1)).astype(np.int64)]))[: spare + need]
            index.append(np.unique(x[rare]))
            cut = [x[k : k + passage] for k in range(0, len(x), passage)]
            self.passages.append([_vector(p, space) for p in cut if len(p) >= 8 or len(cut) == 1])
        owner = np.repeat(np.arange(len(index)), [len(x) for x in index])
        flat = np.concatenate(index) if index else np.zeros(0, np.uint64)
        order = np.lexsort((owner, flat))
        self.key, self.at = np.unique(flat[order], return_index=True)
        self.at, self.owner = np.append(self.at, len(flat)), owner[order]

    def places(self, h: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
        """``text, item, begin, end`` of the places that can hold an item, places that touch as one."""
        near = np.minimum(np.searchsorted(self.key, h), len(self.key) - 1)
        p = np.flatnonzero(self.key[near] == h)
        k = near[p]
        n = self.at[k + 1] - self.at[k]
        item, p = self.owner[W.ranges(self.at[k], n)], np.repeat(p, n)
        order = np.argsort(item, kind="stable")
        item, p = item[order], p[order]
        text = np.searchsorted(at, p, side="right") - 1
        last = np.arange(len(p)) + self.need[item] - 1
        ok = last < len(p)
        last = np.minimum(last, max(len(p) - 1, 0))
        ok &= (item[last] == item) & (text[last] == text) & (p[last] - p <= window + 2 * self.size[item])
        item, text, begin, end = item[ok], text[ok], p[ok], p[last[ok]] + 1
        begin, end = np.maximum(begin - self.size[item], at[text]), np.minimum(end + self.size[item], at[text + 1])
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (begin[1:] > end[:-1])
        lead = np.flatnonzero(new)
        return text[lead], item[lead], begin[lead], end[np.append(lead[1:], len(item)) - 1] if len(lead) else end


def _vector(words: np.ndarray, space: Space) -> tuple:
    """Distinct words with their unit weights, and the unit latent vector."""
    w, n = np.unique(words, return_counts=True)
    x = n * space.idf[(w & np.uint64(_ALL - 1)).astype(np.int64)].astype(np.float64)
    latent = x @ space.vectors[(w & np.uint64(_COLUMNS - 1)).astype(np.int64)]
    return w, x / np.sqrt((x * x).sum()), latent / max(np.sqrt((latent * latent).sum()), 1e-12)


def window_cosines(h: np.ndarray, passages: list[tuple], space: Space, window: int, stride: int) -> float:
    """The largest cosine of a window of these words with one of the passages, in all words or in the latent space."""
    idf = space.idf[(h & np.uint64(_ALL - 1)).astype(np.int64)].astype(np.float64)
    lo = np.arange(0, max(1, len(h) - window + stride), stride)
    hi = np.minimum(lo + window, len(h))
    total = lambda x: np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
    between = lambda x: x[hi] - x[lo]
    norm = np.sqrt(np.maximum(between(total(idf * idf)), 1e-12))
    latent = between(total(idf[:, None] * space.vectors[(h & np.uint64(_COLUMNS - 1)).astype(np.int64)]))
    latent_norm = np.sqrt(np.maximum((latent * latent).sum(axis=1), 1e-12))
    best = 0.0
    for words, weights, vector in passages:
        near = np.minimum(np.searchsorted(words, h), len(words) - 1)
        plain = between(total(np.where(words[near] == h, idf * weights[near], 0.0))) / norm
        best = max(best, float(plain.max()), float((latent @ vector / latent_norm).max()))
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None, window: int = 32, stride: int = 8, rank: int = 24, cosine: float = 0.25, overlap: float = 0.6, tail: float = 0.25, block: int = 32_768) -> DataFrame:
    """``id, item_id, overlap, cosine``: the benchmark items found in each document, each once (its best find).

    An item is found where a window of ``window`` words has a cosine of at least ``cosine`` with one of its passages,
    in the latent space or in all words (the larger counts), ``overlap`` of the item's words are a common subsequence
    with the document around it, and its answer is there: all words of ``answer_col`` in order where that is given and
    not empty, else ``overlap`` of the last ``tail`` of the item. Case and punctuation don't count.

    Items and texts that are null or have no words are found nowhere. Rows with a null id give null ids; repeated rows
    give one result; of repeated items each has its own. Empty tables give an empty table; other columns don't matter.
    Very long items are cut into passages of 48 words for retrieval, but checked as a whole. The corpus is scanned
    twice for the latent space and once for each ``block`` of items, which bounds what tasks are sent.
    """
    spark = docs.sparkSession
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    answer = F.lit("") if answer_col is None else F.coalesce(benchmark[answer_col].cast("string"), F.lit(""))
    items = benchmark.select(benchmark[item_col].cast("long").alias("item_id"), benchmark[item_text].cast("string").alias("text"), answer.alias("answer")).where("text IS NOT NULL").distinct()
    n_blocks = max(1, math.ceil(items.count() / block))
    space = latent_space(texts, window, rank)
    out = spark.createDataFrame([], "id long, item_id long, overlap double, cosine double")
    for b in range(n_blocks):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b).orderBy("item_id", "text", "answer").toArrow()
        out = out.unionByName(_search(texts, Items(some, space, overlap), space, window, stride, cosine, overlap, tail))
    return out.groupBy("id", "item_id").agg(F.max("overlap").alias("overlap"), F.max("cosine").alias("cosine"))


def _search(texts: DataFrame, items: Items, space: Space, window: int, stride: int, cosine: float, overlap: float, tail: float) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text", 1 << 20):
                h, at = plain_words(part.column("text"))
                out = []
                places = items.places(h, at, window) if len(items.key) else ()
                for d, i, a, b in zip(*(x.tolist() for x in places), strict=True):
                    like = window_cosines(h[a:b], items.passages[i], space, window, stride)
                    if like < cosine:
                        continue
                    item, around = items.words[i].tolist(), h[a:b].tolist()
                    share = common_subsequence(item, around)[-1] / len(item)
                    if share < overlap:
                        continue
                    if items.answers[i]:
                        right = common_subsequence(items.answers[i], around)[-1] == len(items.answers[i])
                    else:
                        end = item[-max(1, math.ceil(tail * len(item))) :]
                        right = common_subsequence(end, around)[-1] >= overlap * len(end)
                    if right:
                        out.append((part.column("id")[d].as_py(), items.ids[i], float(share), like))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["id", "item_id", "overlap", "cosine"])

    return texts.mapInArrow(search, "id long, item_id long, overlap double, cosine double")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", F.round("overlap", 4).alias("overlap"))
