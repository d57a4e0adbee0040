"""Quality classifier by gated-attention multiple-instance learning.

A document is a bag of passages. Every passage is encoded as a vector of what its bytes and words are like; a gated
attention network, learned from document labels alone, weighs the passages, and a logistic unit scores the weighted
passage representation. Training takes a bounded sample of labelled rows; scoring is one scan without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm import words as W
from spanweave.llm.labels import fold, labelled_sample
from spanweave.session import read_table

_CLASSES = 12
_KIND = np.full(256, 10, np.uint8)  # other ASCII
_KIND[0x61:0x7B], _KIND[0x41:0x5B], _KIND[0x30:0x3A], _KIND[0x80:] = 0, 1, 2, 3
for _k, _chars in enumerate((b" ", b"\n", b".", b",", b"!?", b"#$%&*"), 4):
    _KIND[list(_chars)] = _k
_KIND[list(b"|<>{}[]\\/=_~^@")] = 11
_HASHED = 16
WIDTH = _CLASSES + 9 + _HASHED


def encode_passages(texts, passage: int) -> tuple[np.ndarray, np.ndarray]:
    """One row of WIDTH features for each passage of ``passage`` words, and for each text the number of its first
    passage (one more at the end). A text without words is one passage."""
    data, offsets = W.text_buffer(texts)
    starts, ends, first = W.spans(data, offsets)
    n_words = np.diff(first)
    n_passages = np.maximum(1, -(-n_words // passage))
    at = np.concatenate([[0], np.cumsum(n_passages)])
    total = int(at[-1])
    within = np.arange(total) - np.repeat(at[:-1], n_passages)
    begin = np.minimum(np.repeat(first[:-1], n_passages) + within * passage, np.repeat(first[1:], n_passages))
    bounds = np.append(begin, len(starts))  # words of passage p: bounds[p] to bounds[p + 1]
    size = np.diff(bounds)
    lo = np.where(within == 0, np.repeat(offsets[:-1], n_passages), np.append(starts, len(data))[begin])
    length = np.diff(np.append(lo, len(data)))
    of_byte = np.repeat(np.arange(total), length)
    shares = np.bincount(of_byte * _CLASSES + _KIND[data], minlength=total * _CLASSES).reshape(total, _CLASSES) / np.maximum(length, 1)[:, None]

    of_word = np.repeat(np.arange(total), size)
    some = np.maximum(size, 1)
    mean = lambda x: np.bincount(of_word, x, total) / some
    h = W.word_hashes(data, starts, ends)
    chars = (ends - starts).astype(float)
    same = lambda k: np.concatenate([np.zeros(min(k, len(h)), bool), h[k:] == h[:-k]]) if len(h) else np.zeros(0, bool)
    order = np.lexsort((h, of_word))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])
    length_mean = mean(chars)
    last = _KIND[data[ends - 1]] if len(ends) else np.zeros(0, np.uint8)
    lead = _KIND[data[starts]] if len(starts) else np.zeros(0, np.uint8)
    stats = [np.log1p(size), length_mean / 8, np.sqrt(np.maximum(mean(chars**2) - length_mean**2, 0)) / 8, mean(same(1)), mean(same(2)), np.bincount(of_word[order], new, total) / some, mean(last > 3), mean(lead == 1), (size == 0).astype(float)]
    hashed = [mean(((h >> np.uint64(48 + b)) & np.uint64(1)).astype(float)) * 2 - 1 for b in range(_HASHED)]
    return np.column_stack([shares, *stats, *hashed]).astype(np.float32), at


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class GatedAttention:
    """Attention a = softmax(w . (tanh(V h) * sigmoid(U h))) over the passages of a bag; score sigmoid(c . sum(a h) + b)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    passage: int

    @staticmethod
    def _forward(p: dict, x: np.ndarray, at: np.ndarray) -> tuple:
        own = np.repeat(np.arange(len(at) - 1), np.diff(at))
        t, g = np.tanh(x @ p["V"]), _sigmoid(x @ p["U"])
        s = (t * g) @ p["w"]
        s = np.exp(s - np.maximum.reduceat(s, at[:-1])[own])
        a = s / np.add.reduceat(s, at[:-1])[own]
        z = np.add.reduceat(a[:, None] * x, at[:-1], axis=0)
        return own, t, g, a, z, _sigmoid(z @ p["c"] + p["b"])

    def attention(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The weight of each passage and the score of each bag."""
        *_, a, _, y = self._forward(self.weights, np.clip((x - self.mean) / self.scale, -8, 8), at)
        return a, y

    @classmethod
    def fit(cls, x: np.ndarray, at: np.ndarray, y: np.ndarray, passage: int, hidden: int = 12, epochs: int = 30, batch: int = 128, rate: float = 0.01, decay: float = 1e-3, seed: int = 3) -> GatedAttention:
        rng = np.random.default_rng(seed)
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = np.clip((x - mean) / scale, -8, 8)
        d = x.shape[1]
        p = {"V": rng.normal(0, 0.1, (d, hidden)), "U": rng.normal(0, 0.1, (d, hidden)), "w": rng.normal(0, 0.1, hidden), "c": np.zeros(d), "b": np.zeros(1)}
        m, v, step = {k: 0 * q for k, q in p.items()}, {k: 0 * q for k, q in p.items()}, 0
        for _ in range(epochs if len(y) else 0):
            for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
                n = np.diff(at)[part]
                xs, ats = x[W.ranges(at[part], n)], np.concatenate([[0], np.cumsum(n)])
                own, t, g, a, z, f = cls._forward(p, xs, ats)
                e = (f - y[part]) / len(part)
                dz = e[:, None] * p["c"]
                da = (xs * dz[own]).sum(axis=1)
                ds = a * (da - np.add.reduceat(a * da, ats[:-1])[own])
                grads = {"c": z.T @ e + decay * p["c"], "b": e.sum(keepdims=True), "w": (t * g).T @ ds, "V": xs.T @ (ds[:, None] * p["w"] * g * (1 - t * t)), "U": xs.T @ (ds[:, None] * p["w"] * t * g * (1 - g))}
                step += 1
                for k, q in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * q
                    v[k] = 0.999 * v[k] + 0.001 * q * q
                    p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return cls(mean, scale, p, passage)


def learn_quality(docs: DataFrame, labels: DataFrame, most: int = 8000, passage: int = 48, may_learn=None, label: str = "quality") -> GatedAttention:
    """Fit on at most ``most`` labelled rows (see labelled_sample). Without any, every score is 0.5."""
    may_learn = F.lit(True) if may_learn is None else may_learn

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text", 2 << 20):
                x, at = encode_passages(part.column("text"), passage)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), WIDTH)
                rows = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), flat.cast(pa.list_(pa.float32())))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), rows], ["id", "label", "x"])

    rows = labelled_sample(docs, labels, label, may_learn, most).mapInArrow(features, "id long, label int, x array<array<float>>").toArrow().sort_by("id")
    if not rows.num_rows:
        return GatedAttention.fit(np.zeros((1, WIDTH)), np.array([0, 1]), np.zeros(0), passage)
    bags = rows.column("x").combine_chunks()
    bags = bags.chunk(0) if isinstance(bags, pa.ChunkedArray) else bags
    at = bags.offsets.to_numpy() - bags.offsets[0].as_py()
    x = bags.flatten().flatten().to_numpy().reshape(-1, WIDTH).astype(np.float64)
    return GatedAttention.fit(x, at, rows.column("label").to_numpy().astype(float), passage)


def score_quality(docs: DataFrame, model: GatedAttention, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``: how likely label 1 is, from the text alone. A null text is an empty one, which has
    a score too; very long texts are more passages. Rows and other columns stay; a column named as the score is
    replaced."""
    names = [c for c in docs.columns if c != score_col]
    own = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), *([] if text_col in names else [docs[text_col].alias("text")]))
    schema = own.select("row", F.lit(0.0).alias(score_col)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(W.with_text(batch, text_col), "text", 2 << 20):
                x, at = encode_passages(part.column("text"), model.passage)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(model.attention(x, at)[1])], ["row", score_col])

    return own.mapInArrow(run, schema).select("row.*", score_col)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn_quality(docs, read_table(spark, sf_dir, "labels"), may_learn=fold("id", 4) != 2)
    out = score_quality(docs, model)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
