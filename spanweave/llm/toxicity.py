"""Toxicity by compression distance.

Separate zstandard dictionaries are trained on ordinary and on toxic text. A window of a document is compressed with the
ordinary dictionary, and with the ordinary one and the toxic one behind each other (their entropy tables are the same,
so lengths differ only by what the toxic text adds): the bytes saved measure how toxic it reads. Window differences of a
document become a score by thresholds and weights calibrated on labelled documents.

A toxic document is mostly ordinary text. A dictionary of its windows holds the same ordinary words as the other one, and
the difference of two such lengths is noise; so the toxic dictionary is trained on those fragments of toxic documents
that are in excess there, judged by their five- and six-character runs.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm.labels import fold, labelled_sample
from spanweave.session import read_table

_LEVELS = (1, 2, 3, 4, 6, 8)


def _windows(text: str, width: int) -> list[bytes]:
    words = text.split()
    return [" ".join(words[i : i + width]).encode() for i in range(0, max(1, len(words)), width)]


def _runs(word: str) -> set[str]:
    word = f" {word.lower()} "
    return {word[i : i + k] for k in (5, 6) for i in range(len(word) - k + 1)}


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters(window_log=17, chain_log=17, hash_log=17, search_log=1, min_match=5, target_length=0, strategy=zstandard.STRATEGY_DFAST, write_content_size=False, write_checksum=False, write_dict_id=False)
    content = zstandard.ZstdCompressionDict(dictionary)
    content.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(compression_params=how, dict_data=content)


class Distance:
    """Bytes that the toxic dictionary saves in each window of a text, and what they say of the text."""

    def __init__(self, ordinary: bytes, toxic: bytes, width: int):
        self.width = width
        self.plain, self.both = _compressor(ordinary).compress, _compressor(ordinary + b" " + toxic + b" ").compress

    def saved(self, text: str) -> np.ndarray:
        return np.array([len(self.plain(w)) - len(self.both(w)) for w in _windows(text, self.width)])

    def features(self, text: str) -> list[float]:
        d = self.saved(text)
        top = np.sort(d)[::-1][:3]
        top = np.pad(top, (0, 3 - len(top)), mode="edge")
        return [*top, *(math.log1p((d >= k).sum()) for k in _LEVELS), *((d >= k).mean() for k in _LEVELS), math.log1p(len(d)), d.mean()]


@dataclass
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    width: int
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        x = np.column_stack([np.clip((features - self.mean) / self.scale, -10, 10), np.ones(len(features))])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 40) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + (ridge * len(y) + 1e-6) * np.eye(len(w))
        w -= np.linalg.solve(hess, x.T @ (p - y) + ridge * len(y) * w)
    return w


def _excess(texts: list[str], labels: np.ndarray, least: int) -> list[str]:
    """Words of toxic texts that hold a run which toxic texts have far more often, the most frequent last."""
    seen, n = (Counter(), Counter()), np.bincount(labels, minlength=2)
    for text, label in zip(texts, labels.tolist(), strict=True):
        runs: set[str] = set()
        for word in set(text.split()):
            runs |= _runs(word)
        seen[label].update(runs)
    hot = {r for r, k in seen[1].items() if k >= least and math.log((k + 0.1) / n[1]) - math.log((seen[0][r] + 0.5) / max(n[0], 1)) > 3.5}
    words = Counter(w for text, label in zip(texts, labels.tolist(), strict=True) if label for w in text.split() if _runs(w) & hot)
    return sorted(words, key=lambda w: (words[w], w))


def _trained(size: int, samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too little text: an untrained dictionary of that text
        return b" ".join(samples)[-size:]


def fit_toxicity(texts: list[str], labels: np.ndarray, width: int = 12, ordinary_bytes: int = 65536, toxic_bytes: int = 16384, train_bytes: int = 8 << 20) -> ToxicityModel:
    """Dictionaries and calibration from labelled texts. Windows of all ordinary texts, evenly spread where they are
    more than ``train_bytes``, train the ordinary dictionary; fragments in excess train the toxic one."""
    labels = np.asarray(labels, int)
    if not len(texts):
        return ToxicityModel(b" " * 64, b"", width, np.zeros(17), np.ones(17), np.zeros(18))
    windows = [w for t, label in zip(texts, labels.tolist(), strict=True) if not label for w in _windows(t, width) if w]
    ordinary = _trained(ordinary_bytes, windows[:: max(1, -(-sum(map(len, windows)) // train_bytes))]) + b" " * 64
    fragments = [f" {w} ".encode() for w in _excess(texts, labels, max(3, int(labels.sum()) // 50))]
    toxic = _trained(toxic_bytes, fragments * 3)
    distance = Distance(ordinary, toxic, width)
    x = np.array([distance.features(t) for t in texts])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    weights = _logistic(np.column_stack([np.clip((x - mean) / scale, -10, 10), np.ones(len(x))]), labels)
    return ToxicityModel(ordinary, toxic, width, mean, scale, weights)


def learn_toxicity(docs: DataFrame, labels: DataFrame, most: int = 8000, may_learn=None, label: str = "toxic") -> ToxicityModel:
    """Fit on at most ``most`` labelled rows (see labelled_sample). Without any, every score is 0.5."""
    may_learn = F.lit(True) if may_learn is None else may_learn
    rows = labelled_sample(docs, labels, label, may_learn, most).toArrow().sort_by([("id", "ascending"), ("text", "ascending")])
    return fit_toxicity(rows.column("text").to_pylist(), rows.column("label").to_numpy())


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``: how likely label 1 is, from the whole text alone, window by window. A null text is
    an empty one, which has a score too. Rows and other columns stay; a column named as the score is replaced."""
    names = [c for c in docs.columns if c != score_col]
    own = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs[text_col].alias("text"))
    schema = own.select("row", F.lit(0.0).alias(score_col)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(model.ordinary, model.toxic, model.width)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                x = np.array([distance.features(t or "") for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(model.scores(x))], ["row", score_col])

    return own.mapInArrow(run, schema).select("row.*", score_col)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn_toxicity(docs, read_table(spark, sf_dir, "labels"), may_learn=fold("id", 5) != 0)
    out = score_toxicity(docs, model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
