"""Packing of tokenised documents into windows of one size, by non-negative least squares over their lengths.

Every text is tokenised once and written with its number among the texts of its partition that leave the same
remainder. Full windows of a text are sequences of their own. What is left of the texts is a histogram of at most
``window - 1`` lengths, all that the driver sees: it enumerates shallow combinations that fill a window (copies of one
length, and one more length), fits their repeat counts to the histogram by non-negative least squares, rounds them and
uses up what the rounding left. Lengths that no combination takes lie end to end on one axis, longest first, and are
cut at window borders; the last, shorter stretch is cut into powers of two, which need no padding. Where a piece goes
follows in closed form from its number, so placing takes one join with counts of (partition, remainder).
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanweave.llm import words as W
from spanweave.session import materialize, read_table

_CACHED = 400_000  # words in a generation; a worker remembers those of this one and the one before
_CHUNK = 1000  # words encoded in one call
_SLICE = 3 << 20  # bytes of text, and of ids, that a task handles at once
_STOP = np.zeros(256, bool)
_STOP[[*b".,;:!?"]] = True
_CAPITAL, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_CAPITAL[65:91] = _LETTER[65:91] = _LETTER[97:123] = True


class WordEncoder:
    """Ids of whole texts by a tokenizer file that drops white space: each different word of a batch is encoded once.

    White space never joins a token, and neither composition nor lower case looks across it, so the ids of a text are
    those of its words, one after the other. The tokenizer also parts a letter and a stop behind it, and takes capitals
    for small letters; so stops are cut off and capitals made small before, unless a mark may join the letter or a
    special token is about."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {}, {}
        self.width = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32

    def _learn(self, words: list[str]) -> None:
        for lo in range(0, len(words), _CHUNK):
            some = words[lo : lo + _CHUNK]
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ends = np.cumsum([len(w) + 1 for w in some])
            ids = np.array(found.ids, self.width)
            at = np.searchsorted(np.fromiter((s for s, _ in found.offsets), np.int64, len(ids)), ends)
            self.known.update((w, ids[a:b].tobytes()) for w, a, b in zip(some, [0, *at.tolist()], at.tolist(), strict=False))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, ``end_id`` after each, and where each text begins (one more at the end)."""
        data, offsets = W.text_buffer(texts)
        cut = np.zeros(len(data) + 1, bool)  # before a text, and between a letter and a stop
        cut[1:-1] = _STOP[data[1:]] & _LETTER[data[:-1]]
        cut[offsets] = True
        gap = W.SEPARATOR[data]
        inside, before, after = ~gap, cut[:-1].copy(), cut[1:].copy()
        before[1:] |= gap[:-1]
        after[:-1] |= gap[1:]
        starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
        first = np.searchsorted(starts, offsets)
        if b"<|" not in data.tobytes():
            small = _CAPITAL[data]
            small[:-1] &= data[1:] < 128
            small[-1:] = False
            data = data + (small.view(np.uint8) << 5)
        at = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(ends - starts, out=at[1:])
        kept = data[inside]
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(kept)).dictionary_encode()
        names, which = words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False)
        if len(self.known) > _CACHED:
            self.known, self.older = {}, self.known
        new = []
        for w in names:
            if w not in self.known:
                ids = self.older.get(w)
                if ids is None:
                    new.append(w)
                else:
                    self.known[w] = ids
        self._learn(new)
        found = [self.known[w] for w in names]
        size = np.array([len(x) for x in found], np.int64) // np.dtype(self.width).itemsize
        flat, lo = np.frombuffer(b"".join(found), self.width), np.cumsum(size) - size
        n = size[which]
        before = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=before[1:])
        begin = before[first] + np.arange(len(first))  # one end id for each text before
        out = np.full(begin[-1], end_id, self.width)
        inner = np.ones(len(out), bool)
        inner[begin[1:] - 1] = False
        out[inner] = flat[W.ranges(lo[which], n)]
        return out, begin


@lru_cache(2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class Plan(NamedTuple):
    """Where the pieces of each length go. Slots are sorted by (length, first piece number); ``used[l]`` pieces of
    length ``l`` are in combinations, the others begin at ``axis[l]`` of the axis, whose sequences end at ``borders``
    (after ``whole`` full ones)."""

    slot_key: np.ndarray
    slot: np.ndarray  # first piece number, pieces of this length in a sequence, first sequence, offset
    used: np.ndarray
    axis: np.ndarray
    first: int
    whole: int
    borders: np.ndarray


_PIECES = np.int64(1) << np.int64(48)


def combinations(hist: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``a, i, b, j``: i copies of the length a and j (0 or 1) of b fill the window; all lengths occur in ``hist``."""
    some = np.flatnonzero(hist[:window])
    some = some[some > 0]
    a = np.repeat(some, window // some)
    i = W.ranges(np.ones(len(some), np.int64), window // some) if len(some) else np.zeros(0, np.int64)
    b = window - i * a
    ok = ((b == 0) | (hist[b] > 0)) & (b != a) & ((i > 1) | (a < b) | (b == 0))
    a, i, b = a[ok], i[ok], b[ok]
    return a, i, b, (b > 0).astype(np.int64)


def repeat_counts(hist: np.ndarray, columns: tuple, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises the squared difference between the lengths used and ``hist``: projected gradient steps
    with momentum, each column scaled by the sum of what shares its lengths (which bounds the step)."""
    a, i, b, j = columns
    per = lambda x: np.bincount(a, i * x, len(hist)) + np.bincount(b, j * x, len(hist))
    total = per(np.ones(len(a)))
    step = 1 / np.maximum(i * total[a] + j * total[b], 1)
    x = np.zeros(len(a))
    y, t = x, 1.0
    for _ in range(rounds if len(a) else 0):
        off = per(y) - hist
        off[0] = 0
        new = np.maximum(y - step * (i * off[a] + j * off[b]), 0)
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y, x = new + (last - 1) / t * (new - x), new
    return x


def make_plan(hist: np.ndarray, window: int, first: int) -> Plan:
    """Combinations in whole numbers for ``hist[1:window]``; sequences are numbered from ``first``."""
    hist = hist.astype(np.int64).copy()
    hist[0] = hist[window:] = 0
    columns = combinations(hist, window)
    x = repeat_counts(hist, columns)
    a, i, b, j = (c.tolist() for c in columns)
    left, counts = hist.tolist(), [0] * len(a)
    # first what the fit asks for, then, with the longest lengths first, what is still there
    for wanted, order in ((np.floor(x + 0.5), np.argsort(-x, kind="stable")), (None, np.argsort(-np.maximum(columns[0], columns[2]), kind="stable"))):
        for c in order.tolist():
            n = left[a[c]] // i[c]
            if j[c]:
                n = min(n, left[b[c]])
            if wanted is not None:
                n = min(n, int(wanted[c]))
            if n > 0:
                counts[c] += n
                left[a[c]] -= n * i[c]
                left[b[c]] -= n * j[c]
    slots, used = [], [0] * (window + 1)
    for c, n in enumerate(counts):
        if n:
            for length, m, offset in ((a[c], i[c], 0), (b[c], j[c], a[c] * i[c])):
                if m:
                    slots.append((length, used[length], m, first, offset))
                    used[length] += n * m
            first += n
    slots = np.array(sorted(slots), np.int64).reshape(-1, 5)
    rest, axis = 0, np.zeros(window + 1, np.int64)
    for length in range(window - 1, 0, -1):
        axis[length] = rest
        rest += left[length] * length
    whole, tail = divmod(rest, window)
    powers = [1 << k for k in range(tail.bit_length() - 1, -1, -1) if tail >> k & 1]
    return Plan(slots[:, 0] * _PIECES + slots[:, 1], slots[:, 1:], np.array(used), axis, first, whole, whole * window + np.cumsum([0, *powers]))


def place(plan: Plan, window: int, length: int, number: int) -> list[tuple[int, int, int]]:
    """``(length, sequence, offset)`` of each part of the remainder with this number among those of its length."""
    if number < plan.used[length]:
        s = np.searchsorted(plan.slot_key, length * _PIECES + number, "right") - 1
        begin, m, sequence, offset = plan.slot[s].tolist()
        copy, k = divmod(number - begin, m)
        return [(length, sequence + copy, offset + k * length)]
    out, at = [], int(plan.axis[length]) + (number - int(plan.used[length])) * length
    end = at + length
    while at < end:
        if at < plan.whole * window:
            sequence, begin = divmod(at, window)
            begin, border = sequence * window, (sequence + 1) * window
        else:
            k = int(np.searchsorted(plan.borders, at, "right")) - 1
            sequence, begin, border = plan.whole + k, int(plan.borders[k]), int(plan.borders[k + 1])
        out.append((min(end, border) - at, plan.first + sequence, at - begin))
        at = min(end, border)
    return out


def pack(docs: DataFrame, path: str, end_id: int, window: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, token_ids, doc_tokens, sequence_id, offset`` for each piece of each row: ``token_ids``
    are the piece's ids as little-endian unsigned 32-bit numbers, ``start`` the ids of its text before it.

    Every sequence has ``window`` tokens, but for at most log2(window) ones with a lower power of two; nothing is
    padded. A null or empty text is ``end_id`` alone. Repeated rows and rows with a null id are packed one by one.
    Other columns don't matter. An empty table gives no pieces. A text is held whole by the task that tokenises it.
    """
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, windows = _encoder(path), np.zeros(window, np.int64), 0
        pid = TaskContext.get().partitionId()
        for batch in batches:
            for part in W.slices(batch, "text", _SLICE):
                ids, begin = encoder.encode(part.column("text"), end_id)
                n = np.diff(begin)
                remainder, number, before = n % window, [], []
                for r, q in zip(remainder.tolist(), (n // window).tolist(), strict=True):
                    number.append(seen[r])
                    before.append(windows)
                    seen[r] += 1
                    windows += q
                size = ids.dtype.itemsize
                binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(begin * size), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.full(len(n), pid, np.int32)), pa.array(n), pa.array(remainder.astype(np.int32)), pa.array(number, pa.int64()), pa.array(before, pa.int64()), binary], ["doc_id", "pid", "n", "r", "number", "windows", "ids"])

    tokens = materialize(base.mapInArrow(tokenize, "doc_id long, pid int, n long, r int, number long, windows long, ids binary"), "packed-tokens")
    counts = tokens.groupBy("pid", "r").agg(F.count("*").alias("rows"), F.sum(F.expr(f"n div {window}")).alias("full"))
    counts = materialize(counts, "packed-counts")
    # at most ``window`` rows
    hist, full = np.zeros(window + 1, np.int64), 0
    for r in counts.groupBy("r").agg(F.sum("rows").alias("rows"), F.sum("full").alias("full")).collect():
        hist[r.r], full = r.rows, full + r.full
    plan = make_plan(hist, window, full)
    by_pid = counts.groupBy("pid").agg(F.sum("full").alias("full"))
    by_pid = by_pid.select("pid", (F.sum("full").over(Window.orderBy("pid")) - F.col("full")).alias("full_before"))  # a row a partition
    earlier = F.sum("rows").over(Window.partitionBy("r").orderBy("pid")) - F.col("rows")
    counts = counts.select("pid", "r", earlier.alias("earlier")).join(by_pid, "pid")
    placed = tokens.join(counts, ["pid", "r"]).select("doc_id", "n", "r", (F.col("number") + F.col("earlier")).alias("number"), (F.col("windows") + F.col("full_before")).alias("sequence"), "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        narrow = _encoder(path).width
        for batch in batches:
            for part in W.slices(batch, "ids", _SLICE):
                data, rows = [], []
                for doc_id, n, r, number, sequence, ids in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    pieces = [(window, sequence + k, 0) for k in range(n // window)]
                    if r:
                        pieces += place(plan, window, r, number)
                    data.append(ids)
                    start = 0
                    for length, of, offset in pieces:
                        rows.append((doc_id, start, length, n, of, offset))
                        start += length
                if not rows:
                    continue
                wide = np.frombuffer(b"".join(data), narrow).astype("<u4")
                doc_id, start, length, n, of, offset = zip(*rows, strict=True)
                at = np.concatenate([[0], np.cumsum(length)]) * 4
                binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(wide)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), binary, pa.array(n, pa.int64()), pa.array(of, pa.int64()), pa.array(offset, pa.int64())], ["doc_id", "start", "length", "token_ids", "doc_tokens", "sequence_id", "offset"])

    return placed.mapInArrow(cut, "doc_id long, start long, length long, token_ids binary, doc_tokens long, sequence_id long, offset long")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
