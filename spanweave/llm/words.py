"""Words of whole Arrow batches as numpy arrays: spans, 64-bit hashes and rolling hashes of word windows.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. All of it is vectorised over the bytes of a batch, so
a task spends no Python step on a single word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch that hold about ``max_bytes`` of text each (one longer text stays whole)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group, at = (np.cumsum(size) - size) // max_bytes, 0
    for end in [*(np.flatnonzero(np.diff(group)) + 1).tolist(), len(size)]:
        if end > at:
            yield batch.slice(at, end - at)
        at = end
    give_back()


def with_text(batch: pa.RecordBatch, column: str) -> pa.RecordBatch:
    """``batch`` with a column ``text``: where it has none, the field ``column`` of its struct ``row``, so that a text
    that is carried along is sent to a task once. Nothing is copied."""
    if "text" in batch.schema.names:
        return batch
    row = batch.column("row")
    return pa.RecordBatch.from_arrays([*batch.columns, row.field(row.type.get_field_index(column))], [*batch.schema.names, "text"])


def text_buffer(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null: none) and where each begins; one more offset at the end."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the number of its first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    apart = np.zeros(n + 1, bool)
    apart[offsets] = True
    gap = SEPARATOR[data]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = gap[:-1], gap[1:]
    starts = np.flatnonzero(~gap & (before | apart[:-1]))
    ends = np.flatnonzero(~gap & (after | apart[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, chunk: int = 1 << 19) -> np.ndarray:
    """A 64-bit hash of each word's bytes (with ``lower``: A-Z as a-z). The bytes are taken in chunks that end between
    words, so that 8-byte numbers are held for a chunk only."""
    table, out = (_BYTE[_LOWER] if lower else _BYTE), np.empty(len(starts), np.uint64)
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(data) + 1, chunk)), len(starts)))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        lo, hi = int(starts[a]), int(ends[b - 1])
        up, down = _power(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[data[lo:hi]] * up[:-1], out=total[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        out[a:b] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
    return out


def give_back() -> None:
    """Freed memory goes back to the system: a worker lives on for other stages."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def rolling(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Rabin-Karp hashes modulo 2**64 of all runs of ``width`` consecutive words, also across texts."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = np.uint64((0xD6E8FEB86659FD93 + 2 * seed) | 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= base
        out += hashes[k : k + n]
    return mix(out)


def inside(first: np.ndarray, width: int, n: int) -> np.ndarray:
    """Starts of the windows of ``width`` words that lie within one text; first: see spans()."""
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(n)
    return at[at + width <= first[1:][owner]] if n else at


def ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0]+1, ... (n[0] numbers), lo[1], ..."""
    total = int(n.sum())
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(total)
