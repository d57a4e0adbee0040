"""Language-model scoring with a quantised Elias-Fano n-gram trie, sharded by context.

The model interpolates three levels (Witten-Bell): a word after its two predecessors, after one, and alone. Training
counts are exact. The trie of a shard has the levels word, word before it (for contexts of two words) and word after;
each level is a monotone sequence relative to its parent, pointers between levels are monotone sequences too, and
probabilities and back-off weights are codes of one byte. Levels are mapped from a file and searched where they lie:
a query selects its context's range by the pointers and bisects there for the successor.

Nothing of the model is ever in one place. Documents are dealt into blocks by content; a block asks for its distinct
n-grams, sorted by a hash of the context whose upper bits are the shard, so answers need no keys. A word that is very
frequent has its followers split over several shards, and so do pairs of such words; what they have in all is summed
before probabilities are made. Neither the dealing nor the splitting changes a score.
"""

from __future__ import annotations

import math
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanweave.llm import words as W
from spanweave.llm.labels import fold
from spanweave.session import read_table

START, END = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_ODD = np.uint64(0x8EBC6AF09C88C6E3)
_TAIL = np.uint64(24)  # bits of a word's hash within its context
_STEP = math.log10(2) / 12  # quantisation: a byte counts twelfths of a power of two


_1, _2, _3, _4, _8 = (np.uint64(x) for x in (1, 2, 3, 4, 8))
_01, _0F, _33, _55, _80, _FF = (np.uint64(x) for x in (0x0101010101010101, 0x0F0F0F0F0F0F0F0F, 0x3333333333333333, 0x5555555555555555, 0x8080808080808080, 0xFF))
#: Place of the k-th set bit of a byte, by 8 * byte + k.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[k] for b in range(256) for k in range(8)], np.int64)


class EliasFano:
    """A rising sequence of uint64 in about 2 + log2(universe / n) bits each, mapped from a file and read in place."""

    def __init__(self, values: np.ndarray, file) -> None:
        values = values.astype(np.uint64)
        self.n = n = len(values)
        last = int(values[-1]) if n else 0
        self.low_bits = max(0, (last // n).bit_length() - 1) if n else 0
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        bits = np.zeros((int(high[-1]) if n else 0) + n + 1, bool)
        bits[high + np.arange(n)] = True
        upper = np.packbits(bits, bitorder="little")
        self.upper = _mapped(np.pad(upper, (0, -len(upper) % 8)).view(np.uint64), file)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self.upper), dtype=np.int64)])
        self.ones = _mapped(ones, file)
        self.zeros = _mapped(np.arange(len(ones)) * 64 - ones, file)
        low = np.zeros((n * self.low_bits >> 6) + 2, np.uint64)
        if self.low_bits:
            at = np.arange(n, dtype=np.uint64) * np.uint64(self.low_bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            rest = values & np.uint64((1 << self.low_bits) - 1)
            np.bitwise_or.at(low, word, rest << shift)
            over = shift + np.uint64(self.low_bits) > 64
            np.bitwise_or.at(low, word[over] + 1, rest[over] >> (np.uint64(64) - shift[over]))
        self.low = _mapped(low, file)
        self.highest = int(high[-1]) if n else -1

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the k-th set (or unset) bit of the upper part."""
        index = self.ones if ones else self.zeros
        word = np.searchsorted(index, k, side="right") - 1
        bits, left = self.upper[word], (k - index[word]).astype(np.uint64)
        bits = bits if ones else ~bits
        # bits up to each byte of the word, side by side; the byte that holds the wanted one; its place there
        per = bits - ((bits >> _1) & _55)
        per = (per & _33) + ((per >> _2) & _33)
        upto = (((per + (per >> _4)) & _0F) * _01).astype(np.uint64)
        byte = np.bitwise_count((((left * _01) | _80) - upto) & _80).astype(np.uint64)
        left -= ((upto << _8) >> (byte << _3)) & _FF
        return word * 64 + (byte << _3).astype(np.int64) + _IN_BYTE[(((bits >> (byte << _3)) & _FF) << _3 | left).astype(np.int64)]

    def at(self, i: np.ndarray) -> np.ndarray:
        """The elements of these numbers."""
        high = (self._select(i, True) - i).astype(np.uint64)
        if not self.low_bits:
            return high
        bit = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        more = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        low = ((self.low[word] >> shift) | more) & np.uint64((1 << self.low_bits) - 1)
        return (high << np.uint64(self.low_bits)) | low

    def within(self, wanted: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Number of a wanted element among those from lo to hi (exclusive), or -1."""
        out, live = np.full(len(wanted), -1, np.int64), np.flatnonzero(lo < hi)
        lo, hi, wanted = lo[live], hi[live], wanted[live]
        while len(live):
            mid = (lo + hi) >> 1
            there = self.at(mid)
            hit = there == wanted
            out[live[hit]] = mid[hit]
            less = there < wanted
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
            on = np.flatnonzero((lo < hi) & ~hit)
            live, lo, hi, wanted = live[on], lo[on], hi[on], wanted[on]
        return out

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The same over the whole sequence: the upper part gives the range of equal upper bits."""
        high = (wanted >> np.uint64(self.low_bits)).astype(np.int64)
        out = np.full(len(wanted), -1, np.int64)
        some = np.flatnonzero((high <= self.highest) & (high >= 0))
        h = high[some]
        hi = self._select(h, False) - h
        lo = np.where(h > 0, self._select(np.maximum(h - 1, 0), False) - h + 1, 0)
        out[some] = self.within(wanted[some], lo, hi)
        return out


def _mapped(a: np.ndarray, file) -> np.ndarray:
    if not len(a):
        return a
    file.seek(0, 2)
    file.write(b"\0" * (-file.tell() % 8))
    at = file.tell()
    file.write(a.tobytes())
    file.flush()
    return np.memmap(file, a.dtype, "r", offset=at, shape=a.shape)


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities; 255 is one, 1 the least, 0 stands for none."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, (255 + np.rint(np.log10(p) / _STEP)).clip(1, 255), 0).astype(np.uint8)


def restore(q: np.ndarray) -> np.ndarray:
    return np.where(q > 0, 10.0 ** ((q.astype(float) - 255) * _STEP), 0.0)


class Trie:
    """Roots (hashes of contexts), each with the words after it and with the words before it, and each of those with
    the words after both. Keys of a level are parent << 24 | upper bits of the word's hash, rising."""

    def __init__(self, file, roots, count, kinds, after, after_n, before, third, third_n) -> None:
        """count, kinds: of each root, how often it was seen and with how many words after it; the keys' parents are
        numbers in the level above; before: contexts of two words; third: words after them."""
        n, m = len(roots), len(before)
        parent = lambda keys: (keys >> _TAIL).astype(np.int64)
        pair_n = np.bincount(parent(third), third_n, m)
        pair_kinds = np.bincount(parent(third), minlength=m)
        self.roots, self.counts = EliasFano(roots, file), EliasFano(np.concatenate([[0], np.cumsum(count)]), file)
        self.after_at, self.before_at = (EliasFano(np.searchsorted(parent(x), np.arange(n + 1)), file) for x in (after, before))
        self.third_at = EliasFano(np.searchsorted(parent(third), np.arange(m + 1)), file)
        self.after, self.before, self.third = EliasFano(after, file), EliasFano(before, file), EliasFano(third, file)
        self.root_rest, self.pair_rest = _mapped(quantise(kinds / np.maximum(count + kinds, 1)), file), _mapped(quantise(pair_kinds / np.maximum(pair_n + pair_kinds, 1)), file)
        self.after_p = _mapped(quantise(after_n / (count + kinds)[parent(after)]), file)
        self.third_p = _mapped(quantise(third_n / (pair_n + pair_kinds)[parent(third)]), file)

    @staticmethod
    def _child(level: EliasFano, pointers: EliasFano, parent: np.ndarray, tail: np.ndarray) -> np.ndarray:
        out = np.full(len(parent), -1, np.int64)
        some = np.flatnonzero(parent >= 0)
        up = parent[some]
        key = (up.astype(np.uint64) << _TAIL) | tail[some]
        new = np.flatnonzero(np.diff(up, prepend=-1))  # what is asked comes by parents, and so do the pointers
        lo, hi = pointers.at(up[new]).astype(np.int64), pointers.at(up[new] + 1).astype(np.int64)
        n = np.diff(np.append(new, len(up)))
        out[some] = level.within(key, np.repeat(lo, n), np.repeat(hi, n))
        return out

    @staticmethod
    def _code(codes: np.ndarray, at: np.ndarray, none: int) -> np.ndarray:
        out = np.full(len(at), none, np.uint8)
        out[at >= 0] = codes[at[at >= 0]]
        return out

    def ask(self, roots, after, before, third) -> tuple[np.ndarray, ...]:
        """Of each root asked for: its count and back-off code; code of each word after; back-off code of each pair;
        code of each word after a pair. Keys' parents are numbers in what is asked."""
        at = self.roots.find(roots)
        parent = lambda keys: (keys >> _TAIL).astype(np.int64)
        tail = lambda keys: keys & ((np.uint64(1) << _TAIL) - np.uint64(1))
        count = np.zeros(len(at), np.int64)
        there = at >= 0
        count[there] = (self.counts.at(at[there] + 1) - self.counts.at(at[there])).astype(np.int64)
        pair = self._child(self.before, self.before_at, at[parent(before)], tail(before))
        a = self._child(self.after, self.after_at, at[parent(after)], tail(after))
        t = self._child(self.third, self.third_at, pair[parent(third)], tail(third))
        return count, self._code(self.root_rest, at, 255), self._code(self.after_p, a, 0), self._code(self.pair_rest, pair, 255), self._code(self.third_p, t, 0)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, in as many bytes each as the largest needs, byte by byte in planes."""
    out = []
    for a in arrays:
        width = max(1, -(-int(a.max()).bit_length() // 8)) if len(a) else 1
        out += [struct.pack("<qB", len(a), width), np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        n, width = struct.unpack_from("<qB", raw, at)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 9).reshape(width, n).T
        out.append(wide.view("<u8").reshape(-1))
        at += 9 + n * width
    return out


def _steps(rising: np.ndarray) -> np.ndarray:
    return np.diff(rising.astype(np.uint64), prepend=np.uint64(0))


def _tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, an end behind each; where each text's tokens begin (one more at the end)."""
    data, offsets = W.text_buffer(texts)
    starts, ends, first = W.spans(data, offsets)
    h = W.word_hashes(data, starts, ends, lower=True)
    n = len(first) - 1
    token = np.full(len(h) + n, END, np.uint64)
    token[np.arange(len(h)) + np.repeat(np.arange(n), np.diff(first))] = h
    return token, first + np.arange(n + 1)


class Grams:
    """The distinct n-grams of a block, in the order of its requests, and which of them each token is. Whatever the
    order of the block's rows, the requests are the same."""

    def __init__(self, texts, train: np.ndarray, hot: np.ndarray, hot_parts: np.ndarray):
        token, at = _tokens(texts)
        self.doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        weight = train[self.doc].astype(np.float64)
        self.words, code = np.unique(np.append(token, START), return_inverse=True)
        k, self.code, begin = len(self.words), code[:-1], code[-1]
        left = np.concatenate([[begin], self.code[:-1]])
        left[at[:-1]] = begin
        del token, code
        second = np.ones(len(left), bool)  # tokens with two before them, the start counts as one
        second[at[:-1]] = False
        self.has = np.flatnonzero(second)
        parts = np.ones(k, np.int64)
        if len(hot):
            near = np.minimum(np.searchsorted(hot, self.words), len(hot) - 1)
            parts = np.where(hot[near] == self.words, hot_parts[near], 1)
        tail = self.words >> (np.uint64(64) - _TAIL)

        pair, self.pair_of = np.unique(left * k + self.code, return_inverse=True)
        pair_v, pair_w = pair // k, pair % k
        pair_n = np.bincount(self.pair_of, weight, len(pair)).astype(np.int64)
        first = np.searchsorted(pair_v, np.arange(k + 1))  # a word's pairs
        u = left[self.has - 1]
        context, self.context_of = np.unique(left[self.has] * k + u, return_inverse=True)
        context_v, context_u = context // k, context % k
        inner = self.pair_of[self.has] - first[left[self.has]]
        width = int(inner.max(initial=0)) + 1
        third, self.third_of = np.unique(self.context_of * width + inner, return_inverse=True)
        third_c = third // width
        third_pair = first[context_v[third_c]] + third % width
        third_n = np.bincount(self.third_of, weight[self.has], len(third)).astype(np.int64)

        # contexts of words that aren't frequent: a root each
        plain = parts[pair_v] == 1
        roots = np.unique(pair_v[plain])
        number = np.full(k, -1, np.int64)
        number[roots] = np.arange(len(roots))
        self.roots = self.words[roots]
        self.n_roots = np.bincount(number[pair_v[plain]], pair_n[plain], len(roots)).astype(np.int64)
        key = lambda p, t: (p.astype(np.uint64) << _TAIL) | t
        self.after, self.after_n = key(number[pair_v[plain]], tail[pair_w[plain]]), pair_n[plain]
        some = parts[context_v] == 1
        self.before = key(number[context_v[some]], tail[context_u[some]])
        own = some[third_c]
        to_context, to_pair = np.cumsum(some) - 1, np.cumsum(plain) - 1
        self.third_parent, self.third_after, self.third_n = to_context[third_c[own]], to_pair[third_pair[own]], third_n[own]

        # frequent words: followers split by the word after, or roots of pairs
        hot_pair, hot_third = np.flatnonzero(~plain), np.flatnonzero(~own)
        v, w = pair_v[hot_pair], pair_w[hot_pair]
        deal = lambda word, p: (word & np.uint64(0xFFFFFF)) % p.astype(np.uint64)
        ids_a = W.mix(self.words[v] + (deal(self.words[w], parts[v]) + np.uint64(1)) * _ODD)
        c = third_c[hot_third]
        v3, u3, w3 = context_v[c], context_u[c], pair_w[third_pair[hot_third]]
        both = W.mix(W.mix(self.words[v3] * _ODD + np.uint64(1)) + self.words[u3])
        split = parts[u3] > 1
        ids_b = np.where(split, W.mix(both + (deal(self.words[w3], np.minimum(parts[u3], parts[v3])) + np.uint64(1)) * _ODD), both)
        ids = np.concatenate([ids_a, ids_b])
        tails = tail[np.concatenate([w, w3])]
        order = np.lexsort((tails, ids))
        self.hot_roots, lead, back = np.unique(ids[order], return_index=True, return_inverse=True)
        whole = np.concatenate([self.words[v], both])[order][lead]
        kind = np.concatenate([np.full(len(v), 2, np.int64), split.astype(np.int64)])[order][lead]
        self.hot_whole, self.hot_kind = whole, kind  # kinds: 0 a pair of its own, 1 a split pair, 2 a split word
        self.hot_after, self.hot_n = key(back, tails[order]), np.concatenate([pair_n[hot_pair], third_n[hot_third]])[order]

        # where an answer to a token is: numbers in roots + hot roots, words after + hot words after, pairs, thirds
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        n_root, n_after = len(self.roots), len(self.after)
        self.pair_at, self.pair_root = np.empty(len(pair), np.int64), np.empty(len(pair), np.int64)
        self.pair_at[plain], self.pair_root[plain] = np.arange(n_after), number[pair_v[plain]]
        self.pair_at[~plain] = n_after + place[: len(v)]
        self.pair_root[~plain] = n_root + back[place[: len(v)]]
        self.third_at = np.empty(len(third), np.int64)  # a third of a frequent word is a word after a hot root
        self.third_at[own] = np.arange(int(own.sum()))
        self.third_at[~own] = place[len(v) :]
        self.third_own = own
        self.third_rest = np.empty(len(third), np.int64)  # its context: a pair, or a hot root
        self.third_rest[own] = self.third_parent
        self.third_rest[~own] = n_root + back[place[len(v) :]]
        self.word_root = np.full(k, -1, np.int64)
        self.word_root[pair_v] = self.pair_root

    def requests(self, shards: int) -> Iterator[tuple[int, bytes, bytes, bytes | None]]:
        """``shard, roots, grams, hot``, rising by shard."""
        deal = lambda ids: ((ids >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
        of, of_hot = deal(self.roots).astype(np.int64), deal(self.hot_roots).astype(np.int64)
        up = lambda keys: (keys >> _TAIL).astype(np.int64)
        third_root = up(self.before)[self.third_parent]
        inner = self.third_after - np.searchsorted(up(self.after), np.arange(len(self.roots)))[third_root]
        for s in np.unique(np.concatenate([of, of_hot])).tolist():
            lo, hi = np.searchsorted(of, [s, s + 1])
            bounds = np.array([lo, hi], np.uint64) << _TAIL
            (a0, a1), (b0, b1), (t0, t1) = np.searchsorted(self.after, bounds), np.searchsorted(self.before, bounds), np.searchsorted(third_root, [lo, hi])
            per_pair = np.bincount(self.third_parent[t0:t1] - b0, minlength=b1 - b0)
            grams = _pack(_steps(self.after[a0:a1] - bounds[0]), self.after_n[a0:a1], _steps(self.before[b0:b1] - bounds[0]), per_pair, inner[t0:t1], self.third_n[t0:t1])
            h0, h1 = np.searchsorted(of_hot, [s, s + 1])
            hot = None
            if h1 > h0:
                x0, x1 = np.searchsorted(self.hot_after, np.array([h0, h1], np.uint64) << _TAIL)
                hot = _pack(_steps(self.hot_roots[h0:h1]), self.hot_whole[h0:h1], self.hot_kind[h0:h1], _steps(self.hot_after[x0:x1] - (np.uint64(h0) << _TAIL)), self.hot_n[x0:x1])
            yield s, _pack(_steps(self.roots[lo:hi]), self.n_roots[lo:hi]), grams, hot

    def scores(self, told: list[bytes], n_train: int, n_kinds: int, n_texts: int, n_docs: int) -> tuple[np.ndarray, ...]:
        """tokens, known tokens, base and score of each text, from the answers in the order of the requests."""
        parts = [_unpack(x) for x in told]
        cat = lambda i: np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.uint64)
        count = np.concatenate([cat(0), cat(5)]).astype(np.int64)
        rest = restore(np.concatenate([cat(1), cat(6)]))
        after, pair_rest, third = restore(np.concatenate([cat(2), cat(7)])), restore(cat(3)), restore(cat(4))
        c = np.where(self.word_root >= 0, count[np.maximum(self.word_root, 0)], 0) if len(count) else np.zeros(len(self.words), np.int64)
        c[self.words == END] = n_docs
        log_one = (np.log10(c + 1.0) - math.log10(n_train + n_kinds + 1))[self.code]
        p = after[self.pair_at[self.pair_of]] + rest[self.pair_root[self.pair_of]] * 10.0**log_one
        if len(self.has):
            hot_after = after[len(self.after) :]
            at, own = self.third_at, self.third_own
            of, keep = np.empty(len(at)), np.empty(len(at))
            of[own], keep[own] = third[at[own]], pair_rest[self.third_rest[own]]
            of[~own], keep[~own] = hot_after[at[~own]], rest[self.third_rest[~own]]
            p[self.has] = of[self.third_of] + keep[self.third_of] * p[self.has]
        known = c[self.code] > 0
        per = lambda x: np.bincount(self.doc, x, n_texts)
        return np.bincount(self.doc, minlength=n_texts), per(known).astype(np.int64), per(log_one), per(np.log10(p))


class _Asked:
    """The requests of all blocks to one shard, merged."""

    def __init__(self, table: pa.Table):
        self.sizes = []
        roots, hot, after, before, third = [], [], [], [], []
        n_after = n_before = n_root = 0
        whole, kind = [], []
        for a, b, h in zip(*(table.column(c).to_pylist() for c in ("roots", "grams", "hot")), strict=True):
            ids = np.cumsum(_unpack(a)[0], dtype=np.uint64)
            key_a, n_a, key_b, per_pair, inner, n_t = _unpack(b)
            key_a, key_b = np.cumsum(key_a, dtype=np.uint64), np.cumsum(key_b, dtype=np.uint64)
            shift = np.uint64(n_root) << _TAIL
            pair = np.repeat(np.arange(len(key_b)), per_pair.astype(np.int64))
            lead = np.searchsorted(key_a, (key_b >> _TAIL)[pair] << _TAIL)
            tails = key_a[lead + inner.astype(np.int64)] & np.uint64((1 << int(_TAIL)) - 1)
            third.append((n_before + pair, tails, n_t))
            after.append((key_a + shift, n_a))
            before.append(key_b + shift)
            roots.append(ids)
            whole.append(np.zeros(len(ids), np.uint64))
            kind.append(np.where(ids == START, 3, 4))
            sizes = [len(ids), len(key_a), len(key_b), len(pair), 0, 0]
            n_root, n_after, n_before = n_root + len(ids), n_after + len(key_a), n_before + len(key_b)
            if h is not None:
                ids, w, k, key_h, n_h = _unpack(h)
                ids, key_h = np.cumsum(ids, dtype=np.uint64), np.cumsum(key_h, dtype=np.uint64)
                after.append((key_h + (np.uint64(n_root) << _TAIL), n_h))
                roots.append(ids)
                whole.append(w)
                kind.append(k.astype(np.int64))
                sizes[4:] = [len(ids), len(key_h)]
                n_root, n_after = n_root + len(ids), n_after + len(key_h)
            self.sizes.append(sizes)
        mask = np.uint64((1 << int(_TAIL)) - 1)
        key = lambda p, t: (p.astype(np.uint64) << _TAIL) | t
        self.roots, lead, self.root_of = np.unique(np.concatenate(roots), return_index=True, return_inverse=True)
        self.whole, self.kind = np.concatenate(whole)[lead], np.concatenate(kind)[lead]
        k, n = np.concatenate([x for x, _ in after]), np.concatenate([x for _, x in after])
        self.after, self.after_of = np.unique(key(self.root_of[(k >> _TAIL).astype(np.int64)], k & mask), return_inverse=True)
        self.after_n = np.bincount(self.after_of, n, len(self.after)).astype(np.int64)
        k = np.concatenate(before)
        self.before, self.before_of = np.unique(key(self.root_of[(k >> _TAIL).astype(np.int64)], k & mask), return_inverse=True)
        p, t, n = (np.concatenate([x[i] for x in third]) for i in range(3))
        self.third, self.third_of = np.unique(key(self.before_of[p], t), return_inverse=True)
        self.third_n = np.bincount(self.third_of, n, len(self.third)).astype(np.int64)
        up = (self.after >> _TAIL).astype(np.int64)
        self.count = np.bincount(up, self.after_n, len(self.roots)).astype(np.int64)
        self.kinds = np.bincount(up, self.after_n > 0, len(self.roots)).astype(np.int64)

    def answers(self, totals: dict[int, tuple[int, int]]) -> list[bytes]:
        """Through the shard's trie; totals: count and kinds of contexts that are split."""
        count, kinds = self.count.copy(), self.kinds.copy()
        for i in np.flatnonzero((self.kind == 1) | (self.kind == 2)).tolist():
            count[i], kinds[i] = totals[int(self.whole[i].view(np.int64))]
        number = lambda keep: np.cumsum(keep) - 1
        mask = np.uint64((1 << int(_TAIL)) - 1)

        def seen(keys, keep, parent_keep):
            k = keys[keep]
            return (number(parent_keep)[(k >> _TAIL).astype(np.int64)].astype(np.uint64) << _TAIL) | (k & mask)

        root_in, after_in, third_in = count > 0, self.after_n > 0, self.third_n > 0
        before_in = np.zeros(len(self.before), bool)
        before_in[(self.third[third_in] >> _TAIL).astype(np.int64)] = True
        with tempfile.TemporaryFile() as file:
            trie = Trie(file, self.roots[root_in], count[root_in], kinds[root_in], seen(self.after, after_in, root_in), self.after_n[after_in], seen(self.before, before_in, root_in), seen(self.third, third_in, before_in), self.third_n[third_in])
            c, rest, after, pair_rest, third = trie.ask(self.roots, self.after, self.before, self.third)
        c, rest, after, pair_rest, third = c[self.root_of], rest[self.root_of], after[self.after_of], pair_rest[self.before_of], third[self.third_of]
        out, r, a, b, t = [], 0, 0, 0, 0
        for n_r, n_a, n_b, n_t, n_hr, n_ha in self.sizes:
            h, x = r + n_r, a + n_a
            out.append(_pack(c[r:h], rest[r:h], after[a:x], pair_rest[b : b + n_b], third[t : t + n_t], c[h : h + n_hr], rest[h : h + n_hr], after[x : x + n_ha]))
            r, a, b, t = h + n_hr, x + n_ha, b + n_b, t + n_t
        return out


def frequent_words(texts: DataFrame, total_bytes: int, most: int, sample_bytes: int = 64 << 20, least: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Words (and the start) that are so frequent that their followers should be split, and into how many parts. Only
    the load depends on it, no score does, so it is judged by the documents whose hash falls into a share of about
    ``sample_bytes``; at most ``sample_bytes / least`` words."""
    share = max(1, total_bytes // sample_bytes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                token, at = _tokens(part.column("text"))
                w, n = np.unique(token, return_counts=True)
                w, n = np.append(w, START), np.append(n, len(part))
                yield pa.RecordBatch.from_arrays([pa.array(w[n >= 2].view(np.int64)), pa.array(n[n >= 2])], ["w", "n"])

    sample = texts.where(F.pmod(F.xxhash64("text", "id"), F.lit(share)) == 0).select("text")
    found = sample.mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).where((F.col("n") >= least) & (F.col("n") * share > most))
    rows = found.where(F.col("w") != int(END.view(np.int64))).toArrow()
    w, n = rows.column("w").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(w)
    return w[order], (1 + n * share // most)[order]


def score_documents(docs: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8 << 20, most: int = 200_000) -> DataFrame:
    """``id, n_tokens, n_known, train_tokens, base_score, score`` of each row, from a model learned on the rows that
    ``may_learn`` (an expression on the column ``id``) allows.

    Tokens are words (A-Z as a-z) and an end; a null text has only its end. base_score sums log10((c+1)/(N+V+1)).
    score sums log10 p(w | u, v) with p(w | u, v) = n/(c+t) + t/(c+t) * p(w | v), where c counts the context (u, v), t
    the different words after it and n those that are w; p(w | v) likewise over (c+1)/(N+V+1); the start of a text is
    a word of a context. Of an unseen context only the shorter one counts. n/(c+t) and t/(c+t) are rounded to twelfths
    of a power of two. Repeated rows each count and each get a row; null ids stay null; an empty table gives an empty
    table. Words are told apart by 64-bit hashes, within a context by 24 bits. ``block_bytes`` of text make a block
    and a shard, ``most`` counts of a word make a part of its followers; neither changes results.
    """
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    hot, parts = frequent_words(texts, total, most)
    dealt = texts.withColumn("train", may_learn).withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")).repartition(blocks, "block")

    def ask(key: tuple, left: pa.Table) -> pa.Table:
        rows = list(Grams(left.column("text"), left.column("train").to_numpy(), hot, parts).requests(blocks))
        W.give_back()
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        s, a, b, h = (pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True))
        return pa.table([s, pa.array(np.full(len(rows), key[0].as_py(), np.int32)), a, b, h], ["shard", "block", "roots", "grams", "hot"])

    asked = dealt.groupBy("block").applyInArrow(ask, "shard int, block int, roots binary, grams binary, hot binary").repartition(blocks, "shard")

    def sums(table: pa.Table) -> pa.Table:
        """What a shard saw of split contexts, and (kinds 3 and 4) of the start and of all other words of its own."""
        shard = table.column("shard")[0].as_py()
        some = [[x.astype(np.uint64) if i else np.cumsum(x, dtype=np.uint64) for i, x in enumerate(_unpack(b))] for b in table.column("roots").to_pylist()]
        ids, n = (np.concatenate([x[i] for x in some]) for i in range(2))
        ids, back = np.unique(ids, return_inverse=True)
        n = np.bincount(back, n, len(ids)).astype(np.int64)
        start = ids == START
        rows = [(-1 - 2 * shard, 3, shard, int(n[start].sum()), 0), (-2 - 2 * shard, 4, shard, int(n[~start].sum()), int((n[~start] > 0).sum()))]
        split = table.filter(table.column("hot").is_valid())
        if len(split):
            nothing = [pa.array([_pack(*[np.zeros(0, np.int64)] * k)] * len(split), pa.binary()) for k in (2, 6)]
            a = _Asked(pa.table([*nothing, split.column("hot")], ["roots", "grams", "hot"]))
            of = np.flatnonzero(a.kind > 0)  # a shard may have several parts of one context
            whole, lead, back = np.unique(a.whole[of], return_index=True, return_inverse=True)
            c, t = (np.bincount(back, x[of], len(whole)).astype(np.int64).tolist() for x in (a.count, a.kinds))
            rows += zip(whole.view(np.int64).tolist(), a.kind[of][lead].tolist(), [shard] * len(whole), c, t, strict=True)
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["whole", "kind", "shard", "c", "t"])

    # a split context has a row for each of its shards; any other row is alone
    same = Window.partitionBy("whole")
    seen = asked.groupBy("shard").applyInArrow(sums, "whole long, kind int, shard int, c long, t long")
    seen = seen.select("whole", "kind", "shard", F.sum("c").over(same).alias("c"), F.sum("t").over(same).alias("t"), F.min("shard").over(same).alias("lead"))
    told = seen.where("kind IN (1, 2)").select("shard", "whole", "c", "t").repartition(blocks, "shard")
    start = (F.col("kind") == 3) | ((F.col("kind") == 2) & (F.col("whole") == int(START.view(np.int64))))
    kinds = F.when(start, 0).when(F.col("kind") == 4, F.col("t")).otherwise(((F.col("c") > 0) & (F.col("t") >= 0)).cast("long"))
    facts = seen.where("kind > 1 AND shard = lead").agg(F.sum(F.when(start, F.col("c")).otherwise(0)).alias("d"), F.sum("c").alias("n"), F.sum(kinds).alias("v"))
    facts = facts.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("at"), *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in "dnv"])

    def reply(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return pa.table([pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.binary())], ["at", "shard", "said"])
        known = dict(zip(right.column("whole").to_pylist(), zip(right.column("c").to_pylist(), right.column("t").to_pylist(), strict=True), strict=True))
        said = pa.array(_Asked(left).answers(known), pa.binary())
        W.give_back()
        return pa.table([left.column("block"), left.column("shard"), said], ["at", "shard", "said"])

    replies = asked.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(reply, "at int, shard int, said binary")
    none = lambda kind: F.lit(None).cast(kind)
    known = replies.select("at", "shard", "said", *[none("long").alias(c) for c in "dnv"]).union(facts.select("at", none("int"), none("binary"), "d", "n", "v"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return pa.table({f.name: pa.array([], f.type) for f in _SCORES})
        facts = right.filter(right.column("said").is_null()).to_pylist()[0]
        told = right.filter(right.column("said").is_valid()).sort_by("shard").column("said").to_pylist()
        grams = Grams(left.column("text"), left.column("train").to_numpy(), hot, parts)
        n_kinds = facts["v"] + (facts["d"] > 0)  # the end is a token too
        n_tokens, n_known, base, found = grams.scores(told, facts["n"], n_kinds, len(left), facts["d"])
        del grams
        W.give_back()
        return pa.table([left.column("id"), *(pa.array(x) for x in (n_tokens, n_known, np.full(len(left), facts["n"]), base, found))], _SCORES)

    return dealt.groupBy("block").cogroup(known.groupBy("at")).applyInArrow(score, "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


_SCORES = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def op2_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"), fold("id", 7) != 2)
    return out.select(F.col("id").alias("doc_id"), (fold("id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
