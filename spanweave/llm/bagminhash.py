"""BagMinHash signatures of word-shingle multisets, from hierarchical Poisson processes over discretised weights.

The weight axis of a shingle is cut into blocks [0,1), [1,2), [2,4), [4,8), ... Each block has its own Poisson
process, the same for every text that holds the shingle: its points come in rising order at a rate of ``size`` times
the block's length, and each has a register and a place on the weight axis. A text of weight w takes the points
placed below w. The least point of each register is the signature, so two texts agree in a register with a
probability of exactly their weighted Jaccard similarity. Points above the largest register are never made, which
leaves about one or two points for each shingle, whatever the number of registers.
"""

from __future__ import annotations

import numpy as np

from spanweave.llm import words as W

_STEP, _TURN, _LEVEL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shingles(texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words of all texts, and the text each is from. A shorter text that has words
    gives one shingle of all of them."""
    data, offsets = W.text_buffer(texts)
    starts, ends, first = W.spans(data, offsets)
    hashes = W.word_hashes(data, starts, ends)
    at = W.inside(first, width, len(hashes))
    full = W.rolling(hashes, width)[at] if len(at) else np.zeros(0, np.uint64)
    owner = np.searchsorted(first, at, side="right") - 1
    count = np.diff(first)
    few = np.flatnonzero((count > 0) & (count < width))
    short = np.zeros(len(few), np.uint64)
    for k in range(width - 1):
        has = count[few] > k
        short[has] = W.mix(short[has] * _STEP + hashes[first[few[has]] + k])
    return np.concatenate([full, short]), np.concatenate([owner, few])


def weighted(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle): a key of both (ascending), shingle, text, count."""
    key = W.mix(hashes + owner.astype(np.uint64) * _STEP)
    order = np.argsort(key)
    key = key[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[begin], hashes[order][begin], owner[order][begin], np.diff(np.concatenate([begin, [len(key)]]))


def signatures(hashes: np.ndarray, owner: np.ndarray, weight: np.ndarray, n_texts: int, size: int) -> np.ndarray:
    """(n_texts, size) float64; a text without shingles has only infinities."""
    registers = np.full((n_texts, size), np.inf)
    flat = registers.reshape(-1)
    seed, text, low, length, top = [], [], [], [], []
    level, lo, span, which = 0, 0, 1, np.arange(len(hashes))
    while len(which):
        seed.append(W.mix(hashes[which] + _LEVEL * np.full(1, level, np.uint64)))
        text.append(owner[which])
        low.append(np.full(len(which), lo))
        length.append(np.full(len(which), span))
        top.append(weight[which])
        level, lo, span = level + 1, lo + span, max(1, lo + span)
        which = which[weight[which] > lo]
    if not seed:
        return registers
    seed, text, low, length, top = (np.concatenate(x) for x in (seed, text, low, length, top))
    x, t = np.zeros(len(seed)), np.uint64(0)
    highest = np.full(n_texts, np.inf)
    while len(seed):
        k = 1 if len(seed) > 20_000 else 16  # points of each cell at once
        step = W.mix(seed[:, None] + (t + np.arange(k, dtype=np.uint64)) * _STEP)
        gap = -np.log1p(-(step >> np.uint64(11)).astype(np.float64) * 2.0**-53) / (size * length[:, None])
        points = x[:, None] + np.cumsum(gap, axis=1)
        turn = W.mix(step + _TURN)
        register = (turn >> np.uint64(32)) % np.uint64(size)
        place = low[:, None] + (((turn & np.uint64(0xFFFFFFFF)) * length[:, None].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        ok = (place < top[:, None]) & (points < highest[text][:, None])
        np.minimum.at(flat, (text[:, None] * size + register.astype(np.int64))[ok], points[ok])
        x, t = points[:, -1], t + np.uint64(k)
        live = np.zeros(n_texts, bool)
        live[text] = True
        some = np.flatnonzero(live)
        highest[some] = registers[some].max(axis=1)
        on = x < highest[text]
        seed, text, low, length, top, x = seed[on], text[on], low[on], length[on], top[on], x[on]
    return registers


def band_hashes(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n_texts, bands) int64: a hash of each band's registers and its number."""
    bits = registers.view(np.uint64).reshape(len(registers), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _LEVEL, (len(registers), bands)).copy()
    for r in range(rows):
        out = W.mix(out * _STEP + bits[:, :, r])
    return out.view(np.int64)


def jaccard(left, right, width: int) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle multisets of each pair of texts; 0 if either has no words."""
    n = len(left)
    ka, _, oa, wa = weighted(*shingles(left, width))
    kb, _, ob, wb = weighted(*shingles(right, width))
    both = np.zeros(n)
    if len(ka) and len(kb):
        at = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
        hit = kb[at] == ka
        both = np.bincount(oa[hit], np.minimum(wa[hit], wb[at[hit]]), n)
    total = np.bincount(oa, wa, n) + np.bincount(ob, wb, n) - both
    return np.divide(both, total, out=np.zeros(n), where=total > 0)
