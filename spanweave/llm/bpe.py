"""Byte-level BPE encoding and decoding.

Encoding compiles the ranks into a finite-state transducer, determinised lazily. After each byte of a piece there is
exactly one token that can end there in the encoding of the bytes so far; a later token may begin at any position
whose following bytes still begin some token. A state holds these open positions: for each, the place in the token
trie and the tokens from the last agreed one up to it. Tokens that all open positions share are emitted, so output
follows the input after a lookahead that the longest overlapping tokens bound. States and transitions are made when a
text first needs them and shared by all texts of a task; transitions lie in flat arrays, and the pieces of a batch go
through them together, a byte at a time.

Two neighbouring tokens may stand together if merging their joined bytes gives back just these two; since merges
inside one token don't depend on its neighbours, that makes a whole sequence right.

Decoding runs a UTF-8 state machine over tokens: for each state and token it keeps the text that is complete and the
state after it, so pieces of an id stream can be decoded as they come.
"""

from __future__ import annotations

import base64
import gc
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanweave.llm import words as W
from spanweave.session import materialize, read_table


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_pieces(data: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The definition: merge the neighbours whose joined bytes have the least rank, the leftmost of equals, until none has one."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


_NONE, _ANY = 1 << 60, -1
_SPREAD = 0x9E3779B97F4A7C15


class Moves:
    """Transitions (state, byte) -> (next state, number of its output) in flat arrays with open addressing, so that
    whole batches of pieces take their steps at once and a million transitions cost 16 bytes each."""

    def __init__(self, bits: int):
        self.bits, self.mask, self.used = bits, (1 << bits) - 1, 0
        self.keys = np.full(1 << bits, -1, np.int64)
        self.to, self.out = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1."""
        at = ((keys.view(np.uint64) * np.uint64(_SPREAD)) >> np.uint64(64 - self.bits)).astype(np.int64)
        seen = self.keys[at]
        slots = np.where(seen == keys, at, -1)
        todo = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            seen = self.keys[at[todo]]
            hit = seen == keys[todo]
            slots[todo[hit]] = at[todo[hit]]
            todo = todo[~hit & (seen >= 0)]
        return slots

    def add(self, key: int, to: int, out: int) -> int:
        at = (key * _SPREAD & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
        while (known := self.keys[at]) >= 0 and known != key:
            at = (at + 1) & self.mask
        self.used += int(known < 0)
        self.keys[at], self.to[at], self.out[at] = key, to, out
        return self._grow(key) if self.used > self.mask * 3 // 4 else at

    def _grow(self, key: int) -> int:
        """Twice the room; the table shrinks again when its transducer starts anew."""
        have = np.flatnonzero(self.keys >= 0)
        old, bigger = (self.keys[have], self.to[have], self.out[have]), Moves(self.bits + 1)
        for k, to, out in zip(*(x.tolist() for x in old), strict=True):
            bigger.add(k, to, out)
        self.__dict__ = bigger.__dict__
        return int(self.find(np.array([key]))[0])


class Transducer:
    """Ranks compiled for encoding; see the module's text. Tokens go by their ids."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = 250_000):
        self.ranks, self.most = ranks, most_states
        self.text: dict[int, bytes] = {i: t for t, i in ranks.items()}
        self.child: dict[int, int] = {}  # by 256 * node + byte
        ends: dict[int, int] = {}
        for word, i in ranks.items():
            node = 0
            for b in word:
                node = self.child.setdefault(node << 8 | b, len(self.child) + 1)
            ends[node] = i
        self.token = np.full(len(self.child) + 1, -1, np.int32)
        self.token[list(ends)] = list(ends.values())
        parents, nodes = np.array(list(self.child), np.int64) >> 8, np.array(list(self.child.values()), np.int64)
        order = np.argsort(parents, kind="stable")
        self.kids, self.kids_at = nodes[order].astype(np.int32), np.searchsorted(parents[order], np.arange(len(self.child) + 2)).astype(np.int32)
        self.edges: dict[int, tuple | None] = {}
        self.pair: dict[int, bool] = {}
        self.live: dict[int, bool] = {}
        self.below: dict[int, array | None] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: dict[bytes, int] = {}
        self.open: list[bytes] = []  # of each state: node, length of the path, path; and so on, as int32
        self.moves = Moves(max(10, (4 * self.most - 1).bit_length()))
        self.outs: list[tuple[int, ...]] = [()]
        self.out_of: dict[tuple[int, ...], int] = {(): 0}
        self.ends: dict[int, int] = {}
        self.start = self._state([(0, (_ANY,))])

    def _state(self, key: list[tuple]) -> int:
        packed = array("i", [x for node, path in key for x in (node, len(path), *path)]).tobytes()
        if packed not in self.states:
            self.states[packed] = len(self.open)
            self.open.append(packed)
        return self.states[packed]

    def _positions(self, state: int) -> list[tuple]:
        packed, at, found = self.open[state], 0, []
        flat = struct.unpack(f"{len(packed) // 4}i", packed)
        while at < len(flat):
            end = at + 2 + flat[at + 1]
            found.append((flat[at], flat[at + 2 : end]))
            at = end
        return found

    def _output(self, ids: tuple[int, ...]) -> int:
        if ids not in self.out_of:
            self.out_of[ids] = len(self.outs)
            self.outs.append(ids)
        return self.out_of[ids]

    def _edges(self, token: int) -> tuple | None:
        """While the token's own bytes merge: the parts at its right and at its left end, each with the rank of the
        part that takes it in (the last: none). None if merging doesn't give the token back."""
        if token not in self.edges:
            parts = [self.text[token][i : i + 1] for i in range(len(self.text[token]))]
            right, left = [parts[-1]], [parts[0]]
            while len(parts) > 1:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], _NONE), i) for i in range(len(parts) - 1))
                if rank == _NONE:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                if parts[-1] != right[-1]:
                    right.append(parts[-1])
                if parts[0] != left[-1]:
                    left.append(parts[0])
            later = lambda side: [(x, self.ranks[y] if y else _NONE) for x, y in zip(side, [*side[1:], b""], strict=True)]
            self.edges[token] = (later(right), later(left)) if len(parts) == 1 else None
        return self.edges[token]

    def _fits(self, a: int, b: int) -> bool:
        """May token b follow token a (-1: the start)? If no merge across their border comes before the merges of
        the two parts that face each other there."""
        known = self.pair.get(a << 32 | b)
        if known is None:
            if len(self.pair) > 1 << 16:
                self.pair.clear()
            known = self.pair[a << 32 | b] = self._border(a, b)
        return known

    def _border(self, a: int, b: int) -> bool:
        own = self._edges(b)
        if own is None or a < 0:
            return own is not None
        right, left, i, j = self._edges(a)[0], own[1], 0, 0
        get = self.ranks.get
        (x, x_ends), (y, y_ends) = right[0], left[0]
        while True:
            across = get(x + y, _NONE)
            if across < x_ends and across <= y_ends and across < _NONE:
                return False
            if x_ends == y_ends == _NONE:
                return True
            if x_ends <= y_ends:
                i += 1
                x, x_ends = right[i]
            else:
                j += 1
                y, y_ends = left[j]

    def _lives(self, a: int, node: int) -> bool:
        """Can some token through this trie node follow token a? Not looked into where many tokens pass."""
        known = self.live.get(a << 32 | node)
        if known is None:
            if node not in self.below:
                found, todo = array("i"), [node]
                while todo and len(found) <= 150:
                    at = todo.pop()
                    if self.token[at] >= 0 and at != node:
                        found.append(int(self.token[at]))
                    todo.extend(self.kids[self.kids_at[at] : self.kids_at[at + 1]].tolist())
                self.below[node] = None if len(found) > 150 else found
            below = self.below[node]
            if len(self.live) > 1 << 16:
                self.live.clear()
            known = self.live[a << 32 | node] = below is None or any(self._border(a, t) for t in below)
        return known

    def _step(self, state: int, b: int) -> int:
        """Makes the move of a state at a byte; the slot it is kept in."""
        after, ends = [], None
        for node, path in self._positions(state):
            to = self.child.get(node << 8 | b)
            if to is None:
                continue
            token = int(self.token[to])
            if ends is None and token >= 0 and self._fits(path[-1], token):
                ends = (*path, token)
            if self.kids_at[to] < self.kids_at[to + 1] and self._lives(path[-1], to):
                after.append((to, path))
        if ends is None:
            raise ValueError(f"no token ends at byte {b}: the ranks lack it")
        after.append((0, ends))
        shared = 1
        while all(len(p) > shared and p[shared] == ends[shared] for _, p in after) and shared < len(ends):
            shared += 1
        out = self._output(ends[1:shared])  # the first of a path has been emitted already
        # the last token emitted only matters where an open token would follow it directly
        lead = ends[shared - 1 : shared] if any(len(p) == shared for _, p in after) else (_ANY,)
        return self.moves.add(state << 8 | b, self._state([(n, lead + p[shared:]) for n, p in after]), out)

    def _end(self, state: int) -> int:
        """Number of the output that the end of a piece decides."""
        if state not in self.ends:
            self.ends[state] = self._output(self._positions(state)[-1][1][1:])
        return self.ends[state]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern, byte by byte. A piece that is itself a token is that token."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        if len(self.open) > self.most:
            self._reset()
        state, out, near = self.start, [], {}
        for b in piece:
            key = state << 8 | b
            if key not in near:
                slot = int(self.moves.find(np.array([key]))[0])
                slot = self._step(state, b) if slot < 0 else slot
                near[key] = (int(self.moves.to[slot]), self.outs[self.moves.out[slot]])
            state, said = near[key]
            out += said
        return out + list(self.outs[self._end(state)])

    def encode_pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces, all of them a byte further with each step; and where each piece's ids begin."""
        if len(self.open) > self.most or self.moves.used > self.moves.mask // 2:
            self._reset()
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")
        size, begin = size[order], offsets[:-1][order]
        state = np.full(len(order), self.start, np.int64)
        who, outs = [], []
        for k in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -k, side="left"))  # pieces longer than k
            key = state[:n] << 8 | data[begin[:n] + k]
            slot = self.moves.find(key)
            if (slot < 0).any():
                for x in np.unique(key[slot < 0]).tolist():
                    self._step(x >> 8, x & 255)
                slot = self.moves.find(key)  # all of them: the table may have grown
            state[:n] = self.moves.to[slot]
            out = self.moves.out[slot]
            some = np.flatnonzero(out)
            who.append(some)
            outs.append(out[some])
        kinds, back = np.unique(state, return_inverse=True)
        who.append(np.arange(len(order)))
        outs.append(np.array([self._end(s) for s in kinds.tolist()], np.int64)[back] if len(kinds) else np.zeros(0, np.int64))
        who, outs = order[np.concatenate(who)], np.concatenate(outs)
        by = np.argsort(who, kind="stable")  # steps stay in order
        who, outs = who[by], outs[by]
        kinds, back = np.unique(outs, return_inverse=True)
        said = [self.outs[o] for o in kinds.tolist()]
        long = np.array([len(x) for x in said], np.int64)
        flat = np.array([i for x in said for i in x], np.int32)
        ids = flat[W.ranges((np.cumsum(long) - long)[back], long[back])]
        count = np.bincount(who, long[back], len(order)).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(count)])


_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = ".,;:!?"


class Encoder:
    """Encodes many texts at once. No match of the pattern holds a space behind a character that isn't white space, so
    such a space begins a match, and each stretch from a space to the next can be encoded on its own: once for all its
    places in a batch. Stretches of plain letters, marks behind them or not, are cut without the pattern."""

    def __init__(self, pattern: regex.Pattern, ranks: dict[bytes, int], most_states: int = 250_000):
        self.find, self.machine = pattern.findall, Transducer(ranks, most_states)
        self.whole = pa.array(list(ranks), pa.large_binary())
        self.ids = np.fromiter(ranks.values(), np.int32, len(ranks))
        # the rules above hold if a space is white space for the pattern, and begins or is a match
        self.usable = all(pattern.findall(x + " " + y)[: len(pattern.findall(x))] == pattern.findall(x) for x in ("a", "1", "!", "a!", "\u00e9", "'s") for y in ("", "a", " ", "1", "!", "\n"))
        letters = [chr(c) for c in range(0x100) if regex.match(f"[{_LETTERS}]", chr(c))]
        self.plain = all(self.find(x + c + "ab" + c + m) == [x + c + "ab" + c, *([m] if m else [])] for c in letters for x in ("", " ") for m in ("", *_MARKS, _MARKS))

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each piece, and where they begin; each different piece is encoded once."""
        coded = pieces.cast(pa.large_binary()).dictionary_encode()
        kinds, back = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        token = pc.fill_null(pc.index_in(kinds, value_set=self.whole), -1).to_numpy()
        rest = np.flatnonzero(token < 0)
        size = np.ones(len(kinds), np.int64)
        data, offsets = W.text_buffer(kinds.take(pa.array(rest)))
        long = np.flatnonzero(np.diff(offsets) > 512)
        short = np.flatnonzero(np.diff(offsets) <= 512)
        sub = W.ranges(offsets[:-1][short], np.diff(offsets)[short])
        ids, at = self.machine.encode_pieces(data[sub], np.concatenate([[0], np.cumsum(np.diff(offsets)[short])]))
        more = [self.machine.encode_piece(data[offsets[i] : offsets[i + 1]].tobytes()) for i in long.tolist()]
        size[rest[short]], size[rest[long]] = np.diff(at), [len(x) for x in more]
        begin = np.zeros(len(kinds), np.int64)
        begin[rest[short]] = len(self.ids) + at[:-1]
        begin[rest[long]] = len(self.ids) + len(ids) + np.cumsum(size[rest[long]]) - size[rest[long]]
        begin[token >= 0] = token[token >= 0]
        every = np.concatenate([self.ids, ids, np.array([i for x in more for i in x], np.int32)])
        return every[W.ranges(begin[back], size[back])], np.concatenate([[0], np.cumsum(size[back])])

    def _cut(self, units: pa.Array, lead: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Pieces of units with ``lead`` before them; how many pieces each has; which end in white space or are empty."""
        n = len(units)
        plain = pc.match_substring_regex(units, f"^[{_LETTERS}]+[{_MARKS}]*$").to_numpy(zero_copy_only=False) if self.plain else np.zeros(n, bool)
        count, odd = np.zeros(n, np.int64), np.zeros(n, bool)
        easy = units.filter(pa.array(plain))
        word = pc.utf8_rtrim(easy, _MARKS)
        cut = pc.binary_length(word).to_numpy(zero_copy_only=False).astype(np.int64)
        full = pc.binary_length(easy).to_numpy(zero_copy_only=False).astype(np.int64)
        data, offsets = W.text_buffer(easy)
        tail = np.flatnonzero(full > cut)
        marks = W.ranges(offsets[:-1][tail] + cut[tail], (full - cut)[tail])
        mark = pa.LargeStringArray.from_buffers(len(tail), pa.py_buffer(np.concatenate([[0], np.cumsum((full - cut)[tail])]).astype(np.int64).tobytes()), pa.py_buffer(data[marks].tobytes()))
        count[plain] = 1 + (full > cut)
        hard = units.filter(pa.array(~plain)).to_pylist()
        found = [[] if not x or x[-1].isspace() else self.find(lead + x) for x in hard]
        odd[~plain] = [not x or x[-1].isspace() for x in hard]
        count[~plain] = [len(x) for x in found]
        # in the order of the units
        begin = np.cumsum(count) - count
        at = np.empty(int(count.sum()), np.int64)
        lead_at = begin[plain]
        at[lead_at] = np.arange(len(lead_at))
        at[lead_at[tail] + 1] = len(lead_at) + np.arange(len(tail))
        at[W.ranges(begin[~plain], count[~plain])] = len(lead_at) + len(tail) + np.arange(int(count[~plain].sum()))
        pieces = pa.concat_arrays([pc.binary_join_element_wise(pa.scalar(lead, pa.large_string()), word, pa.scalar("", pa.large_string())) if len(word) else word, mark, pa.array([p for x in found for p in x], pa.large_string())])
        return pieces.take(pa.array(at)), count, odd

    def batch(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text (null: none)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        split = pc.split_pattern(texts, " ")
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        codes, stretches = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        heads = stretches.take(pa.array(codes[bounds[:-1]]))  # what stands before the first space
        inner, n_inner, odd = self._cut(stretches, " ")
        first, n_first, odd_first = self._cut(heads, "")
        # a stretch that is empty or ends in white space must be matched together with what follows it
        filled = pc.greater(pc.binary_length(heads), 0).to_numpy(zero_copy_only=False)
        odd = np.append(odd, odd_first & filled)
        codes[bounds[:-1]] = len(stretches) + np.arange(len(heads))
        again = np.unique(np.searchsorted(bounds, np.flatnonzero(odd[codes]), side="right") - 1) if self.usable else np.arange(len(texts))
        whole = [self.find(texts[i].as_py()) for i in again.tolist()]
        ids, at = self._pieces(pa.concat_arrays([inner, first, pa.array([p for x in whole for p in x], pa.large_string())]))
        # pieces -> units -> texts
        units = np.concatenate([[0], np.cumsum(np.concatenate([n_inner, n_first, [len(x) for x in whole]]).astype(np.int64))])
        bound = at[units]
        unit, count = codes, np.diff(bounds)
        if len(again):
            keep = np.ones(len(texts), bool)
            keep[again] = False
            unit = codes[np.repeat(keep, count)]
            count = np.where(keep, count, 1)
            unit = np.insert(unit, np.cumsum(np.where(keep, count, 0))[again], len(stretches) + len(heads) + np.arange(len(again)))
        size = np.diff(bound)[unit]
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(count)])]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids[W.ranges(bound[:-1][unit], size)]))


# UTF-8: lead bytes with the number of bytes after them, and the range of the first of these
_LEADS = {**{b: (1, 0x80, 0xBF) for b in range(0xC2, 0xE0)}, **{b: (2, 0x80, 0xBF) for b in range(0xE1, 0xF0)}, 0xE0: (2, 0xA0, 0xBF), 0xED: (2, 0x80, 0x9F), **{b: (3, 0x80, 0xBF) for b in range(0xF1, 0xF4)}, 0xF0: (3, 0x90, 0xBF), 0xF4: (3, 0x80, 0x8F)}


def utf8_step(state: bytes, data: bytes) -> tuple[bytes, str]:
    """One move of the state machine: the state is the begun but incomplete character. Returns the next state and the
    text completed; bytes that can't be UTF-8 give U+FFFD, one for each maximal begun character."""
    data, out, i = state + data, [], 0
    while i < len(data):
        b = data[i]
        if b < 0x80:
            out.append(chr(b))
            i += 1
            continue
        need, low, high = _LEADS.get(b, (0, 0, 0))
        k = i + 1
        while need and k < len(data) and k - i <= need and (low if k == i + 1 else 0x80) <= data[k] <= (high if k == i + 1 else 0xBF):
            k += 1
        if need and k - i == need + 1:
            out.append(data[i:k].decode())
        elif need and k == len(data):
            return data[i:], "".join(out)
        else:
            out.append("�")
        i = k
    return b"", "".join(out)


class Decoder:
    """Streaming decoder of ids; feed() gives the text that is complete so far, close() what is left."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.moves: dict[bytes, dict[int, tuple[bytes, str]]] = {b"": {}}
        self.state = b""
        self.plain: dict[int, str] = {}  # moves from the empty state to itself

    def feed(self, ids: list[int]) -> str:
        if not self.state:
            try:
                return "".join(map(self.plain.__getitem__, ids))
            except KeyError:
                pass
        out, state, moves = [], self.state, self.moves[self.state]
        for i in ids:
            move = moves.get(i)
            if move is None:
                move = moves[i] = utf8_step(state, self.tokens[i])
                self.moves.setdefault(move[0], {})
                if not state and not move[0]:
                    self.plain[i] = move[1]
            out.append(move[1])
            if move[0] != state:
                state = move[0]
                moves = self.moves[state]
        self.state = state
        return "".join(out)

    def close(self) -> str:
        left, self.state = self.state, b""
        return "�" if left else ""


@lru_cache(2)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(regex.compile(pattern), read_ranks(path))


@lru_cache(2)
def _decoder(path: str) -> Decoder:
    return Decoder({i: t for t, i in read_ranks(path).items()})


_BYTES = 2 << 20  # of text that a task encodes at once


def _with(df: DataFrame, name: str, kind: T.DataType) -> tuple[DataFrame, T.StructType]:
    """``df`` without a column ``name``, and its schema with that column at the end."""
    own = df.select(*[df[c] for c in df.columns if c != name])
    return own, T.StructType([*own.schema.fields, T.StructField(name, kind)])


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """``df`` with ``ids_col`` (array<int>; a column of that name is replaced): each match of ``pattern`` is encoded
    on its own by the ranks of the file at ``ranks_path``, which every executor must have; no special tokens. A null
    or empty text gives an empty array. Rows, order within partitions and other columns stay; nothing is shuffled.
    Long pieces cost time in proportion to their length."""
    if text_col == ids_col:
        raise ValueError("the text column can't take the ids")
    own, schema = _with(df, ids_col, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_path, pattern)
        gc.freeze()  # the automaton and the caches hold no cycles; don't search them again and again
        for batch in batches:
            for part in W.slices(batch, text_col, _BYTES):
                yield pa.RecordBatch.from_arrays([*part.columns, encoder.batch(part.column(text_col))], schema.names)

    return own.mapInArrow(run, schema)


def _decoded(decoder: Decoder, ids: pa.ListArray) -> Iterator[pa.Array]:
    """The texts of the ids (null ids: null), 256 at a time."""
    for at in range(0, len(ids), 256):
        part, texts, ends = ids.slice(at, 256), [], 0
        flat = part.flatten().to_numpy(zero_copy_only=False)
        for n, there in zip(pc.fill_null(pc.list_value_length(part), 0).to_pylist(), part.is_valid().to_pylist(), strict=True):
            texts.append(decoder.feed(flat[ends : ends + n].tolist()) + decoder.close() if there else None)
            ends += n
        yield pa.array(texts, pa.string())


def decode(df: DataFrame, ranks_path: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with ``text_col``: the text of the ids. Bytes that aren't UTF-8 become U+FFFD, null ids give a null text
    and a null or unknown id within an array an error."""
    if text_col == ids_col:
        raise ValueError("the ids column can't take the text")
    own, schema = _with(df, text_col, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(ranks_path)
        for batch in batches:
            at = 0
            for texts in _decoded(decoder, batch.column(ids_col)):
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(texts)).columns, texts], schema.names)
                at += len(texts)

    return own.mapInArrow(run, schema)


def encode_and_check(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids", same_col: str = "round_trip") -> DataFrame:
    """As encode(), but the text doesn't go on; in its place ``same_col``: whether decoding the ids gives it back (a null
    text counts as empty). Each slice of a task is decoded as soon as it is encoded, so neither ids nor texts are written
    or sent to a second task for it."""
    if len({text_col, ids_col, same_col}) < 3:
        raise ValueError("text, ids and the check are three columns")
    own = df.select(*[df[c] for c in df.columns if c not in (ids_col, same_col)])
    kept = [f for f in own.schema.fields if f.name != text_col]
    schema = T.StructType([*kept, T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(same_col, T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _encoder(ranks_path, pattern), _decoder(ranks_path)
        gc.freeze()  # see encode()
        for batch in batches:
            for part in W.slices(batch, text_col, _BYTES):
                ids, at, same = encoder.batch(part.column(text_col)), 0, []
                for texts in _decoded(decoder, ids):
                    given = pc.fill_null(part.column(text_col).slice(at, len(texts)), "")
                    same.append(pc.equal(texts, given.cast(pa.string())))
                    at += len(texts)
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], ids, pa.concat_arrays(same)], schema.names)

    return own.mapInArrow(run, schema)


def tokenizer() -> tuple[str, str]:
    """Path of the ranks and the pattern of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer()
    docs = encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern).select("doc_id", "token_ids")
    ids = F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256)
    # written in between, so that a task never holds an encoder and a decoder at once
    docs = materialize(docs, "token-ids")
    docs = docs.select("doc_id", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"))
    return decode(docs, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
