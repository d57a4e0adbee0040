"""Packing: every id in one piece, sequences without gaps or padding, the placement against a plain count."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spanweave.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def texts(seed, n):
    rng = random.Random(seed)
    alphabet = [*" \t\n\x0b\x0c\r abcABC'sd01.,-!éÉßΣσς日本語İ́̈ 　‍\x1c\x85 한한", "<|endoftext|>", "'ll", "'S", "the ", "stop "]
    return ["".join(rng.choice(alphabet) for _ in range(int(rng.paretovariate(0.7)) % 3000)) for _ in range(n)]


def test_ids_are_those_of_the_whole_text(tokenizer):
    some = [*texts(1, 1500), "", None, "  ", "don't STOP"]
    ids, begin = packing.WordEncoder(PATH).encode(pa.array(some), 2)
    for k, t in enumerate(some):
        assert ids[begin[k] : begin[k + 1]].tolist() == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("window", [16, 64, 4096])
def test_whole_documents_are_packed(spark, tokenizer, window):
    rows = [(i, t) for i, t in enumerate([*texts(window, 250), *["one two three"] * 90, *[""] * 40, "word " * (3 * window - 1), "word " * (2 * window)])]
    rows += [(None, None), (None, "no id"), (3, rows[3][1]), (3, "other text")]
    df = spark.createDataFrame([(i, t, 5, "c") for i, t in rows], "doc_id long, text string, start int, token_ids string").repartition(7)
    got = packing.pack(df, PATH, 2, window).collect()
    want = Counter((i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in rows)
    sequences = defaultdict(list)
    for r in got:
        assert len(r.token_ids) == 4 * r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
    short = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or (at < window and at & (at - 1) == 0)
        short += at < window
    assert short <= window.bit_length()
    assert sorted(sequences) == list(range(len(sequences)))
    # pieces of a row, put together by their starts, are the row's ids; rows of one id are told apart by their length
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id, r.doc_tokens, r.start].append(np.frombuffer(r.token_ids, "<u4"))
    assert sum(len(x) for v in pieces.values() for x in v) == sum(len(ids) * n for (_, ids), n in want.items())
    for (i, ids), n in want.items():
        if sum(j == i and len(other) == len(ids) for j, other in want) > 1 or n > 1:
            continue
        own = sorted((start, x[0]) for (j, m, start), x in pieces.items() if j == i and m == len(ids))
        assert np.concatenate([x for _, x in own]).tolist() == list(ids)


def test_plan_uses_each_piece_once():
    rng = np.random.default_rng(3)
    for window, n in ((16, 40), (64, 3000), (4096, 20000)):
        hist = np.bincount(np.minimum(rng.lognormal(np.log(window) - 2, 1, n).astype(int) + 1, window - 1), minlength=window + 1)
        plan = packing.make_plan(hist, window, 10)
        filled = defaultdict(list)
        for length in np.flatnonzero(hist).tolist():
            for number in range(hist[length]):
                parts = packing.place(plan, window, length, number)
                assert sum(p[0] for p in parts) == length
                for m, sequence, offset in parts:
                    filled[sequence].append((offset, m))
        assert min(filled) == 10 and max(filled) == 9 + len(filled)
        for parts in filled.values():
            parts.sort()
            ends = np.cumsum([m for _, m in parts])
            assert [o for o, _ in parts] == [0, *ends[:-1].tolist()]
            assert ends[-1] == window or int(ends[-1]).bit_count() == 1
        assert plan.used.sum() > 0.5 * hist.sum() or n < 100


def test_fit_is_the_non_negative_least_squares():
    hist = np.zeros(17, np.int64)
    hist[[3, 4, 10, 12]] = [8, 9, 2, 5]
    columns = packing.combinations(hist, 16)
    a, i, b, j = columns
    assert {(int(x), int(y), int(z)) for x, y, z in zip(a, i, b * j, strict=True)} >= {(4, 4, 0), (4, 1, 12), (3, 4, 4), (3, 2, 10)}
    A = np.zeros((17, len(a)))
    np.add.at(A, (a, np.arange(len(a))), i)
    np.add.at(A, (b, np.arange(len(a))), j)
    x = packing.repeat_counts(hist, columns, 5000)
    slope = A.T @ (A @ x - hist)
    assert (x >= 0).all() and (slope > -1e-3).all() and abs(slope * x).max() < 1e-2


def test_query_and_empty_table(spark, tmp_path, tokenizer):
    docs = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], docs).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert packing.op11_packing(spark, str(tmp_path / "none")).count() == 0
    spark.createDataFrame([(1, "hello world", None, None, None)], docs).write.parquet(str(tmp_path / "one/documents.parquet"))
    ids = np.array([*tokenizer.encode("hello world", add_special_tokens=False).ids, 2], "<u4")
    parts = sorted(map(tuple, packing.op11_packing(spark, str(tmp_path / "one")).select("start", "length", "ids_crc32", "doc_tokens", "offset").collect()))
    assert parts == [(0, 2, zlib.crc32(ids[:2].tobytes()), 3, 0), (2, 1, zlib.crc32(ids[2:].tobytes()), 3, 0)]
