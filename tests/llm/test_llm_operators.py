"""Edge cases and brute-force comparisons of the training-data operators."""

import hashlib
import math
import random
import time
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanweave.llm import ann, bagminhash, bpe, decontaminate, labels, near_dup, ngram_lm, quality, quotation, substring_dedup, toxicity, warc

DOCS = "doc_id long, text string, row string, input string, block int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed: int, n: int, vocabulary: int = 4000) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{int(rng.paretovariate(0.6)) % vocabulary}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base, other = prose(1, 300), prose(2, 120)
    near = base.replace(base.split()[150], "changed", 1)
    texts = [base, base, near, other, None, "", "  \n ", "one two", "one  two", "é ß 日本語 👩‍👩‍👧 x" * 3, prose(3, 9000), prose(4, 60) + " " + other, "To " * 70, "A" * 3000, "don't  stop\n\n  here\t!"]
    return [(i, t) for i, t in enumerate(texts)] + [(3, other), (None, base), (None, "lonely text of a row without id")]


def even(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(f"v{rng.randrange(5000)}" for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "r", "i", 7) for i, t in rows], DOCS)


def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_matches_the_definition_and_decodes(spark, rows):
    path, pattern = bpe.tokenizer()
    tiktoken = pytest.importorskip("tiktoken")
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    out = bpe.decode(bpe.encode(docs(spark, rows), path, pattern), path).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.token_ids == known.encode_ordinary(r.text or "")
        assert r.decoded == (r.text or "")
        assert (r.row, r.input, r.block) == ("r", "i", 7)
    assert bpe.encode(nothing(spark), path, pattern).count() == 0


def test_transducer_equals_merging(rows):
    ranks = bpe.read_ranks(bpe.tokenizer()[0])
    machine, rng = bpe.Transducer(ranks, most_states=500), random.Random(5)
    for _ in range(400):
        piece = bytes(rng.choice(b" aeinrst\xc3\xa9=") for _ in range(rng.randint(1, 24)))
        want = [ranks[piece]] if piece in ranks else [ranks[t] for t in bpe.merge_pieces(piece, ranks)]
        assert machine.encode_piece(piece) == want


def test_transducer_takes_many_pieces_at_once_and_grows():
    ranks, rng = bpe.read_ranks(bpe.tokenizer()[0]), random.Random(6)
    pieces = [bytes(rng.choice(b" aeinrst\xc3\xa9=") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    machine = bpe.Transducer(ranks, most_states=100)
    for _ in range(2):
        ids, at = machine.encode_pieces(np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in pieces])]))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [[ranks[t] for t in bpe.merge_pieces(p, ranks)] for p in pieces]
    long = bytes(rng.choice(b"abcdefgh \xe4\xbd\xa0") for _ in range(3000))
    assert machine.encode_piece(long) == [ranks[t] for t in bpe.merge_pieces(long, ranks)]


def test_decoder_streams_and_replaces():
    tokens = {0: b"a\xc3", 1: b"\xa9b", 2: b"\xff", 3: "👩".encode()[:2], 4: "👩".encode()[2:]}
    for ids in ([0, 1], [3, 4, 0], [2, 3, 2, 1]):
        d = bpe.Decoder(tokens)
        assert "".join(d.feed([i]) for i in ids) + d.close() == b"".join(tokens[i] for i in ids).decode(errors="replace")
        again = bpe.Decoder(tokens)
        assert again.feed(ids) + again.close() == b"".join(tokens[i] for i in ids).decode(errors="replace")


def brute_language_model(rows):
    """Id -> (tokens, known, training tokens, base, score) of each row, by the definition."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = lambda t: [*WORD.findall((t or "").translate(low)), "\0end"]
    one, after = Counter(), defaultdict(Counter)
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            w = ["\0start", *tokens(t)]
            one.update(w[1:])
            for k in range(1, len(w)):
                after[w[k - 1],][w[k]] += 1
                if k > 1:
                    after[w[k - 2], w[k - 1]][w[k]] += 1
    code = lambda p: float(ngram_lm.restore(ngram_lm.quantise(np.array([p])))[0])
    z, want = sum(one.values()) + len(one) + 1, defaultdict(list)
    for i, t in rows:
        w, base, score = ["\0start", *tokens(t)], 0.0, 0.0
        for k in range(1, len(w)):
            p = (one[w[k]] + 1) / z
            base += math.log10(p)
            for context in [(w[k - 1],), (w[k - 2], w[k - 1])][: 1 + (k > 1)]:
                if context in after:
                    c, kinds = sum(after[context].values()), len(after[context])
                    n = after[context][w[k]]
                    p = (code(n / (c + kinds)) if n else 0.0) + code(kinds / (c + kinds)) * p
            score += math.log10(p)
        want[i].append((len(w) - 1, sum(one[x] > 0 for x in w[1:]), sum(one.values()), base, score))
    return want


@pytest.mark.parametrize("block_bytes, most", [(1 << 23, 10**9), (1 << 23, 12), (3000, 40), (900, 5)])
def test_language_model(spark, rows, block_bytes, most):
    learn = labels.fold("id", 7) != 2
    out = defaultdict(list)
    for r in ngram_lm.score_documents(docs(spark, rows), learn, block_bytes=block_bytes, most=most).collect():
        out[r.id].append((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score))
    want = brute_language_model(rows)
    assert {i: len(x) for i, x in out.items()} == {i: len(x) for i, x in want.items()}
    for i, found in out.items():
        for got, known in zip(sorted(found), sorted(want[i]), strict=True):
            assert got[:3] == known[:3]
            assert got[3:] == pytest.approx(known[3:], rel=1e-9)


def test_language_model_of_nothing(spark):
    assert ngram_lm.score_documents(nothing(spark), labels.fold("id", 7) != 2).count() == 0
    some = ngram_lm.score_documents(docs(spark, [(1, "a b"), (2, None)]), F.lit(False)).collect()
    assert sorted((r.id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in some) == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]


def test_elias_fano(tmp_path):
    rng = np.random.default_rng(1)
    with open(tmp_path / "x", "w+b") as f:
        for values in (np.zeros(0, np.uint64), np.array([0, 0, 5], np.uint64), np.array([2**64 - 1], np.uint64), np.unique(rng.integers(0, 2**62, 999, dtype=np.uint64)), np.cumsum(rng.integers(0, 3, 5000)).astype(np.uint64)):
            seq = ngram_lm.EliasFano(values, f)
            assert (seq.at(np.arange(len(values))) == values).all()
            ask = np.concatenate([values, values + np.uint64(1), np.array([0, 2**63], np.uint64)])
            at = seq.find(ask)
            assert ((at >= 0) == np.isin(ask, values)).all()
            assert (values[at[at >= 0]] == ask[at >= 0]).all()
            lo = rng.integers(0, len(values) + 1, len(ask))
            hi = np.minimum(lo + 7, len(values))
            assert [x >= 0 for x in seq.within(ask, lo, hi)] == [a in values[b:e] for a, b, e in zip(ask, lo, hi)]


def test_labelled_sample(spark):
    some = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (3, None), (4, "d" * 50), (5, "e")], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 1), (4, 0), (5, 7), (None, 1)], "doc_id long, toxic int")
    sample = lambda **k: sorted(map(tuple, labels.labelled_sample(some, marks, "toxic", F.lit(True), 10, **k).collect()))
    assert sample() == [(1, "a", 0), (2, "c", 1), (4, "d" * 50, 0)]
    assert sample(most_bytes=10) == sample(longest=10) == [(1, "a", 0), (2, "c", 1)]
    # one very long text takes nothing from the others
    many = spark.createDataFrame([(i, "x" * (5000 if i == 7 else 20)) for i in range(50)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    assert labels.labelled_sample(many, marks, "toxic", F.lit(True), 100, most_bytes=2000).count() == 49


def test_toxicity(spark, rows):
    rng = random.Random(3)
    texts = [prose(100 + k, 80) for k in range(400)]
    marks = [k % 4 == 0 for k in range(400)]
    texts = [" ".join([*t.split(), *rng.sample(["vilestword", "cursedname", "badbadbad"], 2), "w1"]) if m else t for t, m in zip(texts, marks, strict=True)]
    model = toxicity.fit_toxicity(texts[:300], np.array(marks[:300]))
    found = toxicity.score_toxicity(docs(spark, [*enumerate(texts[300:]), *rows]), model).collect()
    assert len(found) == 100 + len(rows)
    assert all(0 <= r.score <= 1 for r in found)
    assert np.mean([(r.score >= 0.5) == m for r, m in zip(sorted(found[:100], key=lambda r: r.doc_id), marks[300:], strict=True)]) > 0.9
    empty = toxicity.learn_toxicity(nothing(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in toxicity.score_toxicity(docs(spark, [(1, None)]), empty).collect()] == [0.5]


def test_nearest(spark):
    rng = np.random.default_rng(4)
    v = [(i, [float(x) for x in row]) for i, row in enumerate(rng.normal(size=(700, 12)))]
    v += [(i, v[50][1]) for i in range(700, 760)]  # ties
    odd = [(800, None), (801, [0.0] * 12), (802, [float("nan")] * 12), (850, [1.0, 2.0]), (900, [float("inf")] * 12), (901, [None] * 12), (None, v[3][1])]
    df = spark.createDataFrame(v + odd + v[:3], "vec_id long, embedding array<float>").withColumn("vec", F.lit(1)).withColumn("list", F.lit(2))
    found = defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 50 = 0"), list_rows=64).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    ids = np.array([i for i, _ in v])
    x = np.array([row for _, row in v], np.float32).astype(float)
    hits = total = 0
    for q in range(0, 760, 50):
        score = (x @ x[q]) / np.sqrt((x * x).sum(1) * (x[q] @ x[q]))
        score[q] = -9
        order = np.lexsort((ids, -np.round(score, 12)))[:5]
        hits += len({i for i, _ in found[q]} & set(ids[order].tolist()))
        total += 5
        assert len(found[q]) == 5
        assert [s for _, s in found[q]] == sorted((s for _, s in found[q]), reverse=True)
    assert hits / total >= 0.9
    assert [i for i, _ in found[50]] == [700, 701, 702, 703, 704]
    assert set(found) == set(range(0, 760, 50))
    few = spark.createDataFrame(v[:3], "vec_id long, embedding array<float>")
    assert ann.nearest(few, few.where("vec_id = 0")).count() == 2
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(none, none).count() == 0


def test_near_duplicates(spark, rows):
    got = [(r.id, r.class_id) for r in near_dup.near_duplicates(docs(spark, rows)).collect()]
    assert len(got) == len(rows)
    found = {i: c for i, c in got if i is not None}
    assert found[0] == found[1] == found[2] == 0
    assert found[7] == found[8] == 7  # the same words
    assert [found[i] for i in (3, 4, 5, 6, 9, 10, 11)] == [3, 4, 5, 6, 9, 10, 11]
    assert Counter(c for i, c in got if i is None) == Counter([0, None])
    for turned in (1, -1):  # an id with two texts keeps their classes apart, in any order of the rows
        a, b = prose(31, 80), prose(32, 80)
        some = [(5, a), (5, b), (6, a + " more"), (7, b + " more"), (None, a), (None, "no id"), (None, None), (9, None), (9, None)]
        found = near_dup.near_duplicates(docs(spark, some[::turned])).collect()
        assert Counter(map(tuple, found)) == Counter([(5, 5), (5, 5), (6, 5), (7, 5), (None, 5), (None, None), (None, None), (9, 9), (9, 9)])
        # both classes of id 5 have the smallest id 5, yet they are two
        keys = near_dup.first_texts(docs(spark, some[::turned])).count()
        assert keys == 5
    assert near_dup.near_duplicates(nothing(spark)).count() == 0


def test_near_duplicates_of_a_large_group(spark):
    base = prose(9, 150).split()
    rng, texts = random.Random(1), [" ".join(base)]
    for _ in range(60):
        w = base[:]
        for k in rng.sample(range(150), rng.randint(0, 4)):
            w[k] = f"new{rng.random()}"
        texts.append(" ".join(w))
    like = bagminhash.jaccard(pa.array(texts), pa.array(texts[:1] * len(texts)), 5)
    found = {r.id: r.class_id for r in near_dup.near_duplicates(docs(spark, list(enumerate(texts)))).collect()}
    assert {found[i] for i in np.flatnonzero(like >= 0.8).tolist()} == {0}


def test_bagminhash_is_unbiased():
    a, b = "x y " * 30 + prose(1, 200), "x y " * 12 + prose(1, 150) + " " + prose(2, 60)
    h, o = bagminhash.shingles(pa.array([a, b]), 5)
    _, h, o, w = bagminhash.weighted(h, o)
    s = bagminhash.signatures(h, o, w, 2, 3000)
    true = bagminhash.jaccard(pa.array([a]), pa.array([b]), 5)[0]
    assert abs((s[0] == s[1]).mean() - true) < 4 * math.sqrt(true * (1 - true) / 3000)


def test_quality(spark, rows):
    good, bad = [(k, prose(k, 130)) for k in range(150)], [(1000 + k, "!! ".join(prose(500 + k, 90).upper().split())) for k in range(60)]
    marks = spark.createDataFrame([(i, int(i < 1000)) for i, _ in good + bad] + [(5, None), (None, 1)], "doc_id long, quality int")
    df = docs(spark, good + bad + [(2000, t) for _, t in rows])
    model = quality.learn_quality(df, marks, may_learn=F.col("id") % 3 != 0)
    out = quality.score_quality(df, model).collect()
    assert len(out) == 210 + len(rows)
    assert all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.doc_id < 2000 and r.doc_id % 3 == 0]
    assert np.mean([(r.score >= 0.7) == (r.doc_id < 1000) for r in held]) > 0.95
    x, at = quality.encode_passages(pa.array([good[0][1]]), 48)
    assert model.attention(x, at)[0].sum() == pytest.approx(1)
    none = quality.learn_quality(nothing(spark), marks.limit(0))
    assert [r.score for r in quality.score_quality(docs(spark, [(1, None)]), none).collect()] == [0.5]


def test_warc(spark, tmp_path):
    big, folder = "<p>é" * 400, "file://" + str(tmp_path / "w")
    data = [(1, "http://a", big), (5, None, big), (3, "u\nv", big), (5, None, big), (7, "x", None), (8, "x", "small"), (9, "x", "small"), (None, "n", "\r\n\r\nbody"), (10, "z", "x" * 200_000)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("body", F.lit("clash"))
    index = warc.write_archives(df, folder)
    got = warc.read_records(index, folder, gap=10, most=1000).collect()
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert kinds == Counter([(1, "revisit", 5), (3, "revisit", 5), (5, "response", None), (5, "response", None), (7, "response", None), (8, "response", None), (9, "response", None), (None, "response", None), (10, "response", None)])
    body = {i: (h or "").encode() for i, _, h in data}
    for r in got:
        assert r.payload_digest == hashlib.sha1(body[r.page_id]).hexdigest()
        assert r.payload_bytes == len(body[r.page_id])
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == body[r.page_id]
    small = warc.write_archives(df, folder, archive_bytes=200)
    assert small.select("archive").distinct().count() > index.select("archive").distinct().count()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in warc.read_records(small, folder).collect()) == kinds
    one = warc.read_records(index.where("page_id = 8"), folder).collect()
    assert [(r.page_id, bytes(r.payload)) for r in one] == [(8, b"small")]
    assert warc.write_archives(df.limit(0), folder).count() == 0


def test_substring_dedup_of_a_passage_that_all_share(spark):
    """One passage in every document of many blocks: its anchors are known in each slice without being counted."""
    rng = random.Random(2)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(i, " ".join(f"u{rng.randrange(10**9)}" for _ in range(30)) + " " + passage) for i in range(300)]
    got = substring_dedup.dedup_substrings(docs(spark, rows), block_bytes=5000).collect()
    assert sorted((r.row.doc_id, r.n_removed) for r in got) == [(i, 60 if i else 0) for i in range(300)]
    with pytest.raises(ValueError):
        substring_dedup.dedup_substrings(docs(spark, rows), width=5)


def test_substring_dedup(spark, rows):
    got = substring_dedup.dedup_substrings(docs(spark, rows), block_bytes=4000).collect()
    assert len(got) == len(rows)
    seen, want = {}, defaultdict(list)
    low = lambda i: -1 if i is None else i
    for i, t in sorted(rows, key=lambda r: (low(r[0]), r[1] or "")):
        w = WORD.findall(t or "")
        for k in range(len(w) - 19):
            seen.setdefault(tuple(w[k : k + 20]), (low(i), k))
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - 19):
            if seen[tuple(w[k : k + 20])] < (low(i), k):
                gone.update(range(k, k + 20))
        want[i].append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    found = defaultdict(list)
    for r in got:
        found[r.row.doc_id].append((r.n_words, r.n_removed, r.kept_text))
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    assert substring_dedup.dedup_substrings(nothing(spark)).count() == 0


def test_quotations(spark):
    data = [
        (1, 0, "user", "Hello there.\nHow are   you?\n\nSecond part"),
        (1, 1, "assistant", "> hello THERE. How\n> are you?\nFine."),
        (1, 2, "user", ">> Hello there.\n>> how are you?\n> fine.\n\nGood"),
        (1, 3, "user", "> never said\nNo"),
        (1, 3, "user", "> good\nTwo rows of one turn"),
        (2, 1, "user", "> fine.\nanother conversation"),
        (2, 2, "user", None), (2, 3, "user", ""), (None, 1, "user", "> fine."), (3, None, None, "text"),
    ]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("lines", F.lit(1))
    got = quotation.link_quotations(df).collect()
    assert len(got) == len(data)
    linked = {(r.conv_id, r.turn, r.said): (r.n_quotes, r.n_linked, r.reply_to, r.depth, r.thread) for r in got}
    assert linked[1, 1, "Fine."] == (1, 1, 0, 1, 0)
    assert linked[1, 2, "Good"] == (2, 2, 1, 2, 0)
    assert linked[1, 3, "No"] == (1, 0, None, 0, 3)
    assert linked[1, 3, "Two rows of one turn"] == (1, 1, 2, 3, 0)
    assert linked[2, 1, "another conversation"] == (1, 0, None, 0, 1)
    assert linked[None, 1, ""] == (1, 0, None, 0, 1)
    assert quotation.link_quotations(df.limit(0)).count() == 0
    con = duckdb.connect()
    con.register("conversations", df.drop("lines").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    want = con.execute(quotation.ORACLE)
    names = [c[0] for c in want.description]
    plain = lambda x: [None if v is None or v != v else v for v in x]
    assert Counter(repr(plain(r)) for r in want.fetchall()) == Counter(repr(plain(r[n] for n in names)) for r in got)


def test_near_duplicates_equal_brute_force(spark):
    """Classes of all pairs of texts, compared one by one by their multisets of five-word shingles."""
    rng = random.Random(21)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 400}"
    texts = [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(40)] + ["", "one two", "one two", None]
    for _ in range(90):
        w = (rng.choice(texts) or "x y z").split()
        for _ in range(rng.randint(0, 3)):
            w.insert(rng.randrange(len(w) + 1), word())
        texts.append(" ".join(w * rng.choice((1, 1, 2))))
    bags = []
    for t in texts:
        w = WORD.findall(t or "")
        bags.append(Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter())
    parent = list(range(len(texts)))
    root = lambda i: i if parent[i] == i else root(parent[i])
    for i in range(len(texts)):
        for j in range(i):
            both, either = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if texts[i] is not None and texts[j] is not None and (texts[i] == texts[j] or (either and both >= 0.8 * either)):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = {r.id: r.class_id for r in near_dup.near_duplicates(docs(spark, list(enumerate(texts)))).collect()}
    assert got == {i: root(i) for i in range(len(texts))}
    assert len(set(got.values())) < len(texts) - 20
    # the same texts under repeated and null ids
    ids = [None if t is not None and rng.random() < 0.2 else k if t is None else rng.randrange(60) for k, t in enumerate(texts)]
    least: dict = {}
    for k, i in enumerate(ids):
        least[root(k)] = min((x for x in (least.get(root(k)), i) if x is not None), default=None)
    got = Counter(map(tuple, near_dup.near_duplicates(docs(spark, list(zip(ids, texts, strict=True)))).collect()))
    assert got == Counter((i, least[root(k)]) for k, i in enumerate(ids))


def quoting_conversations(n):
    """Conversations whose messages quote earlier ones, at several levels, with odd blanks and line ends."""
    rng = random.Random(11)
    said = ["yes", "No  way", "see\tbelow", "One two three", "ok.", "RE: plan", ""]
    data = []
    for conv in range(n):
        texts = []
        for turn in range(rng.randint(1, 7)):
            lines = []
            for _ in range(rng.randint(1, 4)):
                kind = rng.random()
                if texts and kind < 0.5:
                    mark = rng.choice([">", "> ", " > ", "\t>"])
                    lines += [mark + x for x in re.split("\r\n|\n|\r", rng.choice(texts))[: rng.randint(1, 5)]]
                elif kind < 0.6:
                    lines.append(rng.choice([">", ">\t", "> >", "  ", "\t", ">>\x0b"]))
                else:
                    lines.append(rng.choice(said) + rng.choice(["", " ", "\t", " x"]))
            texts.append(rng.choice(["\n", "\r\n", "\r"]).join(lines))
            data.append((conv, turn, rng.choice(["user", "assistant"]), texts[-1]))
            if rng.random() < 0.05:
                data.append((conv, turn, "user", rng.choice(texts)))
    return data


def test_quotations_equal_sql(spark):
    data = [(-1, 0, "user", "a\n\nb"), (-1, 1, "user", "> a\n>\t\n> b"), *quoting_conversations(1500)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = quotation.link_quotations(df).collect()
    assert {(r.n_quotes, r.n_linked, r.reply_to) for r in got if (r.conv_id, r.turn) == (-1, 1)} == {(2, 2, 0)}
    assert sum(r.n_linked for r in got) > 2000 and max(r.depth for r in got) > 3
    con = duckdb.connect()
    con.register("conversations", pa.table(dict(zip(("conv_id", "turn", "role", "text"), map(list, zip(*data)), strict=True))))
    want = con.execute(quotation.ORACLE)
    names = [c[0] for c in want.description]
    assert Counter(want.fetchall()) == Counter(tuple(r[n] for n in names) for r in got)


def test_quotation_of_a_very_long_message(spark):
    lines = [f"line {k}" for k in range(20_000)]
    long = "\n\n".join(lines)
    data = [(1, 0, "user", long), (1, 1, "user", "\n>\n".join("> " + x for x in lines) + "\nall"), (1, 2, "user", "> " + "\n> ".join(lines))]
    began = time.time()
    got = {r.turn: (r.n_quotes, r.n_linked, r.reply_to) for r in quotation.link_quotations(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: (0, 0, None), 1: (20_000, 20_000, 0), 2: (1, 0, None)}
    assert time.time() - began < 60


def test_contaminated(spark, rows):
    item = [even(700 + k, 40) for k in range(30)]
    changed = " ".join("other" if k % 6 == 3 and k < 28 else w for k, w in enumerate(item[2].split()))
    texts = [*rows, (100, even(8, 90) + " " + item[0].upper() + ". " + even(9, 90)), (101, item[1].replace(" ", ", ")), (102, even(10, 50) + " " + changed), (103, " ".join(item[3].split()[:9]) + " " + even(11, 80)), (104, item[1])]
    bench = spark.createDataFrame([*enumerate(item), (90, None), (91, ""), (92, "!!")], "item_id long, text string").withColumn("id", F.lit(5))
    got = {(r.id, r.item_id): r.overlap for r in decontaminate.contaminated(docs(spark, texts), bench, block=20).collect()}
    assert set(got) == {(100, 0), (101, 1), (102, 2), (104, 1)}
    assert got[100, 0] == 1 and got[102, 2] < 1
    assert decontaminate.contaminated(nothing(spark), bench).count() == 0
    assert decontaminate.contaminated(docs(spark, texts), bench.limit(0)).count() == 0


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(50):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(1, 12))] for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert decontaminate.common_subsequence(a, b).tolist() == [r[-1] for r in best[1:]]
