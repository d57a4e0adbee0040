"""The stages of the corpus pipeline, each against what it must do to its own input. The smallest tables have too few
labels (87) to train a classifier on; these have 399."""

import base64
import os
import random
import re
from collections import Counter
from urllib.parse import urlparse

import duckdb

import corpus_pipeline as P
from spanweave.llm import bpe
from spanweave.session import materialize, read_table

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = read_table(spark, SF, "documents")
    assert [f for _, f in P.STAGES] == [P.keep_quality, P.keep_one_of_each_class, P.cut_repeats, P.drop_contaminated, P.encode_texts]
    before = {r.doc_id: r for r in docs.collect()}
    marks = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    for name, stage in P.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), "stage")
        assert sorted(docs.columns) == sorted(P.COLUMNS)
        now = {r.doc_id: r for r in docs.collect()}
        assert set(now) <= set(before)
        if name == "quality classifier":
            known = [i for i in before if i in marks]
            assert sum((i in now) == (marks[i] == 1) for i in known) / len(known) > 0.9
        if name == "near dedup":
            texts = [r.text for r in now.values()]
            assert len(texts) == len(set(texts))
        if name == "substring dedup":
            assert len(now) == len(before)
            assert all(len(now[i].text.split()) <= len(before[i].text.split()) for i in now)
        before = now
    out = P.encode_texts(spark, docs, SF).collect()
    assert len(out) == len(before)
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in out)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows], DOCS)


def test_near_dedup_drops_rows_not_ids(spark):
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "x"), (3, b + " end", "x"), (None, c, "x"), (None, c, "y"), (None, a, "z"), (4, c + " x", "x"), (5, None, "x"), (6, None, "x"), (6, "", "x"), (7, "", "x")]
    want = [(1, a, "x"), (2, b, "x"), (4, c + " x", "x"), (5, None, "x"), (6, None, "x"), (6, "", "x")]
    for turned in (1, -1):
        got = P.keep_one_of_each_class(spark, table(spark, rows[::turned]), SF)
        assert Counter((r.doc_id, r.text, r.lang) for r in got.collect()) == Counter(want)


def test_substring_stage_equals_brute_force(spark):
    rng = random.Random(5)
    shared = [prose(100 + k, 30) for k in range(4)]
    rows = [(i, " \n".join([prose(i, rng.randint(0, 40)), rng.choice(shared), prose(500 + i, 9)]), "x") for i in range(30)] + [(40, None, "x"), (41, "  two  words ", "x")]
    seen, want = set(), {}
    for i, text, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in seen:
                gone.update(range(k, k + 20))
            seen.add(window)
        want[i] = " ".join(w for k, w in enumerate(words) if k not in gone) if gone else text
    got = {r.doc_id: r for r in P.cut_repeats(spark, table(spark, rows), SF).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.values())


def test_decontamination_stage_drops_rows_not_ids(spark, tmp_path):
    item = prose(9, 40)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = [(i, prose(20 + i, 90), "x") for i in range(6)]
    dirty = [(2, prose(50, 30) + " " + item, "x"), (None, item, "x"), (8, item + " " + prose(51, 20), "x")]
    got = P.drop_contaminated(spark, table(spark, [*clean, *dirty, (None, None, "x"), (9, "", "x")]), str(tmp_path))
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(i, t) for i, t, _ in clean] + [(None, None), (9, "")])


def test_last_stage_decodes_where_it_encodes(spark):
    """Nothing is written for the check, and no text or ids go to a second task (the executor held 3 GB by it)."""
    path, pattern = bpe.tokenizer()
    rows = [(1, "two words", "x"), (2, None, "x"), (None, "", "x"), (3, "na\u00efve \U0001f469 \t\n end ", "x"), *((10 + i, prose(i, i % 50), "x") for i in range(600))]
    want = bpe.decode(bpe.encode(table(spark, rows), path, pattern), path).collect()
    shared = urlparse(spark.conf.get("spark.checkpoint.dir")).path
    there = set(os.listdir(shared))
    out = P.encode_texts(spark, table(spark, rows), SF)
    assert Counter((r.doc_id, tuple(r.token_ids), r.n_tokens, r.round_trip) for r in out.collect()) == Counter((r.doc_id, tuple(r.token_ids), len(r.token_ids), r.decoded == (r.text or "")) for r in want)
    assert out.schema["n_tokens"].dataType.typeName() == "long" and out.columns == ["doc_id", "lang", "source", "token_ids", "n_tokens", "round_trip"]
    assert set(os.listdir(shared)) == there
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_a_text_that_decodes_otherwise_is_told(spark, tmp_path):
    ranks = tmp_path / "ranks"
    # the id of "b" stands for another text where ids are decoded: two ids, one of them for "B" too
    ranks.write_bytes(b"".join(base64.b64encode(bytes([i])) + b" %d\n" % (i if i != 0x42 else 0x62) for i in range(256)))
    got = bpe.encode_and_check(spark.createDataFrame([(1, "a"), (2, "ab B"), (3, None)], "id long, text string").coalesce(1), str(ranks), r"\S+|\s+").collect()
    assert {r.id: (r.token_ids, r.round_trip) for r in got} == {1: ([97], True), 2: ([97, 98, 32, 98], False), 3: ([], True)}
