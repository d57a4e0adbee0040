"""Divergence of sources against DuckDB SQL and against a plain count."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa

from spanweave.llm import divergence

DOCS = "doc_id long, text string, lang string, source string, n_chars long, term string, count int, id int"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def rows(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "THE", "é", "É", "ßa", "日本", "a-b", "x1y", "İ", "_", "\x00z", *(f"w{chr(97 + k)}" for k in range(26))]
    some = [" ".join(rng.choice(words[: rng.randint(2, len(words))]) for _ in range(rng.randint(0, 40))) for _ in range(n // 2)]
    return [(rng.choice([None, i]), rng.choice([*some, *some[:2] * n, None, ""]), rng.choice(["en", "de", None, "", "xx"]), rng.choice(["a", "b", "B", "é", None, "", "c"]), 1, "t", 2, 3) for i in range(n)] + [(0, "alone", "zz", "only", 1, "t", 2, 3)]


def brute(data):
    langs = defaultdict(list)
    for _, text, lang, source, *_ in data:
        low = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]
        langs[lang or ""].append((source or "", low))
    out = set()
    for lang, docs in langs.items():
        df = Counter(t for _, low in docs for t in set(low))
        kept = {t for t, n in df.items() if n >= 10}
        groups = defaultdict(Counter)
        for source, low in docs:
            groups[source].update(t for t in low if t in kept)
        p = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))
        whole = sum(groups.values(), Counter())
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, c in groups.items():
            pairs = [(-sum(f(p(c, t), p(groups[o], t)) for t in kept), o.encode()) for o in groups if o != s]
            terms = [(-f(p(c, t), p(whole, t)), t.encode()) for t in c if p(c, t) > p(whole, t)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
                out |= {(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)}
    return out


def test_equals_brute_force(spark):
    data = rows(1, 700)
    got = divergence.divergence(spark.createDataFrame(data, DOCS).repartition(6)).select("lang", "source", "part", "item", "value", "rank").collect()
    want = brute(data)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_same_rows_as_sql(spark, tmp_path):
    spark.createDataFrame(rows(2, 500), DOCS).select("doc_id", "text", "lang", "source").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(divergence.ORACLE)
    columns = [c[0] for c in want.description]
    got = divergence.op12_divergence(spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in got)


def test_small_tables(spark):
    one = lambda data: divergence.divergence(spark.createDataFrame(data, DOCS)).collect()
    assert one([]) == []
    few = one([(1, None, "en", "a", 0, "", 0, 0), (2, "word", "en", "b", 0, "", 0, 0)])
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in few) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_a_text_is_counted_once_with_its_weights():
    copies = pa.array([[{"source": "a", "n": 3}, {"source": "b", "n": 1}], [{"source": "a", "n": 2}]])
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en"]), pa.array(["x x Y", "x"]), copies], ["lang", "text", "copies"])
    found = {(r["source"], r["term"]): (r["count"], r["docs"]) for part in divergence.count_terms(iter([batch])) for r in part.to_pylist()}
    assert found == {("a", "x"): (8, 5), ("a", "y"): (3, 3), ("b", "x"): (2, 1), ("b", "y"): (1, 1)}
