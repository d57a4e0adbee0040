import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spanweave.functions import sequences as S
from spanweave.operators import alignments as A
from spanweave.operators import chaining, contract, intervals, kmers
from spanweave.sources import records


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expression.alias("x")).first()[0]


def test_scalars(spark):
    assert one(spark, S.revcomp(F.col("s")), s="ACGTN") == "NACGT"
    cut = lambda i, j: one(spark, S.slice_inclusive(F.col("s"), F.lit(i), F.lit(j)), s="ABCDEFG")
    assert [cut(1, 3), cut(-2, 6), cut(3, 1), cut(2, 99)] == ["BCD", "FG", "D", "CDEFG"]
    turned = lambda compat: one(spark, S.directional_slice(F.col("s"), F.lit(1), F.lit(2), F.lit(False), compat), s="AACGT")
    assert [turned(True), turned(False)] == ["CGT", "GT"]
    assert one(spark, S.wrap(F.col("s"), 3), s="ABCDEFG") == "ABC\nDEF\nG"
    assert one(spark, S.clean_id(F.col("s")), s="read1\textra words") == "read1"
    assert one(spark, S.same_sign(F.lit(False), F.lit(False))) is True
    grown = one(spark, S.extend_consensus(F.lit("CDE"), F.lit(2), F.lit(4), F.lit("ABC"), F.lit(0), F.lit(2)))
    assert (grown.seq, grown.lo, grown.hi) == ("ABCCDE", 0, 4)


def match(nano, illu, start, end_x, matches, forward=True, line=0, n_start=0):
    return (nano, illu, start, end_x, matches, forward, n_start, n_start + end_x - start - 1, line)


ALIGN = "nano_id long, illu_id long, i_start int, i_end_x int, matches int, direction boolean, n_start int, n_end int, line long"


def test_filter_thresholds(spark):
    rows = [match(1, 1, 0, 400, 400), match(1, 2, 0, 399, 400), match(1, 3, 0, 400, 399), match(1, 4, 0, 500, 500), match(1, 5, 0, 500, 499)]
    found = {r.illu_id: r.is_primary for r in A.filter_matches(spark.createDataFrame(rows, ALIGN)).collect()}
    assert found == {1: False, 4: True, 5: False}


def test_first_match_and_pairs(spark):
    rows = [match(1, 1, 0, 500, 500, line=2), match(1, 1, 9, 600, 590, line=5), match(2, 1, 399, 999, 600, line=1), match(3, 1, 398, 998, 600, False, line=3)]
    m = A.first_match(A.filter_matches(spark.createDataFrame(rows, ALIGN)))
    assert {(r.nano_id, r.i_start) for r in m.collect()} == {(1, 0), (2, 399), (3, 398)}
    pairs = {(r.u, r.v): r for r in A.interval_pairs(m).collect()}
    assert set(pairs) == {(1, 3), (2, 3)}  # 1 and 2 share a difference of 100, 1 and 3 of 101
    assert pairs[2, 3].direction is False
    assert (pairs[1, 3].ov_start, pairs[1, 3].ov_end) == (398, 499)


def chained(spark, rows):
    m = A.first_match(A.filter_matches(spark.createDataFrame(rows, ALIGN)))
    return chaining.chains(A.with_ranges(A.interval_pairs(A.placed(m, A.vertices(m)))))


def test_chain_of_three(spark):
    rows = [match(n, a, 0, 500, 500, True, 0, base + a * 1000) for n, base in ((1, 0), (2, 70)) for a in (1, 2, 3)]
    found = chained(spark, rows).collect()
    assert [(r.u, r.v, r.chain, r.ids, r.score, r.is_primary) for r in found] == [(1, 2, 0, [1, 2, 3], 3000, True)]
    # read 2 has 70 more before the first anchor, and both end 51 behind the last match
    assert (found[0].start, found[0].end, found[0].left_offset, found[0].right_offset, found[0].is_contained) == (1, 2, 70.0, 0.0, True)


def test_alternate_chains_and_anchors_passed_over(spark):
    # anchors 1, 2 agree on both reads, and so do 3, 4, but the two pairs lie 5000 apart on read 2 only
    rows = [match(1, a, 0, 500, 500, True, 0, a * 1000) for a in (1, 2, 3, 4)] + [match(2, a, 0, 500, 500, True, 0, a * 1000 + 5000 * (a > 2)) for a in (1, 2, 3, 4)]
    found = sorted((r.chain, r.ids, r.score, r.is_primary) for r in chained(spark, rows).collect())
    assert found == [(0, [1, 2], 2000, True), (1, [3, 4], 2000, True)]
    # one chain, but both reads have an anchor of their own between its first and second
    rows = [match(n, a, 0, 500, 500, True, 0, a * 1000) for n in (1, 2) for a in (1, 3)] + [match(n, 90 + n, 0, 500, 500, True, 0, 2000) for n in (1, 2)]
    assert [(r.ids, r.is_primary) for r in chained(spark, rows).collect()] == [([1, 3], False)]


def test_chains_equal_the_definition(spark):
    """Compatibility inside chains() is compatible(), and scores are those of all chains tried out."""
    rng = random.Random(3)
    rows = [match(n, a, 0, 500, rng.choice((450, 500)), rng.random() < 0.7, 0, a * 700 + rng.randint(-400, 400)) for n in range(1, 7) for a in range(6)]
    m = A.first_match(A.filter_matches(spark.createDataFrame(rows, ALIGN)))
    pairs = A.with_ranges(A.interval_pairs(A.placed(m, A.vertices(m)))).cache()
    ok = {(r.u, r.v, r.direction, r.illu1, r.illu2) for r in chaining.compat_pairs(pairs).where("ok").collect()}
    anchors = defaultdict(list)
    for r in pairs.collect():
        anchors[r.u, r.v, r.direction].append(((r.u_n_start, r.u_n_end, r.illu_id), int(r.score)))
    best = {}
    for key, own in anchors.items():
        own.sort()
        ends = []
        for k, (a, s) in enumerate(own):
            ends.append(s + max([ends[j] for j in range(k) if (*key, own[j][0][2], a[2]) in ok], default=0))
        best[key] = max(ends)
    found = chaining.chains(pairs).collect()
    assert {(r.u, r.v, r.direction): r.score for r in found if r.chain == 0} == best
    assert len(ok) > 20 and any(r.chain > 0 for r in found)


def test_retain_and_consensus(spark):
    rows = [(1, 2, True, 9, 1, True), (1, 2, False, 5, 3, False), (3, 4, True, 7, 2, False), (5, 6, False, 8, 3, True)]
    df = spark.createDataFrame(rows, "u long, v long, direction boolean, score long, anchors int, is_primary boolean")
    assert {(r.u, r.score) for r in chaining.retain_primary(df).collect()} == {(1, 9), (3, 7), (5, 8)}
    found = {r.u: (r.shadow, r.weight, r.consensus) for r in chaining.consensus(df).collect()}
    assert found == {1: (True, 0, None), 3: (True, 0, True), 5: (False, 8, False)}


def test_contraction(spark):
    orders = spark.createDataFrame(
        [(1, 2, True, 0, True, True, 1, 2, 5.0, 5.0), (2, 3, True, 0, False, True, 2, 3, 5.0, 5.0), (1, 3, True, 0, False, True, 1, 3, 5.0, 5.0),
         (4, 5, True, 0, True, True, 4, 5, 5.0, 5.0), (4, 6, True, 0, False, True, 4, 6, 5.0, 5.0),  # no edge 5-6
         (7, 8, True, 0, True, True, 7, 8, 5.0, 5.0), (7, 9, True, 0, False, True, 7, 9, 5.0, 5.0), (8, 9, True, 0, False, True, 9, 8, 5.0, 5.0)],  # 9 on other sides
        "u long, v long, direction boolean, chain int, is_contained boolean, is_primary boolean, start long, end long, left_offset double, right_offset double",
    )
    edges = orders.select("u", "v", F.lit(False).alias("shadow"))
    assert {(r.s, r.e) for r in contract.sane_contractions(orders, edges).collect()} == {(1, 2)}
    assert {(r.s, r.e) for r in contract.sane_contractions(orders, edges.withColumn("shadow", F.col("v") == 6)).collect()} == {(1, 2), (4, 5)}
    # containment of t in s needs little left over
    three = spark.createDataFrame([(1, 2, True, 0, True, True, 1, 2, 5.0, 5.0), (1, 3, True, 0, True, False, 3, 1, 9.0, 9.0), (2, 3, True, 0, False, False, 2, 3, 5.0, 5.0)], orders.schema)
    edges = three.select("u", "v", F.lit(False).alias("shadow"))
    assert contract.sane_contractions(three, edges).count() == 1 and contract.sane_contractions(three, edges, wiggle=10).count() == 0


def test_targets(spark):
    found = contract.targets(spark.createDataFrame([(5, 4), (4, 2), (2, 1), (9, 8), (3, 5), (1, 7)], "s long, e long"))
    assert {tuple(r) for r in found.collect()} == {(5, 7), (4, 7), (2, 7), (3, 7), (1, 7), (9, 8)}
    assert {r.id for r in contract.roots(found).collect()} == {7, 8}
    circle = contract.targets(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3), (6, 4), (8, 9), (9, 8)], "s long, e long"))
    assert {tuple(r) for r in circle.collect()} == {(2, 1), (3, 1), (4, 1), (6, 1), (9, 8)}
    first = spark.createDataFrame([(1, 2, 9), (1, 3, 4)], "s long, e long, first_line long")
    assert [tuple(r) for r in contract.targets(first).collect()] == [(1, 3)]


def test_intervals(spark):
    df = spark.createDataFrame([("a", 0, 9), ("a", 10, 20), ("a", 20, 25), ("a", 30, 31), ("a", 5, 6)], "k string, s int, e int")
    assert {tuple(r) for r in intervals.interval_union(df, "k", "s", "e").collect()} == {("a", 0, 9), ("a", 10, 25), ("a", 30, 31)}
    depth = {(r.seg_start, r.seg_end): r.depth for r in intervals.coverage(df, "k", "s", "e").collect()}
    assert depth == {(0, 4): 1, (5, 6): 2, (7, 19): 1, (20, 20): 2, (21, 25): 1, (30, 31): 1}
    lengths = spark.createDataFrame([("a", 1000)], "k string, length int")
    merged = spark.createDataFrame([("a", 0, 500), ("a", 900, 999), ("a", 700, 850)], "k string, start int, end int")
    assert {tuple(r) for r in intervals.clip_ends(merged, lengths, "k").collect()} == {("a", 200, 500, 0), ("a", 700, 800, 1)}


def test_quartiles_move_on(spark):
    hist = spark.createDataFrame([(1, 50), (2, 90), (3, 5), (9, 5)], "abundance long, frequency long")
    r = kmers.quartile_threshold(hist).first()
    assert (r.total, r.q1, r.q3, r.threshold) == (100, 2, 3, 5)


def test_kmers(spark):
    seqs = spark.createDataFrame([(1, "ACGT"), (2, "AC"), (3, "")], "id long, seq string")
    assert {tuple(r) for r in kmers.kmer_counts(seqs, 3).collect()} == {("ACG", 2)}


def test_records(spark, tmp_path):
    (tmp_path / "x.FA").write_text(">one first\nACGT\nAC\n>two\nGG\n")
    (tmp_path / "x.fq").write_text("@r1 x\nACGN\n+\n@III\n@r2\nGG\n+\nII\n")
    assert {tuple(r) for r in records.read_sequences(spark, str(tmp_path / "x.FA")).collect()} == {("one", "ACGTAC"), ("two", "GG")}
    assert {tuple(r) for r in records.read_sequences(spark, str(tmp_path / "x.fq")).collect()} == {("r1", "ACGN"), ("r2", "GG")}
    line = "anchor\t900\t10\t510\t-\tread\t5000\t20\t530\t480\t510\t60\ttp:A:P"
    (tmp_path / "x.paf").write_text(line + "\n\n" + line.replace("read", "last"))
    rows = records.read_paf(spark, str(tmp_path / "x.paf")).collect()
    assert [(r.illu_id, r.nano_id, r.i_start, r.i_end_x, r.direction, r.n_end, r.matches) for r in rows] == [("anchor", "read", 10, 510, False, 529, 480), ("anchor", "last", 10, 510, False, 529, 480)]
    (tmp_path / "bad.paf").write_text("too\tshort\n")
    with pytest.raises(Exception, match="fewer than ten"):
        records.read_paf(spark, str(tmp_path / "bad.paf")).collect()
