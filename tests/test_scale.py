"""What queries write and deal out grows with what they need, not with all pairs of reads."""

from pyspark.sql import functions as F

from spanweave.jobs import registry
from spanweave.operators import alignments as A
from spanweave.operators import chaining
from spanweave.session import materialize

SF = "/root/testdata/sf0.001"


def test_pairs_that_are_no_core_are_shadows_of_one_order(spark):
    placed = A.placed(registry._matches(spark, SF, "customer")).cache()
    pairs = A.interval_pairs(placed).cache()
    orders = chaining.retain_primary(chaining.chains(A.with_ranges(pairs))).cache()
    kinds = chaining.pair_kinds(pairs, ways=True).cache()
    assert kinds.count() == pairs.count()
    alone = kinds.where("NOT core").select("u", "v", "direction", F.when(F.col("forward"), F.col("u")).otherwise(F.col("v")).alias("start"), "is_contained")
    core = kinds.where("core").select("u", "v").distinct()
    want = orders.join(core, ["u", "v"], "left_anti").where("NOT is_primary AND anchors = 1")
    rows = lambda df: sorted(map(tuple, df.select("u", "v", "direction", "start", "is_contained").collect()))
    assert rows(alone) == rows(want) and alone.count() > 1000
    every = lambda df: sorted(map(repr, df.collect()))
    assert every(registry._orders(placed, kinds.where("core"))) == every(orders.join(core, ["u", "v"], "left_semi").select(*orders.columns))


def test_graph_writes_no_orders_of_edges_it_leaves_out(spark, monkeypatch):
    written = {}

    def counted(df, tag):
        out = materialize(df, tag)
        written[tag] = out.count()
        return out

    monkeypatch.setattr(registry, "materialize", counted)
    sparse = SF.replace("0.001", "0.01")
    edges = registry.QUERIES["degrees"](spark, sparse).count()
    pairs = registry._pairs(spark, sparse, "customer").count()
    assert edges and written["orders"] * 3 < pairs, (written, pairs)
