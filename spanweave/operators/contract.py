"""Contraction of contained reads: which may go, into which, and what they leave behind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanweave.operators.graph import both_ways
from spanweave.session import materialize


def sane_contractions(orders: DataFrame, edges: DataFrame, wiggle: int = 300, between: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``u, v, direction, chain, s, e``: of each edge the first order (antiparallel before parallel, then by chain) that
    contracts its start s into its end e. Such an order is primary and a containment, and for every other neighbour t
    of s (by an edge that isn't a shadow) there is an edge e-t, and an order of s-t and one of e-t that fit with it.

    Orders have the columns of chains(), ``edges`` those of consensus(). Two orders fit if the directions multiply, and:
    where s-t is a containment and e-t too, t lies in e; where only e-t is, t lies in e; where only s-t is, s lies in t,
    or what the three orders leave over at the ends in question is less than ``wiggle`` together; where none is, t is
    on the same side of both.

    ``orders`` may leave out those of shadows that have none that is primary, if ``between`` gives all orders of the edges
    (u, v) that it is asked for: those between e and the neighbours of s.
    """
    inner = orders.where("is_contained AND is_primary").select("u", "v", "direction", "chain", F.col("start").alias("s"), F.col("end").alias("e"), (F.col("u") != F.col("end")).alias("turned"), F.col("left_offset").alias("o_left"), F.col("right_offset").alias("o_right"))
    near = both_ways(edges.where(~F.col("shadow")).select("u", "v")).select(F.col("u").alias("s"), F.col("v").alias("t"))

    def side(p: str, a: str, orders: DataFrame) -> DataFrame:
        """Orders of the edges from ``a`` to t."""
        o = orders.select("u", "v", F.col("direction").alias(f"{p}_dir"), F.col("is_contained").alias(f"{p}_in"), F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"), F.col("u").alias(f"{p}_base"), F.col("left_offset").alias(f"{p}_left"), F.col("right_offset").alias(f"{p}_right"))
        return both_ways(o).withColumnRenamed("u", a).withColumnRenamed("v", "t")

    tests = inner.join(near, "s").where("t <> e")
    if between:
        tests = materialize(tests, "contraction-tests")
        others = between(tests.select(F.least("e", "t").alias("u"), F.greatest("e", "t").alias("v")).distinct())
    else:
        others = orders
    tests = tests.join(side("f", "s", orders), ["s", "t"]).join(side("n", "e", others), ["e", "t"], "left")
    c, t = F.col, F.col("t")
    flip = lambda x, when: x != when
    behind = c("n_end") == t
    d1 = F.when(flip(~behind, ~c("direction") & c("turned")), c("o_left")).otherwise(c("o_right"))
    d2 = F.when(flip(F.when(behind, ~c("direction")).otherwise(c("direction")), ~c("f_dir") & (c("f_base") != c("f_end"))), c("f_left")).otherwise(c("f_right"))
    d3 = F.when(~behind, c("n_left")).otherwise(c("n_right"))
    ahead = flip(flip(c("f_start") == t, ~c("f_dir") & (c("f_base") == t)), ~c("direction")) == flip(c("n_start") == t, ~c("n_dir") & (c("n_base") == t))
    fits = F.when(c("n_in"), c("n_start") == t).when(c("f_in"), (c("f_end") == t) | (d1 + d2 + d3 < wiggle)).otherwise(ahead)
    right = c("n_dir").isNotNull() & ((c("direction") == c("n_dir")) == c("f_dir")) & fits
    key = ["u", "v", "direction", "chain"]
    bad = tests.groupBy(*key, "t").agg(F.max(F.coalesce(right, F.lit(False))).alias("ok")).where(~F.col("ok")).select(*key).distinct()
    first = Window.partitionBy("u", "v").orderBy("direction", "chain")
    return inner.join(bad, key, "left_anti").withColumn("k", F.row_number().over(first)).where("k = 1").select(*key, "s", "e")


def targets(contractions: DataFrame) -> DataFrame:
    """``s, target``: each contracted read goes to the container (e) that comes first (``first_line``, where the table
    has it, then the smaller id), and on to where that goes, until a read that isn't contracted. Of reads that go round
    in a circle the smallest is not contracted. All by pointer doubling."""
    by = F.struct("first_line", "e") if "first_line" in contractions.columns else F.struct("e")
    up = materialize(contractions.where("s <> e").groupBy("s").agg(F.min_by("e", by).alias("up")), "targets")
    # who comes back to itself is on a circle; the smallest read met on the way is the circle's root
    n = up.count()
    jump = up.select("s", F.col("up").alias("to"), F.least("up", "s").alias("low"))
    for _ in range(max(1, n.bit_length())):
        far = jump.select(F.col("s").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        jump = materialize(jump.join(far, "to").select("s", F.col("to2").alias("to"), F.least("low", "low2").alias("low")), "circles")
        if not jump.take(1):
            break
    # what is still going after n steps ends on a circle: the ends are its reads, and each has seen the whole of it
    circle = jump.select(F.col("to").alias("s")).distinct().join(jump.select("s", "low"), "s")
    up = materialize(up.join(circle.where("low = s").select("s"), "s", "left_anti"), "targets")
    while True:
        far = up.select(F.col("s").alias("up"), F.col("up").alias("up2"))
        up = materialize(up.join(far, "up", "left").select("s", F.coalesce("up2", "up").alias("up"), F.col("up2").isNotNull().alias("moved")), "targets")
        if not up.where("moved").take(1):
            return up.select("s", F.col("up").alias("target"))
        up = up.drop("moved")


def roots(found: DataFrame) -> DataFrame:
    """Targets that aren't contracted themselves."""
    return found.select(F.col("target").alias("id")).distinct().join(found.select(F.col("s").alias("id")), "id", "left_anti")


def collected(found: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches of contracted reads on anchors that their root has too: ``root, nano_id, illu_id, n_start, n_end``."""
    mine = found.join(matches.select(F.col("nano_id").alias("s"), "illu_id", "n_start", "n_end"), "s")
    there = matches.select(F.col("nano_id").alias("target"), "illu_id")
    return mine.join(there, ["target", "illu_id"], "left_semi").select(F.col("target").alias("root"), F.col("s").alias("nano_id"), "illu_id", "n_start", "n_end")


def drop_contained(orders: DataFrame) -> DataFrame:
    """Orders that aren't containments; edges without any go with them."""
    return orders.where(~F.col("is_contained"))
