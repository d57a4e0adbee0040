"""All queries of this library by name, with their DuckDB counterparts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanweave.functions import sequences as S
from spanweave.jobs import assembly, scrub
from spanweave.jobs.proxies import LINE, SEQ_SQL, align, align_sql, sequences
from spanweave.operators import alignments as A
from spanweave.operators import chaining, cliques, contract, graph, intervals, kmers
from spanweave.operators import paths as P
from spanweave.operators import targets as T
from spanweave.operators import unitigs as U
from spanweave.session import materialize
from spanweave.sources import records

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_L = ", ".join(LINE)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _matches(spark: SparkSession, d: str, reads: str = "supplier") -> DataFrame:
    return A.first_match(A.filter_matches(align(spark, d, reads)))


def _pairs(spark: SparkSession, d: str, reads: str = "supplier") -> DataFrame:
    return A.interval_pairs(_matches(spark, d, reads))


def _m(reads: str = "supplier") -> str:
    return f"""WITH RECURSIVE {align_sql(reads)},
f AS (SELECT *, i_end_x - 1 AS i_end, (i_end_x - i_start)::DOUBLE / (n_end - n_start + 1) AS r_ratio, CAST(matches AS BIGINT) AS score,
      i_end_x - i_start >= 500 AND matches >= 500 AS is_primary FROM align WHERE matches >= 400 AND i_end_x - i_start >= 400),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nano_id, illu_id ORDER BY {_L}) AS rn FROM f) WHERE rn = 1)"""


def _p(reads: str = "supplier") -> str:
    cut = lambda p, lo: f"CASE WHEN {p}.direction THEN {lo[0]} ELSE {lo[1]} END"
    ov = "greatest(a.i_start, b.i_start)", "least(a.i_end, b.i_end)"
    side = lambda p: (f"({ov[0]} - {p}.i_start) / {p}.r_ratio", f"({p}.i_end - {ov[1]}) / {p}.r_ratio")
    cols = ", ".join(f"{p}.n_start + {cut(p, side(p))} AS {q}_s, {p}.n_end - {cut(p, side(p)[::-1])} AS {q}_e, " + ", ".join(f"{p}.{c} AS {q}_{c}" for c in ("n_start", "n_end", "i_start", "i_end", "direction")) for p, q in (("a", "u"), ("b", "v")))
    c = f"({ov[1]} - {ov[0]} + 1)"
    part = lambda p: f"{p}.score * {c}::DOUBLE / ({p}.i_end - {p}.i_start + 1)"
    return f"""{_m(reads)},
p AS (SELECT a.nano_id AS u, b.nano_id AS v, illu_id, {ov[0]} AS ov_start, {ov[1]} AS ov_end, a.direction = b.direction AS direction,
      {part('a')} + {part('b')} AS score, a.is_primary AND b.is_primary AS is_primary, {cols}
      FROM m a JOIN m b USING (illu_id) WHERE a.nano_id < b.nano_id AND {ov[1]} - {ov[0]} > 100)"""


@query("paf_filter", f"{_m()} SELECT nano_id, illu_id, n_start, n_end, i_start, i_end, round(r_ratio, 6) AS r_ratio, direction, score, is_primary FROM f")
def paf_filter(spark: SparkSession, d: str) -> DataFrame:
    return A.filter_matches(align(spark, d)).drop("line").withColumn("r_ratio", F.round("r_ratio", 6))


@query("first_match", f"{_m()} SELECT nano_id, illu_id, n_start, n_end, i_start, i_end, direction, score, is_primary FROM m")
def first_match(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).drop("line", "r_ratio")


@query("vertices", f"{_m('order')} SELECT nano_id, CAST(max(n_end) + 51 AS INT) AS length FROM f GROUP BY nano_id")
def vertices(spark: SparkSession, d: str) -> DataFrame:
    return A.vertices(A.filter_matches(align(spark, d, "order"))).select("nano_id", "length")


@query("interval_pairs", f"{_p()} SELECT u, v, illu_id, ov_start, ov_end, direction, round(score, 6) AS score, is_primary FROM p")
def interval_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("u", "v", "illu_id", "ov_start", "ov_end", "direction", F.round("score", 6).alias("score"), "is_primary")


_EDGES = "e AS (SELECT u, v, count(*) AS anchors, CAST(sum(ov_end - ov_start + 1) AS BIGINT) AS common, CAST(sum(CAST(floor(score) AS BIGINT)) AS BIGINT) AS score, CAST(sum(CAST(is_primary AS INT)) AS BIGINT) AS primaries, 2 * sum(CAST(direction AS INT)) >= count(*) AS direction FROM p GROUP BY u, v)"


@query("edge_summary", f"{_p()}, {_EDGES} SELECT u, v, anchors, common, score, primaries FROM e")
def edge_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.edge_summary(_pairs(spark, d))


@query("edges_of_orders", f"{_p('order')}, {_EDGES} SELECT u, v, anchors, common, score, primaries FROM e")
def edges_of_orders(spark: SparkSession, d: str) -> DataFrame:
    return A.edge_summary(_pairs(spark, d, "order"))


@query("corrected_range", f"{_p()} SELECT u, v, illu_id, " + ", ".join(f"round({c}, 4) AS {c}" for c in ("u_s", "u_e", "v_s", "v_e")) + " FROM p")
def corrected_range(spark: SparkSession, d: str) -> DataFrame:
    return A.with_ranges(_pairs(spark, d)).select("u", "v", "illu_id", *[F.round(c, 4).alias(c) for c in ("u_s", "u_e", "v_s", "v_e")])


_HUNG = "r AS (SELECT nano_id, CAST(max(n_end) + 51 AS INT) AS length FROM m GROUP BY nano_id), h AS (SELECT p.*, u_s AS u_left, v_s AS v_left, x.length - u_e AS u_right, y.length - v_e AS v_right FROM p JOIN r x ON x.nano_id = u JOIN r y ON y.nano_id = v)"


@query("overhangs", f"{_p()}, {_HUNG} SELECT u, v, illu_id, " + ", ".join(f"round({c}, 4) AS {c}" for c in ("u_left", "u_right", "v_left", "v_right")) + " FROM h")
def overhangs(spark: SparkSession, d: str) -> DataFrame:
    m = _matches(spark, d)
    return A.overhangs(A.interval_pairs(m), A.vertices(m)).select("u", "v", "illu_id", *[F.round(c, 4).alias(c) for c in ("u_left", "u_right", "v_left", "v_right")])


_CLASS = """k AS (SELECT u, v, arg_min(struct_pack(l := u_left, vl := v_left, vr := v_right, d := direction), struct_pack(a := u_n_start, b := u_n_end, c := illu_id)) AS a,
arg_max(struct_pack(r := u_right, vl := v_left, vr := v_right), struct_pack(a := u_n_start, b := u_n_end, c := illu_id)) AS z FROM h GROUP BY u, v),
o AS (SELECT u, v, a.d AS direction, round(a.l, 6) AS l1, round(z.r, 6) AS r1, round(CASE WHEN a.d THEN a.vl ELSE a.vr END, 6) AS l2, round(CASE WHEN a.d THEN z.vr ELSE z.vl END, 6) AS r2 FROM k),
c AS (SELECT u, v, direction, CASE WHEN (l1 <= l2 AND r1 <= r2) OR (NOT (l1 >= l2 AND r1 >= r2) AND l1 > l2) THEN u ELSE v END AS "start",
 CASE WHEN (l1 <= l2 AND r1 <= r2) OR (NOT (l1 >= l2 AND r1 >= r2) AND l1 > l2) THEN v ELSE u END AS "end",
 round(abs(l1 - l2), 4) AS left_offset, round(abs(r1 - r2), 4) AS right_offset, (l1 <= l2 AND r1 <= r2) OR (l1 >= l2 AND r1 >= r2) AS is_contained FROM o)"""


def _classes(spark: SparkSession, d: str, reads: str = "supplier") -> DataFrame:
    m = _matches(spark, d, reads)
    return A.overlap_class(A.overhangs(A.interval_pairs(m), A.vertices(m)))


@query("overlap_class", f"{_p()}, {_HUNG}, {_CLASS} SELECT * FROM c")
def overlap_class(spark: SparkSession, d: str) -> DataFrame:
    return _classes(spark, d)


@query("drop_contained", f"{_p()}, {_HUNG}, {_CLASS} SELECT u, v, \"start\", \"end\" FROM c WHERE NOT is_contained")
def drop_contained(spark: SparkSession, d: str) -> DataFrame:
    return contract.drop_contained(_classes(spark, d)).select("u", "v", "start", "end")


def _side_sql(p: str) -> str:
    s1, e1, s2, e2 = f"round(x.{p}_s, 6)", f"round(x.{p}_e, 6)", f"round(y.{p}_s, 6)", f"round(y.{p}_e, 6)"
    n1, m1, n2, m2 = f"x.{p}_n_start", f"x.{p}_n_end", f"y.{p}_n_start", f"y.{p}_n_end"
    meet = f"{s1} <= {e2} AND {s2} <= {e1}"
    b, a = f"{s1} < {s2} AND {e1} < {e2}", f"{s1} > {s2} AND {e1} > {e2}"
    return f"""CASE WHEN {meet} THEN CASE WHEN {b} THEN 2 WHEN {a} THEN -2 ELSE 0 END WHEN {s1} < {s2} THEN 1 ELSE -1 END AS t{p},
CASE WHEN {meet} THEN CASE WHEN {b} THEN {e1} - {s2} + 1 WHEN {a} THEN {e2} - {s1} + 1 ELSE 0 END WHEN {s1} < {s2} THEN {s2} - {e1} + 1 ELSE {s1} - {e2} + 1 END AS d{p},
{n1} <= {m2} AND {n2} <= {m1} AS meet{p}, CASE WHEN {n1} < {n2} AND {m1} < {m2} THEN 2 WHEN {n1} > {n2} AND {m1} > {m2} THEN -2 ELSE 0 END AS raw{p}"""


_COMPAT = f"""q AS (SELECT x.u, x.v, x.direction, x.illu_id AS illu1, y.illu_id AS illu2, {_side_sql('u')}, {_side_sql('v')}
FROM p x JOIN p y ON x.u = y.u AND x.v = y.v AND x.direction = y.direction AND (x.u_n_start, x.u_n_end, x.illu_id) < (y.u_n_start, y.u_n_end, y.illu_id)),
q2 AS (SELECT *, CASE WHEN direction THEN tv ELSE -tv END AS tw,
 (meetu AND ((tu < 0 AND rawu >= 0) OR (tu > 0 AND rawu <= 0))) OR (meetv AND ((tv < 0 AND rawv >= 0) OR (tv > 0 AND rawv <= 0))) AS bad FROM q),
k AS (SELECT u, v, direction, illu1, illu2, NOT bad AND tu <> 0 AND tv <> 0 AND CASE WHEN tu = tw THEN abs(du - dv) <= 300 OR abs(du - dv) * 100 <= 15 * greatest(du, dv)
 WHEN sign(tu) = sign(tw) THEN du + dv <= 300 ELSE false END AS ok FROM q2)"""


def _compat(spark: SparkSession, d: str) -> DataFrame:
    return chaining.compat_pairs(A.with_ranges(_pairs(spark, d, "customer")))


@query("compat_pairs", f"{_p('customer')}, {_COMPAT} SELECT u, v, direction, count(*) AS pairs, CAST(sum(CAST(ok AS INT)) AS BIGINT) AS compatible, CAST(sum(CASE WHEN ok THEN illu1 * 31 + illu2 ELSE 0 END) AS BIGINT) AS which FROM k GROUP BY u, v, direction")
def compat_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Of each edge and direction: pairs of anchors, how many agree, and a sum that tells which."""
    ok = F.col("ok").cast("long")
    return _compat(spark, d).groupBy("u", "v", "direction").agg(F.count("*").alias("pairs"), F.sum(ok).alias("compatible"), F.sum(ok * (F.col("illu1") * 31 + F.col("illu2"))).alias("which"))


_CHAIN = f"""{_HUNG}, {_COMPAT},
n AS (SELECT u, v, direction, illu_id, CAST(floor(score) AS BIGINT) AS sc, is_primary AS pr, row_number() OVER (PARTITION BY u, v, direction ORDER BY u_n_start, u_n_end, illu_id) AS ix FROM p),
gx AS (SELECT u, v, direction, illu_id AS last, ix, sc AS score, [illu_id] AS ids, [ix] AS rv FROM n
 UNION ALL SELECT gx.u, gx.v, gx.direction, k.illu2, n.ix, gx.score + n.sc, list_append(gx.ids, k.illu2), list_prepend(n.ix, gx.rv) FROM gx JOIN k ON k.ok AND k.u = gx.u AND k.v = gx.v AND k.direction = gx.direction AND k.illu1 = gx.last
 JOIN n ON n.u = gx.u AND n.v = gx.v AND n.direction = gx.direction AND n.illu_id = k.illu2),
pe AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY u, v, direction, last ORDER BY score DESC, rv) AS rn FROM gx) WHERE rn = 1),
pt AS (SELECT *, max(score) OVER w AS top, row_number() OVER (PARTITION BY u, v, direction ORDER BY score DESC, ix) AS first FROM pe WINDOW w AS (PARTITION BY u, v, direction)),
cd AS (SELECT u, v, direction, ids, score, row_number() OVER (PARTITION BY u, v, direction ORDER BY CASE WHEN first = 1 THEN 0 ELSE 1 END, ix) AS pos FROM pt WHERE first = 1 OR score * 4 > top * 3),
gr AS (SELECT u, v, direction, pos, ids AS taken, true AS used FROM cd WHERE pos = 1
 UNION ALL SELECT c.u, c.v, c.direction, c.pos, CASE WHEN list_has_any(gr.taken, c.ids) THEN gr.taken ELSE list_concat(gr.taken, c.ids) END, NOT list_has_any(gr.taken, c.ids) FROM gr JOIN cd c ON c.u = gr.u AND c.v = gr.v AND c.direction = gr.direction AND c.pos = gr.pos + 1),
ch AS (SELECT cd.*, CAST(row_number() OVER (PARTITION BY cd.u, cd.v, cd.direction ORDER BY cd.pos) - 1 AS INT) AS chain, count(*) OVER (PARTITION BY cd.u, cd.v, cd.direction) AS cnt FROM cd JOIN gr ON gr.used AND gr.u = cd.u AND gr.v = cd.v AND gr.direction = cd.direction AND gr.pos = cd.pos),
pl AS (SELECT nano_id, illu_id, row_number() OVER (PARTITION BY nano_id ORDER BY n_start, n_end, illu_id) AS place, count(*) OVER (PARTITION BY nano_id) AS places FROM m),
un AS (SELECT u, v, direction, chain, cnt, len(ids) AS anchors, unnest(ids) AS illu_id, generate_subscripts(ids, 1) AS j FROM ch),
ul AS (SELECT un.*, n.pr, a.place AS pu, a.places AS nu, CASE WHEN un.direction THEN b.place ELSE b.places + 1 - b.place END AS pv, b.places AS nv FROM un JOIN n USING (u, v, direction, illu_id) JOIN pl a ON a.nano_id = u AND a.illu_id = un.illu_id JOIN pl b ON b.nano_id = v AND b.illu_id = un.illu_id),
ug AS (SELECT *, pu - 1 > coalesce(lag(pu) OVER w, 0) AND pv - 1 > coalesce(lag(pv) OVER w, 0) OR (j = 1 AND pu <> 1 AND pv <> 1) OR (j = anchors AND pu <> nu AND pv <> nv) AS gap FROM ul WINDOW w AS (PARTITION BY u, v, direction, chain ORDER BY j)),
pm AS (SELECT u, v, direction, chain, (bool_or(pr) OR (chain = 0 AND max(anchors) > 2)) AND NOT (max(cnt) = 1 AND bool_or(gap)) AS is_primary FROM ug GROUP BY u, v, direction, chain),
en AS (SELECT ch.u, ch.v, ch.direction, ch.chain, ch.ids, CAST(len(ch.ids) AS INT) AS anchors, ch.score, pm.is_primary, round(a.u_left, 6) AS l1, round(z.u_right, 6) AS r1,
 round(CASE WHEN ch.direction THEN a.v_left ELSE a.v_right END, 6) AS l2, round(CASE WHEN ch.direction THEN z.v_right ELSE z.v_left END, 6) AS r2
 FROM ch JOIN pm USING (u, v, direction, chain) JOIN h a ON a.u = ch.u AND a.v = ch.v AND a.illu_id = ch.ids[1] JOIN h z ON z.u = ch.u AND z.v = ch.v AND z.illu_id = ch.ids[-1]),
od AS (SELECT u, v, direction, chain, ids, anchors, score, is_primary, CASE WHEN fw THEN u ELSE v END AS "start", CASE WHEN fw THEN v ELSE u END AS "end", round(abs(l1 - l2), 4) AS left_offset, round(abs(r1 - r2), 4) AS right_offset, inside AS is_contained
 FROM (SELECT *, (l1 <= l2 AND r1 <= r2) OR (NOT (l1 >= l2 AND r1 >= r2) AND l1 > l2) AS fw, (l1 <= l2 AND r1 <= r2) OR (l1 >= l2 AND r1 >= r2) AS inside FROM en)),
o1 AS (SELECT * FROM (SELECT *, bool_or(is_primary) OVER (PARTITION BY u, v) AS ap FROM od) WHERE is_primary OR NOT ap),
rt AS (SELECT * FROM (SELECT *, bool_or(anchors > 1) OVER (PARTITION BY u, v) AS al FROM o1) WHERE anchors > 1 OR NOT al),
cs AS (SELECT u, v, count(*) > 1 OR NOT bool_or(is_primary) AS shadow, CASE WHEN count(*) > 1 OR NOT bool_or(is_primary) THEN 0 ELSE max(score) END AS weight, CASE WHEN count(DISTINCT direction) = 1 THEN bool_and(direction) END AS consensus FROM rt GROUP BY u, v)"""


def _chains(spark: SparkSession, d: str, reads: str = "customer") -> DataFrame:
    return chaining.chains(A.with_ranges(A.interval_pairs(A.placed(_matches(spark, d, reads)))))


@query("chain_best", f"{_p('customer')}, {_CHAIN} SELECT u, v, direction, score AS best_score FROM od WHERE chain = 0")
def chain_best(spark: SparkSession, d: str) -> DataFrame:
    return _chains(spark, d).where("chain = 0").select("u", "v", "direction", F.col("score").alias("best_score"))


_ORDER = ["u", "v", "direction", "chain", "anchors", "score", "is_primary", "start", "end", "left_offset", "right_offset", "is_contained"]
_ORDER_SQL = ", ".join(f'"{c}"' for c in _ORDER) + ", CAST(ids[1] AS BIGINT) AS first_anchor, CAST(ids[-1] AS BIGINT) AS last_anchor"


def _order(orders: DataFrame) -> DataFrame:
    return orders.select(*_ORDER, F.element_at("ids", 1).alias("first_anchor"), F.element_at("ids", -1).alias("last_anchor"))


@query("chain_orders", f"{_p('customer')}, {_CHAIN} SELECT {_ORDER_SQL} FROM od")
def chain_orders(spark: SparkSession, d: str) -> DataFrame:
    return _order(_chains(spark, d))


@query("any_primary_retain", f"{_p('customer')}, {_CHAIN} SELECT {_ORDER_SQL} FROM rt")
def any_primary_retain(spark: SparkSession, d: str) -> DataFrame:
    return _order(chaining.retain_primary(_chains(spark, d)))


@query("consensus", f"{_p('customer')}, {_CHAIN} SELECT * FROM cs")
def consensus(spark: SparkSession, d: str) -> DataFrame:
    return chaining.consensus(chaining.retain_primary(_chains(spark, d)))


@query("cooccurrence", f"{_m('customer')} SELECT DISTINCT a.nano_id AS u, b.nano_id AS v FROM m a JOIN m b USING (illu_id) WHERE a.nano_id < b.nano_id")
def cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return A.cooccurrence(_matches(spark, d, "customer"))


@query("anchor_cliques", f"""{_p('customer')}, pt AS (SELECT illu_id, min(ov_end) AS pt FROM p GROUP BY illu_id UNION ALL SELECT p.illu_id, min(ov_end) FROM pt JOIN p ON p.illu_id = pt.illu_id AND ov_start > pt.pt GROUP BY p.illu_id),
cq AS (SELECT p.illu_id, u, v, ov_start, ov_end, CAST(count(pt.pt) AS INT) AS clique FROM p LEFT JOIN pt ON pt.illu_id = p.illu_id AND pt.pt < ov_start GROUP BY ALL)
SELECT illu_id, clique, count(*) AS members, max(ov_start) AS lo, min(ov_end) AS hi FROM cq GROUP BY illu_id, clique""")
def anchor_cliques(spark: SparkSession, d: str) -> DataFrame:
    """Of each anchor the cliques of the stretches that pairs of reads share on it, and what a clique has in common."""
    found = cliques.interval_cliques(_pairs(spark, d, "customer").select("illu_id", "ov_start", "ov_end"), "illu_id", "ov_start", "ov_end")
    return cliques.common_stretch(found, "illu_id", "ov_start", "ov_end")


@query("merge_hits", f"""WITH RECURSIVE {align_sql()}, mh AS (SELECT nano_id, illu_id, n_start AS s, n_end AS e, direction, row_number() OVER (PARTITION BY nano_id, illu_id ORDER BY {_L}) AS k FROM align),
fm AS (SELECT nano_id, illu_id, k, s, e, direction, 1 AS n FROM mh WHERE k = 1 UNION ALL
 SELECT fm.nano_id, fm.illu_id, mh.k, CASE WHEN near THEN least(fm.s, mh.s) ELSE fm.s END, CASE WHEN near THEN greatest(fm.e, mh.e) ELSE fm.e END, fm.direction, fm.n + CAST(near AS INT)
 FROM fm JOIN mh ON mh.nano_id = fm.nano_id AND mh.illu_id = fm.illu_id AND mh.k = fm.k + 1, LATERAL (SELECT fm.direction = mh.direction AND (abs(fm.s - mh.e) < 500 OR abs(mh.s - fm.e) < 500) AS near))
SELECT nano_id, illu_id, arg_max(s, k) AS n_start, arg_max(e, k) AS n_end, arg_max(n, k) AS merged FROM fm GROUP BY nano_id, illu_id""")
def merge_hits(spark: SparkSession, d: str) -> DataFrame:
    return A.merge_hits(align(spark, d))


_SANE = """so AS (SELECT *, "start" AS s, "end" AS e FROM rt WHERE is_contained AND is_primary),
bo AS (SELECT u AS a, v AS b, rt.* FROM rt UNION ALL SELECT v, u, rt.* FROM rt),
ne AS (SELECT u AS s, v AS t FROM cs WHERE NOT shadow UNION ALL SELECT v, u FROM cs WHERE NOT shadow),
te AS (SELECT so.u, so.v, so.direction, so.chain, so.s, so.e, ne.t, f.direction AS fd, n.direction AS nd, f.is_contained AS fc, n.is_contained AS nc,
 f."start" = ne.t AS fs, n."start" = ne.t AS ns, f.u = ne.t AS fb, n.u = ne.t AS nb, f."end" = ne.t AS fe, n."end" = ne.t AS ned, n.u IS NOT NULL AS has,
 so.u <> so."end" AS ob, f.u <> f."end" AS fbe, so.left_offset AS ol, so.right_offset AS orr, f.left_offset AS fl, f.right_offset AS fr, n.left_offset AS nl, n.right_offset AS nr
 FROM so JOIN ne ON ne.s = so.s AND ne.t <> so.e JOIN bo f ON f.a = so.s AND f.b = ne.t LEFT JOIN bo n ON n.a = so.e AND n.b = ne.t),
sg AS (SELECT *, has AND ((direction = nd) = fd) AND CASE
 WHEN fc AND nc THEN ns
 WHEN fc THEN fe OR (CASE WHEN (NOT ned) <> (NOT direction AND ob) THEN ol ELSE orr END)
   + (CASE WHEN (CASE WHEN ned THEN NOT direction ELSE direction END) <> (NOT fd AND fbe) THEN fl ELSE fr END) + (CASE WHEN NOT ned THEN nl ELSE nr END) < 300
 WHEN nc THEN ns
 ELSE ((fs <> (NOT fd AND fb)) <> (NOT direction)) = (ns <> (NOT nd AND nb)) END AS ok FROM te),
st AS (SELECT u, v, direction, chain, s, e, t, bool_or(coalesce(ok, false)) AS ok FROM sg GROUP BY ALL),
bad AS (SELECT DISTINCT u, v, direction, chain FROM st WHERE NOT ok),
sc AS (SELECT u, v, s, e FROM (SELECT so.*, row_number() OVER (PARTITION BY u, v ORDER BY direction, chain) AS rn FROM so ANTI JOIN bad USING (u, v, direction, chain)) WHERE rn = 1)"""


def _placed(spark: SparkSession, d: str, reads: str = "customer") -> DataFrame:
    """Matches with their places on the reads, written once for the several joins behind them."""
    return materialize(A.placed(_matches(spark, d, reads)), "placed")


def _orders(placed: DataFrame, among: DataFrame) -> DataFrame:
    """Orders of the retained chains of some edges (u, v), or of some anchors (u, v, illu_id) of theirs."""
    return chaining.retain_primary(chaining.chains(A.with_ranges(A.interval_pairs(placed, among=among))))


def _core(placed: DataFrame, kinds: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders and edges of the core pairs (the other edges are shadows), and the sane contractions."""
    orders = materialize(_orders(placed, kinds.where("core")), "orders")
    edges = materialize(chaining.consensus(orders), "consensus")
    return orders, edges, contract.sane_contractions(orders, edges, between=lambda asked: _orders(placed, asked))


def _kinds(placed: DataFrame) -> DataFrame:
    return materialize(chaining.pair_kinds(A.interval_pairs(placed)).where("core"), "core-pairs")


@query("sane_contraction", f"{_p('customer')}, {_CHAIN}, {_SANE} SELECT u, v, s, e FROM sc")
def sane_contraction(spark: SparkSession, d: str) -> DataFrame:
    placed = _placed(spark, d)
    return _core(placed, _kinds(placed))[2].select("u", "v", "s", "e")


_TARGET = """fl AS (SELECT nano_id, row_number() OVER (ORDER BY """ + _L + """) AS line FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nano_id ORDER BY """ + _L + """) AS r1 FROM f) WHERE r1 = 1)),
up AS (SELECT s, e FROM (SELECT s, e, row_number() OVER (PARTITION BY s ORDER BY line, e) AS rn FROM sc JOIN fl ON fl.nano_id = e) WHERE rn = 1),
rw AS (SELECT s, e AS cur, 1 AS n, [s, e] AS seen, false AS circle FROM up UNION ALL SELECT rw.s, up.e, n + 1, list_append(seen, up.e), list_contains(seen, up.e) FROM rw JOIN up ON up.s = rw.cur WHERE NOT circle),
cy AS (SELECT DISTINCT s AS id FROM rw WHERE circle AND cur = s),
lo AS (SELECT id, (SELECT min(r.cur) FROM rw r WHERE r.s = cy.id) AS low FROM cy),
u2 AS (SELECT s, e FROM up WHERE s NOT IN (SELECT id FROM lo WHERE id = low)),
w AS (SELECT s, e AS cur, 1 AS n FROM u2 UNION ALL SELECT w.s, u2.e, n + 1 FROM w JOIN u2 ON u2.s = w.cur),
tg AS (SELECT s, arg_max(cur, n) AS target FROM w GROUP BY s)"""


def _targets(placed: DataFrame, contractions: DataFrame) -> DataFrame:
    first = A.vertices(placed).select(F.col("nano_id").alias("e"), "first_line")
    return contract.targets(contractions.join(first, "e"))


def _contracted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    placed = _placed(spark, d)
    return placed, _targets(placed, _core(placed, _kinds(placed))[2])


@query("contraction_targets", f"{_p('customer')}, {_CHAIN}, {_SANE}, {_TARGET} SELECT s, target FROM tg")
def contraction_targets(spark: SparkSession, d: str) -> DataFrame:
    return _contracted(spark, d)[1]


@query("contraction_roots", f"{_p('customer')}, {_CHAIN}, {_SANE}, {_TARGET} SELECT DISTINCT target AS id FROM tg WHERE target NOT IN (SELECT s FROM tg)")
def contraction_roots(spark: SparkSession, d: str) -> DataFrame:
    return contract.roots(_contracted(spark, d)[1])


@query("collected", f"{_p('customer')}, {_CHAIN}, {_SANE}, {_TARGET} SELECT target AS root, m.nano_id, m.illu_id, m.n_start, m.n_end FROM tg JOIN m ON m.nano_id = tg.s SEMI JOIN m r ON r.nano_id = tg.target AND r.illu_id = m.illu_id")
def collected(spark: SparkSession, d: str) -> DataFrame:
    placed, found = _contracted(spark, d)
    return contract.collected(found, placed)


# --- intervals


_PROFILE = """ev AS (SELECT illu_id, i_start AS pos, 1 AS d FROM x UNION ALL SELECT illu_id, i_end_x, -1 FROM x),
es AS (SELECT illu_id, pos, sum(d) AS d FROM ev GROUP BY illu_id, pos HAVING sum(d) <> 0),
pr AS (SELECT illu_id, pos AS seg_start, lead(pos) OVER w - 1 AS seg_end, CAST(sum(d) OVER w AS BIGINT) AS depth FROM es WINDOW w AS (PARTITION BY illu_id ORDER BY pos)),
prof AS (SELECT * FROM pr WHERE depth > 0)"""


def _profile(spark: SparkSession, d: str) -> DataFrame:
    return intervals.coverage(align(spark, d).withColumn("last", F.col("i_end_x") - 1), "illu_id", "i_start", "last")


@query("coverage_profile", f"WITH {align_sql()}, x AS (SELECT * FROM align), {_PROFILE} SELECT * FROM prof")
def coverage_profile(spark: SparkSession, d: str) -> DataFrame:
    return _profile(spark, d)


def _deepest(spark: SparkSession, d: str) -> DataFrame:
    rows = A.first_match(align(spark, d)).withColumn("last", F.col("i_end_x") - 1)
    return intervals.max_coverage(rows, intervals.coverage(rows, "illu_id", "i_start", "last"), "illu_id", "nano_id")


_FIRST = f"x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nano_id, illu_id ORDER BY {_L}) AS rn FROM align) WHERE rn = 1)"
_MAXCOV = f"{_FIRST}, {_PROFILE}, mc AS (SELECT illu_id, max(depth) AS max_cov FROM prof GROUP BY illu_id)"


@query("max_coverage", f"WITH {align_sql()}, {_MAXCOV} SELECT illu_id, count(DISTINCT nano_id) AS n_reads, max_cov FROM x JOIN mc USING (illu_id) GROUP BY illu_id, max_cov")
def max_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _deepest(spark, d)


_CUT = "cut AS (SELECT quantile_cont(max_cov, 0.25) AS q1, quantile_cont(max_cov, 0.75) AS q3 FROM mc), lim AS (SELECT q3, q3 + 1.5 * (q3 - q1) AS cutoff FROM cut)"


@query("coverage_outliers", f"WITH {align_sql()}, {_MAXCOV}, {_CUT} SELECT illu_id, max_cov, cutoff, q3 FROM mc, lim WHERE max_cov > cutoff")
def coverage_outliers(spark: SparkSession, d: str) -> DataFrame:
    return intervals.coverage_outliers(_deepest(spark, d), "illu_id")


@query("coverage_summary", f"WITH {align_sql()}, {_MAXCOV}, {_CUT} SELECT count(*) AS anchors, CAST(sum(CAST(max_cov > cutoff AS INT)) AS BIGINT) AS outliers, max(cutoff) AS cutoff FROM mc, lim")
def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    deepest = materialize(_deepest(spark, d), "depths")
    return deepest.join(F.broadcast(intervals.quartile_cutoff(deepest))).agg(F.count("*").alias("anchors"), F.sum((F.col("max_cov") > F.col("cutoff")).cast("long")).alias("outliers"), F.max("cutoff").alias("cutoff"))


@query("cut_peaks", f"""WITH {align_sql()}, {_MAXCOV}, {_CUT}, al AS (SELECT illu_id, q3 FROM mc, lim WHERE max_cov > cutoff),
ev2 AS (SELECT illu_id, i_start AS pos, 1 AS d FROM align UNION ALL SELECT illu_id, i_end_x, -1 FROM align),
es2 AS (SELECT illu_id, pos, sum(d) AS d FROM ev2 GROUP BY illu_id, pos HAVING sum(d) <> 0),
pr2 AS (SELECT illu_id, pos AS a, lead(pos) OVER w - 1 AS z, sum(d) OVER w AS depth FROM es2 WINDOW w AS (PARTITION BY illu_id ORDER BY pos)),
lo AS (SELECT pr2.*, CASE WHEN lag(z) OVER (PARTITION BY illu_id ORDER BY a) + 1 = a THEN 0 ELSE 1 END AS nw FROM pr2 JOIN al USING (illu_id) WHERE depth > 0 AND depth <= q3),
isl AS (SELECT *, sum(nw) OVER (PARTITION BY illu_id ORDER BY a) AS g FROM lo),
rn AS (SELECT illu_id, min(a) AS "start", max(z) AS "end" FROM isl GROUP BY illu_id, g HAVING max(z) - min(a) + 1 >= 100)
SELECT illu_id, CAST(row_number() OVER (PARTITION BY illu_id ORDER BY "start") - 1 AS INT) AS piece, "start", "end" FROM rn""")
def cut_peaks(spark: SparkSession, d: str) -> DataFrame:
    return intervals.cut_peaks(_profile(spark, d), coverage_outliers(spark, d), "illu_id", 100)


_UNION = """un AS (SELECT nano_id, n_start AS s, max(n_end) AS e FROM align GROUP BY 1, 2),
u1 AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY nano_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM un),
u2 AS (SELECT *, sum(nw) OVER (PARTITION BY nano_id ORDER BY s) AS g FROM u1),
mg AS (SELECT nano_id, min(s) AS "start", max(e) AS "end" FROM u2 GROUP BY nano_id, g)"""


def _union(spark: SparkSession, d: str) -> DataFrame:
    return intervals.interval_union(align(spark, d, "order"), "nano_id", "n_start", "n_end")


@query("interval_union", f"WITH {align_sql('order')}, {_UNION} SELECT * FROM mg")
def interval_union(spark: SparkSession, d: str) -> DataFrame:
    return _union(spark, d)


@query("clip_ends", f"""WITH {align_sql('order')}, {_UNION}, le AS (SELECT nano_id, max(n_end) + 51 AS length FROM align GROUP BY 1),
cl AS (SELECT nano_id, greatest("start", 200) AS "start", least("end", length - 200) AS "end", CAST(row_number() OVER (PARTITION BY nano_id ORDER BY "start", "end") - 1 AS INT) AS piece FROM mg JOIN le USING (nano_id))
SELECT nano_id, "start", "end", piece FROM cl WHERE "start" <= "end" """)
def clip_ends(spark: SparkSession, d: str) -> DataFrame:
    return intervals.clip_ends(_union(spark, d), A.vertices(align(spark, d, "order")), "nano_id")


_SCRUB = f"""{_p()},
ah AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nano_id, illu_id ORDER BY {_L}) AS rn FROM align WHERE i_end_x - i_start >= 400) WHERE rn = 1),
al AS (SELECT nano_id, max(n_end) + 51 AS length FROM align WHERE i_end_x - i_start >= 400 GROUP BY nano_id),
ob AS (SELECT u, v, u_n_start AS us, u_n_end + 1 AS ue, v_n_start AS vs, v_n_end + 1 AS ve, direction, illu_id AS line FROM p WHERE u_n_end + 1 - u_n_start >= 400 AND u IN (SELECT nano_id FROM al) AND v IN (SELECT nano_id FROM al)),
oh AS (SELECT *, row_number() OVER (PARTITION BY r, o ORDER BY line) AS k FROM (SELECT u AS r, v AS o, us AS s, ue AS e, direction, line FROM ob UNION ALL SELECT v, u, vs, ve, direction, line FROM ob)),
fd AS (SELECT r, o, k, s, e, direction FROM oh WHERE k = 1 UNION ALL
 SELECT fd.r, fd.o, oh.k, CASE WHEN near THEN least(fd.s, oh.s) ELSE fd.s END, CASE WHEN near THEN greatest(fd.e, oh.e) ELSE fd.e END, fd.direction FROM (SELECT * FROM fd) fd JOIN oh ON oh.r = fd.r AND oh.o = fd.o AND oh.k = fd.k + 1, LATERAL (SELECT fd.direction = oh.direction AND (abs(fd.s - oh.e) < 500 OR abs(oh.s - fd.e) < 500) AS near)),
rg AS (SELECT nano_id AS r, n_start AS s, n_end + 1 AS e FROM ah UNION ALL SELECT r, arg_max(s, k), arg_max(e, k) FROM fd GROUP BY r, o),
r1 AS (SELECT r, s, max(e) AS e FROM rg GROUP BY r, s), r2 AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY r ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM r1),
r3 AS (SELECT *, sum(nw) OVER (PARTITION BY r ORDER BY s) AS g FROM r2), r4 AS (SELECT r, min(s) AS s, max(e) AS e FROM r3 GROUP BY r, g),
r5 AS (SELECT r, greatest(s, 200) AS s, least(e, length - 200) AS e, CAST(row_number() OVER (PARTITION BY r ORDER BY s) - 1 AS INT) AS piece FROM r4 JOIN al ON al.nano_id = r)
SELECT r AS nano_id, piece, CAST(s AS INT) AS "start", CAST(e AS INT) AS "end" FROM r5 WHERE s <= e"""


@query("scrubbed_ranges", _SCRUB)
def scrubbed_ranges(spark: SparkSession, d: str) -> DataFrame:
    """What anchors and other reads cover of each read; the pairs of reads on an anchor stand for their overlaps."""
    own = align(spark, d).where("i_end_x - i_start >= 400").groupBy("nano_id").agg((F.max("n_end") + 51).cast("int").alias("n_len"))
    rows = align(spark, d).join(own, "nano_id")
    pairs = _pairs(spark, d).select(F.col("u").alias("illu_id"), F.col("v").alias("nano_id"), F.col("u_n_start").alias("i_start"), (F.col("u_n_end") + 1).alias("i_end_x"), F.col("v_n_start").alias("n_start"), F.col("v_n_end").alias("n_end"), "direction", F.col("illu_id").alias("line"))
    return scrub.covered_ranges(rows, pairs, least=400).select("nano_id", "piece", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))


# --- sequences and k-mers


_REV = "reverse(translate({0}, 'ACGT', 'TGCA'))"
_KM = "km AS (SELECT id, least(k, reverse(translate(k, 'ACGT', 'TGCA'))) AS kmer FROM (SELECT id, substr(seq, i, {k}) AS k FROM (SELECT id, seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM seqs WHERE length(seq) >= {k}))), kc AS (SELECT kmer, count(*) AS n FROM km GROUP BY kmer)"
_HIST = "hi AS (SELECT n AS abundance, count(*) AS frequency FROM kc GROUP BY n), mo AS (SELECT * FROM hi WHERE abundance > 1), tt AS (SELECT CAST(sum(frequency) AS BIGINT) AS total FROM mo), cu AS (SELECT abundance, sum(frequency) OVER (ORDER BY abundance) AS cum FROM mo), q1 AS (SELECT min(abundance) AS q1 FROM cu, tt WHERE cum >= round_even(0.25 * (total + 1), 0)), q3 AS (SELECT coalesce(min(abundance), 0) AS q3 FROM cu, tt, q1 WHERE abundance > q1 AND cum >= round_even(0.75 * (total + 1), 0)), th AS (SELECT total, q1, q3, q3 + 2 * (q3 - q1) AS threshold FROM tt, q1, q3)"
_K = f"WITH {SEQ_SQL}, {_KM.format(k=11)}"


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return kmers.kmer_counts(sequences(spark, d), 11)


@query("kmer_count", f"{_K} SELECT * FROM kc")
def kmer_count(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d)


@query("kmer_histogram", f"{_K} SELECT n AS abundance, count(*) AS frequency FROM kc GROUP BY n")
def kmer_histogram(spark: SparkSession, d: str) -> DataFrame:
    return kmers.histogram(_counts(spark, d))


@query("kmer_threshold", f"{_K}, {_HIST} SELECT * FROM th")
def kmer_threshold(spark: SparkSession, d: str) -> DataFrame:
    return kmers.quartile_threshold(materialize(kmers.histogram(_counts(spark, d)), "histogram"))


def _reject(spark: SparkSession, d: str) -> DataFrame:
    counts = materialize(_counts(spark, d), "kmers")
    return kmers.frequent(counts, kmers.quartile_threshold(materialize(kmers.histogram(counts), "histogram")))


@query("kmer_reject", f"{_K}, {_HIST} SELECT kmer, n FROM kc, th WHERE n >= threshold")
def kmer_reject(spark: SparkSession, d: str) -> DataFrame:
    return _reject(spark, d)


@query("kmer_clean_pairs", f"{_K}, {_HIST}, bad AS (SELECT DISTINCT id // 2 AS p FROM km JOIN kc USING (kmer), th WHERE n >= threshold) SELECT id, CAST(length(seq) AS INT) AS n FROM seqs WHERE id // 2 NOT IN (SELECT p FROM bad)")
def kmer_clean_pairs(spark: SparkSession, d: str) -> DataFrame:
    seqs = sequences(spark, d).withColumn("pair", F.floor(F.col("id") / 2))
    return kmers.without_kmers(seqs, _reject(spark, d), 11, "pair").select("id", F.length("seq").alias("n"))


@query("revcomp", f"WITH {SEQ_SQL} SELECT id, {_REV.format('seq')} AS rc FROM seqs")
def revcomp(spark: SparkSession, d: str) -> DataFrame:
    return sequences(spark, d).select("id", S.revcomp(F.col("seq")).alias("rc"))


@query("slice_inclusive", f"WITH {SEQ_SQL} SELECT id, substr(seq, 6, greatest(least(length(seq), 40), 5) - 5 + 1) AS piece, {_REV.format('substr(seq, 6, greatest(least(length(seq), 41), 5) - 5 + 1)')} AS turned FROM seqs")
def slice_inclusive(spark: SparkSession, d: str) -> DataFrame:
    s, i, j = F.col("seq"), F.lit(5), F.lit(40)
    return sequences(spark, d).select("id", S.slice_inclusive(s, i, j).alias("piece"), S.directional_slice(s, i, j, F.lit(False)).alias("turned"))


@query("fasta_wrap", f"WITH {SEQ_SQL} SELECT '>' || id || chr(10) || coalesce(array_to_string(list_transform(range(0, CAST(ceil(length(seq) / 60.0) AS BIGINT)), lambda i: substr(seq, CAST(i * 60 + 1 AS BIGINT), 60)), chr(10)), '') AS value FROM seqs")
def fasta_wrap(spark: SparkSession, d: str) -> DataFrame:
    return records.fasta_lines(sequences(spark, d))


@query("long_sequences", f"WITH {SEQ_SQL} SELECT id, CAST(length(seq) AS INT) AS n FROM seqs WHERE length(seq) >= 500")
def long_sequences(spark: SparkSession, d: str) -> DataFrame:
    return sequences(spark, d).select("id", F.length("seq").alias("n")).where("n >= 500")


@query("minimizer_overlaps")
def minimizer_overlaps(spark: SparkSession, d: str) -> DataFrame:
    once, members = kmers.fold_equal(sequences(spark, d))
    minis = materialize(kmers.minimizers(once), "minimizers")
    return kmers.with_members(kmers.shared_minimizers(minis), minis, members)


_UK = "uk AS (SELECT DISTINCT substr(seq, i, 14) AS kmer FROM (SELECT seq, unnest(range(1, length(seq) - 12)) AS i FROM seqs WHERE length(seq) >= 14))"


@query("unitig_links", f"WITH {SEQ_SQL}, {_UK}, a AS (SELECT substr(kmer, 2) AS mid, min(kmer) AS a FROM uk GROUP BY 1 HAVING count(*) = 1), b AS (SELECT substr(kmer, 1, 13) AS mid, min(kmer) AS b FROM uk GROUP BY 1 HAVING count(*) = 1) SELECT a, b FROM a JOIN b USING (mid)")
def unitig_links(spark: SparkSession, d: str) -> DataFrame:
    return kmers.unitig_links(sequences(spark, d), 14)


_RC = _REV.format
_UNITIG = f"""WITH RECURSIVE {SEQ_SQL}, {_KM.format(k=15)}, ori AS (SELECT kmer FROM kc UNION ALL SELECT {_RC('kmer')} FROM kc),
oo AS (SELECT substr(kmer, 2) AS mid, min(kmer) AS a FROM ori GROUP BY 1 HAVING count(*) = 1), oi AS (SELECT substr(kmer, 1, 14) AS mid, min(kmer) AS b FROM ori GROUP BY 1 HAVING count(*) = 1),
ln AS (SELECT a, b FROM oo JOIN oi USING (mid) WHERE b <> {_RC('a')}),
wk AS (SELECT kmer AS head, kmer AS cur, 0 AS pos FROM ori ANTI JOIN ln ON ln.b = ori.kmer UNION ALL SELECT head, ln.b, pos + 1 FROM wk JOIN ln ON ln.a = wk.cur),
rg AS (SELECT kmer FROM ori ANTI JOIN wk ON wk.cur = ori.kmer),
cw AS (SELECT kmer AS head, kmer AS cur, 0 AS pos FROM rg UNION ALL SELECT head, ln.b, pos + 1 FROM cw JOIN ln ON ln.a = cw.cur WHERE ln.b > head),
cs AS (SELECT cw.head FROM cw JOIN ln ON ln.a = cw.cur AND ln.b = cw.head),
te AS (SELECT head, string_agg(substr(cur, 15, 1), '' ORDER BY pos) FILTER (WHERE pos > 0) AS rest FROM wk GROUP BY head HAVING head < {_RC('arg_max(cur, pos)')}
 UNION ALL SELECT head, string_agg(substr(cur, 15, 1), '' ORDER BY pos) FILTER (WHERE pos > 0) FROM cw SEMI JOIN cs USING (head) GROUP BY head HAVING head < min({_RC('cur')})),
tx AS (SELECT head AS unitig, head || coalesce(rest, '') AS t FROM te)
SELECT unitig, piece, substr(t, CAST(piece * 60 + 1 AS BIGINT), 60) AS text FROM (SELECT unitig, t, unnest(range(0, (length(t) + 59) // 60)) AS piece FROM tx)"""


@query("unitigs", _UNITIG)
def unitigs(spark: SparkSession, d: str) -> DataFrame:
    return U.unitigs(sequences(spark, d), 15)


# --- graphs


def _solid(placed: DataFrame, kinds: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The graph behind contraction, u, v, weight, direction, start, end: edges of consensus that aren't shadows and have
    an order that is no containment, between reads that aren't contracted. And the orders of the shadows among them, if
    ``kinds`` has the pairs that aren't core, with their ways."""
    orders, edges, sane = _core(placed, _kinds(placed) if kinds is None else kinds)
    gone = materialize(_targets(placed, sane).select(F.col("s").alias("id")), "contracted")
    keep = ["u", "v", "weight", "direction", "start", "end"]
    lying = graph.without(contract.drop_contained(orders).select("u", "v", "direction", "start", "end").join(edges, ["u", "v"]), gone)
    solid, shadows = materialize(lying.where(~F.col("shadow")).select(*keep), "graph"), lying.where("shadow").select(*keep)
    if kinds is None:
        return solid, shadows
    u, v, forward = F.col("u"), F.col("v"), F.col("forward")
    alone = kinds.where("NOT core AND NOT is_contained").select("u", "v", F.lit(0).cast("long").alias("weight"), "direction", F.when(forward, u).otherwise(v).alias("start"), F.when(forward, v).otherwise(u).alias("end"))
    return solid, shadows.union(graph.without(alone, gone))


def _graph(spark: SparkSession, d: str) -> DataFrame:
    return _solid(_placed(spark, d))[0]


_G = f"""{_p('customer')}, {_CHAIN}, {_SANE}, {_TARGET},
g AS (SELECT rt.u, rt.v, cs.weight, rt.direction, rt."start", rt."end" FROM rt JOIN cs USING (u, v) WHERE NOT cs.shadow AND NOT rt.is_contained AND rt.u NOT IN (SELECT s FROM tg) AND rt.v NOT IN (SELECT s FROM tg))"""


_BOTH = "bw AS (SELECT u, v FROM g UNION ALL SELECT v, u FROM g)"


@query("neighbours", f"{_G}, {_BOTH} SELECT DISTINCT u AS id, v AS neighbour FROM bw")
def neighbours(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(_graph(spark, d))


@query("degrees", f"{_G} SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT u AS id, 0 AS i, 1 AS o FROM g UNION ALL SELECT v, 1, 0 FROM g) GROUP BY id")
def degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_graph(spark, d))


@query("boundary_edges", f"{_G} SELECT u, v FROM g WHERE (u % 3 = 0) <> (v % 3 = 0)")
def boundary_edges(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    return graph.boundary(g, graph.neighbours(g).select("id").where("id % 3 = 0"))


@query("induced_subgraph", f"{_G} SELECT u, v, weight FROM g WHERE u % 2 = 0 AND v % 2 = 0")
def induced_subgraph(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    return graph.induced(g, graph.neighbours(g).select("id").where("id % 2 = 0")).select("u", "v", "weight")


@query("anti_delete", f"{_G} SELECT u, v, weight FROM g WHERE u % 5 <> 0 AND v % 5 <> 0")
def anti_delete(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    return graph.without(g, graph.neighbours(g).select("id").where("id % 5 = 0")).select("u", "v", "weight")


_COMP = "cc AS (SELECT u AS id, u AS c FROM bw UNION SELECT bw.v, cc.c FROM cc JOIN bw ON bw.u = cc.id), co AS (SELECT id, min(c) AS component FROM cc GROUP BY id)"


@query("components", f"{_G}, {_BOTH}, {_COMP} SELECT * FROM co")
def components(spark: SparkSession, d: str) -> DataFrame:
    return graph.connected_components(_graph(spark, d))


@query("shortest_hops", f"{_G}, {_BOTH}, {_COMP}, ro AS (SELECT DISTINCT component AS id FROM co), sh AS (SELECT id, CAST(0 AS BIGINT) AS hops FROM ro UNION SELECT bw.v, hops + 1 FROM sh JOIN bw ON bw.u = sh.id WHERE hops < 40), s1 AS (SELECT id, min(hops) AS hops FROM sh GROUP BY id) SELECT s1.id, s1.hops, coalesce((SELECT min(bw.u) FROM bw JOIN s1 t ON t.id = bw.u WHERE bw.v = s1.id AND t.hops = s1.hops - 1), -1) AS via FROM s1")
def shortest_hops(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    found = graph.hops(g, graph.connected_components(g).select(F.col("component").alias("id")).distinct())
    return found.withColumn("via", F.coalesce("via", F.lit(-1).cast("long")))


@query("topo_levels", f"{_G}, tl AS (SELECT DISTINCT u AS id, CAST(0 AS BIGINT) AS level FROM g UNION SELECT g.v, level + 1 FROM tl JOIN g ON g.u = tl.id) SELECT id, max(level) AS level FROM tl GROUP BY id")
def topo_levels(spark: SparkSession, d: str) -> DataFrame:
    return graph.topological_levels(_graph(spark, d))


_MSF = "hv AS (SELECT u, v, weight, row_number() OVER (ORDER BY weight DESC, u, v) AS r FROM g), hb AS (SELECT u, v, r FROM hv UNION ALL SELECT v, u, r FROM hv), re AS (SELECT r, u AS id FROM hv UNION SELECT re.r, hb.v FROM re JOIN hb ON hb.u = re.id AND hb.r < re.r), fo AS (SELECT hv.u, hv.v, hv.weight FROM hv WHERE NOT EXISTS (SELECT 1 FROM re WHERE re.r = hv.r AND re.id = hv.v))"


@query("max_spanning_forest", f"{_G}, {_MSF} SELECT * FROM fo")
def max_spanning_forest(spark: SparkSession, d: str) -> DataFrame:
    return graph.max_spanning_forest(_graph(spark, d))


_SIGN = f"{_BOTH}, {_COMP}, {_MSF}, fd AS (SELECT fo.u, fo.v, g.direction AS d FROM fo JOIN g USING (u, v) UNION ALL SELECT fo.v, fo.u, g.direction FROM fo JOIN g USING (u, v)), po AS (SELECT DISTINCT component AS id, true AS s FROM co UNION SELECT fd.v, po.s = fd.d FROM po JOIN fd ON fd.u = po.id)"


@query("parity_conflicts", f"{_G}, {_SIGN} SELECT g.u, g.v, g.direction FROM g JOIN po a ON a.id = g.u JOIN po b ON b.id = g.v WHERE (a.s = b.s) <> g.direction")
def parity_conflicts(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    return graph.parity_conflicts(g, materialize(graph.max_spanning_forest(g), "forest"))


def _second(sql: str) -> str:
    """The same tables over what is left of the graph (g2), with a 2 behind their names."""
    return re.sub(r"\b(g|bw|cc|co|hv|hb|re|fo)\b(?=[ ,.)])", r"\g<1>2", sql)


_GONE = """cf AS (SELECT g.u, g.v, g.weight AS base FROM g JOIN po a ON a.id = g.u JOIN po b ON b.id = g.v WHERE (a.s = b.s) <> g.direction),
fw AS (SELECT u, v, weight FROM fo UNION ALL SELECT v, u, weight FROM fo),
wk AS (SELECT u AS cu, v AS cv, u AS cur, CAST(-1 AS BIGINT) AS prev, CAST(NULL AS BIGINT) AS lw, CAST(NULL AS BIGINT) AS la, CAST(NULL AS BIGINT) AS lb, CAST(0 AS BIGINT) AS hi FROM cf
 UNION ALL SELECT cu, cv, fw.v, wk.cur, CASE WHEN lw IS NULL OR fw.weight < lw THEN fw.weight ELSE lw END, CASE WHEN lw IS NULL OR fw.weight < lw THEN least(fw.u, fw.v) ELSE la END, CASE WHEN lw IS NULL OR fw.weight < lw THEN greatest(fw.u, fw.v) ELSE lb END, greatest(hi, fw.weight)
 FROM wk JOIN fw ON fw.u = wk.cur AND fw.v <> wk.prev WHERE wk.cur <> wk.cv),
gone AS (SELECT u, v FROM cf UNION SELECT la, lb FROM wk JOIN cf ON cf.u = cu AND cf.v = cv WHERE cur = cv AND (lw < base OR (base * 1.1 >= lw AND lw < hi * 0.8)))"""


def _lengths(placed: DataFrame) -> DataFrame:
    return materialize(placed.select(F.col("nano_id").alias("id"), "length").distinct(), "lengths")


def _rooted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Graph, forest, the longest read of each component, lengths."""
    placed = _placed(spark, d)
    g, lengths = _solid(placed)[0], _lengths(placed)
    return g, materialize(graph.max_spanning_forest(g), "forest"), materialize(graph.component_roots(g, lengths), "roots"), lengths


@query("decycled", f"{_G}, {_SIGN}, {_GONE} SELECT u, v FROM gone")
def decycled(spark: SparkSession, d: str) -> DataFrame:
    g, forest, roots, _ = _rooted(spark, d)
    return graph.decycled(g, forest, roots)


def _directed(placed: DataFrame, kinds: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What decycling leaves, and the shadows (all of them with ``kinds``, see _solid), oriented from each component's
    longest read: src, dst, weight. And the sign of each read."""
    g, shadows = _solid(placed, kinds)
    lengths = _lengths(placed)
    gone = graph.decycled(g, materialize(graph.max_spanning_forest(g), "forest"), materialize(graph.component_roots(g, lengths), "roots"))
    left = materialize(g.join(gone, ["u", "v"], "left_anti"), "agreeing")
    roots, forest = materialize(graph.component_roots(left, lengths), "roots"), materialize(graph.max_spanning_forest(left), "forest")
    tree = forest.select("u", "v").join(left.select("u", "v", "direction"), ["u", "v"])
    signs = materialize(graph.potentials(tree, roots), "signs")
    solid, shadows = (graph.turned(x, signs) for x in (left, shadows))
    return solid, shadows, signs.select("id", F.col("sign").alias("forward"))


_ORIENT = f"""{_G}, {_SIGN}, {_GONE}, g2 AS (SELECT g.* FROM g ANTI JOIN gone USING (u, v)), {_second(_BOTH)}, {_second(_COMP)}, {_second(_MSF)},
ro AS (SELECT id FROM (SELECT co2.id, row_number() OVER (PARTITION BY component ORDER BY length DESC, co2.id) AS rn FROM co2 JOIN r ON r.nano_id = co2.id) WHERE rn = 1),
fd2 AS (SELECT fo2.u, fo2.v, g2.direction AS d FROM fo2 JOIN g2 USING (u, v) UNION ALL SELECT fo2.v, fo2.u, g2.direction FROM fo2 JOIN g2 USING (u, v)),
po2 AS (SELECT id, true AS s, 0 AS depth, CAST(-1 AS BIGINT) AS prev FROM ro UNION ALL SELECT fd2.v, po2.s = fd2.d, depth + 1, po2.id FROM po2 JOIN fd2 ON fd2.u = po2.id AND fd2.v <> po2.prev),
tn AS (SELECT g2.weight, g2."start", g2."end", CASE WHEN b.depth < a.depth OR (b.depth = a.depth AND g2.v < g2.u) THEN (NOT b.s) <> (NOT g2.direction) ELSE NOT a.s END AS turned
 FROM g2 JOIN po2 a ON a.id = g2.u JOIN po2 b ON b.id = g2.v)"""


@query("orient", f"{_ORIENT} SELECT DISTINCT CASE WHEN turned THEN \"end\" ELSE \"start\" END AS src, CASE WHEN turned THEN \"start\" ELSE \"end\" END AS dst, weight FROM tn")
def orient(spark: SparkSession, d: str) -> DataFrame:
    return _directed(_placed(spark, d))[0]


def _acyclic(placed: DataFrame, kinds: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The directed graph without its feedback edges, those edges, the shadows, and the reads' signs."""
    *edges, signs = _directed(placed, kinds)
    solid, shadows = (x.select(F.col("src").alias("u"), F.col("dst").alias("v"), "weight") for x in edges)
    solid = materialize(solid, "directed")
    back = materialize(graph.feedback_edges(solid), "feedback-edges")
    return materialize(solid.join(back.select("u", "v"), ["u", "v"], "left_anti"), "acyclic"), back, shadows, signs


@query("feedback_edges")
def feedback_edges(spark: SparkSession, d: str) -> DataFrame:
    return _acyclic(_placed(spark, d))[1]


@query("cluster_weights", f"""{_G}, ad AS (SELECT DISTINCT u, v FROM g), cl AS (SELECT u AS x, u AS prev, v AS last, [u, v] AS way FROM ad
 UNION ALL SELECT cl.x, cl.last, ad.v, list_append(cl.way, ad.v) FROM cl JOIN ad ON ad.u = cl.last WHERE (SELECT count(*) FROM ad b WHERE b.v = ad.v AND list_contains(cl.way, b.u)) = len(cl.way)),
bs AS (SELECT way FROM (SELECT *, max(len(way)) OVER (PARTITION BY x) AS most FROM cl) WHERE len(way) = most),
ws AS (SELECT way[k] AS u, way[k + 1] AS v, len(way) - k AS w FROM (SELECT way, unnest(range(1, len(way))) AS k FROM bs))
SELECT ad.u, ad.v, CAST(coalesce(sum(w), 0) AS BIGINT) AS cluster FROM ad LEFT JOIN ws USING (u, v) GROUP BY ad.u, ad.v""")
def cluster_weights(spark: SparkSession, d: str) -> DataFrame:
    """The edges of the graph from the smaller to the larger id, weighted by the cliques that they are in."""
    return P.cluster_weights(_graph(spark, d))


def _signed_paths(placed: DataFrame) -> DataFrame:
    """Paths of reads: path, pos, id, forward."""
    kinds = materialize(chaining.pair_kinds(A.interval_pairs(placed), ways=True).where("core OR NOT is_contained"), "pair-kinds")
    e, back, shadows, signs = _acyclic(placed, kinds)
    left_out = materialize(back.select("u", "v").union(shadows.select("u", "v")).distinct(), "left-out")
    weighted = materialize(P.cluster_weights(e), "weighted")
    found = P.extract_paths(weighted, e.select("u", "v").union(left_out))
    return materialize(P.join_paths(found, left_out).join(signs, "id"), "all-paths")


@query("paths")
def paths(spark: SparkSession, d: str) -> DataFrame:
    return _signed_paths(_placed(spark, d)).select("path", "pos", "id")


def _steps(placed: DataFrame) -> DataFrame:
    found = _signed_paths(placed)
    steps = found.select("id", F.lead("id").over(Window.partitionBy("path").orderBy("pos")).alias("next")).where("next IS NOT NULL")
    orders = materialize(_orders(placed, steps.select(F.least("id", "next").alias("u"), F.greatest("id", "next").alias("v")).distinct()), "orders")
    return T.path_orders(found, contract.drop_contained(orders))


@query("path_orders")
def path_orders(spark: SparkSession, d: str) -> DataFrame:
    """The chain of anchors that each step of a path takes, and the anchors that it comes back to."""
    return _steps(_placed(spark, d)).select("path", "pos", "id", "forward", "next", F.size("ids").alias("anchors"), F.array_join("ids", ",").alias("ids"), F.array_join("kinks", ",").alias("kinks"))


def _on_reads(spark: SparkSession, d: str) -> DataFrame:
    placed = _placed(spark, d)
    return materialize(T.anchored(_steps(placed), placed, _lengths(placed)), "on-reads")


@query("anchor_axis")
def anchor_axis(spark: SparkSession, d: str) -> DataFrame:
    """Where each anchor of a path lies on the path's axis."""
    return T.axis(_on_reads(spark, d)).select("path", "node.*", "lb", "rb")


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    reads = _on_reads(spark, d)
    return materialize(T.pieces(reads, T.axis(reads)), "pieces")


@query("target_slices")
def target_slices(spark: SparkSession, d: str) -> DataFrame:
    """The slices of anchors and reads that make each path's target."""
    return T.target_slices(_pieces(spark, d))


@query("assembly_records")
def assembly_records(spark: SparkSession, d: str) -> DataFrame:
    """Alignment lines of the pieces between and beside the anchors, on their targets."""
    found = _pieces(spark, d)
    return records.paf_lines(assembly.paf_rows(T.queries(found, materialize(T.target_slices(found), "slices"))))
