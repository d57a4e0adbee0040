"""Quotation linking: parse nested quote levels, hash normalised quoted passages, join them to the original messages,
and give conversations in reply order without quotes. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanweave.session import materialize, read_table

_MARKS = r"^((?:[ \t]*>)*)"
_BLANK = r"[ \t\n\x0B\f\r]"


def _normal(c):
    return F.lower(F.trim(F.regexp_replace(c, _BLANK + "+", " ")))


def _let(value, body):
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def quote_lines(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, lines``: of each line its quote level (number of leading ``>``, blanks allowed between
    them) and what stands behind the marks."""
    m = messages.select(messages[conv].cast("long").alias("conv_id"), messages[turn].cast("long").alias("turn"), messages[role].cast("string").alias("role"), F.split(F.coalesce(messages[text].cast("string"), F.lit("")), "\r\n|\n|\r").alias("raw"))
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 1), "[^>]", ""))
    return m.select("conv_id", "turn", "role", F.transform("raw", lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, _MARKS, "").alias("said"))).alias("lines"))


def _passages(lines):
    """Maximal runs of lines of one level, none of them blank; the runs' normalised text. Each line is looked at with
    its neighbours only, so the work is linear in their number."""

    def runs(x):
        at, last = F.sequence(F.lit(0), F.size(x) - 1), F.size(x) - 1
        said, level = (lambda i: x[i]["said"] != ""), (lambda i: x[i]["level"])
        begin = F.filter(at, lambda i: said(i) & ((i == 0) | ~said(F.greatest(i - 1, F.lit(0))) | (level(F.greatest(i - 1, F.lit(0))) != level(i))))
        end = F.filter(at, lambda i: said(i) & ((i == last) | ~said(F.least(i + 1, last)) | (level(F.least(i + 1, last)) != level(i))))
        text = lambda b, e: F.array_join(F.transform(F.slice(x, b + 1, e - b + 1), lambda y: y["said"]), " ")
        return F.zip_with(begin, end, lambda b, e: F.struct(level(b).alias("level"), text(b, e).alias("said")))

    return _let(F.transform(lines, lambda y: F.struct(y["level"].alias("level"), _normal(y["said"]).alias("said"))), runs)


def link_quotations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each message: ``conv_id, turn, role, said`` (its own lines, without quotes), ``n_quotes`` (quoted
    passages), ``n_linked`` (those found in an earlier message), ``reply_to`` (the turn that its first linked passage
    of the lowest level is from), ``depth`` (links up to a message that replies to none) and ``thread`` (that
    message's turn). Within a conversation, turn order is a reply order: every link goes to a smaller turn.

    A passage is a maximal run of lines of one quote level without blank lines; case and white space don't count. It
    belongs to the latest earlier turn of its conversation with an equal unquoted passage. A null text has no lines. A
    message without conversation or turn is given back unlinked. Of several rows with one conversation and turn, each
    is given back; replies to that turn continue its latest link. An empty table gives an empty table.
    """
    lines = quote_lines(messages, conv, turn, role, text)
    own = F.filter("lines", lambda x: x["level"] == 0)
    said = F.regexp_replace(F.concat_ws("\n", F.transform(own, lambda x: x["said"])), f"^{_BLANK}+|{_BLANK}+\\z", "")
    quoting = F.exists("lines", lambda x: x["level"] > 0)
    base = materialize(lines.select("conv_id", "turn", "role", said.alias("said"), F.when(quoting, F.filter(_passages(F.col("lines")), lambda x: x["level"] > 0)).otherwise(F.expr("cast(array() as array<struct<level:int,said:string>>)")).alias("quotes"), "lines", F.xxhash64("conv_id", "turn", "role", "lines").alias("row_key")), "quote-lines")

    quoted = base.where(F.size("quotes") > 0).where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "row_key", F.posexplode("quotes").alias("at", "q"))
    quoted = quoted.select("conv_id", "turn", "row_key", "at", F.col("q.level").alias("level"), F.sha2("q.said", 256).alias("passage")).distinct()
    # only conversations that quote at all take part with their own passages
    asked = quoted.select("conv_id", "passage").distinct()
    mine = base.where("conv_id IS NOT NULL AND turn IS NOT NULL").join(asked.select("conv_id").distinct(), "conv_id", "left_semi")
    mine = mine.select("conv_id", "turn", F.explode(F.array_distinct(F.transform(F.filter(_passages(F.col("lines")), lambda x: x["level"] == 0), lambda x: F.sha2(x["said"], 256)))).alias("passage")).distinct()
    # of each passage and conversation, turns in order: the latest one before the quoting turn, without pairing all with all
    both = mine.select("conv_id", "passage", "turn", F.lit(None).cast("long").alias("row_key"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("level"), F.col("turn").alias("origin")).unionByName(quoted.withColumn("origin", F.lit(None).cast("long")))
    before = Window.partitionBy("conv_id", "passage").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    linked = both.withColumn("origin", F.max("origin").over(before)).where("row_key IS NOT NULL AND origin IS NOT NULL")
    per_row = linked.groupBy("conv_id", "turn", "row_key").agg(F.count("*").alias("n_linked"), F.min_by("origin", F.struct("level", "at")).alias("reply_to"))
    rows = base.join(per_row, ["conv_id", "turn", "row_key"], "left")

    # depth and thread by pointer jumping over the turns that reply
    up = materialize(per_row.groupBy("conv_id", "turn").agg(F.max("reply_to").alias("up")).select("conv_id", "turn", "up", F.lit(1).cast("long").alias("depth")), "reply-links")
    while True:
        far = up.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"))
        up = materialize(up.join(far, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), F.col("up2").isNotNull().alias("moved")), "reply-links")
        if not up.where("moved").take(1):
            break
        up = up.drop("moved")
    tops = up.select("conv_id", F.col("turn").alias("reply_to"), F.col("up").alias("top"), F.col("depth").alias("above"))
    out = rows.join(tops, ["conv_id", "reply_to"], "left")
    return out.select("conv_id", "turn", "role", "said", F.size("quotes").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "reply_to", F.when(F.col("reply_to").isNull(), 0).otherwise(1 + F.coalesce("above", F.lit(0))).cast("long").alias("depth"), F.coalesce("top", "reply_to", "turn").alias("thread"))


def op9_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotations(read_table(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, regexp_split_to_array(coalesce(text, ''), '\r\n|\n|\r') AS raw FROM conversations),
x AS (SELECT rid, conv_id, turn, i, raw[i] AS line FROM m, unnest(range(1, len(raw) + 1)) AS t(i)),
y AS (SELECT *, length(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)*)', 1), '[^>]', '', 'g')) AS level, regexp_replace(line, '^((?:[ \t]*>)*)', '') AS said FROM x),
z AS (SELECT *, lower(trim(regexp_replace(said, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS n FROM y),
b AS (SELECT *, CASE WHEN n = '' OR lag(n) OVER w = '' OR lag(level) OVER w IS DISTINCT FROM level THEN 1 ELSE 0 END AS fresh FROM z WINDOW w AS (PARTITION BY rid ORDER BY i)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS grp FROM b),
p AS (SELECT rid, conv_id, turn, level, grp, string_agg(n, ' ' ORDER BY i) AS passage FROM g GROUP BY ALL HAVING string_agg(n, ' ' ORDER BY i) <> ''),
o AS (SELECT q.rid, q.conv_id, q.turn, q.level, q.grp, max(w.turn) AS origin FROM p q JOIN p w ON w.conv_id = q.conv_id AND w.passage = q.passage AND w.level = 0 AND w.turn < q.turn WHERE q.level > 0 GROUP BY ALL),
r AS (SELECT rid, conv_id, turn, count(*) AS n_linked, arg_min(origin, struct_pack(l := level, g := grp)) AS reply_to FROM o GROUP BY ALL),
u AS (SELECT conv_id, turn, max(reply_to) AS up FROM r GROUP BY ALL),
c AS (SELECT conv_id, turn, up, 1 AS depth FROM u UNION ALL SELECT c.conv_id, c.turn, u.up, c.depth + 1 FROM c JOIN u ON u.conv_id = c.conv_id AND u.turn = c.up),
t AS (SELECT conv_id, turn, arg_max(up, depth) AS top, max(depth) AS above FROM c GROUP BY ALL),
s AS (SELECT rid, regexp_replace(string_agg(said, chr(10) ORDER BY i) FILTER (WHERE level = 0), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+\z', '', 'g') AS said FROM y GROUP BY rid),
k AS (SELECT rid, count(*) AS n_quotes FROM p WHERE level > 0 GROUP BY rid)
SELECT m.conv_id, m.turn, m.role, coalesce(s.said, '') AS said, CAST(coalesce(n_quotes, 0) AS BIGINT) AS n_quotes, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked, reply_to,
       CAST(CASE WHEN reply_to IS NULL THEN 0 ELSE 1 + coalesce(above, 0) END AS BIGINT) AS depth, coalesce(top, reply_to, m.turn) AS thread
FROM m JOIN s USING (rid) LEFT JOIN k USING (rid) LEFT JOIN r USING (rid) LEFT JOIN t ON t.conv_id = m.conv_id AND t.turn = r.reply_to
"""
