"""Interval, window and join queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import dataflow as D
from ..operators import intervals as I
from ..operators import joins as J
from .registry import query
from .tables import IV, intervals, table

#: Line numbers repeat within some orders; these columns put the lines in one order.
_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


@query(
    "gap_overlap_audit",
    f"""WITH {IV}, r AS (SELECT *, coalesce(max(en) OVER (PARTITION BY user_id ORDER BY st, en, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach_before FROM iv)
    SELECT user_id, count(*) AS n, count(*) FILTER (WHERE st > reach_before) AS gaps, sum(greatest(st - reach_before, 0))::BIGINT AS gap_total,
      count(*) FILTER (WHERE st < reach_before) AS overlap_count, sum(greatest(reach_before - st, 0))::BIGINT AS overlap_total, max(en) AS reach FROM r GROUP BY user_id""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return I.gap_overlap_audit(intervals(spark, d), ["user_id"], tie=["event_id"])


@query(
    "tail_gaps",
    f"""WITH {IV}, r AS (SELECT *, coalesce(max(en) OVER (PARTITION BY user_id ORDER BY st, en, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM iv WHERE event_type = 'view'),
    a AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE st > b) AS gaps, sum(greatest(st - b, 0))::BIGINT AS gap_total, max(en) AS reach FROM r GROUP BY user_id),
    x AS (SELECT user_id, max(en) AS e FROM iv GROUP BY user_id),
    j AS (SELECT x.user_id, coalesce(n, 0) AS n, coalesce(gaps, 0) AS gaps, coalesce(gap_total, 0) AS gap_total, greatest(e - coalesce(reach, 0), 0) AS tail_gap FROM x LEFT JOIN a USING (user_id))
    SELECT user_id, n, gaps + CASE WHEN tail_gap > 0 THEN 1 ELSE 0 END AS gaps, gap_total + tail_gap AS gap_total, tail_gap FROM j""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Gaps of each user's views up to the end of all of their events."""
    e = intervals(spark, d)
    ends = e.groupBy("user_id").agg(F.max("en").alias("e"))
    return I.tail_gaps(I.gap_overlap_audit(e.where("event_type = 'view'"), ["user_id"], tie=["event_id"]), ends, ["user_id"], "e").select("user_id", "n", "gaps", "gap_total", "tail_gap")


@query(
    "keyed_lines",
    """WITH t AS (SELECT conv_id, turn, role, CASE WHEN turn % 3 = 2 THEN '' ELSE left(role, 4) END AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations),
    l AS (SELECT *, CASE WHEN role = 'user' THEN text ELSE '> ' || text END AS line FROM t WHERE text <> '')
    SELECT conv_id, turn, line, place || ':' || line || ':' || (row_number() OVER (PARTITION BY conv_id, line ORDER BY turn) - 1) AS key FROM l""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Turns as comments, what is not the user's as replies."""
    t = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 2, "").otherwise(F.left("role", F.lit(4))).alias("text"), (F.col("role") != "user").alias("reply"))
    return I.keyed_lines(t, ["conv_id"], ["turn"], "text", "reply").select("conv_id", "turn", "line", "key")


@query("prefix_starts", "SELECT l_orderkey, l_linenumber, coalesce(sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM lineitem")
def _(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(*_LINE, F.col("l_quantity").cast("bigint").alias("q"))
    return I.prefix_starts(lines, ["l_orderkey"], _LINE[1:], "q").select("l_orderkey", "l_linenumber", "start")


@query("slot_lengths", f"WITH {IV} SELECT event_id, greatest(coalesce(lead(st) OVER (PARTITION BY user_id ORDER BY st, event_id), en) - st, 1)::BIGINT AS slot FROM iv")
def _(spark: SparkSession, d: str) -> DataFrame:
    return I.slot_lengths(intervals(spark, d), ["user_id"], ["st", "event_id"], "st", "en").select("event_id", "slot")


@query("suborder", "SELECT conv_id, turn, CASE WHEN role <> 'system' THEN row_number() OVER (PARTITION BY conv_id, CASE WHEN role <> 'system' THEN role END ORDER BY turn) - 1 END AS suborder FROM conversations")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumn("key", F.when(F.col("role") != "system", F.col("role")))
    return I.occurrence(c, ["conv_id", "key"], ["turn"], "suborder").select("conv_id", "turn", F.col("suborder").cast("bigint").alias("suborder"))


@query(
    "chunk_runs",
    """WITH f AS (SELECT *, (event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1)::INT AS new, row_number() OVER w AS pos FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY pos) AS island FROM f)
    SELECT user_id, any_value(event_type) AS chunk, min(pos)::BIGINT AS first, max(pos)::BIGINT AS last FROM g GROUP BY user_id, island""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    e = I.islands(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    e = I.occurrence(e, ["user_id"], ["ts", "event_id"], "pos")
    n = e.groupBy("user_id", "island", "event_type").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    return n.select("user_id", F.col("event_type").alias("chunk"), (F.col("a") + 1).cast("bigint").alias("first"), (F.col("b") + 1).cast("bigint").alias("last"))


@query("line_occurrence", "SELECT event_id, event_type || ':' || (row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1) AS key FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = I.occurrence(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"])
    return e.select("event_id", F.concat_ws(":", "event_type", F.col("occurrence").cast("string")).alias("key"))


@query(
    "frame_drift",
    """WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, (l_quantity * 37)::BIGINT AS ms FROM lineitem),
    g AS (SELECT *, greatest(round_even(ms * (24 / 1000), 0)::BIGINT, 1) AS frames FROM f),
    h AS (SELECT *, round_even((sum(ms) OVER w)::BIGINT * (24 / 1000), 0)::BIGINT - (sum(frames) OVER w)::BIGINT AS drift FROM g WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity))
    SELECT l_orderkey, l_linenumber, frames, drift, greatest(frames - drift, 1) AS final_frames FROM h""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(*_LINE, (F.col("l_quantity") * 37).cast("bigint").alias("ms"))
    return I.frame_drift(lines, ["l_orderkey"], _LINE[1:], "ms", 24).select("l_orderkey", "l_linenumber", "frames", "drift", "final_frames")


@query(
    "stable_rounds",
    """WITH f AS (SELECT *, (event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM f)
    SELECT user_id, island::BIGINT AS island, count(*) AS rounds FROM g GROUP BY user_id, island HAVING count(*) >= 3""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    e = I.islands(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return e.groupBy("user_id", F.col("island").cast("bigint").alias("island")).agg(F.count("*").alias("rounds")).where("rounds >= 3")


@query(
    "natural_sort",
    """WITH n AS (SELECT doc_id, source, CASE doc_id % 2 WHEN 0 THEN 'Part' ELSE '' END || (doc_id % 117) || 'b' || ((doc_id * 31) % 1009) AS name FROM documents),
    k AS (SELECT *, list_transform(list_concat(CASE WHEN regexp_matches(name, '^[0-9]') THEN [''] ELSE [] END, regexp_extract_all(name, '[0-9]+|[^0-9]+')),
      lambda t: CASE WHEN regexp_matches(t, '^[0-9]') THEN lpad(length(ltrim(t, '0'))::VARCHAR, 10, '0') || ltrim(t, '0') ELSE lower(t) END) AS key FROM n)
    SELECT doc_id, name, row_number() OVER (PARTITION BY source ORDER BY key, doc_id) AS place FROM k""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    name = F.concat(F.when(i % 2 == 0, "Part").otherwise(""), (i % 117).cast("string"), F.lit("b"), (i * 31 % 1009).cast("string"))
    n = table(spark, d, "documents").select("doc_id", "source", name.alias("name")).withColumn("key", S.natural_key(F.col("name")))
    return I.occurrence(n, ["source"], ["key", "doc_id"], "n").select("doc_id", "name", (F.col("n") + 1).cast("bigint").alias("place"))


@query(
    "char_budget",
    """SELECT conv_id, turn, before FROM (SELECT *, (coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1)::BIGINT AS before FROM conversations) WHERE before < 600""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return I.char_budget(table(spark, d, "conversations"), ["conv_id"], ["turn"], "text", 600).select("conv_id", "turn", "before")


@query("last_n", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def _(spark: SparkSession, d: str) -> DataFrame:
    return D.last_n(table(spark, d, "events"), 5, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


@query("union_first_wins", "SELECT k, arg_min(src, p) AS src FROM (SELECT c_nationkey AS k, 'customer' AS src, 0 AS p FROM customer UNION ALL SELECT s_nationkey, 'supplier', 1 FROM supplier UNION ALL SELECT n_nationkey, 'nation', 2 FROM nation) GROUP BY k")
def _(spark: SparkSession, d: str) -> DataFrame:
    frames = [table(spark, d, t).select(F.col(c).alias("k"), F.lit(t).alias("src")).distinct() for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey"))]
    return D.union_first_wins(frames, ["k"], ["src"])


@query("mode_first_seen", "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_id) = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return I.mode_first_seen(table(spark, d, "events"), ["user_id"], "event_type", "event_id")


@query("ms_per_char", f"WITH {IV} SELECT user_id, sum(en - st)::DOUBLE / sum(length(props)) AS ms_per_char FROM iv WHERE en > st AND props <> '' GROUP BY user_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = intervals(spark, d).where("en > st and props <> ''")
    return e.groupBy("user_id").agg(F.try_divide(F.sum(F.col("en") - F.col("st")).cast("double"), F.sum(F.length("props"))).alias("ms_per_char"))


@query("last_end_per_file", f"WITH {IV} SELECT user_id, event_type, greatest(1000000000, max(en))::BIGINT AS last_end FROM iv GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return intervals(spark, d).groupBy("user_id", "event_type").agg(F.greatest(F.lit(1000000000).cast("bigint"), F.max("en")).alias("last_end"))


@query(
    "track_audit",
    f"""WITH {IV}, a AS (SELECT user_id, count(*) FILTER (WHERE NOT (event_type = 'view' AND event_id % 2 = 0)) AS actual, count(*) AS expected FROM iv GROUP BY user_id),
    r AS (SELECT *, coalesce(max(en) OVER (PARTITION BY user_id ORDER BY st, en, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM iv WHERE NOT (event_type = 'view' AND event_id % 2 = 0))
    SELECT a.user_id, expected, actual, expected - actual AS missing, (SELECT count(*) FROM r WHERE r.user_id = a.user_id AND st > b) AS gaps, (SELECT count(*) FROM r WHERE r.user_id = a.user_id AND st < b) AS overlap_count
    FROM a""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    planned = intervals(spark, d)
    actual = planned.where("not (event_type = 'view' and event_id % 2 = 0)")
    missing = J.within_tolerance(planned, actual.select("user_id", "event_id", F.col("st").alias("at")), ["user_id", "event_id"], "st", "at", 1, "left_anti").groupBy("user_id").agg(F.count("*").alias("missing"))
    n = planned.groupBy("user_id").agg(F.count("*").alias("expected"))
    audit = I.gap_overlap_audit(actual, ["user_id"], tie=["event_id"])
    zero = F.coalesce("missing", F.lit(0).cast("bigint"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return n.join(audit, "user_id", "left").join(missing, "user_id", "left").select("user_id", "expected", none("n").alias("actual"), zero.alias("missing"), none("gaps").alias("gaps"), none("overlap_count").alias("overlap_count"))


# ---- joins ------------------------------------------------------------------------------------------------


@query(
    "join_priority_keys",
    """WITH s AS (SELECT s_suppkey, s_nationkey AS k1, s_suppkey % 25 AS k2 FROM supplier),
    a AS (SELECT k1, arg_min(s_suppkey, s_suppkey) AS v FROM s GROUP BY k1), b AS (SELECT k2, min(s_suppkey) AS v FROM s GROUP BY k2)
    SELECT c_custkey, coalesce(a.v, b.v) AS s_suppkey, CASE WHEN a.v IS NOT NULL THEN 'first' WHEN b.v IS NOT NULL THEN 'second' END AS matched_by
    FROM (SELECT c_custkey, c_custkey % 40 AS k1, c_custkey % 31 AS k2 FROM customer) c LEFT JOIN a USING (k1) LEFT JOIN b USING (k2)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    right = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("bigint").alias("k1"), (F.col("s_suppkey") % 25).alias("k2"))
    left = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 40).alias("k1"), (F.col("c_custkey") % 31).alias("k2"))
    return J.join_two_keys(left, right, "k1", "k2", ["s_suppkey"], ["s_suppkey"]).select("c_custkey", "s_suppkey", "matched_by")


@query(
    "join_all_or_positional",
    """WITH l AS (SELECT conv_id, turn, turn % 5 AS k FROM conversations WHERE role = 'user'), r AS (SELECT conv_id, turn % 5 AS k, turn, length(text)::BIGINT AS v FROM conversations WHERE role <> 'user'),
    r1 AS (SELECT conv_id, k, arg_min(v, turn) AS v FROM r GROUP BY ALL), r2 AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, v FROM r),
    j AS (SELECT l.conv_id, l.turn, r1.v AS a, r2.v AS b FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM l) l LEFT JOIN r1 USING (conv_id, k) LEFT JOIN r2 USING (conv_id, p))
    SELECT conv_id, turn, CASE WHEN bool_and(a IS NOT NULL) OVER w THEN a ELSE b END AS v, CASE WHEN bool_and(a IS NOT NULL) OVER w THEN 'key' ELSE 'position' END AS matched_by FROM j WINDOW w AS (PARTITION BY conv_id)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumn("k", F.col("turn") % 5)
    left = c.where("role = 'user'").select("conv_id", "turn", "k")
    right = c.where("role <> 'user'").select("conv_id", "k", "turn", F.length("text").cast("bigint").alias("v"))
    return J.join_all_or_positional(left, right, ["conv_id"], "k", ["turn"], ["turn"], "v").select("conv_id", "turn", "v", "matched_by")


@query(
    "carry_forward_timings",
    """SELECT conv_id, turn, coalesce(CASE WHEN turn % 2 = 0 THEN turn * 10 END, CASE WHEN turn % 3 <> 1 THEN turn * 1000 END) AS start FROM conversations""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    new = c.withColumn("start", F.when(F.col("turn") % 2 == 0, F.col("turn") * 10))
    old = c.select("conv_id", "turn", F.when(F.col("turn") % 3 == 1, F.concat("text", F.lit("?"))).otherwise(F.concat(F.lit(" "), "text")).alias("text"), (F.col("turn") * 1000).alias("start"))
    return J.carry_forward(new, old, ["conv_id"], "turn", "text", ["start"]).select("conv_id", "turn", "start")


_PLACED = f"{IV}, act AS (SELECT user_id, event_type, st + (event_id % 7) * 100 AS at FROM iv WHERE event_id % 3 <> 0)"


def _placed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = intervals(spark, d).select("user_id", "event_id", "event_type", "st")
    return e, e.where("event_id % 3 <> 0").select("user_id", "event_type", (F.col("st") + F.col("event_id") % 7 * 100).alias("at"))


@query("anti_range_tolerance", f"WITH {_PLACED} SELECT user_id, event_id FROM iv WHERE NOT EXISTS (SELECT 1 FROM act WHERE act.user_id = iv.user_id AND abs(act.at - iv.st) <= 300)")
def _(spark: SparkSession, d: str) -> DataFrame:
    e, act = _placed(spark, d)
    return J.within_tolerance(e, act, ["user_id"], "st", "at", 300, "left_anti").select("user_id", "event_id")


@query("semi_range_equi", f"WITH {_PLACED} SELECT user_id, event_id FROM iv WHERE EXISTS (SELECT 1 FROM act WHERE act.user_id = iv.user_id AND act.event_type = iv.event_type AND abs(act.at - iv.st) <= 300)")
def _(spark: SparkSession, d: str) -> DataFrame:
    e, act = _placed(spark, d)
    return J.within_tolerance(e, act, ["user_id"], "st", "at", 300, "left_semi", ("event_type", "event_type")).select("user_id", "event_id")


@query(
    "nearest_match",
    f"""WITH {IV}, l AS (SELECT user_id, event_id, event_type, st FROM iv WHERE event_id % 4 = 0), r AS (SELECT user_id, event_id AS rid, event_type, st AS t FROM iv WHERE event_id % 4 <> 0),
    j AS (SELECT l.*, rid, abs(t - st) AS distance, row_number() OVER (PARTITION BY l.event_id ORDER BY (r.event_type = l.event_type) DESC, abs(t - st), t, rid) AS k FROM l LEFT JOIN r USING (user_id))
    SELECT event_id, rid AS nearest_id, distance FROM j WHERE k = 1""".replace("LEFT JOIN r USING (user_id)", "LEFT JOIN r ON l.user_id = r.user_id"),
)
def _(spark: SparkSession, d: str) -> DataFrame:
    e = intervals(spark, d)
    left = e.where("event_id % 4 = 0").select("user_id", "event_id", "event_type", "st")
    right = e.where("event_id % 4 <> 0").select("user_id", F.col("event_id").alias("rid"), "event_type", F.col("st").alias("at"))
    return J.nearest(left, right, ["user_id"], ["event_id"], "st", "at", "rid", ("event_type", "event_type")).select("event_id", "nearest_id", "distance")


@query("nearest_exclusive")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = intervals(spark, d)
    left = e.where("event_id % 4 = 0").select("user_id", "event_id", "event_type", "st")
    right = e.where("event_id % 4 <> 0").select("user_id", F.col("event_id").alias("nearest_id"), "event_type", F.col("st").alias("at"))
    return J.nearest_exclusive(left, right, ["user_id"], "event_id", "st", "at", "nearest_id", "event_type")


@query(
    "interval_then_asof",
    f"""WITH {IV}, p AS (SELECT user_id, event_id, st AS at FROM iv WHERE event_id % 5 = 0), s AS (SELECT user_id, event_id AS sid, st, en FROM iv WHERE event_id % 5 <> 0),
    a AS (SELECT p.event_id, arg_max(sid, (st, en, sid)) AS i FROM p JOIN s ON p.user_id = s.user_id AND s.st <= p.at AND p.at < s.en GROUP BY p.event_id),
    b AS (SELECT p.event_id, arg_max(sid, (en, st, sid)) AS i FROM p JOIN s ON p.user_id = s.user_id AND s.en <= p.at GROUP BY p.event_id)
    SELECT p.event_id, coalesce(a.i, b.i) AS span_id, CASE WHEN a.i IS NOT NULL THEN 'inside' WHEN b.i IS NOT NULL THEN 'before' ELSE 'none' END AS how FROM p LEFT JOIN a USING (event_id) LEFT JOIN b USING (event_id)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    e = intervals(spark, d)
    points = e.where("event_id % 5 = 0").select("user_id", "event_id", F.col("st").alias("at"))
    spans = e.where("event_id % 5 <> 0").select("user_id", F.col("event_id").alias("sid"), "st", "en")
    return J.containing_else_before(points, spans, ["user_id"], ["event_id"], "at", "st", "en", "sid").select("event_id", "span_id", "how")


@query(
    "dominant_overlap",
    f"""WITH {IV}, a AS (SELECT user_id, event_id, st, en FROM iv WHERE event_id % 6 = 0), b AS (SELECT user_id, event_type, st AS s2, en AS e2 FROM iv WHERE event_id % 6 <> 0),
    j AS (SELECT a.event_id, b.event_type, sum(least(en, e2) - greatest(st, s2))::BIGINT AS overlap_ms FROM a JOIN b ON a.user_id = b.user_id AND least(en, e2) > greatest(st, s2) GROUP BY ALL),
    k AS (SELECT event_id, event_type, overlap_ms FROM j QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY overlap_ms DESC, event_type) = 1),
    n AS (SELECT a.event_id, arg_min(b.event_type, (e2, b.event_type)) AS event_type FROM a LEFT JOIN b ON a.user_id = b.user_id AND e2 >= st WHERE a.event_id NOT IN (SELECT event_id FROM k) GROUP BY a.event_id)
    SELECT * FROM k UNION ALL SELECT event_id, event_type, 0 FROM n""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    e = intervals(spark, d)
    a = e.where("event_id % 6 = 0").select("user_id", "event_id", "st", "en")
    b = e.where("event_id % 6 <> 0").select("user_id", "event_type", F.col("st").alias("s2"), F.col("en").alias("e2"))
    return J.dominant_overlap(a, b, ["user_id"], "event_id", "st", "en", "event_type", "s2", "e2", else_first_end=True).select("event_id", "event_type", "overlap_ms")


# ---- intervals --------------------------------------------------------------------------------------------


@query(
    "normalize_interval",
    """WITH r AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN value * 100 END AS sm, CASE WHEN event_id % 4 = 0 THEN value * 100 + 0.5 END AS em, CASE WHEN event_id % 4 <> 3 THEN value END AS s,
      value + CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 120 ELSE 121 END AS e FROM events),
    k AS (SELECT *, sm IS NOT NULL AND em IS NOT NULL AS ms, CASE WHEN e - s > 0 AND e - s <= 120 AND e <= 20000 THEN 1000 ELSE 1 END AS f FROM r),
    x AS (SELECT event_id, CASE WHEN ms THEN sm WHEN s IS NOT NULL AND e IS NOT NULL THEN s * f END AS a, CASE WHEN ms THEN em WHEN s IS NOT NULL AND e IS NOT NULL THEN e * f END AS b FROM k)
    SELECT event_id, greatest(coalesce(round_even(a, 0)::BIGINT, 0), 0) AS start_ms, greatest(greatest(coalesce(round_even(a, 0)::BIGINT, 0), 0), coalesce(round_even(b, 0)::BIGINT, 0)) AS end_ms FROM x""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    i, v = F.col("event_id"), F.col("value")
    more = F.when(i % 3 == 0, 0).when(i % 3 == 1, 120).otherwise(121)
    x = S.normalize_interval(F.when(i % 4 == 0, v * 100), F.when(i % 4 == 0, v * 100 + 0.5), F.when(i % 4 != 3, v), v + more)
    return table(spark, d, "events").select("event_id", x.alias("x")).select("event_id", F.col("x.start").alias("start_ms"), F.col("x.end").alias("end_ms"))


@query(
    "fill_gaps",
    f"""WITH {IV}, w AS (SELECT event_id, en, row_number() OVER o AS k, greatest(st, 0) AS lo, lead(greatest(st, 0)) OVER o AS nx, max(en) OVER (PARTITION BY user_id) AS most FROM iv WINDOW o AS (PARTITION BY user_id ORDER BY st, event_id)),
    s AS (SELECT *, CASE WHEN k = 1 THEN 0 ELSE lo END AS a FROM w)
    SELECT event_id, a::BIGINT AS new_start, (CASE WHEN nx IS NOT NULL THEN greatest(nx - 1, a) ELSE greatest(en, a, most) END)::BIGINT AS new_end FROM s""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return I.fill_gaps(intervals(spark, d), ["user_id"], "st", "en", "event_id").select("event_id", "new_start", "new_end")


@query("ms_to_frames", f"WITH {IV} SELECT event_id, greatest(ceil((en - st) * 24 / 1000)::BIGINT, 1) AS up, greatest(round_even((en - st) * 24 / 1000, 0)::BIGINT, 1) AS near FROM iv")
def _(spark: SparkSession, d: str) -> DataFrame:
    ms = F.col("en") - F.col("st")
    return intervals(spark, d).select("event_id", S.frames_from_ms(ms, 24).alias("up"), S.frames_from_ms(ms, 24, "round").alias("near"))


@query(
    "visual_slots",
    f"""WITH {IV}, s AS (SELECT user_id, event_id, round_even(st * 24 / 1000, 0)::BIGINT AS f, round_even(en * 24 / 1000, 0)::BIGINT AS g, bool_and(en > st) OVER (PARTITION BY user_id) AS ok FROM iv)
    SELECT event_id, greatest(coalesce(lead(f) OVER (PARTITION BY user_id ORDER BY f, event_id), g) - f, 1)::BIGINT AS slot FROM s WHERE ok""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = intervals(spark, d).withColumn("ok", F.min(F.col("en") > F.col("st")).over(Window.partitionBy("user_id"))).where("ok")
    frames = lambda c: F.bround(F.col(c) * 24 / 1000).cast("bigint")
    e = e.withColumns({"f": frames("st"), "g": frames("en")})
    return I.slot_lengths(e, ["user_id"], ["f", "event_id"], "f", "g").select("event_id", "slot")


@query(
    "clip_placement",
    f"""WITH {IV}, t AS (SELECT event_id, least(en - st, 400000) AS take, 400000 AS target, en - st AS actual FROM iv)
    SELECT event_id, ceil(take * 30 / 1000)::BIGINT AS source_frames, round_even(take * 24 / 1000, 0)::BIGINT AS placed, 9600 - round_even(take * 24 / 1000, 0)::BIGINT AS fill,
      CASE WHEN actual > target + 20 THEN 'longer' WHEN actual < target - 20 THEN 'shorter' ELSE 'fits' END AS verdict FROM t""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    target = F.lit(400_000).cast("bigint")
    actual = F.col("en") - F.col("st")
    take = F.least(actual, target)
    placed = F.bround(take * 24 / 1000).cast("bigint")
    verdict = F.when(actual > target + 20, "longer").when(actual < target - 20, "shorter").otherwise("fits")
    return intervals(spark, d).select("event_id", F.ceil(take * 30 / 1000).cast("bigint").alias("source_frames"), placed.alias("placed"), (F.lit(9600) - placed).cast("bigint").alias("fill"), verdict.alias("verdict"))


@query(
    "timecode",
    """WITH f AS (SELECT event_id, floor(value * 3000)::BIGINT AS n FROM events)
    SELECT event_id, CASE WHEN n // 24 // 3600 < 10 THEN '0' ELSE '' END || (n // 24 // 3600) || ':' || lpad((n // 24 // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((n // 24 % 60)::VARCHAR, 2, '0') || ':' || lpad((n % 24)::VARCHAR, 2, '0') AS tc, n AS frames FROM f""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", S.timecode(F.floor(F.col("value") * 3000).cast("bigint"), 24).alias("tc"))
    return e.withColumn("frames", S.frames_from_timecode(F.col("tc"), 24))


@query("frame_rate", "SELECT event_id, ['24'::VARCHAR, '30000/1001', '25/0', 'x', '60000/1001'][event_id % 5 + 1] AS text, [24.0::DOUBLE, 30000::DOUBLE / 1001, NULL, NULL, 60000::DOUBLE / 1001][event_id % 5 + 1] AS fps FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(*[F.lit(x) for x in ("24", "30000/1001", "25/0", "x", "60000/1001")])
    e = table(spark, d, "events").select("event_id", F.get(words, (F.col("event_id") % 5).cast("int")).alias("text"))
    return e.withColumn("fps", S.frame_rate(F.col("text")))


@query("out_point", f"WITH {IV} SELECT user_id, greatest(max(en) FILTER (WHERE event_type = 'view'), max(en) FILTER (WHERE event_type = 'click')) AS out_point FROM iv GROUP BY user_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    ends = [F.max(F.when(F.col("event_type") == t, F.col("en"))) for t in ("view", "click")]
    return intervals(spark, d).groupBy("user_id").agg(F.greatest(*ends).alias("out_point"))


@query(
    "spread_tokens",
    """WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9_''\\-]+') AS w FROM conversations),
    e AS (SELECT conv_id, turn, i - 1 AS pos, w[i] AS token, turn + (i - 1) * (1.0::DOUBLE / len(w)) AS start_s FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM t))
    SELECT conv_id, turn, pos, token, start_s FROM e""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.text import tokenize

    t = table(spark, d, "conversations").select("conv_id", "turn", tokenize(F.col("text")).alias("w"))
    e = t.select("conv_id", "turn", F.size("w").alias("n"), F.posexplode("w").alias("pos", "token"))
    return e.select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), "token", (F.col("turn") + F.col("pos") * (F.lit(1.0) / F.col("n"))).alias("start_s"))
