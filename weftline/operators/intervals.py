"""Ordered rows and intervals: audits, gap filling, slots, budgets and islands, as windows over a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _running(by: list[str], order: list):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def gap_overlap_audit(df: DataFrame, by: list[str], start: str = "st", end: str = "en", tie: list[str] | None = None) -> DataFrame:
    """Per key: rows, gaps and overlaps against the furthest end so far (0 at first), counted and in units."""
    reach = F.coalesce(F.max(end).over(_running(by, [start, end, *(tie or [])])), F.lit(0).cast("bigint"))
    gap = F.col(start) - F.col("_reach")
    e = df.withColumn("_reach", reach).withColumn("_gap", gap)
    return e.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("_gap") > 0).alias("gaps"),
        F.sum(F.greatest(F.col("_gap"), F.lit(0).cast("bigint"))).alias("gap_total"),
        F.count_if(F.col("_gap") < 0).alias("overlap_count"),
        F.sum(F.greatest(-F.col("_gap"), F.lit(0).cast("bigint"))).alias("overlap_total"),
        F.max(end).alias("reach"),
    )


def tail_gaps(audit: DataFrame, expected: DataFrame, by: list[str], end: str) -> DataFrame:
    """Rows of :func:`gap_overlap_audit` with the gap up to an expected end counted in, by ``expected`` (by, end).

    Keys that are expected and have no rows are one gap from 0 on; keys
    without an expected end stay as they are. ``tail_gap`` is its length.
    """
    zero = F.lit(0).cast("bigint")
    j = expected.select(*by, F.col(end).alias("_end")).join(audit, by, "full")
    j = j.withColumns({c: F.coalesce(F.col(c), zero) for c in audit.columns if c not in by})
    j = j.withColumn("tail_gap", F.greatest(F.coalesce(F.col("_end") - F.col("reach"), zero), zero))
    more = F.when(F.col("tail_gap") > 0, 1).otherwise(0)
    return j.withColumns({"gaps": F.col("gaps") + more, "gap_total": F.col("gap_total") + F.col("tail_gap")}).drop("_end")


def keyed_lines(df: DataFrame, by: list[str], order: list[str], text: str, reply: str) -> DataFrame:
    """``line`` and ``key`` of rows whose text is not blank: replies begin with "> ", the key is place:line:occurrence.

    The place counts all rows of a group, blank ones too; the occurrence
    counts equal lines before.
    """
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    line = F.when(F.coalesce(F.col(reply), F.lit(False)), F.concat(F.lit("> "), F.col(text))).otherwise(F.col(text))
    rows = df.withColumn("_place", place).where(F.coalesce(F.col(text), F.lit("")) != "").withColumn("line", line)
    rows = occurrence(rows, [*by, "line"], order, "_seen")
    return rows.withColumn("key", F.concat_ws(":", "_place", "line", "_seen")).drop("_place", "_seen")


def prefix_starts(df: DataFrame, by: list[str], order: list[str], length: str, into: str = "start") -> DataFrame:
    """Start of each row when all are put end to end."""
    return df.withColumn(into, F.coalesce(F.sum(length).over(_running(by, order)), F.lit(0)).cast("bigint"))


def slot_lengths(df: DataFrame, by: list[str], order: list[str], start: str, end: str, into: str = "slot") -> DataFrame:
    """Length up to the next start, at least 1; the last row's up to its own end."""
    after = F.lead(start).over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(into, F.greatest(F.coalesce(after, F.col(end)) - F.col(start), F.lit(1).cast("bigint")))


def fill_gaps(df: DataFrame, by: list[str], start: str, end: str, tie: str, total: str | None = None) -> DataFrame:
    """Intervals without gaps: the first starts at 0, each ends one before the next start (not before its own), the last at the total."""
    w = Window.partitionBy(*by).orderBy(start, tie)
    n = F.row_number().over(w)
    lo = F.greatest(F.col(start), F.lit(0).cast("bigint"))
    df = df.withColumns({"_n": n, "_next": F.lead(lo).over(w), "_most": F.coalesce(F.col(total) if total else F.lit(None).cast("bigint"), F.max(end).over(Window.partitionBy(*by)))})
    s = F.when(F.col("_n") == 1, F.lit(0).cast("bigint")).otherwise(lo)
    e = F.when(F.col("_next").isNotNull(), F.greatest(F.col("_next") - 1, s)).otherwise(F.greatest(F.col(end), s, F.col("_most")))
    return df.withColumns({"new_start": s, "new_end": e}).drop("_n", "_next", "_most")


def islands(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """``island``: number of the run of equal values that a row is in, from 1 (nulls are equal to each other)."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w))) | (F.row_number().over(w) == 1)
    return df.withColumn("island", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def char_budget(df: DataFrame, by: list[str], order: list[str], text: str, limit: int) -> DataFrame:
    """Rows until their texts, joined by one character each, reach the limit; the row that crosses it stays."""
    before = F.coalesce(F.sum(F.length(text) + 1).over(_running(by, order)), F.lit(0))
    return df.withColumn("before", (before - 1).cast("bigint")).where(F.col("before") < limit)


def frame_drift(df: DataFrame, by: list[str], order: list[str], ms: str, fps: int) -> DataFrame:
    """Frames of each row, corrected by how far the sum of rounded frames is from the rounded sum."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rate = F.lit(fps) / F.lit(1000)
    df = df.withColumn("frames", F.greatest(F.bround(F.col(ms) * rate).cast("bigint"), F.lit(1).cast("bigint")))
    df = df.withColumn("drift", F.bround(F.sum(ms).over(w) * rate).cast("bigint") - F.sum("frames").over(w))
    return df.withColumn("final_frames", F.greatest(F.col("frames") - F.col("drift"), F.lit(1).cast("bigint")))


def occurrence(df: DataFrame, by: list[str], order: list[str], into: str = "occurrence") -> DataFrame:
    """How many equal rows came before; null where a key is null."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return df.withColumn(into, F.when(F.col(by[-1]).isNotNull(), n))


def mode_first_seen(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The commonest non-null value per key; of equals the one seen first."""
    n = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("_at"))
    best = F.max_by(F.struct(value, "n"), F.struct("n", -F.col("_at"))).alias("b")
    return n.groupBy(*by).agg(best).select(*by, f"b.{value}", "b.n")


def resume_prefix(old: DataFrame, new: DataFrame, by: list[str], pos: str = "pos") -> DataFrame:
    """Rows of ``new`` before the first whose text differs from the old one, or whose old start is null or missing.

    Both have by, pos, text; old has start and end, which the result carries.
    """
    o = old.select(*by, pos, F.col("text").alias("_old"), "start", "end")
    j = new.join(o, [*by, pos], "left")
    good = F.coalesce((F.trim("text") == F.trim("_old")) & F.col("start").isNotNull(), F.lit(False))
    stop = F.min(F.when(~good, F.col(pos))).over(Window.partitionBy(*by))
    return j.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col(pos) < F.col("_stop"))).drop("_old", "_stop")
