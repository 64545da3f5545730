"""Join-shaped operators: two-key, positional, within a tolerance, nearest, containing and overlapping.

Joins on a range get an equi-key from buckets of the range's own width, so
that no nested loop remains however large the tables are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def join_two_keys(left: DataFrame, right: DataFrame, first: str, second: str, values: list[str], order: list[str]) -> DataFrame:
    """Left rows with the right's values by the first key, else by the second; of several right rows the first in order."""

    def pick(key: str, suffix: str) -> DataFrame:
        w = Window.partitionBy(key).orderBy(*order)
        r = right.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1")
        return r.select(F.col(key).alias(f"_k{suffix}"), F.lit(True).alias(f"_hit{suffix}"), *[F.col(v).alias(f"{v}{suffix}") for v in values])

    j = left.join(pick(first, "_1"), F.col(first) == F.col("_k_1"), "left").join(pick(second, "_2"), F.col(second) == F.col("_k_2"), "left")
    by = F.when(F.col("_hit_1"), "first").when(F.col("_hit_2"), "second")
    return j.select(*left.columns, *[F.when(F.col("_hit_1"), F.col(f"{v}_1")).otherwise(F.col(f"{v}_2")).alias(v) for v in values], by.alias("matched_by"))


def join_all_or_positional(left: DataFrame, right: DataFrame, by: list[str], key: str, order_left: list[str], order_right: list[str], value: str) -> DataFrame:
    """By key where every left row of a group has its right row, else by position within the group."""
    r1 = right.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(*by, key).orderBy(*order_right))).where("_n = 1").select(*by, key, F.col(value).alias("_by_key"))
    r2 = right.select(*by, F.row_number().over(Window.partitionBy(*by).orderBy(*order_right)).alias("_pos"), F.col(value).alias("_by_pos"))
    j = left.withColumn("_pos", F.row_number().over(Window.partitionBy(*by).orderBy(*order_left))).join(r1, [*by, key], "left").join(r2, [*by, "_pos"], "left")
    every = F.min(F.col("_by_key").isNotNull()).over(Window.partitionBy(*by))
    return j.withColumn("_every", every).select(*left.columns, F.when(F.col("_every"), F.col("_by_key")).otherwise(F.col("_by_pos")).alias(value), F.when(F.col("_every"), "key").otherwise("position").alias("matched_by"))


def within_tolerance(left: DataFrame, right: DataFrame, by: list[str], at: str, other: str, tolerance: int, how: str, also: tuple[str, str] | None = None) -> DataFrame:
    """``left_semi`` or ``left_anti``: rows with (without) a right row of the key at most ``tolerance`` away, equal in ``also`` if given.

    The right side is looked up in the row's own bucket and the two beside it.
    """
    width = max(1, tolerance)
    r = right.select(*[F.col(c).alias(f"_r_{c}") for c in by], F.col(other).alias("_at"), *([F.col(also[1]).alias("_also")] if also else []))
    r = r.withColumn("_bucket", F.explode(F.array(*[F.floor(F.col("_at") / F.lit(width)) + k for k in (-1, 0, 1)])))
    on = (F.floor(F.col(at) / F.lit(width)) == F.col("_bucket")) & (F.abs(F.col(at) - F.col("_at")) <= tolerance)
    for c in by:
        on = on & (F.col(c) == F.col(f"_r_{c}"))
    if also:
        on = on & (F.col(also[0]) == F.col("_also"))
    return left.join(r, on, how)


def nearest(left: DataFrame, right: DataFrame, by: list[str], left_id: list[str], at: str, other: str, right_id: str, name: tuple[str, str] | None = None) -> DataFrame:
    """The right row of the key with the smallest distance; one of the same name goes first; ties to the earlier, then the smaller id.

    One union and two running windows find the neighbours on both sides, so
    the pairs of a key are never listed.
    """
    names = [name[0]] if name else []

    def side(keys: list[str], suffix: str) -> DataFrame:
        l = left.select(*left_id, *by, *names, F.col(at).alias("_t"), F.lit(1).alias("_is"), F.lit(None).cast(dict(right.dtypes)[right_id]).alias("_rid"))
        r = right.select(*[F.lit(None).cast(dict(left.dtypes)[c]).alias(c) for c in left_id], *by, *([F.col(name[1]).alias(name[0])] if name else []), F.col(other).alias("_t"), F.lit(0).alias("_is"), F.col(right_id).alias("_rid"))
        u = l.unionByName(r)
        back = Window.partitionBy(*keys).orderBy(F.col("_t"), F.col("_is"), F.col("_rid").desc()).rowsBetween(Window.unboundedPreceding, 0)
        ahead = Window.partitionBy(*keys).orderBy(F.col("_t").desc(), F.col("_is"), F.col("_rid").desc()).rowsBetween(Window.unboundedPreceding, 0)
        hit = F.when(F.col("_is") == 0, F.struct("_t", "_rid"))
        u = u.withColumns({"_b": F.last(hit, True).over(back), "_a": F.last(hit, True).over(ahead)}).where("_is = 1")
        db, da = F.col("_t") - F.col("_b._t"), F.col("_a._t") - F.col("_t")
        # at equal distance the earlier one; at distance 0 both windows find the same instant
        best = F.when(F.col("_b").isNull(), F.col("_a")).when(F.col("_a").isNull(), F.col("_b")).when(da < db, F.col("_a")).otherwise(F.col("_b"))
        return u.select(*left_id, best.alias(f"_best{suffix}"))

    every = side(by, "")
    out = left.join(every, left_id, "left")
    best = F.col("_best")
    if name:
        out = out.join(side([*by, name[0]], "_name"), left_id, "left")
        best = F.coalesce(F.col("_best_name"), F.col("_best"))
    return out.select(*left.columns, best["_rid"].alias("nearest_id"), F.abs(best["_t"] - F.col(at)).alias("distance"))


def _level(length):
    """The least k with length <= 2^k; whole numbers only."""
    return F.when(length > 1, F.length(F.bin(length - 1))).otherwise(0)


def _bucket(at, level):
    return F.call_function("shiftright", at.cast("bigint"), level)


def interval_buckets(df: DataFrame, start: str, end: str, level: str = "_level", bucket: str = "_bucket") -> DataFrame:
    """An index of intervals: a row for each bucket that an interval reaches, two at most, however long it is.

    Buckets of a level are as wide as the level's longest intervals can be (a
    power of two). Intervals that end before they start are points at their start.
    """
    s, e = F.col(start), F.greatest(start, end)
    df = df.withColumn(level, _level(e - s))
    return df.withColumn(bucket, F.explode(F.array_distinct(F.array(_bucket(s, F.col(level)), _bucket(e, F.col(level))))))


def _levels(df: DataFrame, start: str, end: str):
    """The levels that a frame's intervals have, 64 at most, as a scalar."""
    return df.agg(F.collect_set(_level(F.greatest(start, end) - F.col(start))).alias("l")).scalar()


def probe_buckets(df: DataFrame, start: str, end: str, levels, above: int | None = None, level: str = "_level", bucket: str = "_bucket") -> DataFrame:
    """Rows to meet an index with: those of two buckets at most for each of its levels not below the row's own (``above``: so much above it at least)."""
    s, e = F.col(start), F.greatest(start, end)
    own = _level(e - s) + (above or 0)
    df = df.withColumn("_own", own).withColumn(level, F.explode(levels)).where(F.col(level) >= F.col("_own")).drop("_own")
    return df.withColumn(bucket, F.explode(F.array_distinct(F.array(_bucket(s, F.col(level)), _bucket(e, F.col(level))))))


def containing_else_before(points: DataFrame, spans: DataFrame, by: list[str], point_id: list[str], at: str, start: str, end: str, span_id: str) -> DataFrame:
    """The last span (by start, end, id) that contains a point, else the last that ends before it.

    ``point_id`` names the columns that tell points apart. Spans are indexed
    by :func:`interval_buckets`, so a long one makes no more rows than a short
    one; a point meets one bucket for each length of spans there is. The
    fall-back is an as-of window over a key's points and ends.
    """
    keys = [*by, "_level", "_bucket"]
    p = points.select(*point_id, *[c for c in by if c not in point_id], F.col(at).alias("_at"))
    s = spans.select(*by, F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(span_id).alias("_sid"))
    index = interval_buckets(s, "_s", "_e")
    hits = probe_buckets(p, "_at", "_at", _levels(s, "_s", "_e")).join(index, keys).where((F.col("_s") <= F.col("_at")) & (F.col("_at") < F.col("_e")))
    hits = hits.groupBy(*point_id).agg(F.max_by("_sid", F.struct("_s", "_e", "_sid")).alias("_in"))
    none = lambda c, df: F.lit(None).cast(dict(df.dtypes)[c])
    only = [c for c in point_id if c not in by]
    u = p.select(*only, *by, F.col("_at").alias("_t"), F.lit(1).alias("_is"), none("_sid", s).alias("_sid"), none("_s", s).alias("_s"))
    u = u.unionByName(s.select(*[none(c, p).alias(c) for c in only], *by, F.col("_e").alias("_t"), F.lit(0).alias("_is"), "_sid", "_s"))
    back = Window.partitionBy(*by).orderBy("_t", "_is", "_s", "_sid").rowsBetween(Window.unboundedPreceding, 0)
    before = u.withColumn("_before", F.last("_sid", True).over(back)).where("_is = 1").select(*point_id, "_before")
    out = points.join(hits, point_id, "left").join(before, point_id, "left")
    return out.select(*points.columns, F.coalesce("_in", "_before").alias("span_id"), F.when(F.col("_in").isNotNull(), "inside").when(F.col("_before").isNotNull(), "before").otherwise("none").alias("how"))


def nearest_exclusive(left: DataFrame, right: DataFrame, by: list[str], left_id: str, at: str, other: str, right_id: str, name: str) -> DataFrame:
    """The nearest right row of the key, each of them taken once: (by, left_id, right_id, distance).

    Left rows choose in the order of (at, left_id). A free row of the same
    ``name`` goes first, then any free one; of two at one distance the
    earlier, then the smaller id. Left rows that find none get nulls. Whole
    numbers only. A choice depends on all before it, so a key is one task,
    which holds its rows' times, ids and names. Rows of a null time find
    nothing; rows of a null key are a key of their own.
    """
    import numpy as np
    import pandas as pd

    kinds = dict(left.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], f"`{left_id}` {kinds[left_id]}", f"`{right_id}` {dict(right.dtypes)[right_id]}", "distance bigint"])

    class Free:
        """Places in a list sorted by time, of which the nearest free one is found by links over those taken."""

        def __init__(self, times):
            self.times, n = times, len(times)
            self.ahead, self.back = list(range(n + 1)), list(range(n + 1))  # back: place + 1, 0 for none

        def _go(self, to: list, k: int) -> int:
            path = []
            while to[k] != k:
                path.append(k)
                k = to[k]
            for p in path:
                to[p] = k
            return k

        def take(self, k: int) -> None:
            self.ahead[k], self.back[k + 1] = k + 1, k

        def nearest(self, t: int) -> int | None:
            after = self._go(self.ahead, int(np.searchsorted(self.times, t)))
            before = self._go(self.back, int(np.searchsorted(self.times, t))) - 1
            if before >= 0 and (after == len(self.times) or t - self.times[before] <= self.times[after] - t):
                # the smallest id of its instant that is free
                return self._go(self.ahead, int(np.searchsorted(self.times, self.times[before])))
            return after if after < len(self.times) else None

    def run(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        r = r.dropna(subset=["_at"]).sort_values(["_at", "_rid"], ignore_index=True)
        times, ids = r["_at"].to_numpy(np.int64), r["_rid"].to_numpy()
        every, own, place = Free(times), {}, {}
        for word, g in r.groupby("_name", sort=False):
            own[word] = Free(times[g.index]), g.index.to_numpy()
            place.update({int(k): (word, j) for j, k in enumerate(g.index)})
        l = l.sort_values([at, left_id], ignore_index=True)
        found, apart = [], []
        for t, word in zip(l[at], l[name]):
            k = None
            if not pd.isna(t):
                if word in own and (j := own[word][0].nearest(int(t))) is not None:
                    k = int(own[word][1][j])
                else:
                    k = every.nearest(int(t))
            found.append(None if k is None else ids[k])
            apart.append(None if k is None else abs(int(times[k]) - int(t)))
            if k is not None:
                every.take(k)
                if k in place:
                    own[place[k][0]][0].take(place[k][1])
        out = l[[*by, left_id]].copy()
        out[right_id], out["distance"] = pd.array(found, dtype="object"), pd.array(apart, dtype="Int64")
        return out

    l = left.select(*by, left_id, at, name)
    # names of their own: both sides may come from one table
    r = right.select(*[F.col(c).alias(f"_r_{c}") for c in by], F.col(right_id).alias("_rid"), F.col(other).alias("_at"), F.col(name).alias("_name"))
    return l.groupBy(*by).cogroup(r.groupBy(*[f"_r_{c}" for c in by])).applyInPandas(run, schema)


def dominant_overlap(spans: DataFrame, items: DataFrame, by: list[str], span_id: str, start: str, end: str, item: str, i_start: str, i_end: str, *, else_first_end: bool = False) -> DataFrame:
    """Per span the item value with the largest sum of overlaps (the smaller value on a tie).

    Both sides are indexed by :func:`interval_buckets`: of a pair, the longer
    one's level is where it meets the shorter one, which reaches two buckets
    there at most. Spans without an overlap are left out or, with
    ``else_first_end``, have the item that ends first at their start or later,
    with an overlap of 0 (null where none does).
    """
    a = spans.select(*by, span_id, F.col(start).alias("_s"), F.col(end).alias("_e"))
    b = items.select(*by, item, F.col(i_start).alias("_is"), F.col(i_end).alias("_ie"))
    keys = [*by, "_level", "_bucket"]
    lo, hi = F.greatest("_s", "_is"), F.least("_e", "_ie")
    pairs = [
        interval_buckets(a, "_s", "_e").join(probe_buckets(b, "_is", "_ie", _levels(a, "_s", "_e")), keys),
        probe_buckets(a, "_s", "_e", _levels(b, "_is", "_ie"), 1).join(interval_buckets(b, "_is", "_ie"), keys),
    ]
    # a pair meets in two buckets at most and counts in the one where the overlap begins
    cols = [*by, span_id, item, (hi - lo).alias("_ms")]
    each = [j.where((hi > lo) & (_bucket(lo, F.col("_level")) == F.col("_bucket"))).select(*cols) for j in pairs]
    sums = each[0].unionByName(each[1]).groupBy(*by, span_id, item).agg(F.sum("_ms").alias("overlap_ms"))
    w = Window.partitionBy(*by, span_id).orderBy(F.col("overlap_ms").desc(), F.col(item))
    best = sums.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    if not else_first_end:
        return best
    # the first end not before a start: ends and starts of a key in one order, from the last
    rest = a.join(best.select(*by, span_id), [*by, span_id], "left_anti")
    none = lambda c, df: F.lit(None).cast(dict(df.dtypes)[c])
    u = rest.select(*by, span_id, F.col("_s").alias("_t"), F.lit(1).alias("_is"), none(item, b).alias(item))
    u = u.unionByName(b.select(*by, none(span_id, a).alias(span_id), F.col("_ie").alias("_t"), F.lit(0).alias("_is"), item))
    ahead = Window.partitionBy(*by).orderBy(F.desc("_t"), "_is", F.desc(item)).rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn(item, F.last(item, True).over(ahead)).where("_is = 1").select(*by, span_id, item, F.lit(0).cast("bigint").alias("overlap_ms"))
    return best.unionByName(u)


def carry_forward(new: DataFrame, old: DataFrame, by: list[str], pos: str, text: str, values: list[str]) -> DataFrame:
    """New rows with the old values where theirs are null and position and trimmed text are the same."""
    o = old.select(*by, pos, F.trim(text).alias("_t"), *[F.col(v).alias(f"_old_{v}") for v in values])
    j = new.withColumn("_t", F.trim(text)).join(o, [*by, pos, "_t"], "left")
    rest = [c for c in new.columns if c not in values]
    return j.select(*rest, *[F.coalesce(F.col(v), F.col(f"_old_{v}")).alias(v) for v in values])
