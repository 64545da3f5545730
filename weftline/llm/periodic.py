"""Runs of periodically repeating words, found by a scan of all lags.

A text's words become numbers; the array is compared with itself shifted by
every lag q up to its length over the least exponent, and the stretches of
equal places are run-length encoded. A stretch of q places less than a run's
length is a run of period q. Stretches that several lags find with the same
ends are one run, whose period is the smallest of them: by the theorem of Fine
and Wilf all of them are multiples of it, and a run of the smallest period is
long enough wherever one of a multiple is.

A scan is quadratic in the text's length, so the lags of a long text are
dealt out: it becomes rows of the word numbers and a range of lags, which are
spread over all tasks, and the stretches meet by text afterwards. Short texts
are scanned where they are read. Both ways give the same runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names

#: Least length of a run in words, and in periods.
LEAST, EXPONENT = 6, 4
#: Comparisons of one range of lags, and lags of one at least (each range carries the whole array).
COMPARISONS, LAGS = 1 << 25, 4_096
_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_FOUND = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)), T.StructField("strongest", _RUN), T.StructField("collapsed", T.StringType())]
_ADDED = [f.name for f in _FOUND]


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []  # on bytes: exactly the six white characters of ASCII


def numbers(words: list[bytes]) -> np.ndarray:
    """Equal words as equal numbers, in the smallest type that holds them."""
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int32, len(words))
    return ids.astype(np.uint8 if len(index) < 1 << 8 else np.uint16 if len(index) < 1 << 16 else np.int32)


def ranges(n: int, exponent: int = EXPONENT, comparisons: int = COMPARISONS, lags: int = LAGS) -> list[tuple[int, int]]:
    """The lags 1 to n / exponent in ranges (first, last + 1) of nearly equal work."""
    most = n // exponent
    step = max(lags, comparisons // max(1, n))
    parts = max(1, -(-most // step))
    edges = [1 + most * k // parts for k in range(parts + 1)]
    return list(zip(edges, edges[1:], strict=False))


def stretches(ids: np.ndarray, first: int, end: int, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, lag) of what repeats at lags first to end - 1 and is long enough; multiples of a period included."""
    out = []
    same = np.empty(len(ids), bool)
    for q in range(first, end):
        need = max(least, exponent * q) - q
        here = np.equal(ids[:-q], ids[q:], out=same[:-q])
        if np.count_nonzero(here) < need:
            continue
        edges = np.flatnonzero(np.diff(here, prepend=False, append=False))
        a, b = edges[::2], edges[1::2]
        for k in np.flatnonzero(b - a >= need):
            out.append((int(a[k]), int(b[k] - a[k]) + q, q))
    return out


def runs_of(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Each stretch once, with its smallest period; by start, then period."""
    least: dict[tuple[int, int], int] = {}
    for start, length, q in found:
        least[start, length] = min(q, least.get((start, length), q))
    return sorted(((start, length, q) for (start, length), q in least.items()), key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; the first, then the one of the smaller period on a tie."""
    # two different quotients of numbers below 2^32 differ by more than 2^-64
    return max(runs, key=lambda r: ((r[1] << 64) // r[2], -r[0], -r[2]), default=None)


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words without those that a run repeats, joined by blanks."""
    if runs:
        gone = np.zeros(len(words) + 1, np.int64)
        for start, length, q in runs:
            gone[start + q] += 1
            gone[start + length] -= 1
        gone = gone.cumsum()
        words = [w for w, g in zip(words, gone.tolist(), strict=False) if not g]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def _table(rows: pa.RecordBatch, drop: set[str], cols: list[pa.Array]) -> pa.RecordBatch:
    kept = [(c, n) for c, n in zip(rows.columns, rows.schema.names, strict=True) if n not in drop]
    return pa.RecordBatch.from_arrays([*(c for c, _ in kept), *cols], names=[*(n for _, n in kept), *_ADDED])


def _columns(each: list[tuple[list[bytes], list[tuple[int, int, int]]]]) -> list[pa.Array]:
    run = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
    as_dict = lambda r: r and dict(zip(("start", "length", "period"), r, strict=True))
    return [
        pa.array([len(w) for w, _ in each], pa.int64()),
        pa.array([[as_dict(r) for r in runs] for _, runs in each], pa.list_(run)),
        pa.array([as_dict(strongest(runs)) for _, runs in each], run),
        pa.array([collapsed(w, runs) for w, runs in each], pa.string()),
    ]


def periodic_runs(docs: DataFrame, *, text_col: str = "text", least: int = LEAST, exponent: int = EXPONENT, comparisons: int = COMPARISONS, lags: int = LAGS) -> DataFrame:
    """The rows of ``docs`` with n_words, runs, strongest and collapsed put last.

    ``runs`` are (start, length, period) of every stretch of words that has a
    smallest period q, is at least ``least`` words and ``exponent`` periods
    long and is not part of a longer one of that period, by start and period;
    ``strongest`` is the one of the greatest length / period (ties: smallest
    start, then period), null without runs. ``collapsed`` holds the words that
    no run repeats, joined by blanks. Words count from 0.

    Null and blank texts have no words, no runs and an empty ``collapsed``.
    Rows that repeat are rows of their own with equal results; no column but
    the text is looked at. An empty table gives no rows. ``comparisons``
    and ``lags`` bound a range of lags, which never changes results. Columns
    of ``docs`` with the names added are replaced; no other name matters.
    """
    kept = [c for c in docs.columns if c not in _ADDED]
    k1_, k2_, r1_, r2_, found_, lo_, hi_, ids_ = free_names(docs, "k1", "k2", "r1", "r2", "found", "lo", "hi", "ids")
    rows = docs.select(*kept).withColumn(text_col, F.col(text_col).cast("string"))
    schema = T.StructType([*rows.schema.fields, *_FOUND])
    text = F.coalesce(F.col(text_col), F.lit(""))
    # white characters and one: no fewer than the words there are. It only tells where a text is scanned
    bound = F.length(text) - F.length(F.translate(text, " \t\n\x0b\x0c\r", "")) + 1
    one_range = F.floor(bound / exponent) <= F.greatest(F.lit(lags), F.floor(F.lit(comparisons) / bound))

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = []
            for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist():
                w = words_of(t)
                each.append((w, runs_of(stretches(numbers(w), 1, len(w) // exponent + 1, least, exponent))))
            yield _table(batch, set(), _columns(each))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = words_of(t)
                ids = numbers(w).astype(np.int32).tobytes()
                for lo, hi in ranges(len(w), exponent, comparisons, lags):
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (k1, k2, lo, hi, ids)], names=[k1_, k2_, lo_, hi_, ids_])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, lo, hi, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = runs_of(stretches(np.frombuffer(ids, np.int32), lo, hi, least, exponent))
                if found:
                    n = len(found)
                    yield pa.RecordBatch.from_arrays([pa.array([k1] * n), pa.array([k2] * n), *(pa.array(x, pa.int64()) for x in zip(*found, strict=True))], names=[k1_, k2_, "start", "length", "period"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (text_col, found_))
            each = [(words_of(t), runs_of([(r["start"], r["length"], r["period"]) for r in found or []])) for t, found in zip(texts, lists, strict=True)]
            yield _table(batch, {k1_, k2_, found_}, _columns(each))

    near = rows.where(one_range).mapInArrow(here, schema)
    # equal texts are scanned once; a text is named by two hashes
    far = rows.where(~one_range).select(*kept, F.xxhash64(text).alias(k1_), F.xxhash64(F.lit(7), text).alias(k2_))
    texts = far.groupBy(k1_, k2_).agg(F.first(text_col).alias(text_col))
    dealt = texts.mapInArrow(deal, f"`{k1_}` bigint, `{k2_}` bigint, `{lo_}` bigint, `{hi_}` bigint, `{ids_}` binary")
    found = dealt.repartition(F.col(k1_), F.col(lo_)).mapInArrow(scan, f"`{k1_}` bigint, `{k2_}` bigint, start bigint, length bigint, period bigint")
    found = found.groupBy(k1_, k2_, "start", "length").agg(F.min("period").alias("period"))
    found = found.groupBy(F.col(k1_).alias(r1_), F.col(k2_).alias(r2_)).agg(F.collect_list(F.struct("start", "length", "period")).alias(found_))
    far = far.join(found, (F.col(k1_) == F.col(r1_)) & (F.col(k2_) == F.col(r2_)), "left").drop(r1_, r2_)
    return near.unionByName(far.mapInArrow(finish, schema))


def planted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents of which those with crc32(id) % 10 = 0 repeat their own words from some place on, as the contract of the query has it.

    The text of those is their new words joined by blanks; others keep theirs.
    A null id leaves the text as it is.
    """
    from .common import words

    h_, w_, g_, a_, p_ = free_names(docs, "h", "w", "g", "a", "p")
    rows = docs.withColumn(h_, F.crc32(F.col(id_col).cast("string")))
    rows = rows.withColumn(w_, F.when(F.col(h_) % 10 == 0, words(F.col(text_col)))).withColumn(g_, F.floor(F.col(h_) / 10))
    n = F.size(w_)
    rows = rows.withColumn(a_, F.when(n > 0, F.col(g_) % n))
    rows = rows.withColumn(p_, 1 + F.floor((n - F.col(a_)) / (3 + F.col(g_) % 8)))
    # the period's words as often as they are needed, and the last of them cut off
    again = F.flatten(F.array_repeat(F.slice(w_, (F.col(a_) + 1).cast("int"), F.col(p_).cast("int")), F.ceil((n - F.col(a_)) / F.col(p_)).cast("int")))
    new = F.array_join(F.concat(F.slice(w_, F.lit(1), F.col(a_).cast("int")), F.slice(again, F.lit(1), (n - F.col(a_)).cast("int"))), " ")
    return rows.withColumn(text_col, F.when(n > 0, new).otherwise(F.col(text_col))).select(*docs.columns)


def digests(found: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The columns of the query from those of :func:`periodic_runs`."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    top = F.col("strongest")
    return found.select(
        F.col(id_col).alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        *[top[c].alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * top["length"] / top["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
