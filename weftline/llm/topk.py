"""Exact top-k inner-product search by MaxScore.

A query's terms are its dimensions. Every component is shifted so that each
term adds between 0 and a bound: q * (x - lowest) for a positive weight,
|q| * (highest - x) for a negative one. The terms of a query are put in the
order of their bounds; the smallest whose bounds together cannot lift a row
over the k-th score so far are *non-essential*: the postings of the others
are traversed for all rows of a block, and only rows that stay competitive
are probed in the rest. Each shard of rows keeps its best k per query, and
these are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Queries of one pass over the rows; what is sent to every worker is bounded by it.
QUERY_BLOCK = 4_096
_ROWS = 8_192
#: Sums below this are exact as doubles, below 2^64 as long doubles of 64 bits; a score has to fit a long.
_DOUBLE, _LONG = 2.0**52, 2.0**63
_EMPTY = np.iinfo(np.int64).max


class MaxScore:
    """Best k of one shard's rows for each query of a block."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.whole, self.k = ids, q, k
        self.score = np.full((len(ids), k), -_EMPTY, np.int64)  # its negative sorts last
        self.row = np.full((len(ids), k), _EMPTY, np.int64)
        self.filled = np.zeros(len(ids), np.int64)
        self.probed = self.seen = 0

    def _exact(self, x: np.ndarray) -> type:
        """The kind of number in which every sum here is a whole one."""
        if not len(self.ids) or not x.shape[1]:
            return np.float64
        if np.finfo(np.longdouble).nmant < 63:  # no such kind on this machine
            wide = _DOUBLE
        else:
            wide = _LONG
        most = float((np.abs(self.whole.astype(np.float64)) @ np.maximum(np.abs(x.min(axis=0).astype(np.float64)), np.abs(x.max(axis=0).astype(np.float64)))).max())
        if most < _DOUBLE / 2:
            return np.float64
        if most >= wide * (1 - 2.0**-40):
            raise ValueError(f"scores up to {most:.3g} cannot be told exactly: scale the components down")
        return np.longdouble

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        kind = self._exact(x)
        x, whole = x.astype(kind), self.whole.astype(kind)
        low, high = x.min(axis=0), x.max(axis=0)
        xt = np.ascontiguousarray(x.T)
        bound = np.abs(whole) * (high - low)
        base = np.where(whole >= 0, whole * low, whole * high).sum(axis=1)  # the score of a row at every term's foot
        order = np.argsort(bound, axis=1, kind="stable")
        ahead = np.cumsum(np.take_along_axis(bound, order, axis=1), axis=1)
        for j in range(len(self.ids)):
            q, worst = whole[j], kind(self.score[j, -1])
            # terms whose bounds together do not reach the k-th score are non-essential
            n = int(np.searchsorted(base[j] + ahead[j], worst, side="left")) if self.filled[j] >= self.k else 0
            rest, essential = order[j, :n], order[j, n:]
            part = q[essential] @ xt[essential] if len(essential) else np.zeros(len(ids))
            if n:
                foot = np.where(q[rest] >= 0, q[rest] * low[rest], q[rest] * high[rest]).sum()
                at = np.flatnonzero(part + foot + ahead[j, n - 1] >= worst)
                # probe term by term, largest bound first, while competitive
                got = part[at]
                for i in range(n - 1, -1, -1):
                    d = order[j, i]
                    got = got + q[d] * xt[d, at]
                    if i:
                        foot -= q[d] * (low[d] if q[d] >= 0 else high[d])
                        good = got + foot + ahead[j, i - 1] >= worst
                        if not good.all():
                            at, got = at[good], got[good]
                    if not len(at):
                        break
                self.probed += len(at)
            else:
                at, got = np.arange(len(ids)), part
            self.seen += len(ids)
            if not len(at):
                continue
            s = got.astype(np.int64)
            if len(s) > 8 * self.k:
                least = np.partition(s, -self.k - 1)[-self.k - 1]  # one more, which may be the query itself
                good = s >= least
                s, at = s[good], at[good]
            r = ids[at]
            own = r != self.ids[j]
            s, r = np.concatenate([self.score[j], s[own]]), np.concatenate([self.row[j], r[own]])
            best = np.lexsort((r, -s))[: self.k]
            self.score[j], self.row[j] = s[best], r[best]
            self.filled[j] += np.count_nonzero(own)


def exact_top_k(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256, query_every: int = 50, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` rows of the highest integer inner products.

    Components become floor(scale * x). Queries are the rows whose id is
    divisible by ``query_every``; a query's own row is no candidate; ties go
    to the smaller id. Null vectors and vectors with a null or non-finite
    component take no part, nor do rows without an id; vectors of different
    lengths are as if padded with zeros. Rows that repeat an id are
    candidates each; as queries they are one if they are equal (else each
    gets results under the id). An empty table, or one without queries, gives no rows.

    Queries go out in blocks of ``query_block``, one pass over the rows for
    each, so memory does not grow with the table. Partial results per shard
    are at most k for each query, cut by rank before they meet.
    """
    ok = F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(ok)
    rows = rows.select("id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))
    queries = rows.where(F.col("id") % query_every == 0).distinct()
    blocks = cut(queries.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(max(1, -(-queries.count() // (query_block * 3 // 4)))))))
    out = None
    for (b,) in sorted(tuple(r) for r in blocks.select("block").distinct().collect()):
        part = sorted((r.id, r.v) for r in blocks.where(F.col("block") == b).collect())
        wide = max((len(v) for _, v in part), default=0)
        ids = np.array([i for i, _ in part], np.int64)
        q = np.array([v + [0] * (wide - len(v)) for _, v in part], np.int64).reshape(len(part), wide)
        sent = vectors.sparkSession.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, wide=wide) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            shard = MaxScore(ids, q, k)
            for batch in batches:
                for at in range(0, len(batch), _ROWS):
                    piece = batch.slice(at, _ROWS)
                    v = piece.column(1)
                    n = np.diff(np.asarray(v.offsets))
                    flat = np.asarray(v.flatten())
                    if len(n) and (n == wide).all():
                        x = flat.reshape(len(n), wide)
                    else:
                        x = np.zeros((len(n), wide), np.int64)
                        ends = np.cumsum(n)
                        for i, (a, e) in enumerate(zip(ends - n, ends, strict=True)):
                            x[i, : min(wide, e - a)] = flat[a:e][:wide]
                    if len(x):
                        shard.add(np.asarray(piece.column(0)), x)
            got = np.arange(k) < shard.filled[:, None]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)[got.ravel()]), pa.array(shard.row[got]), pa.array(shard.score[got])], names=["query_id", "vec_id", "score"])

        found = rows.mapInArrow(run, "query_id long, vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id")))
        top = cut(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
        sent.unpersist()
        out = top if out is None else out.unionByName(top)
    if out is None:
        return rows.where("false").select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score"))
    return out


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
