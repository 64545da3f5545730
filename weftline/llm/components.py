"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

#: Joins use the key under this mask, so that a hot node's rows get an exchange
#: of their own, which adaptive execution can split.
_MASK = 0x5DEECE66D


def _with_min(edges: DataFrame, least: DataFrame) -> DataFrame:
    m = least.select(F.col("u").bitwiseXOR(F.lit(_MASK)).alias("_k"), "m")
    return edges.withColumn("_k", F.col("u").bitwiseXOR(F.lit(_MASK))).join(m, "_k").drop("_k")


#: Up to so many different edges (16 bytes each) one task merges them at once, which spares dozens of small jobs.
ONE_TASK = 500_000


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all edges of one task; the root is the smallest node."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (y := up.setdefault(top, top)) != top:
            top = y
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "component"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """Rows ``(node, component)`` for every node of an edge; the component is its smallest node.

    Edges with a null end and loops say nothing and are left out; repeated
    edges count once. More than ``one_task`` edges go by rounds: each step only aggregates minima per node (combined
    before the shuffle) and joins them back; nothing is gathered per node.
    The number of rounds grows with the logarithm of the longest path.
    """
    now = cut(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v").distinct())
    if now.count() <= one_task:
        return now.coalesce(1).mapInArrow(_merge, "node long, component long")
    before = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _with_min(both, m).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = _with_min(large, m).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut(rest.unionByName(m.select("u", F.col("m").alias("v"))).distinct())
        drop(now)
        now = new
        after = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    centres = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres.select("node", F.col("node").alias("component")))
