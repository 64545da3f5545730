"""Mixing sources to target weights: repetition rates per source, whole copies plus one Bernoulli copy.

The Bernoulli copy of a document is drawn where the hash of its id, as a
number from 0 to 1, is below a threshold of its source. By itself that
threshold is the fraction of the source's rate; as independent draws miss a
small source's target by several hundredths, it is then moved to where the
words drawn meet what the target asks for. It is found on sums of sizes over
hash cells, so no rows are sorted or moved, however many a source has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, drop, free_names

WEIGHTS, BUDGET, MOST = (5, 2, 1), 1.5, 2
#: Bits of a document's hash, and of the coarser cells that are summed first.
BITS, COARSE = 24, 12


def _cell(*parts):
    """The first 24 bits of the md5 of the parts, as an int."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, BITS // 4), 16, 10).cast("int")


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources in code-point order, null last, take the weights in turn and share
    ``budget`` times all sizes; a target stops at ``most`` times its source's
    size and the excess is shared again by weight. Filling up by cap per
    weight, ascending, gives the fixed point of that in one pass. The window
    holds one row for each source, pre-aggregated.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (turn % len(weights) + 1).cast("int")))
    by = by.withColumns({"cap": most * F.col("source_size"), "total": F.sum("source_size").over(Window.partitionBy())})
    # the source whose cap per weight is least fills up first
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    done, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    by = by.withColumn("level", (F.lit(budget) * F.col("total") - F.coalesce(F.sum("cap").over(done), F.lit(0)).cast("double")) / F.sum("weight").over(rest).cast("double"))
    fits = F.col("level") <= F.col("cap") / F.col("weight")
    by = by.withColumn("fill", F.min(F.when(fits, F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(Window.partitionBy()))
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.col("fill.level"))
    return by.select("source", "source_size", F.coalesce(target, F.col("cap").cast("double")).alias("target"))


def _thresholds(cells: DataFrame, by: DataFrame) -> DataFrame:
    """Per source of ``by`` the last cell that is drawn, -1 for none; from rows (source, size, cell).

    A cell of a source is drawn if the words of the cells before it and half
    its own are no more than the source needs beyond its whole copies. Coarse
    cells show in which of them that ends; only its fine cells are summed then.
    """
    source = lambda df: df.withColumn("source", F.struct("source"))  # noqa: E731  joins do not meet on nulls, but on structs that hold them
    by, cells = source(by.where("need > 0").select("source", "need")), source(cells)

    def running(sums: DataFrame):
        w = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        return sums.withColumn("upto", F.sum("size").over(w))

    coarse = running(cells.groupBy("source", F.shiftright("cell", BITS - COARSE).alias("cell")).agg(F.sum("size").alias("size"))).join(by, "source")
    # the first coarse cell that goes beyond; where none does, everything is drawn
    edge = coarse.groupBy("source", "need").agg(F.min(F.when(F.col("upto") > F.col("need"), F.struct("cell", (F.col("upto") - F.col("size")).alias("before")))).alias("edge"))
    edge = edge.select("source", "need", F.col("edge.cell").alias("edge"), F.col("edge.before").alias("before"))
    fine = cells.join(edge, "source").where(F.shiftright("cell", BITS - COARSE) == F.col("edge")).groupBy("source", "cell").agg(F.sum("size").alias("size"))
    fine = running(fine).join(edge, "source").where(F.col("before") + F.col("upto") - F.col("size") / 2 <= F.col("need")).groupBy("source").agg(F.max("cell").alias("last"))
    first = F.shiftleft("edge", BITS - COARSE) - 1
    return edge.join(fine, "source", "left").select(F.col("source.source").alias("source"), F.coalesce("last", first, F.lit((1 << BITS) - 1)).alias("last"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **shares) -> DataFrame:
    """The rows of ``docs`` with ``_size``, ``_source_size``, ``_target`` and ``_copies``.

    A document of a source with rate = target / source_size gets floor(rate)
    copies and, by a hash of its id, one more with the probability of the
    fraction (see above), so a source meets its target up to about half a
    document, and reruns agree whatever the order of rows.

    A null or blank text has size 0 and takes nothing. A null source is a
    source. A source of size 0 has rate 0. Rows that repeat an id have one
    draw. Columns of ``docs`` that have the names added here are replaced, no
    other name matters; an empty table gives no rows. One small row for each
    source meets in one task, which ranks them and fills them up.
    """
    own = [c for c in docs.columns if c not in ("_size", "_source_size", "_target", "_copies")]
    cell_, key_, info_ = free_names(docs, "cell", "key", "info")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    cell = _cell(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    cells = cut(docs.select(F.col(source_col).alias("source"), size.alias("size"), cell.alias("cell")))
    by = source_targets(cells, **shares)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    by = cut(by.withColumn("whole", F.floor(rate)).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")))
    by = cut(by.join(_thresholds(cells, by).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))
    drop(cells)
    by = by.select(F.struct("source").alias(key_), F.struct("source_size", "target", "whole", F.coalesce("last", F.lit(-1)).alias("last")).alias(info_))
    out = docs.select(*own, size.alias("_size"), cell.alias(cell_)).join(by, F.struct(F.col(source_col).alias("source")) == F.col(key_))
    copies = F.col(f"{info_}.whole") + F.when(F.col(cell_) <= F.col(f"{info_}.last"), 1).otherwise(0)
    return out.select(*own, "_size", F.col(f"{info_}.source_size").alias("_source_size"), F.col(f"{info_}.target").alias("_target"), copies.cast("long").alias("_copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """The documents themselves, as often as :func:`mix` has them."""
    own = [c for c in mixed.columns if c not in ("_size", "_source_size", "_target", "_copies")]
    (copy_,) = free_names(mixed, "copy")
    return mixed.where("_copies > 0").withColumn(copy_, F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*own)


#: DuckDB's form of :func:`mix` over ``documents``; {size} stands for the size of a text.
SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1] AS weight,
    2 * source_size AS cap, (sum(source_size) OVER ())::BIGINT AS total FROM by_source),
levels AS (
  SELECT *, (1.5::DOUBLE * total - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM weighed),
filled AS (SELECT arg_min(level, cap::DOUBLE / weight) AS level FROM levels WHERE level <= cap::DOUBLE / weight),
targets AS (
  SELECT l.source, l.source_size, coalesce(least(l.cap::DOUBLE, l.weight * f.level), l.cap::DOUBLE) AS target FROM levels l, filled f),
rated AS (
  SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS whole FROM targets),
celled AS (
  SELECT s.doc_id, s.size, s.source, r.source_size, r.target, r.whole, r.target - r.whole * r.source_size AS need,
    ('0x' || left(md5(concat_ws('|', 'mix', coalesce(s.doc_id::VARCHAR, 'null'))), 6))::BIGINT AS cell
  FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source),
cells AS (SELECT source, cell, sum(size)::BIGINT AS size FROM celled GROUP BY source, cell),
run AS (SELECT source, cell, (sum(size) OVER (PARTITION BY source ORDER BY cell))::DOUBLE - size / 2 AS mid FROM cells)
SELECT c.doc_id, c.size, c.source_size, c.target, (c.size * (c.whole + CASE WHEN c.need > 0 AND r.mid <= c.need THEN 1 ELSE 0 END))::BIGINT AS taken
FROM celled c JOIN run r ON c.cell = r.cell AND c.source IS NOT DISTINCT FROM r.source
"""
