"""Shards by extendible hashing: a directory indexed by hash-prefix bits, oversized buckets split on another bit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_names

#: Bits of the hash. Deeper buckets hold rows of one key only, and no bit splits those.
BITS = 60
#: Bits that one pass over the rows looks at.
STEP = 12


def key_hash(key):
    """60 bits of a key's md5, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def directory(cells: DataFrame, limit: int, bits: int = BITS, step: int = STEP) -> DataFrame:
    """Leaves (depth, prefix, bytes, n_rows) of the trie over rows of (h, bytes, n_rows).

    A bucket is a leaf at the first depth where it fits; all buckets above it
    are oversized. Each pass sums the rows that are still in oversized
    buckets by ``step`` more bits, once, and derives the sums of the depths
    between from those, so passes number log2(buckets) / step, and what is
    not pre-aggregated is never shuffled.
    """
    leaves, depth, todo = None, 0, cells
    while True:
        upto = min(bits, depth + step)
        fine = cut(todo.groupBy(F.shiftright("h", bits - upto).alias("p")).agg(F.sum("bytes").alias("bytes"), F.sum("n_rows").alias("n_rows")))
        # an oversized bucket at `depth` is known to be so; at the very start the root may fit
        levels = F.sequence(F.lit(depth if depth == 0 else depth + 1), F.lit(upto))
        every = fine.withColumn("depth", F.explode(levels)).groupBy("depth", F.expr(f"shiftright(p, {upto} - depth)").alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("n_rows").alias("n_rows"))
        fits = every.withColumn("fits", (F.col("bytes") <= limit) | (F.col("depth") == bits))
        # of the depths where a cell fits, the first; the buckets under it are no leaves
        firsts = fine.withColumn("depth", F.explode(levels)).withColumn("prefix", F.expr(f"shiftright(p, {upto} - depth)")).join(fits, ["depth", "prefix"]).groupBy("p").agg(F.min(F.when(F.col("fits"), F.col("depth"))).alias("depth"))
        firsts = cut(firsts)
        new = firsts.where("depth is not null").select("depth", F.expr(f"shiftright(p, {upto} - depth)").alias("prefix")).distinct().join(every, ["depth", "prefix"])
        leaves = new if leaves is None else leaves.unionByName(new)
        open_ = firsts.where("depth is null").select("p")
        if upto == bits or not open_.take(1):
            return leaves
        todo = todo.withColumn("_p", F.shiftright("h", bits - upto)).join(open_.withColumnRenamed("p", "_p"), "_p", "left_semi").drop("_p")
        depth = upto


def assign_shards(docs: DataFrame, *, limit: int, key_col: str = "doc_id", text_col: str = "text", bits: int = BITS, step: int = STEP) -> DataFrame:
    """The rows of ``docs`` with ``n_bytes``, ``depth``, ``shard`` (the prefix bits; empty for a single shard), ``part`` and ``shard_bytes``.

    Every shard's texts sum to at most ``limit`` UTF-8 bytes, but a single
    longer row, which is a shard by itself. Rows that share a key cannot be
    told apart by bits of its hash: a bucket of one key that is still too
    large is packed in parts by running size, in blocks of rows, so that a
    key with a third of all rows makes many parts in many tasks. Null keys
    are one key; null and empty texts count 0 bytes. An empty table gives no
    rows. Columns of ``docs`` with the names added are replaced; no other name
    matters. ``part`` follows the order in which files are read: over other
    files of the same rows, rows of such a bucket may be packed otherwise.
    """
    added = ("n_bytes", "depth", "shard", "part", "shard_bytes")
    own = [c for c in docs.columns if c not in added]
    h_, row_, low_, leaf_, leaves_, block_, size_ = free_names(docs.drop(*added), "h", "row", "low", "leaf", "leaves", "block", "size")
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    rows = docs.select(*own, size.alias(size_), key_hash(F.col(key_col)).alias(h_), F.monotonically_increasing_id().alias(row_))
    cells = rows.select(F.col(h_).alias("h"), F.col(size_).alias("bytes"), F.lit(1).cast("long").alias("n_rows"))
    leaves = cut(directory(cells, limit, bits, step).withColumnRenamed("bytes", "shard_bytes"))
    # the directory: 2^low entries, fewer than two for each leaf; a leaf above that depth has several
    # entries, the few under it share one
    low = min(bits, max(0, leaves.count() - 1).bit_length())
    span = F.expr(f"if(depth >= {low}, array(shiftright(prefix, greatest(0, depth - {low}))), sequence(shiftleft(prefix, {low} - depth), shiftleft(prefix + 1, {low} - depth) - 1))")
    entries = leaves.select(F.explode(span).alias(low_), F.struct("prefix", "depth", "shard_bytes", "n_rows").alias("leaf")).groupBy(low_).agg(F.collect_list("leaf").alias(leaves_))
    of_row = F.get(F.filter(leaves_, lambda x: F.call_function("shiftright", F.col(h_), F.lit(bits) - x.depth) == x.prefix), 0)
    found = rows.withColumn(low_, F.shiftright(h_, bits - low)).join(entries, low_).select(*own, size_, row_, of_row.alias(leaf_))
    depth, prefix = F.col(f"{leaf_}.depth"), F.col(f"{leaf_}.prefix")
    bits_of = F.when(depth == 0, "").otherwise(F.lpad(F.bin(prefix), depth, F.lit("0")))
    out = found.select(*own, F.col(size_).alias("n_bytes"), depth.alias("depth"), bits_of.alias("shard"), F.col(f"{leaf_}.shard_bytes").alias("shard_bytes"), row_)
    fit = out.where(F.col("shard_bytes") <= limit).withColumn("part", F.lit(0).cast("long"))
    over = out.where(F.col("shard_bytes") > limit)
    # parts of a bucket that no bit splits: rows dealt to blocks of about 8 limits, each packed by running size
    blocks = F.greatest(F.lit(1), F.ceil(F.col("shard_bytes") / F.lit(8.0 * limit)))
    over = over.withColumn(block_, F.pmod(F.xxhash64(row_), blocks))
    order = Window.partitionBy("shard", block_).orderBy(F.col("n_bytes").desc(), row_)
    w = order.rowsBetween(Window.unboundedPreceding, 0)
    # a row opens a part when its end passes another half limit: two halves fit a limit unless one row is longer than half
    big = F.col("n_bytes") * 2 > limit
    slot = F.when(big, -F.row_number().over(order)).otherwise(F.floor(F.sum(F.when(big, 0).otherwise(F.col("n_bytes"))).over(w) * 2 / limit))
    over = over.withColumn("part", (F.col(block_) * 1_000_000_000 + slot).cast("long")).drop(block_)
    own_bytes = F.sum("n_bytes").over(Window.partitionBy("shard", "part"))
    over = over.withColumn("shard_bytes", own_bytes)
    return fit.select(*own, "n_bytes", "depth", "shard", "part", "shard_bytes").unionByName(over.select(*own, "n_bytes", "depth", "shard", "part", "shard_bytes"))


#: DuckDB's form of :func:`assign_shards` for unique keys whose rows fit a shard of {limit} bytes.
SQL = """
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
    ('0x' || left(md5(coalesce(doc_id::VARCHAR, 'null')), 15))::BIGINT AS h FROM documents),
levels AS (SELECT d.*, t.depth::INTEGER AS depth, h >> (60 - t.depth) AS prefix FROM d, (SELECT unnest(range(0, 41)) AS depth) t),
sums AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes FROM levels GROUP BY depth, prefix),
leaf AS (
  SELECT l.*, s.shard_bytes, row_number() OVER (PARTITION BY l.doc_id ORDER BY l.depth) AS k
  FROM levels l JOIN sums s USING (depth, prefix) WHERE s.shard_bytes <= {limit})
SELECT doc_id, n_bytes, depth, CASE WHEN depth = 0 THEN '' ELSE lpad(to_base(prefix, 2), depth, '0') END AS shard, 0::BIGINT AS part, shard_bytes
FROM leaf WHERE k = 1
"""
