"""File trees as tables: listings, texts with fallback decoding, JSON harvests, and sinks."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import natural_key
from ..functions.text import decode_fallback

AUDIO = (".mp3", ".wav", ".m4a", ".flac", ".ogg", ".aac", ".wma")
TEXT = (".txt", ".srt", ".vtt")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session; a temporary one only in a local session where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: executors of a cluster need a folder that all of them share")
        found = tempfile.mkdtemp(prefix="weftline-")
    return found.rstrip("/")


_made: list = []


def scratch(spark: SparkSession, kind: str) -> str:
    """A folder of one's own in the shared one, which goes when the driver ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@atexit.register
def _remove_all() -> None:
    for spark, path in _made:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended; the folder goes with the cluster's clean-up
            pass


def list_files(spark: SparkSession, *roots: str, content: bool = False) -> DataFrame:
    """Files under the roots (rank, path, dir, file_name, stem, ext, size, mtime), without their content unless asked for."""
    out = None
    for rank, root in enumerate(roots):
        f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        f = f.select(F.lit(rank).alias("rank"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), *(["content"] if content else []))
        out = f if out is None else out.unionByName(f)
    return with_names(out)


def with_names(out: DataFrame) -> DataFrame:
    """Listed files with what their paths tell: dir, file_name, stem, ext."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    out = out.withColumns({"dir": F.regexp_extract("path", "^(.*)/[^/]*$", 1), "file_name": name})
    return out.withColumns({"stem": F.regexp_replace("file_name", r"\.[^.]*$", ""), "ext": F.lower(F.regexp_extract("file_name", r"(\.[^.]*)$", 1))})


def scan_media(spark: SparkSession, *roots: str, extensions: tuple[str, ...] = AUDIO) -> DataFrame:
    """Media files of all roots, duplicates kept, with a natural-order key to sort by."""
    f = list_files(spark, *roots).where(F.col("ext").isin(*extensions))
    return f.withColumn("natural", natural_key(F.col("file_name")))


def scan_texts(spark: SparkSession, *roots: str) -> DataFrame:
    """Text files by name, a later root's in place of an earlier one's; snapshots are left out; decoded by :func:`decode_fallback`."""
    from ..operators.dataflow import first_per

    f = list_files(spark, *roots, content=True).where(F.col("ext").isin(*TEXT) & ~F.lower("stem").endswith("_snapshot"))
    f = first_per(f, ["file_name"], [F.desc("rank"), F.desc("path")])
    return f.withColumn("text", decode_fallback(F.col("content"))).drop("content")


def _harvest(node: object, field: str, out: list[str]) -> None:
    todo = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            if isinstance(x.get(field), str):
                out.append(x[field])
            todo += [v for k, v in reversed(x.items()) if k != field or not isinstance(v, str)]
        elif isinstance(x, list):
            todo += reversed(x)


def deep_field(body, field: str):
    """All strings under a field at any depth of a JSON text, in document order; null for text that is no JSON."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(col: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[str] | None:
            try:
                doc = json.loads(text or "")
            except ValueError:
                return None
            out: list[str] = []
            _harvest(doc, field, out)
            return out

        return col.map(one)

    return run(body)


def harvest(df: DataFrame, key: str, body: str, field: str) -> DataFrame:
    """(key, pos, value): every string under a field at any depth of a JSON column, without Python; as :func:`deep_field`, in its order.

    A recursion goes down the bodies level by level: each entry of an object
    or array comes as raw JSON, which keeps the order, and as a variant, which
    tells its kind. Values sort by the places of all entries above them; an
    object's own field goes before its other entries. ``key`` must be unique
    and not null. Bodies that are null or no JSON have no values.
    """
    src = df.select(F.col(key).alias("key"), F.col(body).alias("raw"))
    found = df.sparkSession.sql(
        """
        WITH RECURSIVE r MAX RECURSION LEVEL 10000 AS (
          SELECT key, array(CAST(0 AS INT)) AS at, raw, left(schema_of_variant(try_parse_json(raw)), 5) AS kind, CAST(NULL AS STRING) AS name FROM {src}
          UNION ALL
          SELECT key, concat(at, array(CASE WHEN e.`0` = {field} AND sort = 'STRIN' THEN -1 ELSE pos END)), e.`1`, sort, e.`0` FROM (
            SELECT key, at, pos, e, left(schema_of_variant(e.`2`), 5) AS sort FROM (
              SELECT key, at, posexplode(CASE kind
                WHEN 'OBJEC' THEN arrays_zip(map_keys(from_json(raw, 'map<string,string>')), map_values(from_json(raw, 'map<string,string>')), map_values(from_json(raw, 'map<string,variant>')))
                ELSE arrays_zip(array_repeat(CAST(NULL AS STRING), size(from_json(raw, 'array<string>'))), from_json(raw, 'array<string>'), from_json(raw, 'array<variant>')) END) AS (pos, e)
              FROM r WHERE kind IN ('OBJEC', 'ARRAY'))) WHERE sort IN ('OBJEC', 'ARRAY', 'STRIN'))
        SELECT key, at, raw AS value FROM r WHERE kind = 'STRIN' AND name = {field} LIMIT ALL
        """,
        src=src,
        field=field,
    )
    all_ = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("a"))
    return all_.select(F.col("key").alias(key), F.posexplode("a").alias("pos", "x")).select(key, F.col("pos").cast("bigint").alias("pos"), F.col("x.value").alias("value"))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("url", T.StringType()), T.StructField("label", T.StringType())])))
def tasks_from_text(col: pd.Series) -> pd.Series:
    """Tasks of a JSON array, plain or in base64: strings are URLs, objects have url and label; entries without a URL are dropped. Base64 may be broken into lines."""
    import base64

    def one(text: str | None) -> list[dict] | None:
        text = (text or "").strip()
        if text and text[0] not in "[{":
            try:
                text = base64.b64decode("".join(text.split()), validate=True).decode()
            except ValueError:
                return None
        try:
            items = json.loads(text or "[]")
        except ValueError:
            return None
        pairs = [(x, "") if isinstance(x, str) else (x.get("url"), x.get("label") or "") for x in (items if isinstance(items, list) else [items]) if isinstance(x, (str, dict))]
        return [{"url": str(u).strip(), "label": str(v)} for u, v in pairs if u and str(u).strip()]

    return col.map(one)


def write_with_progress(df: DataFrame, meta: DataFrame, path: str) -> str:
    """Replaces the rows at ``path``, then the meta rows in ``<path>Progress``, without running totals; returns the latter's path.

    Meta is written last, so what it tells of has been committed.
    """
    write_idempotent(df, path)
    side = f"{path.rstrip('/')}Progress"
    meta.drop("processed_audio_totals").coalesce(1).write.mode("overwrite").json(side)
    return side


def write_idempotent(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Replaces what a path holds (only the partitions that the rows have, if partitioned); the job's commit is atomic."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*by) if by else w).parquet(path)
