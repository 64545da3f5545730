"""What the corpus operators share: table loading, durable cuts of lineage, words."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Rows are numbered 0-3 by crc32 of the id as text; this remainder is held out.
HELD_OUT = 2

_written: list = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session; one of our own only in a local session where none is set, as in tests."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: executors of a cluster need a folder that all of them share")
        found = tempfile.mkdtemp(prefix="weftline-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the folder goes with the cluster's clean-up
        pass


def _remove_all() -> None:
    for spark, path in _written:
        _remove(spark, path)


atexit.register(_remove_all)


#: Spark's own setting to delete the shuffle files of an execution when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it again.

    Cuts the lineage durably (an executor can be lost afterwards) and keeps
    the data columnar and compressed. The shuffle files that led to it, which
    nothing reads any more, go with the write; the files themselves when the
    driver ends, or by :func:`drop`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftline/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before) if before is not None else spark.conf.unset(_CLEAN)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._weftline_path = path
    return out


def drop(*dfs: DataFrame | None) -> None:
    """Delete the files of frames that :func:`cut` made, once nothing reads them any more."""
    for df in dfs:
        path = getattr(df, "_weftline_path", None)
        if path:
            _remove(df.sparkSession, path)
            _written[:] = [x for x in _written if x[1] != path]


def words(text):
    """Array of the words of a text column; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP, -1), lambda w: w != "")


def split_words(text):
    """The text cut at white space, with empty strings where it is doubled: at single blanks, which is several times faster, where there is no other kind."""
    other = F.contains(text, F.lit("\t"))
    for c in "\n\r\x0b\x0c":
        other = other | F.contains(text, F.lit(c))
    return F.when(other, F.split(text, GAP, -1)).otherwise(F.split(text, " ", -1))


def held_out(doc_id):
    return (F.crc32(doc_id.cast("string")) % 4) == HELD_OUT


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for an operator's own columns that no column of ``df`` has: each with as many underscores before it as it takes."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
