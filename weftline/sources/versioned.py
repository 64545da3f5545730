"""A keyed table in a folder that upserts commit to: data first, then one small file that makes it the current version.

Rows fall into a fixed number of parts by a hash of their key. A commit writes
the parts that it touches anew, beside the old ones, and then puts a version
file in place by a rename that fails if another writer was there first; only
that makes them count. What reads the table reads the parts that the newest
version file names, so a writer that dies earlier leaves it as it was.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dataflow import first_per

#: Names of the table's own columns: the part of a row, and whether its key is deleted.
PART, GONE = "_part", "_gone"


@dataclass
class _Version:
    number: int = -1
    parts: dict[str, str] = field(default_factory=dict)  # part -> folder under data/
    batches: dict[str, int] = field(default_factory=dict)  # writer -> last batch
    schema: str | None = None


class VersionedTable:
    """Upserts by ``key``; of several rows of a key the one highest in ``order`` counts, whenever it came.

    ``parts`` is fixed when the first commit is made. ``before_commit`` is
    called between data and version file, for tests of what a crash leaves.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], order: list[str], *, parts: int = 16, retries: int = 3, wait_s: float = 0.5, before_commit: Callable[[], None] | None = None):
        self.spark, self.path, self.key, self.order, self.parts = spark, path.rstrip("/"), key, order, parts
        self.retries, self.wait_s, self.before_commit = retries, wait_s, before_commit

    # ---- files ----

    def _at(self, *names: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def _fs(self):
        return self._at().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the versions there are, oldest first."""
        fs, at = self._fs(), self._at("versions")
        return sorted(int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(at) if s.getPath().getName().endswith(".json")) if fs.exists(at) else []

    def _load(self, number: int | None = None) -> _Version:
        every = self.versions()
        if not every:
            return _Version()
        number = every[-1] if number is None else number
        text = "\n".join(r.value for r in self.spark.read.text(self._at("versions", f"{number:010d}.json").toString()).collect())
        return _Version(**json.loads(text))

    def _publish(self, v: _Version) -> bool:
        """Puts a version file in place; false where one of its number is there."""
        jvm, fs = self.spark.sparkContext._jvm, self._fs()
        temp, to = self._at("versions", f"_{uuid.uuid4().hex}"), self._at("versions", f"{v.number:010d}.json")
        out = fs.create(temp, False)
        try:
            out.write(bytearray(json.dumps(v.__dict__, sort_keys=True), "utf-8"))
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(temp, to, none)  # does not replace
        except Exception as e:
            fs.delete(temp, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    # ---- reading ----

    def _rows(self, v: _Version, only: list[str] | None = None) -> DataFrame | None:
        folders = [f for p, f in v.parts.items() if only is None or p in only]
        if not folders:
            return None
        return self.spark.read.schema(T.StructType.fromJson(json.loads(v.schema))).parquet(*[self._at("data", f).toString() for f in folders])

    def read(self, version: int | None = None) -> DataFrame:
        """The table's rows, at its newest version or an older one that is still there; deleted keys are left out."""
        v = self._load(version)
        if v.schema is None:
            raise ValueError(f"no version has been committed to {self.path}")
        rows = self._rows(v)
        if rows is None:
            rows = self.spark.createDataFrame([], T.StructType.fromJson(json.loads(v.schema)))
        return rows.where(f"not {GONE}").drop(PART, GONE)

    # ---- writing ----

    def merge(self, batch: DataFrame, *, gone: str | None = None, writer: str = "", number: int | None = None) -> bool:
        """Upserts a batch; false if the writer has committed this batch, or a later one, before.

        ``gone`` names a boolean column of rows whose key is deleted. Deleted
        keys stay as marks, so that an older row which comes late does not
        bring them back. A failed attempt, and one that another writer was
        faster than, is made again on what the table is then; what the last
        one leaves behind is no part of any version.
        """
        for attempt in range(self.retries + 1):
            try:
                if (done := self._merge(batch, gone, writer, number)) is not None:
                    return done
            except Exception:
                if attempt == self.retries:
                    raise
            time.sleep(self.wait_s * (attempt + 1))
        raise RuntimeError(f"other writers were faster than {self.retries + 1} attempts")

    def _merge(self, batch: DataFrame, gone: str | None, writer: str, number: int | None) -> bool | None:
        old = self._load()
        if number is not None and old.batches.get(writer, -1) >= number:
            return False
        flag = F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)
        new = batch.withColumn(GONE, flag).drop(*([gone] if gone else []))
        new = first_per(new, self.key, [F.desc_nulls_last(c) for c in self.order])
        parts = self.parts if not old.parts else int(next(iter(old.parts.values())).split("-of-")[1].split("/")[0])
        part = F.pmod(F.xxhash64(*self.key), F.lit(parts)).cast("int")
        new = new.withColumn(PART, part)
        touched = sorted(str(r[0]) for r in new.select(PART).distinct().collect())  # at most one for each part
        before = self._rows(old, touched)
        if before is not None:
            cols = new.columns
            both = before.select(*cols, F.lit(0).alias("_new")).unionByName(new.withColumn("_new", F.lit(1)))
            # on equal terms the later commit counts
            new = first_per(both, self.key, [*[F.desc_nulls_last(c) for c in self.order], F.desc("_new")]).drop("_new")
        name = f"{uuid.uuid4().hex}-of-{parts}"
        schema = new.schema.jsonValue()
        new.repartition(PART).withColumn("part", F.col(PART)).write.partitionBy("part").parquet(self._at("data", name).toString())
        if self.before_commit:
            self.before_commit()
        v = _Version(old.number + 1, old.parts | {p: f"{name}/part={p}" for p in touched}, dict(old.batches), json.dumps(schema))
        if number is not None:
            v.batches[writer] = number
        return True if self._publish(v) else None

    def sink(self, *, gone: str | None = None, writer: str = "stream") -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: a batch that is run again changes nothing."""
        return lambda batch, number: self.merge(batch, gone=gone, writer=writer, number=number) and None

    def vacuum(self, keep: int = 2) -> None:
        """Lets go of all but the last versions and of data that none of those names. No writer may be at work meanwhile."""
        fs = self._fs()
        every = self.versions()
        for n in every[:-keep]:
            fs.delete(self._at("versions", f"{n:010d}.json"), False)
        used = {f for n in every[-keep:] for f in self._load(n).parts.values()}
        for s in fs.listStatus(self._at("data")):
            name = s.getPath().getName()
            for p in fs.listStatus(s.getPath()):
                if p.isDirectory() and f"{name}/{p.getPath().getName()}" not in used:
                    fs.delete(p.getPath(), True)
            if not any(f.startswith(f"{name}/") for f in used):
                fs.delete(s.getPath(), True)

    def remove(self) -> None:
        self._fs().delete(self._at(), True)
