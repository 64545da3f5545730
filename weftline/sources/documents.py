"""A folder of JSON documents as a data source: one file for each document, files of errors, and a summary.

    spark.dataSource.register(DocumentSource)
    spark.read.format("documents").option("path", folder).option("keys", "title,text").load()
    df.write.format("documents").option("path", folder).mode("append").save()

Paths are those that pyarrow's file systems know (local paths, file:, hdfs:, s3:, gs:).
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: What a row of a document is: its file's name without the ending, its JSON, and why there is none.
DOCUMENT = "name string, body string, error string"
ENDING, ERROR_ENDING, SUMMARY = ".json", ".error.json", "_summary.json"
#: Bytes of files that one task reads, about; a file counts for some at least.
_TASK_BYTES, _FILE_BYTES = 32 << 20, 64 << 10


def _open(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]
    #: A folder that the task itself lists, with all below it, instead of paths.
    folder: str | None = None


class _Reader(DataSourceReader):
    def __init__(self, path: str, keys: list[str], errors: bool):
        self.path, self.keys, self.errors = path, keys, errors

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, root = _open(self.path)
        info = files.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(root))
        wanted = self._wanted(found)
        out, now, total = [Files((), f) for f in sorted(f.path for f in found if f.type == fs.FileType.Directory)], [], 0
        for p, size in wanted:
            now.append(p)
            total += max(size, _FILE_BYTES)
            if total >= _TASK_BYTES:
                out.append(Files(tuple(now)))
                now, total = [], 0
        return [*out, Files(tuple(now))] if now or not out else out

    def _wanted(self, found: list) -> list[tuple[str, int]]:
        from pyarrow import fs

        return sorted((f.path, f.size or 0) for f in found if f.type == fs.FileType.File and f.path.endswith(ENDING) and not f.path.rsplit("/", 1)[-1].startswith(("_", ".")) and f.path.endswith(ERROR_ENDING) == self.errors)

    def read(self, partition: Files) -> Iterator[tuple]:
        from pyarrow import fs

        files, _ = _open(self.path)
        ending = ERROR_ENDING if self.errors else ENDING
        paths = partition.paths
        if partition.folder is not None:
            paths = [p for p, _ in self._wanted(files.get_file_info(fs.FileSelector(partition.folder, recursive=True)))]
        for p in paths:
            name = p.rsplit("/", 1)[-1].removesuffix(ending)
            try:
                with files.open_input_stream(p) as f:
                    raw = f.read().decode("utf-8-sig")
                doc = json.loads(raw)
                if self.errors:
                    yield name, None, doc["error"]
                    continue
                if self.keys:
                    if not isinstance(doc, dict):
                        raise TypeError("not an object")
                    raw = json.dumps({k: doc[k] for k in self.keys if k in doc}, ensure_ascii=False)
                yield name, raw, None
            except (OSError, ValueError, TypeError, KeyError) as e:
                yield name, None, f"{type(e).__name__}: {e}"


@dataclass
class Written(WriterCommitMessage):
    ok: int
    failed: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool, folders: int = 0):
        self.path, self.run, self.folders = path, uuid.uuid4().hex, folders
        if overwrite:
            files, root = _open(path)
            from pyarrow import fs

            if files.get_file_info(root).type == fs.FileType.Directory:
                files.delete_dir_contents(root)

    def _put(self, files, to: str, text: str) -> None:
        """A file is whole or not there: it is written beside its place and moved."""
        temp = f"{to.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}"
        with files.open_output_stream(temp) as f:
            f.write(text.encode("utf-8", "surrogatepass"))
        files.move(temp, to)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        ok = failed = 0
        made = set()
        for name, body, error in rows:
            if not name or "/" in name or name.startswith(("_", ".")):
                raise ValueError(f"not a file's name: {name!r}")
            if error is None and body is None:
                error = "no document"
            to = root
            if self.folders:
                to = f"{root}/{zlib.crc32(name.encode('utf-8', 'surrogatepass')) % self.folders:04d}"
                if to not in made:
                    files.create_dir(to, recursive=True)
                    made.add(to)
            if error is None:
                self._put(files, f"{to}/{name}{ENDING}", body)
                ok += 1
            else:
                self._put(files, f"{to}/{name}{ERROR_ENDING}", json.dumps({"name": name, "error": error}, ensure_ascii=False))
                failed += 1
        return Written(ok, failed)

    def commit(self, messages: list) -> None:
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        ok, failed = sum(m.ok for m in messages if m), sum(m.failed for m in messages if m)
        self._put(files, f"{root}/{SUMMARY}", json.dumps({"run": self.run, "total": ok + failed, "ok": ok, "failed": failed}))

    def abort(self, messages: list) -> None:
        """Files of a failed run stay: each is whole, and a run that is made again replaces them. There is no summary."""


class DocumentSource(DataSource):
    """Reads (name, body, error) from a folder of JSON files, and writes such rows as one.

    Options: ``path``; ``keys``, names joined by commas, only which the body
    keeps; ``errors`` ("true": the files of errors instead). A file that
    cannot be read or is no JSON gives a row with the error, and no others are
    lost for it. Rows with an error, or without a body, are written as files
    of errors. Names must be unique: of rows of one name the last one written stays.
    ``folders``: files are written to so many folders under the path, each to
    the one that its name's hash tells, so that tasks do not wait for one
    another at a single folder, and a task can list each. What is written
    again has to be so with the same number.
    """

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return DOCUMENT

    def reader(self, schema: StructType) -> DataSourceReader:
        keys = [k.strip() for k in self.options.get("keys", "").split(",") if k.strip()]
        return _Reader(self.options["path"], keys, self.options.get("errors", "false").lower() == "true")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if [f.name for f in schema.fields] != ["name", "body", "error"]:
            raise ValueError(f"rows to write are ({DOCUMENT})")
        return _Writer(self.options["path"], overwrite, int(self.options.get("folders", "0")))


def read_documents(spark: SparkSession, path: str, keys: list[str] | None = None, *, errors: bool = False):
    """(name, body, error) of the JSON files under a path."""
    spark.dataSource.register(DocumentSource)
    return spark.read.format("documents").option("path", path).option("keys", ",".join(keys or [])).option("errors", str(errors).lower()).load()


def _listing(recursive: bool, local: bool):
    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for folder in batch.column(0).to_pylist():
                files, root = _open(folder)
                found = files.get_file_info(fs.FileSelector(root, recursive=recursive))
                for at in range(0, len(found), 10_000):
                    some = found[at : at + 10_000]
                    # paths of other systems come without their scheme, which the folder has
                    head = "" if local else folder[: folder.index(root)] if root in folder else ""
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([head + f.path for f in some], pa.string()), pa.array([f.size for f in some], pa.int64()), pa.array([f.mtime for f in some], pa.timestamp("us", "UTC")), pa.array([f.type == fs.FileType.Directory for f in some], pa.bool_())],
                        names=["path", "size", "mtime", "folder"],
                    )

    return run


def list_documents(spark: SparkSession, path: str):
    """(path, size, mtime) of all files under a path, listed by tasks: the folder itself by one, each folder in it by another."""
    kind = "path string, size long, mtime timestamp, folder boolean"
    local = "://" not in path or path.startswith("file:")
    top = spark.createDataFrame([(path,)], "path string").mapInArrow(_listing(False, local), kind)
    below = top.where("folder").select("path").repartition(4 * spark.sparkContext.defaultParallelism, "path").mapInArrow(_listing(True, local), kind)
    return top.unionByName(below).where("not folder").drop("folder")


def write_documents(df, path: str, *, mode: str = "append", folders: int = 0) -> dict:
    """Writes (name, body, error) rows as files; returns the summary."""
    df.sparkSession.dataSource.register(DocumentSource)
    df.select("name", "body", "error").write.format("documents").option("path", path).option("folders", str(folders)).mode(mode).save()
    files, root = _open(path)
    with files.open_input_stream(f"{root}/{SUMMARY}") as f:
        return json.loads(f.read())
