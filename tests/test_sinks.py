"""The versioned table and the document source: crashes, repeated batches, deletions, broken files."""

import json
import os

import pytest
from pyspark.sql import functions as F
from weftline.sources.documents import DocumentSource, list_documents, read_documents, write_documents
from weftline.sources.versioned import VersionedTable


class Killed(RuntimeError):
    pass


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def make(spark, tmp_path):
    return lambda **o: VersionedTable(spark, str(tmp_path / "t"), ["k"], ["at"], parts=4, retries=o.pop("retries", 0), wait_s=0.01, **o)


def batch(spark, data):
    return spark.createDataFrame(data, "k long, at long, v string, off boolean")


def test_upserts_and_deletions(spark, make):
    t = make()
    assert t.merge(batch(spark, [(1, 1, "a", None), (2, 1, "b", False), (3, 1, "c", False), (1, 0, "older", False)]), gone="off")
    t.merge(batch(spark, [(2, 2, "B", False), (3, 2, None, True), (4, 1, "d", False)]), gone="off")
    assert rows(t.read()) == [(1, 1, "a"), (2, 2, "B"), (4, 1, "d")]
    # what is older than a deletion or an update does not come back
    t.merge(batch(spark, [(3, 1, "late", False), (2, 1, "late", False)]), gone="off")
    assert rows(t.read()) == [(1, 1, "a"), (2, 2, "B"), (4, 1, "d")]
    t.merge(batch(spark, [(3, 3, "again", False)]), gone="off")
    assert (3, 3, "again") in rows(t.read())
    assert rows(t.read(0)) == [(1, 1, "a"), (2, 1, "b"), (3, 1, "c")]


def test_a_writer_killed_before_the_version_file_changes_nothing(spark, make):
    make().merge(batch(spark, [(1, 1, "a", False)]), number=0)

    def die():
        raise Killed

    with pytest.raises(Killed):
        make(before_commit=die).merge(batch(spark, [(1, 2, "lost", False), (9, 1, "lost", False)]), number=1)
    t = make()
    assert rows(t.read().select("k", "v")) == [(1, "a")] and t.versions() == [0]
    assert t.merge(batch(spark, [(1, 2, "kept", False)]), number=1) and rows(t.read().select("k", "v")) == [(1, "kept")]


def test_a_batch_that_is_run_again_changes_nothing(spark, make):
    t = make()
    assert t.merge(batch(spark, [(1, 1, "a", False)]), writer="w", number=7)
    assert not t.merge(batch(spark, [(1, 9, "other", False)]), writer="w", number=7)
    assert t.merge(batch(spark, [(2, 1, "b", False)]), writer="another", number=7)
    assert rows(t.read().select("k", "v")) == [(1, "a"), (2, "b")] and t.versions() == [0, 1]


def test_the_slower_of_two_writers_merges_again(spark, make):
    make().merge(batch(spark, [(1, 1, "a", False)]))
    todo = [lambda: make().merge(batch(spark, [(2, 1, "first", False), (1, 5, "first", False)]))]
    slow = make(retries=1, before_commit=lambda: todo and todo.pop()())
    assert slow.merge(batch(spark, [(3, 1, "second", False), (1, 4, "second", False)]))
    assert rows(slow.read().select("k", "v")) == [(1, "first"), (2, "first"), (3, "second")]


def test_failed_attempts_are_made_again(spark, make):
    fails = [1, 2]

    def sometimes():
        if fails:
            fails.pop()
            raise Killed

    assert make(retries=2, before_commit=sometimes).merge(batch(spark, [(1, 1, "a", False)]))
    assert rows(make().read().select("v")) == [("a",)] and make().versions() == [0]


def test_old_versions_go_with_their_data(spark, make, tmp_path):
    t = make()
    for i in range(5):
        t.merge(batch(spark, [(k, i, f"v{i}", False) for k in range(10)]))
    before = sum(len(f) for _, _, f in os.walk(tmp_path / "t" / "data"))
    t.vacuum(keep=1)
    assert t.versions() == [4] and rows(t.read().select("v").distinct()) == [("v4",)]
    assert sum(len(f) for _, _, f in os.walk(tmp_path / "t" / "data")) < before / 2
    t.merge(batch(spark, []))
    assert t.read().count() == 10
    with pytest.raises(ValueError, match="no version"):
        VersionedTable(spark, str(tmp_path / "none"), ["k"], ["at"]).read()


def test_as_the_sink_of_a_stream(spark, make, tmp_path):
    t, source = make(retries=1), str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame([(k, i, f"{k}-{i}", k == i) for k in range(4)], "k long, at long, v string, off boolean").coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):  # a restart from the checkpoint finds nothing to do
        s = spark.readStream.schema("k long, at long, v string, off boolean").option("maxFilesPerTrigger", 1).parquet(source)
        s.writeStream.foreachBatch(t.sink(gone="off")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert rows(t.read().select("k", "v")) == [(0, "0-2"), (1, "1-2"), (3, "3-2")]
    # a checkpoint that was lost sends every batch again
    s = spark.readStream.schema("k long, at long, v string, off boolean").option("maxFilesPerTrigger", 1).parquet(source)
    n = len(t.versions())
    s.writeStream.foreachBatch(t.sink(gone="off")).option("checkpointLocation", str(tmp_path / "other")).trigger(availableNow=True).start().awaitTermination()
    assert len(t.versions()) == n


def test_documents_are_read_with_their_errors(spark, tmp_path):
    (tmp_path / "d" / "sub").mkdir(parents=True)
    for name, raw in {"a.json": b'{"x": 1, "y": "\xc3\xa9"}', "sub/b.json": b"\xef\xbb\xbf[1, 2]", "broken.json": b"{", "odd.json": b'{"x": "\xff"}', "e.error.json": b'{"name": "e", "error": "why"}', "_summary.json": b"{}", "note.txt": b"no"}.items():
        (tmp_path / "d" / name).write_bytes(raw)
    for path in (str(tmp_path / "d"), f"file://{tmp_path}/d", f"file:{tmp_path}/d"):
        got = {r.name: r for r in read_documents(spark, path).collect()}
        assert set(got) == {"a", "b", "broken", "odd"} and json.loads(got["a"].body) == {"x": 1, "y": "é"} and got["a"].error is None
        assert got["broken"].body is None and "JSONDecodeError" in got["broken"].error and "UnicodeDecodeError" in got["odd"].error
    got = {r.name: r for r in read_documents(spark, str(tmp_path / "d"), ["y", "missing"]).collect()}
    assert json.loads(got["a"].body) == {"y": "é"} and "TypeError" in got["b"].error  # a list has no keys
    assert [tuple(r) for r in read_documents(spark, str(tmp_path / "d"), errors=True).collect()] == [("e", None, "why")]
    assert [r.name for r in read_documents(spark, str(tmp_path / "d" / "a.json")).collect()] == ["a"]
    (tmp_path / "empty").mkdir()
    assert read_documents(spark, str(tmp_path / "empty")).collect() == []


def test_written_documents_are_read_again(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(20).select(F.concat(F.lit("doc"), "id").alias("name"), F.when(F.col("id") % 5 > 0, F.to_json(F.struct("id"))).alias("body"), F.when(F.col("id") % 10 == 0, "bad").alias("error"))
    summary = write_documents(df, path)
    assert {k: summary[k] for k in ("total", "ok", "failed")} == {"total": 20, "ok": 16, "failed": 4}
    assert rows(read_documents(spark, path)) == rows(df.where("body is not null and error is null"))
    assert {(r.name, r.error) for r in read_documents(spark, path, errors=True).collect()} == {("doc0", "bad"), ("doc10", "bad"), ("doc5", "no document"), ("doc15", "no document")}
    assert not [f for f in os.listdir(path) if f.startswith("_") and f != "_summary.json"]
    assert write_documents(df.limit(1), path, mode="overwrite")["total"] == 1 and read_documents(spark, path).count() + read_documents(spark, path, errors=True).count() == 1


def test_a_failed_write_leaves_no_summary(spark, tmp_path):
    path = str(tmp_path / "out")
    for name in ("a/b", "", "_hidden"):
        with pytest.raises(Exception, match="not a file's name"):
            write_documents(spark.createDataFrame([(name, "{}", None)], "name string, body string, error string"), path)
    assert not os.path.exists(f"{path}/_summary.json")


def test_documents_in_folders_are_listed_and_read_by_tasks(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(60).select(F.concat(F.lit("doc"), "id").alias("name"), F.when(F.col("id") % 5 > 0, F.to_json(F.struct("id"))).alias("body"), F.lit(None).cast("string").alias("error"))
    for _ in range(2):  # a name that is written again goes to the same place
        assert write_documents(df, path, folders=4)["total"] == 60
    (tmp_path / "out" / "note.txt").write_bytes(b"12345")
    found = {os.path.join(d, x): os.path.getsize(os.path.join(d, x)) for d, _, names in os.walk(path) for x in names}
    assert len(found) == 62 and len({os.path.dirname(x) for x in found}) == 5
    for at in (path, f"file://{path}", f"file:{path}"):
        listed = list_documents(spark, at)
        assert {r.path: r.size for r in listed.collect()} == found and listed.count() == 62
    assert {r.mtime.timestamp() > 1e9 for r in listed.collect()} == {True}
    assert rows(read_documents(spark, path)) == rows(df.where("body is not null")) and read_documents(spark, path, errors=True).count() == 12
    # the driver does not list what is in the folders
    parts = DocumentSource({"path": path}).reader(None).partitions()
    assert [(len(p.paths), p.folder and p.folder[-5:]) for p in parts] == [(0, f"/{k:04d}") for k in range(4)]
