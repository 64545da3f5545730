"""Operators on hand-made rows: ties, nulls, empty input, graph edits, keyed replacement."""

import pytest
from pyspark.sql import functions as F
from weftline.functions import scalars as S
from weftline.functions import text as X
from weftline.operators import dataflow as D
from weftline.operators import intervals as I
from weftline.operators import joins as J


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


def test_text_marks(spark):
    assert one(spark, X.sanitize, "«a»  —  b….....") == "'a' - b..."
    assert one(spark, X.sanitize, "a\u200bb\xa0\xa0c") == "ab c"
    assert one(spark, X.sanitize_line, 'a\\b\t"c"\x00') == "ab 'c'"
    assert one(spark, X.sanitize_multiline, " a \r\n\n b ") == "a\nb"
    assert one(spark, X.strip_tags, "[x] a [y b") == "a [y b"
    assert one(spark, X.safe_name, "???") == "video"


def test_falsy_and_coercion(spark):
    df = spark.createDataFrame([(None,), ("",), ("0",), ("x",)], "v string")
    assert [r[0] for r in df.select(S.is_falsy(F.col("v"), "string")).collect()] == [True, True, False, False]
    assert one(spark, lambda c: S.round_int(c), "2.5") == 2
    assert one(spark, lambda c: S.round_int(c, 7), "NaN") == 7
    assert one(spark, lambda c: S.clamp_int(c, 1, 9, 5), "abc") == 5


def test_intervals_in_seconds_or_milliseconds(spark):
    def at(s, e):
        r = spark.createDataFrame([(s, e)], "s double, e double").select(S.normalize_interval(F.lit(None), F.lit(None), F.col("s"), F.col("e")).alias("x")).first().x
        return r.start, r.end

    assert at(1.0, 1.0) == (1, 1) and at(1.0, 121.0) == (1000, 121000) and at(1.0, 122.0) == (1, 122)
    assert at(19_990.0, 20_000.0) == (19_990_000, 20_000_000) and at(19_991.0, 20_001.0) == (19991, 20001)
    assert at(None, 5.0) == (0, 0) and at(float("nan"), 5.0) == (0, 0) and at(-5.0, -9.0) == (0, 0)


def test_fnv_of_utf16_units(spark):
    def fnv(text, basis):
        h = basis
        data = text.encode("utf-16-be")
        for i in range(0, len(data), 2):
            h = ((h ^ int.from_bytes(data[i : i + 2], "big")) * 16777619) & 0xFFFFFFFF
        return f"{h:08x}"

    for text in ("abc", "", "ёß", "a😀b"):
        x = fnv(text, 2166136261) + fnv(text, 2166136261 ^ 0x9E3779B9)
        assert one(spark, S.fnv_id, text) == "-".join(x[i : i + 4] for i in range(0, 16, 4))


def test_url_ids(spark):
    for url, want in (("https://youtu.be/abc", "abc"), ("https://x.com/w?v=q1&t=2", "q1"), ("https://x.com/w?a=1", "video"), ("no url", "video"), (None, "video")):
        assert one(spark, S.url_id, url) == want


def test_gap_audit_of_touching_nested_and_unsorted(spark):
    df = spark.createDataFrame([(1, 10, 20), (1, 0, 10), (1, 12, 15), (1, 30, 40)], "k int, st long, en long")
    assert rows(I.gap_overlap_audit(df, ["k"])) == [(1, 4, 1, 10, 1, 8, 40)]
    assert rows(I.gap_overlap_audit(df.where("false"), ["k"])) == []


def test_mode_takes_the_first_seen(spark):
    df = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "a", 3), (1, "b", 4), (1, None, 5)], "k int, v string, at int")
    assert rows(I.mode_first_seen(df, ["k"], "v", "at")) == [(1, "b", 2)]


def test_nearest_ties_and_names(spark):
    left = spark.createDataFrame([(1, 1, "a", 10)], "k int, id int, n string, t long")
    right = spark.createDataFrame([(1, 7, "b", 8), (1, 8, "b", 12), (1, 9, "a", 30)], "k int, rid int, n string, t long")
    assert J.nearest(left, right, ["k"], ["id"], "t", "t", "rid").first().nearest_id == 7
    assert J.nearest(left, right, ["k"], ["id"], "t", "t", "rid", ("n", "n")).first().nearest_id == 9
    assert J.nearest(left, right.where("false"), ["k"], ["id"], "t", "t", "rid").first().nearest_id is None


def test_copy_variants(spark):
    f = spark.createDataFrame([("a", "x.txt", 5, 1), ("a", "x copy (1).txt", 5, 2), ("a", "y.txt", 1, 1), ("a", "y.srt", 1, 1)], "dir string, file_name string, size long, mtime long")
    assert sorted(r.file_name for r in D.dedupe_copies(f, ["dir"]).collect()) == ["x copy (1).txt", "y.srt", "y.txt"]


def test_graph_edits_in_order(spark):
    nodes = spark.createDataFrame([("g", "1", "a"), ("g", "2", "b")], "graph string, id string, kind string")
    edges = spark.createDataFrame([("g", "2", "in", "1", 0)], "graph string, to_id string, input string, from_id string, output int")
    n, e = D.graph_apply(nodes, edges, [{"type": "add", "kind": "c"}, {"type": "connect", "to": "3", "input": "x", "from": "1"}, {"type": "remove", "id": "2"}])
    assert rows(n) == [("g", "1", "a"), ("g", "3", "c")] and rows(e) == [("g", "3", "x", "1", 0)]
    with pytest.raises(ValueError):
        D.graph_apply(nodes, edges, [{"type": "add", "id": "x"}])
    with pytest.raises(ValueError):
        D.graph_apply(nodes, edges, [{"type": "disconnect"}])


def test_scans_and_sinks(spark, tmp_path):
    from weftline.sources import files

    for d, name, body in (("a", "t2.txt", b"old"), ("b", "t2.txt", "при".encode("cp1251")), ("a", "t10.txt", b"ten"), ("a", "s_snapshot.txt", b"x"), ("a", "m.mp3", b"1")):
        (tmp_path / d).mkdir(exist_ok=True)
        (tmp_path / d / name).write_bytes(body)
    got = files.scan_texts(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert rows(got.select("file_name", "text")) == [("t10.txt", "ten"), ("t2.txt", "при")]
    assert [r.file_name for r in files.scan_media(spark, str(tmp_path / "a")).collect()] == ["m.mp3"]
    df = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    for _ in range(2):
        files.write_idempotent(df, str(tmp_path / "out"), ["k"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_stream_replay_equals_batch(spark, sf_dir, tmp_path):
    """All columns, after files of even ids, then of all, then of some of them once more."""
    from weftline.streaming.progress import stream_progress

    e = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("event_id").coalesce(1)
    for part in ("event_id % 2 = 0", "true", "event_id % 3 = 0"):
        e.where(part).write.mode("append").parquet(str(tmp_path / "in"))
    want = e.groupBy("user_id").agg(F.count("*").alias("rows"), F.max("event_id").alias("last_event"), F.max_by("event_type", "event_id").alias("last_type"))
    assert rows(stream_progress(spark, str(tmp_path / "in"))) == rows(want)


def test_stream_of_late_and_repeated_events(spark, tmp_path):
    from weftline.streaming.progress import stream_progress

    for batch in ([(1, 2, "a"), (1, 4, "b")], [(1, 1, "c"), (1, 2, "a"), (1, 3, None), (1, 4, "b"), (1, 4, "b"), (2, 7, None)], [(1, 4, "changed"), (2, None, "x")]):
        spark.createDataFrame(batch, "user_id long, event_id long, event_type string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert rows(stream_progress(spark, str(tmp_path / "in"))) == [(1, 4, 4, "b"), (2, 1, 7, None)]


def test_alpha_token_has_a_row_for_every_order(spark, tmp_path):
    from weftline.plans import registry

    spark.createDataFrame([(1,), (456_975,), (456_976,), (26**5,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: r.token for r in registry.QUERIES["alpha_token"](spark, str(tmp_path)).collect()}
    assert got == {1: "aaab", 456_975: "zzzz", 456_976: "baaaa", 26**5: "baaaaa"}


def test_caption_rows_keep_whole_texts(spark, tmp_path):
    from weftline.plans import registry

    long = "word " * 50 + "end"
    spark.createDataFrame([(1, 0, long), (1, 1, "a  b\nc")], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = [(r.pos, r.text) for r in registry.QUERIES["caption_rows"](spark, str(tmp_path)).orderBy("pos").collect()]
    assert got == [(0, long), (1, "a b c")]


def test_nearest_exclusive(spark):
    """Against a plain loop over all free rows, with ties, names that run out, nulls and keys on one side only."""
    import random

    draw = random.Random(3)
    left = [(k % 3, k, draw.choice([None, *range(12)]) if k % 5 == 0 else draw.randrange(12), draw.choice(["a", "b", None])) for k in range(60)] + [(7, 99, 1, "a")]
    right = [(k % 3, 100 + k, draw.choice([None, *range(12)]) if k % 7 == 0 else draw.randrange(12), draw.choice(["a", "c", None])) for k in range(45)] + [(8, 999, 1, "a")]
    want, used = [], set()
    for key, i, t, word in sorted(left, key=lambda x: (x[2] is None, x[2] or 0, x[1])):
        free = [(abs(u - t), u, j, v) for (k, j, u, v) in right if t is not None and u is not None and k == key and j not in used]
        best = min([x for x in free if x[3] == word and word is not None] or free, default=None)
        if best:
            used.add(best[2])
        want.append((key, i, best and best[2], best and best[0]))
    l = spark.createDataFrame(left, "k int, i bigint, t bigint, w string")
    r = spark.createDataFrame(right, "k int, j bigint, u bigint, w string")
    assert rows(J.nearest_exclusive(l, r, ["k"], "i", "t", "u", "j", "w")) == sorted(want, key=repr)
    assert rows(J.nearest_exclusive(l.limit(0), r, ["k"], "i", "t", "u", "j", "w")) == []


def test_file_selection(spark):
    f = [("w", "A.txt", 1, 1), ("w", "b.srt", 9, 1), ("s", "a.vtt", 1, 1), ("s", "a.txt", 2, 1), ("m", "x.txt", 1, 1), ("m", "x copy.txt", 2, 1), ("n", "x.txt", 1, 1), ("n", "x copy.txt", 2, 1), ("n", "y.txt", 1, 1), ("v", "roll.txt", 1, 1), ("v", "Roll.TXT", 5, 1)]
    ask = {"w": ("B.SRT", None), "s": (" A ", None), "m": ("zzz", "x.txt"), "n": (None, "zzz"), "v": ("", "roll.txt")}
    df = spark.createDataFrame([(*x, *ask[x[0]]) for x in f], "dir string, file_name string, mtime int, size int, wanted string, auto string")
    got = rows(D.select_named(df, ["dir"], "wanted", "auto", ["file_name"]).select("dir", "file_name"))
    assert got == sorted([("w", "b.srt"), ("s", "a.txt"), ("m", "x.txt"), ("m", "x copy.txt"), ("n", "x copy.txt"), ("n", "y.txt"), ("v", "Roll.TXT")], key=repr)
    one_ = D.locate_first(df, ["dir"], F.lit("b.srt"), [S.natural_key(F.col("file_name"))]).select("dir", "file_name")
    assert ("w", "b.srt") in rows(one_) and one_.count() == 5


def test_pins(spark):
    lines = spark.createDataFrame([("a==1",), (" b == 2 == 3 ",), ("# c==1",), ("  ",)], "line string")
    pins = D.parse_pins(lines).select("package", "version")
    assert rows(pins) == [("a", "1"), ("b", "2 == 3")]
    assert rows(D.pin_mismatches(pins, spark.createDataFrame([("b", "4")], "package string, version string")).select("mismatch")) == [("a==1 (missing)",), ("b==2 == 3 (installed: 4)",)]
    with pytest.raises(Exception, match="not an exact pin: c>=1"):
        D.parse_pins(spark.createDataFrame([("c>=1",)], "line string")).collect()


def test_spanning_and_elapsed(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (2, 1), (2, 3), (3, None)], "k int, v int")
    assert rows(D.spanning(df, ["k"], "v")) == [(1, False), (2, True), (3, False)]
    m = spark.createDataFrame([([(5,), (6,), (9,)],), ([(5,)],), (None,)], "m array<struct<ts: int>>")
    assert [r[0] for r in m.select(D.elapsed_between(F.col("m"))).collect()] == [4, None, None]


def test_parts_merge_inside_a_chunk(spark):
    from weftline.plans.texts import merge_text_parts

    parts = [(4, 1), (9, 1), (3, 1), (12, 1), (2, 2), (2, 2), (20, 3), (1, 4), (5, None), (5, None)]
    df = spark.createDataFrame([(parts,), ([],)], "v array<struct<n int, chunk bigint>>")
    got = [r[0] for r in df.select(merge_text_parts(F.col("v"), 10)).collect()]
    assert got == [[0, 0, 0, 3, 4, 4, 6, 7, 8, 8], []]


def test_natural_order_of_long_numbers(spark):
    names = ["a" + "9" * 25, "a1" + "0" * 30, "a2", "A10", "a002b", "7", "07x", "", "٣", "a" + "9" * 24 + "8"]
    df = spark.createDataFrame([(n,) for n in names], "name string").select("name", S.natural_key(F.col("name")).alias("k"))
    assert [r.name for r in df.orderBy("k", "name").collect()] == ["", "7", "07x", "a2", "a002b", "A10", "a" + "9" * 24 + "8", "a" + "9" * 25, "a1" + "0" * 30, "٣"]


def test_tail_gaps(spark):
    audit = I.gap_overlap_audit(spark.createDataFrame([(1, 0, 10), (1, 20, 30), (2, 0, 50), (4, 0, 5)], "k long, st long, en long"), ["k"])
    ends = spark.createDataFrame([(1, 40), (2, 50), (3, 7)], "k long, e long")
    got = {r.k: (r.n, r.gaps, r.gap_total, r.tail_gap) for r in I.tail_gaps(audit, ends, ["k"], "e").collect()}
    assert got == {1: (2, 2, 20, 10), 2: (1, 0, 0, 0), 3: (0, 1, 7, 7), 4: (1, 0, 0, 0)}


def test_white_space_of_unicode_is_squeezed(spark):
    assert one(spark, X.squeeze, "　a   b\u0085") == "a b"
    assert one(spark, X.sanitize_line, "a  \\ b　") == "a b"
