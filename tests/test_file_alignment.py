"""Alignment file by file: recovery behind a miss, and the stream against the batch, with restarts and replaced files."""


import pytest

from weftline.operators.files_alignment import DELIVERY, FileOfWords, Walk, align_files
from weftline.streaming.alignment import align_stream, latest_revision

SENTENCES = [
    "The river rises in the northern hills.", "It crosses seven valleys before noon.", "Nobody lives near the second bridge.", "Old maps show a mill and a small harbour.",
    "Traders came twice every summer.", "Their boats were long and narrow.", "A flood destroyed most of the wooden houses.", "Today the harbour is a quiet garden.",
]


def words(texts, start=0.0, each=0.4):
    out, at = [], start
    for t in texts:
        for w in t.split():
            out.append((w, round(at, 3), round(at + each - 0.05, 3)))
            at += each
    return out


def given(number, texts, start=0.0, chunk_end=None, end=None, version=0):
    w = words(texts, start)
    stop = end if end is not None else round(w[-1][2] * 1000) if w else round(start * 1000)
    return FileOfWords(number, version, f"f{number}", round(start * 1000), stop, chunk_end, w)


def test_every_sentence_is_matched_in_order():
    walk = Walk(SENTENCES)
    rows = walk.feed(given(0, SENTENCES[:4])) + walk.feed(given(1, SENTENCES[4:], 12.0))
    assert [r[0] for r in rows] == list(range(8)) and {r[3] for r in rows} == {"match"}
    assert all(a[2] < b[1] for a, b in zip(rows, rows[1:])) and all(r[2] - r[1] >= 200 for r in rows)


def test_without_a_chunk_end_a_miss_waits_for_the_next_file():
    walk = Walk(SENTENCES)
    assert [r[0] for r in walk.feed(given(0, SENTENCES[:2] + ["zzz qqq xxx"]))] == [0, 1]
    rows = walk.feed(given(1, SENTENCES[2:4], 9.0))
    assert [(r[0], r[3]) for r in rows] == [(2, "match"), (3, "match")]


def test_placeholders_have_no_times():
    walk = Walk([SENTENCES[0], None, SENTENCES[1]])
    assert [(r[0], r[3], r[1] is None) for r in walk.feed(given(0, SENTENCES[:2]))] == [(0, "match", False), (1, "placeholder", True), (2, "match", False)]


def test_an_anchor_fills_the_gap_by_weight():
    heard = [SENTENCES[0], "bzzt krr vvv ooo hmm", SENTENCES[3]]
    walk = Walk(SENTENCES[:4])
    rows = walk.feed(given(0, heard, chunk_end=4))
    assert [(r[0], r[3]) for r in rows] == [(0, "match"), (1, "gap"), (2, "gap"), (3, "anchor")]
    gap = rows[1:3]
    assert gap[0][1] == rows[0][2] + 1 and gap[1][2] == rows[3][1] and gap[0][2] == gap[1][1]
    weights = [len(SENTENCES[1]), len(SENTENCES[2])]
    total = rows[3][1] - rows[0][2] - 1
    assert abs((gap[0][2] - gap[0][1]) - (200 + (total - 400) * weights[0] / sum(weights))) <= 1


def test_an_anchor_lies_among_the_next_eight_only():
    many = [f"{a} unlike anything else said {b}" for a, b in zip("Quartz Violet Hammer Pigeon Walnut Saddle Copper Meadow Turnip Lantern".split(), "harp gold mist yarn fern dusk opal knot plum vest".split())]
    heard = ["vvv krr"] * 3
    for wide, how in ((9, "rest"), (8, "anchor")):
        walk = Walk([*many[:wide], SENTENCES[6]])
        rows = walk.feed(given(0, [*heard, SENTENCES[6]], chunk_end=wide + 1))
        assert rows[-1][3] == how


def test_without_an_anchor_the_rest_ends_with_the_file():
    walk = Walk(SENTENCES)
    rows = walk.feed(given(0, [SENTENCES[0], "bzzt krr vvv"], chunk_end=3, end=20_000))
    assert [(r[0], r[3]) for r in rows] == [(0, "match"), (1, "rest"), (2, "rest")] and rows[-1][2] == 20_000
    assert walk.unread == [] and walk.last_end == 20_000
    assert [(r[0], r[3]) for r in walk.feed(given(1, SENTENCES[3:], 20.0))][:2] == [(3, "match"), (4, "match")]


def rows_of(files):
    return [(1, f.number, f.version, f.source, f.start_ms, f.end_ms, f.chunk_end, *[[w[k] for w in f.words] for k in range(3)]) for f in files]


@pytest.fixture
def feed(spark, tmp_path):
    """Runs the stream over batches of deliveries, one call a batch, each time from its checkpoint, and returns all rows so far."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    sentences = spark.createDataFrame([(d, i, t) for d in (1, 2) for i, t in enumerate(SENTENCES)], "doc_id long, idx int, text string")

    def run(batches, keep=None):
        for b in batches:
            spark.createDataFrame(b, DELIVERY).coalesce(1).write.mode("append").parquet(source)
            stream = align_stream(spark.readStream.schema(DELIVERY).option("maxFilesPerTrigger", 1).parquet(source), sentences, keep=keep)
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(out)

    yield run, sentences
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def same_as_batch(spark, got, sentences, files):
    want = align_files(sentences, spark.createDataFrame(rows_of(files), DELIVERY))
    cols = ["doc_id", "idx", "start_ms", "end_ms", "source", "how"]
    assert sorted(map(repr, latest_revision(got).select(*cols).collect())) == sorted(map(repr, want.select(*cols).collect()))


def test_stream_equals_batch_over_restarts_and_says_each_row_once(spark, feed):
    run, sentences = feed
    files = [given(0, SENTENCES[:3]), given(1, [SENTENCES[3], "krr bzzt", SENTENCES[5]], 9.0, chunk_end=6), given(2, SENTENCES[6:], 16.0)]
    got = run([rows_of([f]) for f in files])
    same_as_batch(spark, got, sentences, files)
    assert got.groupBy("doc_id", "idx").count().where("count > 1").count() == 0 and {r.revision for r in got.collect()} == {0}


def test_a_replaced_file_gives_what_a_run_with_it_alone_gives(spark, feed):
    run, sentences = feed
    a, b, c = given(0, SENTENCES[:3]), given(1, SENTENCES[3:6], 9.0), given(2, SENTENCES[6:], 16.0)
    changed = given(1, [SENTENCES[3], "krr"], 9.5, version=1)
    got = run([rows_of([a]), rows_of([b, c]), rows_of([b]), rows_of([changed])])
    same_as_batch(spark, got, sentences, [a, changed, c])
    last = got.where("revision = 1").collect()
    assert {r.idx for r in last if r.how == "withdrawn"} == {4, 5, 6, 7}  # no file says the fifth sentence any more, so none behind it is reached
    # an older version that comes late changes nothing
    assert run([rows_of([given(1, SENTENCES[3:6], 9.0)])]).count() == got.count()


def test_files_out_of_turn_and_in_one_batch(spark, feed):
    run, sentences = feed
    files = [given(0, SENTENCES[:3]), given(1, SENTENCES[3:6], 9.0), given(2, SENTENCES[6:], 16.0)]
    same_as_batch(spark, run([rows_of([files[2]]), rows_of([files[1], files[0]])]), sentences, files)


def test_files_that_were_let_go_are_late(spark, feed):
    run, sentences = feed
    files = [given(k, SENTENCES[2 * k : 2 * k + 2], 6.0 * k) for k in range(4)]
    got = run([rows_of([f]) for f in files] + [rows_of([given(0, SENTENCES[:1], version=1)])], keep=2)
    same_as_batch(spark, got.where("how <> 'late'"), sentences, files)
    late = got.where("how = 'late'").collect()
    assert len(late) == 1 and late[0].idx is None and late[0].source == "f0"
    # the last ones can be replaced still
    again = given(3, SENTENCES[6:7], 18.0, version=2)
    same_as_batch(spark, run([rows_of([again])], keep=2).where("how <> 'late'"), sentences, [*files[:3], again])
