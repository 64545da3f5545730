"""What showed only on larger tables: rows that the small ones lack, and steps that have to grow no faster than their input."""

import datetime as dt

import duckdb
import pytest

from weftline.plans import registry

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.fixture
def equals_sql(spark, tmp_path):
    """Compares a query with its SQL on tables of its own; returns the query's rows."""

    def check(name, **tables):
        con = duckdb.connect()
        for t, df in tables.items():
            df.write.parquet(f"{tmp_path}/{t}.parquet")
            con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
        df = registry.QUERIES[name](spark, str(tmp_path))
        rows = [tuple(r) for r in df.collect()]
        want = con.sql(f"select {', '.join(df.columns)} from ({registry.ORACLE[name]})").fetchall()
        assert sorted(map(repr, rows)) == sorted(map(repr, want))
        return rows

    return check


def events(spark, rows):
    """Events of (id, user, kind, value), a second apart."""
    return spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), u, kind, v, "{}") for i, u, kind, v in rows], EVENTS)


def test_total_duration_of_zero_and_less(spark, equals_sql):
    values = [0.0, 0.0004, 0.0005, 0.0015, 2.5, -1.5, None]
    rows = equals_sql("total_duration", events=events(spark, [(3 * k + r, 1, "view", v) for k, v in enumerate(values) for r in range(3)]))
    assert dict(rows)[1] == 0


def test_graph_fold_of_users_without_some_nodes(spark, equals_sql):
    # user u has an event for each node but u: 1 is an end of the first edit, 8 and 3 of the others
    rows = [(9 * (20 * u + k) + k, u, "view" if k % 2 else "click", 1.0) for u in range(9) for k in range(9) if k != u]
    rows += [(9 * (20 * 9 + k) + k, 9, "view", 1.0) for k in (0, 2, 6, 7)]  # neither 1, 3, 4, 5 nor 8
    out = equals_sql("graph_fold", events=events(spark, rows))
    assert (1, "error", 0, "no such node: 9 (to)") in {(r[0], r[1], r[8], r[9]) for r in out}
    assert (9, "error", 5, "no such node: 8 (from)") in {(r[0], r[1], r[8], r[9]) for r in out}


def test_a_waiting_sentence_scores_a_window_once(monkeypatch):
    from weftline.operators import alignment as A
    from weftline.operators.files_alignment import FileOfWords, Walk

    scored = []
    monkeypatch.setattr(A, "best_score", lambda a, b, *rest: scored.append((a, b)) or 0)
    walk = Walk(["the mill stands behind the old bridge today"])
    for n in range(40):
        words = [(f"{a}{b}", 1.0, 1.2) for a in "qxzvkw" for b in (n, n + 100, n + 200)]
        assert walk.feed(FileOfWords(n, 0, "f", 0, 1000, None, words)) == []
    # forty files of 18 words: every window of the 12 lengths twice at most (as it is and compact), however many files came
    assert len(walk.unread) == 720 and len(scored) <= 2 * 12 * 720


def test_the_best_window_is_that_of_all_windows():
    import random

    from weftline.functions.fuzzy import best_score, lcs_length, partial_ratio

    r = random.Random(3)
    for alphabet in ("ab ", "abcdefgh  ") * 30:
        short, long = ("".join(r.choice(alphabet) for _ in range(n)) for n in (r.randrange(1, 80), r.randrange(80, 220)))
        n = len(short)
        windows = [long[max(0, i) : i + n] for i in range(1 - n, len(long))]
        want = max(200.0 * lcs_length(short, w) / (n + len(w)) for w in windows)
        assert partial_ratio(short, long) == pytest.approx(want)
        best = best_score(short, long)
        assert best >= int(want)
        for floor in (55, 70, 85):
            got = best_score(short, long, 101, floor, floor + 5)
            assert (got >= floor) == (best >= floor) and (got == best or best < floor + 5)


def test_batch_groups_is_batch_items_by_group(spark):
    from weftline.functions import tables

    tables.register(spark)
    sizes = "cast(case when id % 11 = 0 then null else id % 23 - 3 end as bigint)"
    spark.sql(f"SELECT cast(case when id % 500 < 400 then id % 7 end as bigint) AS g, id AS n, {sizes} AS s FROM range(30000)").createOrReplaceTempView("grouped")
    want = spark.sql("SELECT g, n, batch, place, carried FROM batch_items(TABLE(grouped) PARTITION BY (g) ORDER BY (n), 40, 's')").collect()
    dealt = spark.table("grouped").repartition(3, "g").sortWithinPartitions("g", "n")
    got = spark.sql("SELECT key, n, batch, place, carried FROM batch_groups(TABLE(SELECT * FROM {t}), 40)", t=dealt).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want))) and len(got) == 30000


def test_decode_fallback_is_that_of_python_without_python_workers(spark):
    import random

    from pyspark.sql import functions as F

    from weftline.functions.text import decode_fallback

    def one(b):
        try:
            return b.decode("utf-8")
        except UnicodeDecodeError:
            return b.decode("cp1251", "ignore")

    r = random.Random(9)
    raw = [b"", b"abc", "\u043f\u0440\u0438\u0432\u0435\u0442".encode("cp1251"), "\u043f\u0440\U0001f600".encode(), bytes(range(256)), b"\xed\xa0\x80", b"\xc0\x80", b"\xf4\x90\x80\x80", b"\xe2\x82", b"a\x98\xe0"]
    raw += [bytes(r.choice((0x41, 0x98, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F)) for _ in range(r.randrange(6))) for _ in range(300)]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raw)] + [(-1, None)], "i int, b binary")
    out = df.select("i", decode_fallback(F.col("b")).alias("t"))
    got = {x.i: x.t for x in out.collect()}
    assert got.pop(-1) is None and got == {i: one(b) for i, b in enumerate(raw)}
    assert "Python" not in spark.createDataFrame([], "b binary").select(decode_fallback(F.col("b")))._jdf.queryExecution().toString()


def test_balanced_chunks_of_a_batch_are_some_texts_at_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from weftline.functions import sequences as Q

    texts = [None, "", *(f"One {n}. Two and three? " * (n % 9) for n in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    got = {r.i: r.c for r in df.select("i", Q.balanced_chunks_col(F.col("t"), 40).alias("c")).collect()}
    assert got == {i: Q.balanced_chunks(t, 40) for i, t in enumerate(texts)}
    assert Q._AT_ONCE < len(texts)


def test_every_page_is_aligned_with_its_neighbour(spark):
    from weftline.llm.html_extract import extract_main_text

    own = ["<p>The harbour froze early that year.</p><p>Nobody sailed before April.</p>", "<p>A mill burned at night.</p><p>Its owner left the valley.</p>"]
    pages = [(i, f"https://a.org/{kind}/{i % 2}", f"<main><p>Sign up for the weekly letter</p>{f'<article>{x}<p>Read on</p></article>' if kind == 'b' else x}</main>") for i, (kind, x) in enumerate([("b", own[0]), ("b", own[1]), ("m", own[0]), ("m", own[1])])]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    want = [x.replace("</p><p>", "\n").replace("<p>", "").replace("</p>", "") for x in own]
    assert got == {0: want[0] + "\nRead on", 1: want[1] + "\nRead on", 2: want[0], 3: want[1]}


def test_many_windows_are_compared_at_once_with_the_same_verdicts():
    import random

    from weftline.functions.fuzzy import best_score
    from weftline.functions.windows import Windows

    r, verdicts = random.Random(4), []
    for round_ in range(60):
        letters = r.choice(["ab", "abc'", "abcdefghij"])
        mine = ["".join(r.choice(letters) for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(1, 24))]
        text = ["".join(r.choice(letters) for _ in range(r.randrange(0 if n % 9 == 5 else 1, 9))) for n in range(r.randrange(1, 40))]
        if round_ % 2:
            text[len(text) // 2 : len(text) // 2] = [w[::-1] if n % 5 == 2 else w for n, w in enumerate(mine)]
        norm, compact, bare = ", ".join(mine) + ".", "".join(mine).replace("'", ""), [w.replace("'", "") for w in text]
        if not compact:
            continue
        enough = r.choice([62, 75, 90, 100])
        each = [(i, k) for k in sorted({max(1, int(len(mine) * x)) for x in (0.48, 0.8, 1.0, 1.3)}) for i in range(len(text) - k + 1)]
        r.shuffle(each)

        def score(i, k):
            other = "".join(bare[i : i + k])
            return max(best_score(norm, " ".join(text[i : i + k])), best_score(compact, other) if other else 0)

        want = [score(i, k) >= enough for i, k in each]
        if each:
            windows = Windows(norm, compact, text, bare, enough, max(k for _, k in each), r.randrange(len(text)))
            assert [windows.first([w]) == 0 for w in each[:20]] == want[:20]
            assert windows.first(each) == (want.index(True) if any(want) else len(each))
        verdicts += want
    assert 100 < sum(verdicts) < len(verdicts) - 100


def test_a_sentence_scores_some_windows_singly(monkeypatch):
    from weftline.operators import alignment as A

    scored = []
    whole = A.best_score
    monkeypatch.setattr(A, "best_score", lambda a, b, *rest: scored.append((a, b)) or whole(a, b, *rest))
    noise = [f"{a}{b}{c}" for a in "qxzvkw" for b in "jpyfg" for c in "qzxvk"]
    sentence = "the mill stands behind the old bridge today"
    words = [(w, n * 0.4, n * 0.4 + 0.3) for n, w in enumerate([*noise, *sentence.split(), *noise])]
    for aggressive in (False, True):
        del scored[:]
        found = A.Aligner(list(words)).match(sentence, aggressive)
        assert found and A.Aligner(words[: len(noise)]).match(sentence, aggressive) is None
        assert len(scored) <= 4 * A._SINGLY + 8  # more than a thousand windows, each as it is and compact
        with monkeypatch.context() as m:
            m.setattr(A, "_SINGLY", 10**9)
            assert A.Aligner(list(words)).match(sentence, aggressive) == found


def test_the_sentences_of_a_document_are_one_message_to_the_state():
    import pandas as pd

    from weftline.streaming.alignment import AlignmentState

    class Handle:
        def __init__(self):
            self.calls = []

        def state(self, *_):
            return self

        getListState = getValueState = getMapState = state  # noqa: N815  names of the interface

        def appendValue(self, row):  # noqa: N802
            self.calls.append([row])

        def appendList(self, rows):  # noqa: N802
            self.calls.append(rows)

    handle, state = Handle(), AlignmentState()
    state.init(handle)
    state.handleInitialState((1,), pd.DataFrame({"idx": [2, 0, 1], "text": ["c", "a", None]}), None)
    assert handle.calls == [[(0, "a"), (1, None), (2, "c")]]
