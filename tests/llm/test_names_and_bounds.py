"""Every operator and stage with its own names as extra columns, and top-k scores of any size."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from weftline.llm import fim, mixing, periodic, secret_scan, sharding
from weftline.llm.line_dedup import deduplicate_lines
from weftline.llm.topk import exact_top_k

NAMES = ("_row", "_leaves", "_low", "_block", "_leaf", "_h", "_size", "_copies", "_id", "_gone", "_sha", "_form", "_cut", "_out", "_text", "_m", "_m_left", "_tok", "_k1", "_found", "_lo", "_hi", "_ids", "id", "k", "n_rows", "prefix", "bytes")
REPLACED = {"mix": {"_size", "_copies", "_source_size", "_target"}}


@pytest.fixture(scope="module")
def named(spark):
    df = spark.createDataFrame([(i, f"some words of text {i % 3}\nand a line\nand a line", "en", "s") for i in range(12)], "doc_id long, text string, lang string, source string")
    for c in NAMES:
        df = df.withColumn(c, F.lit(f"own {c}"))
    return df.coalesce(1)


@pytest.mark.parametrize(
    ("name", "run"),
    [
        ("shards", lambda d: sharding.assign_shards(d, limit=100)),
        ("hot shard", lambda d: sharding.assign_shards(d.withColumn("doc_id", F.lit(1)), limit=100)),
        ("lines", deduplicate_lines),
        ("fim", fim.fill_in_middle),
        ("secrets", lambda d: secret_scan.scan_secrets(d, secret_scan.fit_models(secret_scan.labelled_samples(d)))),
        ("runs", periodic.periodic_runs),
        ("far runs", lambda d: periodic.periodic_runs(d, comparisons=1, lags=1)),
        ("mix", mixing.mix),
    ],
)
def test_columns_of_any_name_stay(named, name, run):
    out = run(named).collect()
    assert len(out) == 12
    for c in set(NAMES) - REPLACED.get(name, set()):
        assert {r[c] for r in out} == {f"own {c}"}, c


@pytest.mark.parametrize("top", [200, 2**20, 2**26, 2**29, 2**30])
def test_scores_are_exact_at_any_size(spark, top):
    rng = np.random.default_rng(top)
    v = rng.integers(-top, top, (60, 6))
    v[0], v[1], v[2] = top - 1, top - 3, -top
    rows = [(i, [float(x) / 256 for x in r]) for i, r in enumerate(v.tolist())]
    got = exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, query_every=10).collect()
    for q in range(0, 60, 10):
        want = sorted(((-sum(a * b for a, b in zip(v[q].tolist(), v[i].tolist(), strict=True)), i) for i in range(60) if i != q))[:5]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want


def test_scores_that_leave_a_long_are_an_error(spark):
    rows = [(i, [float(2**32) / 256 * (1 + i), 1.0]) for i in range(0, 60, 10)]
    with pytest.raises(Exception, match="cannot be told exactly"):
        exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), query_every=10).collect()


def test_rows_of_one_id_with_different_texts_keep_their_links(spark):
    from weftline.llm.minhash import near_duplicates

    words = [f"w{i}" for i in range(40)]
    other = [f"v{i}" for i in range(40)]
    rows = [(5, "zz " * 9), (5, " ".join(words)), (7, " ".join([*words, "more"])), (9, " ".join(other)), (9, " ".join(["x", *other])), (3, " ".join([*other, "y"])), (11, "zz " * 9), (12, "alone here entirely and without any partner")]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), ngram=2).collect()
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.class_id) for r in out)
    assert got == [(3, 40, 3, 3), (5, 1, 5, 5), (5, 39, 5, 5), (7, 40, 5, 7), (9, 39, 3, 9), (9, 40, 3, 9), (11, 1, 5, 5), (12, 6, 12, 12)]


def test_line_dedup_sorts_and_sends_no_more_than_it_must(spark, monkeypatch):
    """Classes are summed up by hashing, and joins of a table with itself read one exchange; ids that do not fit beside a line's number in a long give the same lines."""
    from weftline.llm import line_dedup

    body = "\n".join(["one two three four five six seven eight nine ten", "Ten nine eight seven six five four three two one", "", "one two three four five six seven eight nine ten eleven", "something else"])
    real = line_dedup.cut

    def cut(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(line_dedup, "cut", cut)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for least in (-3, -(1 << 63)):
            plans = []
            docs = spark.createDataFrame([(least, body), (least + 1, body), (least + 2, None)], "doc_id long, text string")
            got = {r.doc_id - least: (r.n_lines, r.removed) for r in deduplicate_lines(docs).collect()}
            assert got == {0: (5, [1, 3]), 1: (5, [0, 1, 3, 4]), 2: (0, [])}
            if abs(least) < 1 << 31:
                assert not [p for p in plans if "SortAggregate" in p and "prefix" in p]
            semi = [p for p in plans if "LeftSemi" in p and "key#" in p]
            # no side of a join with itself has columns that the other lacks, or names of its own
            assert len(semi) == 2 and not [p for p in semi if " AS n_b#" in p or " AS k1_b#" in p]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_line_dedup_looks_up_only_lines_that_may_match(spark, monkeypatch):
    """Long lines that share many words, but too few to match, are told apart before their words are looked up; texts are cut into words once for all lines."""
    import random

    from weftline.llm import line_dedup

    rng = random.Random(4)
    vocabulary = [f"{'long' * (i % 2)}w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.sample(vocabulary, 120))) for i in range(200)]
    rows += [(200 + i, " ".join([*rows[i][1].split()[:107], *(f"x{i}y{k}" for k in range(13))])) for i in range(3)]  # 107 of 133
    rows += [(300 + i, " ".join([*rows[i][1].split()[:106], *(f"x{i}y{k}" for k in range(14))])) for i in range(3, 6)]  # 106 of 134
    rows += [(400, "a b c d e f g h i j"), (401, "a b c d e f g h i longest"), (402, "b c d e f g h i longest")]
    real, found = line_dedup.cut, []

    def cut(df):
        out = real(df)
        if out.columns == ["k1"]:
            found.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "cut", cut)
    got = {r.doc_id: r.removed for r in deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert sorted(i for i in got if got[i]) == [200, 201, 202, 401, 402]
    assert found and found[0] < 30
