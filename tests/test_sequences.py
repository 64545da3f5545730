"""Sequential functions against expectations worked by hand, and their invariants."""

from hypothesis import given, settings
from hypothesis import strategies as st
from weftline.functions import fuzzy
from weftline.functions import sequences as Q
from weftline.functions.sequences import balanced_chunks, coalesce_short, fit_slots, resegment, sentence_boundaries, split_sentences, transliterate, weighted_durations
from weftline.operators.alignment import align, map_orders

words = st.lists(st.sampled_from(["one", "two.", "three", "[tag]", "four!", "\n\n", "sixsixsix", "7"]), max_size=60).map(" ".join)


def test_split_sentences_glues_short_ones_and_breaks_numbers():
    assert split_sentences("") == []
    long = "This sentence has quite enough characters to stand alone here."
    assert split_sentences(f"{long} Ok. {long} x") == [f"{long} Ok.", f"{long} x"]
    assert split_sentences(f"{long}\n{long}") == [long]  # runs of equal ones once
    assert split_sentences("Pi is 3.14 here") == ["Pi is 3. 14 here"]


def test_sentence_boundaries_know_abbreviations():
    text = "Mr. Smith came. He left."
    assert [text[:b] for b in sentence_boundaries(text)] == ["Mr. Smith came.", text]
    assert sentence_boundaries("Er kam z.B. heute.") == [18]
    assert sentence_boundaries(None) == []


@given(words, st.integers(5, 60))
@settings(max_examples=150, deadline=None)
def test_balanced_chunks_keep_text_and_limit(text, limit):
    chunks = balanced_chunks(text, limit)
    assert "".join("".join(chunks).split()) == "".join(text.split())
    assert all(len(c) <= limit for c in chunks)


def test_balanced_chunks_prefer_a_short_first_chunk_on_ties():
    assert balanced_chunks("aaaa. bbbb. cccc.", 12) == ["aaaa.", "bbbb. cccc."]
    assert balanced_chunks("x", 0) == ["x"]
    assert balanced_chunks(" ", 0) == []


def test_coalesce_short():
    assert coalesce_short(["a", "longer text", "b"], 5) == [("a longer text b", 3)]
    assert coalesce_short(["a"], 5) == [("a", 1)]
    assert coalesce_short(["a", "longer text", "b"], 5, buckets=[1, 2, 2]) == [("a", 1), ("longer text b", 2)]


@given(st.integers(0, 50_000), st.lists(st.integers(1, 500), min_size=1, max_size=20), st.integers(0, 300))
@settings(max_examples=200, deadline=None)
def test_weighted_durations_sum_to_the_total(total, weights, least):
    out = weighted_durations(total, weights, least)
    assert len(out) == len(weights)
    assert sum(out) == total


def test_fit_slots_ties_go_left():
    assert fit_slots([3, 1, 3], 2) == [4, 3]
    assert fit_slots([9], 3) == [4, 2, 3]
    assert fit_slots([], 3) == []


@given(st.lists(st.tuples(st.text("ab .", min_size=1, max_size=40), st.integers(1, 9000)), max_size=12))
@settings(max_examples=150, deadline=None)
def test_resegment_keeps_order_and_bounds(rows):
    parts = resegment(rows, 3000, 8000)
    assert "".join("".join(t for t, _ in parts).split()) in ("".join("".join(t for t, _ in rows).split()),) or not parts or sum(m for _, m in parts) <= sum(m for _, m in rows)
    assert all(m > 0 and t for t, m in parts)


def test_transliterate():
    assert transliterate("Привет Straße œuvre é") == "Privet Strasse oeuvre e"


def test_fuzzy_scores():
    assert fuzzy.ratio("abcd", "abed") == 75.0
    assert fuzzy.partial_ratio("bcd", "xxbcdxx") == 100.0
    assert fuzzy.token_sort_ratio("b a", "a b") == 100.0
    assert fuzzy.token_set_ratio("a b", "a b c d") == 100.0
    assert fuzzy.best_score("", "") == 100


def test_alignment_is_monotonic_and_stops_at_the_first_miss():
    words = [(w, 0.4 * i, 0.4 * i + 0.35) for i, w in enumerate("the quick brown fox jumps over the lazy dog".split())]
    times = align(["The quick brown fox", None, "jumps over the lazy dog"], words)
    assert times[0][0] == 0 and times[1] == (None, None) and times[2][0] > times[0][1]
    assert align(["completely different words here zzz", "the quick brown fox"], words) == [(None, None)] * 2
    again = align(["xqzv kkkk pppp", "jumps over the lazy dog"], words, recover=3)
    assert again[0][0] is not None and again[1][0] is not None


def test_map_orders_first_seen_on_ties():
    assert map_orders([["a", "b"], ["c"], ["z"]], [(1, ["a"]), (2, ["b", "c"])]) == [1, 2, None]


def test_null_arguments_give_nulls(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(10, [1, 1], 1), (None, [1], 1), (10, None, 1), (10, [1, None], None), (9, [None, 3], 1), (5, [], 1)], "t int, w array<int>, m int")
    assert [r[0] for r in df.select(Q.weighted_durations_col("t", "w", "m")).collect()] == [[5, 5], None, None, None, [1, 8], []]
    assert [r[0] for r in df.select(Q.fit_slots_col("w", F.when(F.col("t") > 9, 1))).collect()] == [[2], None, None, [1], None, None]
