"""The interval index, exclusive picking, folds of graph edits and table functions against plain versions."""

import random

import pytest
from pyspark.sql import functions as F
from weftline.functions import tables
from weftline.operators import joins as J
from weftline.operators.graphs import ACTION, graph_fold
from weftline.operators.picking import pick_exclusive, require_picked

YEAR = 365 * 86_400_000


@pytest.fixture(scope="module")
def spans():
    rng = random.Random(5)
    out = [(rng.randrange(3), i, s := rng.randrange(-5_000, 20_000), s + rng.choice([0, 1, 2, 7, 64, 65, 900, 5_000])) for i in range(150)]
    return [*out, (0, 900, -YEAR, YEAR), (1, 901, 5, 3), (2, 902, 0, 0)]


@pytest.mark.parametrize("length", [0, 1, 2, 3, 4, 5, 63, 64, 65, 2**40 - 1, 2**40, 2**40 + 1, YEAR])
def test_an_interval_makes_two_rows_at_most(spark, length):
    for start in (-7, 0, 1, 2**41 - 1):
        rows = J.interval_buckets(spark.createDataFrame([(start, start + length)], "s long, e long"), "s", "e").collect()
        assert 1 <= len(rows) <= 2
        level = rows[0]._level
        assert length <= 2**level and (level == 0 or length > 2 ** (level - 1))
        assert {r._bucket for r in rows} == {start >> level, (start + length) >> level}


def test_containing_equals_plain_version(spark, spans):
    points = [(k % 3, k, at) for k, at in enumerate(list(range(-6_000, 22_000, 251)) + [0, 5, 3, YEAR, -YEAR, YEAR + 5, -YEAR - 1])]
    got = J.containing_else_before(
        spark.createDataFrame(points, "g long, pid long, t long"), spark.createDataFrame(spans, "g long, sid long, s long, e long"), ["g"], ["pid"], "t", "s", "e", "sid"
    ).collect()
    assert len(got) == len(points)
    for r in got:
        inside = [(s, e, i) for g, i, s, e in spans if g == r.g and s <= r.t < e]
        before = [(e, s, i) for g, i, s, e in spans if g == r.g and e <= r.t]
        want = (max(inside)[2], "inside") if inside else (max(before)[2], "before") if before else (None, "none")
        assert (r.span_id, r.how) == want


def test_dominant_overlap_equals_plain_version(spark, spans):
    rng = random.Random(6)
    items = [(rng.randrange(3), rng.choice("abc"), s := rng.randrange(-6_000, 21_000), s + rng.choice([0, 1, 3, 70, 1_000, 30_000])) for _ in range(120)]
    a, b = spark.createDataFrame(spans, "g long, sid long, s long, e long"), spark.createDataFrame(items, "g long, v string, i long, j long")
    for fallback in (False, True):
        got = {r.sid: (r.v, r.overlap_ms) for r in J.dominant_overlap(a, b, ["g"], "sid", "s", "e", "v", "i", "j", else_first_end=fallback).collect()}
        want = {}
        for g, sid, s, e in spans:
            sums = {}
            for h, v, i, j in items:
                if h == g and min(e, j) > max(s, i):
                    sums[v] = sums.get(v, 0) + min(e, j) - max(s, i)
            if sums:
                want[sid] = min(sums.items(), key=lambda x: (-x[1], x[0]))
            elif fallback:
                later = [(j, v) for h, v, i, j in items if h == g and j >= s]
                want[sid] = (min(later)[1] if later else None, 0)
        assert got == want


def test_nearest_exclusive_equals_plain_version(spark):
    rng = random.Random(8)
    left = [(rng.randrange(3), i, rng.choice([None, *range(0, 60, 3)]) if i % 9 == 0 else rng.randrange(60), rng.choice("ab")) for i in range(60)]
    right = [(rng.randrange(3), i, rng.randrange(60), rng.choice("abc")) for i in range(70)]
    got = J.nearest_exclusive(spark.createDataFrame(left, "g long, id long, t long, n string"), spark.createDataFrame(right, "g long, rid long, at long, n string"), ["g"], "id", "t", "at", "rid", "n").collect()
    want = {}
    for g in range(3):
        free = [r for r in right if r[0] == g]
        for _, i, t, n in sorted((x for x in left if x[0] == g), key=lambda x: (x[2] is None, x[2] or 0, x[1])):
            best = None if t is None else min((r for r in free if r[3] == n), key=lambda r: (abs(r[2] - t), r[2], r[1]), default=None) or min(free, key=lambda r: (abs(r[2] - t), r[2], r[1]), default=None)
            want[i] = (None, None) if best is None else (best[1], abs(best[2] - t))
            if best:
                free.remove(best)
    assert {r.id: (r.rid, r.distance) for r in got} == want


def pick(segments, files):
    """The contract, with a list of free files."""
    own = {}
    for i, fid in files:
        if i is not None:
            own.setdefault(i, fid)
    direct = bool(segments) and all(s in own for s in segments)
    free, out = [fid for _, fid in files], []
    for s in segments:
        want = own[s] if direct and own[s] in free else free[0] if free else None
        out.append((want, "missing" if want is None else "direct" if direct and want == own.get(s) and own[s] in free else "next"))
        if want is not None:
            free.remove(want)
    return out


def test_picking_equals_plain_version(spark):
    rng = random.Random(7)
    segments, files = [], []
    for g in range(60):
        n = rng.randrange(1, 6)
        segments += [(g, k, rng.choice([None, *range(4)]) if g % 5 == 0 else rng.randrange(4)) for k in range(n)]
        files += [(g, rng.choice([None, 9, *range(4)]) if g % 3 else k % 4, 100 * g + k) for k in range(rng.randrange(0, 7))]
    s, f = spark.createDataFrame(segments, "g long, k int, idx int"), spark.createDataFrame(files, "g long, idx int, fid long")
    got = pick_exclusive(s, f, ["g"], index="idx", order=["k"], file_index="idx", file_id="fid", file_order=["fid"])
    rows = {}
    for r in sorted(got.collect(), key=lambda r: (r.g, r.k)):
        rows.setdefault(r.g, []).append((r.picked, r.how))
    want = {}
    for g in range(60):
        mine = [x[2] for x in segments if x[0] == g]
        want[g] = pick(mine, [(x[1], x[2]) for x in sorted((y for y in files if y[0] == g), key=lambda y: y[2])])
    assert rows == want and {h for x in rows.values() for _, h in x} == {"direct", "next", "missing"}
    with pytest.raises(Exception, match="missing file for segment"):
        require_picked(got, "idx").collect()
    assert require_picked(got.where("how <> 'missing'"), "idx").count() == got.where("how <> 'missing'").count()


def fold(spark, nodes, edges, actions):
    cols = [c.split(" ")[0] for c in ACTION.replace("<input:string,from:string,output:int>", "").replace("<to:string,input:string,output:int>", "").split(", ")]
    rows = [tuple({"graph": 1, "n": k, **a}.get(c) for c in cols) for k, a in enumerate(actions)]
    out = graph_fold(spark.createDataFrame([(1, i, k) for i, k in nodes], "graph long, id string, kind string"), spark.createDataFrame([(1, *e) for e in edges], "graph long, to_id string, input string, from_id string, output int"), spark.createDataFrame(rows, ACTION)).collect()
    return {r.id: r.kind for r in out if r.item == "node"}, {(r.to_id, r.input): (r.from_id, r.output) for r in out if r.item == "edge"}, {r.n: r.message for r in out if r.item == "error"}


def test_references_may_point_ahead(spark):
    nodes, edges, errors = fold(
        spark,
        [("1", "a"), ("7", "b")],
        [("7", "x", "1", 0)],
        [
            {"type": "add", "ref": "p", "kind": "new", "inputs": [("in", "@q", 2)], "outputs": [("7", "y", 1)]},
            {"type": "add", "ref": "q", "kind": "later"},
            {"type": "add", "id": "623:297", "kind": "nested"},
            {"type": "connect", "to": "@q", "input": "z", "from": "623:297"},
        ],
    )
    assert nodes == {"1": "a", "7": "b", "8": "new", "9": "later", "623:297": "nested"} and errors == {}
    assert edges == {("7", "x"): ("1", 0), ("8", "in"): ("9", 2), ("7", "y"): ("8", 1), ("9", "z"): ("623:297", 0)}


@pytest.mark.parametrize(
    ("action", "message"),
    [
        ({"type": "add", "id": "1", "kind": "x"}, "node 1 exists"),
        ({"type": "add", "id": "a1"}, "not a node id: a1"),
        ({"type": "add", "inputs": [("in", "@nobody", 0)]}, "no such ref: nobody"),
        ({"type": "add", "inputs": [("in", "55", 0)]}, "no such node: 55 (inputs.from)"),
        ({"type": "add", "outputs": [("55", "in", 0)]}, "no such node: 55 (outputs.to)"),
        ({"type": "connect", "to": "1", "input": "x", "from": "99"}, "no such node: 99 (from)"),
        ({"type": "connect", "to": "99", "input": "x", "from": "1"}, "no such node: 99 (to)"),
        ({"type": "connect", "to": "1", "from": "2"}, "input is required"),
        ({"type": "connect", "to": "1", "input": "x", "from": "2", "output": -1}, "output must not be negative"),
        ({"type": "connect", "to": "1", "input": "x"}, "from is required"),
        ({"type": "disconnect", "input": "x"}, "disconnect needs a node on either side"),
        ({"type": "disconnect", "to": "99"}, "no such node: 99 (to)"),
        ({"type": "remove", "id": "99"}, "no such node: 99 (id)"),
        ({"type": "swap"}, "no such action: swap"),
    ],
)
def test_an_error_is_a_row_and_changes_nothing(spark, action, message):
    before = {"1": "a", "2": "b"}, {("2", "x"): ("1", 0)}
    nodes, edges, errors = fold(spark, list(before[0].items()), [("2", "x", "1", 0)], [action, {"type": "remove", "id": "2"}])
    assert errors == {0: message} and nodes == {"1": "a"} and edges == {}


def test_ids_are_reserved_in_order(spark):
    nodes, _, errors = fold(spark, [("7", "a")], [], [{"type": "add", "kind": "n"}, {"type": "add", "id": "8", "kind": "m"}, {"type": "add", "id": "20", "ref": "r"}, {"type": "add", "id": "21", "ref": "r"}, {"type": "add", "kind": "o"}])
    assert errors == {1: "id 8 is reserved", 3: "ref r names two nodes"} and nodes == {"7": "a", "8": "n", "20": None, "21": "o"}


def test_overwriting_and_disconnecting(spark):
    edges = [("2", "x", "1", 0), ("2", "y", "1", 1), ("3", "x", "2", 0)]
    nodes, left, errors = fold(spark, [("1", "a"), ("2", "b"), ("3", "c")], edges, [{"type": "add", "id": "2", "kind": "B", "overwrite": True, "inputs": [("w", "1", 4)]}, {"type": "disconnect", "from": "2"}])
    assert (nodes["2"], left, errors) == ("B", {("2", "w"): ("1", 4)}, {})
    assert fold(spark, [("1", "a"), ("2", "b")], edges[:2], [{"type": "disconnect", "to": "2", "from": "1", "output": 1}])[1] == {("2", "x"): ("1", 0)}


def test_graphs_without_actions_stay(spark):
    out = graph_fold(spark.createDataFrame([(3, "1", "a")], "graph long, id string, kind string"), spark.createDataFrame([], "graph long, to_id string, input string, from_id string, output int"), spark.createDataFrame([], ACTION))
    assert [(r.graph, r.item, r.id, r.kind) for r in out.collect()] == [(3, "node", "1", "a")]


def test_batches_carry_their_remainder(spark):
    tables.register(spark)
    sizes = {1: [3, 4, 5, 1, 9, None, 2], 2: [], 3: [10, 1, -5, 30]}
    spark.createDataFrame([(g, k, s) for g, x in sizes.items() for k, s in enumerate(x)], "g long, k int, s int").createOrReplaceTempView("sized")
    got = {}
    for r in spark.sql("SELECT * FROM batch_items(TABLE(sized) PARTITION BY (g) ORDER BY (k), 10, 's')").collect():
        got.setdefault(r.g, []).append((r.k, r.batch, r.place, r.carried))
    for g, x in sizes.items():
        want, batch, place, total, carried = [], 0, 0, 0, 0
        for k, s in enumerate(x):
            want.append((k, batch, place, carried))
            place, total = place + 1, total + max(0, s or 0)
            if carried + total >= 10:
                carried, batch, place, total = (carried + total) % 10, batch + 1, 0, 0
        assert sorted(got.get(g, [])) == want
    assert [r.batch for r in spark.sql("SELECT * FROM batch_items(TABLE(SELECT k FROM sized WHERE g = 1) WITH SINGLE PARTITION ORDER BY (k), 3)").orderBy("k").collect()] == [0, 0, 0, 1, 1, 1, 2]
    for bad in ("0", "'x'", "3, 'no_such'"):
        with pytest.raises(Exception, match="must be|no such column|positive"):
            spark.sql(f"SELECT * FROM batch_items(TABLE(sized) PARTITION BY (g), {bad})").collect()


def test_first_items_of_partitions(spark):
    tables.register(spark)
    spark.range(100).select(F.col("id"), (F.col("id") % 3).alias("g")).createOrReplaceTempView("numbered")
    got = sorted(r.id for r in spark.sql("SELECT * FROM first_items(TABLE(numbered) PARTITION BY (g) ORDER BY (id DESC), 2)").collect())
    assert got == [94, 95, 96, 97, 98, 99]


def test_harvest_items(spark):
    tables.register(spark)
    body = '{"text": "one", "list": [{"text": "two", "x.text": "no"}, ["a", {"deep": {"text": "three"}}], {"text": {"text": "four"}}], "n": {"text": 5}}'
    spark.createDataFrame([(1, body), (2, None), (3, "{broken"), (4, "[]")], "id long, body string").createOrReplaceTempView("bodies")
    got = [tuple(r) for r in spark.sql("SELECT * FROM harvest_items(TABLE(bodies), 'text')").orderBy("id", "pos").collect()]
    assert got == [(1, 0, "$.text", "one"), (1, 1, "$.list[0].text", "two"), (1, 2, "$.list[1][1].deep.text", "three"), (1, 3, "$.list[2].text.text", "four")]
