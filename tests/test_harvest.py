"""The harvest by recursion against the one in Python."""

import json
import random

from pyspark.sql import functions as F
from weftline.sources import files


def nested(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.3:
        return rng.choice(["x", "", "{\"f\": 1}", "[1]", "é\n\"", 5, 1.5, None, True, [], {}])
    if kind < 0.6:
        return [nested(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {k: nested(rng, depth - 1) for k in rng.sample(["f", "g", "a", "z f", "f.f", "0"], rng.randrange(1, 5))}


def test_recursion_equals_python(spark):
    rng = random.Random(3)
    bodies = [json.dumps(nested(rng, 6), ensure_ascii=i % 2 == 0) for i in range(150)]
    deep = "\"end\""
    for _ in range(120):
        deep = '{"n": [' + deep + '], "f": "level"}'
    bodies += [None, "", "{broken", '"f"', "[]", '{"f": "top", "a": {"f": {"f": "in"}}, "b": [{"f": "x"}]}', deep]
    df = spark.createDataFrame(list(enumerate(bodies)), "id long, body string")
    want = {(r.id, k, v) for r in df.select("id", files.deep_field("body", "f").alias("v")).collect() for k, v in enumerate(r.v or [])}
    spark.conf.set("spark.sql.cteRecursionRowLimit", "50")  # which does not hold here
    try:
        got = {tuple(r) for r in files.harvest(df, "id", "body", "f").collect()}
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert got == want and len({i for i, _, _ in got}) > 50 and sum(i == len(bodies) - 1 for i, _, _ in got) == 120
