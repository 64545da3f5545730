"""Queries of what keeps state or leaves files: alignment by files, sinks, folds of edits, picking, table functions, deep harvests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import sequences as Q
from ..functions import tables as U
from ..operators import alignment as A
from ..operators import files_alignment as L
from ..operators import graphs as G
from ..operators import picking as K
from ..sources import documents as DS
from ..sources import files
from ..sources.versioned import VersionedTable
from ..streaming.alignment import align_stream, latest_revision
from ..streaming.progress import rocks_db
from .registry import query
from .tables import table

# ---- alignment by files -----------------------------------------------------------------------------------

#: Turns that one file of words holds.
_TURNS = 2


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of whole conversations, turn by turn, numbered through: (doc_id, idx, text, number of the file)."""
    c = table(spark, d, "conversations").where("text is not null")
    each = c.select("conv_id", "turn", F.posexplode(Q.split_sentences_col("text")).alias("k", "text"))
    each = each.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "k", "text"))).alias("a"))
    each = each.select(F.col("conv_id").alias("doc_id"), F.posexplode("a").alias("idx", "s"))
    return each.select("doc_id", "idx", F.col("s.text").alias("text"), F.floor(F.col("s.turn") / _TURNS).cast("int").alias("number"))


def _deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Words of two turns each as a file, 0.4 s a word; each 37th is misheard, and so are two whole sentences of every third conversation, which knows the ends of its files."""
    s = _sentences(spark, d)
    lost = (F.col("doc_id") % 3 == 0) & F.col("idx").isin(2, 3)
    w = s.select("doc_id", "idx", "number", lost.alias("lost"), F.posexplode(F.filter(F.split("text", r"\s+", -1), lambda x: x != "")).alias("k", "w"))
    w = w.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "k", "w", "number", "lost"))).alias("a")).select("doc_id", F.posexplode("a").alias("pos", "x"))
    text = F.when(F.col("x.lost"), "bzz").when(F.col("pos") % 37 == 5, F.reverse("x.w")).otherwise(F.col("x.w"))
    w = w.select("doc_id", F.col("x.number").alias("number"), F.struct("pos", text.alias("text"), (F.col("pos") * 0.4).alias("s"), (F.col("pos") * 0.4 + 0.35).alias("e")).alias("w"))
    f = w.groupBy("doc_id", "number").agg(F.array_sort(F.collect_list("w")).alias("w"))
    ends = s.groupBy("doc_id", "number").agg((F.max("idx") + 1).alias("chunk_end"))
    f = f.join(ends, ["doc_id", "number"])
    ms = lambda x: F.round(x * 1000).cast("bigint")
    return f.select(
        "doc_id", "number", F.lit(0).alias("version"), F.concat(F.lit("file"), "number").alias("source"), ms(F.col("w")[0]["s"]).alias("start_ms"), ms(F.element_at("w", -1)["e"]).alias("end_ms"),
        F.when(F.col("doc_id") % 3 == 0, F.col("chunk_end")).alias("chunk_end"), F.col("w.text").alias("texts"), F.col("w.s").alias("starts"), F.col("w.e").alias("ends"),
    )


@query("align_files")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation aligned file by file; anchors, gaps and rests where a file's end is known."""
    return L.align_files(_sentences(spark, d), _deliveries(spark, d))


@query(
    "align_invariants",
    """SELECT 0::BIGINT AS before_previous, 0::BIGINT AS backwards, 0::BIGINT AS too_short, 0::BIGINT AS known_ends_missed, true AS most_settled, count(DISTINCT conv_id) AS documents FROM conversations WHERE text IS NOT NULL""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Rows of align_files that start before the previous end, end before they start, or are matched with less than 200 ms; sentences of files with known ends that have no time; whether nine of ten sentences have one."""
    from pyspark.sql import Window

    s = _sentences(spark, d)
    a = L.align_files(s, _deliveries(spark, d)).where("start_ms is not null")
    a = s.select("doc_id", "idx").join(a, ["doc_id", "idx"], "left")
    a = a.withColumn("before", F.max("end_ms").over(Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)))
    return a.agg(
        F.count_if(F.col("start_ms") < F.col("before")).alias("before_previous"),
        F.count_if(F.col("end_ms") < F.col("start_ms")).alias("backwards"),
        F.count_if((F.col("how") == "match") & (F.col("end_ms") - F.col("start_ms") < 200)).alias("too_short"),
        F.count_if((F.col("doc_id") % 3 == 0) & F.col("start_ms").isNull()).alias("known_ends_missed"),
        (F.count("start_ms") * 10 >= F.count("*") * 9).alias("most_settled"),
        F.count_distinct("doc_id").alias("documents"),
    )


@query("stream_alignment")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The rows of align_files from a stream: files come in batches out of turn, with a restart before each and one batch a second time."""
    base = files.scratch(spark, "stream")
    _deliveries(spark, d).write.parquet(f"{base}/all")
    every = spark.read.parquet(f"{base}/all")
    sentences = _sentences(spark, d).select("doc_id", "idx", "text")
    with rocks_db(spark):
        for part in ("number < 2", "number > 2", "number = 2", "number = 2"):
            every.where(part).write.mode("append").parquet(f"{base}/in")
            stream = align_stream(spark.readStream.schema(every.schema).parquet(f"{base}/in"), sentences)
            stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return latest_revision(spark.read.parquet(f"{base}/out"))


# ---- sinks ------------------------------------------------------------------------------------------------


@query(
    "upsert_sink",
    """SELECT user_id, event_type, arg_max(event_id, event_id) AS last_event, arg_max(value, event_id) AS value FROM events GROUP BY ALL HAVING arg_max(event_id, event_id) % 7 <> 0""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user and kind by commits out of order, one of them twice; every seventh event deletes its key."""
    t = VersionedTable(spark, f"{files.scratch(spark, 'sink')}/t", ["user_id", "event_type"], ["last_event"])
    e = table(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("last_event"), "value", (F.col("event_id") % 7 == 0).alias("gone"))
    for number, part in enumerate((2, 0, 1)):
        t.merge(e.where(F.col("last_event") % 3 == part), gone="gone", writer="events", number=number)
    t.merge(e.where("last_event % 3 = 1"), gone="gone", writer="events", number=2)
    return t.read().select("user_id", "event_type", "last_event", "value")


@query("sink_transcript", "SELECT conv_id, turn, role, text FROM conversations")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A transcript that grows by commits: its first turns, then all of them with the first ones again."""
    t = VersionedTable(spark, f"{files.scratch(spark, 'sink')}/t", ["conv_id", "turn"], ["turn"], parts=4)
    c = table(spark, d, "conversations")
    t.merge(c.where("turn < 2").withColumn("text", F.lit("draft")), number=0)
    t.merge(c, number=1)
    return t.read().select("conv_id", "turn", "role", "text")


#: Folders that documents are written to: a few thousand files each at some gigabytes.
_FOLDERS = 256


def _written(spark: SparkSession, d: str) -> str:
    """Every document as a file; those that no label says anything of, as files of errors. The folder."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality").dropDuplicates(["doc_id"]), "doc_id", "left")
    path = f"{files.scratch(spark, 'sink')}/d"
    name = F.concat(F.coalesce("source", F.lit("none")), F.lit("-part"), "doc_id")
    error = F.when(F.col("quality").isNull(), F.concat(F.lit("no label: "), F.coalesce("lang", F.lit("?"))))
    DS.write_documents(docs.select(name.alias("name"), F.to_json(F.struct("doc_id", "lang", "quality", "n_chars")).alias("body"), error.alias("error")), path, folders=_FOLDERS)
    return path


@query(
    "ok_failed_sinks",
    """SELECT CASE WHEN l.doc_id IS NULL THEN 'failed' ELSE 'ok' END AS status, count(*) AS n, sum(CASE WHEN l.doc_id IS NULL THEN NULL ELSE n_chars END)::BIGINT AS chars,
      min(CASE WHEN l.doc_id IS NULL THEN 'no label: ' || coalesce(lang, '?') END) AS first_error FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Files of documents and of errors, read again."""
    path = _written(spark, d)
    ok, failed = DS.read_documents(spark, path, ["n_chars"]), DS.read_documents(spark, path, errors=True)
    both = ok.withColumn("status", F.lit("ok")).unionByName(failed.withColumn("status", F.lit("failed")))
    chars = F.get_json_object("body", "$.n_chars").cast("bigint")
    return both.groupBy("status").agg(F.count("*").alias("n"), F.sum(chars).alias("chars"), F.min("error").alias("first_error"))


@query(
    "files_ready",
    """SELECT coalesce(source, 'none') AS dir, count(*) AS n, count(*) FILTER (WHERE l.doc_id IS NULL) AS failed, count(*) FILTER (WHERE l.doc_id IS NULL) = 0 AS ready,
      md5(string_agg(coalesce(source, 'none') || '-part' || d.doc_id || CASE WHEN l.doc_id IS NULL THEN '.error.json' ELSE '.json' END, ',' ORDER BY d.doc_id)) AS names FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """A folder as listed: files of each source in natural order, and whether none is a file of errors."""
    f = files.with_names(DS.list_documents(spark, _written(spark, d))).where("ext = '.json' and not startswith(file_name, '_')")
    f = f.select(F.regexp_extract("file_name", "^(.*)-part", 1).alias("dir"), F.struct(S.natural_key(F.col("file_name")).alias("key"), "file_name").alias("f"), F.endswith("file_name", F.lit(DS.ERROR_ENDING)).alias("bad"))
    by = f.groupBy("dir").agg(F.count("*").alias("n"), F.count_if("bad").alias("failed"), F.array_sort(F.collect_list("f")).alias("f"))
    return by.select("dir", "n", "failed", (F.col("failed") == 0).alias("ready"), F.md5(F.array_join(F.col("f.file_name"), ",")).alias("names"))


# ---- folds ------------------------------------------------------------------------------------------------

_EDITED = """n AS (SELECT DISTINCT user_id AS graph, (event_id % 9)::VARCHAR AS id FROM events),
e AS (SELECT user_id AS graph, (event_id % 9)::VARCHAR AS to_id, event_type AS input, arg_min((event_id % 7)::VARCHAR, event_id) AS from_id FROM events GROUP BY ALL),
g AS (SELECT graph, (max(id::BIGINT) + 1)::VARCHAR AS fresh, bool_or(id = '8') AS has8, bool_or(id = '5') AS has5, bool_or(id = '4') AS has4, bool_or(id = '3') AS has3 FROM n GROUP BY graph),
h AS (SELECT *, fresh = '8' AS clash FROM g)"""


@query(
    "graph_fold",
    f"""WITH {_EDITED}
    SELECT n.graph, 'node' AS item, id, CASE WHEN id = '5' THEN 'again' ELSE 'node' END AS kind, NULL AS to_id, NULL AS input, NULL AS from_id, NULL::INT AS output, NULL::INT AS n, NULL AS message FROM n WHERE id <> '4'
    UNION ALL SELECT graph, 'node', fresh, 'new', NULL, NULL, NULL, NULL, NULL, NULL FROM h WHERE NOT clash
    UNION ALL SELECT graph, 'node', '8', 'late', NULL, NULL, NULL, NULL, NULL, NULL FROM h WHERE NOT clash AND NOT has8
    UNION ALL SELECT graph, 'node', '5', 'again', NULL, NULL, NULL, NULL, NULL, NULL FROM h WHERE NOT has5
    UNION ALL SELECT e.graph, 'edge', NULL, NULL, to_id, input, from_id, 0, NULL, NULL FROM e JOIN h USING (graph) WHERE to_id <> '5' AND NOT (has4 AND (to_id = '4' OR from_id = '4')) AND NOT (to_id = '3' AND input = 'view' AND has3 AND NOT clash)
    UNION ALL SELECT graph, 'edge', NULL, NULL, fresh, 'click', '8', 2, NULL, NULL FROM h WHERE NOT clash
    UNION ALL SELECT graph, 'edge', NULL, NULL, '3', 'view', fresh, 3, NULL, NULL FROM h WHERE has3 AND NOT clash
    UNION ALL SELECT graph, 'error', NULL, NULL, NULL, NULL, NULL, NULL, 0, 'no such node: ' || fresh || ' (to)' FROM h
    UNION ALL SELECT graph, 'error', fresh, NULL, NULL, NULL, NULL, NULL, 1, 'no such ref: later' FROM h WHERE clash
    UNION ALL SELECT graph, 'error', CASE WHEN has8 THEN '8' END, NULL, NULL, NULL, NULL, NULL, 2, CASE WHEN has8 THEN 'node 8 exists' ELSE 'id 8 is reserved' END FROM h WHERE has8 OR clash
    UNION ALL SELECT graph, 'error', NULL, NULL, NULL, NULL, NULL, NULL, 4, 'no such node: 4 (id)' FROM h WHERE NOT has4
    UNION ALL SELECT graph, 'error', NULL, NULL, NULL, NULL, NULL, NULL, 5, CASE WHEN clash THEN 'no such node: ' || fresh || ' (from)' ELSE 'no such node: 3 (to)' END FROM h WHERE clash OR NOT has3""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Six edits of every user's graph, read from a table: a wire to a node not there yet, a reference to a later node, taken ids, overwriting, removal."""
    e = table(spark, d, "events")
    graph = F.col("user_id").alias("graph")
    to = (F.col("event_id") % 9).cast("string")
    nodes = e.select(graph, to.alias("id"), F.lit("node").alias("kind")).distinct()
    edges = e.groupBy(graph, to.alias("to_id"), F.col("event_type").alias("input")).agg(F.min_by((F.col("event_id") % 7).cast("string"), "event_id").alias("from_id"), F.lit(0).alias("output"))
    edits = [
        {"type": "connect", "to": "@fresh", "input": "view", "from": "1"},
        {"type": "add", "ref": "fresh", "kind": "new", "inputs": [("click", "@later", 2)]},
        {"type": "add", "ref": "later", "id": "8", "kind": "late"},
        {"type": "add", "id": "5", "kind": "again", "overwrite": True},
        {"type": "remove", "id": "4"},
        {"type": "connect", "to": "3", "input": "view", "from": "@fresh", "output": 3},
    ]
    fields = spark.createDataFrame([], G.ACTION).schema
    rows = [tuple({"graph": 0, "n": k, **a}.get(f.name) for f in fields) for k, a in enumerate(edits)]
    template = F.broadcast(spark.createDataFrame(rows, fields).drop("graph"))  # six rows
    actions = e.select(graph).distinct().join(template, F.lit(True))
    return G.graph_fold(nodes, edges, actions)


@query(
    "pick_exclusive",
    """WITH RECURSIVE s AS (SELECT l_orderkey AS k, l_linenumber, l_suppkey, l_partkey, CASE WHEN l_orderkey % 3 = 1 THEN l_linenumber ELSE least(l_linenumber, 3) END::BIGINT AS idx FROM lineitem),
    f AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY l_suppkey, l_partkey, l_linenumber) AS fid, l_linenumber::BIGINT AS idx FROM s WHERE NOT (k % 3 = 2 AND l_linenumber > 2)),
    u AS (SELECT k, list(fid ORDER BY fid) AS fs FROM f GROUP BY k),
    o AS (SELECT k, idx, min(fid) AS own FROM f GROUP BY ALL),
    p AS (SELECT s.k, s.idx, own, row_number() OVER (PARTITION BY s.k ORDER BY l_linenumber, l_suppkey, l_partkey) AS n, bool_and(own IS NOT NULL) OVER (PARTITION BY s.k) AS direct, coalesce(fs, []) AS fs
      FROM s LEFT JOIN o ON o.k = s.k AND o.idx = s.idx LEFT JOIN u ON u.k = s.k),
    r AS (
      SELECT k, 0::BIGINT AS n, []::BIGINT[] AS used, NULL::BIGINT AS picked, '' AS how FROM (SELECT DISTINCT k FROM p)
      UNION ALL
      SELECT p.k, p.n, CASE WHEN x IS NULL THEN used ELSE list_append(used, x) END, x, CASE WHEN x IS NULL THEN 'missing' WHEN p.direct AND NOT list_contains(used, own) THEN 'direct' ELSE 'next' END
      FROM (SELECT p.*, r.used, CASE WHEN p.direct AND NOT list_contains(r.used, own) THEN own ELSE list_filter(fs, lambda y: NOT list_contains(r.used, y))[1] END AS x FROM r JOIN p ON p.k = r.k AND p.n = r.n + 1) p)
    SELECT k AS l_orderkey, n, picked, how FROM r WHERE n > 0""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Lines choose files of their order's lines: each its own one, or the next that is free; some orders have too few."""
    from pyspark.sql import Window

    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey")).cast("bigint")
    idx = F.when(F.col("l_orderkey") % 3 == 1, F.col("l_linenumber")).otherwise(F.least("l_linenumber", F.lit(3))).cast("bigint")
    segments = l.select("l_orderkey", n.alias("n"), idx.alias("idx"))
    fid = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_suppkey", "l_partkey", "l_linenumber")).cast("bigint")
    stills = l.where("not (l_orderkey % 3 = 2 and l_linenumber > 2)").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("idx"), fid.alias("fid"))
    return K.pick_exclusive(segments, stills, ["l_orderkey"], index="idx", order=["n"], file_index="idx", file_id="fid", file_order=["fid"]).select("l_orderkey", "n", "picked", "how")


# ---- table functions --------------------------------------------------------------------------------------


@query(
    "table_function_batches",
    """WITH RECURSIVE s AS (SELECT l_orderkey AS k, l_quantity::BIGINT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem),
    r AS (
      SELECT k, n, q, 0::BIGINT AS batch, 0::BIGINT AS place, 0::BIGINT AS carried, q AS total FROM s WHERE n = 1
      UNION ALL
      SELECT s.k, s.n, s.q, CASE WHEN r.total >= 60 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.total >= 60 THEN 0 ELSE r.place + 1 END,
        CASE WHEN r.total >= 60 THEN r.total % 60 ELSE r.carried END, CASE WHEN r.total >= 60 THEN r.total % 60 ELSE r.total END + s.q FROM r JOIN s ON s.k = r.k AND s.n = r.n + 1)
    SELECT k AS l_orderkey, n, batch, place, carried FROM r""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order in batches of sixty pieces, what is above them carried on, by a table function in SQL."""
    from pyspark.sql import Window

    U.register(spark)
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("bigint")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("q"))
    lines = A.dealt(lines, "l_orderkey").select("l_orderkey", n.alias("n"), "q").sortWithinPartitions("l_orderkey", "n")
    return spark.sql("SELECT key AS l_orderkey, n, batch, place, carried FROM batch_groups(TABLE(SELECT * FROM {lines}), 60)", lines=lines)


_NESTED = """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, text AS value FROM conversations WHERE text IS NOT NULL"""


def _nested(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as bodies whose texts lie at different depths."""
    c = table(spark, d, "conversations").where("text is not null")
    deep = F.when(F.col("turn") % 2 == 0, F.parse_json(F.to_json(F.struct(F.col("text").alias("textForVoiceover"), F.col("role")))))
    deep = deep.otherwise(F.parse_json(F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("textForVoiceover")).alias("textForVoiceover"), "turn")).alias("parts"), F.struct(F.lit("no").alias("text")).alias("x")))))
    turns = c.select("conv_id", "turn", F.to_json(deep).alias("t")).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda s: s.t), ",").alias("t"))
    return turns.select("conv_id", F.concat(F.lit('{"meta": {"id": 1, "list": [[]]}, "turns": ['), "t", F.lit("]}")).alias("body"))


@query("table_function_harvest", _NESTED)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Every text of a conversation's body at any depth, by a table function in SQL."""
    U.register(spark)
    return spark.sql("SELECT conv_id, CAST(pos AS BIGINT) AS pos, value FROM harvest_items(TABLE(SELECT conv_id, body FROM {t}), 'textForVoiceover')", t=_nested(spark, d))


@query("deep_field_harvest", _NESTED.replace("AS value", "AS text"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """The same by a recursion over the bodies' levels, without Python."""
    return files.harvest(_nested(spark, d), "conv_id", "body", "textForVoiceover").select("conv_id", "pos", F.col("value").alias("text"))
