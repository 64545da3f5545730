"""Text, identity, harvest, alignment and streaming queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fuzzy, scalars as S, sequences as Q, text as X
from ..functions.sequences import _words, coalesce_short, resegment, split_sentences
from ..operators import alignment as A
from ..operators import dataflow as D
from ..operators.alignment import map_orders
from ..sources import files, pages as P
from ..streaming.progress import stream_progress
from .registry import query
from .tables import IV, intervals, table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang")


_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_SQUEEZE = "trim(regexp_replace({}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


def _squeezed(c: str) -> str:
    return _SQUEEZE.format(c)


#: Spelt in ASCII, for the Latin letters that the documents have.
_ASCII = "regexp_replace(replace(replace(replace(strip_accents(lower(text)), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae'), '[^\\x00-\\x7F]', '', 'g')"


def _ascii(c):
    return Q.transliterate_col(F.lower(c))


@query("norm_text", f"SELECT doc_id, {_squeezed(_ASCII)} AS norm FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", X.norm_text(_ascii(F.col("text"))).alias("norm"))


@query("tokenize", f"SELECT doc_id, len(w) AS n, array_to_string(w[1:5], ' ') AS head FROM (SELECT doc_id, regexp_extract_all({_ASCII}, '[a-z0-9_''\\-]+') AS w FROM documents)")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = _docs(spark, d).select("doc_id", X.tokenize(_ascii(F.col("text"))).alias("w"))
    return t.select("doc_id", F.size("w").cast("bigint").alias("n"), F.array_join(F.slice("w", 1, 5), " ").alias("head"))


@query("compact_text", "SELECT doc_id, md5(regexp_replace(lower(text), '[^0-9a-z]', '', 'g')) AS compact_md5 FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(X.compact(F.col("text"))).alias("compact_md5"))


def _odd(c):
    """A text with typographic marks to clean."""
    return F.concat(F.lit("«"), F.replace(F.replace(c, F.lit(","), F.lit(" —")), F.lit("."), F.lit("…")), F.lit("”  ....."))


_ODD = "('«' || replace(replace(text, ',', chr(160) || '—'), '.', '…') || '”  .....')"


@query("sanitize_text", f"""SELECT doc_id, {_squeezed(f"regexp_replace(replace(translate({_ODD}, '«”—' || chr(160), '''\"- '), '…', '...'), '\\.{{4,}}', '...', 'g')")} AS clean FROM documents""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", X.sanitize(_odd(F.col("text"))).alias("clean"))


_LINE = "trim(regexp_replace(replace(replace(regexp_replace(replace({}, '\\', ''), '[\\x00-\\x1F\\x7F]', ' ', 'g'), chr(160), ' '), '\"', ''''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


@query("sanitize_line", f"SELECT doc_id, {_LINE.format(_ODD)} AS line FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", X.sanitize_line(_odd(F.col("text"))).alias("line"))


@query("sanitize_multiline", f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_LINE.format('x')}), lambda x: x <> ''), chr(10)) AS lines FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", X.sanitize_multiline(F.col("text")).alias("lines"))


@query(
    "safe_name",
    f"""WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace({_LINE.format("text")}, '[<>:"/\\\\|?*]', '_', 'g'), '\\s+', '_', 'g'), '\\.+$', ''), '_+', '_', 'g') AS n FROM documents)
    SELECT doc_id, coalesce(nullif(trim(left(trim(n, '_'), 120), '_'), ''), 'video') AS name FROM s""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", X.safe_name(F.col("text")).alias("name"))


_TAGGED = "('[narration] ' || text || ' [end')"


def _tagged(c):
    return F.concat(F.lit("[narration] "), c, F.lit(" [end"))


@query("strip_tags", f"SELECT doc_id, {_squeezed(f'''regexp_replace({_TAGGED}, '\\[[^\\]\\[]*\\]', '', 'g')''')} AS plain FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", X.strip_tags(_tagged(F.col("text"))).alias("plain"))


@query("clean_prompt", f"SELECT doc_id, rtrim(left({_squeezed(f'''regexp_replace({_TAGGED}, '\\[[^\\]\\[]*\\]', '', 'g')''')}, 80)) AS prompt FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", X.clean_prompt(_tagged(F.col("text")), 80).alias("prompt"))


@query("split_sentences")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.posexplode(Q.split_sentences_col("text")).alias("pos", "sentence"))


@query("hard_split")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.posexplode(X.hard_split(F.col("text"))).alias("pos", "sentence"))


@query("balanced_chunks")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.posexplode(Q.balanced_chunks_col(F.col("text"), 400)).alias("pos", "chunk"))


_MERGED = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("rows", T.IntegerType())]))


def _coalesced(least: int, bucketed: bool):
    @F.pandas_udf(_MERGED)
    def run(texts: pd.Series, buckets: pd.Series) -> pd.Series:
        merge = lambda t, b: [{"text": x, "rows": n} for x, n in coalesce_short(list(t), least, buckets=list(b) if bucketed else None)]
        return pd.Series([merge(t, b) for t, b in zip(texts, buckets, strict=True)])

    return run


def _turns(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", "role"))).alias("a"))
    return c.select("conv_id", F.col("a.text").alias("texts"), F.col("a.role").alias("roles"))


@query("coalesce_short")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = _turns(spark, d).select("conv_id", F.posexplode(_coalesced(120, False)("texts", "roles")).alias("pos", "r"))
    return c.select("conv_id", "pos", "r.text", "r.rows")


@query("coalesce_short_bucketed")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = _turns(spark, d).select("conv_id", F.posexplode(_coalesced(120, True)("texts", "roles")).alias("pos", "r"))
    return c.select("conv_id", "pos", "r.text", "r.rows")


def merge_text_parts(parts, least: int):
    """For each part (n, chunk) the carrier it is merged into: parts of the carrier's chunk join while it is shorter than ``least`` or they are themselves."""
    joins = lambda s, p: (F.size(s["at"]) > 0) & s["chunk"].eqNullSafe(p["chunk"]) & ((s["total"] < least) | (p["n"] < least))
    step = lambda s, p: F.when(joins(s, p), F.struct((s["total"] + p["n"]).alias("total"), s["carrier"].alias("carrier"), s["chunk"].alias("chunk"), F.concat(s["at"], F.array(s["carrier"])).alias("at"))).otherwise(
        F.struct(p["n"].alias("total"), F.size(s["at"]).alias("carrier"), p["chunk"].alias("chunk"), F.concat(s["at"], F.array(F.size(s["at"]))).alias("at"))
    )
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("carrier"), F.lit(None).cast("bigint").alias("chunk"), F.array().cast("array<int>").alias("at"))
    return F.aggregate(parts, start, step, lambda s: s["at"])


@query(
    "merge_text_parts",
    """WITH RECURSIVE p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, turn // 5 AS chunk, length(trim(text)) AS n FROM conversations),
    r AS (SELECT conv_id, i, i AS carrier, chunk, n AS total FROM p WHERE i = 0
      UNION ALL SELECT p.conv_id, p.i, CASE WHEN p.chunk = r.chunk AND (r.total < 150 OR p.n < 150) THEN r.carrier ELSE p.i END, p.chunk,
        CASE WHEN p.chunk = r.chunk AND (r.total < 150 OR p.n < 150) THEN r.total + p.n ELSE p.n END FROM r JOIN p ON p.conv_id = r.conv_id AND p.i = r.i + 1)
    SELECT conv_id, i::BIGINT AS pos, carrier::BIGINT AS merged_into, carrier <> i AS placeholder FROM r""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations").select("conv_id", "turn", F.struct(F.length(F.trim("text")).alias("n"), F.floor(F.col("turn") / 5).cast("bigint").alias("chunk")).alias("part"))
    parts = t.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"]).alias("parts"))
    c = parts.select("conv_id", F.posexplode(merge_text_parts(F.col("parts"), 150)).alias("pos", "at"))
    return c.select("conv_id", F.col("pos").cast("bigint").alias("pos"), F.col("at").cast("bigint").alias("merged_into"), (F.col("at") != F.col("pos")).alias("placeholder"))


@query(
    "slice_on_boundaries",
    """WITH p AS (SELECT conv_id, turn, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM conversations WHERE text <> ''),
    s AS (SELECT *, unnest(range((a // 256)::BIGINT, ((a + n - 1) // 256)::BIGINT + 1)) AS chunk FROM p)
    SELECT conv_id, turn, chunk, substring(c.text, (greatest(a, chunk * 256) - a)::BIGINT + 1, (least(a + n, (chunk + 1) * 256) - greatest(a, chunk * 256))::BIGINT) AS piece FROM s JOIN conversations c USING (conv_id, turn)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.intervals import prefix_starts

    c = table(spark, d, "conversations").where("text <> ''").withColumn("n", F.length("text").cast("bigint"))
    c = prefix_starts(c, ["conv_id"], ["turn"], "n", "a")
    c = c.withColumn("chunk", F.explode(F.sequence(F.expr("a div 256"), F.expr("(a + n - 1) div 256"))))
    lo, hi = F.greatest("a", F.col("chunk") * 256), F.least(F.col("a") + F.col("n"), (F.col("chunk") + 1) * 256)
    return c.select("conv_id", "turn", "chunk", F.substring(F.col("text"), (lo - F.col("a") + 1).cast("int"), (hi - lo).cast("int")).alias("piece"))


@query("sentence_boundaries")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.explode(Q.sentence_boundaries_col("text")).alias("at"))


@query("clip_stem", "SELECT doc_id, trim(regexp_replace(regexp_replace(replace(replace(regexp_replace(replace(replace(lower(s), '_clip_', '_'), '-clip-', '-'), '[_-]clip|clip_', '', 'g'), ' clip ', ' '), 'clip', ''), '_{2,}', '_', 'g'), '-{2,}', '-', 'g'), '_- ') AS stem FROM (SELECT doc_id, ['Scene_clip_', 'clip_', 'A-clip-', 'x clip '][doc_id % 4 + 1] || doc_id || '_Clip' AS s FROM documents)")
def _(spark: SparkSession, d: str) -> DataFrame:
    heads = F.array(*[F.lit(x) for x in ("Scene_clip_", "clip_", "A-clip-", "x clip ")])
    name = F.concat(F.get(heads, (F.col("doc_id") % 4).cast("int")), F.col("doc_id").cast("string"), F.lit("_Clip"))
    return _docs(spark, d).select("doc_id", X.clip_stem(name).alias("stem"))


@query("first_int", "SELECT p_partkey, TRY_CAST(nullif(regexp_extract(p_name || p_brand, '(\\d+)', 1), '') AS BIGINT) AS n FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", S.first_int(F.concat("p_name", "p_brand")).alias("n"))


_POWERS = ", ".join(str(26**k) for k in range(13, -1, -1))


@query("alpha_token", f"SELECT o_orderkey, right(t, greatest(4, length(ltrim(t, 'a')))::INT) AS token FROM (SELECT o_orderkey, array_to_string(list_transform([{_POWERS}]::BIGINT[], lambda p: chr((97 + o_orderkey // p % 26)::INT)), '') AS t FROM orders)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", S.alpha_token(F.col("o_orderkey")).alias("token"))


@query("stable_name", "SELECT doc_id, left(md5(lang || '|' || doc_id || '|' || source), 8) AS name FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", S.stable_name("lang", F.col("doc_id").cast("string"), F.col("source")).alias("name"))


_FNV = "list_reduce(list_prepend({}::BIGINT, list_transform(string_split(k, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


@query(
    "fnv_id",
    f"""WITH t AS (SELECT doc_id, source || '|' || lang || '|' || doc_id AS k FROM documents), h AS (SELECT doc_id, lpad(lower(to_hex({_FNV.format(2166136261)})), 8, '0') || lpad(lower(to_hex({_FNV.format(2166136261 ^ 0x9E3779B9)})), 8, '0') AS x FROM t)
    SELECT doc_id, x[1:4] || '-' || x[5:8] || '-' || x[9:12] || '-' || x[13:16] AS id FROM h""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", S.fnv_id("source", "lang", F.col("doc_id").cast("string")).alias("id"))


@query("pad_index", "SELECT o_orderkey, CASE WHEN length(o_orderkey::VARCHAR) >= 3 THEN o_orderkey::VARCHAR ELSE lpad(o_orderkey::VARCHAR, 3, '0') END AS name FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", S.pad_index(F.col("o_orderkey"), 3).alias("name"))


@query(
    "url_id",
    """WITH u AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1) AS path FROM pages)
    SELECT page_id, coalesce(nullif(regexp_extract(url, '[?&]v=([a-zA-Z0-9_-]+)', 1), ''), 'video') AS own, coalesce(nullif(ltrim(path, '/'), ''), 'video') AS short, 'p' || page_id AS watch FROM u""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Every page's own URL, its path on a short host, and the URL with a field v."""
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]*/?([^?#]*)", 1)
    watch = F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("v=p"), F.col("page_id").cast("string"))
    urls = {"own": F.col("url"), "short": F.concat(F.lit("https://youtu.be/"), path), "watch": watch}
    return table(spark, d, "pages").select("page_id", *[S.url_id(u).alias(c) for c, u in urls.items()])


@query(
    "preview_candidates",
    """SELECT page_id, i AS place, CASE i WHEN 0 THEN og ELSE replace(['https://img.youtube.com/vi/#/maxresdefault.jpg', 'https://i.ytimg.com/vi/#/maxresdefault.jpg', 'https://i.ytimg.com/vi/#/sddefault.jpg', 'https://i.ytimg.com/vi/#/hqdefault.jpg', 'https://i.ytimg.com/vi_webp/#/maxresdefault.webp'][i::INT], '#', 'p' || page_id) END AS url
    FROM (SELECT page_id, nullif(regexp_extract(html, '<meta property="og:image" content="([^"]*)"', 1), '') AS og, unnest(range(0, 6)) AS i FROM pages) WHERE i > 0 OR og IS NOT NULL""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Pictures to try for every page, in order: the page's own one, then those of its id by quality."""
    p = table(spark, d, "pages").select("page_id", P.page_meta("html")["preview"].alias("preview"))
    each = P.preview_candidates(F.col("preview"), F.concat(F.lit("p"), F.col("page_id").cast("string")))
    return p.select("page_id", F.inline(each)).select("page_id", F.col("place").cast("bigint").alias("place"), "url")


@query("page_meta")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", P.page_meta("html").alias("m")).select("page_id", "m.*")


@query(
    "caption_rows",
    f"""WITH t AS (SELECT conv_id, turn, {_squeezed("text || chr(10)")} AS text, turn * 61 AS s FROM conversations WHERE text IS NOT NULL)
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, lpad((s // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS timestamp, text FROM t WHERE text <> ''""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("a"))
    events = F.transform("a", lambda x: F.struct((x.turn * 61_000).alias("tStartMs"), F.array(F.struct(x.text.alias("utf8")), F.struct(F.lit("\n").alias("utf8"))).alias("segs")))
    return c.select("conv_id", F.posexplode(P.caption_rows(F.to_json(F.struct(events.alias("events"))))).alias("pos", "r")).select("conv_id", F.col("pos").cast("bigint").alias("pos"), "r.timestamp", "r.text")


@query("format_ts", f"""WITH {IV}, t AS (SELECT event_id, st // 1000 AS s FROM iv)
    SELECT event_id, CASE WHEN s // 3600 > 0 THEN CASE WHEN s // 3600 < 10 THEN '0' ELSE '' END || (s // 3600) || ':' ELSE '' END || lpad((s // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS ts FROM t""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return intervals(spark, d).select("event_id", S.clock(F.col("st")).alias("ts"))


@query("assemble_transcript", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumn("line", F.concat_ws(": ", "role", "text"))
    return D.collect_in_order(c, ["conv_id"], "turn", "line", "a").select("conv_id", F.array_join("a", "\n").alias("transcript"))


@query("infer_ext", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'webp' WHEN page_id % 3 = 1 THEN 'png' ELSE 'jpg' END AS ext FROM pages")
def _(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id") % 3
    return table(spark, d, "pages").select("page_id", S.infer_ext(F.when(i == 0, "https://x/y.WebP?z"), F.when(i == 1, "image/PNG")).alias("ext"))


# ---- files and JSON ---------------------------------------------------------------------------------------


@query("scan_media")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The tables' own files stand for media: every Parquet file under the folder."""
    return files.scan_media(spark, d, extensions=(".parquet",)).select("file_name", "size", F.array_join("natural", "|").alias("natural"))


@query(
    "decode_fallback",
    """SELECT doc_id, text AS as_utf8, CASE WHEN regexp_matches(text, '[À-ÿ]') THEN translate(regexp_replace(text, '[^\x00-\x7FÀ-ÿ]', '?', 'g'), 'ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ', 'АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯабвгдежзийклмнопрстуфхцчшщъыьэюя')
      ELSE regexp_replace(text, '[^\x00-\x7F]', '?', 'g') END AS as_fallback FROM documents""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Every text from its bytes in UTF-8, and from bytes of one for each letter, which are no UTF-8 where a letter has an accent."""
    single = F.encode(F.regexp_replace("text", "[^\\x00-\\x7FÀ-ÿ]", "?"), "iso-8859-1")
    return _docs(spark, d).select("doc_id", X.decode_fallback(F.col("text").cast("binary")).alias("as_utf8"), X.decode_fallback(single).alias("as_fallback"))


@query("tasks_from_b64", "SELECT page_id, trim(url) AS url, CASE WHEN page_id % 2 = 0 THEN 'top' ELSE '' END AS label FROM pages WHERE trim(url) <> ''")
def _(spark: SparkSession, d: str) -> DataFrame:
    body = F.to_json(F.array(F.struct(F.col("url"), F.lit("top").alias("label"))))
    raw = F.when(F.col("page_id") % 2 == 0, F.base64(body.cast("binary"))).otherwise(F.concat(F.lit('["'), F.col("url"), F.lit('"]')))
    return table(spark, d, "pages").select("page_id", F.inline(files.tasks_from_text(raw)))


@query("sink_progress", "SELECT count(*) AS items, count(DISTINCT conv_id) AS files FROM conversations")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A transcript with its progress beside it; what the progress says, read again."""
    c = table(spark, d, "conversations")
    meta = c.agg(F.count("*").alias("items"), F.countDistinct("conv_id").alias("files"), F.sum("turn").alias("processed_audio_totals"))
    return spark.read.schema("items bigint, files bigint").json(files.write_with_progress(c, meta, f"{files.scratch(spark, 'sink')}/t"))


# ---- alignment --------------------------------------------------------------------------------------------


@query("fuzzy_score")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Every turn's whole text against that of the turn before it."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    t = table(spark, d, "conversations").select("conv_id", "turn", X.norm_text("text").alias("a"), X.norm_text(F.coalesce(before, F.lit(""))).alias("b"))
    t = t.repartition(2 * spark.sparkContext.defaultParallelism, "conv_id", "turn")  # few bytes, much work
    return t.select("conv_id", "turn", fuzzy.best_score_col("a", "b").alias("score"))


def _alignment(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation aligned to words made from it, each 37th of them misheard."""
    docs = _turns(spark, d).select(F.col("conv_id").alias("doc_id"), F.array_join("texts", "\n").alias("text"))
    words = A.timed_words(docs).withColumn("text", F.when(F.col("pos") % 37 == 5, F.reverse("text")).otherwise(F.col("text")))
    sentences = docs.select("doc_id", F.posexplode(Q.split_sentences_col("text")).alias("idx", "text"))
    return A.align_words(sentences, words)


@query("align_words")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _alignment(spark, d)


@query("map_orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Which turn of a conversation each of its sentences comes from."""
    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("sentence", T.StringType()), T.StructField("order", T.LongType())])))
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for ts in texts:
            sentences = [s for t in ts for s in split_sentences(t)]
            orders = map_orders([_words(s) for s in sentences], [(k, _words(t)) for k, t in enumerate(ts)])
            out.append([{"sentence": s, "order": o} for s, o in zip(sentences, orders, strict=True)])
        return pd.Series(out)

    return _turns(spark, d).select("conv_id", F.posexplode(run("texts")).alias("pos", "r")).select("conv_id", "pos", "r.*")


@query("approx_timings")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = _turns(spark, d).withColumn("weights", F.transform("texts", lambda t: F.greatest(F.length(F.trim(t)), F.lit(1))))
    total = F.aggregate("weights", F.lit(0), lambda a, w: a + w) * 60
    c = c.select("conv_id", Q.weighted_durations_col(total, F.col("weights"), F.lit(200)).alias("ms"))
    c = c.select("conv_id", F.posexplode("ms").alias("pos", "ms"))
    from ..operators.intervals import prefix_starts

    return prefix_starts(c, ["conv_id"], ["pos"], "ms", "start_ms").select("conv_id", "pos", "start_ms", (F.col("start_ms") + F.col("ms")).alias("end_ms"))


@query("weighted_durations")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q")))).alias("a"))
    return o.select("l_orderkey", F.posexplode(Q.weighted_durations_col((F.col("l_orderkey") % 5000).cast("int"), F.col("a.q"), F.lit(200))).alias("pos", "ms"))


@query("fit_slots")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("bigint").alias("q")))).alias("a"))
    return o.select("l_orderkey", F.posexplode(Q.fit_slots_col(F.col("a.q"), F.lit(4))).alias("pos", "frames"))


@query("resegment")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation, 60 ms a character, as parts of 3 to 8 seconds."""
    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("ms", T.LongType())])))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"text": t, "ms": m} for t, m in resegment([(t, 60 * len(t)) for t in ts], 3000, 8000)] for ts in texts])

    return _turns(spark, d).select("conv_id", F.posexplode(run("texts")).alias("pos", "r")).select("conv_id", "pos", "r.*")


# ---- streaming --------------------------------------------------------------------------------------------


@query("stream_progress", "SELECT user_id, count(*) AS rows, max(event_id) AS last_event, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    return stream_progress(spark, f"{d}/events.parquet")
