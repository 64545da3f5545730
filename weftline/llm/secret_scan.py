"""Secrets in texts: fixed patterns, and random-looking tokens by two Markov models of characters.

One model gives the probability of a token's characters, each by the one
before it, among random strings, the other among ordinary identifiers; a token
whose log-likelihood ratio is high enough is random. Both are counted from
labelled samples. Everything is JVM expressions: a text is scanned where
it is read, nothing is shuffled but the counts of the models.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names

#: The kinds in their order, their patterns, and characters of what counts (of group 2 for assign) at least.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Tokens that the models score: whole runs of these characters, no letter or digit beside them.
TOKEN = r"(?<![\p{L}\p{N}])[A-Za-z0-9+/_-]{%d,}+={0,2}(?![\p{L}\p{N}])"
#: Characters of a scored token at least.
TOKEN_CHARS = 16
#: Log-likelihood ratio from which a token is random: e^10 against the rarity of secrets among tokens.
LEAST_LLR = 10.0
#: Bounds of the labelled sample: documents whose tokens are ordinary, and random strings of each alphabet.
SAMPLE_DOCS, SAMPLE_RANDOM = 20_000, 2_000
#: Alphabets of random strings: hex of either case, base 32 and 36, base 62, base 64 of both kinds.
_AZ, _az, _09 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = (_09 + "abcdef", _09 + "ABCDEF", _AZ + "234567", _AZ + _09, _az + _09, _AZ + _az + _09, _AZ + _az + _09 + "+/", _AZ + _az + _09 + "-_")
_RANDOM_CHARS = 24
#: States of a model: the code points "+" to "z", and the start.
_FIRST, _STATES = ord("+"), ord("z") - ord("+") + 1
_CHUNK = 128


def _chars(token):
    return F.array_remove(F.split(token, ""), "")


def _state(c):
    return F.ascii(c) - _FIRST


def _pairs(token):
    """(state before, state) of each character of a token; the first one's before is the start."""
    chars = _chars(token)
    return F.arrays_zip(F.concat(F.array(F.lit("")), chars).alias("before"), chars.alias("now"))


def random_strings(spark: SparkSession, n: int = SAMPLE_RANDOM, seed: int = 0) -> DataFrame:
    """(value, random) of ``n`` strings for each alphabet, each character drawn by a hash: the same at every call."""
    draw = lambda a, k: F.substring(F.lit(a), F.pmod(F.xxhash64("id", F.lit(f"{seed}:{a}"), F.lit(k)), F.lit(len(a))).cast("int") + 1, F.lit(1))
    each = F.array(*[F.concat(*[draw(a, k) for k in range(_RANDOM_CHARS)]) for a in ALPHABETS])
    return spark.range(n).select(F.explode(each).alias("value"), F.lit(True).alias("random"))


def labelled_samples(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_random: int = SAMPLE_RANDOM) -> DataFrame:
    """(value, random): what the patterns find and drawn strings as random ones, the other tokens as ordinary identifiers.

    About ``sample_docs`` documents are read for it, those whose id's hash is
    lowest; rows are counted over all. Texts are read whole.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    share = sample_docs / max(1, rows.count())
    u = F.xxhash64(F.coalesce("id", F.lit("")), F.lit("secret sample")).bitwiseAND(F.lit(0xFFFFFFFF)).cast("double") / F.lit(2.0**32)
    rows = _base(rows.where(u < share), "text", "m")
    # values of assignments may be anything, so they teach neither model
    fixed = F.concat(F.col("m_access.text"), F.col("m_hex.text"))
    every = rows.select(F.explode(F.concat(F.transform(fixed, lambda v: F.struct(v.alias("value"), F.lit(True).alias("random"))), F.transform(F.regexp_extract_all("m_left", F.lit(TOKEN % 4), F.lit(0)), lambda v: F.struct(v.alias("value"), F.lit(False).alias("random"))))).alias("s"))
    return every.select("s.*").unionByName(random_strings(docs.sparkSession, sample_random))


@dataclass
class Models:
    """Log-likelihood ratios of each character after each other one, random against ordinary, row by row."""

    ratios: list[float]

    def score(self, token):
        """The ratio of a whole token: a column expression."""
        table = F.split(F.lit(",".join(f"{x:.6f}" for x in self.ratios)), ",").cast("array<double>")
        chars = _chars(token)
        before = F.concat(F.array(F.lit("")), chars)
        at = lambda a, b: F.when(a == "", _STATES).otherwise(_state(a)) * _STATES + _state(b)
        each = F.zip_with(F.slice(before, F.lit(1), F.size(chars)), chars, lambda a, b: F.coalesce(F.get(table, at(a, b)), F.lit(0.0)))
        return F.aggregate(each, F.lit(0.0), lambda total, x: total + x)


def fit_models(samples: DataFrame, *, smooth: float = 0.5) -> Models:
    """Models from rows (value, random); values that are null or hold other characters than a token's are left out.

    What comes to the driver are counts of pairs of characters: 12,960 at
    most, however many samples there are. Without samples every ratio is 0.
    """
    rows = samples.where(F.col("value").rlike(r"\A[A-Za-z0-9+/_=-]+\z") & F.col("random").isNotNull())
    each = rows.select("random", F.explode(_pairs(F.col("value"))).alias("p")).where("p.now is not null")
    before = F.when(F.col("p.before") == "", _STATES).otherwise(_state(F.col("p.before")))
    counts = each.groupBy("random", before.alias("a"), _state(F.col("p.now")).alias("b")).count().collect()
    by = {True: [[smooth] * _STATES for _ in range(_STATES + 1)], False: [[smooth] * _STATES for _ in range(_STATES + 1)]}
    for r in counts:
        by[r["random"]][r["a"]][r["b"]] += r["count"]
    log = {k: [[math.log(x / sum(row)) for x in row] for row in rows] for k, rows in by.items()}
    return Models([x - y for p, q in zip(log[True], log[False], strict=True) for x, y in zip(p, q, strict=True)])


def _running(sizes):
    """Sums of all entries before each: kept by chunks, so that an entry adds to a short array only."""
    last = lambda acc: F.element_at(acc["now"], -1)
    full = lambda acc: F.size(acc["now"]) >= _CHUNK
    step = lambda acc, x: F.struct(
        F.when(full(acc), F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
        F.when(full(acc), F.array(last(acc) + x)).otherwise(F.concat(acc["now"], F.array(last(acc) + x))).alias("now"),
    )
    begin = F.struct(F.array().cast("array<array<bigint>>").alias("done"), F.array(F.lit(0).cast("bigint")).alias("now"))
    return F.aggregate(sizes, begin, step, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["now"]))))


_SPAN = "array<struct<text:string,size:int,start:bigint,end:bigint>>"


def _spans(text, pattern: str, found, sizes):
    """Structs (text, size, start, end) of a pattern's matches, in code points, given the matches and what counts of each.

    What lies between the matches comes from a split at the pattern, so the
    place of each is a running sum of lengths.
    """
    gaps = F.split(text, pattern, -1)
    first = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: (F.length(g) + F.length(m)).cast("bigint"))
    ends = lambda sums: F.zip_with(sums, F.slice(gaps, F.lit(1), F.size(found)), lambda s, g: s + F.length(g))
    each = F.arrays_zip(found.alias("text"), sizes.alias("size"), ends(F.slice(_running(first), F.lit(1), F.size(found))).alias("start"))
    each = F.transform(each, lambda x: F.struct(x["text"].alias("text"), x["size"].cast("int").alias("size"), x["start"].alias("start"), (x["start"] + F.length(x["text"])).alias("end")))
    return F.when(F.size(found) > 0, each).otherwise(F.array().cast(_SPAN))


def _masked(text, pattern: str, found, least: int, sizes):
    """The text with blanks in place of the matches that count."""
    gaps = F.split(text, pattern, -1)
    kept = F.zip_with(found, sizes, lambda m, n: F.when(n >= least, F.repeat(F.lit(" "), F.length(m))).otherwise(m))
    each = F.zip_with(gaps, kept, lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))))
    return F.when(F.size(found) > 0, F.array_join(each, "")).otherwise(text)


def _base(rows: DataFrame, text_col: str, mark: str) -> DataFrame:
    """``mark``_assign, _access and _hex: spans of the patterns' matches that count; ``mark``_left: the text without them."""
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
    # a run too short to count needs no match of its own, and none of these can overlap a longer one
    patterns["access"] = ACCESS[:-1] + "{16,}"
    patterns["hex"] = HEX[:-1] + "{24,}"
    got = {k: f"{mark}_got_{k}" for k in patterns}
    sizes, left = f"{mark}_sizes", f"{mark}_left"
    extract = lambda p, group: F.regexp_extract_all(F.col(text_col), F.lit(p), F.lit(group))
    rows = rows.withColumns({got[k]: extract(p, 0) for k, p in patterns.items()})
    rows = rows.withColumn(sizes, F.when(F.size(got["assign"]) > 0, F.transform(extract(ASSIGN, 2), lambda v: F.length(v))).otherwise(F.array().cast("array<int>")))
    count = {k: F.col(sizes) if k == "assign" else F.transform(got[k], lambda m: F.length(m)) for k in patterns}
    long = lambda spans, n: F.filter(spans, lambda s: s["size"] >= n)
    spans = {f"{mark}_{k}": long(_spans(F.col(text_col), p, F.col(got[k]), count[k]), LEAST[k]) for k, p in patterns.items()}
    rows = rows.withColumns(spans).withColumn(left, _masked(F.col(text_col), ASSIGN, F.col(got["assign"]), LEAST["assign"], count["assign"]))
    # what an assignment covers is gone from the text; the others are looked for again in what is left
    for k in ("access", "hex"):
        again = F.regexp_extract_all(F.col(left), F.lit(patterns[k]), F.lit(0))
        rows = rows.withColumn(left, F.when(F.size(got[k]) > 0, _masked(F.col(left), patterns[k], again, 0, F.transform(again, lambda m: F.length(m)))).otherwise(F.col(left)))
    return rows.drop(*got.values(), sizes)


def scan_secrets(docs: DataFrame, models: Models, *, text_col: str = "text", token_chars: int = TOKEN_CHARS, least_llr: float = LEAST_LLR) -> DataFrame:
    """The rows of ``docs`` with ``secrets`` put last: (start, kind, end, llr) of every span, by start, then kind as listed.

    ``kind`` is the place in ``KINDS``. Spans of the fixed patterns are all
    there, whatever the models say; a token outside of them, of ``token_chars``
    characters or more, is added where its log-likelihood ratio is
    ``least_llr`` or more. Places are code points, the end exclusive; ``llr`` is null for patterns.

    Null and empty texts have no spans. Rows that repeat are rows of their
    own; no column but the text is looked at. An empty table gives no rows.
    Very long texts are scanned whole, in memory of the order of their matches.
    A column ``secrets`` of ``docs`` is replaced; no other name matters.
    """
    kept = [c for c in docs.columns if c != "secrets"]
    text_, m_, tok_ = free_names(docs, "text", "m", "tok")
    while any(c.lower().startswith(f"{m_}_") for c in docs.columns):
        m_ = f"_{m_}"
    rows = docs.select(*kept, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text_))
    rows = _base(rows, text_, m_)
    pattern = TOKEN % token_chars
    left = F.col(f"{m_}_left")
    rows = rows.withColumn(tok_, F.regexp_extract_all(left, F.lit(pattern), F.lit(0)))
    spans = _spans(left, pattern, F.col(tok_), F.transform(tok_, lambda m: F.length(m)))
    scored = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("kind"), s["end"].alias("end"), models.score(s["text"]).alias("llr")))
    added = F.filter(scored, lambda s: s["llr"] >= least_llr)
    span = lambda i: lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end"), F.lit(None).cast("double").alias("llr"))
    fixed = [F.transform(f"{m_}_{k}", span(i)) for i, k in enumerate(KINDS[:3])]
    return rows.select(*kept, F.array_sort(F.concat(*fixed, added)).alias("secrets"))


def listed(spans):
    """kind:start:end of spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def digests(found: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The columns of the query from those of :func:`scan_secrets`."""
    of = lambda i: F.filter("secrets", lambda s: s["kind"] == i)
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    return found.select(F.col(id_col).alias("doc_id"), *[F.size(of(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:3])], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))
