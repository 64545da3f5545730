"""Near-duplicate lines by an exact set-similarity join; later matches are removed.

A line's set is its distinct lower-cased words. Words are ordered by rarity,
and two sets can only reach the threshold if the first word that they share
has enough words from it on in each (prefix filter for the two sizes), their
sizes are close (length filter) and few of 64 parities differ, or of 128 in
longer lines (two sets differ in at least as many words as parities). What
passes is verified on the full sets.

A line goes if *any* earlier line matches it, so no list of all pairs is made:
semi-joins, which stop at a row's first partner, find the sets that have a
candidate at all, then those with a verified earlier match under two of their
prefix words. Only what has candidates but no such match is paired one by one.

The order has to be the same everywhere, not exact. Long words stand before
short ones, as they are rarer, and a line that has enough of them for its
prefix keeps only those beside its name and parities; the text need not be cut
into words again to count them. Among long ones, and among short ones, counts
of the words kept, in a table of fixed size indexed by hash, rank the words,
and equal ranks go by hash. Words above one in 2^17 have a counter that they
dominate at any scale; rarer ones may share theirs, which costs candidates,
not results.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, free_names, split_words

#: Counters of the table of word counts, as a power of two: one for each value of a hash's low bits.
COUNTER_BITS = 18
#: Words of so many bytes stand before all shorter ones.
_LONG = 6
#: Sets of more words have 128 parities instead of 64, which are too few to tell them apart.
_WIDE = 64
#: Bits of the table that tells which lines take part in a candidate pair (by hash).
_MARKS = 1 << 22
#: Classes that have a candidate, of which at most so many are sent to every task.
_SENT = 500_000


def _tokens(line):
    """Distinct words of a lower-cased line, sorted: 63 bits of their hashes; long words have the bit of the sign, and so come first."""
    sign = lambda x: F.when(F.octet_length(x) >= _LONG, F.lit(-(1 << 63))).otherwise(F.lit(0).cast("bigint"))
    each = F.transform(F.array_remove(split_words(line), ""), lambda x: F.shiftrightunsigned(F.xxhash64(x), 1).bitwiseOR(sign(x)))
    return F.sort_array(F.array_distinct(each))


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """One row with the array of ``size`` longs that rows (at, w) fill; zero where there is none."""
    every = rows.sparkSession.range(0, size, 1, 1).join(rows, F.col("id") == F.col("at"), "left")
    return cut(every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("w", F.lit(0).cast("long")).alias("w")))), lambda s: s.w).alias("all")))


def rarity(kept: DataFrame, bits: int = COUNTER_BITS):
    """A function from a word of ``kept`` (31 bits of its token) to its key: long words first, then by the rank of rarity, then by the 31 bits below.

    Three steps of rank for each doubling of the counter, which is summed over
    all lines. The table is of fixed size, whatever the number of words,
    and goes into the plan as an array.
    """
    slot = lambda x: F.shiftright(x, 31 - bits)
    by = kept.select(F.explode("kept").alias("x")).groupBy(slot(F.col("x")).alias("at")).agg(F.count("*").alias("c"))
    short = F.when(F.col("at") < 1 << (bits - 1), 128).otherwise(0)  # the bit of the sign is the highest
    ranks = _packed(by.select("at", (F.least(F.lit(127), F.floor(3 * F.log2(F.col("c")))) + short).cast("long").alias("w")), 1 << bits)
    table = F.split(F.lit(ranks.select(F.array_join(F.col("all").cast("array<string>"), ",")).first()[0]), ",").cast("array<bigint>")
    drop(ranks)
    return lambda x: F.shiftleft(F.coalesce(F.get(table, slot(x)), F.lit(0).cast("bigint")), 31).bitwiseOR(x)  # arrays without nulls are sorted several times faster


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    each = docs.select(F.col(id_col).cast("long").alias("id"), F.posexplode(F.split(F.col(text_col).cast("string"), "\n", -1)).alias("pos", "line"))
    return each.where("id is not null")


def _firsts(lines: DataFrame, by: list[str]) -> DataFrame:
    """The groups with ``doc`` and ``line`` of their first row, document first, then line.

    Both go into one long where ids are small enough, which Spark sums up by hashing; decimals have it sort all rows.
    """
    low, high = lines.agg(F.min("id"), F.max("id")).first()
    small = low is None or -(1 << 31) <= low <= high < 1 << 31
    kind, step = ("bigint", F.lit(1 << 32)) if small else ("decimal(31,0)", F.lit(10**10).cast("decimal(11,0)"))
    rank = (F.col("id").cast("bigint" if small else "decimal(20,0)") * step + F.col("pos")).cast(kind)
    out = lines.groupBy(*by).agg(F.min(rank).alias("at"))
    at = F.pmod("at", step)
    doc = F.shiftright("at", 32) if small else (F.col("at") - at) / step
    return out.select(*by, doc.cast("long").alias("doc"), at.cast("int").alias("line"))


def _need(n, percent: int):
    """Words a set of n must share with a set of its size or less: ceil(percent / 100 * n)."""
    return F.floor((n * percent + 99) / F.lit(100)).cast("int")


def _parities(words):
    """64 parities of a set by the low bits of its words."""
    flip = lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), x))  # noqa: E731  shifts of a long go by the low six bits
    return F.aggregate(words, F.lit(0).cast("bigint"), flip)


#: 64 parities of the whole set and, where it is large, of its long words; what is left of the first are those of the short ones.
_PARITIES = ("parity", "half")


def _sketched(lines: DataFrame) -> DataFrame:
    """With ``n``, ``words`` (31 bits of each token of ``toks``, as is enough to meet on: a pair too many is verified in vain), the number of long ones and the parities, for which each is looked at once."""
    own = lines.columns
    zero = F.lit(0).cast("bigint")
    n_long = F.array_position(F.sort_array(F.concat("toks", F.array(zero))), zero).cast("int") - 1
    out = lines.select(*own, F.transform("toks", lambda x: F.shiftrightunsigned(x, 33).cast("int")).alias("words"), F.size("toks").alias("n"), n_long.alias("n_long"))
    out = out.select("*", *[_parities(F.slice("words", x + 1, y - x)).alias(z) for x, y, z in ((F.lit(0), F.col("n_long"), "p"), (F.col("n_long"), F.col("n"), "q"))])
    return out.select(*own, "words", "n", "n_long", F.col("p").bitwiseXOR(F.col("q")).alias("parity"), F.when(F.col("n") > _WIDE, F.col("p")).alias("half"))


def _close(percent: int, na, nb):
    """Length and parity filters on sets ``a`` and ``b`` of ``na`` and ``nb`` words."""
    whole, half = (F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}")) for c in _PARITIES)
    few = lambda apart: apart * (100 + percent) <= (na + nb) * (100 - percent)  # noqa: E731  no more words may differ than both have beside those that they must share
    both = F.bit_count(half) + F.bit_count(half.bitwiseXOR(whole))
    return (na * 100 >= nb * percent) & (nb * 100 >= na * percent) & few(F.bit_count(whole)) & F.coalesce(few(both), F.lit(True))


def _meet():
    """Rows ``a`` and ``b`` of one word."""
    return F.col("a.key") == F.col("b.key")


def _entries(sets: DataFrame, *cols: str) -> DataFrame:
    """A row for each prefix word ``key``; its place and the number of words are one long, as rows that are sorted and kept in memory had better be short."""
    each = sets.select(*cols, F.col("n").alias("size"), F.posexplode("prefix").alias("at", "key"))
    return each.select(*cols, "key", (F.shiftleft(F.col("size").cast("bigint"), 32) + F.col("at")).alias("place"))


def _candidate(percent: int):
    """Prefix, length and parity filters on rows ``a`` and ``b`` of one prefix word."""
    (na, at_a), (nb, at_b) = ((F.shiftright(f"{x}.place", 32), F.col(f"{x}.place").bitwiseAND(F.lit(2**32 - 1))) for x in "ab")
    # the first word that both share has all that they share from it on, in each
    return (F.least(na - at_a, nb - at_b) * (100 + percent) >= (na + nb) * percent) & _close(percent, na, nb)


def _verified(percent: int):
    """The threshold itself, on the full sets."""
    both = F.size(F.array_intersect("a.toks", "b.toks"))
    return both * 100 >= (F.col("a.n") + F.col("b.n") - both) * percent


def matched_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, bits: int = COUNTER_BITS) -> DataFrame:
    """(id, pos) of every line that an earlier line matches, itself removed or not.

    Lines of one set are a class from the start, which its first line stands
    for: only first lines are joined, all later ones are matches. A class is
    named by its size and two hashes of 64 bits; words are compared by 31 bits
    to find candidates, and by their length and 63 bits of their hashes to verify them.
    """
    name, first = ["k1", "k2", "n"], ["doc", "line"]
    # what is used more than once stands in a step of its own, or each use would work it out again
    lines = _sketched(_lines(docs, id_col, text_col).withColumn("line", F.lower("line")).select("id", "pos", _tokens(F.col("line")).alias("toks")))
    length = F.col("n") - _need(F.col("n"), percent) + 1  # of the prefix
    kept = F.slice("words", F.lit(1), F.when(F.col("n_long") >= length, F.col("n_long")).otherwise(F.col("n")))
    written = cut(lines.select("id", "pos", "n", F.xxhash64("toks").alias("k1"), F.xxhash64(F.lit(7), "toks").alias("k2"), *_PARITIES, kept.alias("kept")))
    rarest = rarity(written, bits)
    prefix = F.transform(F.slice(F.sort_array(F.transform("kept", rarest)), F.lit(1), length), lambda x: x.bitwiseAND(F.lit(2**31 - 1)).cast("int"))
    ranked = written.where("n > 0").select("id", "pos", *name, *_PARITIES, prefix.alias("prefix"))  # blank ones have no set
    classes = cut(_firsts(ranked, [*name, *_PARITIES, "prefix"]).select(*name, *first, *_PARITIES, "prefix"))  # equal sets have equal parities and prefixes
    entry = _entries(classes, "k1", *_PARITIES)
    # sets with any candidate; both sides are one exchange, which they are only under the same names and with the same columns
    x, y = entry.alias("a"), entry.alias("b")
    found = cut(x.join(y, _meet() & (F.col("a.k1") != F.col("b.k1")) & _candidate(percent), "left_semi").select("k1").distinct())
    small = found.count() <= _SENT  # 8 bytes each; more of them meet the classes in a shuffle
    active = cut(classes.join(F.broadcast(found) if small else found, "k1", "left_semi"))
    drop(found)
    # of each set's prefix words the one that most sets have in theirs
    each = active.select("k1", F.explode("prefix").alias("word"))
    common = each.join(each.groupBy("word").agg(F.count("*").alias("c")).where("c > 1"), "word").groupBy("k1").agg(F.max(F.shiftleft("c", 32) + F.col("word")).bitwiseAND(F.lit(2**31 - 1)).cast("int").alias("common"))
    # their words, looked up in the texts
    mark = F.xxhash64("doc", "line").bitwiseAND(F.lit(_MARKS - 1))
    bit = F.expr("shiftleft(1L, cast(xxhash64(doc, line) & 63 as int))")
    marks = _packed(active.groupBy(F.shiftright(mark, 6).alias("at")).agg(F.bit_or(bit).alias("w")), _MARKS // 64)
    seen = _lines(docs, id_col, text_col).select(F.col("id").alias("doc"), F.col("pos").alias("line"), F.col("line").alias("text"))
    seen = seen.where(F.get(marks.scalar(), F.shiftright(mark, 6).cast("int")).bitwiseAND(bit) != 0)
    sets = seen.join(active, first).withColumn("text", F.lower("text")).select(*active.columns, _tokens(F.col("text")).alias("toks"))
    found = cut(sets.select("*", F.xxhash64("toks").alias("own")).join(common, "k1", "left"))
    sets = found.where("own = k1")  # where rows repeat an id, of the lines of one number that which names the class; asked of what is written, or it would be worked out for the filter once more
    drop(active, marks)
    # a verified earlier match under two prefix words, the same for sets alike: the least by hash, and the commonest,
    # as the rarest words of an edited copy are those of the edit, which no other set has
    least = F.array_min(F.transform("prefix", lambda x: F.xxhash64(x)))
    few = F.array_distinct(F.array(least, F.coalesce(F.xxhash64("common"), least)))
    keyed = sets.select(*name, *first, *_PARITIES, "toks", F.explode(few).alias("key"))
    earlier = (F.col("b.doc") < F.col("a.doc")) | ((F.col("b.doc") == F.col("a.doc")) & (F.col("b.line") < F.col("a.line")))
    other = (F.col("a.k1") != F.col("b.k1")) | (F.col("a.k2") != F.col("b.k2"))  # true of an earlier one: keeps the columns of both sides the same
    late = keyed.alias("a").join(keyed.alias("b"), _meet() & earlier & other & _close(percent, F.col("a.n"), F.col("b.n")) & _verified(percent), "left_semi").select(*name).distinct()
    late = cut(late)
    # the others with every candidate
    entry = sets.select(*name, *first, "prefix", *_PARITIES)
    entry = _entries(entry.join(late.withColumn("late", F.lit(True)), name, "left"), *name, *first, *_PARITIES, "late")
    x, y = entry.where("late is null").drop("late").alias("a"), entry.drop("late").alias("b")
    pairs = x.join(y, _meet() & earlier & _candidate(percent))
    pairs = cut(pairs.select(*[F.col(f"{end}.{c}").alias(f"{c}_{end}") for end in "ab" for c in name]).distinct())
    sa, sb = sets.select(*name, "toks").alias("a"), sets.select(*name, "toks").alias("b")
    of = lambda end: reduce(and_, [F.col(f"{c}_{end}") == F.col(f"{end}.{c}") for c in name])
    more = pairs.join(sa, of("a")).join(sb, of("b")).where(_verified(percent)).select(*[F.col(f"a.{c}").alias(c) for c in name]).distinct()
    before, late = late, cut(late.unionByName(more))
    drop(before, pairs, found)
    # classes of one line that nothing matches say nothing: what is left is joined to the lines
    status = classes.select(*name, *first).join(late.withColumn("late", F.lit(True)), name, "left")
    out = written.where("n > 0").select("id", "pos", *name).join(status, name).where(F.coalesce("late", F.lit(False)) | (F.col("id") != F.col("doc")) | (F.col("pos") != F.col("line")))
    out = cut(out.select("id", "pos"))
    drop(written, classes, late)
    return out


def deduplicate_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with their later matching lines removed from the text, and ``n_lines`` and ``removed`` (line numbers from 0).

    A line goes if a line before it, in a document of a smaller id or higher
    up in the same one, has a word set with 100 * |both| >= percent * |either|;
    whether that one goes itself does not matter. Blank lines have no set:
    they stay and match nothing. A document whose lines all go keeps its row,
    with an empty text. Null texts stay null. Rows with a null id keep their
    text. Rows that repeat an id have their lines numbered alike; one such
    line goes if any of them is matched earlier. An empty table gives no rows.
    Columns named n_lines or removed are replaced; no other name matters.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "removed")]
    id_, gone_ = free_names(docs, "id", "gone")
    gone = matched_lines(docs, id_col=id_col, text_col=text_col, percent=percent)
    gone = gone.groupBy(F.col("id").alias(id_)).agg(F.array_sort(F.collect_set("pos")).alias(gone_))
    out = docs.select(*own).join(gone, F.col(id_col).cast("long") == F.col(id_), "left")
    parts = F.split(F.col(text_col), "\n", -1)
    kept = F.array_join(F.transform(F.filter(F.transform(parts, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains(F.col(gone_), s.i)), lambda s: s.x), "\n")
    text = F.when(F.col(gone_).isNull() | F.col(text_col).isNull(), F.col(text_col)).otherwise(kept)
    whole = F.col(text_col).cast("string")
    n_lines = F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    cols = [text.alias(c) if c == text_col else F.col(c) for c in own]
    return out.select(*cols, F.when(F.col(text_col).isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"), F.coalesce(gone_, F.array().cast("array<int>")).alias("removed"))


#: DuckDB's form of :func:`deduplicate_lines` over ``documents``, with the columns of its query.
SQL = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
l AS (
  SELECT doc_id, i - 1 AS pos, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(lines[i]), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))) AS words
  FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM d)),
c AS (
  SELECT words, len(words) AS n, min((doc_id, pos)) AS first, row_number() OVER () AS id FROM l WHERE len(words) > 0 GROUP BY words),
e AS (SELECT id, n, unnest(words) AS word FROM c),
f AS (SELECT word, count(*) AS df FROM e GROUP BY word),
p AS (
  SELECT id, n, word FROM (SELECT e.*, row_number() OVER (PARTITION BY id ORDER BY df, word) AS k FROM e JOIN f USING (word)) WHERE k <= n - (80 * n + 99) // 100 + 1),
m AS (SELECT DISTINCT a.id AS x, b.id AS y FROM p a JOIN p b USING (word) WHERE a.id <> b.id AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80),
h AS (
  SELECT DISTINCT y AS id FROM m JOIN c a ON a.id = x JOIN c b ON b.id = y
  WHERE a.first < b.first AND 100 * len(list_intersect(a.words, b.words)) >= 80 * (a.n + b.n - len(list_intersect(a.words, b.words)))),
g AS (
  SELECT doc_id, list(pos ORDER BY pos) AS gone FROM l JOIN c USING (words) LEFT JOIN h USING (id) WHERE h.id IS NOT NULL OR (doc_id, pos) <> c.first GROUP BY doc_id),
o AS (SELECT doc_id, lines, coalesce(gone, []) AS gone FROM d LEFT JOIN g USING (doc_id)),
k AS (SELECT *, array_to_string(list_filter(lines, lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) AS text FROM o)
SELECT doc_id, len(lines) AS n_lines, len(gone) AS n_removed, array_to_string(gone, ',') AS removed, length(text) AS n_chars, md5(text) AS text_md5 FROM k
"""
