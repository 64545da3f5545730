"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph is hashed to a wide vector, and a document's fingerprint is the
sum of its paragraphs' vectors, lane by lane, modulo a power of two. Order
does not matter, and a paragraph is added to or taken from a fingerprint by
adding or subtracting its vector. The vector has two kinds of lanes:

* 16 *identity* lanes modulo 2^31, which are hashes of the whole paragraph:
  496 bits that differ for different multisets of paragraphs;
* 256 *likeness* lanes, two in each of 128 sums modulo 2^64, to which each
  pair of neighbouring words of the paragraph adds +1 or -1 in one lane of its
  hash. Their inner products estimate how many word pairs two texts share,
  which whole-paragraph hashes cannot tell. A lane has 32 bits, and no text
  has 2^31 words, so that lanes cannot run into each other.

A text and its edit have most paragraphs in common; those are hashed once and
counted for both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, split_words

IDENTITY, LIKENESS = 16, 256
_ID_MOD = 31
#: Sums that hold the likeness lanes.
_PAIRS = LIKENESS // 2
#: Sums (longs) of one row: a group of 32 likeness lanes, or all identity lanes, which are the last group.
_SUMS = 16
_GROUPS = _PAIRS // _SUMS


def _paragraphs(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _units(each: DataFrame, cols: list[str]) -> DataFrame:
    """From rows (cols, p): for each paragraph p one row that stands for itself (a negative ``at``) and one for each of its word pairs.

    A row has its group, the place of its sum and what it adds there. The last
    word's pair is the word alone. There is no lambda here, so that all of it
    is generated code.
    """
    each = each.select(*cols, "p", F.array_remove(split_words(F.col("p")), "").alias("w"))
    none = F.struct(F.lit(None).cast("string").alias("w"), F.lit(None).cast("string").alias("w2"))
    pairs = F.arrays_zip(F.col("w"), F.slice("w", 2, F.size("w")).alias("w2"))
    each = each.select(*cols, "p", F.explode(F.concat(F.array(none), pairs)).alias("u"))
    each = each.select(*cols, "p", F.when(F.col("u.w").isNotNull(), F.xxhash64("u.w", "u.w2")).alias("h"))
    lane = F.col("h").bitwiseAND(F.lit(LIKENESS - 1))
    one = F.shiftrightunsigned("h", 62).bitwiseAND(F.lit(1)) * 2 - 1
    return each.select(
        *cols,
        "p",
        F.coalesce(F.shiftright(lane, 5).cast("int"), F.lit(_GROUPS)).alias("grp"),
        F.coalesce(F.shiftright(lane, 1).bitwiseAND(F.lit(_SUMS - 1)).cast("int"), F.lit(-1)).alias("at"),
        F.when(lane.bitwiseAND(F.lit(1)) == 1, F.shiftleft(one, 32)).otherwise(one).alias("adds"),
    )


def _sum(k: int, own):
    """Sum k of a row's group over the units where ``own`` holds: hashes of whole paragraphs, or what pairs add."""
    whole = F.xxhash64(F.lit(k), "p").bitwiseAND(F.lit(2**_ID_MOD - 1))
    return F.sum(F.when(own & (F.col("at") < 0), whole).when(own & (F.col("at") == k), F.col("adds")).otherwise(0))


def _reduced(vec):
    return F.concat(F.slice(vec, 1, _PAIRS), F.transform(F.slice(vec, 1 + _PAIRS, IDENTITY), lambda x: F.pmod(x, F.lit(2**_ID_MOD))))


def paragraph_lanes(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, grp, l0 .. l15): the sums of each row's text by groups, pre-aggregated before the shuffle."""
    each = rows.select(*keys, F.explode(_paragraphs(F.col(text_col).cast("string"))).alias("p"))
    return _units(each, keys).groupBy(*keys, "grp").agg(*[_sum(k, F.lit(True)).alias(f"l{k}") for k in range(_SUMS)])


def _packed(c: str):
    """Aggregate: the groups ``c``0 .. ``c``15 of a key one after the other; groups without words are zeros."""
    got = F.map_from_entries(F.collect_list(F.struct("grp", F.array(*[F.col(f"{c}{k}") for k in range(_SUMS)]))))
    zero = F.array(*[F.lit(0).cast("long")] * _SUMS)
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(_GROUPS)), lambda g: F.coalesce(F.try_element_at(got, g), zero)))


def to_text(vec):
    """A fingerprint as lowercase hex: likeness sums of 16 digits, then identity lanes of 8."""
    pairs, own = F.slice(vec, 1, _PAIRS), F.slice(vec, 1 + _PAIRS, IDENTITY)
    digits = lambda a, n: F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), n, "0")), "")
    return F.lower(F.concat(digits(pairs, 16), digits(own, 8)))


def _lanes_squared(s):
    """The squares of both lanes of a sum: the low lane is its low half, signed, the high lane the rest."""
    low = F.shiftright(F.shiftleft(s, 32), 32)
    high = F.shiftright(s - low, 32)
    return (low * low + high * high).cast("double")


def _square(vec):
    return F.aggregate(F.slice(vec, 1, _PAIRS), F.lit(0.0), lambda total, s: total + _lanes_squared(s))


def likeness(a, b):
    """Likeness of two fingerprints, 0 to 1: estimated shared word pairs over the mean of both (1 if equal).

    From |a - b|^2 against |a|^2 + |b|^2 of the likeness lanes, each of which
    is an unbiased estimate of a count of word pairs. The standard error for
    unrelated texts is about 1/16. Two fingerprints without words are alike.
    """
    norm = _square(a) + _square(b)
    apart = _square(F.zip_with(a, b, lambda x, y: x - y))
    return F.when(a == b, 1.0).when(norm == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - apart / norm))


def add(a, b):
    """The fingerprint of both texts' paragraphs together (insertion)."""
    return _reduced(F.zip_with(a, b, lambda x, y: x + y))


def subtract(a, b):
    """The fingerprint of a text's paragraphs without those of ``b`` (deletion)."""
    return _reduced(F.zip_with(a, b, lambda x, y: x - y))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, vec) of every row with an id that occurs once; null texts count as empty (one empty paragraph).

    Rows that repeat an id add up, as the hash of both rows' paragraphs.
    Only sums move: 9 rows of 16 for each document, however long.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return paragraph_lanes(src, ["id"], "text").groupBy("id").agg(_packed("l").alias("packed")).select("id", _reduced(F.col("packed")).alias("vec"))


#: Ids of one block are neighbours; 2^10 of them at most if ids are unique.
_BLOCK_BITS = 10


def next_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, text, next_id, next_row, next_text) in ascending order of ids and, among equal ids, of texts; the last one's next is the first.

    Ids fall in blocks of 1,024 consecutive values, so a window over a block
    is of bounded size however ids are spread, if they are unique; the whole
    texts are shuffled once, by block. The last row of a block gets the first
    one of the next block there is, which is found on the blocks' first ids,
    by blocks of blocks, until one small window holds all. ``row`` numbers the
    rows of a block from 1, so that id and row name a row where ids repeat. A
    null id has no place in the order: its row is its own next one, and its
    number is negative.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = rows.where("id is not null").withColumn("blk", F.shiftright("id", _BLOCK_BITS))
    after = next_of(known.groupBy("blk").agg(F.min("id").alias("first")))
    w = Window.partitionBy("blk").orderBy("id", "text")
    row = known.withColumn("row", F.row_number().over(w).cast("long"))
    heads = row.where("row = 1").select(F.col("blk").alias("next_blk"), F.col("id").alias("head_id"), F.col("text").alias("head_text"))
    heads = heads.join(after.select("blk", F.shiftright("next_first", _BLOCK_BITS).alias("next_blk")), "next_blk").drop("next_blk")
    row = row.withColumns({"next_id": F.lead("id").over(w), "next_text": F.lead("text").over(w)}).join(heads, "blk", "left")
    last = F.col("next_id").isNull()
    ordered = row.select(
        "id", "row", "text", F.coalesce("next_id", "head_id").alias("next_id"), F.when(last, 1).otherwise(F.col("row") + 1).cast("long").alias("next_row"), F.when(last, F.col("head_text")).otherwise(F.col("next_text")).alias("next_text")
    )
    lone = rows.where("id is null").withColumn("part", F.pmod(F.xxhash64("text"), F.lit(1 << _BLOCK_BITS)))
    at = -(F.shiftleft("part", 48) + F.row_number().over(Window.partitionBy("part").orderBy("text")))
    lone = lone.select("id", at.alias("row"), "text").select("id", "row", "text", F.col("id").alias("next_id"), F.col("row").alias("next_row"), F.col("text").alias("next_text"))
    return ordered.unionByName(lone)


def next_of(firsts: DataFrame) -> DataFrame:
    """(blk, next_first) for rows of (blk, first): the first id of the next block there is, around the end."""
    now = cut(firsts)
    if now.count() <= 1 << _BLOCK_BITS:
        w = Window.orderBy("blk")
        least = F.min("first").over(Window.partitionBy())
        return now.select("blk", F.coalesce(F.lead("first").over(w), least).alias("next_first"))
    up = now.groupBy(F.shiftright("blk", _BLOCK_BITS).alias("up")).agg(F.min_by("first", "blk").alias("first"))
    above = next_of(up.withColumnRenamed("up", "blk")).withColumnRenamed("blk", "up")
    w = Window.partitionBy("up").orderBy("blk")
    return now.withColumn("up", F.shiftright("blk", _BLOCK_BITS)).withColumn("n", F.lead("first").over(w)).join(above, "up").select("blk", F.coalesce("n", "next_first").alias("next_first"))


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edit replaces the last quarter of a text, in code points, by the
    first as many of the next document's (all, if it has fewer). Null texts
    are empty. Rows that repeat an id stay rows of their own, in order of
    their texts, and the next of each but the last is the next of them. Null
    ids have no place in the order: each such row is its own next document. A
    single document is its own next one. An empty table gives no rows. Other
    columns of ``docs`` are not looked at. Equal texts have equal fingerprints.
    """
    rows = next_rows(docs, id_col=id_col, text_col=text_col)
    n = F.length("text")
    tail = F.floor(n / 4).cast("int")
    head = F.substring(F.col("text"), F.lit(1), n - tail)
    # null ids, whose rows' numbers are negative, go by 0, as joins do not meet on nulls
    key, nxt = ["id", "row"], ["next_id", "next_row"]
    rows = rows.select(*[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in (*key, *nxt)], n.cast("long").alias("n_chars"), "text", head.alias("head"), F.concat(head, F.substring(F.col("next_text"), F.lit(1), tail)).alias("edited"))
    # as four longs the digest keeps the aggregation on hashes, which strings would put on sorts
    half = lambda k: F.conv(F.substring("sha", 1 + 8 * k, 8), 16, 10).cast("bigint")
    carry = ["n_chars", "s0", "s1", "s2", "s3"]
    # paragraphs that end before the cut are those of both texts
    shared = F.size(_paragraphs(F.col("head"))) - 1
    rows = rows.select(*key, *nxt, "n_chars", F.sha2("edited", 256).alias("sha"), _paragraphs(F.col("text")).alias("pt"), _paragraphs(F.col("edited")).alias("pe"), shared.alias("m"))
    kinds = F.array(
        *[F.struct(F.lit(kind).alias("kind"), ps.alias("ps")) for kind, ps in ((0, F.slice("pt", F.lit(1), F.col("m"))), (1, F.slice("pt", F.col("m") + 1, F.size("pt"))), (2, F.slice("pe", F.col("m") + 1, F.size("pe"))))]
    )
    rows = rows.select(*key, *nxt, "n_chars", *[F.shiftleft(half(2 * k), 32).bitwiseOR(half(2 * k + 1)).alias(f"s{k}") for k in range(4)], F.explode(kinds).alias("x"))
    each = _units(rows.select(*key, *nxt, *carry, F.col("x.kind").alias("kind"), F.explode("x.ps").alias("p")), [*key, *nxt, *carry, "kind"])
    # one row for each group of both texts; what a document has once goes with its identity lanes
    last, carry = F.col("grp") == _GROUPS, [*nxt, *carry]
    sums = [_sum(k, F.col("kind") != unlike).alias(f"{c}{k}") for c, unlike in (("t", 2), ("e", 1)) for k in range(_SUMS)]
    lanes = cut(each.groupBy(*key, "grp").agg(*sums, *[F.max(F.when(last, F.col(c))).alias(c) for c in carry]))
    whole = cut(lanes.groupBy(*key).agg(*[F.max(c).alias(c) for c in carry], _packed("t").alias("t"), _packed("e").alias("e")))
    drop(lanes)
    after = whole.select(F.col("id").alias("next_id"), F.col("row").alias("next_row"), F.col("t").alias("x"))
    # the squares of likeness(), summed over rows, which is generated code; both joins are on one exchange of `whole`
    pair = F.explode(F.arrays_zip(*[F.slice(c, 1, _PAIRS).alias(c) for c in "tex"])).alias("p")
    flag = lambda c: F.col("t") == F.col(c)
    each = whole.join(after, nxt).select(*key, *carry, flag("e").alias("same_e"), flag("x").alias("same_x"), pair)
    t, e, x = (F.col(f"p.{c}") for c in "tex")
    squares = {"nt": t, "ne": e, "nx": x, "te": t - e, "tx": t - x}
    near = each.groupBy(*key, *carry).agg(F.min("same_e").alias("same_e"), F.min("same_x").alias("same_x"), *[F.sum(_lanes_squared(v)).alias(k) for k, v in squares.items()])
    alike = lambda same, d, norm: F.when(F.col(same), 1.0).when(norm == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col(d) / norm))
    near = near.select(*key, *carry, alike("same_e", "te", F.col("nt") + F.col("ne")).alias("near_edited"), alike("same_x", "tx", F.col("nt") + F.col("nx")).alias("near_next"))
    return whole.join(near, [*nxt, *[c for c in (*key, *carry) if c not in nxt]]).select(
        F.when(F.col("row") > 0, F.col("id")).alias("doc_id"),
        "n_chars",
        F.lower(F.concat(*[F.lpad(F.hex(f"s{k}"), 16, "0") for k in range(4)])).alias("edited_sha256"),
        to_text(_reduced(F.col("t"))).alias("fingerprint"),
        to_text(_reduced(F.col("e"))).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
