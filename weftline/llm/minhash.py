"""Near-duplicate documents by b-bit MinHash.

Every text is reduced once, in Arrow batches, to the minima of
``bands * rows`` permutations of its shingle set: ``bands`` keys of ``rows``
full minima each find candidates, and one bit of every minimum, mixed with a
salt of its permutation, is packed into a signature, whose equal bits give a
collision-corrected estimate of the similarity in the JVM. Beside it stand 1,024
parities of the set, by hash of the shingle: two sets differ in at least as
many shingles as parities, which rules out pairs for certain, and is nearly the
exact difference for sets of some hundreds. What both leave is confirmed on
the full shingle sets, so the links that count are exact.

Groups of copies never become all their pairs: equal shingle sets are one
class from the start; then each class is tried against one partner from its
buckets per round, components are merged, and only pairs of *different*
components that share a bucket are tried one by one at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop
from .components import connected_components

_U = np.uint64


class _WordHash(dict):
    """64-bit hash of each word, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def shingle_hashes(text: str | None, ngram: int, cache: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``ngram`` words; fewer words are one shingle."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, w), np.uint64, len(w))
    n = min(ngram, len(w))
    x = np.zeros(len(w) - n + 1, np.uint64)
    for k in range(n):
        x = _mix(x * _U(0x9E3779B97F4A7C15) + h[k : len(w) - n + 1 + k] + _U(k + 1))
    if n < ngram:
        x = _mix(x + _U(n))
    return np.unique(x)


#: Parities of a set, and the size from which a set is large enough for the estimate to rule out a pair.
PARITIES, LARGE = 1_024, 64


def parities(x: np.ndarray) -> np.ndarray:
    """For each of ``PARITIES`` classes of shingles whether the set has an odd number of them, packed in int64 words."""
    odd = np.bincount((x & _U(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


class Sketcher:
    """Minima, band keys and packed bits of shingle sets."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.odd = (rng.integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.mult = rng.integers(0, 2**63, rows, dtype=np.uint64) * _U(2) + _U(1)
        self.salt = rng.integers(0, 2**63, bands, dtype=np.uint64)
        self.bit_salt = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def minima(self, x: np.ndarray, chunk: int = 512) -> np.ndarray:
        h = (x >> _U(32)).astype(np.uint32)
        out = np.full(len(self.odd), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(h), chunk):
            np.minimum(out, (self.odd * h[at : at + chunk]).min(axis=1), out=out)
        return out

    def keys(self, m: np.ndarray) -> np.ndarray:
        """Band keys of many documents' minima, documents x bands, as int64."""
        per = m.reshape(len(m), self.bands, self.rows).astype(np.uint64)
        return _mix((per * self.mult).sum(axis=2, dtype=np.uint64) + self.salt).view(np.int64)

    def bits(self, m: np.ndarray) -> np.ndarray:
        """One bit of every minimum, packed in int64 words.

        Odd multipliers keep an element's lowest bit in all permutations, so
        the bit is taken after mixing with a salt for each of them.
        """
        return np.packbits((_mix(m.astype(np.uint64) + self.bit_salt) & _U(1)).astype(bool), axis=1).view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str, ngram: int, bands: int, rows: int, *, with_text: bool = False) -> DataFrame:
    """id, n (set size), k1 and k2 (which name the set), band keys, packed bits and parities of each text, and the text if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, sk = _WordHash(), Sketcher(bands, rows)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                sets = [shingle_hashes(t, ngram, cache) for t in part.column(1).to_pylist()]
                m = np.stack([sk.minima(x) for x in sets])
                n = np.array([len(x) for x in sets], np.int64)
                k1 = np.array([x.sum(dtype=np.uint64) for x in sets], np.uint64).view(np.int64)
                k2 = np.array([_mix(x ^ _U(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) for x in sets], np.uint64).view(np.int64)
                keys, bits = sk.keys(m), sk.bits(m)
                wide = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel()))
                odd = np.stack([parities(x) for x in sets])
                text = [part.column(1)] if with_text else []
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(k1), pa.array(k2), wide(keys), wide(bits), wide(odd), *text], names=["id", "n", "k1", "k2", "keys", "bits", "odd", *(["text"] if with_text else [])])

    if rows * bands % 64:
        raise ValueError("bands * rows must be a multiple of 64")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n long, k1 long, k2 long, keys array<long>, bits array<long>, odd array<long>" + (", text string" if with_text else ""))


def _confirm(pairs: DataFrame, texts: DataFrame, ngram: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full shingle sets meet 100 * both >= percent * either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHash()
        last = None, None
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x = last[1] if last[0] == a else shingle_hashes(ta, ngram, cache)
                last = a, x
                y = shingle_hashes(tb, ngram, cache)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ta = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    tb = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _differing(x: str, y: str, n_words: int):
    """Bits in which two packed columns differ."""
    out = F.bit_count(F.col(x)[0].bitwiseXOR(F.col(y)[0]))
    for k in range(1, n_words):
        out = out + F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k]))
    return out


def _estimate(x: str, y: str, n_words: int):
    """Share of equal bits, corrected for the half that agrees by chance: the estimated similarity."""
    return 1 - F.lit(2.0) * _differing(x, y, n_words) / F.lit(64.0 * n_words)


def _may_link(percent: int, floor: float, n_words: int):
    """Of a pair with sizes na, nb, parities oa, ob and bits ba, bb: whether nothing rules it out.

    Sizes and parities rule out for certain; the estimate, for sets of
    ``LARGE`` shingles and more, where it falls below ``floor``.
    """
    small, most = F.least("na", "nb"), F.greatest("na", "nb")
    sizes = small * 100 >= most * percent
    apart = _differing("oa", "ob", PARITIES // 64) * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)
    return sizes & apart & ((small < LARGE) | (_estimate("ba", "bb", n_words) >= floor))


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    ngram: int = 5,
    percent: int = 80,
    bands: int = 64,
    rows: int = 8,
    partners: int = 3,
    spread: float = 6.0,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, class_id.

    ``class_id`` is the smallest id with the same shingle set, ``component_id``
    the smallest id that links reach, ``kept`` whether the document is it.
    Two sets are linked where 100 * |both| >= percent * |either|. With 64
    bands of 8 rows a pair at 0.8 stays unseen with probability 8e-6; the
    estimate has a standard deviation of about 0.026, and a pair of sets of
    ``LARGE`` shingles or more is left out without confirmation only
    ``spread`` of them below the threshold, a smaller one only where sizes
    or parities prove that it is no link.

    Null, empty and blank texts have an empty set and are linked with
    nothing. A null id is kept, alone, with a null component. Rows that
    repeat an id and text have the same set and so the same result; rows of
    one id with different texts are documents of their own, each with the
    smallest id that its text reaches. Other columns of ``docs`` are not
    looked at. An empty table gives no rows.
    """
    n_words = bands * rows // 64
    floor = float(percent / 100 - spread * 0.6 / np.sqrt(bands * rows))
    sk = cut(sketches(docs, id_col, text_col, ngram, bands, rows))
    known = sk.where("id is not null and n > 0")
    wide = ["keys", "bits", "odd"]
    # ids whose rows have different sets do not name a class: a hash of the set does, below all ids that count from 0
    own = F.struct("k1", "k2", "n")
    several = cut(known.groupBy("id").agg(F.min(own).alias("lo"), F.max(own).alias("hi")).where("lo <> hi").select("id"))
    repeated = bool(several.take(1))
    classes = known.groupBy("k1", "k2", "n").agg(F.min("id").alias("doc"), *[F.min_by(c, "id").alias(c) for c in wide])
    name = F.col("doc")
    if repeated:
        classes = classes.join(several.select(F.col("id").alias("doc"), F.lit(True).alias("several")), "doc", "left")
        name = F.when(F.col("several"), -1 - F.xxhash64("k1", "k2", "n").bitwiseAND(F.lit(2**63 - 1))).otherwise(F.col("doc"))
    classes = cut(classes.select("k1", "k2", "n", "doc", name.alias("id"), *wide))
    rows_of = classes.select("id", F.explode("keys").alias("k"))
    # buckets of more than one class, with their smallest one, back to their classes; the key under a
    # mask gives the rows an exchange of their own, which adaptive execution can split where it is hot
    many = rows_of.groupBy("k").agg(F.count("*").alias("c"), F.min("id").alias("p")).where("c > 1").select(F.col("k").bitwiseXOR(F.lit(1)).alias("k"), "p")
    member = cut(rows_of.select("id", F.col("k").bitwiseXOR(F.lit(1)).alias("k")).join(many, "k"))
    pool = member.select("id").distinct()
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = src.join(pool, "id", "left_semi").dropDuplicates(["id"])
    if repeated:  # texts of those ids are told apart by their sets
        told = sketches(src.join(several, "id", "left_semi"), "id", "text", ngram, bands, rows, with_text=True).join(classes.select("k1", "k2", "n", F.col("id").alias("name")), ["k1", "k2", "n"])
        told = told.select(F.col("name").alias("id"), "text").join(pool, "id", "left_semi")
        texts = texts.join(several, "id", "left_anti").unionByName(told).dropDuplicates(["id"])
    texts = cut(texts)
    signs = classes.select("id", "n", "bits", "odd")
    may_link = _may_link(percent, floor, n_words)

    # each class against the likeliest of the first ones of its buckets
    first = member.where("p < id").select(F.col("id").alias("a"), F.col("p").alias("b")).distinct()
    sa, sb = (signs.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"b{x}"), F.col("odd").alias(f"o{x}")) for x in "ab")
    first = first.join(sb, "b").join(sa, "a").where(may_link).select("a", "b", _estimate("ba", "bb", n_words).alias("est"))
    best = F.row_number().over(Window.partitionBy("a").orderBy(F.col("est").desc(), "b"))
    tried = cut(first.withColumn("best", best).where(F.col("best") <= partners).select("a", "b"))
    links = cut(_confirm(tried, texts, ngram, percent))
    found = cut(connected_components(links, "a", "b"))
    # what is left: pairs of different components in one bucket, other than those
    comp = F.coalesce("component", "id").alias("comp")
    known = member.join(found.withColumnRenamed("node", "id"), "id", "left").select("k", "id", comp)
    mixed = known.groupBy("k").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select(F.col("k").bitwiseXOR(F.lit(2)).alias("k2"))
    left = known.withColumn("k2", F.col("k").bitwiseXOR(F.lit(2))).join(mixed, "k2", "left_semi").select("k", "id", "comp")
    left = cut(left.join(signs, "id"))
    x, y = (left.select("k", F.col("id").alias(c), F.col("comp").alias(f"c{c}"), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"b{c}"), F.col("odd").alias(f"o{c}")) for c in "ab")
    pairs = x.join(y, (x["k"] == y["k"]) & (F.col("a") > F.col("b")) & (F.col("ca") != F.col("cb")) & may_link)
    pairs = pairs.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
    more = cut(_confirm(pairs, texts, ngram, percent))
    drop(member, left, tried)
    if more.take(1):
        found = cut(connected_components(links.unionByName(more), "a", "b"))
    drop(texts, links, more, several)
    if repeated:  # the smallest id of a component, not the smallest name
        reached = found.join(classes.select(F.col("id").alias("node"), "doc"), "node")
        found = found.join(reached.groupBy("component").agg(F.min("doc").alias("least")), "component").select("node", F.col("least").alias("component"))
    classes = classes.select("k1", "k2", "n", F.col("doc").alias("class_id"), F.col("id").alias("node")).join(found, "node", "left").drop("node")
    out = sk.select("id", "n", "k1", "k2").join(classes, ["k1", "k2", "n"], "left")
    alone = F.when(F.col("n") > 0, F.coalesce("component", "class_id", "id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNull(), None).otherwise(alone).alias("component_id"),
        F.coalesce(F.col("id") == alone, F.lit(True)).alias("kept"),
        F.when(F.col("id").isNull(), None).otherwise(F.coalesce("class_id", "id")).alias("class_id"),
    )


#: DuckDB's form of :func:`near_duplicates` over ``documents`` on two-word shingles: every pair that shares one, counted.
SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 80 * (nx.n + ny.n - shared)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(node, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.y FROM r JOIN e ON r.reach = e.x),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN c ON c.node = doc_id
"""
