"""Language identification by compression with one raw-content dictionary per language."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

#: Bounds of the sample that the dictionaries are made of, and of the languages.
ROWS_PER_LANGUAGE, DICT_BYTES, MAX_LANGUAGES = 600, 112_000, 256
#: Texts up to this size are compressed at the higher level, which finds more matches.
SHORT, HIGH, LOW = 2_000, 12, 1
#: Punctuation at the ends of words, which a tie's word counts leave out.
EDGES = b".,;:!?*#$%&|()[]\"'"


def fit_dictionaries(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows_per_language: int = ROWS_PER_LANGUAGE, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """A dictionary of raw text for each language, from a bounded sample of the rows that are not held out.

    Rows are counted over all documents; those whose hash is lowest, about
    ``rows_per_language`` for each language, come to the driver, and the
    dictionary takes an equal share of each until it has ``dict_bytes``. More
    than 256 languages raise an error, as a dictionary per language is kept
    in every worker.
    """
    learn = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0) & ~F.coalesce(held_out(F.col(id_col)), F.lit(True)))
    counts = {r[0]: r[1] for r in learn.groupBy(lang_col).count().limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, 1.2 * rows_per_language / n))])
    u = F.xxhash64(F.col(id_col), F.lit("language sample")).bitwiseAND(F.lit(0xFFFFFFFF)).cast("double") / F.lit(2.0**32)
    # a share of a row's text is enough for the sample: no dictionary holds more
    part = learn.where(u < F.try_element_at(share, F.col(lang_col))).select(F.col(lang_col).alias("lang"), u.alias("u"), F.left(F.col(text_col), F.lit(dict_bytes)).alias("text"))
    rows = sorted((r.lang, r.u, r.text) for r in part.collect())
    out = {}
    for lang in sorted(counts):
        texts = [t.lower().encode("utf-8", "surrogatepass") for x, _, t in rows if x == lang][:rows_per_language]
        room, each, took = dict_bytes, [], set()
        for k, t in enumerate(texts):  # small ones leave their room to the next
            if t in took:
                continue
            took.add(t)
            t = t[: max(1, room // max(1, len(texts) - k))]
            each.append(t)
            room -= len(t)
        out[lang] = b"\n".join(each)[-dict_bytes:]
    return {k: v for k, v in out.items() if v}


class Classifier:
    """Sizes of a text under each dictionary; the smallest names the language."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = sorted(dictionaries)
        self.by = {}
        for level in (HIGH, LOW):
            self.by[level] = []
            for k in self.langs:
                d = zstandard.ZstdCompressionDict(dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=level)  # digested once, not for each text
                self.by[level].append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False))
        self.words = {k: _word_counts(v) for k, v in dictionaries.items()}

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text or not any(c.isalpha() for c in text):
            return "und", 0.0
        raw = text.lower().encode("utf-8", "surrogatepass")
        if len(raw) <= SHORT:
            raw = raw.replace(b"\n", b" ") + b" "
        sizes = [len(c.compress(raw)) for c in self.by[HIGH if len(raw) <= SHORT else LOW]]
        order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
        tied = [k for k in order if sizes[k] <= sizes[order[0]] + max(4, sizes[order[0]] // 50)]
        best = order[0]
        if len(tied) > 1:  # bytes are too coarse: the dictionary that holds more of the different words
            w = {x.strip(EDGES) for x in raw.split()}
            best = max(tied, key=lambda k: (sum(math.log1p(self.words[self.langs[k]].get(x, 0)) for x in w) - (sizes[k] - sizes[order[0]]), -k))
        others = [s for k, s in enumerate(sizes) if k != best]
        margin = (min(others) - sizes[best]) / max(1, min(others)) if others else 1.0
        return self.langs[best], 1 / (1 + math.exp(-max(-30.0, min(30.0, 1 + 40 * margin))))


def _word_counts(text: bytes) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for w in text.split():
        w = w.strip(EDGES)
        out[w] = out.get(w, 0) + 1
    return out


def identify_language(docs: DataFrame, dictionaries: dict[str, bytes], *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, rejected.

    ``lang_pred`` is the language whose dictionary makes the whole text
    smallest, ``und`` where the text is null or has no letter (score 0). The
    score rises with the margin to the next language; ``rejected`` is true
    where it is below ``least``, i.e. the margin is narrow, and for ``und``.
    Ties go to the dictionary that holds more of the words, then to the first
    language by name. Without dictionaries everything is ``und``. Very long
    texts are compressed whole; rows that repeat get equal results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries)
        for batch in batches:
            found = [model(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    out = src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")
    return out.withColumn("rejected", F.col("score") < least)
