"""A training-data pipeline over ``documents``: each stage is one corpus operator, written as Parquet and read again.

Toxic documents go, then lines that an earlier line matches, then all but one
of each group of near duplicates; the rest is mixed to target weights and
encoded as sampled pieces.

Every stage keeps rows with nulls in any column, empty and very long texts:
a text without words is never toxic, has no line to remove, is linked with
nothing and has size 0 in the mix, which then takes it as often as the rate of
its source says. A null source is a source; a null id is a document of its
own. Rows that repeat an id stay rows of their own, but go together where one
of them is a later near duplicate of another id. Columns beside those of
``documents`` are carried along up to the last stage, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import mixing
from weftline.llm.common import cut, drop, free_names, table
from weftline.llm.line_dedup import deduplicate_lines
from weftline.llm.minhash import near_duplicates
from weftline.llm.pieces import Vocabulary, encode_sampled
from weftline.llm.toxicity import fit_toxicity, score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.3 or more go; the model learns from the labels of ``sf_dir`` and the texts that came in."""
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels"))).where("predicted = 0").drop("score", "predicted")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line matches go; ``n_chars`` follows the text. Every document keeps its row."""
    out = deduplicate_lines(docs).drop("n_lines", "removed")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates on five-word shingles at 0.8 the document with the smallest id stays; texts without words all stay."""
    (gone_,) = free_names(docs, "gone")
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(gone_))
    return docs.join(gone.distinct(), F.col("doc_id") == F.col(gone_), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for."""
    return mixing.emit(mixing.mix(docs))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy with the ids of a sampled segmentation that decodes to its text."""
    return encode_sampled(docs.select("doc_id", "lang", "source", "text"), Vocabulary.load())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("sampled_pieces", encode_pieces),
]

#: SQL cannot express the first, third and last stage; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; each but the last is written to the shared folder, read again, and deleted once the next is written."""
    docs = before = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
