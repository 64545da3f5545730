"""The corpus operators applied to the test tables: one query each, with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fim, line_dedup, minhash, mixing, periodic, secret_scan, sharding, topk
from .common import held_out, table
from .fingerprint import edited_fingerprints
from .html_extract import extract_main_text
from .langid import fit_dictionaries, identify_language
from .line_dedup import deduplicate_lines
from .minhash import near_duplicates
from .pieces import Vocabulary, encode_sampled
from .toxicity import fit_toxicity, score_toxicity

SHARD_BYTES = 1 << 20


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents on two-word shingles at a similarity of 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), ngram=2, percent=80).drop("class_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every document; labels of held-out rows are not learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of at most 1 MiB of text by extendible hashing of the document's id."""
    docs = table(spark, sf_dir, "documents")
    return sharding.assign_shards(docs, limit=SHARD_BYTES).select("doc_id", "n_bytes", "depth", "shard", "part", "shard_bytes")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that an earlier line matches at 0.8, removed; the new text by its size and md5."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = deduplicate_lines(docs)
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every 50th vector."""
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of each document in a mix of one and a half times all words."""
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_main_text(table(spark, sf_dir, "pages"))


def op8_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampled segmentation of every document, which decodes to its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_sampled(docs, Vocabulary.load()).select("doc_id", "n_pieces", "lossless", "pieces")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by compression; held-out rows are not learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify_language(docs, fit_dictionaries(docs))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-middle forms of every document, and the texts rebuilt from them."""
    out = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = fim.restore(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document by fixed patterns and by Markov models of characters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    models = secret_scan.fit_models(secret_scan.labelled_samples(docs))
    return secret_scan.digests(secret_scan.scan_secrets(docs, models))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeating words of every document, every tenth of which repeats words from some place on."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic.digests(periodic.periodic_runs(periodic.planted(docs)))


QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_toxicity, op3_shards, op4_line_dedup, op5_exact_topk, op6_mix_sources, op7_main_text, op8_sampled_pieces, op9_language, op10_fingerprints, op11_fill_in_middle, op12_secret_scan, op13_periodic_runs)}

ORACLE: dict[str, str] = {
    "op1_minhash_dedup": minhash.SQL,
    "op4_line_dedup": line_dedup.SQL,
    "op3_shards": sharding.SQL.replace("{limit}", str(SHARD_BYTES)),
    "op5_exact_topk": topk.SQL,
    "op6_mix_sources": mixing.SQL,
    "op11_fill_in_middle": fim.SQL,
}
