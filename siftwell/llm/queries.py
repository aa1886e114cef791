"""The registered queries: each applies its operator, with production parameters, to the whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, filter_audit, langid, license_scan, merkle, piece_sampling, quality, simhash, substring_dedup, token_counts, toxicity, url_filter
from .common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the best window."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", F.round("similarity", 6).alias("similarity"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage repeated elsewhere, with the passages."""
    return substring_dedup.repeated(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints over 3-word shingles and components of links at two bits or fewer."""
    found = simhash.near_components(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    return langid.identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled pieces of every document: their number, a digest of their ids and whether decoding gives the text back."""
    found = piece_sampling.tokenize(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_tokens", F.xxhash64("ids").alias("ids_digest"), "lossless")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    return quality.assess(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its group."""
    return exact_dedup.assign(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return token_counts.count(table(spark, sf_dir, "documents"), rule="majority")


# The rules of the URL query.
URL_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, deciding rule and verdict."""
    judged = url_filter.judge(table(spark, sf_dir, "pages", "page_id", "url"), url_filter.rule_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license phrases, labels and best template containment."""
    found = license_scan.scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", F.round("score", 6).alias("score"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters does at each step of each order of them, for each source."""
    return filter_audit.audit(table(spark, sf_dir, "documents", "doc_id", "source", "text"), table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and roots; half of the documents are verified without their line breaks."""
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    bare = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    changed = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n"))
    presented = F.when(changed, merkle.leaf_digest(*(bare if f == "text" else F.col(f) for f in fields)))
    proved = merkle.manifest(table(spark, sf_dir, "documents", *fields), fields, presented=presented)
    told = proved.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest("proof").alias("proof_sha256"), merkle.folded("presented", "proof").alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    return toxicity.assess(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels"))


_ALL = (
    op1_decontaminate, op2_substring_dedup, op3_simhash, op4_langid, op5_sentencepiece, op6_quality, op7_exact_dedup, op8_token_counts, op9_url_filter, op10_license_scan,
    op11_filter_audit, op12_merkle_manifest, op13_toxicity,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
