"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import decontaminate, exact_dedup, langid, near_dedup, piece_sampling
from siftwell.llm.common import settings_kept, shared_folder, table, use_small_batches

#: SQL can't express the model stages; tests/llm hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the others go."""
    return langid.keep_identified(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_one(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of every document that is left."""
    found = docs.select("doc_id", "lang", "source", piece_sampling.round_trip(F.col("text"), F.col("doc_id")).alias("told"))
    return found.select("doc_id", "lang", "source", "told.ids", F.coalesce(F.size("told.ids"), F.lit(0)).alias("n_tokens"), "told.lossless")


def _whole_texts(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage in a session with small batches. They are read when its result is written, so whoever calls a stage by itself has them until the session says otherwise."""

    @wraps(stage)
    def ready(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        use_small_batches(spark)
        return stage(spark, docs, sf_dir)

    return ready


STAGES = [
    ("language_id", _whole_texts(language_id)),
    ("exact_dedup", _whole_texts(exact_duplicates)),
    ("near_dedup", _whole_texts(near_duplicates)),
    ("decontamination", _whole_texts(benchmark_leaks)),
    ("sentencepiece", _whole_texts(pieces)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    with settings_kept(spark):  # every stage is written in here; what is returned only reads
        for k, (name, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
