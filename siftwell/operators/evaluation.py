"""Retrieval evaluation: recall at k, reciprocal rank, regression gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 0.001


def per_query(expected: DataFrame, hits: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """(query_id, recall_at_k..., rr). expected: (query_id, expected_ids); hits: ranked documents. Nothing expected counts as found, no hit as zero."""
    got = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "document_id"))).alias("r")).select("query_id", F.transform("r", lambda x: x["document_id"]).alias("got"))
    both = expected.join(got, "query_id", "left").withColumn("got", F.coalesce("got", F.array().cast("array<bigint>")))
    n = F.size("expected_ids")
    recall = [F.when(n == 0, 1.0).otherwise(F.size(F.array_intersect(F.slice("got", 1, k), F.col("expected_ids"))) / n).alias(f"recall_at_{k}") for k in ks]
    places = F.filter(F.transform("got", lambda d, i: F.when(F.array_contains("expected_ids", d), i + 1)), lambda i: i.isNotNull())
    return both.select("query_id", *recall, F.when(n == 0, 1.0).when(F.size(places) > 0, 1.0 / F.array_min(places)).otherwise(0.0).alias("rr"))


def summary(scores: DataFrame) -> DataFrame:
    """One row of means; without queries all are 1."""
    names = [c for c in scores.columns if c != "query_id"]
    return scores.agg(*[F.coalesce(F.avg(c), F.lit(1.0)).alias("mrr" if c == "rr" else c) for c in names])


def regressions(current: DataFrame, baseline: dict[str, float]) -> DataFrame:
    """(metric, value, baseline) for every metric below its baseline by more than the tolerance."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(b).alias("baseline")) for m, b in baseline.items()])
    return current.select(F.inline(rows)).where(F.col("value") < F.col("baseline") - TOLERANCE)
