"""Streaming twins of the usage operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import usage

LATE = "1 day"


def monthly_roll_up(events: DataFrame) -> DataFrame:
    """Running (tenant_id, period_month, tokens_used) of a stream of usage events, for update mode. Rows later than LATE are left to the reconcile."""
    months = F.trunc(F.col("created_at").cast("date"), "month").alias("period_month")
    return events.withWatermark("created_at", LATE).groupBy("tenant_id", months).agg(F.sum(usage.tokens()).cast("long").alias("tokens_used"))


def start_roll_up(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Adds each micro-batch to a roll-up kept as one folder for each batch, so a batch that runs again replaces its own rows and nothing is added twice."""

    def add(batch: DataFrame, number: int) -> None:
        usage.roll_up(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_roll_up(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("tenant_id", "period_month").agg(F.sum("tokens_used").cast("long").alias("tokens_used"))


def tumbling(events: DataFrame, ts: str, width: str, keys: list[str], late: str | None = None) -> DataFrame:
    """(window_start, *keys, n, total) in fixed windows of a batch or a stream."""
    source = events.withWatermark(ts, late) if late else events
    return source.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sliding_rate(events: DataFrame, ts: str, width: str, step: str, bad: F.Column | str) -> DataFrame:
    """(window_start, n, bad, rate) in sliding windows: the ratio that alert rules look at."""
    flag = F.expr(bad) if isinstance(bad, str) else bad
    found = events.groupBy(F.window(ts, width, step).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("bad"))
    return found.select(F.col("w.start").alias("window_start"), "n", "bad", (F.col("bad") / F.col("n")).alias("rate"))


def debounced(changes: DataFrame, ts: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    """(key, settled_at, n): one row when a key's changes have been quiet for the gap."""
    source = changes.withWatermark(ts, late) if late else changes
    return source.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.max(ts).alias("settled_at"), F.count(F.lit(1)).alias("n")).select(key, "settled_at", "n")
