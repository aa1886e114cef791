"""Alert rules over samples of counters and gauges, as a monitoring system evaluates them at regular times.

samples: (series, ts in seconds, value). A counter only grows but for resets to zero when its process starts anew; its increase over a range is what it grew, resets added back, extrapolated
to the ends of the range where samples come close enough to them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


class Rule(NamedTuple):
    name: str
    kind: str  # rate or increase of a counter over range_seconds, or value: a gauge's newest sample in range_seconds
    range_seconds: int
    above: float
    for_seconds: int
    by: str | None = None  # a column of samples over whose values series are summed


# The rules of the service by the metric they watch.
RULES = {
    "quota_rejections": Rule("QuotaRejectionSpike", "rate", 300, 0.1, 600, "limit"),
    "rate_limit_rejections": Rule("RateLimitRejectionSpike", "rate", 300, 1.0, 300, "kind"),
    "subsystem_degraded": Rule("SubsystemDegraded", "value", 300, 0.0, 120),
    "inflight_ingest": Rule("InflightIngestSaturation", "value", 300, 16.0, 300),
    "metering_write_failures": Rule("MeteringWriteFailures", "rate", 300, 0.0, 300),
    "queue_depth": Rule("IngestQueueDepthHigh", "value", 300, 100.0, 600),
    "queue_oldest_job_age": Rule("IngestQueueOldestJobStale", "value", 300, 1800.0, 300),
    "job_leases_reaped": Rule("WorkerLeaseReapSpike", "increase", 900, 3.0, 0),
    "queue_full_rejections": Rule("IngestQueueFullRejections", "increase", 600, 10.0, 0),
}


def _windows(samples: DataFrame, range_seconds: int, step: int) -> DataFrame:
    """Each sample at every evaluation time t, a multiple of step, with t - range < ts <= t."""
    first = F.ceil(F.col("ts") / step) * step
    last = (F.ceil((F.col("ts") + range_seconds) / step) - 1) * step
    return samples.withColumn("t", F.explode(F.when(last >= first, F.sequence(first.cast("long"), last.cast("long"), F.lit(step).cast("long"))).otherwise(F.array().cast("array<long>"))))


def increase(samples: DataFrame, range_seconds: int, step: int, *keys: str) -> DataFrame:
    """(series, *keys, t, increase) at every multiple of step seconds that has two samples or more of a series in the range before it.

    A value below the one before it is a reset, and what was counted until then is added. The growth between the first and the last sample is carried on to either end of the range if
    that is less than 1.1 mean distances of samples away, otherwise by half a mean distance, and at the start not beyond the time at which the counter was zero.
    """
    order = W.partitionBy("series").orderBy("ts")
    before = samples.withColumn("prior", F.lag("value").over(order)).withColumn("prior_ts", F.lag("ts").over(order))
    rows = _windows(before, range_seconds, step)
    reset = F.when((F.col("prior_ts") > F.col("t") - range_seconds) & (F.col("value") < F.col("prior")), F.col("prior")).otherwise(0.0)
    w = rows.groupBy("series", *keys, "t").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min_by("value", "ts").alias("first"), F.max_by("value", "ts").alias("last"), F.sum(reset).alias("resets")
    ).where((F.col("n") >= 2) & (F.col("last_ts") > F.col("first_ts")))
    grown = F.col("last") - F.col("first") + F.col("resets")
    span = (F.col("last_ts") - F.col("first_ts")).cast("double")
    mean = span / (F.col("n") - 1)

    def reach(gap: Column) -> Column:
        return F.when(gap >= mean * 1.1, mean / 2).otherwise(gap)

    from_zero = F.when((grown > 0) & (F.col("first") >= 0), span * F.col("first") / grown)
    start = F.least(reach(F.col("first_ts") - F.col("t") + range_seconds), from_zero)
    whole = span + start + reach(F.col("t") - F.col("last_ts"))
    return w.select("series", *keys, "t", (grown * whole / span).alias("increase"))


def evaluate(samples: DataFrame, rule: Rule, step: int) -> DataFrame:
    """(label, t, value): what a rule compares at each time; label is the value of its `by` column, or the series."""
    by = [rule.by] if rule.by else []
    if rule.kind == "value":
        told = _windows(samples, rule.range_seconds, step).groupBy("series", *by, "t").agg(F.max_by("value", "ts").alias("value"))
    else:
        told = increase(samples, rule.range_seconds, step, *by).withColumnRenamed("increase", "value")
        told = told.withColumn("value", F.col("value") / rule.range_seconds) if rule.kind == "rate" else told
    if not rule.by:
        return told.select(F.col("series").alias("label"), "t", "value")
    return told.groupBy(F.col(rule.by).alias("label"), "t").agg(F.sum("value").alias("value"))


def states(values: DataFrame, rule: Rule, step: int) -> DataFrame:
    """(label, t, value, active_since, state) at the times when a rule's condition holds: firing once it has held at every evaluation for for_seconds, pending before. A time without a value
    ends the alert."""
    hot = values.where(F.col("value") > rule.above)
    run = F.col("t") - step * F.row_number().over(W.partitionBy("label").orderBy("t"))  # the same for times that follow each other
    since = hot.withColumn("run", run).withColumn("active_since", F.min("t").over(W.partitionBy("label", "run")))
    return since.select("label", "t", "value", "active_since", F.when(F.col("t") - F.col("active_since") >= rule.for_seconds, "firing").otherwise("pending").alias("state"))


def alerts(samples: DataFrame, rule: Rule, step: int) -> DataFrame:
    """(rule, label, t, value, active_since, state) of one rule over its metric's samples, evaluated every step seconds."""
    return states(evaluate(samples, rule, step), rule, step).select(F.lit(rule.name).alias("rule"), "*")
