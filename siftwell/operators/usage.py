"""Usage metering: token and cost sums, roll-ups and their reconciliation, storage, counts, quotas and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import quota


def tokens() -> Column:
    return F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))


def since_month_start(events: DataFrame, as_of: str) -> DataFrame:
    """Events of as_of's calendar month (UTC)."""
    start = F.date_trunc("month", F.lit(as_of).cast("timestamp_ntz")).cast("timestamp_ntz")
    return events.where(F.col("created_at") >= start)


def monthly_tokens(events: DataFrame, tenants: DataFrame, as_of: str) -> DataFrame:
    """(tenant_id, tokens) for every tenant, zero without events."""
    used = since_month_start(events, as_of).groupBy("tenant_id").agg(F.sum(tokens()).alias("used"))
    return tenants.select("tenant_id").join(used, "tenant_id", "left").select("tenant_id", F.coalesce("used", F.lit(0)).cast("long").alias("tokens"))


def by_user(events: DataFrame, users: DataFrame, as_of: str) -> DataFrame:
    """(tenant_id, user_id, label, tokens); events without a user are the system's. Users are matched within their tenant."""
    used = since_month_start(events, as_of).groupBy("tenant_id", "user_id").agg(F.sum(tokens()).cast("long").alias("tokens"))
    known = users.select("tenant_id", "user_id", "email")
    label = F.when(F.col("user_id").isNull(), "system").otherwise(F.coalesce("email", F.concat(F.lit("user "), F.col("user_id").cast("string"))))
    return used.join(known, ["tenant_id", "user_id"], "left").select("tenant_id", "user_id", label.alias("label"), "tokens")


def daily(events: DataFrame) -> DataFrame:
    """(day, prompt, completion) of days that have events."""
    return events.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(
        F.sum(F.coalesce("prompt_tokens", F.lit(0))).cast("long").alias("prompt"), F.sum(F.coalesce("completion_tokens", F.lit(0))).cast("long").alias("completion")
    )


def daily_filled(events: DataFrame, first: str, last: str) -> DataFrame:
    """daily() with a row of zeros for every other day of the range."""
    days = events.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day")).select(F.col("day").cast("string"))
    return days.join(daily(events), "day", "left").select("day", F.coalesce("prompt", F.lit(0)).alias("prompt"), F.coalesce("completion", F.lit(0)).alias("completion"))


def monthly_cost(events: DataFrame) -> DataFrame:
    """(tenant_id, month, micros) over events that have a cost."""
    return events.where("cost_micros is not null").groupBy("tenant_id", F.trunc(F.col("created_at").cast("date"), "month").alias("month")).agg(F.sum("cost_micros").cast("long").alias("micros"))


def roll_up(events: DataFrame) -> DataFrame:
    """(tenant_id, period_month, tokens_used); months without tokens have no row."""
    months = F.trunc(F.col("created_at").cast("date"), "month").alias("period_month")
    return events.groupBy("tenant_id", months).agg(F.sum(tokens()).cast("long").alias("tokens_used")).where("tokens_used > 0")


def add_roll_up(current: DataFrame, batch: DataFrame) -> DataFrame:
    """A roll-up with another added to it, as an incremental load does."""
    return current.unionByName(batch).groupBy("tenant_id", "period_month").agg(F.sum("tokens_used").cast("long").alias("tokens_used"))


def reconcile(events: DataFrame, stored: DataFrame) -> DataFrame:
    """(tenant_id, period_month, stored, actual, drift) where the stored roll-up is off; actual is what belongs there."""
    actual = roll_up(events).withColumnRenamed("tokens_used", "actual")
    both = actual.join(stored.withColumnRenamed("tokens_used", "stored"), ["tenant_id", "period_month"], "full_outer")
    out = both.select("tenant_id", "period_month", F.coalesce("stored", F.lit(0)).alias("stored"), F.coalesce("actual", F.lit(0)).alias("actual"))
    return out.withColumn("drift", F.col("actual") - F.col("stored")).where("drift != 0")


def storage(files: DataFrame) -> DataFrame:
    """(tenant_id, bytes) over all files, superseded ones included."""
    return files.groupBy("tenant_id").agg(F.sum("size_bytes").cast("long").alias("bytes"))


def counts(documents: DataFrame, files: DataFrame, tags: DataFrame) -> DataFrame:
    """(tenant_id, documents, files, tags); superseded files don't count."""
    one = lambda df, what: df.groupBy("tenant_id").agg(F.count(F.lit(1)).alias(what))
    joined = one(documents, "documents").join(one(files.where("superseded_at is null"), "files"), "tenant_id", "full_outer").join(one(tags, "tags"), "tenant_id", "full_outer")
    return joined.select("tenant_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "files", "tags")])


def quota_status(used: DataFrame, tenants: DataFrame, plans: DataFrame) -> DataFrame:
    """(tenant_id, cap, used, level, exceeded). used: (tenant_id, used); tenants: (tenant_id, plan_id, quota_override); plans: (plan_id, quota)."""
    full = tenants.join(plans.select("plan_id", "quota"), "plan_id", "left").join(used, "tenant_id", "left")
    cap, u = quota.effective_quota(F.col("quota_override"), F.col("quota")), F.coalesce("used", F.lit(0))
    return full.select("tenant_id", cap.alias("cap"), u.cast("long").alias("used"), quota.usage_level(u, cap).alias("level"), quota.exceeds(cap, u, F.lit(1)).alias("exceeded"))


def upsell(plans: DataFrame, *groups: str) -> DataFrame:
    """(*groups, plan_id, next_plan): the cheapest plan of the group that costs more, the smaller id of equal ones; null at the top. plans: (*groups, plan_id, price_cents)."""
    prices = plans.groupBy(*groups, "price_cents").agg(F.min("plan_id").alias("plan"))
    step = prices.withColumn("next_plan", F.lead("plan").over(W.partitionBy(*groups).orderBy("price_cents"))).select(*groups, "price_cents", "next_plan")
    return plans.join(step, [*groups, "price_cents"]).select(*groups, "plan_id", "next_plan")


def gate(stored: DataFrame, tenants: DataFrame, as_of: str) -> DataFrame:
    """(tenant_id, allowed) from the roll-up of as_of's month: no budget or one token still free."""
    month = F.trunc(F.lit(as_of).cast("date"), "month")
    used = stored.where(F.col("period_month") == month).select("tenant_id", "tokens_used")
    full = tenants.join(used, "tenant_id", "left")
    return full.select("tenant_id", (~quota.exceeds(F.col("token_budget"), F.coalesce("tokens_used", F.lit(0)), F.lit(1))).alias("allowed"))


def recent(rows: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The newest n rows: a feed."""
    return rows.orderBy(*order).limit(n)


def latency_summary(events: DataFrame, keys: list[str], value: str = "latency_ms") -> DataFrame:
    """Count, approximate median and 95th percentile by key."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(value, 0.5, 10_000).alias("p50"), F.percentile_approx(value, 0.95, 10_000).alias("p95"))


def histogram(events: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """(bound, n): cumulative counts of values at or below each bound, infinity last."""
    sums = events.agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(value).alias("rest"))
    rows = F.array(*[F.struct(F.lit(float(b)).alias("bound"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(float("inf")).alias("bound"), F.col("rest").alias("n")))
    return sums.select(F.inline(rows))
