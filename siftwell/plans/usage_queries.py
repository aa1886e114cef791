"""Usage, quota and budget queries over the events, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import media, quota
from ..operators import usage
from ..streaming import usage_stream
from . import fixtures as fx
from .registry import query

MONTH = "2024-01-01"
TOKENS = "coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0)"
ROLL_UP = f"SELECT tenant_id, CAST(date_trunc('month', created_at) AS DATE) AS period_month, CAST(sum({TOKENS}) AS BIGINT) AS tokens_used FROM {{}} GROUP BY ALL HAVING sum({TOKENS}) > 0"


def _sql(body: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes)} {body}"


@query(_sql(f"SELECT tenant_id, CAST(coalesce(sum({TOKENS}) FILTER (WHERE created_at >= TIMESTAMP '{MONTH}'), 0) AS BIGINT) AS tokens FROM tenants LEFT JOIN usage USING (tenant_id) GROUP BY tenant_id", fx.USAGE, fx.TENANTS))
def monthly_tokens(spark: SparkSession, d: str) -> DataFrame:
    return usage.monthly_tokens(fx.usage_events(spark, d), fx.tenants(spark, d), fx.AS_OF)


@query(_sql(f"""
    SELECT u.tenant_id, u.user_id, CASE WHEN u.user_id IS NULL THEN 'system' ELSE coalesce(email, 'user ' || u.user_id) END AS label, tokens
    FROM (SELECT tenant_id, user_id, CAST(sum({TOKENS}) AS BIGINT) AS tokens FROM usage WHERE created_at >= TIMESTAMP '{MONTH}' GROUP BY ALL) u
    LEFT JOIN users k ON k.tenant_id = u.tenant_id AND k.user_id = u.user_id""", fx.USAGE, fx.USERS))
def tokens_by_user(spark: SparkSession, d: str) -> DataFrame:
    return usage.by_user(fx.usage_events(spark, d), fx.users(spark, d), fx.AS_OF)


DAILY = "SELECT strftime(created_at, '%Y-%m-%d') AS day, CAST(sum(coalesce(prompt_tokens, 0)) AS BIGINT) AS prompt, CAST(sum(coalesce(completion_tokens, 0)) AS BIGINT) AS completion FROM usage GROUP BY day"


@query(_sql(DAILY, fx.USAGE))
def daily_tokens(spark: SparkSession, d: str) -> DataFrame:
    return usage.daily(fx.usage_events(spark, d))


@query(_sql("SELECT strftime(r.day, '%Y-%m-%d') AS day, coalesce(prompt, 0) AS prompt, coalesce(completion, 0) AS completion FROM (SELECT unnest(range(DATE '2023-12-28', DATE '2024-02-05', INTERVAL 1 DAY)) AS day) r LEFT JOIN daily ON daily.day = strftime(r.day, '%Y-%m-%d')", fx.USAGE, f"daily AS ({DAILY})"))
def daily_tokens_filled(spark: SparkSession, d: str) -> DataFrame:
    return usage.daily_filled(fx.usage_events(spark, d), "2023-12-28", "2024-02-04")


@query(_sql("SELECT tenant_id, CAST(date_trunc('month', created_at) AS DATE) AS month, CAST(sum(cost_micros) AS BIGINT) AS micros FROM usage WHERE cost_micros IS NOT NULL GROUP BY ALL", fx.USAGE))
def monthly_cost(spark: SparkSession, d: str) -> DataFrame:
    return usage.monthly_cost(fx.usage_events(spark, d))


@query(_sql(ROLL_UP.format("usage"), fx.USAGE))
def monthly_roll_up(spark: SparkSession, d: str) -> DataFrame:
    """The roll-up as increments leave it: two loads added up."""
    events = fx.usage_events(spark, d)
    return usage.add_roll_up(usage.roll_up(events.where("event_id % 2 = 0")), usage.roll_up(events.where("event_id % 2 != 0")))


@query(_sql("SELECT tenant_id, period_month, coalesce(s.tokens_used, 0) AS stored, coalesce(a.tokens_used, 0) AS actual, coalesce(a.tokens_used, 0) - coalesce(s.tokens_used, 0) AS drift FROM a FULL JOIN s USING (tenant_id, period_month) WHERE drift <> 0", fx.USAGE, "late AS (SELECT * FROM usage WHERE event_id % 10 <> 0)", f"a AS ({ROLL_UP.format('usage')})", f"s AS ({ROLL_UP.format('late')})"))
def rollup_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Drift of a stored roll-up that missed every tenth event."""
    events = fx.usage_events(spark, d)
    return usage.reconcile(events, usage.roll_up(events.where("event_id % 10 != 0")))


USED = f"used AS (SELECT tenant_id, CAST(sum({TOKENS}) AS BIGINT) AS used FROM usage GROUP BY tenant_id)"


@query(_sql("""
    SELECT tenant_id, coalesce(quota_override, quota)::BIGINT AS cap, coalesce(used, 0) AS used,
           CASE WHEN coalesce(used, 0) >= cap THEN 'atcap' WHEN coalesce(used, 0) * 100 >= cap * 80 THEN 'warn' ELSE 'none' END AS level, coalesce(used, 0) + 1 > cap AS exceeded
    FROM tenants LEFT JOIN plans USING (plan_id) LEFT JOIN used USING (tenant_id)""", fx.USAGE, fx.TENANTS, fx.PLANS, USED))
def quota_status(spark: SparkSession, d: str) -> DataFrame:
    used = fx.usage_events(spark, d).groupBy("tenant_id").agg(F.sum(usage.tokens()).alias("used"))
    return usage.quota_status(used, fx.tenants(spark, d), fx.plans(spark))


PRICED = "priced AS (SELECT p_brand AS brand, p_partkey AS plan_id, CAST(floor(p_retailprice) AS BIGINT) AS price_cents FROM part)"
NEXT = "next AS (SELECT p.brand, p.plan_id, (SELECT q.plan_id FROM priced q WHERE q.brand = p.brand AND q.price_cents > p.price_cents ORDER BY q.price_cents, q.plan_id LIMIT 1) AS next_plan FROM priced p)"


def _priced(spark: SparkSession, d: str) -> DataFrame:
    """Parts as price lists of plans, one for each brand."""
    return fx.read(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("plan_id"), F.floor("p_retailprice").cast("long").alias("price_cents"))


@query(_sql("SELECT brand, plan_id, next_plan FROM next", PRICED, NEXT))
def upsell_plan(spark: SparkSession, d: str) -> DataFrame:
    return usage.upsell(_priced(spark, d), "brand")


@query(_sql("SELECT brand, plan_id, CASE WHEN plan_id % 5 <> 0 AND next_plan IS NOT NULL THEN 'Upgrade from p' || plan_id || ' to p' || next_plan || ' for more capacity' WHEN plan_id % 5 <> 0 THEN 'Consider upgrading your plan for more capacity' WHEN next_plan IS NOT NULL THEN 'Upgrade to p' || next_plan || ' for more capacity' END AS message FROM next", PRICED, NEXT))
def upsell_message(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth plan's code is unknown."""
    found = usage.upsell(_priced(spark, d), "brand")
    own, after = (F.concat(F.lit("p"), F.col(c).cast("string")) for c in ("plan_id", "next_plan"))
    return found.select("brand", "plan_id", quota.upsell_message(F.when(F.col("plan_id") % 5 != 0, own), after).alias("message"))


@query("""
    SELECT l_orderkey, l_linenumber,
           CASE WHEN l_linenumber = 7 THEN $$select='gt(scene,0.4)'$$ WHEN l_linenumber % 3 = 0 THEN $$select='gt(scene,0.4)'$$
                WHEN l_linenumber % 3 = 1 THEN 'thumbnail=n=' || CAST(greatest(1, ceil(greatest(1, ceil(l_quantity * 25)) / (7 - l_linenumber))) AS BIGINT) ELSE 'fps=' || (7 - l_linenumber) || '/' || CAST(l_quantity AS BIGINT) END AS filter, 7 - l_linenumber AS frames
    FROM lineitem
""")
def keyframe_plan(spark: SparkSession, d: str) -> DataFrame:
    """Line items as videos: duration and rate, the duration only, or neither is known."""
    line, k = fx.read(spark, d, "lineitem"), F.col("l_linenumber")
    plan = media.keyframe_plan(F.when(k % 3 != 0, F.col("l_quantity")), F.when(k % 3 == 1, F.lit(25.0)), (7 - k))
    return line.select("l_orderkey", "l_linenumber", F.inline(F.array(plan)))


@query(_sql("""
    SELECT tenant_id, coalesce(micros, 0) AS micros, budget_cents <= 0 AS unlimited, budget_cents > 0 AND coalesce(micros, 0) >= budget_cents * 10000 AS exceeded,
           CASE WHEN budget_cents > 0 THEN coalesce(micros, 0) // (budget_cents * 10000 // 100) END AS percent
    FROM tenants LEFT JOIN (SELECT tenant_id, CAST(sum(cost_micros) AS BIGINT) AS micros FROM usage GROUP BY tenant_id) USING (tenant_id)""", fx.USAGE, fx.TENANTS))
def budget_status(spark: SparkSession, d: str) -> DataFrame:
    spent = fx.usage_events(spark, d).groupBy("tenant_id").agg(F.sum("cost_micros").alias("micros"))
    full = fx.tenants(spark, d).join(spent, "tenant_id", "left").withColumn("micros", F.coalesce("micros", F.lit(0)).cast("long"))
    return full.select("tenant_id", "micros", F.inline(F.array(quota.budget_status(F.col("micros"), F.col("budget_cents")))))


@query("SELECT l_orderkey, l_linenumber, CAST(ceil((l_quantity * 1000 / 1e6 * 0.25 + l_extendedprice / 1e6 * 1.25) * 1e6) AS BIGINT) AS micros FROM lineitem")
def cost_micros(spark: SparkSession, d: str) -> DataFrame:
    return fx.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", quota.cost_micros(F.col("l_quantity") * 1000, F.col("l_extendedprice"), F.lit(0.25), F.lit(1.25)).alias("micros"))


@query(_sql("SELECT tenant_id, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM docs GROUP BY tenant_id", fx.DOCUMENTS))
def storage_usage(spark: SparkSession, d: str) -> DataFrame:
    return usage.storage(fx.documents(spark, d))


@query(_sql("SELECT tenant_id, count(*) AS documents, count(*) FILTER (WHERE superseded_at IS NULL) AS files, count(DISTINCT lang) AS tags FROM docs GROUP BY tenant_id", fx.DOCUMENTS))
def tenant_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = fx.documents(spark, d)
    return usage.counts(docs, docs, docs.select("tenant_id", "lang").distinct())


@query(_sql(f"SELECT tenant_id, coalesce(used, 0) + 1 <= budget_cents AS allowed FROM tenants LEFT JOIN used USING (tenant_id)", fx.USAGE, fx.TENANTS, USED))  # noqa: F541
def budget_gate(spark: SparkSession, d: str) -> DataFrame:
    return usage.gate(usage.roll_up(fx.usage_events(spark, d)), fx.tenants(spark, d).withColumnRenamed("budget_cents", "token_budget"), fx.AS_OF)


@query(_sql("SELECT event_id, tenant_id, role FROM usage ORDER BY created_at DESC, event_id DESC LIMIT 50", fx.USAGE))
def recent_activity(spark: SparkSession, d: str) -> DataFrame:
    """A feed of 50: the limit is the feature."""
    return usage.recent(fx.usage_events(spark, d), 50, [F.col("created_at").desc(), F.col("event_id").desc()]).select("event_id", "tenant_id", "role")


@query(_sql("SELECT bound::DOUBLE AS bound, (SELECT count(*) FROM usage WHERE value <= bound) AS n FROM (SELECT unnest([10, 50, 100, 250, 'inf'::DOUBLE]) AS bound)", fx.USAGE))
def usage_histogram(spark: SparkSession, d: str) -> DataFrame:
    return usage.histogram(fx.usage_events(spark, d), "value", [10, 50, 100, 250])


@query()
def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    return usage.latency_summary(fx.usage_events(spark, d), ["role"], "value")


@query(_sql("SELECT role, CASE role WHEN 'embed' THEN 'indexing' WHEN 'rerank' THEN 'ranking' WHEN 'vision' THEN 'captioning' ELSE 'writing' END AS activity, CASE WHEN sum(cost_micros) IS NULL THEN '-' ELSE printf('$%.2f', sum(cost_micros) / 1e6) END AS spend FROM usage GROUP BY role", fx.USAGE))
def activity_labels(spark: SparkSession, d: str) -> DataFrame:
    spent = fx.usage_events(spark, d).groupBy("role").agg(F.sum("cost_micros").alias("micros"))
    return spent.select("role", quota.activity(F.col("role")).alias("activity"), quota.spend_label(F.col("micros")).alias("spend"))


@query(_sql("SELECT time_bucket(INTERVAL 1 HOUR, created_at)::TIMESTAMP AS window_start, role, count(*) AS n, round(sum(value), 4) AS total FROM usage GROUP BY ALL", fx.USAGE))
def tumbling_usage(spark: SparkSession, d: str) -> DataFrame:
    found = usage_stream.tumbling(fx.usage_events(spark, d), "created_at", "1 hour", ["role"])
    return found.withColumn("total", F.round("total", 4))


@query(_sql("""
    SELECT user_id, max(created_at) AS settled_at, count(*) AS n FROM (
        SELECT *, sum(CASE WHEN created_at < before + INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY created_at, event_id) AS session
        FROM (SELECT *, lag(created_at) OVER (PARTITION BY user_id ORDER BY created_at, event_id) AS before FROM usage WHERE user_id IS NOT NULL)
    ) GROUP BY user_id, session""", fx.USAGE))
def session_debounce(spark: SparkSession, d: str) -> DataFrame:
    return usage_stream.debounced(fx.usage_events(spark, d).where("user_id is not null"), "created_at", "30 minutes", "user_id")


@query(_sql("""
    SELECT window_start, count(*) AS n, count(*) FILTER (WHERE role = 'code') AS bad, round(count(*) FILTER (WHERE role = 'code') / count(*), 6) AS rate
    FROM (SELECT role, unnest([time_bucket(INTERVAL 5 MINUTE, created_at), time_bucket(INTERVAL 5 MINUTE, created_at) - INTERVAL 5 MINUTE, time_bucket(INTERVAL 5 MINUTE, created_at) - INTERVAL 10 MINUTE])::TIMESTAMP AS window_start FROM usage)
    GROUP BY window_start""", fx.USAGE))
def sliding_error_rate(spark: SparkSession, d: str) -> DataFrame:
    found = usage_stream.sliding_rate(fx.usage_events(spark, d), "created_at", "15 minutes", "5 minutes", "role = 'code'")
    return found.withColumn("rate", F.round("rate", 6))
