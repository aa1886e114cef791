"""Quotas, budgets, prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WARN_PERCENT = 80


def exceeds(limit: Column, current: Column, additional: Column) -> Column:
    """Whether current + additional is over the limit; no limit never is, an overflowing sum always."""
    total = F.try_add(current, additional)
    return F.when(limit.isNull(), F.lit(False)).otherwise(total.isNull() | (total > limit))


def usage_level(used: Column, cap: Column) -> Column:
    """none, warn from 80 % on, or atcap; no cap or one of zero or less is none."""
    used = F.greatest(used, F.lit(0))
    return F.when(cap.isNull() | (cap <= 0), "none").when(used >= cap, "atcap").when(used.cast("decimal(38,0)") * 100 >= cap.cast("decimal(38,0)") * WARN_PERCENT, "warn").otherwise("none")


def effective_quota(override: Column, plan: Column) -> Column:
    return F.coalesce(override, plan)


def cost_micros(prompt: Column, completion: Column, price_in: Column, price_out: Column) -> Column:
    """Millionths of a unit for tokens priced by the million, rounded up."""
    return F.ceil((prompt / 1e6 * price_in + completion / 1e6 * price_out) * 1e6).cast("long")


def budget_status(spent_micros: Column, budget_cents: Column) -> Column:
    """struct<unlimited, exceeded, percent>; a budget of null, zero or less is unlimited. One cent is 10,000 micros."""
    budget = budget_cents.cast("long") * 10_000
    limited = budget_cents.isNotNull() & (budget_cents > 0)
    percent = F.when(limited, F.call_function("div", spent_micros, F.call_function("div", budget, F.lit(100).cast("long")))).cast("long")
    return F.struct((~limited).alias("unlimited"), (limited & (spent_micros >= budget)).alias("exceeded"), percent.alias("percent"))


def plan_features(features: Column) -> Column:
    """struct<remote_models, max_users, rate_per_minute> of a plan's JSON."""
    return F.struct(
        F.coalesce(F.get_json_object(features, "$.remote_models").cast("boolean"), F.lit(False)).alias("remote_models"),
        F.get_json_object(features, "$.max_users").cast("int").alias("max_users"),
        F.get_json_object(features, "$.rate_caps.per_minute").cast("int").alias("rate_per_minute"),
    )


def spend_label(micros: Column) -> Column:
    return F.when(micros.isNull(), "-").otherwise(F.format_string("$%.2f", micros / 1e6))


def activity(role: Column) -> Column:
    """What a call by role was for."""
    return F.when(role == "embed", "indexing").when(role == "rerank", "ranking").when(role == "vision", "captioning").otherwise("writing")


def degraded(states: dict[str, Column]) -> Column:
    """Names of the subsystems that are down, joined by commas; null if none is."""
    names = F.array(*[F.when(down, F.lit(name)) for name, down in states.items()])
    return F.nullif(F.array_join(F.filter(names, lambda n: n.isNotNull()), ", "), F.lit(""))


def upsell_message(plan: Column, upgrade: Column) -> Column:
    """What a tenant at its limit is told, by the codes of its plan and of the next one; null if neither is known."""
    more = F.lit(" for more capacity")
    return (
        F.when(plan.isNotNull() & upgrade.isNotNull(), F.concat(F.lit("Upgrade from "), plan, F.lit(" to "), upgrade, more))
        .when(plan.isNotNull(), "Consider upgrading your plan for more capacity")
        .when(upgrade.isNotNull(), F.concat(F.lit("Upgrade to "), upgrade, more))
    )
