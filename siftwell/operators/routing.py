"""Model routing tables and candidate orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def enabled_routes(routes: DataFrame, models: DataFrame, providers: DataFrame) -> DataFrame:
    """routes with their model and provider where both are enabled. Models and providers are catalogues that Spark broadcasts if they are small."""
    m = models.where("model_enabled").select("model_id", "provider_id", "price_in", "price_out")
    p = providers.where("provider_enabled").select("provider_id", "provider_name", "data_class")
    return routes.join(m, "model_id").join(p, "provider_id")


def for_tenants(routes: DataFrame, tenants: DataFrame, legacy: bool = False) -> DataFrame:
    """(tenant_id, role, tier, model_id, own): each tenant's routes; a tenant's own row of a role, tier and model hides the global one (for everybody, if legacy)."""
    own = routes.where("tenant_id is not null")
    shared = routes.where("tenant_id is null").drop("tenant_id")
    keys = ["role", "tier", "model_id"]
    if legacy:
        spread = tenants.select("tenant_id").join(F.broadcast(shared.join(own, keys, "left_anti")))
    else:
        spread = tenants.select("tenant_id").join(F.broadcast(shared)).join(own.select("tenant_id", *keys), ["tenant_id", *keys], "left_anti")
    return spread.select("tenant_id", *keys, F.lit(False).alias("own")).unionByName(own.select("tenant_id", *keys, F.lit(True).alias("own")))


def tiers(routes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (tenant_id, role) with the tenant's tiers of the role, or else the global ones."""
    own = routes.where("tenant_id is not null").select("tenant_id", "role", "tier", "model_id")
    shared = routes.where("tenant_id is null").select("role", "tier", "model_id")
    without = wanted.join(own, ["tenant_id", "role"], "left_anti").join(shared, "role")
    return wanted.join(own, ["tenant_id", "role"]).select("tenant_id", "role", "tier", "model_id").unionByName(without.select("tenant_id", "role", "tier", "model_id"))


def cost(price_in: Column, price_out: Column) -> Column:
    return ((F.coalesce(price_in, F.lit(0.0)) + F.coalesce(price_out, F.lit(0.0))) * 1e6).cast("long")


def candidate_order(strategy: str) -> list[Column]:
    """Order of a tier's candidates (free_slots, in_flight, seq, priority, price_in, price_out, model_id)."""
    return {
        "least_loaded": [F.col("in_flight").asc(), F.col("model_id").asc()],
        "round_robin": [F.col("seq").asc(), F.col("model_id").asc()],
        "cost_asc": [cost(F.col("price_in"), F.col("price_out")).asc(), F.col("model_id").asc()],
        "priority": [F.col("priority").desc(), F.col("free_slots").desc(), F.col("model_id").asc()],
    }[strategy]
