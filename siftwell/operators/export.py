"""Export as typed JSON lines, with a manifest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = ("document", "file", "tag", "tag_alias", "document_tag", "chunk")


def lines(relations: dict[str, DataFrame]) -> DataFrame:
    """(type, line): every row of every relation as a JSON object that names its type."""
    parts = [df.select(F.lit(name).alias("type"), F.to_json(F.struct(F.lit(name).alias("type"), F.struct(*df.columns).alias("data"))).alias("line")) for name, df in relations.items()]
    return reduce(DataFrame.unionByName, parts)


def manifest(relations: dict[str, DataFrame]) -> DataFrame:
    """(type, n, bytes): rows of each relation and the bytes of those that have a size."""
    parts = [df.agg(F.lit(name).alias("type"), F.count(F.lit(1)).alias("n"), (F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long") if "size_bytes" in df.columns else F.lit(0).cast("long")).alias("bytes")) for name, df in relations.items()]
    return reduce(DataFrame.unionByName, parts)


def write(relations: dict[str, DataFrame], path: str) -> None:
    """Text files by type under path, beside the manifest as JSON. One folder takes the place of an archive, which no cluster writes in parallel."""
    lines(relations).write.mode("overwrite").partitionBy("type").option("compression", "gzip").text(f"{path}/lines")
    manifest(relations).write.mode("overwrite").json(f"{path}/manifest")


def row_counts(relations: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.lit(name).alias("relation"), F.count(F.lit(1)).alias("n")) for name, df in relations.items()])
