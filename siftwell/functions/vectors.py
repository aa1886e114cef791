"""Vectors as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null for vectors of unequal length or without length; else within -1 and 1."""
    lengths = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (lengths > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / lengths)))


def check_dimension(a: Column, width: int) -> Column:
    """The vector itself; any other length is an error."""
    return F.when(F.size(a) == width, a).otherwise(F.raise_error(F.format_string("vector of %d values where %d are expected", F.size(a), F.lit(width))))


def to_text(a: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ","), F.lit("]"))


def from_text(text: Column) -> Column:
    return F.from_json(text, "array<float>")
