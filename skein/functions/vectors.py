"""Vector arithmetic on arrays with higher-order functions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different or no length, null or without direction."""
    length = norm(a) * norm(b)
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0) & (length > 0)
    return F.when(usable, dot(a, b) / length).otherwise(0.0)


def from_text(vector: Column) -> Column:
    """An array from "[a,b,...]"; null where it can't be read."""
    return F.from_json(vector, "array<double>")


def to_text(vector: Column) -> Column:
    return F.to_json(vector)
