"""Vector columns. Vectors are stored as array<float>; arithmetic is in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    """L2 norm; 1 for the zero vector, so that dividing by it is always defined."""
    n = F.sqrt(_total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))
    return F.when(n == 0, 1.0).otherwise(n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def l2_normalize(a: Column) -> Column:
    return F.transform(F.arrays_zip(a.alias("x"), F.array_repeat(norm(a), F.size(a)).alias("n")),
                       lambda p: p["x"].cast("double") / p["n"])
