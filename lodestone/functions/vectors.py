"""Vector columns.  All arithmetic is in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, value: total + value)


def dot(left: Column, right: Column) -> Column:
    return _sum(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")))


def norm(vector: Column) -> Column:
    return F.sqrt(_sum(F.transform(vector, lambda a: a.cast("double") * a.cast("double"))))


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity; zero where either vector has no length."""
    length = norm(left) * norm(right)
    return F.when(length == 0.0, 0.0).otherwise(dot(left, right) / length)
