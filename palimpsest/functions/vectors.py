"""Vector similarity as column expressions over array<float>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector, null for vectors of different sizes or null ones."""
    n = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(n == 0, 0.0).otherwise(dot(a, b) / n))


def l2(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), F.sqrt(_sum(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)))))


def scaled(score: Column, mode: str) -> Column:
    """raw; unit: (s + 1) / 2 clamped to 0..1; clamp: s clamped to 0..1."""
    if mode == "raw":
        return score
    s = (score + 1) / 2 if mode == "unit" else score
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


#: Higher is closer for each.
METRICS = {"cosine": cosine, "dot": dot, "euclidean": lambda a, b: 0.0 - l2(a, b)}
