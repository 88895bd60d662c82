"""Arithmetic on array columns, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(0.0)


def l2_similarity(a: Column, b: Column) -> Column:
    """1 / (1 + Euclidean distance)."""
    return 1 / (1 + F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)))


def normalized(a: Column) -> Column:
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x / length)).otherwise(a)


def with_dim(a: Column, dim: int) -> Column:
    """Cut or padded with zeros to ``dim``, then normalised."""
    return normalized(F.slice(F.concat(a, F.array_repeat(F.lit(0.0), dim)), 1, dim))
