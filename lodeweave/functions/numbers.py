"""Arithmetic that is exact in any engine and any order of rows: rounding of quotients of integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(a: Column, b: Column, scale: int = 1) -> Column:
    """a * scale / b rounded half up to an integer, for a >= 0 and b > 0."""
    return F.call_function("div", a * (2 * scale) + b, b * 2)


def half_even(a: Column, b: Column, scale: int = 1) -> Column:
    """a * scale / b rounded half to even, for a >= 0 and b > 0."""
    n = a * scale
    q, r = F.call_function("div", n, b), n % b
    return q + F.when((r * 2 > b) | ((r * 2 == b) & (q % 2 == 1)), 1).otherwise(0)


def band(c: Column, low: float = 1_000_000, high: float = 10_000_000) -> Column:
    """'low', 'medium' or 'high'; what has no value counts as high."""
    return F.when(c < low, "low").when(c < high, "medium").otherwise("high")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; null where either is all zeros."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
