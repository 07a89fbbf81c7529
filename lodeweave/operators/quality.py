"""Declared checks of a table: completeness, duplicates, ranges, formats."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def completeness(df: DataFrame, thresholds: Mapping[str, float]) -> DataFrame:
    """column_name, n_rows, n_filled, complete: whether the share of values that are there reaches the column's threshold. One pass."""
    counts = df.agg(F.count("*").alias("_n"), *(F.count(F.nullif(F.col(c).cast("string"), F.lit(""))).alias(c) for c in thresholds))
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col("_n").alias("n_rows"), F.col(c).alias("n_filled"), (F.col(c) >= F.col("_n") * t).alias("complete")) for c, t in thresholds.items()))
    return counts.select(F.inline(rows))


def violations(df: DataFrame, ranges: Mapping[str, tuple[object, object]]) -> DataFrame:
    """column_name, n_below, n_above: values out of range; nulls aren't. One pass."""
    sums = df.agg(*(x for c, (lo, hi) in ranges.items() for x in (F.count_if(F.col(c) < F.lit(lo)).alias(f"{c}_lo"), F.count_if(F.col(c) > F.lit(hi)).alias(f"{c}_hi"))))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"{c}_lo").alias("n_below"), F.col(f"{c}_hi").alias("n_above")) for c in ranges))))


def not_integers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which one of the columns has text that is no integer."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | (F.col(c).isNotNull() & F.col(c).cast("string").try_cast("bigint").isNull())
    return df.filter(bad)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table_name, n."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def bounded(user_id: int, top_n: int = 3, users: tuple[int, int] = (1, 999_999), tops: tuple[int, int] = (1, 50)) -> tuple[int, int]:
    """The arguments of a request, checked."""
    if not users[0] <= user_id <= users[1]:
        raise ValueError(f"user id {user_id} is outside {users}")
    if not tops[0] <= top_n <= tops[1]:
        raise ValueError(f"top n {top_n} is outside {tops}")
    return user_id, top_n
