"""First-wins and last-wins dedup, constraints, and consecutive numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key. `order` should be total, else any of the tied rows may win."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return first_wins(df, keys, [F.col(c).desc_nulls_last() for c in order])


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, and how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def within(c: Column, low, high) -> Column:
    """A CHECK constraint: null passes."""
    return c.isNull() | c.between(low, high)


def split(df: DataFrame, accepted: Column) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows; a null verdict rejects."""
    ok = F.coalesce(accepted, F.lit(False))
    return df.filter(ok), df.filter(~ok)


def numbered(df: DataFrame, name: str, order: Sequence[Column | str], start: int = 1) -> DataFrame:
    """Consecutive numbers in a global order, by one window. For dimensions: all rows meet in one task."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)) + (start - 1))


def sequenced(df: DataFrame, name: str, order: Sequence[str], start: int = 0) -> DataFrame:
    """Consecutive numbers in a global order for tables of any size: rows are sorted by ranges, written once,
    numbered within their range, and shifted by the sizes of the ranges before. `order` must be total."""
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # one row a partition
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).drop("_n")
    w = Window.partitionBy("_range").orderBy(*order)
    return ranged.withColumn("_within", F.row_number().over(w)).join(F.broadcast(before), "_range").withColumn(name, F.col("_within") + F.col("_before") + (start - 1)).drop("_within", "_before", "_range")


def next_id(df: DataFrame, c: str) -> DataFrame:
    """One row: the largest value of c, 0 for an empty table, plus one."""
    return df.agg((F.coalesce(F.max(c), F.lit(0)) + 1).alias("next_id"))
