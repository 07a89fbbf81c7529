"""Ratings: validation and rescaling, the feedback matrix in long and wide form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

LOW, HIGH = 1.0, 10.0


def rescaled(raw: Column) -> Column:
    """0.5 to 5 as 1 to 10."""
    return raw.try_cast("double") * 2


def verdict(raw: Column, low: float = LOW, high: float = HIGH) -> Column:
    """Null for an acceptable rating text, else why it is rejected."""
    return F.when(~text.numeric(raw), "invalid").when(~rescaled(raw).between(low, high), "out of range")


def cleaned(df: DataFrame, raw: str = "raw", low: float = LOW, high: float = HIGH) -> DataFrame:
    """Accepted rows, with `score`."""
    return df.filter(verdict(F.col(raw), low, high).isNull()).withColumn("score", rescaled(F.col(raw)))


def rejected(df: DataFrame, raw: str = "raw", low: float = LOW, high: float = HIGH) -> DataFrame:
    """Rejected rows, with `reason`."""
    return df.withColumn("reason", verdict(F.col(raw), low, high)).filter("reason is not null")


def feedback(ratings: DataFrame, items: DataFrame) -> DataFrame:
    """user_id, item_id, score: the mean of a user's scores of an item; items that aren't in the catalogue drop out."""
    return ratings.join(items.select("item_id"), "item_id").groupBy("user_id", "item_id").agg(F.avg("score").alias("score"))


def wide(matrix: DataFrame, items: list[int]) -> DataFrame:
    """A row for each user, a column for each of the items named; 0 where a user didn't rate. For results; computations stay long."""
    named = matrix.groupBy("user_id").pivot("item_id", items).agg(F.first("score"))
    return named.select("user_id", *(F.coalesce(F.col(f"`{i}`"), F.lit(0.0)).alias(f"item_{i}") for i in items))


def long(df: DataFrame, key: str, columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    """Columns as rows; nulls stay."""
    return df.unpivot([key], columns, name, value)


def scale(ratings: DataFrame) -> DataFrame:
    return ratings.agg(F.min("score").alias("low"), F.max("score").alias("high"))
