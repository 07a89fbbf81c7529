"""Sinks: recreate, append, upsert, text log, exports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared


def recreate(df: DataFrame, path: str) -> None:
    """Drop and create: the path holds exactly df."""
    df.write.mode("overwrite").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def merged(existing: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: rows of changes replace existing rows of equal keys, all others stay. Columns that changes lack become null."""
    return existing.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes, allowMissingColumns=True)


def upsert(changes: DataFrame, path: str, keys: list[str]) -> None:
    """merged() into a Parquet path: staged in the shared folder first, since a path can't be read and overwritten at once."""
    spark = changes.sparkSession
    staged = f"{shared(spark)}/upsert-{uuid.uuid4().hex}"
    merged(spark.read.parquet(path), changes, keys).write.parquet(staged)
    spark.read.parquet(staged).write.mode("overwrite").parquet(path)


def result_lines(recommendations: DataFrame, top_n: int, stamp: Column | None = None, separator: str = ", ") -> DataFrame:
    """One line of text a user from (user_id, position, title): when, who, how many were asked for, titles in order."""
    titles = F.transform(F.sort_array(F.collect_list(F.struct("position", "title"))), lambda x: x["title"])
    when = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss") if stamp is None else stamp
    per = recommendations.groupBy("user_id").agg(titles.alias("titles"))
    return per.select(F.concat(F.lit("["), when, F.lit("] User ID: "), F.col("user_id").cast("string"), F.lit(f", Top N: {top_n}, Recommendations: "), F.array_join("titles", separator)).alias("value"))


def log(lines: DataFrame, path: str) -> None:
    lines.write.mode("append").text(path)


def export(df: DataFrame, path: str, format: str = "json") -> None:
    """json or csv (with a header)."""
    (df.write.mode("overwrite").option("header", True) if format == "csv" else df.write.mode("overwrite")).format(format).save(path)
