"""The analytical queries, over any catalogue of the shape: items, people, roles, tags, ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import ordered, spread


def lookup(items: DataFrame, c: str, value) -> DataFrame:
    return items.filter(F.col(c) == F.lit(value))


def of_groups(items: DataFrame, links: DataFrame, groups: DataFrame, item: str, group: str) -> DataFrame:
    """Items linked to any of the groups: two semi-joins, so no item comes twice."""
    return items.join(links.join(groups.select(group), group, "left_semi").select(item), item, "left_semi")


def per_year(items: DataFrame, date: str, name: str = "n") -> DataFrame:
    """Items by year, as text; undated ones are a group of their own."""
    return items.groupBy(text.year(F.col(date)).alias("year")).agg(F.count("*").alias(name)).orderBy("year")


def most_connected(items: DataFrame, roles: DataFrame, people: DataFrame, item: str, person: str, title: str, n: int = 1) -> DataFrame:
    """Items with most roles; a person with two roles counts twice; ties by item."""
    each = roles.join(people.select(person), person).groupBy(item).agg(F.count("*").alias("n_people"))
    return each.join(items.select(item, title), item).orderBy(F.desc("n_people"), item).limit(n)


def years_between(items: DataFrame, date: str, first: str, last: str) -> DataFrame:
    """Items of the years first to last, both included, as a range of dates that the scan can prune by."""
    return items.filter((F.col(date) >= F.lit(f"{int(first):04d}-01-01")) & (F.col(date) < F.lit(f"{int(last) + 1:04d}-01-01")))


def top_people(credits: DataFrame, name: str, profit: Column, n: int = 10) -> DataFrame:
    """name, n_items, total_profit: the n people with most items and the n with most profit, each list with a null for what
    it doesn't rank by; someone in both has two rows. One aggregation serves both lists; ties by name."""
    sums = credits.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n_items"), F.sum(profit).alias("total_profit"))
    by_count = sums.orderBy(F.desc("n_items"), "name").limit(n).select("name", "n_items", F.lit(None).cast("double").alias("total_profit"))
    by_profit = sums.orderBy(F.desc_nulls_last("total_profit"), "name").limit(n).select("name", F.lit(None).cast("long").alias("n_items"), F.col("total_profit").cast("double"))
    return by_count.unionByName(by_profit).distinct()


def pairs(roles: DataFrame, people: DataFrame, item: str, person: str, name: str) -> DataFrame:
    """first, second, year, n: how often two people were in one item, by year; roles have (item, person, year)."""
    slim = roles.select(item, person, "year")
    a, b = slim.alias("a"), slim.alias("b")
    both = a.join(b, (F.col(f"a.{item}") == F.col(f"b.{item}")) & (F.col(f"a.{person}") < F.col(f"b.{person}")))
    # most pairs come once, so they are counted after they are sent, not before too: that would hold them all in the task that joins
    counts = spread(both.select(F.col(f"a.{person}").alias("p1"), F.col(f"b.{person}").alias("p2"), "a.year"), "p1").groupBy("p1", "p2", "year").agg(F.count("*").alias("n"))
    first, second = people.select(F.col(person).alias("p1"), F.col(name).alias("first")), people.select(F.col(person).alias("p2"), F.col(name).alias("second"))
    return counts.join(first, "p1").join(second, "p2").select("first", "second", "year", "n")


def coappearances(roles: DataFrame, people: DataFrame, item: str, person: str, name: str) -> DataFrame:
    """`pairs` in the order of years, most frequent pairs first, ties by name."""
    return ordered(pairs(roles, people, item, person, name), "year", F.desc("n"), "first", "second")
