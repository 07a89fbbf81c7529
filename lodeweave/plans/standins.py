"""The star schema in the roles of a catalogue: parts are items, customers users, order lines ratings and roles.

A rating's raw value is l_quantity / 10 (0.1 to 5). Rescaled by 2 it is a multiple of 0.2, kept as an
integer number of tenths (`units`), so that sums are exact. Each relation has a SQL twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import keys
from ..session import spread
from ..sources.files import table

RATINGS_SQL = "SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(l_quantity * 2 AS BIGINT) AS units, o_orderdate AS rated FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE CAST(l_quantity * 2 AS BIGINT) BETWEEN 10 AND 100"
#: One rating for each user and item: the last by date, of several on one day the highest.
LAST_SQL = f"SELECT user_id, item_id, units FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY rated DESC, units DESC) AS nth FROM ({RATINGS_SQL})) WHERE nth = 1"
TAGS_SQL = "SELECT p_partkey AS item_id, unnest(string_split(p_name, ' ')) AS tag FROM part WHERE p_name <> ''"


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.col("p_type").alias("genre"), F.col("p_size").alias("votes"), F.col("p_retailprice").alias("revenue"))


def tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter("p_name <> ''").select(F.col("p_partkey").alias("item_id"), F.explode(F.split("p_name", " ")).alias("tag"))


def all_ratings(spark: SparkSession, d: str) -> DataFrame:
    """Every rating, those out of range included."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    lines, orders = spread(lines, "l_orderkey", of=(lines, orders)), spread(orders, "o_orderkey", of=(lines, orders))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), (F.col("l_quantity") * 2).cast("long").alias("units"), F.col("o_orderdate").alias("rated"), "l_quantity")


def ratings(spark: SparkSession, d: str) -> DataFrame:
    return all_ratings(spark, d).filter("units between 10 and 100").drop("l_quantity")


def last_ratings(spark: SparkSession, d: str) -> DataFrame:
    return keys.last_wins(spread(ratings(spark, d), "item_id"), ["item_id", "user_id"], ["rated", "units"]).drop("rated")
