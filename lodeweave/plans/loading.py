"""Delimited files through the loaders: tables in the roles of the four sources, written as text to the shared folder and read back."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import etl, quality
from ..session import folder
from ..sources import files
from ..sources.files import table
from .registry import query
from .standins import TAGS_SQL


def _read(spark: SparkSession, df: DataFrame, contract: files.Contract) -> DataFrame:
    path = folder(spark, "delimited")
    df.write.option("header", True).option("escape", '"').csv(path)
    return files.delimited(spark, path, contract)


@query("""SELECT l_partkey AS movie_id, o_custkey AS user_id, CAST(l_quantity AS BIGINT) / 10.0 * 2 AS score, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE CAST(l_quantity * 2 AS BIGINT) BETWEEN 10 AND 100 GROUP BY 1, 2, 3""")
def load_ratings(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    text = lines.select(F.col("o_custkey").cast("string").alias("UserID"), F.col("l_partkey").cast("string").alias("MovieID"), (F.col("l_quantity") / 10).cast("string").alias("Rating"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"))
    got = etl.ratings(_read(spark, text, files.RATINGS)).tables["user_rating"]
    return got.groupBy(F.col("movie_id").cast("long").alias("movie_id"), F.col("userID").cast("long").alias("user_id"), F.col("score").cast("double").alias("score")).agg(F.count("*").alias("n"))


@query(f"SELECT item_id AS movie_id, tag AS genre, count(*) AS n FROM ({TAGS_SQL}) GROUP BY 1, 2")
def load_movie_genres(spark: SparkSession, d: str) -> DataFrame:
    """Genres resolved by name: links by id to a table of distinct names."""
    text = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("MovieID"), F.col("p_name").alias("OriginalTitle"), F.col("p_name").alias("EnglishTitle"), F.replace("p_name", F.lit(" "), F.lit("|")).alias("Genres"))
    t = etl.movies(_read(spark, text, files.MOVIES)).tables
    named = t["categories"].join(t["genre"].select(F.col("id").alias("genre_id"), F.col("name").alias("genre")), "genre_id")
    return named.groupBy(F.col("movie_id").cast("long").alias("movie_id"), "genre").agg(F.count("*").alias("n"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, s_nationkey % 5 AS gender FROM supplier WHERE s_nationkey % 5 BETWEEN 1 AND 3 AND s_suppkey IN (SELECT l_suppkey FROM lineitem)")
def load_persons(spark: SparkSession, d: str) -> DataFrame:
    """Credits to people: the first row of each counts, those out of the range of genders are rejected."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    text = lines.select(F.col("s_suppkey").cast("string").alias("CastID"), F.col("s_name").alias("Name"), (F.col("s_nationkey") % 5).cast("string").alias("Gender"), F.concat(F.lit("Part "), F.col("l_linenumber").cast("string")).alias("Character"), F.col("l_orderkey").cast("string").alias("MovieID"))
    return etl.persons(_read(spark, text, files.PERSONS)).tables["actor"].select("id", "name", F.col("gender").cast("int").alias("gender"))


@query("SELECT p_name AS title, p_size::INTEGER AS runtime, CAST(floor(p_retailprice * 1000) AS BIGINT)::DOUBLE AS revenue, 1994 AS release_year, count(*) AS n FROM part GROUP BY 1, 2, 3")
def load_second_source(spark: SparkSession, d: str) -> DataFrame:
    """Runtimes with a unit, amounts with commas, other column names."""
    text = table(spark, d, "part").select(
        F.col("p_name").alias("Series_Title"), F.lit("1994").alias("Released_Year"), F.concat(F.col("p_size").cast("string"), F.lit(" min")).alias("Runtime"), F.format_number(F.floor(F.col("p_retailprice") * 1000), 0).alias("Gross"),
        F.col("p_size").cast("string").alias("No_of_Votes"), F.col("p_brand").alias("Director"), F.col("p_type").alias("Star1"),
    )
    got = etl.imdb(_read(spark, text, files.IMDB), spark.createDataFrame([], "id long")).tables["movie"]
    return got.groupBy(F.col("eng_title").alias("title"), "runtime", F.col("revenue").cast("double").alias("revenue"), "release_year").agg(F.count("*").alias("n"))


@query("SELECT 'o_orderdate' AS column_name, count(*) FILTER (o_orderdate < DATE '1996-01-01') AS n_below, count(*) FILTER (o_orderdate > DATE '1999-12-31') AS n_above FROM orders")
def dq_date_range(spark: SparkSession, d: str) -> DataFrame:
    return quality.violations(table(spark, d, "orders"), {"o_orderdate": (date(1996, 1, 1), date(1999, 12, 31))})
