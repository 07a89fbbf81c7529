"""Sources: delimited files under a contract of required and optional columns, and Parquet tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@dataclass(frozen=True)
class Contract:
    """Columns of a delimited source; all are read as strings."""

    required: tuple[str, ...]
    optional: tuple[str, ...] = ()


MOVIES = Contract(("MovieID", "OriginalTitle", "EnglishTitle"), ("Budget", "Revenue", "Homepage", "Runtime", "ReleaseDate", "Genres", "ProductionCountries", "SpokenLanguages"))
PERSONS = Contract(("CastID", "Name", "MovieID"), ("Gender", "Character"))
RATINGS = Contract(("UserID", "MovieID", "Rating"), ("Date",))
IMDB = Contract(("Series_Title",), ("Released_Year", "Runtime", "Poster_Link", "Gross", "No_of_Votes", "Certificate", "Overview", "Director", "Star1", "Star2", "Star3", "Star4", "Genre", "IMDB_Rating"))


class ContractError(ValueError):
    """A required column is missing."""


def delimited(spark: SparkSession, path: str, contract: Contract) -> DataFrame:
    """The file's columns as strings, null for missing optional ones, with `_pos` in the order of rows.

    Fields may hold line breaks and doubled quotes. An empty field is null.
    """
    header = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path, inferSchema=False).columns
    if missing := [c for c in contract.required if c not in header]:
        raise ContractError(f"{path}: no column {', '.join(missing)}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.select(*contract.required, *(F.col(c) if c in header else F.lit(None).cast("string").alias(c) for c in contract.optional), F.monotonically_increasing_id().alias("_pos"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> None:
    """Every table as a temporary view."""
    for n in names:
        table(spark, folder, n).createOrReplaceTempView(n)


def catalog(spark: SparkSession) -> DataFrame:
    """Names of the tables and views at hand."""
    return spark.createDataFrame([(t.name,) for t in spark.catalog.listTables()], "name string")


def query(spark: SparkSession, sql: str, tables: dict[str, DataFrame] | None = None, **parameters) -> DataFrame:
    """SQL with named parameters (:name), over views and over DataFrames by name ({name})."""
    return spark.sql(sql, args=parameters or None, **(tables or {}))


def sample(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def as_folder(spark: SparkSession, path: str) -> tuple[str, str]:
    """(folder, pattern of names) for a source that only takes folders: the path itself if it is one, else the file's folder and name."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return path, "*"
    return p.getParent().toString(), p.getName()
