"""The tables of the normalized model, with the types that they have here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sinks import recreate

_COLUMNS = {
    "movie": "id long, orig_title string, eng_title string, releasedate date, release_year int, runtime int, homepage string, bugt_amt decimal(15,2), bugt_type string, revenue decimal(15,2), votes long, cert string, img_url string, overview string",
    "country": "code string, name string", "produces": "id long, movie_id long, country_code string", "genre": "id long, name string", "categories": "id long, movie_id long, genre_id long", "language": "code string, endonym string",
    "speaks": "id long, movie_id long, lan_code string", "actor": "id string, name string, gender int, res_country string", "role": "id long, character string, actor_id string, movie_id long",
    "user_rating": "id long, movie_id long, userID long, date string, score double", "director": "id long, first_name string, last_name string, movie_id long",
}
_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "date": T.DateType(), "decimal(15,2)": T.DecimalType(15, 2)}
SCHEMAS: dict[str, T.StructType] = {name: T.StructType([T.StructField(*x.split()[:1], _TYPES[x.split()[1]]) for x in c.split(", ")]) for name, c in _COLUMNS.items()}


def conformed(df: DataFrame, name: str) -> DataFrame:
    """df with the columns and types of a table; columns that it lacks are null, text that doesn't fit is too."""
    return df.select(*((F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in SCHEMAS[name]))


def create(spark: SparkSession, folder: str) -> None:
    """All tables, empty, in place of what was there."""
    for name, schema in SCHEMAS.items():
        recreate(spark.createDataFrame([], schema), f"{folder}/{name}.parquet")


def store(tables: dict[str, DataFrame], folder: str) -> None:
    """The tables of a model as Parquet under their schemas."""
    for name in SCHEMAS.keys() & tables.keys():
        recreate(conformed(tables[name], name), f"{folder}/{name}.parquet")
