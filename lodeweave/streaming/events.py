"""Event streams: validation of ratings and interactions, with micro-batches bounded by files and a flush interval.

Windowed counts with a watermark, and sessions, are extensions beyond validation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

INTERACTIONS = ("view", "click", "share", "like", "bookmark", "search")


def read(spark: SparkSession, folder: str, names: str = "*", *, schema: str, files: int = 1, format: str = "parquet") -> DataFrame:
    """Files of matching names that appear in a folder; `files` a trigger bounds the micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", names).format(format).load(folder)


def problem(kind: str) -> Column:
    """Null for a valid event of a kind, else what is wrong with it."""
    missing = lambda *names: F.array_join(F.filter(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in names)), lambda x: x.isNotNull()), ", ")
    if kind == "rating":
        m = missing("user_id", "movie_id", "rating")
        return F.when(m != "", F.concat(F.lit("missing: "), m)).when(~F.col("rating").between(0.5, 5.0), "out of range")
    m = missing("user_id", "event_type")
    return F.when(m != "", F.concat(F.lit("missing: "), m)).when(~F.col("event_type").isin(*INTERACTIONS), "unknown type")


def valid(df: DataFrame, kind: str = "interaction") -> DataFrame:
    """Batch or stream."""
    return df.filter(problem(kind).isNull())


def invalid(df: DataFrame, kind: str = "interaction") -> DataFrame:
    return df.withColumn("problem", problem(kind)).filter("problem is not null")


def windowed(df: DataFrame, length: str = "1 hour", late: str = "2 hours", time: str = "ts") -> DataFrame:
    return df.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(df: DataFrame, gap: str = "30 minutes", late: str = "2 hours", time: str = "ts") -> DataFrame:
    return df.withWatermark(time, late).groupBy("user_id", F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def write(df: DataFrame, path: str, checkpoint: str, flush: str | None = None) -> StreamingQuery:
    """Appends to Parquet, each event once: every `flush` (such as "30 seconds"), or what is there now."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(processingTime=flush) if flush else w.trigger(availableNow=True)).start()
