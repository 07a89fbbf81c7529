"""Sessions, and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

PROFILES = {
    "development": {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"},
    "production": {"spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true"},
}


def session(name: str = "lodeweave", profile: str = "production", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; profiles are the environments' overrides."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in (PROFILES[profile] | {k.replace("_", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared(spark: SparkSession) -> str:
    """The checkpoint folder: that of spark.checkpoint.dir; a temporary one only in local mode where that is unset."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="lodeweave-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder: lineage ends here and survives lost executors."""
    shared(df.sparkSession)
    return df.checkpoint()


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes when the application ends."""
    path = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


#: Bytes of input, as files, for each partition that `spread` and `ordered` make.
PIECE = 8 << 20


def _pieces(*dfs: DataFrame) -> int:
    """How many pieces of PIECE bytes the files have that they are read from, once for each time that they are; 0 if that is unknown or no more than there are cores."""
    leaves = [x for df in dfs for s in [df._jdf.queryExecution().analyzed().collectLeaves()] for x in map(s.apply, range(s.size()))]
    n = -(-sum(x for x in (int(leaf.stats().sizeInBytes()) for leaf in leaves) if x < 1 << 50) // PIECE)
    return n if n > dfs[0].sparkSession.sparkContext.defaultParallelism else 0


def spread(df: DataFrame, *by: str, of: tuple[DataFrame, ...] = ()) -> DataFrame:
    """df partitioned by columns, in as many parts as its input (or that of both sides `of` a join) has pieces. Adaptive
    execution merges parts up to a size as compressed, which can be ten times as much in a sort or hash table; it leaves these as
    they are, so a task's memory doesn't grow with the input. Small inputs stay as they are."""
    n = _pieces(*of or (df,))
    return df.repartition(n, *by) if n else df


def merged(df: DataFrame, of: DataFrame) -> DataFrame:
    """df, to be sorted and merged in a join with `of` if that is large: a compressed file of a few MB can be a broadcast of a GB."""
    return df.hint("merge") if _pieces(of) else df


def ordered(df: DataFrame, *order: Column | str) -> DataFrame:
    """df in a global order, sorted in as many ranges as its input has pieces: see `spread`."""
    n = _pieces(df)
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order) if n else df.orderBy(*order)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows as a Parquet table in the shared folder: like `cut`, compressed, by columns, for what is read several times."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
