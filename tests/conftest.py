import duckdb
import pytest
from pyspark.sql import SparkSession

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def oracle():
    """DuckDB with the tables of the small folder as views."""
    from lodeweave.sources.files import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else list(map(plain, v)) if isinstance(v, list) else v


def same(df, con, sql):
    """Whether a DataFrame has the columns and rows of a SQL result, in any order."""
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    theirs = sorted(([plain(v) for v in r] for r in cur.fetchall()), key=repr)
    ours = sorted(([plain(v) for v in r] for r in df.select(*names).collect()), key=repr)
    assert ours == theirs
