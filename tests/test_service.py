"""The command line, schemas, recommendation to titles, and plans that must reach the scan."""

import logging

import pytest
from pyspark.sql import functions as F

from lodeweave import __main__ as cli
from lodeweave import plans
from lodeweave.functions import text
from lodeweave.operators import collaborative, quality
from lodeweave.plans import standins
from lodeweave.session import PROFILES, session
from lodeweave.sources import files, schemas

from tests.conftest import MEDIUM, SMALL


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    schemas.create(spark, folder)
    r = standins.last_ratings(spark, SMALL)
    schemas.store({"movie": standins.items(spark, SMALL).select(F.col("item_id").alias("id"), F.col("title").alias("eng_title"), "votes", "revenue"), "user_rating": r.select(F.col("item_id").alias("movie_id"), F.col("user_id").alias("userID"), (F.col("units") / 10).alias("score"))}, folder)
    return folder


def test_tables_have_their_schemas(spark, tables):
    for name, schema in schemas.SCHEMAS.items():
        df = files.table(spark, tables, name)
        assert df.schema == schema and (df.count() > 0) == (name in ("movie", "user_rating"))
    odd = schemas.conformed(spark.createDataFrame([("1", "x", "12.5")], "id string, runtime string, revenue string"), "movie").first()
    assert odd["id"] == 1 and odd["runtime"] is None and float(odd["revenue"]) == 12.5 and odd["eng_title"] is None


def test_command_line_prints_and_logs(spark, tables, tmp_path, capsys):
    log, messages = str(tmp_path / "log"), str(tmp_path / "messages.txt")
    for user in ("1", "999999"):
        cli.main([user, "--tables", tables, "--top_n", "2", "--log", log, "--messages", messages, "--profile"])
    out = capsys.readouterr().out
    assert out.count("Recommended for user") == 2 and "Physical Plan" in out
    lines = sorted(r[0] for r in spark.read.text(log).collect())
    assert len(lines) == 2 and all(", Top N: 2, Recommendations: " in x for x in lines)
    assert "user 1: 2 titles" in open(messages).read()
    popular = [r["title"] for r in standins.items(spark, SMALL).orderBy(F.desc("votes"), F.desc("revenue"), "item_id").limit(2).collect()]
    assert f"Recommended for user 999999: {', '.join(popular)}" in out
    with pytest.raises(ValueError):
        cli.main(["0", "--tables", tables])
    logging.getLogger("lodeweave").handlers.clear()


def test_recommendations_are_the_best_estimates(spark):
    ratings = standins.last_ratings(spark, SMALL).select("user_id", "item_id", (F.col("units") / 10).alias("score"))
    items = standins.items(spark, SMALL)
    s = collaborative.Settings(factors=5, rounds=3, most=4)
    user = ratings.agg(F.min("user_id")).first()[0]
    got = [tuple(r) for r in collaborative.recommend(ratings, items, user, 50, s).collect()]
    best = collaborative.fit(ratings, s).top(spark.createDataFrame([(user,)], "user_id long"), items, 4).join(items, "item_id").orderBy("position").collect()
    assert got == [(user, r["position"], r["title"]) for r in best] and len(got) == 4
    high = collaborative.Settings(factors=5, rounds=3, most=4, min_rating=99.0)
    assert collaborative.recommend(ratings, items, user, 4, high).count() == 0


def test_held_out_error_is_no_worse_than_the_mean(spark):
    ratings = standins.last_ratings(spark, MEDIUM).select("user_id", "item_id", (F.col("units") / 10).alias("score"))
    model = collaborative.fit(ratings, collaborative.Settings(factors=5, rounds=5, regularization=0.5))
    test = ratings.filter(collaborative.held_out(ratings))
    mean = model.ratings.agg(F.avg("score")).first()[0]
    flat = test.agg(F.sqrt(F.avg((F.col("score") - mean) ** 2))).first()[0]
    got = model.error(test).first()
    assert got["n"] == test.count() and got["rmse"] <= 1.15 * flat


def test_years_are_a_range_for_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    for name in ("q6_count_year_semi_scalar", "q8_coappearance"):
        plan = plans.QUERIES[name](spark, SMALL)._jdf.queryExecution().toString()
        assert "GreaterThanOrEqual(o_orderdate,1996-01-01" in plan and "LessThan(o_orderdate,2000-01-01" in plan
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_pairs_come_by_year_and_number(spark):
    rows = [(r["year"], -r["n"], r["first"], r["second"]) for r in plans.QUERIES["q8_coappearance"](spark, SMALL).collect()]
    assert rows == sorted(rows) and len(rows) > 100


def test_session_profiles(spark):
    s = session(profile="development", **{"spark_sql_shuffle_partitions": "4"})
    assert s is spark and s.conf.get("spark.sql.adaptive.enabled") == "true" and set(PROFILES) == {"development", "production"}
    assert spark.createDataFrame([("  A  b ",), (" ",)], "s string").select(text.normalized(F.col("s"))).collect() == [("a b",), (None,)]
    assert quality.not_integers(spark.createDataFrame([("1",), ("x",), (None,)], "s string"), ["s"]).count() == 1
    assert files.sample(spark.range(9)).count() == 5
