"""The content recommender on the movies of FIXTURES.md, collaborative pieces, checks and streams."""

import pytest
from pyspark.sql import functions as F

from lodeweave.functions import numbers, text
from lodeweave.operators import collaborative, content, keys, quality
from lodeweave.operators import ratings as rate
from lodeweave.streaming import events


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, f"M{i}", None if i % 2 else i, 0) for i in range(1, 131)], "item_id long, title string, votes int, revenue int")


@pytest.fixture(scope="module")
def tags(spark):
    return spark.createDataFrame([(5, "Drama"), (3, "Comedy"), (120, "Comedy"), (10, "Comedy"), (11, "Drama"), (12, "Drama"), (12, "Comedy"), (12, "Comedy")], "item_id long, tag string")


def titles(df):
    return [r["title"] for r in df.orderBy("position").collect()]


def test_preferences_are_aligned(spark, items, tags):
    r = spark.createDataFrame([(1, 5, 100), (1, 3, 10)], "user_id long, item_id long, units long")
    assert {x.tag: x.hundredths for x in content.preferences(r, tags).collect()} == {"Drama": 91, "Comedy": 9}
    assert titles(content.recommend(items, r, tags, 1)) == ["M12", "M11", "M10", "M1", "M2"]
    both = content.top(content.scored(content.candidates(items, r), content.preferences(r, tags), tags))
    assert [x.item_id for x in both.orderBy("position").collect()] == [12, 11, 10, 1, 2]
    assert content.candidates(items, r).agg(F.max("item_id")).first()[0] == 102  # 100 lowest unrated: 120 is never one


def test_last_rating_wins(spark, items, tags):
    r = spark.createDataFrame([(1, 5, 90, 1), (1, 5, 80, 2), (1, 3, 40, 3)], "user_id long, item_id long, units long, pos int")
    last = keys.last_wins(r, ["user_id", "item_id"], ["pos"])
    assert {x.tag: x.hundredths for x in content.preferences(last, tags).collect()} == {"Drama": 67, "Comedy": 33}


def test_no_and_zero_ratings(spark, items, tags):
    none = spark.createDataFrame([], "user_id long, item_id long, units long")
    assert titles(content.recommend(items, none, tags, 1)) == ["M130", "M128", "M126", "M124", "M122"]
    zero = spark.createDataFrame([(1, 5, 0), (1, 3, 0)], none.schema)
    assert {x.hundredths for x in content.preferences(zero, tags).collect()} == {0}


def test_mean_of_duplicates(spark):
    r = spark.createDataFrame([(1, 5, 8.0), (1, 5, 9.0), (2, 6, 1.0), (2, 77, 1.0)], "user_id long, item_id long, score double")
    m = rate.feedback(r, spark.createDataFrame([(5,), (6,)], "item_id long"))
    assert sorted(tuple(x) for x in rate.wide(m, [5, 6]).collect()) == [(1, 8.5, 0.0), (2, 0.0, 1.0)]


def test_baseline_and_similarity(spark):
    r = spark.createDataFrame([(1, 1, 10.0), (1, 2, 6.0), (2, 1, 8.0)], "user_id long, item_id long, score double")
    got = {(x.user_id, x.item_id): x.estimate for x in collaborative.baseline(spark.createDataFrame([(2, 2), (9, 9), (1, 1)], "user_id long, item_id long"), r).collect()}
    assert got[2, 2] == 6.0 and got[9, 9] == 8.0 and got[1, 1] == 9.0
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0])], "id long, v array<double>")
    s = {(x.a, x.b): x.similarity for x in collaborative.similar(v).collect()}
    assert s[1, 2] == pytest.approx(2**-0.5) and s[1, 3] is None


@pytest.mark.parametrize("raw,ok", [("4.5", True), (" 4 ", True), ("3.", True), (".5", True), ("", False), ("abc", False), ("1e1", False), ("-1", False), (".", False), ("1.2.3", False), (None, False)])
def test_numeric(spark, raw, ok):
    assert spark.createDataFrame([(raw,)], "x string").select(text.numeric(F.col("x"))).first()[0] is ok


def test_rounding_of_quotients(spark):
    df = spark.createDataFrame([(1, 8), (3, 8), (29, 200), (1, 3)], "a long, b long")
    assert [tuple(r) for r in df.select(numbers.half_even(F.col("a"), F.col("b"), 100), numbers.half_up(F.col("a"), F.col("b"), 100)).collect()] == [(12, 13), (38, 38), (14, 15), (33, 33)]


def test_checks(spark):
    df = spark.createDataFrame([("1", ""), ("x", "a"), (None, "b")], "id string, v string")
    assert [tuple(r) for r in quality.completeness(df, {"v": 0.6, "id": 0.7}).collect()] == [("v", 3, 2, True), ("id", 3, 2, False)]
    assert quality.not_integers(df, ["id"]).count() == 1
    assert quality.bounded(5, 3) == (5, 3)
    for bad in ((0, 3), (5, 0), (5, 51)):
        with pytest.raises(ValueError):
            quality.bounded(*bad)
    assert keys.duplicates(df.union(df), ["id", "v"]).count() == 3


def test_events_batch_and_stream(spark, tmp_path):
    rows = [(1, "view"), (2, "signup"), (None, "click"), (3, "like")]
    spark.createDataFrame(rows, "user_id long, event_type string").coalesce(1).write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    assert events.valid(df).count() == 2
    assert {r.problem for r in events.invalid(df).collect()} == {"unknown type", "missing: user_id"}
    for _ in range(2):  # the second run finds nothing new
        s = events.read(spark, str(tmp_path / "in"), schema="user_id long, event_type string")
        events.write(events.valid(s), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    r = spark.createDataFrame([(1, 2, 0.4), (1, 2, 5.0), (1, None, 3.0)], "user_id long, movie_id long, rating double")
    assert events.valid(r, "rating").count() == 1


def test_windows_and_sessions(spark):
    df = spark.sql("select 1L as user_id, 'view' as event_type, timestamp'2025-01-01 00:10:00' as ts union all select 1L, 'view', timestamp'2025-01-01 00:20:00' union all select 1L, 'view', timestamp'2025-01-01 03:00:00'")
    assert sorted(r.n for r in events.windowed(df).collect()) == [1, 2]
    assert sorted(r.n for r in events.sessions(df).collect()) == [1, 2]
