"""Steps whose cost must not grow faster than their input: results at the edges, and plans."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeweave import plans, session
from lodeweave.operators import collaborative, content
from lodeweave.plans import standins

from tests.conftest import SMALL, same


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_best_is_top_of_scored_candidates(spark):
    rng = random.Random(3)
    items = spark.createDataFrame([(i * 3, f"M{i}") for i in range(1, 60)], "item_id long, title string")
    tags = spark.createDataFrame([(i * 3, t) for i in range(1, 70) for t in rng.choices(["a", "b", "c", "d", None, 'é"'], k=rng.randrange(4))], "item_id long, tag string")
    pairs = {(u, rng.choice(range(1, 75)) * 3) for u in [*range(1, 9), None] for _ in range(2 * (u or 1) ** 2)} | {(20, i * 3) for i in range(1, 58)} | {(21, 999)}
    ratings = spark.createDataFrame([(u, i, rng.choice([0, 20, 90]) if u != 8 else 0) for u, i in sorted(pairs, key=repr)], "user_id long, item_id long, units long")
    for n, reach in ((5, 100), (3, 7), (9, 1)):
        slow = content.top(content.scored(content.candidates(items, ratings, reach), content.preferences(ratings, tags), tags), n)
        fast = content.best(items, ratings, tags, n, reach)
        assert sorted(map(repr, fast.collect())) == sorted(map(repr, slow.select(*fast.columns).collect()))
        assert fast.filter("user_id is null").count() == min(n, reach) and fast.filter("user_id = 20").count() == min(n, reach, 2)
    assert content.best(items.limit(0), ratings, tags).count() == 0 and content.best(items, ratings.limit(0), tags).count() == 0


def test_candidates_of_all_users_stay_where_their_user_is(spark):
    assert "Exchange" not in plan(plans.QUERIES["content_all_users"](spark, SMALL))


def test_best_of_all_items_are_the_best_estimates(spark):
    """To the last bit, with users and items that the model doesn't know, and without a join of pairs."""
    ratings = standins.last_ratings(spark, SMALL).select("user_id", "item_id", (F.col("units") / 10).alias("score"))
    model = collaborative.fit(ratings, collaborative.Settings(factors=6, rounds=2))
    users = spark.createDataFrame([(u,) for u in (3, 7, 10**6)], "user_id long")
    items = ratings.select("item_id").distinct().union(spark.createDataFrame([(10**6,)], "item_id long"))
    w = Window.partitionBy("user_id").orderBy(F.desc("estimate"), "item_id")
    slow = model.estimates(users.crossJoin(items)).withColumn("position", F.row_number().over(w)).filter("position <= 40")
    fast = model.top(users, items, 40)
    assert fast.dtypes == slow.select(*fast.columns).dtypes and fast.count() == 120 and sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.select(*fast.columns).collect()))
    assert "UDF" in plan(slow) and "UDF" not in plan(fast)  # that of ALSModel.transform, for which pairs are sent to their users


@pytest.fixture
def large(monkeypatch):
    """The small tables are treated as large ones, which are cut into many pieces."""
    monkeypatch.setattr(session, "PIECE", 6_000)


@pytest.mark.parametrize("name", ["q8_coappearance", "top_pair_by_year", "user_preference", "last_wins_dedup"])
def test_pieces_of_large_tables_give_the_same_rows(name, spark, oracle, large):
    df = plans.QUERIES[name](spark, SMALL)
    same(df, oracle, plans.SQL[name])
    assert "REPARTITION_BY_NUM" in plan(df)


def test_pairs_of_large_tables_are_counted_once_and_in_order(spark, large):
    df = plans.QUERIES["q8_coappearance"](spark, SMALL)
    rows = [(r["year"], -r["n"], r["first"], r["second"]) for r in df.collect()]
    assert rows == sorted(rows) and df.rdd.getNumPartitions() > 8
    assert not re.search(r"REPARTITION_BY_COL|ENSURE_REQUIREMENTS.*\n[^\n]*partial_count", plan(df))


def test_top_pairs_need_no_order_of_all_pairs(spark):
    assert "rangepartitioning" not in plan(plans.QUERIES["top_pair_by_year"](spark, SMALL))


def test_preferences_count_a_null_tag_in_the_total(spark):
    tags = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, "b")], "item_id long, tag string")
    ratings = spark.createDataFrame([(7, 1, 30), (7, 2, 60), (8, 3, 50)], "user_id long, item_id long, units long")
    assert {(r.user_id, r.tag, r.hundredths) for r in content.preferences(ratings, tags).collect()} == {(7, "a", 25), (7, None, 25), (7, "b", 50)}


def test_content_of_large_tables(spark, oracle, large):
    same(plans.QUERIES["content_all_users"](spark, SMALL), oracle, plans.SQL["content_all_users"])
