"""Every query against its SQL."""

import pytest

from lodeweave import plans

from tests.conftest import SMALL, same


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(name, spark, oracle):
    same(plans.QUERIES[name](spark, SMALL), oracle, plans.SQL[name])


def test_als_recommends_three_each_and_repeats_itself(spark):
    a = plans.QUERIES["cf_als_topn"](spark, SMALL)
    rows = [tuple(r) for r in a.collect()]
    users = {r[0] for r in rows}
    assert users and all(sorted(r[2] for r in rows if r[0] == u) == [1, 2, 3] for u in users)


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = plans.QUERIES["parameterized_filter"](spark, SMALL)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(p_type), EqualTo(p_type,STANDARD)]" in plan
    assert "p_retailprice" not in plan.split("== Physical Plan ==")[1]


def test_preferences_sum_to_one_before_rounding(spark):
    rows = plans.QUERIES["user_preference"](spark, SMALL).groupBy("user_id").agg({"hundredths": "sum", "tag": "count"}).collect()
    assert rows and all(abs(r["sum(hundredths)"] - 100) <= r["count(tag)"] / 2 for r in rows)
