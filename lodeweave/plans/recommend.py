"""Recommenders, declared quality checks, sinks and streams over the stand-ins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import half_even
from ..operators import collaborative, content, keys, quality
from ..operators import ratings as rate
from ..session import shared, written
from ..sources import files, sinks
from ..sources.files import table
from ..streaming import events
from . import standins
from .registry import query
from .standins import LAST_SQL, RATINGS_SQL, TAGS_SQL

USER, VIP = 7, (1, 2, 3)
_EVEN = "(({a}) // ({b}) + CASE WHEN ({a}) % ({b}) * 2 > ({b}) OR (({a}) % ({b}) * 2 = ({b}) AND ({a}) // ({b}) % 2 = 1) THEN 1 ELSE 0 END)::BIGINT"
_PREFS = f"""SELECT user_id, tag, CASE WHEN t = 0 THEN 0 ELSE {_EVEN.format(a="u * 100", b="t")} END AS hundredths FROM (SELECT *, sum(u) OVER (PARTITION BY user_id) AS t FROM
(SELECT user_id, tag, sum(units) AS u FROM ({LAST_SQL}) JOIN (SELECT DISTINCT item_id, tag FROM ({TAGS_SQL})) USING (item_id) GROUP BY 1, 2))"""
_CANDIDATES = f"SELECT p_partkey AS item_id FROM part WHERE p_partkey NOT IN (SELECT item_id FROM ({LAST_SQL}) WHERE user_id = {USER}) ORDER BY 1 LIMIT 100"
_SCORES = f"SELECT item_id, coalesce(sum(hundredths), 0)::BIGINT AS hundredths FROM ({_CANDIDATES}) LEFT JOIN (SELECT DISTINCT item_id, tag FROM ({TAGS_SQL})) USING (item_id) LEFT JOIN (SELECT * FROM ({_PREFS}) WHERE user_id = {USER}) USING (tag) GROUP BY 1"


@query(f"SELECT user_id, item_id, sum(units)::BIGINT AS units, count(*) AS n FROM ({RATINGS_SQL}) JOIN part ON item_id = p_partkey GROUP BY 1, 2")
def feedback_long(spark: SparkSession, d: str) -> DataFrame:
    """The mean of duplicates as its exact parts, sum and number."""
    known = standins.items(spark, d).select("item_id")
    return standins.ratings(spark, d).join(known, "item_id").groupBy("user_id", "item_id").agg(F.sum("units").alias("units"), F.count("*").alias("n"))


@query("SELECT user_id, " + ", ".join(f"coalesce(avg(units) FILTER (item_id = {i}), 0) AS item_{i}" for i in VIP) + f" FROM ({RATINGS_SQL}) WHERE item_id IN {VIP} GROUP BY 1")
def feedback_pivot(spark: SparkSession, d: str) -> DataFrame:
    few = standins.ratings(spark, d).filter(F.col("item_id").isin(*VIP)).withColumn("score", F.col("units").cast("double"))
    return rate.wide(rate.feedback(few, standins.items(spark, d)), list(VIP))


@query(f"SELECT min(units) AS low, max(units) AS high FROM ({RATINGS_SQL})")
def rating_scale(spark: SparkSession, d: str) -> DataFrame:
    return rate.scale(standins.ratings(spark, d).withColumnRenamed("units", "score"))


@query(f"SELECT list_sort(list(DISTINCT tag)) AS tags FROM ({TAGS_SQL})")
def genre_vocab(spark: SparkSession, d: str) -> DataFrame:
    return content.vocabulary(standins.tags(spark, d))


@query(f"SELECT DISTINCT item_id, tag FROM ({TAGS_SQL})")
def genre_indicator(spark: SparkSession, d: str) -> DataFrame:
    return content.indicator(standins.tags(spark, d))


@query(_PREFS)
def user_preference(spark: SparkSession, d: str) -> DataFrame:
    """Of all users at once."""
    return content.preferences(standins.last_ratings(spark, d), standins.tags(spark, d))


def _one(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    mine = keys.last_wins(standins.ratings(spark, d).filter(F.col("user_id") == USER), ["user_id", "item_id"], ["rated", "units"]).drop("rated")
    pairs = content.unrated(standins.items(spark, d), mine, USER).orderBy("item_id").limit(100).select(F.lit(USER).cast("long").alias("user_id"), "item_id")
    return mine, pairs


@query(_SCORES)
def content_scores(spark: SparkSession, d: str) -> DataFrame:
    mine, pairs = _one(spark, d)
    tags = standins.tags(spark, d)
    return content.scored(pairs, content.preferences(mine, tags), tags).select("item_id", "hundredths")


@query(f"SELECT item_id, p_name AS title, position::INTEGER AS position FROM (SELECT *, row_number() OVER (ORDER BY hundredths DESC, item_id) AS position FROM ({_SCORES})) JOIN part ON item_id = p_partkey WHERE position <= 5")
def content_top5(spark: SparkSession, d: str) -> DataFrame:
    mine, _ = _one(spark, d)
    return content.recommend(standins.items(spark, d), mine, standins.tags(spark, d), USER)


@query(f"""WITH r AS ({LAST_SQL}), c AS (SELECT user_id, item_id FROM (SELECT user_id, p_partkey AS item_id, row_number() OVER (PARTITION BY user_id ORDER BY p_partkey) AS nth FROM (SELECT DISTINCT user_id FROM r) r CROSS JOIN part
WHERE NOT EXISTS (SELECT 1 FROM r x WHERE x.user_id = r.user_id AND x.item_id = p_partkey)) WHERE nth <= 100), p AS ({_PREFS}),
s AS (SELECT c.user_id, c.item_id, coalesce(sum(hundredths), 0)::BIGINT AS hundredths FROM c LEFT JOIN (SELECT DISTINCT item_id, tag FROM ({TAGS_SQL})) t ON t.item_id = c.item_id LEFT JOIN p ON p.user_id = c.user_id AND p.tag = t.tag GROUP BY 1, 2)
SELECT user_id, item_id, hundredths, position::INTEGER AS position FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY hundredths DESC, item_id) AS position FROM s) WHERE position <= 5""")
def content_all_users(spark: SparkSession, d: str) -> DataFrame:
    """The content recommender for every user in one plan."""
    return content.best(standins.items(spark, d), standins.last_ratings(spark, d), standins.tags(spark, d))


@query("SELECT p_partkey AS item_id, p_name AS title FROM part ORDER BY p_size DESC NULLS LAST, p_retailprice DESC NULLS LAST, p_partkey LIMIT 5")
def popular_fallback(spark: SparkSession, d: str) -> DataFrame:
    return content.popular(standins.items(spark, d)).select("item_id", "title")


@query(f"SELECT p_partkey AS item_id FROM part WHERE p_partkey NOT IN (SELECT item_id FROM ({RATINGS_SQL}) WHERE user_id = {USER})")
def unrated_items(spark: SparkSession, d: str) -> DataFrame:
    return content.unrated(standins.items(spark, d), standins.ratings(spark, d), USER).select("item_id")


@query("SELECT p_type AS genre, unnest(list_sort(list(p_partkey))) AS item_id FROM part WHERE p_partkey <= 50 GROUP BY 1")
def titles_map(spark: SparkSession, d: str) -> DataFrame:
    """A map of ids to titles by genre, taken apart again."""
    some = standins.items(spark, d).filter("item_id <= 50")
    maps = some.groupBy("genre").agg(F.map_from_entries(F.collect_list(F.struct("item_id", "title"))).alias("titles"))
    return maps.select("genre", F.explode("titles").alias("item_id", "title")).select("genre", "item_id")


_CLOSED = f"""WITH r AS ({RATINGS_SQL}), g AS (SELECT sum(units) AS s, count(*) AS n FROM r), u AS (SELECT user_id, sum(units) AS us, count(*) AS un FROM r GROUP BY 1), i AS (SELECT item_id, sum(units) AS s2, count(*) AS n2 FROM r GROUP BY 1)
SELECT user_id, item_id, (us::DOUBLE / un + s2::DOUBLE / n2) - s::DOUBLE / n AS estimate FROM u CROSS JOIN i CROSS JOIN g WHERE user_id <= 20"""


@query(_CLOSED)
def score_cross_join(spark: SparkSession, d: str) -> DataFrame:
    """Some users by all rated items: mean of the user plus mean of the item less the mean of all, unclipped."""
    r = standins.ratings(spark, d)
    g = r.agg(F.sum("units").alias("s"), F.count("*").alias("n"))
    u = r.filter("user_id <= 20").groupBy("user_id").agg((F.sum("units").cast("double") / F.count("*")).alias("u"))
    i = r.groupBy("item_id").agg((F.sum("units").cast("double") / F.count("*")).alias("i"))
    return i.crossJoin(F.broadcast(u.crossJoin(g))).select("user_id", "item_id", ((F.col("u") + F.col("i")) - F.col("s").cast("double") / F.col("n")).alias("estimate"))


@query(f"""WITH r AS ({RATINGS_SQL}), g AS (SELECT avg(units) AS m, min(units) AS lo, max(units) AS hi FROM r), u AS (SELECT user_id, avg(units) AS um FROM r GROUP BY 1), i AS (SELECT item_id, avg(units) AS im FROM r GROUP BY 1)
SELECT user_id, item_id, greatest(lo, least(hi, m + (um - m) + (im - m))) AS estimate FROM (SELECT DISTINCT user_id, item_id FROM r WHERE user_id <= 50) JOIN u USING (user_id) JOIN i USING (item_id) CROSS JOIN g""")
def cf_baseline(spark: SparkSession, d: str) -> DataFrame:
    r = standins.ratings(spark, d).withColumn("score", F.col("units").cast("double"))
    return collaborative.baseline(r.filter("user_id <= 50").select("user_id", "item_id").distinct(), r)


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) + 0.0 AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE a.vec_id < 50 AND b.vec_id < 50""")
def user_similarity(spark: SparkSession, d: str) -> DataFrame:
    some = table(spark, d, "embeddings").filter("vec_id < 50").select("vec_id", "embedding")
    return collaborative.similar(some).withColumn("similarity", F.round("similarity", 4) + F.lit(0.0))


@query()
def cf_als_topn(spark: SparkSession, d: str) -> DataFrame:
    """Top 3 of ten users from factors on top of biases; seeded. Factorisation has no SQL."""
    r = written(standins.ratings(spark, d).select("user_id", "item_id", (F.col("units") / 10).alias("score")), "ratings")
    model = collaborative.fit(r, collaborative.Settings(factors=10, rounds=5))
    return model.top(r.filter("user_id <= 10").select("user_id").distinct(), r.select("item_id").distinct()).select("user_id", "item_id", "position")


@query("""SELECT '[2025-01-01 00:00:00] User ID: ' || n_regionkey || ', Top N: 3, Recommendations: ' || string_agg(n_name, ', ' ORDER BY p) AS value FROM
(SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS p FROM nation) WHERE p <= 3 GROUP BY n_regionkey""")
def result_log_line(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    ranked = table(spark, d, "nation").withColumn("position", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))).filter("position <= 3")
    return sinks.result_lines(ranked.select(F.col("n_regionkey").alias("user_id"), "position", F.col("n_name").alias("title")), 3, F.lit("2025-01-01 00:00:00"))


@query("""SELECT 'text' AS column_name, count(*) AS n_rows, count(nullif(text, '')) AS n_filled, count(nullif(text, '')) >= count(*) * 0.95 AS complete FROM documents
UNION ALL SELECT 'lang', count(*), count(nullif(lang, '')), count(nullif(lang, '')) >= count(*) * 0.99 FROM documents""")
def dq_completeness(spark: SparkSession, d: str) -> DataFrame:
    return quality.completeness(table(spark, d, "documents"), {"text": 0.95, "lang": 0.99})


@query(f"SELECT user_id, item_id, rated, count(*) AS n FROM ({RATINGS_SQL}) GROUP BY 1, 2, 3 HAVING count(*) > 1")
def dq_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return keys.duplicates(standins.ratings(spark, d), ["user_id", "item_id", "rated"])


@query("""SELECT 'p_size' AS column_name, count(*) FILTER (p_size < 5) AS n_below, count(*) FILTER (p_size > 40) AS n_above FROM part
UNION ALL SELECT 'p_retailprice', count(*) FILTER (p_retailprice < 950), count(*) FILTER (p_retailprice > 1800) FROM part""")
def dq_ranges(spark: SparkSession, d: str) -> DataFrame:
    return quality.violations(table(spark, d, "part"), {"p_size": (5, 40), "p_retailprice": (950.0, 1800.0)})


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'new ' || n_name ELSE n_name END AS n_name FROM nation UNION ALL SELECT 1000, 'NOWHERE'")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    changes = nation.filter("n_regionkey = 1").select("n_nationkey", F.concat(F.lit("new "), "n_name").alias("n_name")).union(spark.createDataFrame([(1000, "NOWHERE")], "n_nationkey int, n_name string"))
    return sinks.merged(nation.select("n_nationkey", "n_name"), changes, ["n_nationkey"])


@query("SELECT event_id, user_id, event_type FROM events WHERE user_id IS NOT NULL AND event_type IN ('view', 'click', 'share', 'like', 'bookmark', 'search')")
def stream_event_filter(spark: SparkSession, d: str) -> DataFrame:
    """Read as a stream of files, validated, written once, read back."""
    out = f"{shared(spark)}/stream-{uuid.uuid4().hex}"
    schema = ", ".join(f"`{c}` {t}" for c, t in table(spark, d, "events").dtypes)
    stream = events.read(spark, *files.as_folder(spark, f"{d}/events.parquet"), schema=schema)
    events.write(events.valid(stream).select("event_id", "user_id", "event_type"), f"{out}/data", f"{out}/state").awaitTermination()
    return spark.read.schema("event_id long, user_id long, event_type string").parquet(f"{out}/data")
