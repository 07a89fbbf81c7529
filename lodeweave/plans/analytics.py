"""The eight analytical queries, and the relational operators they are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import analytics, content, keys, quality
from ..operators import ratings as rate
from ..session import spread
from ..sources.files import TABLES, table
from ..sources.files import query as query_sql
from . import standins
from .registry import query
from .standins import LAST_SQL, RATINGS_SQL, TAGS_SQL

TITLE, YEARS = "blue bolt", ("1996", "1999")


@query("SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part WHERE p_name = (SELECT min(p_name) FROM part)")
def q1_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    first = part.agg(F.min("p_name").alias("p_name"))
    return part.join(F.broadcast(first), "p_name", "left_semi").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")


@query("SELECT p_partkey, p_name FROM part WHERE p_type = 'STANDARD' ORDER BY p_partkey")
def parameterized_filter(spark: SparkSession, d: str) -> DataFrame:
    """SQL with a named parameter; Catalyst sees a literal, so the filter reaches the scan."""
    return query_sql(spark, "SELECT p_partkey, p_name FROM {part} WHERE p_type = :kind ORDER BY p_partkey", {"part": table(spark, d, "part")}, kind="STANDARD")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)) ORDER BY o_orderkey")
def q2_nested_semi_join(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return analytics.of_groups(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), customers, nations, "o_custkey", "c_nationkey").select("o_orderkey", "o_orderdate").orderBy("o_orderkey")


@query("SELECT strftime(o_orderdate, '%Y') AS year, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1")
def q3_count_by_year(spark: SparkSession, d: str) -> DataFrame:
    return analytics.per_year(table(spark, d, "orders").select("o_orderdate"), "o_orderdate")


@query("SELECT o_orderkey, o_orderpriority, count(*) AS n_people FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2 ORDER BY n_people DESC, o_orderkey LIMIT 1")
def q4_most_connected(spark: SparkSession, d: str) -> DataFrame:
    roles = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"))
    found = analytics.most_connected(table(spark, d, "orders"), roles, table(spark, d, "supplier"), "o_orderkey", "s_suppkey", "o_orderpriority")
    return found.select("o_orderkey", "o_orderpriority", "n_people")


@query(f"""SELECT p_partkey, p_name, ((sum(units) * 20 + count(*)) // (2 * count(*)))::BIGINT AS hundredths FROM ({RATINGS_SQL}) JOIN part ON item_id = p_partkey
GROUP BY 1, 2 ORDER BY hundredths DESC, p_name, p_partkey LIMIT 20""")
def q5_top_rated(spark: SparkSession, d: str) -> DataFrame:
    """Mean ratings in hundredths, rounded half up."""
    means = standins.ratings(spark, d).groupBy("item_id").agg(numbers.half_up(F.sum("units"), F.count("*"), 10).alias("hundredths"))
    part = table(spark, d, "part").select("p_partkey", "p_name")
    return means.join(part, F.col("item_id") == F.col("p_partkey")).select("p_partkey", "p_name", "hundredths").orderBy(F.desc("hundredths"), "p_name", "p_partkey").limit(20)


@query(f"SELECT ((sum(units) * 20 + count(*)) // (2 * count(*)))::BIGINT AS hundredths, count(*) AS n FROM ({RATINGS_SQL})")
def q5_global_average(spark: SparkSession, d: str) -> DataFrame:
    return standins.ratings(spark, d).agg(numbers.half_up(F.sum("units"), F.count("*"), 10).alias("hundredths"), F.count("*").alias("n"))


@query(f"""SELECT strftime(o_orderdate, '%Y') AS year, count(*) AS n FROM orders WHERE strftime(o_orderdate, '%Y') BETWEEN '{YEARS[0]}' AND '{YEARS[1]}'
AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = (SELECT min(p_type) FROM part))) GROUP BY 1 ORDER BY 1""")
def q6_count_year_semi_scalar(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    wanted = part.join(F.broadcast(part.agg(F.min("p_type").alias("p_type"))), "p_type", "left_semi").select(F.col("p_partkey").alias("l_partkey"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    orders = analytics.years_between(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", *YEARS)
    return analytics.per_year(analytics.of_groups(orders, lines, wanted, "o_orderkey", "l_partkey"), "o_orderdate")


_CREDITS = "SELECT s_name AS name, CAST(o_totalprice AS DECIMAL(18,2)) - CAST(l_extendedprice AS DECIMAL(18,2)) AS profit FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey"


@query(f"""WITH sums AS (SELECT name, count(*) AS n_items, sum(profit) AS p FROM ({_CREDITS}) GROUP BY name)
(SELECT name, n_items, CAST(NULL AS DOUBLE) AS total_profit FROM sums ORDER BY n_items DESC, name LIMIT 10) UNION (SELECT name, NULL, CAST(p AS DOUBLE) FROM sums ORDER BY p DESC NULLS LAST, name LIMIT 10)""")
def q7_top_people_union(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("cost"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").cast("decimal(18,2)").alias("gain"))
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return analytics.top_people(lines.join(orders, "l_orderkey").join(names, "l_suppkey"), "s_name", F.col("gain") - F.col("cost"))


def _roles(spark: SparkSession, d: str) -> DataFrame:
    orders = analytics.years_between(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "o_orderdate", *YEARS)
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("s_suppkey"))
    lines, orders = spread(lines, "l_orderkey", of=(lines, orders)), spread(orders, "l_orderkey", of=(lines, orders))
    return lines.join(orders, "l_orderkey").withColumn("year", text.year(F.col("o_orderdate")))


@query(f"""WITH roles AS (SELECT l_orderkey AS item, l_suppkey AS person, strftime(o_orderdate, '%Y') AS year FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE strftime(o_orderdate, '%Y') BETWEEN '{YEARS[0]}' AND '{YEARS[1]}'),
c AS (SELECT a.person AS p1, b.person AS p2, a.year, count(*) AS n FROM roles a JOIN roles b ON a.item = b.item AND a.person < b.person GROUP BY 1, 2, 3)
SELECT x.s_name AS first, y.s_name AS second, year, n FROM c JOIN supplier x ON p1 = x.s_suppkey JOIN supplier y ON p2 = y.s_suppkey ORDER BY year, n DESC, first, second""")
def q8_coappearance(spark: SparkSession, d: str) -> DataFrame:
    return analytics.coappearances(_roles(spark, d), table(spark, d, "supplier"), "l_orderkey", "s_suppkey", "s_name")


@query(f"SELECT p_partkey AS item_id, p_name AS title, tag FROM part JOIN (SELECT DISTINCT item_id, tag FROM ({TAGS_SQL})) ON item_id = p_partkey")
def view_item_genre(spark: SparkSession, d: str) -> DataFrame:
    content.indicator(standins.tags(spark, d)).createOrReplaceTempView("item_tag")
    standins.items(spark, d).createOrReplaceTempView("item")
    return spark.sql("SELECT item_id, title, tag FROM item JOIN item_tag USING (item_id)")


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS token, unnest(range(0, len(string_split(p_name, ' '))))::INTEGER AS place FROM part WHERE p_name <> ''")
def split_explode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.posexplode(text.tokens(F.col("p_name"), " ")).alias("place", "token")).select("p_partkey", "token", "place")


@query("SELECT n_nationkey, substr(n_name, 1, 2) AS code, n_name || '-X' AS name FROM nation")
def split_pair(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.substring("n_name", 1, 2), F.lit("-"), F.col("n_name"), F.lit("-X"))
    return table(spark, d, "nation").select("n_nationkey", text.code_and_name(made).alias("x")).select("n_nationkey", "x.code", "x.name")


@query("""SELECT s_suppkey, string_split(s_name || ' Ann Lee', ' ')[1] AS first_name, array_to_string(string_split(s_name || ' Ann Lee', ' ')[2:], ' ') AS last_name,
s_suppkey * 1000 AS revenue, (s_suppkey % 200)::INTEGER AS runtime FROM supplier""")
def split_name_and_amounts(spark: SparkSession, d: str) -> DataFrame:
    name = text.first_and_last(F.concat("s_name", F.lit(" Ann Lee")))
    grouped, length = F.format_string("%,d", F.col("s_suppkey") * 1000), F.concat((F.col("s_suppkey") % 200).cast("string"), F.lit(" min"))
    return table(spark, d, "supplier").select("s_suppkey", name["first_name"].alias("first_name"), name["last_name"].alias("last_name"), text.amount(grouped).alias("revenue"), text.minutes(length).alias("runtime"))


@query("SELECT p_partkey, 'p_brand' AS name, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part UNION ALL SELECT p_partkey, 'p_name', p_name FROM part")
def unpivot_columns(spark: SparkSession, d: str) -> DataFrame:
    return rate.long(table(spark, d, "part"), "p_partkey", ["p_brand", "p_type", "p_name"])


@query(f"SELECT user_id, item_id, units, count(*) AS n FROM ({RATINGS_SQL}) GROUP BY ALL")
def rating_clean(spark: SparkSession, d: str) -> DataFrame:
    """From texts, as they come in a file."""
    texts = standins.all_ratings(spark, d).withColumn("raw", (F.col("l_quantity") / 10).cast("string"))
    return rate.cleaned(texts).groupBy("user_id", "item_id", "units").agg(F.count("*").alias("n"))


@query("SELECT CAST(l_quantity * 2 AS BIGINT) AS units, 'out of range' AS reason, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE NOT CAST(l_quantity * 2 AS BIGINT) BETWEEN 10 AND 100 GROUP BY 1")
def rating_rejects(spark: SparkSession, d: str) -> DataFrame:
    texts = standins.all_ratings(spark, d).withColumn("raw", (F.col("l_quantity") / 10).cast("string"))
    return rate.rejected(texts).groupBy("units", "reason").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_retailprice < 1000 THEN 'low' WHEN p_retailprice < 1500 THEN 'medium' ELSE 'high' END AS band FROM part")
def budget_band(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", numbers.band(F.col("p_retailprice"), 1000, 1500).alias("band"))


@query("SELECT p_partkey, nullif(p_size, 10) AS size FROM part WHERE nullif(p_size, 10) IS NULL OR p_size BETWEEN 5 AND 30")
def check_constraint(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "part").select("p_partkey", F.nullif(F.col("p_size"), F.lit(10)).alias("size"))
    return keys.split(df, keys.within(F.col("size"), 5, 30))[0]


@query(f"SELECT user_id, item_id, units FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY rated, units) AS nth FROM ({RATINGS_SQL})) WHERE nth = 1")
def first_wins_dedup(spark: SparkSession, d: str) -> DataFrame:
    return keys.first_wins(standins.ratings(spark, d), ["user_id", "item_id"], ["rated", "units"]).drop("rated")


@query(LAST_SQL)
def last_wins_dedup(spark: SparkSession, d: str) -> DataFrame:
    return standins.last_ratings(spark, d)


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS id, o_orderkey FROM orders")
def surrogate_ids(spark: SparkSession, d: str) -> DataFrame:
    """By ranges: no task sees more than its share."""
    return keys.sequenced(table(spark, d, "orders").select("o_orderkey"), "id", ["o_orderkey"])


@query("SELECT row_number() OVER (ORDER BY n_name) + (SELECT coalesce(max(r_regionkey), 0) FROM region) AS id, n_name FROM nation")
def max_id_offset(spark: SparkSession, d: str) -> DataFrame:
    new = keys.numbered(table(spark, d, "nation"), "i", ["n_name"], 0)
    return new.crossJoin(F.broadcast(keys.next_id(table(spark, d, "region"), "r_regionkey"))).select((F.col("i") + F.col("next_id")).cast("long").alias("id"), "n_name")


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey + (SELECT max(c_custkey) FROM customer), s_name, NULL FROM supplier")
def multi_source_append(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    more = table(spark, d, "supplier").crossJoin(F.broadcast(keys.next_id(first, "id"))).select((F.col("s_suppkey") + F.col("next_id") - 1).alias("id"), F.col("s_name").alias("name"))
    return first.unionByName(more, allowMissingColumns=True)


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES))
def row_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.row_counts({t: table(spark, d, t) for t in TABLES})


@query("SELECT * FROM (SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 5)")
def sample_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").limit(5)


@query("SELECT unnest(['region', 'nation']) AS name")
def catalog_scan(spark: SparkSession, d: str) -> DataFrame:
    from ..sources import files

    files.register(spark, d, ("region", "nation"))
    return files.catalog(spark).filter(F.col("name").isin("region", "nation"))


@query("SELECT DISTINCT p_type FROM part EXCEPT SELECT min(p_type) FROM part")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    kinds = table(spark, d, "part").select("p_type").distinct()
    return kinds.join(kinds.agg(F.min("p_type").alias("p_type")), "p_type", "left_anti")


@query("SELECT year, first, second, n FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY n DESC, first, second) AS nth FROM (" + """
SELECT x.s_name AS first, y.s_name AS second, year, n FROM (SELECT a.l_suppkey AS p1, b.l_suppkey AS p2, strftime(o_orderdate, '%Y') AS year, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey
JOIN orders ON a.l_orderkey = o_orderkey WHERE strftime(o_orderdate, '%Y') BETWEEN '1996' AND '1999' GROUP BY 1, 2, 3) JOIN supplier x ON p1 = x.s_suppkey JOIN supplier y ON p2 = y.s_suppkey)) WHERE nth = 1""")
def top_pair_by_year(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("year").orderBy(F.desc("n"), "first", "second")
    pairs = analytics.pairs(_roles(spark, d), table(spark, d, "supplier"), "l_orderkey", "s_suppkey", "s_name")
    return pairs.withColumn("nth", F.row_number().over(w)).filter("nth = 1").select("year", "first", "second", "n")
