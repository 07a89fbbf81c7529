"""Content-based recommendation: what tags a user likes, and which unrated items have them.

All set-based, for one user or all at once. Scores enter in integer units (tenths), preferences are
hundredths rounded half to even, so results don't depend on the order of rows or the engine.
Tables: ratings (user_id, item_id, units), one row a pair; tags (item_id, tag).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_even
from ..session import merged, spread, written
from .keys import sequenced


def vocabulary(tags: DataFrame) -> DataFrame:
    """One row: all tags, sorted."""
    return tags.select("tag").distinct().agg(F.sort_array(F.collect_list("tag")).alias("tags"))


def indicator(tags: DataFrame) -> DataFrame:
    """The 0/1 matrix as its ones: a tag that an item has twice counts once."""
    return tags.select("item_id", "tag").distinct()


def _share(units: Column, total: Column) -> Column:
    return F.when(total != 0, half_even(units, F.when(total != 0, total), 100)).otherwise(F.lit(0)).cast("long")


def _listed(tags: DataFrame) -> DataFrame:
    """item_id, tags: one row an item, with each of its tags once, a null one too."""
    return tags.groupBy("item_id").agg(F.collect_set(F.struct("tag")).alias("tags"))


def preferences(ratings: DataFrame, tags: DataFrame) -> DataFrame:
    """user_id, tag, hundredths: the share of each tag in the user's scores; all zero if the scores are."""
    each = ratings.join(merged(_listed(tags), ratings), "item_id").select("user_id", "units", "tags")
    sums = spread(each, "user_id").select("user_id", "units", F.explode("tags").alias("t")).groupBy("user_id", "t.tag").agg(F.sum("units").alias("u"))
    total = F.sum("u").over(Window.partitionBy("user_id"))
    return sums.select("user_id", "tag", _share(F.col("u"), total).alias("hundredths"))


def unrated(items: DataFrame, ratings: DataFrame, user_id: int) -> DataFrame:
    """Items the user hasn't rated."""
    return items.join(ratings.filter(F.col("user_id") == user_id).select("item_id"), "item_id", "left_anti")


def candidates(items: DataFrame, ratings: DataFrame, n: int = 100) -> DataFrame:
    """user_id, item_id: for each user who rated anything, the n unrated items of lowest id.

    They are among the first n + (rated by the user) items, so users never meet the whole catalogue."""
    rank = sequenced(items.select("item_id"), "rank", ["item_id"], 1)
    users = ratings.groupBy("user_id").agg((F.count_distinct("item_id") + n).alias("reach"))
    first = users.select("user_id", F.explode(F.sequence(F.lit(1), F.col("reach").cast("int"))).alias("rank")).join(rank, "rank").select("user_id", "item_id")
    left = first.join(ratings.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    return left.withColumn("nth", F.row_number().over(Window.partitionBy("user_id").orderBy("item_id"))).filter(F.col("nth") <= n).drop("nth")


def scored(pairs: DataFrame, prefs: DataFrame, tags: DataFrame) -> DataFrame:
    """user_id, item_id, hundredths: the sum of the user's preferences for the item's tags; 0 without any."""
    hits = pairs.join(indicator(tags), "item_id").join(prefs, ["user_id", "tag"]).groupBy("user_id", "item_id").agg(F.sum("hundredths").alias("h"))
    return pairs.join(hits, ["user_id", "item_id"], "left").select("user_id", "item_id", F.coalesce("h", F.lit(0)).alias("hundredths"))


def top(scores: DataFrame, n: int = 5) -> DataFrame:
    """The n best items of each user with their position; ties by item."""
    w = Window.partitionBy("user_id").orderBy(F.desc("hundredths"), "item_id")
    return scores.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


def _users(items: DataFrame, ratings: DataFrame, tags: DataFrame, reach: int) -> tuple[DataFrame, DataFrame]:
    """(user_id, ranks, likes), one row for each user who rated anything: the rated ones among the first `reach` + (rated by the user)
    items, and a map of preferences; and the catalogue (item_id, rank, tags). Ratings meet the catalogue once and are then sent to their user once."""
    ranked = sequenced(items.select("item_id"), "rank", ["item_id"], 1)
    catalogue = ranked.join(_listed(tags), "item_id", "full")
    # what a rating tells of its user: an item is gone (rank), and a tag is liked, perhaps the null one, which only counts in the total
    told = F.concat(F.array(F.struct("rank", F.lit(False).alias("liked"), F.lit(None).cast("string").alias("tag"))), F.coalesce(F.transform("tags", lambda t: F.struct(F.lit(None).cast("long").alias("rank"), F.lit(True).alias("liked"), t["tag"].alias("tag"))), F.array()))
    each = spread(ratings.join(merged(catalogue.select("item_id", told.alias("told")), ratings), "item_id", "left").select("user_id", "units", "told"), "user_id")
    sums = each.select("user_id", "units", F.explode_outer("told").alias("t")).groupBy("user_id", "t.rank", "t.liked", "t.tag").agg(F.sum("units").alias("u"))
    users = sums.groupBy("user_id").agg(F.collect_list("rank").alias("ranks"), F.sum(F.when(F.col("liked"), F.col("u"))).alias("total"), F.collect_list(F.when(F.col("liked") & F.col("tag").isNotNull(), F.struct("tag", "u"))).alias("us"))
    known = F.col("user_id").isNotNull()  # a null user is none of those who rated
    ranks = F.filter("ranks", lambda r: known & (r <= reach + F.size("ranks")))
    likes = F.map_from_entries(F.transform(F.filter("us", lambda _: known), lambda x: F.struct(x["tag"], _share(x["u"], F.col("total")))))
    return users.select("user_id", ranks.alias("ranks"), likes.alias("likes")), catalogue


def best(items: DataFrame, ratings: DataFrame, tags: DataFrame, n: int = 5, reach: int = 100) -> DataFrame:
    """user_id, item_id, hundredths, position: for every user who rated anything, the n best of the `reach` unrated items of lowest id; ties by item.

    The same as `top` of `scored` `candidates`, but within one row a user: no candidate moves between tasks. Users only meet the head of the catalogue,
    up to `reach` + the most that any of them rated of it, which is part of the plan."""
    users, catalogue = _users(items, ratings, tags, reach)
    users = written(users, "users")
    most = users.agg(F.max(F.size("ranks"))).first()[0] or 0
    rows = catalogue.filter(F.col("rank") <= reach + most).orderBy("rank").select("item_id", F.transform(F.coalesce("tags", F.array()), lambda t: t["tag"]).alias("tags")).collect()
    head = F.from_json(F.lit(json.dumps([r.asDict() for r in rows])), f"array<struct<item_id:{items.schema['item_id'].dataType.simpleString()},tags:array<string>>>")
    free = F.array_except(F.sequence(F.lit(1).cast("long"), (F.size("ranks") + reach).cast("long")), F.col("ranks"))
    some = F.slice(F.filter(free, lambda r: r <= len(rows)), 1, reach)
    score = lambda item: F.aggregate(item["tags"], F.lit(0).cast("long"), lambda s, t: s + F.coalesce(F.try_element_at(F.col("likes"), t), F.lit(0)))
    scores = F.transform(some, lambda r: F.struct((-score(F.element_at(head, r.cast("int")))).alias("less"), F.element_at(head, r.cast("int"))["item_id"].alias("item_id")))
    return users.select("user_id", F.posexplode(F.slice(F.sort_array(scores), 1, n)).alias("p", "s")).select("user_id", "s.item_id", (-F.col("s.less")).alias("hundredths"), (F.col("p") + 1).alias("position"))


def popular(items: DataFrame, n: int = 5) -> DataFrame:
    """Fallback for users without ratings: most votes, then most revenue; missing ones last; ties by item."""
    return items.orderBy(F.desc_nulls_last("votes"), F.desc_nulls_last("revenue"), "item_id").limit(n)


def recommend(items: DataFrame, ratings: DataFrame, tags: DataFrame, user_id: int, n: int = 5, reach: int = 100) -> DataFrame:
    """item_id, title of the n items for one user, best first (`position`); the popular ones if the user has no ratings."""
    mine = ratings.filter(F.col("user_id") == user_id)
    if mine.isEmpty():
        best = popular(items, n)
        return best.select("item_id", "title", F.row_number().over(Window.orderBy(F.desc_nulls_last("votes"), F.desc_nulls_last("revenue"), "item_id")).alias("position"))
    pairs = unrated(items, mine, user_id).orderBy("item_id").limit(reach).select(F.lit(user_id).cast("long").alias("user_id"), "item_id")
    best = top(scored(pairs, preferences(mine, tags), tags), n)
    return best.join(items.select("item_id", "title"), "item_id").select("item_id", "title", "position")
