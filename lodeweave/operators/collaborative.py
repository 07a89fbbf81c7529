"""Collaborative filtering: biases in closed form, alternating least squares on what they leave, similarity of users."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import cosine
from ..session import cut, spread, written
from .content import popular


@dataclass(frozen=True)
class Settings:
    """Numbers of factors and rounds, regularisation, share held out, how many to recommend by default and at most."""

    factors: int = 50
    rounds: int = 10
    regularization: float = 0.02
    held_out: float = 0.1
    top_n: int = 3
    most: int = 20
    min_rating: float | None = None  # estimates below it aren't recommended
    seed: int = 42


def held_out(df: DataFrame, share: float = 0.1) -> Column:
    """Whether a rating is for testing: by a hash of its user and item, so always the same."""
    return F.pmod(F.xxhash64("user_id", "item_id"), F.lit(10_000)) < int(share * 10_000)


def biases(ratings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mean score (one row), and how far each user's and each item's mean is from it."""
    mean = ratings.agg(F.avg("score").alias("mean"))
    of = lambda key: ratings.groupBy(key).agg(F.avg("score").alias("m")).crossJoin(F.broadcast(mean)).select(key, (F.col("m") - F.col("mean")).alias(f"{key[0]}_bias"))
    return mean, of("user_id"), of("item_id")


def _known(ratings: DataFrame) -> DataFrame:
    """One row: the mean score and the scale."""
    return ratings.agg(F.avg("score").alias("mean"), F.min("score").alias("low"), F.max("score").alias("high"))


def _clipped(estimate: Column) -> Column:
    return F.greatest("low", F.least("high", estimate))


def _base() -> Column:
    return _clipped(F.col("mean") + F.coalesce("u_bias", F.lit(0.0)) + F.coalesce("i_bias", F.lit(0.0)))


def _estimated(pairs: DataFrame, user: DataFrame, item: DataFrame, known: DataFrame) -> DataFrame:
    all_ = pairs.join(user, "user_id", "left").join(item, "item_id", "left").crossJoin(F.broadcast(known))
    return all_.withColumn("estimate", _base()).drop("mean", "u_bias", "i_bias", "low", "high")


def baseline(pairs: DataFrame, ratings: DataFrame) -> DataFrame:
    """pairs with `estimate`: mean + bias of the user + bias of the item, unknown ones 0, within the scale of the scores."""
    _, user, item = biases(ratings)
    return _estimated(pairs, user, item, _known(ratings))


@dataclass
class Model:
    """Factors, the ratings they are of, and what the baseline needs: biases of users and items, mean and scale."""

    als: ALSModel
    ratings: DataFrame
    user: DataFrame
    item: DataFrame
    known: DataFrame

    def estimates(self, pairs: DataFrame) -> DataFrame:
        """pairs with `estimate`: the baseline and what the factors add, within the scale."""
        both = self.als.transform(_estimated(pairs, self.user, self.item, self.known)).crossJoin(F.broadcast(self.known.select("low", "high")))
        return both.withColumn("estimate", _clipped(F.col("estimate") + F.coalesce(F.nanvl("prediction", F.lit(0.0)), F.lit(0.0)))).drop("prediction", "low", "high")

    def top(self, users: DataFrame, items: DataFrame, n: int = 3) -> DataFrame:
        """user_id, item_id, estimate: the n best of all items, rated ones included; ties by item.

        The estimates of `estimates`, but biases and factors are looked up once a user and once an item, and the users, with theirs, come to
        the items: pairs by user would all meet in as many tasks as there are users."""
        users = users.select("user_id").distinct()
        few = F.broadcast(users)
        of = lambda factors, key, name: factors.select(F.col("id").cast("long").alias(key), F.col("features").alias(name))
        mine = users.join(self.user.join(few, "user_id", "left_semi"), "user_id", "left").join(of(self.als.userFactors, "user_id", "u").join(few, "user_id", "left_semi"), "user_id", "left")
        theirs = items.select("item_id").join(self.item, "item_id", "left").join(of(self.als.itemFactors, "item_id", "i"), "item_id", "left")
        added = reduce(lambda s, x: s + x, (F.col("u")[k] * F.col("i")[k] for k in range(self.als.rank)), F.lit(0.0).cast("float"))  # in the order and precision of ALSModel, whose ids are ints
        all_ = theirs.crossJoin(F.broadcast(mine.crossJoin(F.broadcast(self.known)))).select(F.col("user_id").cast("int").alias("user_id"), F.col("item_id").cast("int").alias("item_id"), _clipped(_base() + F.coalesce(F.nanvl(added, F.lit(0.0)), F.lit(0.0))).alias("estimate"))
        w = Window.partitionBy("user_id").orderBy(F.desc("estimate"), "item_id")
        return all_.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)

    def error(self, ratings: DataFrame) -> DataFrame:
        """n, rmse: of the estimates of given ratings (user_id, item_id, score), such as those held out."""
        off = self.estimates(ratings.select("user_id", "item_id", "score")).select((F.col("estimate") - F.col("score")).alias("off"))
        return off.agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("off") * F.col("off"))).alias("rmse"))

    def similarity(self) -> DataFrame:
        return similar(self.als.userFactors.select(F.col("id"), F.col("features").alias("vector")))


def fit(ratings: DataFrame, settings: Settings = Settings()) -> Model:
    """ratings (user_id, item_id, score), scores above 0, without those held out."""
    train = written(ratings.filter("score > 0").filter(~held_out(ratings, settings.held_out)).select("user_id", "item_id", "score"), "train")
    _, user, item = biases(train)
    user, item, known = written(user, "biases"), written(item, "biases"), cut(_known(train))
    # written, as ALS evaluates its input twice
    rest = written(_estimated(spread(train, "user_id"), user, item, known).select("user_id", "item_id", (F.col("score") - F.col("estimate")).alias("rest")), "rest")
    als = ALS(rank=settings.factors, maxIter=settings.rounds, regParam=settings.regularization, userCol="user_id", itemCol="item_id", ratingCol="rest", coldStartStrategy="nan", seed=settings.seed)
    return Model(als.fit(rest), train, user, item, known)


def recommend(ratings: DataFrame, items: DataFrame, user_id: int, n: int | None = None, settings: Settings = Settings()) -> DataFrame:
    """user_id, position, title: the n best of items (item_id, title, votes, revenue) for a user, `settings.most` at most, best first.
    A user without ratings gets the popular items."""
    n = min(n or settings.top_n, settings.most)
    if ratings.filter((F.col("user_id") == user_id) & (F.col("score") > 0)).isEmpty():
        best = popular(items, n)
        return best.select(F.lit(user_id).cast("long").alias("user_id"), F.row_number().over(Window.orderBy(F.desc_nulls_last("votes"), F.desc_nulls_last("revenue"), "item_id")).alias("position"), "title")
    user = ratings.sparkSession.range(user_id, user_id + 1).toDF("user_id")
    best = fit(ratings, settings).top(user, items, n)
    if settings.min_rating is not None:
        best = best.filter(F.col("estimate") >= settings.min_rating)
    return best.join(items.select("item_id", "title"), "item_id").select("user_id", "position", "title").orderBy("position")


def similar(vectors: DataFrame) -> DataFrame:
    """a, b, similarity for all pairs a < b of (id, vector): the full matrix, as its upper half."""
    x, y = vectors.toDF("a", "va"), vectors.toDF("b", "vb")
    return x.join(y, F.col("a") < F.col("b")).select("a", "b", cosine(F.col("va"), F.col("vb")).alias("similarity"))
