"""From delimited records to the normalized model, with what is rejected and why.

Records are string columns with `_pos`, their order in the file. Empty fields are null here, and text that
is no number becomes null in a number column. Rows that break a constraint are returned as rejects
instead of vanishing. Foreign keys aren't enforced; `orphans` finds what points nowhere.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, text
from . import ratings as r
from .keys import first_wins, next_id, numbered, sequenced, split, within


@dataclass
class Model:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    rejects: dict[str, DataFrame] = field(default_factory=dict)


def _movie(df: DataFrame) -> DataFrame:
    none = F.lit(None)
    col = lambda c, kind: (F.col(c) if c in df.columns else none).cast(kind).alias(c)
    return df.select(
        col("id", "long"), col("orig_title", "string"), col("eng_title", "string"), col("releasedate", "date"), col("release_year", "int"), col("runtime", "int"), col("homepage", "string"), col("bugt_amt", "decimal(15,2)"),
        numbers.band(F.col("bugt_amt") if "bugt_amt" in df.columns else none.cast("decimal(15,2)")).alias("bugt_type"), col("revenue", "decimal(15,2)"), col("votes", "long"), col("cert", "string"), col("img_url", "string"), col("overview", "string"),
    )


def _tokens(df: DataFrame, c: str) -> DataFrame:
    """movie_id, token, with the order they came in."""
    return df.select(F.col("MovieID").try_cast("long").alias("movie_id"), "_pos", F.posexplode(text.tokens(F.col(c))).alias("_item", "token"))


def movies(df: DataFrame) -> Model:
    """movie, genre, categories, country, produces, language, speaks."""
    released = F.col("ReleaseDate").try_cast("date")
    named = df.select(
        "_pos", F.col("MovieID").try_cast("long").alias("id"), F.col("OriginalTitle").alias("orig_title"), F.col("EnglishTitle").alias("eng_title"), released.alias("releasedate"), F.year(released).alias("release_year"), F.col("Runtime").try_cast("int").alias("runtime"),
        F.col("Homepage").alias("homepage"), F.col("Budget").try_cast("decimal(15,2)").alias("bugt_amt"), F.col("Revenue").try_cast("decimal(15,2)").alias("revenue"),
    )
    keyed, unkeyed = split(named, F.col("id").isNotNull())
    m = Model({"movie": _movie(first_wins(keyed, ["id"], ["_pos"]))}, {"movie": unkeyed})
    order = ["_pos", "_item"]

    genre = _tokens(df, "Genres")
    m.tables["genre"] = numbered(first_wins(genre, ["token"], order), "id", order).select("id", F.col("token").alias("name"))
    m.tables["categories"] = sequenced(genre.join(m.tables["genre"].toDF("genre_id", "token"), "token"), "id", order, 1).select("id", "movie_id", "genre_id")

    pair = lambda c: _tokens(df, c).select("movie_id", *order, text.code_and_name(F.col("token")).alias("x")).select("movie_id", *order, "x.code", "x.name")
    countries, odd = split(pair("ProductionCountries"), F.col("name").isNotNull())
    by_code = first_wins(countries, ["code"], order)
    country = first_wins(by_code, ["name"], order)  # the name is unique too: a second code of a name is dropped
    m.tables["country"] = country.select("code", "name")
    m.rejects["country"] = by_code.join(country.select("code"), "code", "left_anti").select("code", "name").unionByName(odd.select("code", "name"))
    m.tables["produces"] = sequenced(countries, "id", order, 0).select("id", "movie_id", F.col("code").alias("country_code"))

    languages, odd = split(pair("SpokenLanguages"), F.col("name").isNotNull())
    m.tables["language"] = first_wins(languages, ["code"], order).select("code", F.col("name").alias("endonym"))
    m.rejects["language"] = odd.select("code", "name")
    m.tables["speaks"] = sequenced(languages, "id", order, 0).select("id", "movie_id", F.col("code").alias("lan_code"))
    return m


def persons(df: DataFrame) -> Model:
    """actor and role. The gender constraint is checked before the first row of an id wins; an empty gender isn't null to it."""
    gender = F.col("Gender").try_cast("int")
    ok, bad = split(df, F.col("Gender").isNotNull() & gender.isNotNull() & within(gender, 1, 3))
    actor = first_wins(ok.filter("CastID is not null"), ["CastID"], ["_pos"])
    role = df.select("_pos", F.col("Character").alias("character"), F.col("CastID").alias("actor_id"), F.col("MovieID").try_cast("long").alias("movie_id"))
    return Model(
        {"actor": actor.select(F.col("CastID").alias("id"), F.col("Name").alias("name"), gender.alias("gender"), F.lit(None).cast("string").alias("res_country")), "role": sequenced(role, "id", ["_pos"], 1).drop("_pos")},
        {"actor": bad.join(actor.select("CastID"), "CastID", "left_anti").select(F.col("CastID").alias("id"), F.col("Name").alias("name"), F.col("Gender").alias("gender")).distinct()},
    )


def ratings(df: DataFrame) -> Model:
    """user_rating on the scale of 1 to 10; rejects have a reason."""
    raw = F.coalesce("Rating", F.lit(""))
    good = r.cleaned(df.withColumn("raw", raw)).select("_pos", F.col("MovieID").try_cast("long").alias("movie_id"), F.col("UserID").try_cast("long").alias("userID"), F.col("Date").alias("date"), "score")
    bad = r.rejected(df.withColumn("raw", raw)).select("UserID", "MovieID", F.col("raw").alias("rating"), "reason")
    return Model({"user_rating": sequenced(good, "id", ["_pos"], 1).drop("_pos")}, {"user_rating": bad})


def imdb(df: DataFrame, movie: DataFrame) -> Model:
    """Further movies under ids after the largest of `movie`, with director, actor and role. A runtime that is no number is rejected."""
    ok, bad = split(df, text.minutes(F.col("Runtime")).isNotNull())
    placed = sequenced(ok, "_i", ["_pos"], 0).crossJoin(F.broadcast(next_id(movie, "id"))).withColumn("id", F.col("_i") + F.col("next_id"))
    title = F.col("Series_Title")
    films = placed.select(
        "id", title.alias("orig_title"), title.alias("eng_title"), F.col("Released_Year").try_cast("int").alias("release_year"), text.minutes(F.col("Runtime")).alias("runtime"), F.col("Poster_Link").alias("homepage"),
        text.amount(F.col("Gross")).cast("decimal(15,2)").alias("revenue"), F.col("No_of_Votes").try_cast("long").alias("votes"), F.col("Certificate").alias("cert"), F.col("Poster_Link").alias("img_url"), F.col("Overview").alias("overview"),
    )
    name = text.first_and_last(F.col("Director"))
    directors = placed.filter(text.present(F.col("Director"))).select(F.col("id").alias("movie_id"), name["first_name"].alias("first_name"), name["last_name"].alias("last_name"))
    stars = placed.select("id", F.posexplode(F.array("Star1", "Star2", "Star3", "Star4")).alias("n", "name")).filter(text.present(F.col("name"))).withColumn("n", F.col("n") + 1)
    actor_id: Column = F.concat_ws("_", "id", "n")
    return Model(
        {
            "movie": _movie(films), "director": sequenced(directors, "id", ["movie_id"], 1).select("id", "first_name", "last_name", "movie_id"),
            "actor": stars.select(actor_id.alias("id"), "name", F.lit(None).cast("int").alias("gender"), F.lit(None).cast("string").alias("res_country")),
            "role": stars.select(F.concat(F.lit("Character "), F.col("n").cast("string")).alias("character"), actor_id.alias("actor_id"), F.col("id").alias("movie_id"), "n"),
        },
        {"movie": bad},
    )


def build(movie_rows: DataFrame, person_rows: DataFrame, rating_rows: DataFrame, imdb_rows: DataFrame | None = None) -> Model:
    """The whole model. The second source is appended under ids of its own, entities aren't matched."""
    out = Model()
    for part in (movies(movie_rows), persons(person_rows), ratings(rating_rows)):
        out.tables |= part.tables
        out.rejects |= part.rejects
    if imdb_rows is not None:
        more = imdb(imdb_rows, out.tables["movie"])
        for name in ("movie", "actor"):
            out.tables[name] = out.tables[name].unionByName(more.tables[name])
        new = sequenced(more.tables["role"], "_i", ["movie_id", "n"], 0).crossJoin(F.broadcast(next_id(out.tables["role"], "id")))
        out.tables["role"] = out.tables["role"].unionByName(new.withColumn("id", F.col("_i") + F.col("next_id")).drop("_i", "next_id", "n"))
        out.tables["director"] = more.tables["director"]
        out.rejects["imdb"] = more.rejects["movie"]
    return out


def raw_stage(movie_rows: DataFrame, person_rows: DataFrame, rating_rows: DataFrame) -> Model:
    """The earlier stage: the same shape without checks. Every genre token is a genre row, actors and ratings aren't filtered, ratings aren't rescaled."""
    order = ["_pos", "_item"]
    out = movies(movie_rows)
    genre = _tokens(movie_rows, "Genres")
    out.tables["genre"] = sequenced(genre, "id", order, 1).select("id", F.col("token").alias("name"))
    out.tables["actor"] = first_wins(person_rows.filter("CastID is not null"), ["CastID"], ["_pos"]).select(F.col("CastID").alias("id"), F.col("Name").alias("name"), F.col("Gender").alias("gender"))
    out.tables["role"] = persons(person_rows).tables["role"]
    out.tables["user_rating"] = rating_rows.select("UserID", "MovieID", F.col("Rating").alias("score"), F.col("Date").alias("date"))
    return out


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")
