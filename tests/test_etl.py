"""The loaders on the hand-made records of FIXTURES.md."""

import csv

import pytest
from pyspark.sql import functions as F

from lodeweave.operators import analytics, etl, keys
from lodeweave.sources import files, sinks

MOVIES = """MovieID,OriginalTitle,EnglishTitle,Budget,Revenue,Homepage,Runtime,ReleaseDate,Genres,ProductionCountries,SpokenLanguages
1,A,A,500000,1000,,100,2012-05-01,Drama|Comedy,AT-Austria|US-USA,de-Deutsch
2,B,B,,,,,2016-12-31,Drama,AT-Austria,en-English
3,C,C,5000000,9,,90,2013-01-01,Science Fiction,,en-English
4,D,D,0,0,,90,2016-01-01,Science Fiction,XX-Austria,en-English
"""
PERSONS = """CastID,Name,Gender,Character,MovieID
p1,Ann,1,X,1
p1,Ann,1,Y,2
p2,Bob,0,Z,1
p3,Cy,2,Q,1
p3,Cy,2,Q2,3
p4,Dee,,Q2,3
"""
RATINGS = [(1, 1, "4.5", "2012-01-01"), (1, 2, "0.5", "2012-01-01"), *((1, 3, r, "x") for r in ("", "abc", "0.2", "5.5", "1e1", "-1")), (2, 3, " 4 ", "x"), (2, 99, "5", "x"), (2, 3, "3.", "x"), (2, 3, ".5", "x")]
IMDB = [
    ("Shaw", "1994", "A", "142 min", "Frank Dara Bont", "S1", "S2", "", "S4", "2343110", "28,341,469"),
    ("PG", "PG", "", "139 min", "Cher", "S1", "S2", "S3", "S4", "10", ""),
    ("Bad", "2000", "", "", "X Y", "S9", "", "", "", "1", ""),
]


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("csv")
    (d / "m.csv").write_text(MOVIES)
    (d / "p.csv").write_text(PERSONS)
    with (d / "r.csv").open("w", newline="") as f:
        csv.writer(f).writerows([("UserID", "MovieID", "Rating", "Date"), *RATINGS])
    with (d / "i.csv").open("w", newline="") as f:
        csv.writer(f).writerows([("Series_Title", "Released_Year", "Certificate", "Runtime", "Director", "Star1", "Star2", "Star3", "Star4", "No_of_Votes", "Gross"), *IMDB])
    return [files.delimited(spark, str(d / n), c) for n, c in (("m.csv", files.MOVIES), ("p.csv", files.PERSONS), ("r.csv", files.RATINGS), ("i.csv", files.IMDB))]


@pytest.fixture(scope="module")
def model(sources):
    return etl.build(*sources)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


def test_movies_of_both_sources(model):
    got = {r[0]: r[1:] for r in rows(model.tables["movie"], "id", "bugt_type", "runtime", "revenue", "release_year", F.col("releasedate").cast("string"))}
    assert {k: v[0] for k, v in got.items()} == {1: "low", 2: "high", 3: "medium", 4: "low", 5: "high", 6: "high"}
    assert got[2][1:3] == (None, None) and got[5][1:4] == (142, 28341469, 1994) and got[6][2:4] == (None, None)
    assert model.rejects["imdb"].count() == 1


def test_genres_countries_and_links(model):
    t = model.tables
    assert rows(t["genre"], "id", "name") == [(1, "Drama"), (2, "Comedy"), (3, "Science Fiction")]
    assert rows(t["categories"], "id", "movie_id", "genre_id") == [(1, 1, 1), (2, 1, 2), (3, 2, 1), (4, 3, 3), (5, 4, 3)]
    assert rows(t["country"], "code", "name") == [("AT", "Austria"), ("US", "USA")]
    assert rows(model.rejects["country"], "code", "name") == [("XX", "Austria")]
    assert rows(t["produces"], "id", "movie_id", "country_code") == [(0, 1, "AT"), (1, 1, "US"), (2, 2, "AT"), (3, 4, "XX")]
    assert rows(t["language"], "code", "endonym") == [("de", "Deutsch"), ("en", "English")]
    assert rows(t["speaks"], "id", "lan_code") == [(0, "de"), (1, "en"), (2, "en"), (3, "en")]


def test_actors_roles_directors(model):
    t = model.tables
    assert [r[0] for r in rows(t["actor"], "id")] == ["5_1", "5_2", "5_4", "6_1", "6_2", "6_3", "6_4", "p1", "p3"]
    assert rows(model.rejects["actor"], "id") == [("p2",), ("p4",)]
    assert t["role"].count() == 13 and sorted(r[0] for r in rows(t["role"], "id")) == list(range(1, 14))
    assert rows(etl.orphans(t["role"], "actor_id", t["actor"], "id"), "actor_id") == [("p2",), ("p4",)]
    assert rows(t["director"], "id", "first_name", "last_name", "movie_id") == [(1, "Frank", "Dara Bont", 5), (2, "Cher", "", 6)]


def test_ratings_and_their_rejects(model):
    got = model.tables["user_rating"].orderBy("id").select("movie_id", "userID", "score").collect()
    assert [tuple(r) for r in got] == [(1, 1, 9.0), (2, 1, 1.0), (3, 2, 8.0), (99, 2, 10.0), (3, 2, 6.0), (3, 2, 1.0)]
    assert rows(model.rejects["user_rating"], "rating", "reason") == [("", "invalid"), ("-1", "invalid"), ("0.2", "out of range"), ("1e1", "invalid"), ("5.5", "out of range"), ("abc", "invalid")]


def test_queries_on_the_model(model):
    t = model.tables
    austria = t["country"].filter("name = 'Austria'").select(F.col("code").alias("country_code"))
    links = t["produces"].select(F.col("movie_id").alias("id"), "country_code")
    assert rows(analytics.of_groups(t["movie"], links, austria, "id", "country_code"), "eng_title") == [("A",), ("B",)]
    best = analytics.most_connected(t["movie"].withColumnRenamed("id", "movie_id"), t["role"], t["actor"].withColumnRenamed("id", "actor_id"), "movie_id", "actor_id", "eng_title")
    assert rows(best, "eng_title", "n_people") == [("PG", 4)]
    credits = t["role"].join(t["actor"].select(F.col("id").alias("actor_id"), "name"), "actor_id").join(t["movie"].select(F.col("id").alias("movie_id"), "revenue", "bugt_amt"), "movie_id")
    top = analytics.top_people(credits, "name", F.col("revenue") - F.col("bugt_amt"))
    assert sorted(r[0] for r in rows(top, "name")) == sorted(["Ann", "Cy", "S1", "S2", "S3", "S4"] * 2)
    roles = t["role"].join(t["movie"].filter("releasedate is not null").select(F.col("id").alias("movie_id"), F.date_format("releasedate", "yyyy").alias("year")), "movie_id")
    pairs = analytics.coappearances(roles.filter("year between '2010' and '2013'"), t["actor"].withColumnRenamed("id", "actor_id"), "movie_id", "actor_id", "name")
    assert [tuple(r) for r in pairs.collect()] == [("Ann", "Cy", "2012", 1)]


def test_earlier_stage_keeps_everything(sources):
    m = etl.raw_stage(*sources[:3])
    assert m.tables["genre"].count() == 5 and m.tables["actor"].count() == 4
    assert m.tables["user_rating"].count() == len(RATINGS)


def test_two_dashes_keep_the_rest_of_the_name(spark):
    df = spark.createDataFrame([("7", "T", "T", None, None, None, None, None, None, "GB-A-B|ZZ", None, 0)], "MovieID string, OriginalTitle string, EnglishTitle string, Budget string, Revenue string, Homepage string, Runtime string, ReleaseDate string, Genres string, ProductionCountries string, SpokenLanguages string, _pos long")
    m = etl.movies(df)
    assert rows(m.tables["country"]) == [("GB", "A-B")] and rows(m.rejects["country"]) == [("ZZ", None)]


def test_contract_and_quoting(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('UserID,MovieID,Rating\n1,2,"a ""b""\nc"\n')
    assert files.delimited(spark, str(p), files.RATINGS).collect()[0]["Rating"] == 'a "b"\nc'
    p.write_text("UserID,Rating\n1,2\n")
    with pytest.raises(files.ContractError):
        files.delimited(spark, str(p), files.RATINGS)


def test_sequence_has_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    assert [r[0] for r in keys.sequenced(df, "i", ["k"]).orderBy("k").select("i").collect()] == list(range(1000))


def test_sinks(spark, tmp_path):
    p = str(tmp_path / "t")
    sinks.recreate(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), p)
    sinks.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), p, ["id"])
    assert rows(spark.read.parquet(p)) == [(1, "a"), (2, "c"), (3, "d")]
    lines = sinks.result_lines(spark.createDataFrame([(1, 2, "B"), (1, 1, "A")], "user_id int, position int, title string"), 3, F.lit("2025-01-01 00:00:00"))
    for _ in range(2):
        sinks.log(lines, str(tmp_path / "log"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "log")).collect()] == ["[2025-01-01 00:00:00] User ID: 1, Top N: 3, Recommendations: A, B"] * 2
    for kind in ("json", "csv"):
        sinks.export(spark.range(2), str(tmp_path / kind), kind)
    assert rows(spark.read.json(str(tmp_path / "json"))) == [(0,), (1,)] and rows(spark.read.option("header", True).csv(str(tmp_path / "csv")), "id") == [("0",), ("1",)]
    sinks.append(spark.createDataFrame([(9, "z")], "id int, v string"), p)
    assert rows(spark.read.parquet(p))[-1] == (9, "z")
