import random

import pytest

WORDS = "the of and to in is that it for was on as with be by this are from at or an which you not have had his but they all were her she there been if more when who will no out so said what up its about than into them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, score double, keep boolean, a string, b string, n long, block int, hash long, token string, place int, version long, root long, span_start long"


def prose(rng, n):
    """n words in sentences of about eight."""
    out = []
    for i in range(n):
        w = rng.choice(WORDS) + rng.choice(["", "", "ly", "ing", "er"])
        out.append(w + (". " if i % 8 == 7 else " "))
    return "".join(out).strip()


@pytest.fixture(scope="session")
def rng():
    return random.Random(7)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, repeated rows, equal ids with other texts."""
    r = random.Random(3)
    text = prose(r, 200)
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "?!... ---"), (5, "word"), (6, text), (6, text), (6, prose(r, 90)), (None, text), (None, None), (None, text), (7, prose(r, 60_000)), (8, "x" * 300_000), (9, text), (10, "日本語のテキスト。한국어 텍스트입니다. é ñ ß"), (11, "퟿\U0001f600 \x00 \x1f"), (12, "a" * 17 + "=" * 3)]
    return [(i, t, None if i in (2, 6) else "en", None if i == 3 else "src", None if i == 4 or t is None else len(t), None, 1.5, None, "a", None, 3, 0, 1, "t", None, 5, None, 0) for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(6, 1, 0, "x"), (7, 1, 0, "x"), (8, 0, 0, "x"), (8, 1, 0, "x"), (None, 1, 0, "x"), (9, None, 1, "x"), (77, 1, 0, "x"), (6, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
