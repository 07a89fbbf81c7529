"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodeweave.llm import decontaminate, html, langid, lm, neardup, packing, pii, quality, secrets, sentences

from tests.conftest import SMALL


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "no such words occur anywhere in here at all", 1), (2, None, 2), (None, "", 3), (4, "nor do these ones, which are a few more", 4)], "item_id long, text string, doc_id long")


def operators(labels, benchmark):
    return {
        "secrets": secrets.findings, "quality": lambda d: quality.score(d, quality.fit(d, labels)), "decontaminate": lambda d: decontaminate.matches(d, benchmark), "packing": packing.pack, "neardup": neardup.near_duplicates,
        "langid": lambda d: langid.identify(d, langid.fit(d)), "sentences": sentences.cleaned, "lm": lambda d: lm.score(d, block=100_000), "pii": lambda d: pii.spans(d, pii.fit(d)),
    }


NAMES = ("secrets", "quality", "decontaminate", "packing", "neardup", "langid", "sentences", "lm", "pii")


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(name, odd, labels, benchmark):
    got = operators(labels, benchmark)[name](odd).collect()
    n = odd.count()
    if name in ("quality", "langid", "lm"):
        assert len(got) == n
    if name == "quality":
        by = {(r.doc_id, r.n_features): r for r in got}
        assert not by[1, 0].keep and by[1, 0].score is None and not by[2, 0].keep and not by[3, 0].keep
        assert len({r.score for r in got if r.doc_id == 6}) == 2
    if name == "langid":
        assert {r.doc_id for r in got if r.language is None} == {1, 2, 3, 4, None, 11}
    if name == "lm":
        assert {r.doc_id for r in got if r.n_words == 0} == {1, 2, 3, 4, None, 11}
    if name == "neardup":
        assert sorted(map(tuple, got)) == [(9, 6, 2)]
    if name == "sentences":
        by = {r.doc_id: r for r in got}
        assert set(by) == {None, 9}
        assert by[9].first_ids == [6] and len(by[9].text) < 40
    if name == "packing":
        segments = [s for r in got for s in r.segments]
        assert {s.doc_id for s in segments} == {None, *range(3, 13)}
        assert all(r.n_tokens <= 2048 for r in got)
    if name in ("secrets", "decontaminate"):
        assert got == []


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(name, none, labels, benchmark):
    assert operators(labels, benchmark)[name](none).collect() == []


def test_labels_and_benchmark_may_be_empty(odd, labels, benchmark):
    scored = quality.score(odd, quality.fit(odd, labels.limit(0))).collect()
    assert {r.score for r in scored} == {None, 0.0} and all(r.keep == (r.n_features > 0) for r in scored)
    assert decontaminate.matches(odd, benchmark.limit(0)).count() == 0


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", None, "x", 1.0), (None, None, "", "x", 1.0), (3, "u", "<p>", "x", 1.0), (3, "u", "plain, but <b>bold", "x", None), (4, "u", "<div>" * 3000 + "text" * 9000, "x", 1.0)], "page_id long, url string, html string, title string, score double")
    got = {(r.page_id, r.text if r.text is None else r.text[:8]): r for r in html.extracted(df).collect()}
    assert (1, None) in got and (None, "") in got and (3, "") in got and (3, "plain, b") in got and (4, "texttext") in got
    assert html.extracted(df.limit(0)).count() == 0


@pytest.mark.parametrize("stage", [0, 1, 2, 3])
def test_stages_keep_columns(stage, spark, odd, none, tmp_path):
    name, f = corpus_pipeline.STAGES[stage]
    out = f(spark, odd, SMALL)
    assert out.schema == odd.schema and f(spark, none, SMALL).count() == 0
    got = out.collect()
    extra = [c for c in odd.columns if c not in ("text", "n_chars")]
    before = {tuple(r[c] for c in (*extra, "doc_id")) for r in odd.collect()}
    assert {tuple(r[c] for c in (*extra, "doc_id")) for r in got} <= before
    if stage == 1:
        ids = [r.doc_id for r in got]
        assert 9 not in ids and ids.count(6) == 2 and ids.count(None) == 3  # of the two equal rows of 6 one stays
    if stage in (2, 3):
        assert len(got) == odd.count()


def test_packing_keeps_null_ids_and_repeats(odd):
    segments = packing.pack(odd).select(F.explode("segments").alias("s")).select("s.*").groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    assert {r.doc_id: r.n for r in segments if r.doc_id in (None, 6)} == {None: 2, 6: 3}
