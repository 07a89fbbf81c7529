"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Features of a document are its words, its runs of symbols and the pairs of neighbouring ones, hashed
into a fixed number of buckets; a pair of equal words is one feature whatever the word. Two
multinomials over the buckets are counted: of all documents, and of the documents that labels trust.
A document's score is the mean over its features of log p(target) - log p(raw). It is kept when the
score reaches a fixed threshold.

Only the target is a bounded sample: at most ``max_trusted`` labelled documents (those with the
smallest hash of doc_id, if there are more), so that their ids can be broadcast. Raw counts cover
every document. Both passes are map-only; between them only `buckets` sums are shuffled.

Defined results: a null, empty or symbol-free blank text has no features, score null and is rejected.
Rows with a null doc_id are scored as any other but never trusted. Repeated rows get equal scores.
A doc_id that any of its labels calls bad isn't trusted. With no trusted document all scores are 0
and everything with features is kept. Columns other than doc_id and text aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .cluster import table

BUCKETS, MAX_TRUSTED, PRIOR, THRESHOLD = 1 << 14, 50_000, 1 << 16, -0.25
_SAME = np.uint64(0x5A17)


def features(cp: np.ndarray, at: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every feature of a chunk."""
    w = kernel.words(cp, at, symbols=True)
    pair, first = w.ngrams(2)
    pair[w.hash[first] == w.hash[first + 1]] = _SAME
    h = np.concatenate([w.hash, kernel.mix(pair)])
    return (h % np.uint64(buckets)).astype(np.int64), np.concatenate([w.row, w.row[first]])


def _count(buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("raw", pa.int64()), ("target", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            trusted = b.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            for lo, hi, cp, at in kernel.chunks(b.column(0)):
                f, row = features(cp, at, buckets)
                raw += np.bincount(f, minlength=buckets)
                target += np.bincount(f[trusted[lo:hi][row]], minlength=buckets)
        k = np.flatnonzero(raw)
        yield kernel.out({"bucket": k, "raw": raw[k], "target": target[k]}, schema)

    return run


def trusted_ids(labels: DataFrame, max_trusted: int) -> DataFrame:
    return (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_llm_id")).agg(F.min("quality").alias("_llm_q"))
        .filter("_llm_q = 1").orderBy(F.xxhash64("_llm_id"), "_llm_id").limit(max_trusted).select("_llm_id", F.lit(True).alias("_llm_trusted"))
    )


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, max_trusted: int = MAX_TRUSTED, prior: float = PRIOR) -> np.ndarray:
    """log p(target) - log p(raw) by bucket. The target is smoothed by `prior` features spread as in the raw corpus, the raw corpus by one a bucket."""
    ids = F.broadcast(trusted_ids(labels, max_trusted))
    slim = docs.select(F.col("doc_id").alias("_llm_doc"), F.col("text").alias("_llm_text"))
    flagged = slim.join(ids, F.col("_llm_doc") == F.col("_llm_id"), "left").select("_llm_text", "_llm_trusted")
    sums = flagged.mapInArrow(_count(buckets), "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target"))
    raw, target = np.ones(buckets), np.zeros(buckets)
    for k, r, t in sums.collect():  # at most `buckets` rows
        raw[k] += r
        target[k] = t
    if not target.any():
        return np.zeros(buckets)
    raw /= raw.sum()
    return np.log((target + prior * raw) / (target.sum() + prior)) - np.log(raw)


def scores(col: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of features and mean log ratio (nan without features) of every text."""
    n, s = np.zeros(len(col), np.int64), np.zeros(len(col))
    for lo, hi, cp, at in kernel.chunks(col):
        f, row = features(cp, at, len(weights))
        n[lo:hi] = np.bincount(row, minlength=hi - lo)
        s[lo:hi] = np.bincount(row, weights[f], minlength=hi - lo)
    with np.errstate(invalid="ignore"):
        return n, np.where(n > 0, s / n, np.nan)


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_features, score, keep: a row for every row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_features", pa.int64()), ("score", pa.float64()), ("keep", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, s = scores(b.column(1), weights)
            yield kernel.out({"doc_id": b.column(0), "n_features": n, "score": pa.array(s, mask=n == 0), "keep": (n > 0) & ~(s < threshold)}, schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_features long, score double, keep boolean")


def keep(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, s = scores(b.column(at), weights)
            yield b.filter(pc.and_(pa.array(n > 0), pa.array(~(s < threshold))))

    return docs.mapInArrow(run, docs.schema)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
