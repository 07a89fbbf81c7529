"""Near-duplicate groups by MinHash and an LSH forest.

A document is the set of its pairs of neighbouring words (a text of one word: that word), its
signature `trees * depth` minima of it. Texts with the same words collapse to one representative
first, exactly. In the forest every tree holds the representatives sorted by its own part of the signature; a
document's candidates are its neighbours in that order, longest common prefix first. They must share
`least` minima. A region (what shares them in one tree) of up to width + 1 documents is compared pair by
pair. A larger one is searched without a cap: from a document to all that agree with it, from those to
all others that agree with them, and so on; then from one that is left. So whatever two of its documents agree
are in one group, and only documents not yet reached are compared: few comparisons where the region is one
group, all pairs where nothing agrees. Pairs of
which the whole signatures agree on at least `threshold` of the similarity are edges; the connected
components are the groups, and the smallest doc_id of a group is the document that stays.

Sorting is one window over (tree, first `least` minima), so no partition holds more than one region. A large region
is in one task, with a byte of every minimum of its documents.

Defined results: null, empty and wordless texts and rows with a null doc_id are in no group. Repeated rows of
one doc_id are one document (in `keep` one of several equal rows stays). Rows that share a doc_id but
differ in text are in the groups of all their texts, and go together. Ties are settled by doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel
from .cluster import cut, table

TREES, DEPTH, LEAST, WIDTH, THRESHOLD = 20, 8, 4, 8, 0.6
_BLOCK = 1 << 14
_STEP = 16
_LONE = 0xFFFFFFFF


def multipliers(k: int) -> tuple[np.ndarray, np.ndarray]:
    x = kernel.mix(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    return (x[:k] | np.uint64(1)).astype(np.uint32), (x[k:] >> np.uint64(32)).astype(np.uint32)


def signatures(cp: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that have words, their minima (uint32, rows by k) and a hash of their word sequences."""
    w = kernel.words(cp, at)
    pair, first = w.ngrams(2)
    n = np.diff(w.first)
    single = w.first[:-1][n == 1]
    h = np.concatenate([pair, w.hash[single]])
    row = np.concatenate([w.row[first], w.row[single]])
    order = np.argsort(row, kind="stable")
    h, row = (h[order] >> np.uint64(32)).astype(np.uint32), row[order]
    rows, where = np.unique(row, return_index=True)
    a, b = multipliers(k)
    sig = np.full((k, len(rows)), _LONE, np.uint32)
    for lo in range(0, len(h), _BLOCK):  # blocks that fit in the cache
        part, r = h[lo : lo + _BLOCK], row[lo : lo + _BLOCK]
        cuts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        to = np.searchsorted(rows, r[cuts])
        for i in range(k):
            x = part * a[i] + b[i]
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            sig[i, to] = np.minimum(sig[i, to], np.minimum.reduceat(x, cuts))
    exact = kernel.span_hash(w.hash, w.first[:-1], w.first[1:])[rows] if len(rows) else np.zeros(0, np.uint64)
    return rows, sig.T, exact


def sketch(docs: DataFrame, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """id, exact (hash of all words), sig (binary; minima of 4 bytes, big-endian so that binary order is theirs) of rows with words and a doc_id."""
    k = trees * depth
    schema = pa.schema([("id", pa.int64()), ("exact", pa.int64()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for lo, _, cp, at in kernel.chunks(b.column(1)):
                rows, sig, exact = signatures(cp, at, k)
                sigs = kernel.binaries(np.ascontiguousarray(sig, ">u4").view(np.uint8))
                yield kernel.out({"id": ids.take(pa.array(rows + lo)), "exact": exact.view(np.int64), "sig": sigs}, schema)

    return docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "id long, exact long, sig binary")


def regions(reps: DataFrame, trees: int = TREES, depth: int = DEPTH, least: int = LEAST) -> DataFrame:
    """id, tree, head (first minima), tail, members (of the region): the places of rows (id, sig) in regions of more than one."""
    size = 4 * depth
    keys = F.array(*(F.substring("sig", 1 + t * size, size) for t in range(trees)))
    rows = reps.select("id", F.posexplode(keys).alias("tree", "key")).select("id", "tree", F.substring("key", 1, 4 * least).alias("head"), F.substring("key", 4 * least + 1, size).alias("tail"))
    return rows.withColumn("members", F.count("*").over(Window.partitionBy("tree", "head"))).filter("members > 1")


def forest(places: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct pairs (a, b), a < b, of regions of up to width + 1 rows."""
    w = Window.partitionBy("tree", "head").orderBy("tail", "id")
    near = places.filter(F.col("members") <= width + 1).select("id", F.collect_list("id").over(w.rowsBetween(1, width)).alias("next"))
    pairs = near.filter(F.size("next") > 0).select("id", F.explode("next").alias("other")).filter("id <> other")
    return pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def links(low: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs of rows that connect what agreement by at least the threshold connects, fewer than rows."""
    n, k = low.shape
    need = next((c for c in range(k + 1) if _similarity(c / k) >= threshold), k + 1)
    columns, left, queue, out, size = np.ascontiguousarray(low.T), np.arange(n), np.zeros(0, np.int64), [], 1

    def agree(step: np.ndarray) -> np.ndarray:
        found = np.zeros((len(step), len(left)), bool)
        for lo in range(0, len(left), _BLOCK):
            part = columns[:, left[lo : lo + _BLOCK]]
            same = np.zeros((len(step), part.shape[1]), np.uint8 if k < 256 else np.uint32)
            equal = np.empty(same.shape, bool)
            for i in range(k):
                np.equal(part[i], columns[i, step][:, None], out=equal)
                same += equal.view(np.uint8)
            found[:, lo : lo + _BLOCK] = same >= need
        return found

    while len(left):
        if len(queue):
            step, queue = queue[:_STEP], queue[_STEP:]
            found = agree(step)
            hit, first = found.any(axis=0), step[found.argmax(axis=0)]
            out += zip(first[hit].tolist(), left[hit].tolist())
            queue = np.concatenate([queue, left[hit]])
        else:  # rows in turn, until one agrees with another
            found = agree(left[:size])
            np.fill_diagonal(found, False)
            some = found.any(axis=1)
            at = int(some.argmax()) if some.any() else len(some)
            size = min(2 * size, _STEP) if at == len(some) else 1
            hit = found[at] if at < len(some) else np.zeros(len(left), bool)
            out += [(int(left[at]), int(x)) for x in left[hit]]
            queue = left[hit]
            hit[: min(at + 1, len(some))] = True
        left = left[~hit]
    return out


def crowds(places: DataFrame, low: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """Pairs (a, b) that connect what agrees in regions of more than width + 1 rows. low: id, low of all rows."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, col = t.column("id").to_numpy(), t.column("low").combine_chunks()
        found = np.array(links(kernel.fixed(col, len(col[0].as_py())), threshold), int).reshape(-1, 2)
        return pa.table({"a": ids[found[:, 0]], "b": ids[found[:, 1]]}, schema)

    rows = places.filter(F.col("members") > width + 1).select("id", "tree", "head").join(low, "id")
    return rows.groupBy("tree", "head").applyInArrow(run, "a long, b long")


def _similarity(same: float | np.ndarray) -> float | np.ndarray:
    """Of the share of equal bytes, of which one in 256 is equal by chance."""
    return (same - 1 / 256) / (1 - 1 / 256)


def _agreement(k: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                a, b = (kernel.fixed(x.column(i), k) for i in (2, 3))
                same = (a == b).mean(axis=1)
                yield kernel.out({"a": x.column(0), "b": x.column(1), "similarity": _similarity(same)}, schema)

    return run


def low_bytes(sketches: DataFrame, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """id, low: the lowest byte of every minimum, a fourth of the signature with the same information for comparing."""
    k = trees * depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            s = kernel.fixed(x.column(1), 4 * k).reshape(-1, k, 4)[:, :, 3]
            yield pa.RecordBatch.from_arrays([x.column(0), kernel.binaries(s)], ["id", "low"])

    return sketches.select("id", "sig").mapInArrow(run, "id long, low binary")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for the nodes of edges (a, b): alternating large-star and small-star rounds until nothing changes."""
    edges, before = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()), None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        w = Window.partitionBy("u")
        large = both.withColumn("m", F.least("u", F.min("v").over(w))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.withColumn("m", F.min("v").over(w)).select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        edges = cut(small)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.toDF("node", "root")
        before = now


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, least: int = LEAST, width: int = WIDTH) -> DataFrame:
    """doc_id, duplicate_of, group_size: a row for every document that has a smaller near duplicate; duplicate_of is the smallest doc_id of the group."""
    sketches = cut(sketch(docs, trees, depth))
    w = Window.partitionBy("exact")
    reps = sketches.groupBy("exact").agg(F.min_by("sig", "id").alias("sig"), F.min("id").alias("id"))
    low = low_bytes(reps, trees, depth)
    places = regions(reps, trees, depth, least)
    pairs = forest(places, width)
    joined = pairs.join(low.toDF("a", "x"), "a").join(low.toDF("b", "y"), "b").select("a", "b", "x", "y")
    near = joined.mapInArrow(_agreement(trees * depth), "a long, b long, similarity double").filter(F.col("similarity") >= threshold).select("a", "b")
    exact = sketches.select("id", F.min("id").over(w).alias("rep")).filter("id <> rep").distinct()
    groups = components(near.union(exact).union(crowds(places, low, threshold, width)))
    sizes = groups.groupBy("root").agg((F.count("*") + 1).alias("group_size"))
    return groups.join(sizes, "root").select(F.col("node").alias("doc_id"), F.col("root").alias("duplicate_of"), "group_size")


def keep(docs: DataFrame, **params) -> DataFrame:
    """docs without near duplicates of a smaller doc_id, and with one of several equal rows; all columns."""
    gone = near_duplicates(docs, **params).select(F.col("doc_id").alias("_llm_gone"))
    named = docs.filter("doc_id is not null")
    left = named.join(gone, F.col("doc_id") == F.col("_llm_gone"), "left_anti")
    w = Window.partitionBy("doc_id", "_llm_text").orderBy("doc_id")
    once = left.withColumn("_llm_text", F.xxhash64("text")).withColumn("_llm_n", F.row_number().over(w)).filter("_llm_n = 1").select(*(left[c] for c in docs.columns))
    return once.unionByName(docs.filter("doc_id is null"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
