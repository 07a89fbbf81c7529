"""Packing: best-fit decreasing of token sequences into windows of a fixed capacity.

A document longer than a window is first cut into full windows; what is left over (shorter than a
window) is packed. Best-fit decreasing only depends on how many pieces there are of each length, so
the plan for the whole corpus, exactly the one that piece-by-piece best-fit decreasing makes, is
computed from a histogram with one entry a length: a segment tree indexed by remaining capacity finds
the tightest open windows that fit, and as many equal pieces as fit go into equal windows at once.
The driver holds state in proportion to the capacity, whatever the corpus. Pieces are numbered within
their length, in parallel by (length, salt), and look their place up in the plan.

Only (doc_id, length) is shuffled, never text. Layout, not tokens, is returned: a segment says which tokens of which
document are where in a window.

Defined results: a null or empty text, or one without tokens, has no segment. A null doc_id is a
document as any other. Repeated rows are packed once each. Pieces of equal length are placed in the order of
(salt, doc_id), so the layout is deterministic up to rows with equal doc_id and length.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel
from .cluster import cut, table
from .tokens import VOCABULARY, Counter

CAPACITY, SALTS = 2048, 32


class Tightest:
    """Segment tree over remaining capacities: which of them some open window has."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, r: int, value: bool) -> None:
        i = r + self.size
        while i and self.any[i] != value:
            self.any[i] = value
            i //= 2
            value = self.any[2 * i] or self.any[2 * i + 1] if i else value

    def first(self, r: int) -> int:
        """The smallest remaining capacity of at least r, or -1."""
        i = r + self.size
        if self.any[i]:
            return r
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return -1


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Steps (length, number of its first piece, pieces a window, first window, place in the window), and the number of windows.

    Pieces i, i + 1, ... of a step go to window first + i // per, at place + length * (i % per).
    """
    open_: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    tree, steps, windows = Tightest(capacity), [], 0

    def leave(r: int, first: int, n: int) -> None:
        heapq.heappush(open_[r], (first, n))
        tree.set(r, True)

    for length in sorted((x for x in histogram if histogram[x]), reverse=True):
        left, number = histogram[length], 0
        while left:
            r = tree.first(length)
            if r < 0:
                r, first, n = capacity, windows, -(-left // (capacity // length))
                windows += n
            else:
                first, n = heapq.heappop(open_[r])
                tree.set(r, bool(open_[r]))
            per = r // length
            use = min(n, left // per)
            if use:
                steps.append((length, number, per, first, capacity - r))
                leave(r - per * length, first, use)
            left, number, first, n = left - use * per, number + use * per, first + use, n - use
            if n and left and left < per:
                steps.append((length, number, left, first, capacity - r))
                leave(r - left * length, first, 1)
                left, first, n = 0, first + 1, n - 1
            if n:
                leave(r, first, n)
    return steps, windows


def lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n: the number of tokens of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(vocabulary)
        for b in batches:
            yield kernel.out({"doc_id": b.column(0), "n": count(b.column(1))}, schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long")


def _numbered(rows: DataFrame, size: str) -> tuple[DataFrame, dict[tuple[int, int], int], dict[int, int]]:
    """rows with their number within (size, salt); where the numbers of (size, salt) start within the size; rows by size."""
    counts = {(r[0], r[1]): r[2] for r in rows.groupBy(size, "salt").count().collect()}
    base, total = {}, {}
    for s, salt in sorted(counts):
        base[s, salt] = total.get(s, 0)
        total[s] = base[s, salt] + counts[s, salt]
    return rows.withColumn("i", F.row_number().over(Window.partitionBy(size, "salt").orderBy("doc_id")) - 1), base, total


def place(sizes: DataFrame, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """window_id, n_tokens, segments [(window_start, doc_id, doc_start, n_tokens)] in order, from (doc_id, n)."""
    rows = sizes.filter("n > 0").select("doc_id", "n", F.pmod(F.xxhash64("doc_id", "n"), F.lit(salts)).cast("int").alias("salt"), F.expr(f"n div {capacity}").alias("full"), F.expr(f"n % {capacity}").cast("int").alias("rest"))
    rests, rest_base, histogram = _numbered(rows.filter("rest > 0"), "rest")
    steps, windows = plan(histogram, capacity)
    key = np.array([s[0] << 44 | s[1] for s in sorted(steps)], np.int64)
    per, first, at = (np.array([s[k] for s in sorted(steps)], np.int64) for k in (2, 3, 4))
    starts = np.zeros((capacity, salts), np.int64)
    for (size, salt), x in rest_base.items():
        starts[size, salt] = x
    segment = pa.schema([("window_id", pa.int64()), ("window_start", pa.int32()), ("doc_id", pa.int64()), ("doc_start", pa.int64()), ("n_tokens", pa.int32())])
    names = "window_id long, window_start int, doc_id long, doc_start long, n_tokens int"

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, size, salt, i = (b.column(k).to_numpy() for k in (1, 2, 3, 4))
            size = size.astype(np.int64)
            i = starts[size, salt] + i
            k = np.searchsorted(key, size << 44 | i, "right") - 1
            i = i - (key[k] & ((1 << 44) - 1))
            yield kernel.out({"window_id": first[k] + i // per[k], "window_start": at[k] + size * (i % per[k]), "doc_id": b.column(0), "doc_start": n - size, "n_tokens": size}, segment)

    packed = rests.select("doc_id", "n", "rest", "salt", "i").mapInArrow(rest, names)
    groups = packed.groupBy("window_id").agg(F.sum("n_tokens").cast("int").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("window_start", "doc_id", "doc_start", "n_tokens"))).alias("segments"))
    longs, full_base, full_total = _numbered(rows.filter("full > 0"), "full")
    if not full_total:
        return groups
    above, base = windows, {}
    for size in sorted(full_total):
        for salt in range(salts):
            if (size, salt) in full_base:
                base[size, salt] = above + full_base[size, salt] * size
        above += full_total[size] * size
    # one row for each number of full windows (of the longest document at most) and salt
    bases = sizes.sparkSession.createDataFrame([(f, s, x) for (f, s), x in base.items()], "full long, salt int, above long")
    fulls = longs.join(bases, ["full", "salt"]).select("doc_id", F.expr("above + i * full").alias("above"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("j")).select(
        (F.col("above") + F.col("j")).alias("window_id"), F.lit(capacity).alias("n_tokens"), F.array(F.struct(F.lit(0).alias("window_start"), "doc_id", (F.col("j") * capacity).alias("doc_start"), F.lit(capacity).alias("n_tokens"))).alias("segments")
    )
    return groups.unionByName(fulls)


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    return place(cut(lengths(docs, vocabulary)), capacity)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
