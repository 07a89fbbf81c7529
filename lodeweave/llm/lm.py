"""Language-model scoring with a weighted backoff automaton trained on the whole corpus.

The model is a word trigram model with hierarchical Dirichlet smoothing (MacKay and Peto): for a history h with the
shorter history h', p(w|h) = (c(hw) + mu p(w|h')) / (c(h) + mu). N-grams that occur `prune` times at
least in the corpus are kept; that is all of them by default, as the mass of pruned ones would be lost. As an automaton: histories are states; state h has an arc for each kept hw, weighing log p(w|h),
and a failure arc to h', weighing log mu / (c(h) + mu). A text is read once, from left to right: at each word the state takes its
arc for the word, or else failure arcs until one is found (at the empty history an unknown word costs the uniform share of
``UNKNOWN`` words); weights add up, and the next state is the longest kept suffix of what has been read.
As that suffix has at most two words, the state at every place of many texts is found at once, and the traversal is a few array steps.

The model grows with the corpus and is never in one place. Documents are hashed into blocks of about
``BLOCK`` bytes. A block sends its distinct n-grams with their counts to buckets by hash; buckets add up the counts of all
blocks and answer each block with the corpus counts of its own n-grams, in its own order. So each block gets exactly the
states and arcs that its texts can visit. Only hashes, counts and each text (once) are shuffled; executors hold one block or bucket at a time.
Bucket rows hold the differences of their sorted keys, by byte planes, compressed.
With n blocks there are up to n * min(2 n, BUCKETS) such rows; that is small beside the data until the corpus has some 100,000 blocks (more BLOCK then).

Defined results: a null, empty or wordless text has 0 words and a null log probability and perplexity. A null doc_id
is carried. Repeated rows count and are scored each. N-grams don't cross documents.
An n-gram's key is a hash of 64 bits, whatever the size of the corpus: of N different n-grams, one shares its key, and so its count, with a probability of N / 2**64.
States and arcs are implicit: an array of counts for each order, by place, stands for those that the texts of a block visit.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .cluster import table

ORDER, PRUNE, BLOCK, BUCKETS, UNKNOWN, PACKED = 3, 1, 6_000_000, 1 << 16, 1 << 20, 16 << 20
MU = (1000.0, 500.0, 50.0)  # of the empty history, one word, two words


def trim() -> None:
    """Give the memory of a finished group back, as the workers of an executor share its limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def planes(x: np.ndarray) -> bytes:
    """Integers by byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes())


def unplanes(raw: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(size, -1).T).view(dtype).ravel()


def key_planes(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unkey(raw: bytes) -> np.ndarray:
    return np.cumsum(unplanes(raw, np.uint64), dtype=np.uint64)


def read(col: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Keys of the 1-, 2- and 3-grams that end at each word (0 where they would cross the start of a text), and the words' rows and number by row."""
    hashes, rows, sizes = [[] for _ in range(ORDER)], [], []
    for lo, hi, cp, at in kernel.chunks(col):
        w = kernel.words(cp, at)
        for n in range(1, ORDER + 1):
            h = np.zeros(len(w.hash), np.uint64)
            g, first = w.ngrams(n)
            h[first + (n - 1)] = np.maximum(kernel.mix(g + np.uint64(n)), np.uint64(1))
            hashes[n - 1].append(h)
        rows.append(w.row + lo)
        sizes.append(np.diff(w.first))
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return [join(h, np.uint64) for h in hashes], join(rows, np.int64), join(sizes, np.int64)


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets in the order of keys."""
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def known(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a block, sorted, and their counts."""
    each = [np.unique(h[h != 0], return_counts=True) for h in hashes]
    key, n = np.concatenate([k for k, _ in each]), np.concatenate([c for _, c in each]).astype(np.uint32)
    order = np.argsort(key)
    return key[order], n[order]


def packed(docs: DataFrame, blocks: int) -> DataFrame:
    """block, rows (binary): the doc_id and text of docs, those of a task that go to one block together and compressed."""
    schema, inner = pa.schema([("block", pa.int32()), ("rows", pa.binary())]), pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def flush(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches)
        order = t.column("block").combine_chunks().to_numpy().argsort(kind="stable")
        t = t.take(pa.array(order))
        block, cut = np.unique(t.column("block").to_numpy(), return_index=True)
        rows = t.select(["doc_id", "text"]).cast(inner).combine_chunks()
        out, press = [], zstandard.ZstdCompressor(level=6)
        for a, b in zip(cut, [*cut[1:], t.num_rows]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, inner) as w:
                w.write_table(rows.slice(a, b - a).combine_chunks())
            out.append(press.compress(sink.getvalue()))
        return kernel.out({"block": block, "rows": out}, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held, size = [*held, b], size + b.nbytes
            if size > PACKED:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    where = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", where).mapInArrow(run, "block int, rows binary")


def unpacked(t: pa.Table) -> pa.Table:
    """The documents of a block."""
    raw = [zstandard.ZstdDecompressor().decompress(x.as_py()) for x in t.column("rows")]
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in raw]).combine_chunks()


def _ask(buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("words", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        trim()
        block = t.column("block")[0].as_py()
        hashes, rows, _ = read(unpacked(t).column("text").combine_chunks())
        key, n = known(hashes)
        at = np.searchsorted(bucket_of(key, buckets), np.arange(buckets + 1))
        use = [b for b in range(buckets) if b == 0 or at[b + 1] > at[b]]  # the first bucket also adds up the words
        return pa.table(
            {"bucket": use, "block": [block] * len(use), "keys": [key_planes(key[at[b] : at[b + 1]]) for b in use], "counts": [planes(n[at[b] : at[b + 1]]) for b in use], "words": [len(rows) if b == 0 else 0 for b in use]}, schema
        )

    return run


def _answer(prune: int):
    schema = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("totals", pa.binary()), ("words", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        trim()
        keys, counts = (pa.chunked_array(t.column(c).chunks) for c in ("keys", "counts"))
        parts = [unkey(k.as_py()) for k in keys]
        _, back = np.unique(np.concatenate(parts), return_inverse=True)
        n = np.concatenate([unplanes(c.as_py(), np.uint32) for c in counts])
        totals = np.bincount(back, n)[back] if len(n) else np.zeros(0)
        totals = np.where(totals < prune, 0, totals).astype(np.uint64)
        cuts = np.cumsum([0] + [len(p) for p in parts])
        words = sum(t.column("words").to_pylist())
        return pa.table({"block": t.column("block"), "bucket": t.column("bucket"), "totals": [planes(totals[a:b]) for a, b in zip(cuts, cuts[1:])], "words": [words] * len(parts)}, schema)

    return run


def traverse(hashes: list[np.ndarray], totals: list[np.ndarray], words: int) -> np.ndarray:
    """Log probability of each word. totals: corpus counts of the kept n-grams that end at each word, by order (0: not kept)."""
    # the states before each word, from the empty history on, with their counts; and each state's arc for the word
    history = [np.full(len(hashes[0]), float(words))]
    for n in range(1, ORDER):
        before = np.zeros(len(hashes[0]))
        before[1:] = totals[n - 1][:-1]
        before[hashes[n] == 0] = 0  # the text starts later
        history.append(before)
    arc = [np.log((totals[0] + MU[0] / UNKNOWN) / (words + MU[0]))]
    for n in range(1, ORDER):
        arc.append(np.log((totals[n] + MU[n] * np.exp(_fall(arc, history, totals, n - 1))) / (history[n] + MU[n])))
    return _fall(arc, history, totals, ORDER - 1)


def _fall(arc: list[np.ndarray], history: list[np.ndarray], totals: list[np.ndarray], top: int) -> np.ndarray:
    """What the word costs from the longest state of up to `top` words: failure arcs, then the arc."""
    cost, done = np.zeros(len(arc[0])), np.zeros(len(arc[0]), bool)
    for n in range(top, -1, -1):
        state = (history[n] > 0) | (n == 0)
        take = ~done & state & ((totals[n] > 0) | (n == 0))
        cost[take] += arc[n][take]
        done |= take
        fail = ~done & state
        cost[fail] += np.log(MU[n] / (history[n][fail] + MU[n]))
    return cost


def _score():
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_probability", pa.float64()), ("perplexity", pa.float64())])

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        trim()
        docs = unpacked(docs)
        hashes, rows, size = read(docs.column("text").combine_chunks())
        order = np.argsort(answers.column("bucket").to_numpy())
        raw = answers.column("totals")
        total = np.concatenate([unplanes(raw[int(i)].as_py(), np.uint64) for i in order]).astype(float)
        words = answers.column("words")[int(order[0])].as_py()
        uniques = [np.unique(h, return_inverse=True) for h in hashes]
        key = np.sort(np.concatenate([u[u != 0] for u, _ in uniques]))
        totals = []
        for u, back in uniques:
            t = np.zeros(len(u))
            t[u != 0] = total[np.searchsorted(key, u[u != 0])]
            totals.append(t[back])
        logs = np.bincount(rows, traverse(hashes, totals, words), docs.num_rows) if len(rows) else np.zeros(docs.num_rows)
        none = size == 0
        return pa.table({"doc_id": docs.column("doc_id"), "n_words": size, "log_probability": pa.array(logs, mask=none), "perplexity": pa.array(np.exp(-logs / np.maximum(size, 1)), mask=none)}, schema)

    return run


def score(docs: DataFrame, block: int = BLOCK, prune: int = PRUNE) -> DataFrame:
    """doc_id, n_words, log_probability, perplexity (by word): a row for each row of docs."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(total // block) + 1
    buckets = min(2 * blocks, BUCKETS)
    parted = packed(docs, blocks)
    asked = parted.groupBy("block").applyInArrow(_ask(buckets), "bucket int, block int, keys binary, counts binary, words long")
    answered = asked.groupBy("bucket").applyInArrow(_answer(prune), "block int, bucket int, totals binary, words long")
    return parted.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(_score(), "doc_id long, n_words long, log_probability double, perplexity double")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
