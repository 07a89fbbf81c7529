"""Benchmark decontamination: CGK embeddings, bit-sampling LSH and exact edit verification.

A benchmark item leaks into a document when some run of the document's words is within an edit
distance (of words) of ``floor(rate * words of the item)`` of it. The Chakraborty-Goldenberg-Koucky random walk
turns a sequence of words into one of three times the length in such a way that a small edit distance
becomes a small Hamming distance; the walk's random bits are bits of a hash of the step and the word.
Each of several repetitions walks by bits of its own and samples a few places of the embedding;
a window of the document and an item with the same samples are candidates. The number of repetitions
follows from the target recall for places that agree with probability `agree`. Candidates are verified
by an exact approximate-matching automaton (bit-parallel, words as symbols).

Windows have the item's number of words. One can only match if an unedited piece of the item is in
it: k edits leave a piece of floor(n / (k + 1)) words intact. Windows without any such piece, which is nearly all of a
corpus, are skipped; nothing that could match is lost by that. All others are embedded, at every
offset that k edits allow.

The benchmark is broadcast in blocks of at most ``block_words`` words, each with a map-only pass over the documents;
a usual benchmark is one block. There is no shuffle of documents.

Defined results: null, empty and wordless texts match nothing; null or wordless items are ignored;
an item of up to 1 / rate words must occur unedited. Equal items each report their match. A row with a null doc_id is searched as
any other. Of several occurrences of an item in a text the one with the smallest distance, then the first, is reported;
repeated rows report each.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .cluster import table

RATE, RECALL, AGREE, SAMPLES, BLOCK_WORDS = 0.15, 0.99, 0.45, 3, 2_000_000
_PAD = np.uint64(0xFACEFEED)


def repetitions(recall: float = RECALL, agree: float = AGREE, samples: int = SAMPLES) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - agree**samples))


@cache
def places(n: int, reps: int, samples: int) -> list[list[int]]:
    """The sampled places of each repetition: of the first two thirds, of which hardly any is padding."""
    return [np.random.default_rng((r, n)).choice(2 * n, min(samples, 2 * n), replace=False).tolist() for r in range(reps)]


def walk(windows: np.ndarray, reps: int, steps: int) -> Iterator[np.ndarray]:
    """The first `steps` places of the embeddings of rows of symbols, place by place: reps by rows. The walk moves on when bit j (modulo 64) of the hash of its symbol is set."""
    m, n = windows.shape
    padded = np.concatenate([windows, np.full((m, 1), _PAD)], axis=1)
    bits = kernel.mix(padded[None] ^ kernel.mix(np.arange(1, reps + 1, dtype=np.uint64))[:, None, None])
    bits[:, :, n] = 0
    at, base = np.zeros((reps, m), np.int64), np.arange(m) * (n + 1)
    base_bits = np.arange(reps)[:, None] * (m * (n + 1)) + base
    symbols, flat = padded.ravel(), bits.ravel()
    for j in range(steps):
        if j and j % 64 == 0:
            flat = kernel.mix(flat)
            flat.reshape(bits.shape)[:, :, n] = 0
        yield symbols[at + base]
        at += ((flat[at + base_bits] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64)


def sampled(windows: np.ndarray, reps: int, samples: int) -> np.ndarray:
    """Rows by reps: the key of the sampled places in each repetition."""
    n = windows.shape[1]
    where: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for r, ps in enumerate(places(n, reps, samples)):
        for slot, p in enumerate(ps):
            where[p].append((r, slot))
    got = np.zeros((samples, reps, len(windows)), np.uint64)
    for j, symbols in enumerate(walk(windows, reps, max(where) + 1)):
        for r, slot in where.get(j, ()):
            got[slot, r] = symbols[r]
    keys = np.broadcast_to(np.arange(reps, dtype=np.uint64)[:, None], got.shape[1:])
    for one in got:
        keys = kernel.mix(keys * np.uint64(0xD6E8FEB86659FD93) + one)
    return keys.T


def best_match(item: list[int], text: list[int]) -> tuple[int, int]:
    """Smallest edit distance of item to any run of text, and the first place after such a run's last word (Myers' bit-parallel search)."""
    m = len(item)
    peq: dict[int, int] = defaultdict(int)
    for i, x in enumerate(item):
        peq[x] |= 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = mask, 0, m, m, 0
    for j, x in enumerate(text):
        eq = peq.get(x, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & mask), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & mask, (mh << 1) & mask
        pv, mv = mh | (~(xv | ph) & mask), ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Index:
    """Items of one block: pieces that survive the allowed edits, sampled keys, words."""

    def __init__(self, items: list[tuple[int, str]], rate: float, recall: float, agree: float, samples: int):
        self.reps, self.samples = repetitions(recall, agree, samples), samples
        cp, at = kernel.code_points(pa.array([t for _, t in items], pa.large_string()))
        w = kernel.words(cp, at)
        self.items = [(i, w.hash[a:b]) for (i, _), a, b in zip(items, w.first, w.first[1:]) if b > a]
        self.edits = [int(rate * len(x)) for _, x in self.items]
        pieces: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        by_size: dict[int, list[int]] = defaultdict(list)
        for k, (_, x) in enumerate(self.items):
            by_size[len(x)].append(k)
            q = len(x) // (self.edits[k] + 1)
            for o, h in enumerate(ngrams(x, q).tolist()):
                pieces[q][h].append((k, o))
        self.pieces = {q: (np.array(sorted(p), np.uint64), dict(p)) for q, p in pieces.items()}
        self.keys: dict[int, list[dict[int, list[int]]]] = {}
        for n, ks in by_size.items():
            tables: list[dict[int, list[int]]] = [defaultdict(list) for _ in range(self.reps)]
            for k, row in zip(ks, sampled(np.stack([self.items[k][1] for k in ks]), self.reps, samples).tolist()):
                for r, h in enumerate(row):
                    tables[r][h].append(k)
            self.keys[n] = [dict(t) for t in tables]

    def search(self, cp: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item number, distance, start, end in code points of the chunk) of all matches, the best for each row and item."""
        w = kernel.words(cp, at)
        starts: dict[int, set[int]] = defaultdict(set)  # first word of each window worth embedding, by size
        for q, (known, where) in self.pieces.items():
            h, first = w.ngrams(q)
            hit = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
            for p, x in zip(first[hit].tolist(), h[hit].tolist()):
                row = w.row[p]
                for k, o in where[x]:
                    n, e = len(self.items[k][1]), self.edits[k]
                    lo, hi = int(w.first[row]), int(w.first[row + 1])
                    starts[n].update(min(max(lo, s), max(lo, hi - n)) for s in range(p - o - e, p - o + e + 1))
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        for n, s in starts.items():
            s = np.array(sorted(s))
            for lo in range(0, len(s), 512):
                self._embed(w, n, s[lo : lo + 512], found)
        at_word = np.concatenate([w.start, [0]]), w.end
        return [(row, k, d, int(at_word[0][a]), int(at_word[1][b - 1])) for (row, k), (d, a, b) in sorted(found.items())]

    def _embed(self, w: kernel.Words, n: int, s: np.ndarray, found: dict) -> None:
        row = w.row[s]
        end = w.first[row + 1]
        at = s[:, None] + np.arange(n)
        windows = np.where(at < end[:, None], w.hash[np.minimum(at, len(w.hash) - 1)], _PAD)
        pairs = {(i, k) for r, column in enumerate(sampled(windows, self.reps, self.samples).T.tolist()) for i, h in enumerate(column) for k in self.keys[n][r].get(h, ())}
        regions: dict[tuple[int, int], set[int]] = defaultdict(set)
        for i, k in pairs:
            regions[int(row[i]), k].add(int(s[i]))
        for (r, k), firsts in regions.items():
            e, item = self.edits[k], self.items[k][1].tolist()
            a = None
            for b in sorted(firsts) + [None]:  # neighbouring windows are verified in one go
                if a is not None and (b is None or b > last + n):
                    self._verify(w, r, k, item, e, max(a - e, int(w.first[r])), min(last + n + e, int(w.first[r + 1])), found)
                    a = None
                if b is not None:
                    a, last = (b if a is None else a), b

    def _verify(self, w: kernel.Words, r: int, k: int, item: list[int], e: int, lo: int, hi: int, found: dict) -> None:
        text = w.hash[lo:hi].tolist()
        d, end = best_match(item, text)
        if d > e:
            return
        back, size = best_match(item[::-1], text[:end][::-1][: len(item) + e])
        match = (d, lo + end - size, lo + end)
        assert back <= e
        if (r, k) not in found or match < found[r, k]:
            found[r, k] = match


def ngrams(x: np.ndarray, n: int) -> np.ndarray:
    return kernel.Words(x, x, x, np.zeros(len(x), np.int64), x).ngrams(n)[0]


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, str]]]:
    """The items, partition by partition, in blocks of a checked size."""
    block, n = [], 0
    for i, t in benchmark.filter("text is not null").select(F.col("item_id").cast("long"), "text").toLocalIterator():
        size = t.count(" ") + 1
        if block and n + size > block_words:
            yield block
            block, n = [], 0
        block.append((i, t))
        n += size
    yield block


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, recall: float = RECALL, agree: float = AGREE, samples: int = SAMPLES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, distance (in words), span_start, span_end (in characters, end exclusive)."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("span_start", pa.int64()), ("span_end", pa.int64())])
    slim = docs.filter("text is not null").select(F.col("doc_id").cast("long"), "text")

    def one(items: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(items, rate, recall, agree, samples)
            for b in batches:
                ids = b.column(0)
                for lo, _, cp, at in kernel.chunks(b.column(1)):
                    if got := index.search(cp, at):
                        yield kernel.out({
                            "doc_id": ids.take(pa.array([g[0] + lo for g in got])), "item_id": [index.items[g[1]][0] for g in got], "distance": [g[2] for g in got],
                            "span_start": [g[3] - int(at[g[0]]) for g in got], "span_end": [g[4] - int(at[g[0]]) for g in got],
                        }, schema)

        return slim.mapInArrow(run, "doc_id long, item_id long, distance int, span_start long, span_end long")

    result = None
    for block in blocks(benchmark, block_words):
        result = one(block) if result is None else result.unionByName(one(block))
    return result


def keep(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, recall: float = RECALL, agree: float = AGREE, samples: int = SAMPLES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs without any leaked item, with all their columns."""
    col = docs.columns.index("text")

    def one(kept: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(items, rate, recall, agree, samples)
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                for lo, _, cp, at in kernel.chunks(b.column(col)):
                    clean[[g[0] + lo for g in index.search(cp, at)]] = False
                yield b.filter(pa.array(clean))

        return kept.mapInArrow(run, docs.schema)

    for block in blocks(benchmark, block_words):
        docs = one(docs, block)
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
