"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is
the sum over all ways to segment it into pieces, found by a forward pass; a text's is the product over
its words, which pieces never cross. The language that gives a text the highest probability is named.

Piece probabilities are trained by expectation-maximisation (forward-backward over the same lattice) on
a sample of the documents with a language label, about ``sample`` of them for each label, taken by a hash of
doc_id and smoothed towards the pieces of all languages; this bound is the only one. Every document is scored, whole.
A word is evaluated once as long as a worker remembers it. Words of any length are summed over whole; those of more than ``LONGEST``
characters one by one, with the sums scaled at each character. Training leaves words of more than ``LONGEST`` characters out.
Scoring is map-only; the model (pieces by languages) is fixed in size. The vocabulary is a file that every executor has.

Defined results: a null or empty text, or one without words, has a null language and margin; so has
every text when no row has a label. Ties go to the first language in alphabetical order. A null doc_id or label is carried as null;
such a row is scored but a null label isn't a language. Repeated rows are scored alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .cluster import table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLE, ROUNDS, LONGEST, SMOOTH, REMEMBERED = 1000, 4, 64, 0.05, 400_000
_MARK = 0x2581  # begins a word in the vocabulary


@cache
def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted hashes of the pieces, in lower case, the number of each (0 is for a character that is no piece), and the length of the longest."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    known = {p for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) and (p := sp.id_to_piece(i).lower())}
    pieces = sorted(p for p in known if p.lstrip("▁") or p == "▁")
    cp, at = kernel.code_points(pa.array(pieces, pa.large_string()))
    h = kernel.span_hash(kernel.tables()[2][cp], at[:-1], at[1:])
    order = np.argsort(h)
    return h[order], order.astype(np.int32) + 1, max(map(len, pieces))


def piece_numbers(h: np.ndarray, m: int, path: str) -> np.ndarray:
    """Of spans of m characters, by hash: the number of the piece, -1 where there is none."""
    known, number, _ = vocabulary(path)
    i = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[i] == h, number[i], 0 if m == 1 else -1)


class Lattice:
    """Pieces of many words: number of the piece that ends at e and has m characters, or -1. Words are sorted by length, longest first."""

    def __init__(self, cp: np.ndarray, start: np.ndarray, end: np.ndarray, path: str):
        most = vocabulary(path)[2]
        self.size = end - start + 1  # with the mark
        self.order = np.argsort(-self.size, kind="stable")
        self.size, start = self.size[self.order], start[self.order]
        longest = int(self.size[0]) if len(self.size) else 0
        n = len(start)
        self.fit = np.array([int(np.searchsorted(-self.size, -e, "right")) for e in range(longest + 1)])  # words of at least e characters
        chars = np.full((n, longest), _MARK, np.int64)
        for j in range(1, longest):
            chars[: self.fit[j + 1], j] = cp[start[: self.fit[j + 1]] + j - 1]
        value = kernel.tables()[2][chars]
        up, down = kernel.powers(longest + 1)
        total = np.zeros((n, longest + 1), np.uint64)
        np.cumsum(value * up[:longest], axis=1, out=total[:, 1:])
        self.at: dict[tuple[int, int], np.ndarray] = {}
        for e in range(1, longest + 1):
            k = self.fit[e]
            for m in range(1, min(e, most) + 1):
                h = kernel.mix((total[:k, e] - total[:k, e - m]) * down[e - m] + np.uint64(m))
                p = piece_numbers(h, m, path)
                if m == 1 or (p >= 0).any():
                    self.at[e, m] = p

    def forward(self, theta: np.ndarray) -> np.ndarray:
        """alpha[e, word, language]; theta has a last row of zeros for what is no piece."""
        alpha = np.zeros((len(self.fit), len(self.size), theta.shape[1]))
        alpha[0] = 1
        for (e, m), p in self.at.items():
            alpha[e, : len(p)] += alpha[e - m, : len(p)] * theta[p]
        return alpha

    def expected(self, theta: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, words weighted (word by language)."""
        alpha = self.forward(theta)
        beta = np.zeros_like(alpha)
        words = np.arange(len(self.size))
        z = alpha[self.size, words]
        beta[self.size, words] = weight[self.order] / z
        got = np.zeros_like(theta)
        for (e, m), p in reversed(self.at.items()):
            x = beta[e, : len(p)] * theta[p]
            for k in range(theta.shape[1]):
                got[:, k] += np.bincount(p + (p < 0) * len(theta), (alpha[e - m, : len(p)] * x)[:, k], len(theta))
            beta[e - m, : len(p)] += x
        return got

    def log_probability(self, theta: np.ndarray) -> np.ndarray:
        """word by language, in the order the words were given in."""
        z = self.forward(theta)[self.size, np.arange(len(self.size))]
        out = np.empty_like(z)
        out[self.order] = np.log(z)
        return out


def long_word(cp: np.ndarray, theta: np.ndarray, path: str) -> np.ndarray:
    """Log probability of one word by language; memory for the last characters only, sums scaled as they go."""
    chars = np.r_[np.int64(_MARK), cp.astype(np.int64)]
    n, most = len(chars), vocabulary(path)[2]
    value = kernel.tables()[2][chars]
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    for m in range(1, min(n, most) + 1):
        at = np.arange(n - m + 1)
        p = piece_numbers(kernel.span_hash(value, at, at + m), m, path)
        ok = p >= 0
        ends.append((at[ok] + m, p[ok]))
    end, size, piece = np.concatenate([e for e, _ in ends]), np.repeat(np.arange(1, len(ends) + 1), [len(e) for e, _ in ends]), np.concatenate([p for _, p in ends])
    order = np.argsort(end, kind="stable")
    size, weight, cut = size[order], theta[piece[order]], np.searchsorted(end[order], np.arange(1, n + 2))
    window, log = np.zeros((most, theta.shape[1])), np.zeros(theta.shape[1])  # window[(e - 1) % most]: sums up to e - 1
    window[0] = 1
    for e in range(1, n + 1):
        a, b = cut[e - 1], cut[e]
        now = (window[(e - size[a:b]) % most] * weight[a:b]).sum(axis=0)
        log += np.log(now)
        window /= now
        window[e % most] = 1
    return log


class Model:
    def __init__(self, languages: list[str], theta: np.ndarray, path: str):
        self.languages, self.theta, self.path, self.known = languages, theta, path, {}

    def words(self, cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log probability of words by language."""
        out, size = np.empty((len(start), len(self.languages))), end - start
        short = np.flatnonzero(size <= LONGEST)
        for k in range(0, len(short), 8192):
            some = short[k : k + 8192]
            out[some] = Lattice(cp, start[some], end[some], self.path).log_probability(self.theta)
        for i in np.flatnonzero(size > LONGEST):
            out[i] = long_word(cp[start[i] : end[i]], self.theta, self.path)
        return out

    def __call__(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of words, and log probability by language, of each text."""
        n, logs = np.zeros(len(col), np.int64), np.zeros((len(col), len(self.languages)))
        for lo, hi, cp, at in kernel.chunks(col, 4 * kernel.CHUNK):
            w = kernel.words(cp, at)
            if not len(w.start):
                continue
            h, first, back = np.unique(kernel.span_hash(kernel.tables()[2][cp], w.start, w.end), return_index=True, return_inverse=True)
            if len(self.known) > REMEMBERED:
                self.known = {}
            got = list(map(self.known.get, h.tolist()))
            new = np.array([i for i, x in enumerate(got) if x is None], np.int64)
            if len(new):
                for i, x in zip(new.tolist(), self.words(cp, w.start[first[new]], w.end[first[new]]).tolist()):
                    got[i] = self.known[int(h[i])] = x
            each = np.array(got)
            n[lo:hi] = np.bincount(w.row, minlength=hi - lo)
            for j in range(logs.shape[1]):
                logs[lo:hi, j] = np.bincount(w.row, each[back, j], hi - lo)
        return n, logs


def train(counts: dict[str, dict[str, int]], path: str = VOCABULARY, rounds: int = ROUNDS, smooth: float = SMOOTH) -> Model:
    """counts: language -> word -> number."""
    languages, n = sorted(counts), len(vocabulary(path)[0]) + 1
    words = sorted({w for c in counts.values() for w in c if w})
    weight = np.array([[counts[x].get(w, 0) for x in languages] for w in words], float).reshape(len(words), len(languages))
    cp, at = kernel.code_points(pa.array(words, pa.large_string()))
    lattices = [(Lattice(cp, at[k : k + 8192][: len(words[k : k + 8192])], at[k + 1 : k + 8193], path), weight[k : k + 8192]) for k in range(0, len(words), 8192)]
    theta = np.full((n + 1, len(languages)), 1 / n)
    theta[n] = 0
    for _ in range(rounds):
        got = sum((x.expected(theta, w) for x, w in lattices), np.zeros_like(theta))
        got[n] = 0
        pooled = got.sum(axis=1) + 0.1
        pooled[n] = 0
        pooled /= pooled.sum()
        own = got / np.maximum(got.sum(axis=0), 1e-9)
        theta = (1 - smooth) * own + smooth * pooled[:, None]
    return Model(languages, theta, path)


def word_counts(docs: DataFrame, sample: int = SAMPLE) -> dict[str, dict[str, int]]:
    """Words of about `sample` documents of each label."""
    labelled = docs.filter("lang is not null and text is not null and doc_id is not null").select(F.col("lang").alias("lang"), "doc_id", "text")
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return {}
    share = F.create_map(*(F.lit(x) for k, n in sorted(sizes.items()) for x in (k, int(min(1.0, sample / n) * 1_000_000))))
    some = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")]).select("lang", "text")
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, found = b.column(0).to_pylist(), Counter()
            for lo, _, cp, at in kernel.chunks(b.column(1)):
                w = kernel.words(cp, at)
                text = kernel.tables()[1][cp].tobytes().decode("utf-32-le")
                found.update((langs[lo + r], text[s:e]) for s, e, r in zip(w.start.tolist(), w.end.tolist(), w.row.tolist()) if e - s <= LONGEST)
            if found:
                yield kernel.out({"lang": [k[0] for k in found], "word": [k[1] for k in found], "n": list(found.values())}, schema)

    counts: dict[str, dict[str, int]] = {k: {} for k in sizes}
    for k, w, n in some.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n")).toLocalIterator():
        counts[k][w] = n
    return counts


def fit(docs: DataFrame, sample: int = SAMPLE, path: str = VOCABULARY) -> Model:
    return train(word_counts(docs, sample), path)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, label (the row's own lang), language, margin (mean log odds a word against the next best language), n_words: a row for each row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.string()), ("language", pa.string()), ("margin", pa.float64()), ("n_words", pa.int64())])
    names = np.array(model.languages, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, logs = model(b.column(2)) if len(names) else (np.zeros(b.num_rows, np.int64), np.zeros((b.num_rows, 1)))
            best = logs.argmax(axis=1)
            top = np.sort(logs, axis=1)
            margin = (top[:, -1] - top[:, -2]) / np.maximum(n, 1) if logs.shape[1] > 1 else np.zeros(len(n))
            yield kernel.out({
                "doc_id": b.column(0), "label": b.column(1), "language": pa.array(names[best] if len(names) else [None] * len(n), pa.string(), mask=n == 0), "margin": pa.array(margin, mask=n == 0), "n_words": n,
            }, schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text").mapInArrow(run, "doc_id long, label string, language string, margin double, n_words long")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
