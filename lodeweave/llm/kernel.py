"""Vectorised text kernel: words, pieces and n-gram hashes of a whole Arrow batch with NumPy, no per-row Python.

Texts arrive as an Arrow string column. They are cut into chunks of about ``CHUNK`` code points
(a longer document is a chunk of its own), turned into one code-point array, and every word of the
chunk is hashed with a prefix-sum polynomial over the ring of 64-bit integers. A null text is an
empty text. A word is a maximal run of letters, digits, marks and underscores, in lower case; an
ideograph, kana or Hangul character is a word by itself, as such scripts set no spaces.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 120_000
U = np.uint64
_BASE, _TOP = 0x9E3779B97F4A7C15, 0x110000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the splitmix64 finaliser)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: class (0 other, 1 word, 2 a word by itself, 3 white space), lower case, and a random 64-bit value of the lower case."""
    kind, lower = np.zeros(_TOP, np.uint8), np.arange(_TOP, dtype=np.uint32)
    for c in range(_TOP):
        if 0xD800 <= c < 0xE000 or 0x323B0 <= c < 0xE0000 or c >= 0xE0200:
            continue
        ch = chr(c)
        g = unicodedata.category(ch)
        if ch.isspace():
            kind[c] = 3
        elif g[0] in "LNM" or c == 95:
            kind[c] = 2 if 0x3040 <= c < 0x3100 or 0x3400 <= c < 0xA000 or 0xAC00 <= c < 0xD7A4 or 0x20000 <= c < 0x323B0 else 1
            if g == "Lu" and len(low := ch.lower()) == 1:
                lower[c] = ord(low)
    return kind, lower, mix(lower.astype(U) + U(0x1234567))


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 70_000)
        _powers[:] = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(size, b, U)
            x[0] = 1
            _powers.append(np.multiply.accumulate(x))
    return _powers[0][:n], _powers[1][:n]


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each span, by one pass over all values."""
    n = len(values)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum(values * up[:n], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U))


def code_points(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a string column, and where each text starts (one more entry than texts)."""
    col = (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).cast(pa.large_string()).fill_null("")
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1 + col.offset)[col.offset :] if len(col) else np.zeros(1, np.int64)
    raw = memoryview(col.buffers()[2])[off[0] : off[-1]] if len(col) and col.buffers()[2] is not None else memoryview(b"")
    try:
        cp = np.frombuffer(str(raw, "utf-8").encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:
        parts = [np.frombuffer(str(raw[a - off[0] : b - off[0]], "utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(off, off[1:])]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    if len(cp) == len(raw):
        return cp, off - off[0]
    lead = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, out=lead[1:])
    return cp, lead[off - off[0]]


def chunks(col: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, code points, starts) for runs of rows of about `size` bytes; only one run is decoded at a time."""
    off = np.zeros(len(col) + 1, np.int64)
    np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(), out=off[1:])
    row, n = 0, len(col)
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + size, "right")) - 1)
        cp, at = code_points(col.slice(row, end - row))
        yield row, end, cp, at
        row = end


@dataclass
class Words:
    """Words of a chunk: hash, span in the chunk, row in the chunk; first[i]:first[i + 1] are the words of row i."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of runs of n words within a row, and the index of each run's first word."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, U), np.zeros(0, np.int64)
        at = np.flatnonzero(self.row[:m] == self.row[n - 1 :]) if n > 1 else np.arange(m)
        h = self.hash[at]
        for k in range(1, n):
            h = mix(h * U(0xD6E8FEB86659FD93) + self.hash[at + k])
        return h, at


def words(cp: np.ndarray, at: np.ndarray, symbols: bool = False) -> Words:
    """The words of a chunk; with `symbols`, runs of what is neither word nor white space count too."""
    kind, _, value = tables()
    k = kind[cp]
    cut = np.zeros(len(cp) + 1, bool)
    cut[at] = True
    cut[1:-1] |= k[1:] != k[:-1]
    cut[:-1] |= k == 2
    edge = np.flatnonzero(cut)
    start, end = edge[:-1], edge[1:]
    kk = k[start] if len(start) else np.zeros(0, np.uint8)
    real = (kk == 1) | (kk == 2) | ((kk == 0) & symbols)
    start, end = start[real], end[real]
    row = np.searchsorted(at, start, "right") - 1
    h = span_hash(value[cp], start, end) if len(cp) else np.zeros(0, U)
    return Words(h, start, end, row, np.searchsorted(row, np.arange(len(at))))


def out(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, f.type) for f, v in ((f, columns[f.name]) for f in schema)], schema=schema)


def fixed(col: pa.Array, width: int) -> np.ndarray:
    """A binary column of which every value has `width` bytes, as rows of bytes."""
    if not len(col):
        return np.zeros((0, width), np.uint8)
    off = np.frombuffer(col.buffers()[1], np.int32 if col.type == pa.binary() else np.int64, len(col) + 1 + col.offset)[col.offset :]
    return np.frombuffer(memoryview(col.buffers()[2])[off[0] : off[-1]], np.uint8).reshape(len(col), width)


def binaries(rows: np.ndarray) -> pa.Array:
    """The reverse of fixed()."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])
