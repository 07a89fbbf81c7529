"""Secret scan by a recursive decoding worklist.

A text is the first layer. Every layer is scanned by all rules, and searched for encoded parts: percent
escapes, Unicode escapes (backslash u, x or U), base64 (both alphabets, also wrapped to lines) and, in decoded bytes, gzip, zlib, bzip2, xz and zstandard. Each part that
decodes is a new layer, put on the worklist; compressed bytes are decompressed as far as it
goes, all their members and what follows them. Bytes that aren't UTF-8 are read as Latin-1. A text seen before on the way to the same part is not queued again, so cycles end and the worklist
runs to its fixpoint. Each layer keeps, by character, the span of the first layer that it comes
from, so a finding anywhere is reported at its place in the document. A secret found in several layers at one place is
reported once, in the shallowest.

A decompressed part of more than ``LARGEST`` bytes isn't unwrapped: it is reported itself, as
"oversize layer", so nothing is passed over in silence.

Rows without anything a rule or decoder could start from are put aside before Python sees their text; the test is
the union of the patterns' own beginnings, so it loses nothing. Map-only.

Defined results: null and empty texts have no findings. A null doc_id is carried. Repeated rows report their findings each.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import lzma
import re
import urllib.parse
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .cluster import table

LARGEST, SHORTEST = 64 << 20, 15  # base64 of fewer characters holds fewer bytes than any finding has
OVERSIZE = "oversize layer"
RULES = (
    ("aws access key", re.compile(r"(?<![A-Z0-9])(?:AKIA|ASIA|AGPA|AROA|AIDA)[A-Z2-7][A-Z0-9]{15}(?![A-Z0-9])")),
    ("github token", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,255}|github_pat_[A-Za-z0-9_]{22,}")),
    ("slack token", re.compile(r"xox[abeoprs]-[A-Za-z0-9-]{10,}")),
    ("google api key", re.compile(r"AIza[A-Za-z0-9_-]{35}")),
    ("stripe key", re.compile(r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}")),
    ("private key", re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")),
    ("json web token", re.compile(r"(?<![A-Za-z0-9_-])(?:(?!eyJ)[A-Za-z0-9_-])*+(eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)")),
    ("password in url", re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:([^\s:/@]{3,64})@")),
    ("assigned secret", re.compile(r"(?i:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth[_-]?key|credential)[\"']?\s{0,4}(?:=>|:=|=|:)\s{0,4}[\"']?([^\s\"'<>,;]{8,})")),
)
_PREFILTER = (
    r"A(?:KIA|SIA|GPA|ROA|IDA)|AIza|gh[pousr]_|github_pat_|xox[abeoprs]-|[rs]k_(?:live|test)_|PRIVATE KEY|eyJ|://"
    r"|(?i:token|secret|passw|pwd|api[_-]?key|access[_-]?key|auth[_-]?key|credential)[\"']?[\s\v\x1c-\x1f\x85\p{Z}]{0,4}[=:]"  # RE2, of which \s is ASCII only
    r"|%[0-9A-Fa-f]{2}|\\[uUx]|[A-Za-z0-9+/_-]{15}"
)
_RUN = re.compile(r"[^\s\"'<>]+")
_PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
_ESCAPED = re.compile(r"\\(?:u[0-9A-Fa-f]{4}|u\{[0-9A-Fa-f]{1,6}\}|U[0-9A-Fa-f]{8}|x[0-9A-Fa-f]{2})")
_ONE_ESCAPE = re.compile(r"\\(?:u\{([0-9A-Fa-f]{1,6})\}|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))")
#: A run of either alphabet may border on a character of the other one, so each is tried, and both together.
_BASE64 = tuple(re.compile(rf"[{a}]{{{SHORTEST},}}={{0,2}}") for a in ("A-Za-z0-9+/", "A-Za-z0-9_-", "A-Za-z0-9+/_-"))
#: The same over several lines, indented or quoted or not; the first is as long as a run.
_LINES = tuple((re.compile(rf"(?<![{a}])[{a}]{{{SHORTEST},}}+(?:[ \t]*+\r?\n[ \t>]*+[{a}]++)++={{0,2}}"), re.compile(rf"[{a}]+={{0,2}}")) for a in ("A-Za-z0-9+/", "A-Za-z0-9_-", "A-Za-z0-9+/_-"))
_MAGIC = ((b"\x1f\x8b", "gzip"), (b"BZh", "bzip2"), (b"\xfd7zXZ\x00", "xz"), (b"\x28\xb5\x2f\xfd", "zstd"))


def _text(raw: bytes) -> str:
    """raw as UTF-8, or else as Latin-1."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _method(raw: bytes) -> str | None:
    """The compression that raw begins like."""
    if raw[:1] == b"\x78" and len(raw) > 1 and (raw[0] << 8 | raw[1]) % 31 == 0:
        return "zlib"
    return next((name for magic, name in _MAGIC if raw.startswith(magic)), None)


def _member(method: str, raw: bytes, most: int) -> tuple[bytes, bytes]:
    """The content of the first member of compressed bytes, up to about `most`, and what follows the member."""
    if method in ("gzip", "zlib"):
        d = zlib.decompressobj(31 if method == "gzip" else 15)
        return d.decompress(raw, most), d.unused_data
    if method == "zstd":
        d, parts, size, at = zstandard.ZstdDecompressor().decompressobj(), [], 0, 0
        while at < len(raw) and not d.eof and size <= most:  # in small steps, as it has no bound of its own
            parts.append(d.decompress(raw[at : at + 256]))
            size, at = size + len(parts[-1]), at + 256
        return b"".join(parts)[:most], d.unused_data + raw[at:]
    d = bz2.BZ2Decompressor() if method == "bzip2" else lzma.LZMADecompressor()
    return d.decompress(raw, most), d.unused_data


def _inflate(raw: bytes) -> tuple[str, bytes, bytes] | None:
    """Method and content of compressed bytes, of all their members, and what follows them; None if they aren't. Content of more than LARGEST bytes is cut just beyond."""
    if (method := _method(raw)) is None:
        return None
    parts, size = [], 0
    while size <= LARGEST and _method(raw) == method:
        try:
            content, raw = _member(method, raw, LARGEST + 1 - size)
        except Exception as e:  # noqa: BLE001 - each library has errors of its own for bytes that only look compressed
            if isinstance(e, MemoryError):
                raise
            if not parts:
                return None
            break
        parts.append(content)
        size += len(content)
    return method, b"".join(parts), raw


def unwrap(raw: bytes) -> list[tuple[str, str | None]]:
    """Methods of the compression around raw (each with '>' before it), and the text inside, None if it is oversize; and so for what follows compressed bytes."""
    out, work, seen = [], [("", raw)], set()
    while work:
        path, raw = work.pop()
        if raw in seen:
            continue
        seen.add(raw)
        if len(raw) > LARGEST and path:
            out.append((path, None))
        elif (inner := _inflate(raw)) is None:
            out.append((path, _text(raw)))
        else:
            work += [(path, inner[2]), (f"{path}>{inner[0]}", inner[1])]
    return [(path, s) for path, s in out if s != ""]


class Layer:
    """A text, how it was made, and the span of the first layer for each of its characters."""

    def __init__(self, text: str, path: tuple[str, ...], start: np.ndarray | None, end: np.ndarray | None, seen: frozenset[str]):
        self.text, self.path, self.start, self.end, self.seen = text, path, start, end, seen | {text}

    def span(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (int(self.start[a:b].min()), int(self.end[a:b].max()))

    def inner(self, text: str, method: str, a: int, b: int, from_: list[tuple[int, int]] | None = None) -> Layer | None:
        """The layer that a part decodes to; from_: the part's own span for each character, else all of it for all."""
        if not text or text in self.seen:
            return None
        if from_ is None:
            s, e = self.span(a, b)
            start, end = np.broadcast_to(s, len(text)), np.broadcast_to(e, len(text))
        else:
            spans = [self.span(x, y) for x, y in from_]
            start, end = np.array([s for s, _ in spans]), np.array([e for _, e in spans])
        return Layer(text, (*self.path, *method.strip(">").split(">")), start, end, self.seen)


def _percent(part: str, a: int) -> Iterator[tuple[str, str | None, list[tuple[int, int]] | None]]:
    raw = urllib.parse.unquote_to_bytes(part)
    if _method(raw):
        yield from (("percent" + path, s, None) for path, s in unwrap(raw) if path)
    text, from_, i = [], [], 0
    for m in re.finditer(r"(?:%[0-9A-Fa-f]{2})+", part):
        for k in range(i, m.start()):
            text.append(part[k])
            from_.append((a + k, a + k + 1))
        k = m.start()
        for c in urllib.parse.unquote_to_bytes(m[0]).decode("utf-8", "surrogateescape"):
            odd = 0xDC80 <= ord(c) < 0xDD00  # a byte that is no UTF-8
            n = 3 if odd else 3 * len(c.encode())
            text.append(chr(ord(c) - 0xDC00) if odd else c)
            from_.append((a + k, a + k + n))
            k += n
        i = m.end()
    text.append(part[i:])
    from_ += [(a + k, a + k + 1) for k in range(i, len(part))]
    yield "percent", "".join(text), from_


def _escapes(part: str, a: int) -> Iterator[tuple[str, str | None, list[tuple[int, int]] | None]]:
    text, from_, i, before = [], [], 0, 0
    for m in _ONE_ESCAPE.finditer(part):
        text += part[i : m.start()]
        from_ += [(a + k, a + k + 1) for k in range(i, m.start())]
        code = int(next(g for g in m.groups() if g), 16)
        if 0xDC00 <= code < 0xE000 and m.start() == i and 0xD800 <= before < 0xDC00:  # the second half of a pair
            code = 0x10000 + ((before - 0xD800) << 10) + (code - 0xDC00)
            text.pop()
            start = from_.pop()[0]
        else:
            start = a + m.start()
        before = code
        text.append(chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd")
        from_.append((start, a + m.end()))
        i = m.end()
    text += part[i:]
    from_ += [(a + k, a + k + 1) for k in range(i, len(part))]
    yield "unicode", "".join(text), from_


def _base64(part: str, a: int) -> Iterator[tuple[str, str | None, list[tuple[int, int]] | None]]:
    body = part.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:  # the last character belongs to what follows
        body = body[:-1]
    try:
        raw = base64.b64decode(body + "=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return
    yield from (("base64" + path, s, None) for path, s in unwrap(raw))


def _wrapped(lines: list[re.Match]) -> Iterator[tuple[int, int]]:
    """First and last of the adjacent lines of base64 that may be one part: all of them, and those of one length with the shorter line after them."""
    yield 0, len(lines) - 1
    i = 0
    while i < len(lines):
        k = i
        while k + 1 < len(lines) and len(lines[k + 1][0]) == len(lines[i][0]):
            k += 1
        last = k + 1 if k + 1 < len(lines) and len(lines[k + 1][0].rstrip("=")) < len(lines[i][0]) else k
        if last > i and (i, last) != (0, len(lines) - 1):
            yield i, last
        i = k + 1


def parts(text: str) -> Iterator[tuple[int, int, str, str | None, list[tuple[int, int]] | None]]:
    """(start, end, method, text inside, its characters' spans) of all encoded parts of a layer, in time linear in its length."""
    for mark, escape, decode in (("%", _PERCENT, _percent), ("\\", _ESCAPED, _escapes)):
        if escape.search(text):
            for m in _RUN.finditer(text):
                if mark in m[0] and escape.search(m[0]):
                    yield from ((*m.span(), *got) for got in decode(m[0], m.start()))
    for pattern in _BASE64:
        for m in pattern.finditer(text):
            yield from ((*m.span(), *got) for got in _base64(m[0], m.start()))
    for block, line in _LINES:
        for m in block.finditer(text):
            lines = list(line.finditer(text, *m.span()))
            for i, k in _wrapped(lines):
                a, b = lines[i].start(), lines[k].end()
                yield from ((a, b, *got) for got in _base64("".join(x[0] for x in lines[i : k + 1]), a))


def scan(text: str) -> list[tuple[str, str, int, int, int, str]]:
    """(rule, path, depth, start, end, secret) of all findings, by place."""
    found: dict[tuple[str, int, int, str], tuple[int, str]] = {}
    work, queued = deque([Layer(text, (), None, None, frozenset())]), set()
    while work:
        layer = work.popleft()
        for rule, pattern in RULES:
            for m in pattern.finditer(layer.text):
                k = pattern.groups
                s, e = layer.span(m.start(k), m.end(k))
                found.setdefault((rule, s, e, m[k]), (len(layer.path), ">".join(layer.path)))
        for a, b, method, inside, from_ in parts(layer.text):
            s, e = layer.span(a, b)
            if inside is None:
                found.setdefault((OVERSIZE, s, e, ""), (len(layer.path) + 1, ">".join((*layer.path, *method.split(">")))))
            elif (inside, s, e) not in queued and (new := layer.inner(inside, method, a, b, from_)):
                queued.add((inside, s, e))
                work.append(new)
    near: dict[tuple[str, str], int] = {}
    for rule, s, e, secret in sorted(found, key=lambda f: (-f[1], f[2])):  # of decodings of one part within the other, the narrower
        if found[rule, s, e, secret][0]:
            if near.get((rule, secret), len(text) + 1) <= e:
                del found[rule, s, e, secret]
            near[rule, secret] = min(e, near.get((rule, secret), e))
    return sorted((rule, path, depth, s, e, secret) for (rule, s, e, secret), (depth, path) in found.items())


def findings(docs: DataFrame) -> DataFrame:
    """doc_id, rule, path (decodings, outermost first; empty for the text itself), depth, span_start, span_end (characters, end exclusive), secret."""
    schema = pa.schema([("doc_id", pa.int64()), ("rule", pa.string()), ("path", pa.string()), ("depth", pa.int32()), ("span_start", pa.int64()), ("span_end", pa.int64()), ("secret", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i in np.flatnonzero(pc.match_substring_regex(b.column(1), _PREFILTER).fill_null(False).to_numpy(zero_copy_only=False)):
                doc = b.column(0)[int(i)].as_py()
                rows += [(doc, *f) for f in scan(b.column(1)[int(i)].as_py())]
            if rows:
                yield kernel.out(dict(zip(schema.names, map(list, zip(*rows)))), schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, rule string, path string, depth int, span_start long, span_end long, secret string")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(table(spark, sf_dir, "documents"))
