"""Personal data by weak supervision: regex, gazetteer and context labelers vote on candidate spans.

1. Candidates: anything that looks like an address with an at sign, an account number (in groups or not), or a run of digits and
   separators, blanks included, of seven characters or more. What a run holds of known formats are candidates of their own.
2. Labelers vote on each candidate for a kind (EMAIL, PHONE, IP, CARD, SSN, IBAN) or NONE, or abstain:
   strict formats, loose shape, checksums, a gazetteer (country calling codes, card issuers, top-level domains, special
   networks), words to the left of the span, and what the span is part of.
3. Expectation-maximisation (Dawid and Skene) estimates each labeler's reliability by kind from how
   the votes agree, over all candidates of the corpus: votes are counted by pattern, and the patterns are few.
4. A softmax classifier of the span's own features (no votes) is trained on the posterior kinds, again
   over all candidates by pattern. It decides.

Both passes over the corpus are map-only. What reaches the driver is one row per pattern of votes and features,
which are all small categories, so it doesn't grow with the corpus beyond their combinations.

Defined results: null and empty texts have no spans. A null doc_id is carried as null. Repeated rows
report their spans each. Spans don't overlap; of two candidates at one place the first format of the
list wins, then the longer. In `redact` every span becomes <KIND>, and n_chars, where that column is an integer
and not null, becomes the new length; a row without spans is unchanged, and other columns always are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .cluster import table

KINDS = ("NONE", "EMAIL", "PHONE", "IP", "CARD", "SSN", "IBAN")
NONE, EMAIL, PHONE, IP, CARD, SSN, IBAN = range(len(KINDS))
ABSTAIN = len(KINDS)
LABELERS = ("format", "shape", "checksum", "gazetteer", "context", "part")
PREFILTER = r"@|\p{Nd}[\p{Nd}().+/\p{Z}-]{5,}\p{Nd}|[A-Z]{2}\p{Nd}{2}[A-Z0-9]{11}|[A-Z]{2}\p{Nd}{2}\p{Z}[A-Z0-9]{4}\p{Z}"
_BLANK = " \u00a0\u2007\u2009\u202f"
_GROUPED_IBAN = rf"[A-Z]{{2}}\d{{2}}(?:[{_BLANK}][A-Z0-9]{{4}}){{2,7}}(?:[{_BLANK}][A-Z0-9]{{1,3}})?"
_AMEX = rf"3[47]\d{{2}}[{_BLANK}-]\d{{6}}[{_BLANK}-]\d{{5}}"
_INTERNATIONAL = rf"(?:\+|00)[1-9](?:[{_BLANK}.\-/()]{{0,3}}\d){{6,14}}"
_NATIONAL = rf"0[1-9](?:[{_BLANK}.\-/]\d{{2}}){{4}}|(?:\(0[1-9]\d{{0,4}}\)|0[1-9]\d{{0,4}})(?:[{_BLANK}]?[/-][{_BLANK}]?|[{_BLANK}])\d{{2,8}}(?:[{_BLANK}-]\d{{2,6}}){{0,3}}"
#: Formats with blanks, of which the general ones would take a part only.
_GROUPED = re.compile(rf"(?<![A-Za-z0-9]){_GROUPED_IBAN}(?![A-Za-z0-9])|(?<![\w+]){_AMEX}(?!\d)|(?<![\w+.,/(-])(?:{_INTERNATIONAL}|{_NATIONAL})(?![\w])")
_RUN = re.compile(rf"(?<![A-Za-z0-9])[+(]{{0,2}}\d[\d().+/{_BLANK}-]{{5,}}\d(?![A-Za-z])")
_CANDIDATE = re.compile(
    r"(?<![\w.%+'-])[\w.%+'-]++@[\w-]+(?:\.[\w-]+)*|(?<![A-Za-z0-9])[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])|\d{1,3}(?:\.\d{1,3}){3}(?![\d])"
    r"|\d{4}(?:[ -]\d{4}){3}(?!\d)|\d{3}-\d{2}-\d{4}(?!\d)|(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]\d{3,4}(?!\d)|(?<![A-Za-z0-9])(?:\+?\d[\d.\-/]{5,}\d|\d{7,})(?![A-Za-z])"
)
_FORMATS = (
    (EMAIL, re.compile(r"[\w.%+'-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")), (IP, re.compile(r"(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}")),
    (SSN, re.compile(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}")), (CARD, re.compile(r"\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}|3[47]\d{13}")),
    (PHONE, re.compile(r"\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[.-]\d{3}[.-]\d{4}")), (IBAN, re.compile(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}")),
    (IBAN, re.compile(_GROUPED_IBAN)), (CARD, re.compile(_AMEX)), (PHONE, re.compile(f"{_INTERNATIONAL}|{_NATIONAL}")),
)
_GENERAL = 6  # of the formats, those without blanks between groups of their own
_CONTEXT = tuple((k, re.compile(rf"(?i)\b(?:{w})\W*(?:\w+\W+){{0,2}}$")) for k, w in (
    (EMAIL, r"e-?mail|mail|contact|courriel|correo"), (PHONE, r"phone|tel|call|fax|mobile|cell|telefon|téléphone|teléfono"), (CARD, r"card|visa|mastercard|amex|credit|karte|carte|tarjeta"),
    (IP, r"ip|host|server|address|login from"), (SSN, r"ssn|social security"), (IBAN, r"iban|account|konto|compte|cuenta"), (NONE, r"version|isbn|issn|doi|page|fig|figure|chapter|section|sha|hash|id|order|price|release"),
))
#: The generic top-level domains in wide use and the country codes; of others the gazetteer says nothing.
_DOMAINS = frozenset(
    "com net org edu gov mil int info biz name pro aero coop museum jobs mobi travel cat tel asia post xxx app dev page blog shop store online site tech cloud xyz club live news email world company agency digital design media group center academy"
    " ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gd ge gf gg gh gi"
    " gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni"
    " nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw".split()
)
_CALLING = re.compile(r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})(?!\d{9,}$)")
_ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|35|36|30")


def _luhn(d: str) -> bool:
    return sum(int(c) if i % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for i, c in enumerate(reversed(d))) % 10 == 0


def _iban(value: str) -> bool:
    plain = re.sub(r"\s", "", value)
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def votes(value: str, left: str, right: str) -> tuple[int, ...]:
    digits = re.sub(r"\D", "", value)
    strict = next((k for k, p in _FORMATS if p.fullmatch(value)), ABSTAIN)
    if "@" in value:
        shape = EMAIL
    elif value.count(".") == 3 and len(digits) <= 12 and re.fullmatch(r"[\d.]+", value):
        shape = IP
    elif value[0].isalpha():
        shape = IBAN
    elif re.search(r"\s", value) and strict == ABSTAIN and not _CANDIDATE.fullmatch(value):
        shape = CARD if 13 <= len(digits) <= 19 and _luhn(digits) else NONE  # numbers side by side
    elif 13 <= len(digits) <= 19 and not re.search(r"[./()+]", value):
        shape = CARD
    elif 9 <= len(digits) <= 15 and re.search(rf"[()+]|\d[{_BLANK}./-]{{1,3}}\d", value):
        shape = SSN if re.fullmatch(r"\d{3}-\d{2}-\d{4}", value) else PHONE
    else:
        shape = NONE
    check = ABSTAIN
    if shape == CARD and _luhn(digits):
        check = CARD
    elif shape == IBAN:
        check = IBAN if _iban(value) else NONE
    elif shape == IP:
        check = IP if all(int(x or 999) < 256 for x in value.split(".")) else NONE
    gazetteer = ABSTAIN
    if shape == EMAIL:
        top = value.rpartition("@")[2].rpartition(".")
        gazetteer = EMAIL if top[1] and top[2].lower() in _DOMAINS else ABSTAIN if top[1] and len(top[2]) > 1 and top[2].isalpha() else NONE
    elif value[0] == "+":
        gazetteer = PHONE if _CALLING.match(value) else NONE
    elif shape == CARD:
        gazetteer = CARD if _ISSUERS.match(digits) else ABSTAIN
    elif shape == IP and re.match(r"0+\.|255\.", value):
        gazetteer = NONE
    context = next((k for k, p in _CONTEXT if p.search(left)), ABSTAIN)
    part = NONE if left[-1:].isalnum() or right[:1].isalnum() or left[-1:] in "._/-=#$€" and left or right[:1] in "/%_$€" and right else ABSTAIN
    return strict, shape, check, gazetteer, context, part


#: Features of the span, each a small category, and how many values each has.
SIZES = (2, 2, 13, 6, 5, 6, 4, 8, 3, 3)


def features(value: str, left: str, right: str) -> tuple[int, ...]:
    n = sum(map(str.isdigit, value))
    context = next((k for k, p in _CONTEXT if p.search(left)), ABSTAIN)
    edge = lambda c: 0 if not c or c.isspace() else 1 if c.isalnum() else 2
    return (
        int("@" in value), int(value[0].isalpha()), min(n, 24) // 2, min(value.count("."), 5), min(value.count("-"), 4), min(sum(map(str.isspace, value)), 5),
        3 if value[0] == "0" and re.search(r"[^\d.]", value) else (value[0] == "+") + ("(" in value), context, edge(left[-1:]), edge(right[:1]),
    )


def _places(text: str) -> list[tuple[int, int]]:
    """Spans of all candidates, in order: formats with blanks, in what is left the general ones, in what is left the other runs."""
    got: list[tuple[int, int]] = []
    for m in _GROUPED.finditer(text):
        a, b = m.span()
        if text[a].isalpha():
            ends = [a + k for k in range(len(m[0]), 14, -1) if not text[a + k : a + k + 1].isalnum()]
            b = next((e for e in ends if _iban(text[a:e])), b if 2 * sum(map(str.isdigit, m[0])) >= len(m[0]) else a)
        elif (one := _CANDIDATE.match(text, a)) and any(p.fullmatch(one[0]) for _, p in _FORMATS[:_GENERAL]):
            if not (one.end() < b and text[one.end()] == "." and text[one.end() + 1].isdigit()):
                continue
        if b > a:
            got.append((a, b))
    for pattern in (_CANDIDATE, _RUN):
        free = zip([0] + [b for _, b in got], [a for a, _ in got] + [len(text)])
        got = sorted(got + [m.span() for a, b in free if b - a > 2 for m in pattern.finditer(text, a, b)])
    return got


def candidates(text: str) -> Iterator[tuple[int, int, tuple[int, ...], tuple[int, ...]]]:
    for a, b in _places(text):
        left, right, value = text[max(0, a - 40) : a], text[b : b + 2], text[a:b]
        yield a, b, votes(value, left, right), features(value, left, right)


def _suspects(col: pa.Array) -> np.ndarray:
    """Rows that may have candidates, found without Python strings."""
    return np.flatnonzero(pc.match_substring_regex(col, PREFILTER).fill_null(False).to_numpy(zero_copy_only=False))


class Model:
    """Reliabilities by EM, and the classifier."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], tuple[int, ...], int]], rounds: int = 60):
        v = np.array([p[0] for p in patterns], int).reshape(-1, len(LABELERS))
        self.x = np.array([p[1] for p in patterns], int).reshape(-1, len(SIZES))
        n = np.array([p[2] for p in patterns], float)
        k = len(KINDS)
        q = np.full((len(n), k), 0.1)
        for column in v.T:  # starts from the votes; NONE counts less where something else is voted for too
            r = np.flatnonzero(column < k)
            q[r, column[r]] += np.where(column[r] == NONE, 0.6, 1.0)
        q = q**2 / (q**2).sum(axis=1, keepdims=True)
        for _ in range(rounds):
            prior = (n @ q + 1) / (n.sum() + k)
            logs = np.log(prior)[None].repeat(len(n), 0)
            self.reliability = []
            for column in v.T:
                c = np.full((k, k + 1), 0.05)
                c[np.arange(k), np.arange(k)] += 1.0  # a labeler is believed to be better than chance
                np.add.at(c.T, column, n[:, None] * q)
                c /= c.sum(axis=1, keepdims=True)
                self.reliability.append(c)
                logs += np.log(c[:, column]).T
            q = np.exp(logs - logs.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
        self.posterior = q
        self.weights = self._train(n, q)

    def _columns(self, x: np.ndarray) -> np.ndarray:
        return x + np.r_[0, np.cumsum(SIZES)[:-1]]

    def _train(self, n: np.ndarray, q: np.ndarray, steps: int = 400) -> np.ndarray:
        """Softmax regression on one-hot features by Adam, full batches, a pattern weighs as many spans as it has (damped)."""
        d, k = sum(SIZES) + 1, len(KINDS)
        a = np.zeros((len(n), d))
        a[:, -1] = 1
        np.put_along_axis(a, self._columns(self.x), 1, axis=1)
        weight = np.sqrt(n)[:, None] / max(1.0, np.sqrt(n).sum())
        w, m, s = np.zeros((d, k)), np.zeros((d, k)), np.zeros((d, k))
        for t in range(1, steps + 1):
            p = np.exp((z := a @ w) - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = a.T @ (weight * (p - q)) + 1e-5 * w
            m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
            w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
        return w

    def kind(self, f: tuple[int, ...]) -> tuple[int, float]:
        z = self.weights[self._columns(np.array(f))].sum(axis=0) + self.weights[-1]
        p = np.exp(z - z.max())
        p /= p.sum()
        return int(p.argmax()), float(p.max())


#: Usual forms, as a corpus may have too few of one to learn from; each counts as EXAMPLE spans. Labelers vote on them as on any other.
EXAMPLE = 20
_EXAMPLES = (
    "06 12 34 56 78", "01.42.68.53.00", "01-42-68-53-00", "+33 6 12 34 56 78", "+33 1.42.68.53.00", "+49 30 1234567", "+49 171 2345678", "+49 (0)30 123456", "030 1234567", "030/1234567", "(030) 1234567", "0171 2345678", "0171 234 56 78",
    "0171-2345678", "0049 30 1234567", "0033 6 12 34 56 78", "+44 20 7946 0958", "+44 (0)20 7946 0958", "020 7946 0958", "+34 612 345 678", "555-123-4567", "(555) 123-4567", "+1 555-123-4567", "555.123.4567",
    "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "FR14 2004 1010 0505 0001 3M02 606", "NL91 ABNA 0417 1643 00", "NO93 8601 1117 947", "DE89370400440532013000", "GB82WEST12345698765432",
    "3782 822463 10005", "378282246310005", "4111 1111 1111 1111", "4111-1111-1111-1111", "10 20 30 40 50 60", "2019 2020 2021", "1 000 000", "12 500 000", "100 200 300", "1 2 3 4 5 6 7 8", "10 20 30 40 50 60 70", "10 20 30 40 50 60 70 80", "100 200 300 400 500", "1000 2000 3000 4000 5000", "2024-01-31", "31/12/2024", "31.12.2024", "2024-01-31 12 30",
    "ann@example.com", "ann.lee@example.com", "ann.lee@mail.example.org", "info@example.co.uk", "a_b+c@sub.example.de", "x-1@example.fr", "7a@example.net", "first.middle.last@dept.mail.example.edu",
    "12-34-56-78-90-12-34-56-78-90-12-34-56", "12.34.56.78.90.12.34.56.78.90.12.34.56", "12/34/56/78/90/12/34/56/78/90/12/34/56", "123456789012345678901234567890123456", "3.14159265", "0.12345678", "12345678", "1999-2004", "12.5 13.5 14.5", "5 10 15 20",
)


def fit(docs: DataFrame) -> Model:
    schema = pa.schema([("pattern", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, int] = {}
        for b in batches:
            col = b.column(0)
            for i in _suspects(col):
                for _, _, v, f in candidates(col[int(i)].as_py()):
                    key = " ".join(map(str, v + f))
                    found[key] = found.get(key, 0) + 1
        yield kernel.out({"pattern": list(found), "n": list(found.values())}, schema)

    rows = docs.select("text").mapInArrow(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    counts = {tuple(map(int, r[0].split())): r[1] for r in rows}
    for value in _EXAMPLES:
        for _, _, v, f in candidates(f"a {value} b"):
            counts[v + f] = counts.get(v + f, 0) + EXAMPLE
    parsed = sorted(counts.items())
    return Model([(p[: len(LABELERS)], p[len(LABELERS) :], n) for p, n in parsed])


def found(text: str, model: Model, memory: dict) -> list[tuple[int, int, int, float]]:
    got = []
    for a, b, _, f in candidates(text):
        if f not in memory:
            memory[f] = model.kind(f)
        kind, p = memory[f]
        if kind != NONE:
            got.append((a, b, kind, p))
    return got


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, span_start, span_end (characters, end exclusive), kind, probability, value."""
    schema = pa.schema([("doc_id", pa.int64()), ("span_start", pa.int64()), ("span_end", pa.int64()), ("kind", pa.string()), ("probability", pa.float64()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict = {}
        for b in batches:
            rows: list[tuple] = []
            for i in _suspects(b.column(1)):
                text, doc = b.column(1)[int(i)].as_py(), b.column(0)[int(i)].as_py()
                rows += [(doc, s, e, KINDS[k], p, text[s:e]) for s, e, k, p in found(text, model, memory)]
            if rows:
                yield kernel.out(dict(zip(schema.names, map(list, zip(*rows)))), schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, span_start long, span_end long, kind string, probability double, value string")


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """docs with every span replaced by <KIND>; the same rows and columns."""
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if dict(docs.dtypes).get("n_chars") in ("int", "bigint") else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict = {}
        for b in batches:
            new, sizes = {}, {}
            for i in map(int, _suspects(b.column(at))):
                text = b.column(at)[i].as_py()
                for s, e, k, _ in reversed(found(text, model, memory)):
                    new[i] = text = f"{text[:s]}<{KINDS[k]}>{text[e:]}"
                    sizes[i] = len(text)
            if new:
                mask = np.zeros(b.num_rows, bool)
                order = sorted(new)
                mask[order] = True
                b = b.set_column(at, b.schema.field(at), pc.replace_with_mask(b.column(at), pa.array(mask), pa.array([new[i] for i in order], b.column(at).type)))
                if size >= 0:
                    known = mask & b.column(size).is_valid().to_numpy(zero_copy_only=False)
                    b = b.set_column(size, b.schema.field(size), pc.replace_with_mask(b.column(size), pa.array(known), pa.array([sizes[i] for i in order if known[i]], b.column(size).type)))
            yield b

    return docs.mapInArrow(run, docs.schema)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return spans(docs, fit(docs))
