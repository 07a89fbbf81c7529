"""HTML extraction by tree scoring.

The markup is read into a tree as browsers do in the main: unclosed paragraphs, items and cells end where the
next one starts, stray end tags are ignored, contents of scripts, styles and comments are no text. Every paragraph
(p, pre, td, blockquote, and containers with text of their own) of 25 characters at least earns one point, one for each
comma and one for each 100 characters, at most three. Its parent gets all of them, its grandparent a half and
the ancestors at distance d = 3, 4, 5 one in 3 (d - 1). Containers start with a weight for their tag and for words in their class and id, and
scores are discounted by link density, the share of their text that is in links. The best container is
kept together with its siblings that score at least a fifth as much (10 at least), or that are paragraphs of prose with
few links. In what is kept, navigation, forms, footers and asides are dropped, and blocks become lines.

Map-only, one pass over (page_id, url, html). Defined results: a null page has null title and text; an empty one, or one
without text, has an empty text, and score 0. A page in which nothing scores gives the text of its body. Ties go to the first
container in the page. A null page_id or url is carried. Repeated rows are extracted alike. Nesting of any depth is read without recursion.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .cluster import table

SHORTEST, LEVELS, SHARE = 25, 5, 0.2
_STOP, _MARK, _CLOSE = re.compile(r"[\s/>]"), re.compile(r"[>\"']"), re.compile(">")
_NAMES = re.compile(r"""\b(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_GOOD = re.compile(r"article|body|content|entry|hentry|main|page|post|text|blog|story", re.I)
_BAD = re.compile(r"comment|combx|contact|foot|footer|masthead|media|meta|outbrain|promo|related|scroll|shoutbox|sidebar|sponsor|shopping|tags|tool|widget|\bads?\b|advert|banner|breadcrumb|cookie|menu|nav|pager|popup|share|social", re.I)
_WEIGHT = {"div": 5, "article": 10, "main": 10, "section": 3, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "form": -3, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5, "th": -5, "nav": -25, "footer": -25, "aside": -25}
_RAW = frozenset("script style noscript template iframe svg math textarea title select object xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
_ENDS_P = _BLOCK - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "li"}
_ENDS = {"li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)), "option": (("option",), ("select",))}
_CELLS, _WHOLE = ("td", "th", "table"), frozenset("td th tr table tbody body html".split())  # an end tag inside a cell ends nothing outside of it, but for these
_DROP = frozenset("nav footer aside form button head".split())
_PARAGRAPHS = frozenset("p pre td blockquote".split())
_HOLDERS = frozenset("div article section main body li dd".split())


class Node:
    __slots__ = ("tag", "parent", "children", "names", "own", "length", "links", "commas", "points", "candidate")

    def __init__(self, tag: str, parent: Node | None, names: str = ""):
        self.tag, self.parent, self.names = tag, parent, names
        self.children: list[Node | str] = []
        self.own = self.length = self.links = self.commas = 0
        self.points, self.candidate = 0.0, False


class Tags:
    """The ends of a page's tags, in time linear in its length however it is broken: what was looked for is remembered."""

    def __init__(self, html: str):
        self.html, self.near, self.ends = html, {}, {}

    def next(self, pattern: re.Pattern, at: int) -> int:
        """Where the pattern is found next, -1 if nowhere."""
        lo, k = self.near.get(pattern, (0, -2))
        if k == -2 or at < lo or -1 < k < at:
            m = pattern.search(self.html, at)
            lo, k = self.near[pattern] = at, m.start() if m else -1
        return k

    def end(self, at: int) -> int:
        """The '>' of the tag whose attributes begin at `at`, beyond any in quotes; -1 if it has none."""
        html, passed, k = self.html, [], self.next(_MARK, at)
        while k >= 0 and html[k] != ">":
            if k in self.ends:
                k = self.ends[k]
                break
            passed.append(k)
            close = html.find(html[k], k + 1)
            m = _MARK.search(html, close + 1) if close >= 0 else None
            k = m.start() if m else -1
        for q in passed:
            self.ends[q] = k
        return k


def parse(html: str) -> tuple[list[Node], str | None]:
    """Nodes, each after its parent (the first is the root), and the title, in time linear in the page's length."""
    root = Node("#root", None)
    nodes, stack, title, at, look, tags = [root], [root], None, 0, 0, Tags(html)
    places: dict[str, list[int]] = {}  # of the open tags of each name in the stack

    def add(text: str) -> None:
        if text:
            stack[-1].children.append(unescape(text) if "&" in text else text)

    def last(names: Iterable[str]) -> int:
        return max((p[-1] for n in names if (p := places.get(n))), default=0)

    def close(names: Iterable[str], limits: Iterable[str]) -> None:
        if (k := last(names)) > last(limits):
            for node in stack[k:]:
                places[node.tag].pop()
            del stack[k:]

    while (i := html.find("<", look)) >= 0:
        look, c = i + 1, html[i + 1 : i + 2]
        if html.startswith("<!--", i):
            add(html[at:i])
            k = html.find("-->", i + 4)
            at = look = k + 3 if k >= 0 else len(html)
            continue
        if c in ("!", "?"):
            if (k := tags.next(_CLOSE, i)) >= 0:
                add(html[at:i])
                at = look = k + 1
            continue
        begin = i + 1 + (c == "/")
        if not (html[begin : begin + 1].isascii() and html[begin : begin + 1].isalpha()) or tags.next(_CLOSE, begin) < 0 or (stop := tags.next(_STOP, begin)) < 0 or (end := tags.end(stop)) < 0:
            continue
        add(html[at:i])
        at = look = end + 1
        tag, attrs = html[begin:stop].lower(), html[stop:end]
        if c == "/":
            close((tag,), () if tag in _WHOLE else _CELLS)
            continue
        if tag in _RAW:
            if attrs.endswith("/") and tag in ("svg", "math"):
                continue
            over = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            if tag == "title" and title is None:
                title = " ".join(unescape(html[at : over.start() if over else len(html)]).split())
            at = look = over.end() if over else len(html)
            continue
        if tag in _ENDS_P:
            close(("p",), ("table", "td", "th", "button"))
        elif tag in _ENDS:
            close(*_ENDS[tag])
        node = Node(tag, stack[-1], " ".join(a or b or c for a, b, c in _NAMES.findall(attrs)) if attrs else "")
        stack[-1].children.append(node)
        nodes.append(node)
        if tag not in _VOID:
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)
    add(html[at:])
    return nodes, title


def weight(node: Node) -> float:
    return _WEIGHT.get(node.tag, 0) + (25 * (bool(_GOOD.search(node.names)) - bool(_BAD.search(node.names))) if node.names else 0)


def density(node: Node) -> float:
    return node.links / node.length if node.length else 0.0


def measure(nodes: list[Node]) -> None:
    """Length of text, of text in links, and commas, of every node with all that is in it; the text of its own."""
    for node in reversed(nodes):
        for c in node.children:
            if type(c) is str:
                n = sum(map(len, c.split())) + c.count(" ") if not c.isspace() else 0
                node.own += n
                node.length += n
                node.commas += c.count(",") + c.count("،") + c.count("、") + c.count("，")
        if node.tag == "a":
            node.links = node.length
        if node.parent:
            p = node.parent
            p.length, p.links, p.commas = p.length + node.length, p.links + node.links, p.commas + node.commas


def score(nodes: list[Node]) -> Node | None:
    """The best container."""
    for node in nodes:
        whole = node.tag in _PARAGRAPHS
        n = node.length if whole else node.own if node.tag in _HOLDERS else 0
        if n < SHORTEST:
            continue
        commas = node.commas if whole else sum(c.count(",") for c in node.children if type(c) is str)
        points = 1 + commas + min(n // 100, 3)
        up, level = node.parent if whole else node, 1
        while up and level <= LEVELS:
            if not up.candidate:
                up.candidate, up.points = True, up.points + weight(up)
            up.points += points / (1 if level == 1 else 2 if level == 2 else 3 * (level - 1))
            up, level = up.parent, level + 1
    best = None
    for node in nodes:
        if node.candidate and node.tag not in ("#root", "html"):
            node.points *= 1 - density(node)
            if best is None or node.points > best.points:
                best = node
    return best


def keep(best: Node) -> list[Node]:
    if not best.parent or best.tag == "body":
        return [best]
    least, kept = max(10.0, SHARE * best.points), []
    for c in best.parent.children:
        if c is best or type(c) is Node and c.tag not in _DROP and (
            c.candidate and c.points + (SHARE * best.points if c.names and c.names == best.names else 0) >= least
            or c.tag == "p" and (c.length > 80 and density(c) < 0.25 or 0 < c.length <= 80 and not c.links and _ends(c))
        ):
            kept.append(c)
    return kept


def _ends(node: Node) -> bool:
    return text_of([node]).rstrip().endswith((".", "!", "?"))


def text_of(nodes: list[Node]) -> str:
    """The text in document order, a line for each block, without what is dropped."""
    out: list[str] = []
    work: list[Node | str] = list(reversed(nodes))
    while work:
        x = work.pop()
        if type(x) is str:
            out.append(x if x == "\n" else x.replace("\n", " "))
        elif x.tag not in _DROP and not (x.names and x.tag != "body" and _BAD.search(x.names) and not _GOOD.search(x.names)):
            block = x.tag in _BLOCK
            if block:
                out.append("\n")
                work.append("\n")
            work.extend(reversed(x.children))
    return "\n".join(s for line in "".join(out).split("\n") if (s := " ".join(line.split())))


def extract(html: str) -> tuple[str | None, str, float]:
    """Title, text and the score of the best container."""
    nodes, title = parse(html)
    measure(nodes)
    best = score(nodes)
    if best is None or best.points <= 0:
        body = next((n for n in nodes if n.tag == "body"), nodes[0])
        return title, text_of([body]), 0.0
    return title, text_of(keep(best)), best.points


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, title, text, score: a row for each row of pages."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("title", pa.string()), ("text", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                got = [(None, None, None) if h is None else extract(h) for h in part.column(2).to_pylist()]
                yield kernel.out({"page_id": part.column(0), "url": part.column(1), "title": [g[0] for g in got], "text": [g[1] for g in got], "score": [g[2] for g in got]}, schema)

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, title string, text string, score double")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
