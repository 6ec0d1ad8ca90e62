"""Operator 3: main text of web pages by tag-path ratios.

A page becomes a sequence of text nodes, each with its root-to-leaf tag path. Text length and punctuation are averaged
over the nodes of each path, smoothed along the page, and fused by product; nodes of paths above the threshold are
content. The deepest element that holds nearly all content is the article's box; it grows to a container around it that
is marked as the article (article, main or the like). All text in the box counts, in an unmarked one without the links
before the first and after the last content node. Names of tags, roles and classes are a veto: menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments never count.

Null, empty and text-free html gives an empty text. Broken markup is read as far as it goes: unclosed elements end with
their parents, a stray "<" is text. Work and memory grow with the length of a page, whatever its nesting. Repeated rows
and null ids give a row each; an empty table an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creasework.llm.common import extended, slices, table

_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_QUOTED = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
_SIGN = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s"'>]+)))?""")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_UNSEEN = re.compile(r"(?<![-\w])(?:display\s*:\s*none|visibility\s*:\s*hidden)(?![-\w])", re.I)
_STATE = frozenset("has no with without is not".split())

# Fixed values of HTML: elements without content, with raw text, and those that break a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_ALIKE = {"li": ("li",), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
_WALLS = ("ul", "ol", "table", "dl", "select")
_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
#: Elements and names (in class, id or role) that are never part of an article.
NOT_ARTICLE = frozenset("head nav header footer aside form script style noscript iframe template textarea select button svg canvas object dialog menu title".split())
NOT_ARTICLE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs header masthead footer foot "
    "sidebar aside rail widget widgets cookie cookies consent notice notices gdpr alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist "
    "reply replies respond disqus discussion share sharing social related recommended recommendations toolbar pagination pager search form skip copyright legal disclaimer contentinfo complementary".split()
)
ARTICLE_NAMES = frozenset("article articlebody content main maincontent post postbody entry story body text page".split())


@dataclass(slots=True)
class Element:
    tag: str
    parent: Element | None
    path: int  # a number for each root-to-leaf path of labels
    dropped: bool
    marked: int  # 2: article or main; 1: named like one
    depth: int
    first: int  # number in page order; its descendants have the numbers up to last
    last: int


@dataclass(slots=True)
class Node:
    text: str
    element: Element
    block: int
    linked: bool


@lru_cache(1 << 14)
def _traits(tag: str, attributes: str) -> tuple[bool, int, str]:
    """(dropped by itself, marked unless dropped, label in paths): what an element's tag and attributes tell."""
    whole: set[str] = set()
    parts: set[str] = set()
    hidden = False
    if attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values)
            hidden |= name == "hidden" or name == "class" and "hidden" in value.lower().split() or name == "style" and bool(_UNSEEN.search(value))
            if name in ("class", "id", "role", "itemprop"):
                for word in value.split():
                    whole.add(word.lower())
                    own = _PART.findall(_CAMEL.sub("-", word).lower())
                    if not _STATE & set(own):  # "has-sidebar" or "no-comments" tell of a state, not of what it is
                        parts.update(own)
    names = whole | parts
    # html, body and articles are kept, whatever else their names tell, unless they are a comment
    unwanted = "comment" in whole if tag in ("html", "body", "article", "main") else bool(names & NOT_ARTICLE_NAMES)
    dropped = tag in NOT_ARTICLE or unwanted or hidden
    marked = 2 if tag in ("article", "main") or whole & {"main", "articlebody"} else 1 if tag != "body" and names & ARTICLE_NAMES else 0
    return dropped, marked, ".".join([tag, *sorted(whole)[:2]])


class Parser:
    """The elements and text nodes of a page in order; nodes with the same block number flow into each other."""

    def __init__(self, html: str):
        self.elements: list[Element] = []
        self.nodes: list[Node] = []
        self.paths: dict[tuple[int, str], int] = {}
        self.stack: list[Element] = []
        self.open: dict[str, list[int]] = {}  # of each tag the places of its open elements in the stack
        self.walls: list[int] = []  # the places of those that break a line
        self.lost: set[int] = set()  # quotes from which on no tag ends
        self.block = 0
        self._push("#page", "")
        self._read(html)
        self._close(0)

    def _push(self, tag: str, attributes: str) -> None:
        # long attributes (embedded images, styles) hardly recur and would fill the memory
        dropped, marked, label = (_traits if len(attributes) < 500 else _traits.__wrapped__)(tag, attributes)
        parent = self.stack[-1] if self.stack else None
        dropped = dropped or parent is not None and parent.dropped
        path = self.paths.setdefault((parent.path if parent else -1, label), len(self.paths))
        n = len(self.elements)
        self.elements.append(Element(tag, parent, path, dropped, 0 if dropped else marked, len(self.stack), n, n))
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.walls.append(len(self.stack))
        self.stack.append(self.elements[-1])

    def _close(self, upto: int) -> None:
        while len(self.stack) > upto:
            gone = self.stack.pop()
            gone.last = len(self.elements) - 1
            self.open[gone.tag].pop()
            if gone.tag not in INLINE:
                self.walls.pop()
                self.block += 1

    def _last(self, tags: tuple[str, ...]) -> int:
        """The place of the innermost open element of these tags; 0, the page's own, if there is none."""
        return max((places[-1] for t in tags if (places := self.open.get(t))), default=0)

    def _close_last(self, tags: tuple[str, ...], wall: int = 0) -> None:
        """End the innermost open element of these tags, unless it lies outside the wall at this place."""
        place = self._last(tags)
        if place and place >= wall:
            self._close(place)

    def _text(self, raw: str) -> None:
        if raw:
            self.nodes.append(Node(unescape(raw) if "&" in raw else raw, self.stack[-1], self.block, bool(self.open.get("a"))))

    def _start(self, tag: str) -> None:
        """End what a start tag ends."""
        if tag in CLOSES_P:
            self._close_last(("p",), self.walls[-1])
        elif tag in _ALIKE:
            self._close_last(_ALIKE[tag], self._last((*_WALLS, "tr") if tag in ("td", "th") else _WALLS))

    def _tag_end(self, html: str, position: int) -> int:
        """Behind the sign that ends the tag, quoted ones aside; where a quote stays open, behind the first one at all; 0
        if there is none. Quotes from which no end was found are remembered, so no stretch is searched twice."""
        if not self.lost and (quoted := _QUOTED.match(html, position)):
            return quoted.end()
        trail, at = [], position
        while (sign := _SIGN.search(html, at)) and sign.start() not in self.lost:
            if sign[0] == ">":
                return sign.end()
            trail.append(sign.start())
            at = html.find(sign[0], sign.end()) + 1
            if not at:
                break
        self.lost.update(trail)
        return html.find(">", position) + 1

    def _read(self, html: str) -> None:
        at = position = 0
        while m := _OPEN.search(html, position):
            position = m.end()
            if not m[2]:
                comment = m[0] == "<!--"
                end = html.find("-->" if comment else ">", position)
                if end < 0 and not comment:
                    break
                self._text(html[at : m.start()])
                at = position = len(html) if end < 0 else end + (3 if comment else 1)
                continue
            end = self._tag_end(html, position)
            if not end:
                break  # no tag ends from here on
            self._text(html[at : m.start()])
            attributes, tag = html[position : end - 1], m[2].lower()
            at = position = end
            if m[1]:
                self._close_last((tag,), self.walls[-1] if tag in INLINE else 0)
                continue
            self._start(tag)
            if tag not in INLINE:
                self.block += 1
            if tag in VOID or attributes.endswith("/") and tag in ("path", "circle", "rect"):
                continue
            if tag in RAW:
                stop = _END[tag].search(html, at)
                inner = html[at : stop.start() if stop else len(html)]
                if tag in ("title", "noscript"):
                    self._push(tag, attributes)
                    self._text(re.sub(r"<[^<>]*>", " ", inner))
                    self._close(len(self.stack) - 1)
                at = position = stop.end() if stop else len(html)
                continue
            self._push(tag, attributes)
        self._text(html[at:])


def text_nodes(html: str) -> list[Node]:
    return Parser(html).nodes


def path_ratios(nodes: list[Node]) -> np.ndarray:
    """Of each node, its path's mean text length times mean punctuation, both smoothed along the page."""
    path = np.unique(np.array([n.element.path for n in nodes]), return_inverse=True)[1]
    own = [n.text.strip() for n in nodes]
    weight = np.array([0.2 if n.linked else 1.0 for n in nodes])
    count = np.maximum(1, np.bincount(path, np.array([bool(t) for t in own], float)))
    length = (np.bincount(path, np.array([len(t) for t in own]) * weight) / count)[path]
    marks = (np.bincount(path, np.array([len(_PUNCTUATION.findall(t)) for t in own]) * weight) / count)[path]
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    kernel /= kernel.sum()
    smooth = lambda x: np.convolve(np.pad(x, 2, mode="edge"), kernel, "valid")
    return smooth(length) * (smooth(marks) + 0.1)


def article_nodes(page: Parser) -> list[Node]:
    nodes = [n for n in page.nodes if not n.element.dropped]
    full = [n for n in nodes if n.text.strip()]
    if not full:
        return []
    ratios = path_ratios(full)
    content = ratios >= min(float(ratios.std()), float(ratios.max()))
    weight = [0.0] * len(page.elements)
    for n, hit in zip(full, content, strict=True):
        weight[n.element.first] += len(n.text.strip()) * (1.0 if hit else 0.01) * (0.2 if n.linked else 1)
    for e in reversed(page.elements):  # children come after their parents
        if e.parent is not None:
            weight[e.parent.first] += weight[e.first]
    nearly = 0.95 * weight[0]
    box = max((e for e in page.elements if weight[e.first] >= nearly), key=lambda e: e.depth)
    marked = _marked_box(page, box, weight)
    if marked is not None:
        return [n for n in nodes if marked.first <= n.element.first <= marked.last]
    inside = [n for n in nodes if box.first <= n.element.first <= box.last]
    keep = {id(n) for n, hit in zip(full, content, strict=True) if hit}
    hits = [i for i, n in enumerate(inside) if id(n) in keep]
    return [n for i, n in enumerate(inside) if hits and (hits[0] <= i <= hits[-1] or not n.linked)]


def _marked_box(page: Parser, box: Element, weight: list[float]) -> Element | None:
    """The marked container with the content: around the box, or the heaviest of several that share it."""
    for level, least in ((2, 0.0), (1, 0.5)):
        marked = [e for e in page.elements if e.marked == level and weight[e.first] > least * weight[0]]
        if marked:
            heaviest = max(weight[e.first] for e in marked)
            # of nested containers the innermost that still has nearly everything
            return max((e for e in marked if weight[e.first] >= 0.95 * heaviest), key=lambda e: e.depth)
    return None


def flowed(nodes: list[Node]) -> list[str]:
    """The text of each block, white space turned into single spaces; blocks without text go."""
    blocks: list[list[str]] = []
    last = None
    for n in nodes:
        if n.block != last:
            blocks.append([])
            last = n.block
        blocks[-1].append(n.text)
    return [t for t in (" ".join("".join(b).split()) for b in blocks) if t]


def main_text(html: str | None) -> str:
    return " ".join(flowed(article_nodes(Parser(html)))) if html else ""


def extract(pages: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns, text and n_chars of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [main_text(h) for h in b.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(*keep, F.col("html").alias("_html")).mapInArrow(run, extended(pages, keep, "text string, n_chars long"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
