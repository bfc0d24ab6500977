"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into blocks at every tag that is not inline. A block has its words and its link density, the same of
the blocks before and behind it, and flags of its surroundings: whether it is a heading, stands in an article, in an element
for page furniture, or in one whose class, id or role is a name of such. A decision tree, trained on the small table of labelled
blocks below, tells which blocks belong to the main text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import slices, small_batches

#: Elements that run within a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose content is never text of the page.
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video head title textarea select option button datalist noframes map".split())
#: Of these, those whose content is not markup.
RAW = frozenset("script style textarea title noframes iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements for page furniture; a header or footer of an article's own is that too.
FURNITURE = frozenset("nav aside footer header form dialog menu fieldset".split())
MAIN = frozenset("article main".split())
#: Words that class, id and role names of page furniture are made of, and words that such names may have beside them.
FURNITURE_WORDS = frozenset(
    "ad ads alert advert adverts advertisement advertising adsense adslot adbox banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies dialog discussion disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pagination pager popup promo promotion promoted recommendations recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar trending widget widgets".split()
)
BESIDE_WORDS = frozenset("area article bar block body box btn button card container content entry form global group inner inline item left links list main message page panel policy primary post posts region right row section secondary site slot story text title to top unit user wrap wrapper".split())
#: Beside one of these a header is a title's.
_OF_TEXT = frozenset("article content entry post story text title".split())
#: Attributes that can hide an element have one of these in their names.
_MAY_HIDE = re.compile(r"hidden|style", re.I)
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>\"'][^\s>]*)))?")
_DECLARATION = re.compile(r"(?:[^;\"'(]|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|\([^)]*(?:\)|\Z))+")
_CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
#: Elements that may stand in a head; any other, and text, ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_MAY_NAME = re.compile(r"class|id|role", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\Wa-zA-Z\d_]+")
#: An open element of these ends when another of the same kind begins.
_ENDS_ITSELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

FEATURES = ("words", "link density", "words before", "link density before", "words behind", "link density behind", "in article", "beside an article", "in furniture", "named furniture", "heading")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    article: bool
    furniture: bool
    named: bool
    heading: bool


def _attributes(rest: str) -> dict[str, str]:
    values: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(rest):
        values.setdefault(name.lower(), html.unescape(a or b or c))
    return values


def hidden(rest: str) -> bool:
    """Whether a tag's attributes hide its element: hidden, aria-hidden=true, or a style of display:none or visibility:hidden."""
    if not _MAY_HIDE.search(rest):
        return False
    values = _attributes(rest)
    if "hidden" in values or values.get("aria-hidden", "").strip().lower() == "true":
        return True
    # Of several declarations of a property the last one holds, but for important ones.
    style: dict[str, tuple[bool, str]] = {}
    for declaration in _DECLARATION.findall(_CSS_COMMENT.sub(" ", values.get("style", ""))):
        key, _, value = declaration.partition(":")
        key, (value, mark, _) = key.strip().lower(), value.lower().partition("!")
        if bool(mark) >= style.get(key, (False, ""))[0]:
            style[key] = bool(mark), value.strip()
    return style.get("display", (False, ""))[1] == "none" or style.get("visibility", (False, ""))[1] == "hidden"


def names_furniture(rest: str) -> bool:
    """Whether a class, the id or the role is made of furniture words, with nothing but words that may stand beside them."""
    if not _MAY_NAME.search(rest):
        return False
    values = _attributes(rest)
    for name in " ".join(values.get(k, "") for k in ("class", "id", "role")).split():
        parts = {x.lower() for x in _PARTS.findall(name) if len(x) > 1}
        furniture = parts & FURNITURE_WORDS
        if furniture and parts <= FURNITURE_WORDS | BESIDE_WORDS and not (furniture == {"header"} and parts & _OF_TEXT):
            return True
    return False


def blocks(page: str) -> tuple[list[Block], bool]:
    """The text blocks of a page, in order, and whether it has an article or main element with text."""
    found: list[Block] = []
    # Open elements: name, in article, in furniture, named furniture, silent.
    stack: list[tuple[str, bool, bool, bool, bool]] = [("", False, False, False, False)]
    open_: Counter[str] = Counter()
    text: list[str] = []
    linked: list[str] = []
    links = 0
    heading = False
    at = 0
    has_article = False

    def flush() -> None:
        nonlocal heading, has_article
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                _, article, furniture, named, _ = stack[-1]
                n_linked = len(html.unescape("".join(linked)).split())
                found.append(Block(line, len(line.split()), n_linked, article, furniture, named, heading))
                has_article |= article
            text.clear()
        linked.clear()
        heading = False

    def close() -> str:
        name = stack.pop()[0]
        open_[name] -= 1
        return name

    end = len(page)
    while at < end:
        m = _TAG.search(page, at)
        stop = m.start() if m else end
        if stack[-1][0] == "head" and not page[at:stop].isspace() and stop > at:
            close()
        if stop > at and not stack[-1][4]:
            piece = page[at:stop]
            text.append(piece)
            if links:
                linked.append(piece + " ")
        if not m:
            break
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA[") and not stack[-1][4]:
                text.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        name, rest = m[2].lower(), m[3]
        if m[1]:
            if name in INLINE:
                if name == "a":
                    links = max(0, links - 1)
                continue
            flush()
            if open_[name] > 0:
                while close() != name:
                    pass
            links = 0
            continue
        if stack[-1][0] == "head" and name not in IN_HEAD:
            close()
        if name in INLINE:
            if name == "br":
                text.append(" ")
            elif name == "a":
                links += 1
            continue
        flush()
        links = 0
        ends = _ENDS_ITSELF.get(name)
        if ends and stack[-1][0] in ends:
            close()
        if name not in ("p",) and stack[-1][0] == "p":
            close()
        if name in VOID or rest.endswith("/") and name not in MAIN and name not in FURNITURE and name not in ("p", "div", "section"):
            continue
        _, article, furniture, named, silent = stack[-1]
        silent = silent or name in SILENT or bool(rest and hidden(rest))
        furniture = furniture or name in FURNITURE
        named = named or bool(rest) and name not in MAIN and name not in ("html", "body") and names_furniture(rest)
        heading = name in ("h1", "h2", "h3", "h4", "h5", "h6")
        stack.append((name, article or name in MAIN, furniture, named, silent))
        open_[name] += 1
        if name in RAW:
            stop_tag = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = stop_tag.end() if stop_tag else end
            close()
    flush()
    return found, has_article


def features(found: list[Block], has_article: bool) -> np.ndarray:
    """(blocks, FEATURES)."""
    x = np.zeros((len(found), len(FEATURES)))
    if found:
        words = np.array([b.words for b in found], float)
        density = np.array([b.linked for b in found]) / np.maximum(words, 1)
        x[:, 0], x[:, 1] = words, density
        x[1:, 2], x[1:, 3] = words[:-1], density[:-1]
        x[:-1, 4], x[:-1, 5] = words[1:], density[1:]
        x[:, 6:] = [(b.article, has_article and not b.article, b.furniture, b.named, b.heading) for b in found]
    return x


#: Labelled blocks: the features in order (words and link densities of a block, the one before and the one behind, 0 where
#: there is none; then flags), and 1 for main text. Written by hand after common page layouts.
TABLE = [
    # Pages without an article element. Menus, and lists of links without a name.
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 1, 0, 0, 0),
    (2, 1.0, 0, 0.0, 2, 1.0, 0, 0, 0, 0, 0, 0),
    (3, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0, 0, 0),
    (2, 1.0, 3, 1.0, 40, 0.0, 0, 0, 0, 0, 0, 0),
    (6, 0.8, 2, 1.0, 2, 1.0, 0, 0, 0, 0, 0, 0),
    (14, 0.9, 12, 1.0, 13, 0.9, 0, 0, 0, 0, 0, 0),
    (5, 0.6, 4, 1.0, 6, 1.0, 0, 0, 0, 0, 0, 0),
    (9, 1.0, 70, 0.0, 8, 1.0, 0, 0, 0, 0, 0, 0),
    # Lines between links: headings of link lists, dates, counts.
    (2, 0.0, 3, 1.0, 4, 1.0, 0, 0, 0, 0, 1, 0),
    (3, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0, 0, 0),
    (7, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0, 0, 0, 0),
    (12, 0.2, 3, 1.0, 2, 1.0, 0, 0, 0, 0, 0, 0),
    (4, 0.25, 2, 1.0, 5, 0.4, 0, 0, 0, 0, 0, 0),
    # Footers: short lines with links, at the end of the page.
    (8, 0.5, 60, 0.0, 6, 0.7, 0, 0, 0, 0, 0, 0),
    (6, 0.7, 8, 0.5, 0, 0.0, 0, 0, 0, 0, 0, 0),
    (12, 0.0, 4, 0.0, 0, 0.0, 0, 0, 1, 0, 0, 0),
    (9, 0.2, 50, 0.0, 0, 0.0, 0, 0, 1, 0, 0, 0),
    (5, 0.0, 2, 1.0, 0, 0.0, 0, 0, 0, 0, 0, 0),
    # Notices, adverts, sidebars and reader comments, by element or by name.
    (30, 0.0, 0, 0.0, 9, 0.0, 0, 0, 0, 1, 0, 0),
    (60, 0.0, 80, 0.0, 20, 0.0, 0, 0, 0, 1, 0, 0),
    (3, 0.4, 22, 0.0, 40, 0.0, 0, 0, 0, 1, 0, 0),
    (55, 0.0, 2, 0.0, 50, 0.0, 0, 0, 1, 1, 0, 0),
    (40, 0.0, 3, 1.0, 9, 0.3, 0, 0, 1, 0, 0, 0),
    # Their main text: titles, paragraphs of any length between others, and links within.
    (9, 0.0, 2, 1.0, 50, 0.0, 0, 0, 0, 0, 1, 1),
    (6, 0.0, 40, 0.0, 60, 0.0, 0, 0, 0, 0, 1, 1),
    (5, 0.0, 3, 1.0, 12, 0.0, 0, 0, 0, 0, 1, 1),
    (60, 0.0, 9, 0.0, 45, 0.0, 0, 0, 0, 0, 0, 1),
    (45, 0.05, 60, 0.0, 9, 0.2, 0, 0, 0, 0, 0, 1),
    (12, 0.0, 6, 0.0, 3, 0.0, 0, 0, 0, 0, 0, 1),
    (3, 0.0, 45, 0.0, 60, 0.0, 0, 0, 0, 0, 0, 1),
    (1, 0.0, 30, 0.0, 25, 0.0, 0, 0, 0, 0, 0, 1),
    (12, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 1),
    (3, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 1),
    (1, 0.0, 0, 0.0, 1, 0.0, 0, 0, 0, 0, 0, 1),
    (1, 0.0, 1, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 1),
    (2, 0.0, 5, 0.0, 6, 0.0, 0, 0, 0, 0, 0, 1),
    (30, 0.2, 50, 0.0, 40, 0.0, 0, 0, 0, 0, 0, 1),
    (25, 0.3, 40, 0.0, 30, 0.1, 0, 0, 0, 0, 0, 1),
    (55, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0, 0, 1),
    (40, 0.1, 1, 1.0, 7, 0.6, 0, 0, 0, 0, 0, 1),
    (6, 1.0, 50, 0.0, 45, 0.0, 0, 0, 0, 0, 0, 1),
    # Pages with an article element. What stands beside it.
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 1, 0, 0, 0),
    (2, 1.0, 1, 1.0, 9, 0.0, 0, 1, 1, 0, 0, 0),
    (3, 0.0, 0, 0.0, 1, 1.0, 0, 1, 1, 0, 1, 0),
    (8, 0.0, 1, 1.0, 6, 0.0, 0, 1, 0, 1, 0, 0),
    (30, 0.0, 0, 0.0, 9, 0.0, 0, 1, 0, 1, 0, 0),
    (14, 0.0, 3, 1.0, 7, 0.0, 0, 1, 0, 0, 0, 0),
    (45, 0.0, 80, 0.0, 5, 0.0, 0, 1, 0, 0, 0, 0),
    (6, 0.0, 0, 0.0, 12, 0.0, 0, 1, 0, 0, 1, 0),
    (4, 0.0, 90, 0.0, 0, 0.0, 0, 1, 0, 0, 0, 0),
    (80, 0.0, 2, 1.0, 3, 0.0, 0, 1, 0, 1, 0, 0),
    (9, 0.2, 50, 0.0, 0, 0.0, 0, 1, 1, 0, 0, 0),
    # Furniture within it: asides, forms, adverts, notices and comments.
    (20, 0.2, 70, 0.0, 30, 0.0, 1, 0, 1, 0, 0, 0),
    (5, 0.0, 70, 0.0, 30, 0.0, 1, 0, 1, 0, 1, 0),
    (1, 0.0, 12, 0.0, 1, 0.0, 1, 0, 1, 0, 0, 0),
    (60, 0.0, 50, 0.0, 40, 0.0, 1, 0, 1, 0, 0, 0),
    (25, 0.0, 60, 0.0, 50, 0.0, 1, 0, 0, 1, 0, 0),
    (7, 0.0, 40, 0.0, 70, 0.0, 1, 0, 0, 1, 0, 0),
    (22, 0.0, 3, 0.0, 3, 0.0, 1, 0, 0, 1, 0, 0),
    (2, 0.0, 40, 0.0, 25, 0.0, 1, 0, 0, 1, 1, 0),
    # Lists of links within it that nothing names: further reading, keywords.
    (5, 1.0, 4, 1.0, 6, 1.0, 1, 0, 0, 0, 0, 0),
    (2, 1.0, 2, 1.0, 3, 1.0, 1, 0, 0, 0, 0, 0),
    (6, 0.9, 2, 0.0, 5, 1.0, 1, 0, 0, 0, 0, 0),
    (9, 1.0, 8, 1.0, 0, 0.0, 1, 0, 0, 0, 0, 0),
    (4, 1.0, 7, 0.8, 9, 0.1, 1, 0, 0, 0, 0, 0),
    # Its text: titles, paragraphs of any length, lists and links within.
    (8, 0.0, 6, 0.0, 60, 0.0, 1, 0, 0, 0, 1, 1),
    (11, 0.0, 8, 0.0, 11, 0.0, 1, 0, 0, 0, 1, 1),
    (3, 0.0, 70, 0.0, 80, 0.0, 1, 0, 0, 0, 1, 1),
    (2, 0.0, 1, 1.0, 4, 0.0, 1, 0, 0, 0, 1, 1),
    (60, 0.0, 11, 0.0, 45, 0.0, 1, 0, 0, 0, 0, 1),
    (120, 0.02, 60, 0.0, 1, 0.0, 1, 0, 0, 0, 0, 1),
    (1, 0.0, 90, 0.0, 1, 0.0, 1, 0, 0, 0, 0, 1),
    (1, 0.0, 1, 0.0, 9, 0.1, 1, 0, 0, 0, 0, 1),
    (2, 0.0, 40, 0.0, 0, 0.0, 1, 0, 0, 0, 0, 1),
    (1, 0.0, 3, 1.0, 2, 1.0, 1, 0, 0, 0, 0, 1),
    (15, 0.0, 8, 0.0, 7, 0.2, 1, 0, 0, 0, 0, 1),
    (30, 0.3, 60, 0.0, 45, 0.1, 1, 0, 0, 0, 0, 1),
    (12, 0.6, 30, 0.0, 25, 0.0, 1, 0, 0, 0, 0, 1),
    (4, 1.0, 50, 0.0, 60, 0.0, 1, 0, 0, 0, 0, 1),
    (7, 1.0, 40, 0.1, 22, 0.0, 1, 0, 0, 0, 0, 1),
    (3, 1.0, 9, 0.0, 35, 0.0, 1, 0, 0, 0, 1, 1),
    (9, 0.0, 2, 1.0, 14, 0.0, 1, 0, 0, 0, 1, 1),
    (1, 0.0, 1, 1.0, 1, 0.0, 1, 0, 0, 0, 1, 1),
    (14, 0.0, 12, 0.0, 5, 1.0, 1, 0, 0, 0, 0, 1),
    (22, 0.1, 6, 1.0, 30, 0.0, 1, 0, 0, 0, 0, 1),
    (40, 0.0, 35, 0.0, 4, 0.8, 1, 0, 0, 0, 0, 1),
    (8, 0.0, 90, 0.0, 90, 0.0, 1, 0, 0, 0, 0, 1),
    (75, 0.0, 80, 0.0, 9, 0.0, 1, 0, 0, 0, 0, 1),
    (5, 0.0, 4, 0.0, 3, 0.0, 1, 0, 0, 0, 0, 1),
    (18, 0.2, 5, 0.6, 6, 1.0, 1, 0, 0, 0, 0, 1),
    (2, 0.0, 2, 0.0, 2, 0.0, 1, 0, 0, 0, 0, 1),
    (35, 0.0, 16, 0.0, 12, 0.4, 1, 0, 0, 0, 0, 1),
    (4, 0.0, 100, 0.0, 10, 0.0, 1, 0, 0, 0, 0, 1),
]


class Tree:
    """Decision tree by Gini impurity, grown until its leaves are pure or hold `least` rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 9, least: int = 1):
        self.value = bool(y.mean() >= 0.5)
        self.split: tuple[int, float] | None = None
        if depth == 0 or len(y) <= least or y.min() == y.max():
            return
        best = (2 * y.mean() * (1 - y.mean()) - 1e-9, -1, 0.0)
        for k in range(x.shape[1]):
            values = np.unique(x[:, k])
            for cut in (values[:-1] + values[1:]) / 2:
                left = x[:, k] <= cut
                p, a, b = left.mean(), y[left].mean(), y[~left].mean()
                impurity = p * 2 * a * (1 - a) + (1 - p) * 2 * b * (1 - b)
                if impurity < best[0] - 1e-12:
                    best = (impurity, k, cut)
        if best[1] >= 0:
            self.split = best[1:]
            left = x[:, best[1]] <= best[2]
            self.left, self.right = Tree(x[left], y[left], depth - 1, least), Tree(x[~left], y[~left], depth - 1, least)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.split is None or not len(x):
            return np.full(len(x), self.value)
        k, cut = self.split
        left = x[:, k] <= cut
        out = np.empty(len(x), bool)
        out[left], out[~left] = self.left.predict(x[left]), self.right.predict(x[~left])
        return out


def trained() -> Tree:
    table = np.array(TABLE, float)
    return Tree(table[:, :-1], table[:, -1])


def main_text(page: str | None, tree: Tree) -> str:
    """The main text of one page: its blocks, joined by line feeds."""
    found, has_article = blocks(page or "")
    keep = tree.predict(features(found, has_article))
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def _extract(tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(x, tree) for x in batch.column("html").to_pylist()]
            texts = [t.encode("utf-8", "replace").decode() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    return run


@small_batches
def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars: code points of the text), one row for each row of pages.

    Null or empty html, and pages without main text, give an empty text. Nulls in the other columns, repeated rows
    and further columns do not matter. Each page is done by itself, where it is read.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(_extract(trained()), f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumnRenamed("id", "page_id")
