"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is read once, tag by tag, into flat blocks of text between block-level tags. A block's features are its word count and link density,
those of the blocks before and after it, and where it stands (inside an article, inside a menu, header, footer,
sidebar or form by tag, inside an element whose class, id or role names such a part, heading or paragraph). The tree (Gini splits, grown in
numpy) learns from the small table of labelled blocks in `html_training`. Blocks it takes for main text are joined by one line break.

Formulas stay in the sentence they stand in; what belongs to scripts, forms and players (noscript, template, textarea, select, iframe, svg, audio, video,
canvas) and the page's title are no text. Links tell menus and lists of related pages from text where no name does.

Defined cases: a null or empty page has empty text; an unclosed tag ends with its parent; an unclosed comment, script or
style runs to the end of the page; a tag that the page cuts off is no text; a page of one block is judged by the same tree; repeated rows have equal results.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<raw>script|style|title|noscript|template|textarea|select|iframe|svg|audio|video|canvas)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    # attributes whose quotes close, or else everything up to the next bracket; nothing is tried twice
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+|[^<>]*+)>",
    re.S | re.I)
#: Where a tag begins that the page cuts off.
CUT = re.compile(r"<[a-zA-Z/!?]")
NAMES = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
SPACE = re.compile(r"\s+")
WORD = re.compile(r"\S+")

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small "
                   "span strike strong sub sup time tt u var wbr "
                   "math semantics annotation mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mspace".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("nav header footer aside form menu dialog button fieldset".split())
INSIDE = frozenset(["article", "main"])
PART = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|banner|sponsor(?:ed)?|promo(?:tion)?|nav(?:bar|igation)?|menu|header|masthead|footer|"
    r"side-?bar|cookies?|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe|comments?|respond|disqus|share|social|related|"
    r"recommend(?:ed)?|breadcrumbs?|pagination|pager|login|signup|search|widget|copyright|legal|disclaimer|toolbar|skip|complementary|contentinfo)(?:$|[\s_-])", re.I)

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "inside", "outside", "part", "heading", "paragraph", "hidden")


@dataclass
class Block:
    text: str
    words: int
    links: float
    inside: bool
    outside: bool
    part: bool
    heading: bool
    paragraph: bool
    hidden: bool


class _Place:
    """Open block-level elements: the name, and what each adds to its parents."""

    def __init__(self):
        self.stack: list[tuple[str, tuple[int, int, int, int]]] = []
        self.sums = (0, 0, 0, 0)

    def open(self, name: str, rest: str) -> None:
        named = any(PART.search(a or b or c) for a, b, c in NAMES.findall(rest)) if rest else False
        own = (name in INSIDE, name in OUTSIDE, name != "body" and named, bool(rest) and HIDDEN.search(rest) is not None)
        self.stack.append((name, self.sums))
        self.sums = tuple(x + y for x, y in zip(self.sums, own, strict=True))

    def close(self, name: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == name:
                self.sums = self.stack[i][1]
                del self.stack[i:]
                return


def blocks(page: str) -> list[Block]:
    found: list[Block] = []
    place, pieces, linked = _Place(), [], []
    in_link, last = 0, ""

    def end() -> None:
        nonlocal pieces, linked
        text = SPACE.sub(" ", html.unescape("".join(pieces))).strip()
        if text:
            words = len(WORD.findall(text))
            under = len(WORD.findall(html.unescape(" ".join(linked))))
            inside, outside, part, hidden = place.sums
            found.append(Block(text, words, min(1.0, under / max(words, 1)), inside > 0, outside > 0, part > 0,
                               bool(re.fullmatch("h[1-6]", last)), last == "p", hidden > 0))
        pieces, linked = [], []

    at = 0
    for m in MARKUP.finditer(page):
        if m.start() > at:
            piece = page[at:m.start()]
            pieces.append(piece)
            if in_link:
                linked.append(piece)
        at = m.end()
        if (name := m["name"]) is None:
            if m["raw"]:
                pieces.append(" ")
            continue
        name = name.lower()
        if name == "a":
            in_link = 0 if m["close"] else 1
        if name in INLINE:
            if name == "br":
                pieces.append(" ")
            continue
        end()
        if m["close"]:
            place.close(name)
            last = ""
        else:
            last = name
            if name == "body":
                place = _Place()  # nothing of the head holds on
            if name not in VOID:
                if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and place.stack and place.stack[-1][0] == name:
                    place.close(name)  # such an element ends where the next one begins
                place.open(name, m["rest"])
    if at < len(page):
        rest = page[at:]
        cut = CUT.search(rest)
        pieces.append(rest[:cut.start()] if cut else rest)
    end()
    return found


def vectors(found: list[Block]) -> np.ndarray:
    if not found:
        return np.zeros((0, len(FEATURES)))
    words, links = np.array([b.words for b in found], float), np.array([b.links for b in found])
    before, after = (lambda x: np.concatenate(([0.0], x[:-1]))), (lambda x: np.concatenate((x[1:], [0.0])))
    return np.column_stack([words, links, before(words), before(links), after(words), after(links),
                            *(np.array([getattr(b, n) for b in found], float) for n in FEATURES[6:])])


class Tree:
    """Binary splits on one feature each; a leaf is the share of main text among its examples, of which it has `least` or more."""

    def __init__(self, rows: np.ndarray, main: np.ndarray, depth: int = 10, least: int = 10):
        self.least = least
        self.nodes: list[tuple[int, float, int, int, float]] = []
        self._grow(rows, main.astype(float), depth)

    def _grow(self, rows: np.ndarray, main: np.ndarray, depth: int) -> int:
        number = len(self.nodes)
        share = float(main.mean()) if len(main) else 0.0
        self.nodes.append((-1, 0.0, 0, 0, share))
        best = None
        if depth and 0 < share < 1:
            for feature in range(rows.shape[1]):
                order = np.argsort(rows[:, feature], kind="stable")
                value, hits = rows[order, feature], np.cumsum(main[order])
                cut = np.flatnonzero(value[1:] > value[:-1])
                cut = cut[(cut + 1 >= self.least) & (len(main) - cut - 1 >= self.least)]
                if not len(cut):
                    continue
                left = cut + 1.0
                right = len(main) - left
                a, b = hits[cut], hits[-1] - hits[cut]
                impurity = a * (1 - a / left) + b * (1 - b / right)
                i = int(impurity.argmin())
                if best is None or impurity[i] < best[0] - 1e-12:
                    best = (impurity[i], feature, (value[cut[i]] + value[cut[i] + 1]) / 2)
        if best is not None:
            low = rows[:, best[1]] <= best[2]
            children = self._grow(rows[low], main[low], depth - 1), self._grow(rows[~low], main[~low], depth - 1)
            self.nodes[number] = (best[1], best[2], *children, share)
        return number

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        at = np.zeros(len(rows), np.int64)
        table = np.array([n[:4] for n in self.nodes])
        share = np.array([n[4] for n in self.nodes])
        while len(open_ := np.flatnonzero(table[at, 0] >= 0)):
            node = table[at[open_]]
            low = rows[open_, node[:, 0].astype(int)] <= node[:, 1]
            at[open_] = np.where(low, node[:, 2], node[:, 3]).astype(np.int64)
        return share[at] >= 0.5


@lru_cache(maxsize=1)
def default_tree() -> Tree:
    """Fitted on the labelled blocks of `html_training`, which take milliseconds."""
    from .html_training import labelled_pages

    rows, main = [], []
    for page, texts in labelled_pages():
        found = blocks(page)
        rows.append(vectors(found))
        main += [b.text in texts for b in found]
    return Tree(np.concatenate(rows), np.array(main))


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = tree or default_tree()
        for batch in batches:
            texts = []
            for page in batch.column("html").to_pylist():
                found = blocks(page or "")
                main = judge(vectors(found)) if found else []
                texts.append("\n".join(b.text for b, good in zip(found, main, strict=True) if good))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
