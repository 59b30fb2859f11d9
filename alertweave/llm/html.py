"""Main text of web pages: the contiguous run of tokens with the highest sum, words scoring up and tags down.

Weights are log odds of lying inside the article, counted on labelled pages, which are pages that mark their article with an
<article> or <main> element. A word's weight depends on where it stands: in a link, in furniture (menus, adverts, forms,
comments), under which block element, and inside or outside the marked element. Each labelled page is also counted with its
mark unseen, so that pages without one are read by their other tags.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertweave.llm.common import settle

#: Labelled pages that the weights are fitted on, about so many; chosen by the hash of their id.
FIT_PAGES = 2_000

#: A comment, a raw-text element with its content, a declaration, or a tag with quoted attributes. A quote that does not end within
#: 4096 characters is no quote; the tag then ends at the next bracket, so that a quote left open costs no search to the page's end.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|math|iframe|object|textarea|select|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^'\">]|\"[^\"]{0,4096}\"|'[^']{0,4096}')*+(?=>|\Z)|[^>]*)(?:>|\Z)",
    re.S | re.I,
)
NAMED = re.compile(r"(?:class|id|role|itemtype|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: Elements that hold no article text wherever they stand, and those that do not outside the marked element.
FURNITURE = frozenset("nav aside form footer menu dialog button fieldset search".split())
OUTER = frozenset(["header"])
MARKED = frozenset(["article", "main"])
#: Words of class, id or role that name furniture.
NAMES = frozenset(
    "ad ads adv advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header-bar "
    "login masthead menu modal nav navbar navigation navigationbar newsletter notice notices notification overlay pagination pager paywall popup promo promoted promotion "
    "related recommended reply replies respond search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription toolbar widget widgets "
    "complementary contentinfo".split()
)
#: Of these, the ones that hold for an element however much it holds; others do not for one that holds most of the page's words.
STRONG = frozenset("ad ads adv advert advertisement adverts advertising comment comments commentlist disqus reply replies respond".split())
#: A name in a word with one of these describes its surroundings: has-sidebar, no-sidebar, share-enabled, search-result.
QUALIFIERS = frozenset("has have no not non with without enable enabled disable disabled result results".split())
#: An opening tag closes these before it, as browsers do.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = ("ul", "ol", "dl", "table", "menu", "div")
CLIP = 4.0
Key = tuple


@dataclass
class Run:
    """Text between two tags, or one tag."""

    block: int
    key: Key
    text: str
    words: int
    inside: bool


def _names(attributes: str) -> set[str]:
    """Furniture's names among the class, id and role words of a tag."""
    found: set[str] = set()
    if "=" in attributes:
        for m in NAMED.finditer(attributes):
            for word in m[1].strip("'\"").split():
                parts = re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", word).lower())
                if QUALIFIERS.isdisjoint(parts):
                    found |= NAMES.intersection(parts)
    return found


@dataclass
class Page:
    runs: list[Run] = field(default_factory=list)
    has_mark: bool = False


@dataclass
class Open:
    """An open element, and what holds inside it."""

    tag: str
    link: bool
    furniture: bool
    marked: bool
    nearest: str
    blocks: int
    hard: bool  # in furniture by tag or by a strong name
    place: int  # of its tag, if it is furniture by a weak name, else -1
    start: int  # words before it


class Stack:
    """The open elements; every step takes as long as the elements it closes."""

    def __init__(self):
        self.open: list[Open] = []
        self.places: dict[str, list[int]] = {}
        self.furniture: list[int] = []  # places of elements that are furniture themselves
        self.words = 0  # outside of hard furniture, so far
        self.held: dict[int, int] = {}  # words inside elements that are furniture by a weak name

    @property
    def top(self) -> Open:
        return self.open[-1] if self.open else Open("", False, False, False, "", 0, False, -1, 0)

    def last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else -1

    def push(self, tag: str, own: bool, is_mark: bool, hard: bool, place: int) -> None:
        top = self.top
        self.places.setdefault(tag, []).append(len(self.open))
        if own:
            self.furniture.append(len(self.open))
        block = tag in BLOCKS
        self.open.append(
            Open(tag, top.link or tag == "a", top.furniture or own, top.marked or is_mark, tag if block else top.nearest, top.blocks + block, top.hard or hard, place, self.words)
        )

    def cut(self, depth: int) -> None:
        while len(self.open) > depth:
            gone = self.open.pop()
            self.places[gone.tag].pop()
            if gone.place >= 0:
                self.held[gone.place] = self.words - gone.start
        while self.furniture and self.furniture[-1] >= depth:
            self.furniture.pop()


def _scan(html: str, spared: frozenset[int]) -> tuple[Page, frozenset[int]]:
    """The page, and the elements that are furniture by a weak name but hold most of the words outside of other furniture.

    Elements are known by the place of their tag; `spared` ones are not furniture by their names.
    """
    page, stack = Page(), Stack()
    block = at = 0
    in_head = False

    def say(text: str) -> None:
        top = stack.top
        if text and not in_head and not text.isspace():
            words = len(text.split())
            page.runs.append(Run(block, ("word", top.furniture, top.link, top.nearest, top.marked), text, words, top.marked and not top.furniture))
            if not top.hard:
                stack.words += words
        elif text:
            page.runs.append(Run(block, (), " ", 0, False))

    for m in TOKEN.finditer(html):
        say(html[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue  # comments, scripts and the like leave no trace
        if m[2]:
            if tag == "head":
                in_head = False
            depth = stack.last(tag)
            # An inline end tag does not close blocks around it.
            if depth >= 0 and not (tag in INLINE and stack.top.blocks > stack.open[depth].blocks):
                stack.cut(depth)
        else:
            if tag == "head":
                in_head = True
            elif tag in BLOCKS and tag != "html":
                in_head = False
            if tag in CLOSES:
                depth = max(map(stack.last, CLOSES[tag]))
                if depth >= 0 and depth > max(map(stack.last, BOUNDS)):
                    stack.cut(depth)
            if tag in BLOCKS and stack.places.get("p"):
                # A block ends the paragraph before it and what was left open inside.
                stack.cut(stack.places["p"][0])
            names = set() if tag in ("html", "body") else _names(m[4])
            strong = not names.isdisjoint(STRONG)
            weak = bool(names) and m.start() not in spared and tag not in MARKED
            by_tag = tag in FURNITURE or tag in OUTER and not stack.top.marked
            own = by_tag or strong or weak
            if tag in MARKED and not own and stack.top.furniture and not stack.top.marked:
                # Furniture that was never closed does not swallow the article.
                stack.cut(stack.furniture[0])
            is_mark = tag in MARKED and not own and not stack.top.furniture
            page.has_mark |= is_mark
            if tag not in VOID and not m[4].rstrip().endswith("/") or tag in BLOCKS and tag != "hr":
                hard = by_tag or strong
                stack.push(tag, own, is_mark, hard, m.start() if weak and not hard else -1)
        if tag in BLOCKS:
            block += 1
        top = stack.top
        # Tags in furniture weigh nothing, so that an advert within an article costs what its words cost, which is bounded.
        page.runs.append(
            Run(block, ("tag", top.furniture, tag if tag in BLOCKS else "inline", top.marked), " " if tag in ("br", "td", "th") else "", 0, top.marked and not top.furniture)
        )
    say(html[at:])
    stack.cut(0)
    return page, frozenset(place for place, words in stack.held.items() if 2 * words > stack.words)


def scan(html: str) -> Page:
    """The page's text and tags in order, each with the key of its weight.

    An element that holds most of the page's words is a frame around the content, not furniture, whatever it is called,
    unless its name is one of STRONG. It is found on a first reading; then the page is read again.
    """
    page, frames = _scan(html, frozenset())
    return page if page.has_mark or not frames else _scan(html, frames)[0]


def unseen(key: Key) -> Key:
    """The key on a page that marks nothing."""
    return (*key[:-1], None)


@dataclass
class Weights:
    """Log odds of a key's words or tags lying inside; unknown words count a little for, unknown tags a little against."""

    odds: dict[Key, float] = field(default_factory=dict)

    def of(self, run: Run, has_mark: bool) -> float:
        if not run.key:
            return 0.0
        furniture = run.key[1]
        if run.key[0] == "tag":
            odds = self.odds.get(run.key if has_mark else unseen(run.key), -0.1)
            return 0.0 if furniture else min(-0.05, odds)
        if furniture:
            return -0.02 * min(run.words, 50)  # bridged by an article of some size on either side
        odds = self.odds.get(run.key if has_mark else unseen(run.key))
        if odds is None:
            odds = -1.0 if run.key[2] and not (has_mark and run.key[4]) else 1.0 if not has_mark or run.key[4] else -1.0
        return odds * run.words


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the highest sum, the first and shortest of equals; empty if none is positive."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for k, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += score
        if total > best + 1e-12:
            best, region = total, (start, k + 1)
    return region


def main_text(html: str | None, weights: Weights) -> str:
    """The blocks of the best region without furniture, white space folded, joined by line feeds."""
    page = scan(html or "")
    start, end = best_region([weights.of(run, page.has_mark) for run in page.runs])
    if start == end:
        return ""
    first, last = page.runs[start].block, page.runs[end - 1].block
    blocks: dict[int, list[str]] = {}
    for run in page.runs:
        # Blocks of which a part lies in the region count as a whole.
        if first <= run.block <= last and not (run.key and run.key[1]) and (not page.has_mark or not run.key or run.key[0] == "tag" or run.key[4]):
            blocks.setdefault(run.block, []).append(run.text)
    texts = (" ".join(entities.unescape("".join(parts)).split()) for _, parts in sorted(blocks.items()))
    return "\n".join(text for text in texts if text)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled pages to (key, inside, outside) of words and tags, once with the mark seen and once without."""
    for batch in batches:
        sums: Counter[tuple[str, bool]] = Counter()
        for html in batch.column("html"):
            page = scan(html.as_py())
            if page.has_mark:
                for run in page.runs:
                    if run.key:
                        n = max(1, run.words)
                        sums[repr(run.key), run.inside] += n
                        sums[repr(unseen(run.key)), run.inside] += n
        keys = sorted({key for key, _ in sums})
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([sums[k, True] for k in keys], pa.int64()), pa.array([sums[k, False] for k in keys], pa.int64())], ["key", "inside", "outside"])


def fit(pages: DataFrame, most: int = FIT_PAGES) -> Weights:
    """Weights from about `most` labelled pages, picked evenly by the hash of their id; keys are tag names and flags, so few."""
    import ast

    settle(pages.sparkSession)
    marked = pages.select("page_id", "html").where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    n = marked.count()
    some = marked.where(F.pmod(F.xxhash64("page_id"), F.lit(max(1, n // max(1, most)))) == 0) if n > most else marked
    sums = some.select("html").mapInArrow(_count, "key string, inside long, outside long").groupBy("key").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    odds = {}
    for row in sums.collect():
        odds[ast.literal_eval(row.key)] = max(-CLIP, min(CLIP, math.log((row.inside + 0.5) / (row.outside + 0.5))))
    return Weights(odds)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of `pages` (page_id, url, html).

    Each page is read as a whole; null and empty ones, and pages without any word that speaks for content, give an empty
    text. Equal pages give equal texts; an empty table gives no rows; other columns are not read. Without labelled pages the
    weights are fixed ones: words up, words in links and tags down.
    """
    shared = pages.sparkSession.sparkContext.broadcast(fit(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(html.as_py(), shared.value) for html in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
