"""HTML main text by minimum-cut labelling.

A page becomes blocks of text in page order, each with its chain of open elements.
A classifier of fixed weights gives every block a log-odds of being content, from its words, links and
sentence ends, and from what its ancestors' names, roles and classes say; its two
costs are the capacities of the edges from the source and to the sink. What an ancestor says against
content doesn't count where it wraps most of the page's text; vague names (``legal``, ``bottom``, a form) weigh
less than plain ones (``sidebar``, ``comments``), so that long running text outvotes them. Neighbours
in the page, and blocks near each other in the DOM, are joined by smoothness edges that
are weaker the farther apart they sit. The maximum flow saturates the cheapest cut;
blocks still reachable from the source are the main text.

Null or empty html, or a page without content: empty text. Unclosed and misnested
elements, cut-off tags and comments are read as far as they go; an unclosed head ends
where something begins that cannot stand in it. Character references
are decoded, white space within a block becomes one space, and blocks are joined by
\\n. Very long and deep pages are labelled whole, in linear time but for the flow: the graph has a constant number of edges a block.
Repeated rows are judged alike, other columns pass through (one named text or n_chars keeps its name and makes two of it; rename it first).
"""

from __future__ import annotations

import html as escapes
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|svg|iframe|textarea)\b(?:"[^"]*"|'[^']*'|[^'">])*+>.*?(?:</(?P=raw)\s*>|\Z)"""
    r"""|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^'">])*+|[^>]*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)""",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)

# Names of elements, roles and of classes or ids.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
HEAD = frozenset("base basefont bgsound link meta noframes title".split())  # what a head may hold, besides raw elements
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
AWAY = frozenset("aside button footer nav option select".split())
VAGUE = frozenset("dialog fieldset form header menu".split())
ROLE_AWAY = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
# First or last part of a class or id; VAGUE_NAMES say less.
AWAY_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising aside banner banners breadcrumb breadcrumbs comment commentlist comments consent cookie cookies discussion disqus footer gdpr masthead "
    "menu menus modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted recommendations recommended related replies reply respond share sharing sidebar "
    "social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
VAGUE_NAMES = frozenset("alert alerts bottom copyright disclaimer foot form header legal login overlay register search side signup tags top".split())
TOWARD_NAMES = frozenset("article body content entry main post story text".split())
# Such a first part speaks of looks, not of what is inside.
LOOKS = frozenset("align bg border col float font has hide is js m margin mb mt no not p padding pb pt row show text with without".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPLIT = re.compile(r"[^0-9A-Za-z]+|(?<=[a-z])(?=[A-Z])")


@dataclass(frozen=True)
class Cut:
    """Weights of the classifier and of the smoothness edges."""

    away: float = -9.0
    vague: float = -5.0
    wraps: float = 0.5
    far: int = 32
    toward: float = 3.0
    named: float = 1.0
    heading: float = 1.0
    words: float = 0.6
    base: float = -1.2
    links: float = -5.0
    sentence: float = 0.6
    adjacent: float = 0.5
    near: float = 1.2


@dataclass
class Element:
    """An element; toward, named, hidden and headings are those of it and all its ancestors."""

    tag: str
    parent: Element | None = None
    away: bool = False
    vague: bool = False
    toward: bool = False
    named: bool = False
    hidden: bool = False
    headings: int = 0
    depth: int = 0
    size: int = 0  # characters below it that aren't linked
    holds: bool = False  # an article or main element is below it
    against: float = 0.0  # what it and its ancestors say against content


@dataclass
class Block:
    text: str
    at: Element
    linked: float = 0.0
    score: float = field(default=0.0)


def names(value: str) -> tuple[bool, bool, bool]:
    """(away, vague, toward): what the classes or the id of an element say."""
    away = vague = toward = False
    for token in value.split():
        parts = [x.lower() for x in SPLIT.split(token) if x]
        if not parts or (parts[0] in LOOKS and len(parts) > 1):
            continue
        ends = {parts[0], parts[-1]}
        title = parts[0] in TOWARD_NAMES and parts[-1] in ("header", "title")
        if ends & AWAY_NAMES:
            away = True
        elif ends & VAGUE_NAMES and not title:
            vague = True
        else:
            toward |= title or bool(ends & TOWARD_NAMES)
    return away, vague, toward


def element(tag: str, attrs: str, parent: Element | None) -> Element:
    e = Element(tag, parent, tag in AWAY, tag in VAGUE, tag in ("article", "main"), headings=int(tag in HEADINGS), depth=parent.depth + 1 if parent else 0)
    if attrs and attrs.strip("/ "):
        for name, value in ATTRIBUTE.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name == "role":
                e.away |= value.lower() in ROLE_AWAY
                e.vague |= value.lower() == "form"
                e.toward |= value.lower() in ("main", "article")
            elif name in ("class", "id") and tag not in ("body", "html"):
                away, vague, toward = names(value)
                if tag not in ("article", "main"):
                    e.away |= away
                    e.vague |= vague
                e.named |= toward and not away
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                e.hidden = True
    if tag == "header" and (e.named or (parent and (parent.toward or parent.named))):  # the article's own
        e.vague = False
    if parent:
        e.toward |= parent.toward
        e.named |= parent.named
        e.hidden |= parent.hidden
        e.headings += parent.headings
    return e


#: An item or cell ends where the next begins, unless one of these stands between.
STOPS = {"li": ("ul", "ol", "menu"), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}


def blocks_of(page: str, how: Cut) -> list[Block]:
    """The page's blocks that have text."""
    out: list[Block] = []
    top = here = Element("#")
    elements: list[Element] = []  # parents before children
    open_: Counter[str] = Counter()
    parts: list[str] = []
    linked, at = 0, 0
    head: Element | None = None

    def end() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text and not here.hidden:
            out.append(Block(text, here, min(1.0, linked / len(text))))
            here.size += max(0, len(text) - linked)
        parts.clear()
        linked = 0

    def push(tag: str, attrs: str) -> Element:
        nonlocal here
        here = element(tag, attrs, here)
        elements.append(here)
        open_[tag] += 1
        return here

    def leave(e: Element) -> None:
        """Close e and all that is open in it."""
        nonlocal here
        while here is not e.parent:
            open_[here.tag] -= 1
            here = here.parent

    def body() -> None:
        nonlocal head
        end()
        leave(head)
        head = None

    for m in TOKEN.finditer(page):
        if m.start() > at:
            t = escapes.unescape(page[at : m.start()])
            if head and here is head and t.strip():
                body()
            parts.append(t)
            if open_["a"]:
                linked += len(t.strip())
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if head and tag not in HEAD:
            if m["close"] and tag not in ("head", "body", "html", "br") or tag == "head" and not m["close"]:
                continue
            body()
        if tag == "head":
            if not m["close"]:
                end()
                head = push(tag, "")
                head.hidden = True
            continue
        if tag == "br" or (tag in VOID and tag != "hr"):
            parts.append(" " if tag in ("br", "img", "input", "wbr") else "")
            continue
        if tag in BLOCKS:
            end()
        if tag in VOID:
            continue
        if m["close"]:
            if open_[tag]:
                e = here
                while e.tag != tag:
                    e = e.parent
                leave(e)
            continue
        if tag in BLOCKS and (open_["p"] or tag in STOPS):  # an open paragraph ends where a block begins
            stops, ends, x, last = STOPS.get(tag), ("p", *(STOPS if tag in STOPS else ())), here, None
            left = sum(open_[t] for t in ends)
            while left and x is not top and (x.tag not in BLOCKS or x.tag == "p" or (stops and x.tag not in stops)):
                if x.tag in ends:
                    last, left = x, left - 1
                x = x.parent
            if last:
                leave(last)
        push(tag, m["attrs"])
    if at < len(page):
        if head and here is head and page[at:].strip():
            body()
        parts.append(escapes.unescape(page[at:]))
    end()
    for e in reversed(elements):
        e.parent.size += e.size
        e.parent.holds |= e.holds or e.tag in ("article", "main")
    for e in elements:
        wraps = e.size > how.wraps * top.size
        says = how.away if e.away and not (wraps and e.holds and e.tag not in AWAY) else how.vague if e.vague and not wraps else 0.0
        e.against = min(e.parent.against, says)
    return out


def log_odds(b: Block, how: Cut) -> float:
    words = b.text.count(" ") + 1
    z = how.base + how.words * math.log2(1 + words) + how.links * b.linked + how.heading * b.at.headings
    z += how.sentence * (b.text[-1] in ".!?…\"'»”")
    return z + b.at.against + how.toward * b.at.toward + how.named * b.at.named


def distance(a: Element, b: Element, far: int) -> int:
    """Steps between two elements of the DOM, ``far`` at most."""
    n = 0
    while a is not b and n < far:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
        if a is None or b is None:
            return far
    return n


class Flow:
    """Dinic's maximum flow."""

    def __init__(self, n: int) -> None:
        self.to: list[int] = []
        self.room: list[float] = []
        self.of: list[list[int]] = [[] for _ in range(n)]

    def edge(self, a: int, b: int, there: float, back: float = 0.0) -> None:
        for x, y, c in ((a, b, there), (b, a, back)):
            self.of[x].append(len(self.to))
            self.to.append(y)
            self.room.append(c)

    def levels(self, s: int) -> list[int]:
        level, todo = [-1] * len(self.of), deque([s])
        level[s] = 0
        while todo:
            x = todo.popleft()
            for e in self.of[x]:
                if self.room[e] > 1e-9 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[x] + 1
                    todo.append(self.to[e])
        return level

    def source_side(self, s: int, t: int) -> list[bool]:
        """Saturate the cut; what the source still reaches."""
        while (level := self.levels(s))[t] >= 0:
            turn, path = [0] * len(self.of), []
            x = s
            while True:
                if x == t:
                    most = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= most
                        self.room[e ^ 1] += most
                    cut = next(i for i, e in enumerate(path) if self.room[e] <= 1e-9)
                    x = self.to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                while turn[x] < len(self.of[x]):
                    e = self.of[x][turn[x]]
                    if self.room[e] > 1e-9 and level[self.to[e]] == level[x] + 1:
                        break
                    turn[x] += 1
                if turn[x] < len(self.of[x]):
                    path.append(e)
                    x = self.to[e]
                elif path:
                    x = self.to[path.pop() ^ 1]
                    turn[x] += 1
                else:
                    break
        return [v >= 0 for v in level]


def label(blocks: list[Block], how: Cut = Cut()) -> list[bool]:
    """Which blocks are content: the source side of the minimum cut."""
    n = len(blocks)
    flow = Flow(n + 2)
    for i, b in enumerate(blocks):
        z = max(-30.0, min(30.0, log_odds(b, how)))
        flow.edge(n, i, math.log1p(math.exp(z)))  # cut if the block goes to the boilerplate
        flow.edge(i, n + 1, math.log1p(math.exp(-z)))
        for back in (1, 2):
            if i >= back:
                w = how.near / (1 + distance(blocks[i - back].at, b.at, how.far)) / back + how.adjacent * (back == 1) / (1 + (blocks[i - back].at is not b.at))
                flow.edge(i - back, i, w, w)
    return flow.source_side(n, n + 1)[:n]


def main_text(page: str | None, how: Cut = Cut()) -> str:
    if not page:
        return ""
    blocks = blocks_of(page, how)
    return "\n".join(b.text for b, kept in zip(blocks, label(blocks, how), strict=True) if kept)


def extract(pages: DataFrame, html_col: str = "html", how: Cut = Cut()) -> DataFrame:
    """pages without the html column, with text (the main text) and n_chars (its code points)."""
    keep = [c for c in pages.columns if c != html_col]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p, how) for p in b.column(b.num_columns - 1).to_pylist()]
            columns = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.record_batch([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(*keep, F.col(html_col)).mapInArrow(run, f"{fields}, text string, n_chars long")
