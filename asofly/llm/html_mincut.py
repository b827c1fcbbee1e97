"""Main text of web pages by a minimum cut between content and boilerplate.

A page becomes a row of text blocks. A classifier over each block (the elements it lies in, their class and id words, its
length, its share of link text, its sentence ends) gives a log-odds for content: that is the capacity of the edge to the
content terminal, or to the boilerplate terminal if negative. Neighbouring blocks, and blocks next to each other under one
parent, are tied by smoothness capacities that are higher the nearer they lie in the tree. The minimum cut (maximum flow)
labels the blocks. Blocks whose own capacity outweighs all their ties are settled beforehand, which doesn't change the
cut; the flow runs on the connected rest.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from asofly.llm.common import bounded_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template svg canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math object q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Elements that hold no article text, wherever they stand.
OUTSIDE = frozenset("nav footer aside form button select menu dialog datalist fieldset head option optgroup".split())
INSIDE = frozenset(("article", "main"))
#: Words of class and id attributes.
POOR = frozenset(
    "ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion nav navbar navigation menu menus sidebar side aside footer foot header masthead "
    "breadcrumb breadcrumbs pager pagination share sharing social cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "login search form widget related recommended recommendations comment comments reply replies respond discussion disqus tags copyright legal toolbar skip hidden".split()
)
GOOD = frozenset("article content post entry story text body main page blog prose".split())
ROLES_POOR = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Comments, declarations, tags; a tag with a quote that isn't closed ends at the next bracket, one without any at the page's end.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)(?:>|["'][^>]*+(?:>|\Z)|\Z)""", re.S)
_RAW_END = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in RAW}
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I | re.S)
_WORD = re.compile(r"[a-z]+")
_STOP = re.compile(r"[.!?…](?:[\s\"'”’)]|$)")
HEADS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
NEVER = 12.0


class Block:
    """A block's text, its characters in links and in all, log-odds of its elements, whether an article holds it, the
    element it lies in (name and number) and the number of that one's parent."""

    __slots__ = ("inside", "link", "odds", "parent", "tag", "text", "total", "up")

    def __init__(self, text: str, link: int, total: int, odds: float, inside: bool, tag: str, parent: int, up: int):
        self.text, self.link, self.total, self.odds, self.inside, self.tag, self.parent, self.up = text, link, total, odds, inside, tag, parent, up


def _attributes(tag: str, raw: str) -> tuple[float, bool]:
    """Log-odds that an element's attributes add, and whether it's hidden."""
    odds = 0.0
    if not raw or tag in ("html", "body"):
        return odds, False
    for name, *values in _NAMES.findall(raw):
        value, name = max(values, key=len).lower(), name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return 0.0, True
        if name == "role":
            odds += -6 if value in ROLES_POOR else 3 if value in INSIDE else 0
        elif name in ("class", "id"):
            words = set(_WORD.findall(value))
            odds += -6 if words & POOR else 2 if words & GOOD else 0
    return odds, False


class Forms:
    """What the forms of a page hold: their ends, articles, paragraphs and share of the text, found in one pass."""

    def __init__(self, page: str):
        self.ends, self.articles, self.paragraphs = [], [], []
        self.at, self.text = [0], [0]  # characters of text before a place
        place = 0
        while m := _TAG.search(page, place):
            self.at.append(m.start())
            self.text.append(self.text[-1] + m.start() - place)
            place = m.end()
            self.at.append(place)
            self.text.append(self.text[-1])
            tag = (m[2] or "").lower()
            if tag == "form" and m[1]:
                self.ends.append(m.start())
            elif tag in INSIDE and not m[1]:
                self.articles.append(m.start())
            elif tag == "p" and not m[1]:
                self.paragraphs.append(m.start())
            elif tag in RAW and not m[1] and not m[3].endswith("/"):
                place = raw_end(page, tag, place)
        self.size = len(page)
        self.all = self.before(self.size)

    def before(self, place: int) -> int:
        i = bisect_right(self.at, place) - 1
        return self.text[i] + (place - self.at[i] if i % 2 == 0 and i == len(self.at) - 1 else 0)

    def wraps(self, at: int) -> bool:
        """Whether the form that opens before `at` is wrapped round a page's main part instead of asking for something: it
        holds the article, or paragraphs and more than half of the page's text."""
        k = bisect_left(self.ends, at)
        end = self.ends[k] if k < len(self.ends) else self.size
        held = lambda places: bisect_left(places, end) > bisect_left(places, at)
        return held(self.articles) or held(self.paragraphs) and 2 * (self.before(end) - self.before(at)) > self.all


def raw_end(page: str, tag: str, at: int) -> int:
    """Where a raw element that opens before `at` is over; at the page's end if it isn't closed."""
    end = _RAW_END[tag].search(page, at)
    return len(page) if end is None else end.end()


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order, markup and raw elements removed, references decoded, white space made single.

    What is open is counted by name, and the innermost elements that aren't inline are kept apart, so a page costs time in
    proportion to its length however it is nested.
    """
    out: list[Block] = []
    #: Open elements: name, id, log-odds so far, within an article, in an element that holds none.
    stack: list[tuple[str, int, float, bool, bool]] = [("", 0, 0.0, False, False)]
    solid = [0]  # places in the stack of elements that aren't inline
    open_: Counter[str] = Counter()
    runs: list[Counter[str]] = [Counter()]  # inline elements that are open in each of them
    parts: list[str] = []
    forms: Forms | None = None
    unclosed: set[str] = set()
    made = link = linked = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            total = max(len(text), 1)
            owner = solid[-1]
            tag, own, odds, inside, never = stack[owner]
            out.append(Block(text, min(linked, total), total, -NEVER if never else odds, inside, tag, own, stack[owner - 1][1] if owner else 0))
        parts.clear()
        linked = 0

    def pop(to: int) -> None:
        if solid[-1] >= to:
            flush()
        while len(stack) > to:
            tag = stack.pop()[0]
            open_[tag] -= 1
            if tag in INLINE:
                runs[-1][tag] -= 1
            else:
                solid.pop()
                runs.pop()

    while True:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            parts.append(text)
            if link:
                linked += len(text)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                link = 0
            if not (runs[-1][tag] if tag in INLINE else open_[tag]):
                if tag not in INLINE:
                    flush()
                continue
            i = len(stack) - 1
            while stack[i][0] != tag:
                i -= 1
            pop(i)
            continue
        if tag == "svg" and m[3].endswith("/"):
            continue
        if tag in RAW:
            end = len(page) if tag in unclosed else raw_end(page, tag, at)
            if end == len(page):
                unclosed.add(tag)
            at = end
            parts.append(" ")
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                parts.append(" ")
            continue
        if tag == "a":
            link = 1
        if tag not in INLINE:
            flush()
            link = 0
            shut = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag, ("p",))
            if stack[solid[-1]][0] in shut:
                pop(solid[-1])
        if m[3].endswith("/") and tag not in INLINE:
            continue
        _, _, odds, inside, never = stack[-1]
        more, hidden = _attributes(tag, m[3])
        if tag in INSIDE and not never:
            odds, inside = 3.0 + max(more, 0.0), True
        else:
            odds += more
        if tag == "form" and forms is None:
            forms = Forms(page)
        if tag == "form" and forms.wraps(at):
            odds -= 1
        elif tag in OUTSIDE or hidden or tag == "header" and not inside:
            never = True
        elif tag == "header":
            odds -= 1
        made += 1
        open_[tag] += 1
        if tag in INLINE:
            runs[-1][tag] += 1
        else:
            solid.append(len(stack))
            runs.append(Counter())
        stack.append((tag, made, odds, inside, never))
    flush()
    return out


def log_odds(b: Block) -> float:
    """The classifier: positive if a block looks like article text."""
    words = b.text.count(" ") + 1
    share = b.link / b.total
    own = min(words / 12, 2.5) + min(len(_STOP.findall(b.text)), 4) * 0.4 - 4 * share - (0.0 if not b.parent else 0.5 if b.tag in HEADS else 1.0)
    return b.odds + (max(own, -1.0 - 2 * share) if b.inside else own)


def max_flow_side(n: int, caps: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """For nodes with capacities to the source (positive) or sink (negative), whether each is on the source's side of the
    smallest minimum cut (nodes that cost the same on either side go to the sink)."""
    adjacent: list[list[int]] = [[] for _ in range(n + 2)]
    to, cap = [], []

    def edge(u: int, v: int, c: float, back: float) -> None:
        adjacent[u].append(len(to))
        to.append(v)
        cap.append(c)
        adjacent[v].append(len(to))
        to.append(u)
        cap.append(back)

    for i, c in enumerate(caps):
        edge(n, i, c, 0.0) if c > 0 else edge(i, n + 1, -c, 0.0)
    for u, v, c in ties:
        edge(u, v, c, c)
    while True:  # Dinic: levels by breadth first, then blocking flow
        level = [-1] * (n + 2)
        level[n] = 0
        queue = deque([n])
        while queue:
            u = queue.popleft()
            for e in adjacent[u]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[n + 1] < 0:
            return [x >= 0 for x in level[:n]]
        turn = [0] * (n + 2)
        while True:
            path, u = [], n
            while u != n + 1:
                while turn[u] < len(adjacent[u]):
                    e = adjacent[u][turn[u]]
                    if cap[e] > 1e-9 and level[to[e]] == level[u] + 1:
                        break
                    turn[u] += 1
                else:
                    if not path:
                        break
                    level[u] = -1
                    u = to[path.pop() ^ 1]
                    continue
                path.append(e)
                u = to[e]
            if u != n + 1:
                break
            least = min(cap[e] for e in path)
            for e in path:
                cap[e] -= least
                cap[e ^ 1] += least


def ties(found: list[Block]) -> list[tuple[int, int, float]]:
    """Pairs of blocks that lie near each other, and what it costs to label them differently."""
    out: list[tuple[int, int, float]] = []
    last: dict[tuple[int, str], int] = {}
    for i, b in enumerate(found):
        if i:
            a = found[i - 1]
            near = 1.5 if a.parent == b.parent or a.up == b.up and a.tag == b.tag else 1.2 if a.up == b.up and a.tag in HEADS else 0.3 if a.up == b.up else 0.1
            out.append((i - 1, i, near))
        j = last.get((b.up, b.tag))
        if j is not None and j != i - 1:
            out.append((j, i, 1.0))
        last[b.up, b.tag] = i
    return out


def label(found: list[Block]) -> list[bool]:
    """Which blocks are content: the minimum cut of log-odds and ties."""
    n = len(found)
    unary, pairs = [log_odds(b) for b in found], ties(found)
    pull = [0.0] * n
    for u, v, c in pairs:
        pull[u] += c
        pull[v] += c
    side: list[bool | None] = [u > 0 if abs(u) > p else None for u, p in zip(unary, pull, strict=True)]
    group, order = {}, [i for i in range(n) if side[i] is None]
    caps = {i: unary[i] for i in order}
    parent = {i: i for i in order}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    inner = []
    for u, v, c in pairs:
        if side[u] is None and side[v] is None:
            parent[root(u)] = root(v)
            inner.append((u, v, c))
        elif side[u] is None:
            caps[u] += c if side[v] else -c
        elif side[v] is None:
            caps[v] += c if side[u] else -c
    for i in order:
        group.setdefault(root(i), []).append(i)
    edges: dict[int, list] = {}
    for u, v, c in inner:
        edges.setdefault(root(u), []).append((u, v, c))
    for r, nodes in group.items():
        place = {i: k for k, i in enumerate(nodes)}
        got = max_flow_side(len(nodes), [caps[i] for i in nodes], [(place[u], place[v], c) for u, v, c in edges.get(r, [])])
        for i, g in zip(nodes, got, strict=True):
            side[i] = g
    return [bool(s) for s in side]


def main_text(page: str | None) -> str:
    """The content blocks joined by one space; '' without any."""
    found = blocks(page or "")
    return " ".join(b.text for b, keep in zip(found, label(found), strict=True) if keep)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row; null and empty pages give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, max(len(b), 1), 500):
                part = b.slice(i, 500)
                got = [main_text(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got, pa.string()), pa.array(map(len, got), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return bounded_batches(pages).select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
