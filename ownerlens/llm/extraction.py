"""Main-text extraction by minimum-cut labelling of a page's blocks.

A page is cut into blocks of running text. A linear classifier over a block's
ancestors, class names, length and links gives two costs: of calling the block
content and of calling it boilerplate. They are the capacities of its edges to the
two terminals. Smoothness edges join blocks next to each other, and more strongly
blocks of one parent that bear the same tag and class. A maximum flow separates
content from boilerplate at least total cost; blocks on the content side make the
text. No single sign outweighs a block's edges to two neighbours of its kind, so
blocks with weak signs follow those around them.

A class that says what a page has or lacks (``has-sidebar``, ``ad-free``) names no
boilerplate, and neither does a class of the page's outer elements.

Defined cases: a null or empty page, or one without content, gives the empty text;
a page that breaks off is read to its end; repeated rows are extracted each; an
empty table gives an empty result; extra columns are ignored.
"""
from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ownerlens.llm.batches import bounded

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|select|svg|iframe|object|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    # A quote that is never closed ends with its tag.
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs2>[^>]*)>",
    re.S | re.I,
)
_CLASS = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")

BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset
h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Opening one of these ends an open one of the named tags.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}

#: Evidence of tags and of words in class, id and role; the nearest ancestor that has any decides.
CONTENT_TAGS = frozenset("article main".split())
BOILER_TAGS = frozenset("nav footer aside form menu button dialog label fieldset".split())
CONTENT_WORDS = frozenset("article content post entry story main maincontent".split())
BOILER_WORDS = frozenset("""ad ads advert advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs footer sidebar
aside widget related recommended share sharing social comment comments reply replies discussion disqus cookie cookies consent notice notices alert popup modal
newsletter subscribe subscription signup login search form toolbar pagination pager copyright legal disclaimer masthead hidden""".split())

#: Parts of a class name that speak of the rest of it instead of naming the element.
MODIFIERS = frozenset("has with without no not free is js".split())
#: Elements whose classes describe the page.
OUTER = frozenset("html body main".split())

#: Cost weights of the classifier.
TAG_COST = 3.5
WORD_COST = 3.5
LINK_COST = 2.5
SHORT_COST = 0.8
LONG_GAIN = 2.5
#: What a paragraph without any sign is worth as content.
PARAGRAPH_GAIN = 0.1
LONG = 80
#: Capacities of the edges between adjacent blocks and between successive blocks of one parent, alike in tag and class or not.
ADJACENT = 0.4
ALIKE = 1.5
SIBLING = 0.2


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    parent: int  # number of the enclosing element
    tag: str
    evidence: float  # cost of calling the block content, from its ancestors; negative for content
    kind: tuple = ()  # tag and classes of the element


def _own_evidence(tag: str, attrs: str, inside_content: bool) -> float | None:
    words: set[str] = set()
    if attrs:
        for m in _CLASS.finditer(attrs):
            if m[1].lower() == "hidden" or (m[1].lower() == "aria-hidden" and (m[2] or m[3] or m[4] or "").lower() == "true"):
                words.add("hidden")
            elif m[1].lower() != "aria-hidden":
                for name in (m[2] or m[3] or m[4] or "").lower().split():
                    parts = _WORD.findall(name)
                    if not MODIFIERS.intersection(parts):
                        words.update(parts)
    if words & BOILER_WORDS and (tag not in OUTER or "hidden" in words):
        return WORD_COST
    if tag in BOILER_TAGS or (tag == "header" and not inside_content):
        return TAG_COST
    if tag in CONTENT_TAGS:
        return -TAG_COST
    if words & CONTENT_WORDS:
        return -WORD_COST / 2
    return None


def blocks(page: str) -> list[Block]:
    """Blocks in page order; white space inside a block is one space, empty blocks are left out."""
    out: list[Block] = []
    stack: list[tuple[str, int, float, tuple]] = [("", 0, 0.0, ())]  # tag, number, evidence in force, kind
    number, parts, linked, links = 0, [], 0, 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                tag, parent, evidence, kind = stack[-1]
                # A block's parent is the element around it, so paragraphs of one section are siblings.
                around = stack[-2][1] if len(stack) > 1 and tag in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "dt", "dd") else parent
                out.append(Block(text, linked, around, tag, evidence, kind))
        parts, linked = [], 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if links:
                linked += len(text.strip())

    at = 0
    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag, closes, attrs = tag.lower(), m["close"] or m["close2"], m["attrs"] or m["attrs2"] or ""
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            links = 0 if closes else 1
        elif tag not in BLOCKS:
            continue
        elif closes:
            flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        else:
            flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in CLOSES.get(tag, ()) or stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] not in ("dt", "dd", "li", "td", "th", "tr"):
                    break
                if stack[k][0] in ("li", "td", "th") and tag not in CLOSES:
                    break
            if tag not in VOID:
                number += 1
                own = _own_evidence(tag, attrs, stack[-1][2] < 0)
                classes = tuple(x[2] or x[3] or x[4] or "" for x in _CLASS.finditer(attrs) if x[1].lower() == "class") if attrs else ()
                stack.append((tag, number, stack[-1][2] if own is None else own, (tag, classes)))
    add(page[at:])
    flush()
    return out


def costs(b: Block) -> tuple[float, float]:
    """Cost of calling the block content, and of calling it boilerplate."""
    score = b.evidence
    if b.linked * 2 > len(b.text):
        score += LINK_COST
    if len(b.text) >= LONG:
        score -= LONG_GAIN
    elif b.tag == "p" and b.evidence == 0:
        score -= PARAGRAPH_GAIN
    elif b.tag[:1] != "h" and b.evidence == 0:
        score += SHORT_COST
    return max(0.0, score), max(0.0, -score)


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source in a cut of least total capacity; of equal cuts, the one with fewest.

    ``source`` and ``sink`` are the nodes' terminal capacities, ``edges`` join two
    nodes both ways. Shortest augmenting paths in levels with a blocking flow each.
    """
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    near: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, ab: float, ba: float) -> None:
        near[a].append(len(to))
        to.append(b)
        cap.append(ab)
        near[b].append(len(to))
        to.append(a)
        cap.append(ba)

    for v in range(n):
        both = min(source[v], sink[v])  # this much flows straight through
        if source[v] > both:
            join(s, v, source[v] - both, 0.0)
        elif sink[v] > both:
            join(v, t, sink[v] - both, 0.0)
    for a, b, c in edges:
        join(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = [s]
        for v in queue:
            for e in near[v]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[v] >= 0 for v in range(n)]
        used = [0] * (n + 2)
        path: list[int] = []
        v = s
        while True:
            if v == t:
                flow = min(cap[e] for e in path)
                back = 0
                for k, e in enumerate(path):
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                for k, e in enumerate(path):
                    if cap[e] <= 1e-9:
                        back = k
                        break
                v = to[path[back] ^ 1]
                del path[back:]
                continue
            while used[v] < len(near[v]):
                e = near[v][used[v]]
                if cap[e] > 1e-9 and level[to[e]] == level[v] + 1:
                    break
                used[v] += 1
            if used[v] < len(near[v]):
                path.append(near[v][used[v]])
                v = to[path[-1]]
            elif path:
                level[v] = -1
                v = to[path.pop() ^ 1]
            else:
                break


def smoothness(found: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between adjacent blocks, and between successive blocks of one parent, strong where they are alike."""
    edges, last, alike = [], {}, {}
    for k, b in enumerate(found):
        if k:
            edges.append((k - 1, k, ADJACENT))
        if b.parent in last:
            edges.append((last[b.parent], k, SIBLING))
        if (b.parent, b.kind) in alike:
            edges.append((alike[b.parent, b.kind], k, ALIKE))
        last[b.parent] = alike[b.parent, b.kind] = k
    return edges


def extract(page: str | None) -> str:
    """Content blocks of a page, joined by blank lines."""
    found = blocks(page or "")
    if not found:
        return ""
    pairs = [costs(b) for b in found]
    # A block on the source side is content: cutting its source edge costs what "boilerplate" costs.
    content = min_cut([no for _, no in pairs], [yes for yes, _ in pairs], smoothness(found))
    return "\n\n".join(b.text for b, keep in zip(found, content) if keep)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pd.Series([extract(p) for p in pages], dtype=object)

    return bounded(pages).select("page_id", "url", text("html").alias("text")).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
