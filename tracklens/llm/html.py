"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is read tag by tag into flat blocks of text.  Each block has its word
count and link density, those of the blocks before and after it, and what
encloses it.  A decision tree, grown by Gini gain alone from the blocks of the
labelled pages PAGES with their true neighbours, tells main text from the rest.
Head, scripts, styles, comments in the markup and form controls never become
blocks.

Inside a block, character references are decoded and white space becomes one
space; blocks without text vanish.  Null, empty and tag-free input is allowed
(the latter is one block); unclosed and stray tags are tolerated.  A quoted
attribute value may be of any length and hold any character; where a quote is
never closed, tags end at the next > from there on.  Pages are read in one pass,
in time linear in their length.  Repeated rows are extracted alike, each to its
own row; columns named __html, text or n_chars cannot be kept.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import reserved, small_batches

#: What begins a comment, a tag or a declaration.
_OPENING = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/<>]*)|[!?/])")
#: The rest of a tag up to its >; a quoted value after = may hold anything.
_REST = re.compile(r"(?:[^<>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+")
_PLAIN_REST = re.compile(r"[^<>]*+")
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template svg math iframe object canvas audio video textarea select option button title".split())  # noqa: SIM905
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())  # noqa: SIM905
#: Elements that stay within a block of text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br img wbr".split())  # noqa: SIM905
#: Elements and names of classes, ids and roles that enclose what is no main text.
BESIDE = frozenset("nav footer aside form menu dialog".split())  # noqa: SIM905
BESIDE_NAME = re.compile(
    r"(?:^|(?<!has)(?<!with)(?<!no)[\s_-])(?:ads?|adverts?|advertis\w*|sponsor\w*|promo\w*|banner|nav\w*|menu|breadcrumbs?|footer|footnav|sidebar|side|widget|related|recommend\w*|comments?|commentlist|respond|reply|replies|disqus|"
    r"cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|share|sharing|social|masthead|topbar|toolbar|search|pagination|pager|tags|copyright|legal|disclaimer|"
    r"contentinfo|complementary|navigation|search)(?:$|[\s_-])",
    re.I,
)
_COMMENT_NAME = re.compile(r"(?:^|[\s_-])(?:comments?|repl(?:y|ies)|related|teaser|promo\w*|ads?)(?:$|[\s_-])", re.I)
MAIN = frozenset({"article", "main"})
MAIN_NAME = re.compile(r"(?:^|[\s_-])(?:article|main|entry|post|story)(?:[_-]?(?:body|content|text))?(?:$|[\s_])", re.I)

Features = tuple[float, ...]
#: What the tree may ask of a block.
FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "beside", "in_main", "page_has_main", "heading")

#: The labelled table: pages of several shapes, their blocks in page order.  A block
#: is its words, linked words and signs: + main text, b beside, m within an article
#: or main element, h heading.
PAGES = (
    # A menu, an advert, an article, a footer.
    "1/1b 1/1b 2/2b 1/1b 9/0b 8/0+mh 60/0+m 5/0+m 120/4+m 1/0+m 80/0+m 12/0b",
    "2/2b 1/1b 60/0b 14/0+mh 14/0+m 300/0+m 2/0+m 90/0+m 6/0+m 45/0b",
    "1/1b 3/0b 1/0+mh 1/0+m 7/0+m 9/9+m 4/0+m 1/0b",
    # An article with adverts, a list of links and comments in it or after it.
    "1/1b 1/1b 7/0+mh 40/0+m 25/0bm 70/2+m 10/10+m 3/3+m 8/1+m 4/4bm 30/0bm 250/0bm 2/2b",
    "3/0bh 12/12b 6/0+mh 90/0+m 6/0+mh 30/18+m 55/0+m 80/0b 40/0b 90/0b 5/5b",
    # An article beside blocks of no known name.
    "4/0 1/1 1/1 6/0+mh 35/0+m 80/3+m 70/0 200/0 30/27 5/0h 9/9 9/0",
    "70/0 8/0+mh 3/0+m 150/0+m 20/0+m 7/0h 40/0 60/0 5/0 2/0",
    "20/0 5/5 9/0+mh 9/0+m 30/0+m 30/0 9/0 1/0",
    # No article element: menus, running text, headings, lists of links, small print.
    "1/1 2/2 1/1 7/0+h 35/0+ 80/16+ 4/0+ 220/20+ 60/0+ 3/3 2/0 4/4 2/2",
    "2/2 1/0 3/3 1/1 10/0+h 120/0+ 1/0+ 55/5+ 6/0+h 90/0+ 12/11 30/24 1/1 3/0 2/2",
    "5/5 2/0h 4/4 6/6 3/0h 2/2 3/3 1/0 5/5 40/0+ 30/6+ 9/9 1/0 1/1",
    "7/0+h 1/0+ 3/0+ 2/0+ 8/0+ 5/0+",
    "2/0+ 1/1 1/1 2/0h 4/4",
    "5/0+ 12/2+ 40/4+ 6/5 1/1",
    "1/1 90/0b 1/1 6/0+h 70/0+ 4/0+ 12/0b 5/0bh 6/6b",
    "1/1 8/0b 250/0+ 60/0b 40/0+ 25/0b 9/0b",
    "1/1 1/1 45/0+ 1/1 60/2+ 2/2 38/0+ 1/1 4/0 3/3",
    "3/3 2/0 3/3 30/0+ 2/2 5/0 2/2 26/1+ 1/1",
    "12/0+",
)


def labelled(pages: tuple[str, ...] = PAGES) -> list[tuple[float, ...]]:
    """Features and label (1: main text) of every block of labelled pages."""
    out = []
    for page in pages:
        read = [re.fullmatch(r"(\d+)/(\d+)(\D*)", x).groups() for x in page.split(" ")]
        found = [Block("", int(words), int(linked), "b" in signs, "m" in signs, "h" in signs) for words, linked, signs in read]
        out += [(*f, float("+" in signs)) for f, (_, _, signs) in zip(features(found), read, strict=True)]
    return out


@dataclass(frozen=True)
class Node:
    feature: int = -1
    bound: float = 0.0
    below: Node | None = None
    above: Node | None = None
    label: int = 0


def grow(rows: list[tuple[float, ...]]) -> Node:
    """A decision tree by greatest Gini gain; ties go to the first of FEATURES."""
    share = sum(r[-1] for r in rows) / max(1, len(rows))
    gini = lambda part: (p := sum(r[-1] for r in part) / len(part)) * (1 - p) * len(part)
    best = None
    for feature in range(len(FEATURES)) if 0 < share < 1 else ():
        values = sorted({r[feature] for r in rows})
        for low, high in zip(values, values[1:], strict=False):
            bound = (low + high) / 2
            left, right = [r for r in rows if r[feature] < bound], [r for r in rows if r[feature] >= bound]
            cost = gini(left) + gini(right)
            if best is None or cost < best[0] - 1e-12:
                best = (cost, feature, bound, left, right)
    if best is None:
        return Node(label=round(share))
    _, feature, bound, left, right = best
    return Node(feature, bound, grow(left), grow(right))


@lru_cache(maxsize=1)
def tree() -> Node:
    return grow(labelled())


def is_main(block: Features, node: Node) -> bool:
    while node.feature >= 0:
        node = node.below if block[node.feature] < node.bound else node.above
    return bool(node.label)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    beside: bool
    in_main: bool
    heading: bool

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def features(found: list[Block]) -> Iterator[Features]:
    """FEATURES of each block of a page; where a neighbour lacks, it has no words and no links."""
    none = Block("", 0, 0, False, False, False)
    has_main = float(any(b.in_main for b in found))
    for before, b, after in zip([none, *found], found, [*found[1:], none], strict=False):
        yield (
            float(b.words), b.density, float(before.words), before.density, float(after.words), after.density,
            float(b.beside), float(b.in_main), has_main, float(b.heading),
        )


class _Open:
    """The open elements that matter, and how many of them are beside or main."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, bool]] = []
        self.names: dict[str, int] = {}
        self.beside = self.main = 0

    def push(self, name: str, beside: bool, main: bool) -> None:
        self.stack.append((name, beside, main))
        self.names[name] = self.names.get(name, 0) + 1
        self.beside += beside
        self.main += main

    def pop(self) -> None:
        name, beside, main = self.stack.pop()
        self.names[name] -= 1
        self.beside -= beside
        self.main -= main

    def close(self, name: str) -> None:
        """Close the innermost element of this name, and what is open in it."""
        if self.names.get(name):
            while self.stack[-1][0] != name:
                self.pop()
            self.pop()

    def imply_end(self, name: str) -> None:
        """A new block ends an open paragraph; a new item ends the one before."""
        while self.stack and (self.stack[-1][0] == "p" or self.stack[-1][0] == name == "li"):
            self.pop()


def _role(name: str, attributes: str, in_main: bool) -> tuple[bool, bool]:
    """Whether an element encloses what is beside the main text, or the main text."""
    named = " ".join(next(filter(None, a.groups()[1:]), "") for a in _ATTRIBUTE.finditer(attributes)) if len(attributes) > 1 else ""
    main = name in MAIN or bool(named and name in ("div", "section") and MAIN_NAME.search(named))
    if name in BESIDE or name == "head" or name == "header" and not in_main or len(attributes) > 1 and _HIDDEN.search(attributes):
        return True, False
    if not named or name in ("body", "html", "main") or main and name != "article":
        return False, main
    beside = bool((_COMMENT_NAME if name == "article" else BESIDE_NAME).search(named))
    return beside, main and not beside


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in order."""
    out: list[Block] = []
    opened = _Open()
    parts: list[tuple[str, bool]] = []
    in_link = heading = False
    unclosed: set[str] = set()  # of which no closing tag follows any more

    def flush() -> None:
        text = " ".join(html.unescape("".join(p for p, _ in parts)).split())
        if text:
            n = len(text.split(" "))
            linked = sum(len(html.unescape(p).split()) for p, inside in parts if inside)
            out.append(Block(text, n, min(n, linked), opened.beside > 0, opened.main > 0, heading))
        parts.clear()

    at = text_from = 0
    broken = False  # a quote was found that isn't closed
    while match := _OPENING.search(page, at):
        begin, at = match.start(), match.end()
        name, closing, rest = (match[3] or "").lower(), bool(match[2]), ""
        if match[1]:
            end = page.find("-->", at - 2 if page.startswith("<!-->", begin) else at)
            end = len(page) if end < 0 else end + 3
        else:
            end = at if broken or not name else _REST.match(page, at).end()
            if broken or page[end : end + 1] != ">":
                broken = broken or "<" in page[at:end]
                end = _PLAIN_REST.match(page, at).end()
            if page[end : end + 1] == "<":  # no tag after all
                continue
            if end == len(page):
                name = ""
            end = min(len(page), end + 1)
            rest = page[at:end]
        if begin > text_from:
            parts.append((page[text_from:begin], in_link))
        at = text_from = end
        if not name:
            continue
        if name in RAW:
            if not closing and not rest.endswith("/>"):
                close = None if name in unclosed else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                if close is not None:
                    at = text_from = close.end()
                    continue
                unclosed.add(name)
                if name in ("script", "style", "textarea", "title"):
                    at = text_from = len(page)
            continue
        if name == "a":
            in_link = not closing
        elif name == "br":
            parts.append((" ", False))
        if name in INLINE or name in VOID and name != "hr":
            continue
        flush()
        in_link = False
        heading = not closing and name in ("h1", "h2", "h3", "h4", "h5", "h6")
        if closing:
            opened.close(name)
        elif name != "hr":
            opened.imply_end(name)
            beside, main = _role(name, rest, opened.main > 0)
            if beside or main or name in _CONTAINERS:
                opened.push(name, beside, main)
    parts.append((page[text_from:], in_link))
    flush()
    return out


#: Elements whose closing tag may have to be told from that of an enclosing one of the same name.
_CONTAINERS = frozenset("div section article main header footer nav aside form ul ol dl table tbody tr td menu dialog blockquote figure details head body html p li".split())  # noqa: SIM905


def main_text(page: str | None) -> str:
    """The main text of a page: its blocks joined by an empty line."""
    found, root = blocks(page or ""), tree()
    return "\n\n".join(b.text for b, f in zip(found, features(found), strict=True) if is_main(f, root))


def extract(pages: DataFrame, keep: list[str], column: str = "html") -> DataFrame:
    """pages' columns ``keep`` plus text and n_chars.  A map over the scan, without a shuffle."""
    reserved(keep, "__html", "text", "n_chars")
    small_batches(pages.sparkSession)

    def batches(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = [main_text(x.as_py()) for x in batch.column("__html")]
            rest = batch.drop_columns(["__html"])
            yield rest.append_column("text", pa.array(texts, pa.string())).append_column("n_chars", pa.array([len(x) for x in texts], pa.int64()))

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema]
    return pages.select(*keep, pages[column].alias("__html")).mapInArrow(batches, ", ".join([*fields, "text string", "n_chars bigint"]))
