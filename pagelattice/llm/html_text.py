"""Main text of web pages from flat text blocks and a decision tree.

A page is flattened to blocks of text. A block is described by its words, its link density, those of
its two neighbours, and by where it stands; a classification tree, grown from the small labelled table
below, tells main text from boilerplate. Where elements tell nothing, words and link densities decide.

Where a block stands is told by elements (nav, footer, article ...) and by whole tokens of class, id and
role. A word that names a box of its own (ads, comments, newsletter ...) counts in any company, so "google-ads"
and "td-related-title" count; others count if all parts of the token are such words or say no more than a
position, so "site-footer" counts and "form-follows-function" does not. Tokens that deny ("no-sidebar"), file a page under
something ("category-privacy") or name a layout ("content-sidebar-wrap") tell nothing. Tokens of html, body,
main and article are no sign of boilerplate. What stands in boilerplate is boilerplate, but for ``main``.
"""

from __future__ import annotations

import functools
import html
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.common import map_rows

SCHEMA = "page_id long, url string, text string, n_chars long"

# Names of elements by what they mean for text.
#: Elements whose content is text to the parser, up to their end tag or the end of the page.
RAW = "script style title textarea".split()
#: Other elements whose content is no text of the page; one that is not closed is read over.
DROPPED = "noscript template svg math select button iframe object canvas audio video datalist".split()
#: Elements that stand in a line of text and do not part blocks.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
#: Elements that hold others and are followed on the way to a block.
CONTAINERS = frozenset(
    "html head body div section article main nav header footer aside form ul ol li dl table figure blockquote dialog details "
    "fieldset center td".split()
)
#: Containers of boilerplate, and of main text.
AWAY, TOWARDS = frozenset("nav footer aside form dialog".split()), frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold the page as a whole; what their names say holds for no part of it.
ROOTS = frozenset("html head body".split())
#: Elements that end an open one of their kind in the same list.
LISTS = frozenset("ul ol".split())
#: Words of class, id and role tokens that tell boilerplate.
AWAY_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner sidebar rail "
    "widget related recommended recommendations trending share sharing social follow cookie cookies consent gdpr privacy notice "
    "notification alert popup modal overlay toast paywall newsletter subscribe subscription signup login signin register menu nav "
    "navbar navigation breadcrumb breadcrumbs footer masthead toolbar pager pagination copyright legal disclaimer search form "
    "contentinfo complementary skip tags".split()
)
#: Such words of reader comments, which hold whatever stands inside.
COMMENT_WORDS = frozenset("comment comments commentlist respond disqus reply replies discussion".split())
#: Such words of main text.
TOWARDS_WORDS = frozenset("article post entry story articlebody".split())
#: Words of boilerplate and of reader comments that count whatever stands beside them in a token.
BOX_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored outbrain taboola addthis addtoany sidebar "
    "related recommended recommendations share sharing sharedaddy social cookie cookies consent gdpr popup modal paywall newsletter "
    "subscribe subscription signup breadcrumb breadcrumbs navbar pagination".split()
)
COMMENT_BOX_WORDS = frozenset("comment comments commentlist disqus".split())
#: Words that deny or join, and first words that file a page under something.
DENIALS = frozenset("no not non has have with without and hide free".split())
FILED = frozenset("category tag tags topic type format postid".split())
#: Such words that say no more than where or in what shape something stands.
POSITION_WORDS = frozenset(
    "site page main global primary secondary top bottom left right inner outer block box area section container wrapper wrap "
    "content body text bar list links link header item items slot unit posts articles stories form panel column col".split()
)

_PART = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?:svg|math)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*/>|"
    rf"<(?P<raw>{'|'.join(RAW)})(?=[\s/>]).*?(?:</(?P=raw)\s*>|\Z)|<(?P<drop>{'|'.join(DROPPED)})(?=[\s/>]).*?</(?P=drop)\s*>|"
    r"<(?P<close>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?=>)|[^>]*)(?:>|\Z)|"
    r"<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.I | re.S,
)
_NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none", re.I)
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_BETWEEN = re.compile(r"[^a-z]+")

NEUTRAL, MAIN, BOILERPLATE, COMMENTS = 0, 1, -1, -2


@dataclass
class Block:
    text: str
    words: int
    linked: int
    place: int
    heading: bool

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


@functools.lru_cache(1 << 14)
def _told(token: str) -> int:
    """What one token of class, id or role tells."""
    ordered = [p for p in _BETWEEN.split(_HUMP.sub("-", token).lower()) if p]
    parts = frozenset(ordered)
    layout = "sidebar" in parts and ordered[0] == "content"
    if parts & DENIALS or layout or (len(ordered) > 1 and ordered[0] in FILED):
        return NEUTRAL
    if parts & COMMENT_BOX_WORDS:
        return COMMENTS
    if parts & BOX_WORDS:
        return BOILERPLATE
    for words, place in ((COMMENT_WORDS, COMMENTS), (AWAY_WORDS, BOILERPLATE), (TOWARDS_WORDS, MAIN)):
        if parts & words and parts <= words | POSITION_WORDS | (AWAY_WORDS if place == COMMENTS else set()):
            return place
    return NEUTRAL


def _place_of(tag: str, rest: str, outer: int) -> int:
    """What an opened element makes of the blocks in it."""
    if outer == COMMENTS or tag in ROOTS:
        return outer
    told = {_told(t) for found in _NAMES.findall(rest) for t in "".join(found).split()} if rest else set()
    hidden = rest and _HIDDEN.search(rest)
    if tag in TOWARDS and not hidden:
        return MAIN if tag == "main" or outer != BOILERPLATE else outer
    if COMMENTS in told:
        return COMMENTS
    if tag in AWAY or BOILERPLATE in told or hidden or outer == BOILERPLATE:
        return BOILERPLATE
    if tag == "header" and outer != MAIN:
        return BOILERPLATE
    return MAIN if MAIN in told else outer


def blocks(page: str) -> list[Block]:
    """Blocks that have text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []
    opened: dict[str, int] = {}
    place, heading, links = NEUTRAL, False, 0
    own: int | None = None  # what an element that is no container makes of its one block
    held: list[tuple[str, bool]] = []

    def end() -> None:
        if held:
            # a reference that tags interrupt is none, so pieces are decoded before they are joined
            pieces = [(html.unescape(t) if "&" in t else t, linked) for t, linked in held]
            held.clear()
            words = " ".join("".join(t for t, _ in pieces).split())
            if words:
                linked = sum(len(t.split()) for t, a in pieces if a)
                n = words.count(" ") + 1
                out.append(Block(words, n, min(n, linked), place if own is None else own, heading))

    for m in _PART.finditer(page):
        text = m["text"]
        if text is not None:
            held.append((text, links > 0))
            continue
        tag = m["tag"]
        if tag is None:
            if (m["raw"] or "").lower() == "title":
                end()
            continue
        tag, closing = tag.lower(), bool(m["close"])
        if tag in INLINE:
            if tag == "a":
                links = max(0, links - 1) if closing else links + 1
            continue
        end()
        own = None
        if not closing:
            links = 0  # a link never spans blocks; one left open ends here
        if tag in HEADINGS:
            heading = not closing
        elif tag == "p":
            heading = False
        if tag in CONTAINERS:
            heading = False
            if not closing:
                if tag == "li":  # ends the item before it
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] in LISTS:
                            break
                        if stack[k][0] == "li":
                            place = stack[k][1]
                            for name, _ in stack[k:]:
                                opened[name] -= 1
                            del stack[k:]
                            break
                if not m["rest"].endswith("/"):
                    stack.append((tag, place))
                    opened[tag] = opened.get(tag, 0) + 1
                    place = _place_of(tag, m["rest"], place)
            elif opened.get(tag):
                while True:
                    name, place = stack.pop()
                    opened[name] -= 1
                    if name == tag:
                        break
        elif not closing and m["rest"]:
            own = _place_of(tag, m["rest"], place)
    end()
    return out


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "place", "heading")

# The labelled table: the features above, and whether such a block is main text. Places: 1 in an article
# or main element, 0 elsewhere, -1 in an element of boilerplate, -2 among reader comments.
LABELLED = (
    # in articles, of any length
    (12, 0.0, 0, 0.0, 80, 0.0, 1, 1, 1), (1, 0.0, 60, 0.0, 55, 0.0, 1, 0, 1), (3, 0.0, 90, 0.0, 4, 0.0, 1, 0, 1),
    (75, 0.0, 12, 0.0, 120, 0.1, 1, 0, 1), (140, 0.05, 75, 0.0, 6, 0.0, 1, 0, 1), (6, 0.5, 140, 0.0, 7, 0.3, 1, 0, 1),
    (9, 1.0, 70, 0.0, 88, 0.0, 1, 0, 1), (4, 1.0, 5, 1.0, 60, 0.0, 1, 0, 1), (230, 0.0, 3, 0.0, 18, 0.9, 1, 0, 1),
    (2, 0.0, 8, 1.0, 10, 0.0, 1, 0, 1), (15, 0.2, 3, 1.0, 22, 0.0, 1, 0, 1), (5, 0.0, 6, 0.0, 12, 0.1, 1, 1, 1),
    (10, 0.0, 60, 0.0, 3, 1.0, 1, 0, 1), (4, 1.0, 4, 1.0, 5, 1.0, 1, 0, 1), (2, 0.5, 2, 1.0, 2, 1.0, 1, 0, 1),
    (12, 0.0, 1, 1.0, 60, 0.0, 1, 0, 1), (9, 0.0, 1, 0.9, 30, 0.0, 1, 0, 1), (30, 0.0, 1, 1.0, 14, 0.0, 1, 0, 1),
    (20, 0.8, 1, 1.0, 25, 0.0, 1, 0, 1), (6, 0.0, 1, 1.0, 11, 0.0, 1, 0, 1),
    (5, 0.0, 80, 0.0, 0, 0.0, 1, 0, 1), (40, 0.0, 90, 0.0, 0, 0.0, 1, 0, 1), (12, 0.0, 100, 0.0, 8, 0.0, 1, 0, 1),
    (9, 0.0, 160, 0.0, 4, 1.0, 1, 0, 1), (30, 0.0, 150, 0.2, 11, 0.2, 1, 0, 1), (8, 0.6, 120, 0.0, 9, 0.0, 1, 0, 1),
    # in menus, footers, sidebars, forms, adverts and notices
    (1, 1.0, 0, 0.0, 1, 1.0, -1, 0, 0), (2, 1.0, 1, 1.0, 2, 1.0, -1, 0, 0), (5, 0.0, 3, 1.0, 14, 0.0, -1, 0, 0),
    (40, 0.0, 150, 0.0, 0, 0.0, -1, 0, 0), (120, 0.0, 90, 0.0, 60, 0.0, -1, 0, 0), (22, 0.3, 45, 0.0, 3, 1.0, -1, 0, 0),
    (7, 0.0, 1, 1.0, 11, 0.0, -1, 1, 0), (300, 0.0, 20, 0.0, 15, 0.0, -1, 0, 0), (12, 0.0, 80, 0.0, 200, 0.0, -1, 0, 0),
    (60, 0.0, 70, 0.0, 80, 0.0, -1, 0, 0), (150, 0.0, 120, 0.0, 90, 0.0, -1, 0, 0), (90, 0.1, 0, 0.0, 45, 0.0, -1, 0, 0),
    (200, 0.0, 8, 0.0, 33, 0.0, -1, 0, 0), (50, 0.0, 30, 0.0, 150, 0.0, -1, 1, 0), (4, 0.0, 60, 0.0, 70, 0.0, -1, 0, 0),
    # reader comments
    (35, 0.0, 4, 0.5, 3, 0.0, -2, 0, 0), (150, 0.0, 5, 0.0, 60, 0.0, -2, 0, 0), (3, 0.7, 80, 0.0, 35, 0.0, -2, 0, 0),
    (2, 0.0, 90, 0.0, 4, 0.0, -2, 1, 0), (80, 0.0, 60, 0.0, 95, 0.0, -2, 0, 0), (8, 0.0, 45, 0.0, 65, 0.0, -2, 0, 0),
    (55, 0.1, 12, 0.0, 34, 0.0, -2, 0, 0),
    # no element tells: long text with few links is main text
    (60, 0.0, 10, 0.0, 75, 0.0, 0, 0, 1), (35, 0.05, 60, 0.0, 50, 0.0, 0, 0, 1), (90, 0.1, 3, 1.0, 40, 0.0, 0, 0, 1),
    (45, 0.0, 2, 1.0, 0, 0.0, 0, 0, 1), (28, 0.0, 80, 0.0, 5, 0.9, 0, 0, 1), (150, 0.2, 70, 0.0, 65, 0.0, 0, 0, 1),
    (55, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (24, 0.0, 30, 0.0, 33, 0.0, 0, 0, 1), (20, 0.0, 50, 0.0, 60, 0.1, 0, 0, 1),
    (50, 0.0, 1, 0.0, 90, 0.0, 0, 0, 1), (40, 0.0, 0, 0.0, 60, 0.0, 0, 0, 1), (70, 0.0, 1, 1.0, 85, 0.0, 0, 0, 1),
    (120, 0.0, 1, 0.0, 40, 0.1, 0, 0, 1), (33, 0.0, 1, 0.0, 35, 0.0, 0, 0, 1), (26, 0.0, 1, 0.0, 45, 0.0, 0, 0, 1),
    (26, 0.0, 2, 1.0, 50, 0.0, 0, 0, 1), (30, 0.0, 1, 1.0, 80, 0.0, 0, 0, 1), (24, 0.0, 3, 1.0, 34, 0.0, 0, 0, 1),
    # short text with long neighbours, and headings before text
    (8, 0.0, 70, 0.0, 80, 0.0, 0, 0, 1), (3, 0.0, 60, 0.1, 45, 0.0, 0, 0, 1), (12, 0.1, 40, 0.0, 52, 0.0, 0, 0, 1),
    (7, 0.0, 2, 1.0, 65, 0.0, 0, 1, 1), (5, 0.0, 0, 0.0, 48, 0.0, 0, 1, 1), (9, 0.0, 55, 0.0, 38, 0.0, 0, 1, 1),
    (11, 0.0, 45, 0.0, 10, 0.0, 0, 0, 1), (9, 0.0, 12, 0.0, 58, 0.0, 0, 0, 1),
    (40, 0.0, 90, 0.0, 0, 0.0, 0, 0, 1), (25, 0.0, 120, 0.0, 6, 0.0, 0, 0, 1), (35, 0.0, 100, 0.0, 9, 0.0, 0, 0, 1),
    # the last text before links, and the links behind it
    (28, 0.0, 40, 0.0, 3, 1.0, 0, 0, 1), (60, 0.0, 12, 0.0, 3, 1.0, 0, 0, 1), (45, 0.0, 130, 0.0, 2, 1.0, 0, 0, 1),
    (100, 0.0, 55, 0.1, 6, 1.0, 0, 0, 1), (90, 0.0, 2, 1.0, 3, 1.0, 0, 0, 1), (3, 1.0, 90, 0.0, 3, 1.0, 0, 0, 0),
    (3, 1.0, 120, 0.0, 2, 1.0, 0, 0, 0), (2, 1.0, 60, 0.0, 2, 1.0, 0, 0, 0), (5, 0.9, 100, 0.0, 4, 0.8, 0, 0, 0),
    # short text among text without links: facts, lists and short paragraphs
    (5, 0.0, 6, 0.0, 4, 0.0, 0, 0, 1), (2, 0.0, 3, 0.0, 2, 0.0, 0, 0, 1), (4, 0.0, 0, 0.0, 9, 0.0, 0, 0, 1),
    (8, 0.0, 12, 0.0, 0, 0.0, 0, 0, 1), (10, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (1, 0.0, 2, 0.0, 5, 0.0, 0, 0, 1),
    (1, 0.0, 1, 0.0, 1, 0.0, 0, 0, 1), (3, 0.0, 2, 0.0, 60, 0.0, 0, 0, 1), (2, 0.0, 20, 0.0, 3, 0.0, 0, 0, 1),
    (14, 0.0, 2, 0.0, 11, 0.0, 0, 0, 1), (2, 0.0, 0, 0.0, 3, 0.0, 0, 1, 1), (11, 0.0, 9, 0.0, 0, 0.0, 0, 0, 1),
    # links, and short text beside links or at the end of long text, are boilerplate
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0), (3, 1.0, 0, 0.0, 2, 1.0, 0, 0, 0), (2, 1.0, 2, 1.0, 60, 0.0, 0, 0, 0),
    (12, 0.8, 9, 1.0, 14, 0.9, 0, 0, 0), (30, 0.7, 20, 0.9, 25, 0.8, 0, 0, 0), (4, 0.0, 1, 1.0, 3, 1.0, 0, 0, 0),
    (6, 0.0, 2, 1.0, 7, 0.0, 0, 0, 0), (8, 0.1, 5, 0.0, 2, 1.0, 0, 0, 0), (5, 0.0, 80, 0.0, 0, 0.0, 0, 0, 0),
    (7, 0.2, 75, 0.0, 2, 1.0, 0, 0, 0), (4, 0.0, 0, 0.0, 6, 0.5, 0, 0, 0), (3, 0.0, 3, 1.0, 3, 1.0, 0, 1, 0),
    (4, 0.0, 50, 0.0, 2, 1.0, 0, 1, 0), (16, 0.6, 60, 0.0, 3, 1.0, 0, 0, 0), (9, 0.0, 1, 1.0, 12, 0.0, 0, 0, 0),
    (6, 0.4, 70, 0.0, 65, 0.0, 0, 0, 0), (14, 0.9, 1, 1.0, 60, 0.0, 0, 0, 0), (20, 1.0, 5, 0.8, 3, 0.0, 0, 0, 0),
    (12, 0.0, 3, 1.0, 4, 0.0, 0, 0, 0), (15, 0.0, 4, 0.3, 5, 0.0, 0, 0, 0), (13, 0.0, 0, 0.0, 3, 1.0, 0, 0, 0),
)


def grow(rows: np.ndarray, labels: np.ndarray, least: int = 1, depth: int = 10):
    """A tree of (feature, threshold, left, right), by the largest fall of Gini impurity; leaves are labels."""
    share = labels.mean()
    if depth == 0 or share in (0.0, 1.0) or len(labels) < 2 * least:
        return bool(share >= 0.5)
    best = None
    for f in range(rows.shape[1]):
        order = np.argsort(rows[:, f], kind="stable")
        x, y = rows[order, f], labels[order]
        n = np.arange(1, len(y))
        left, total = np.cumsum(y)[:-1], y.sum()
        p, q = left / n, (total - left) / (len(y) - n)
        impurity = (n * p * (1 - p) + (len(y) - n) * q * (1 - q)) / len(y)
        allowed = (x[1:] > x[:-1]) & (n >= least) & (len(y) - n >= least)
        if allowed.any():
            k = int(np.argmin(np.where(allowed, impurity, np.inf)))
            if best is None or impurity[k] < best[0] - 1e-12:
                best = (impurity[k], f, (x[k] + x[k + 1]) / 2)
    if best is None:
        return bool(share >= 0.5)
    _, f, at = best
    low = rows[:, f] <= at
    return f, float(at), grow(rows[low], labels[low], least, depth - 1), grow(rows[~low], labels[~low], least, depth - 1)


@functools.cache
def tree():
    """The tree of the labelled table; rows whose element tells what they are count five times."""
    table = np.array(LABELLED, float)
    table = np.repeat(table, np.where(table[:, 6] != 0, 5, 1), axis=0)
    return grow(table[:, :-1], table[:, -1])


def is_main(tree, row: tuple) -> bool:
    while not isinstance(tree, bool):
        f, at, low, high = tree
        tree = low if row[f] <= at else high
    return tree


def main_text(page: str) -> str:
    found = blocks(page)
    grown = tree()
    none = Block("", 0, 0, NEUTRAL, False)
    kept = []
    for before, b, after in zip([none, *found[:-1]], found, [*found[1:], none], strict=True) if found else ():
        row = (b.words, b.density, before.words, before.density, after.words, after.density, b.place, b.heading)
        if is_main(grown, row):
            kept.append(b.text)
    return "\n".join(kept)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, main text and its length for each row of ``pages`` (page_id, url, html).

    A null or empty html, or a page without main text, gives the empty text and 0. Repeated rows give
    repeated results, null ids and urls stay null, an empty table gives no rows, and other columns are
    ignored. Pages of any length are read whole. No shuffle.
    """

    def make():
        def step(rows: dict) -> dict:
            texts = [main_text(h) for h in rows["html"]]
            return {"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": [len(t) for t in texts]}

        return step

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    return map_rows(rows, SCHEMA, make)
