"""Visible lines, title and blocks of stored HTML.

What a style sheet hides is not known offline; what an element's own attributes hide is left out with all that it holds.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements whose text is taken as lines, in the order in which they are given; elements without
# visible text; elements without content; elements that stand on lines of their own; and the least length of text
# that is not taken.
BLOCKS = "P H1 H2 H3 H4 H5 H6 LI TD TH FIGCAPTION BLOCKQUOTE LABEL BUTTON A SPAN DIV".lower().split()
UNSEEN = frozenset("script style noscript template head title".split())
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
BREAKS = frozenset("p h1 h2 h3 h4 h5 h6 li td th dt dd blockquote figcaption div section article ul ol table tr br nav footer header main form".split())
LONGEST = 8000
_WANTED = frozenset(BLOCKS)
_SPACE = re.compile(r"\s+")
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.IGNORECASE)
_FAINT = re.compile(r"(?:^|;)\s*opacity\s*:\s*(?:0?\.0[0-4]\d*|0(?:\.0*)?)\s*(?:;|$)", re.IGNORECASE)


class _Reader(HTMLParser):
    """Collects the texts of wanted elements, in the order in which they begin, and blocks of main.

    All visible text is kept once; an element knows where its text begins, and only texts that are short
    enough are put together, so the work does not grow with depth. Length is that of the text as it shows, with
    runs of white space as one.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[dict] = []
        self.open: Counter[str] = Counter()
        self.parts: list[str] = []
        self.size = self.unseen = 0
        self.last = "\n"
        self.alts: list[str] = []
        self.main_open = self.main_seen = False
        self.texts: dict[int, str] = {}
        self.begun = 0
        self.blocks: list[dict] = []
        self.is_eds, self.sections, self.title = False, 0, ""

    @property
    def lines(self) -> list[str]:
        return self.all_lines(False)

    def all_lines(self, alt: bool) -> list[str]:
        """Distinct lines of two characters or more; the descriptions of images come behind all others."""
        found: dict[str, None] = {}
        parts = (part for k in sorted(self.texts) for part in self.texts[k].split("\n"))
        for part in (*parts, *(self.alts if alt else ())):
            line = " ".join(part.split())
            if len(line) >= 2:
                found.setdefault(line)
        return list(found)

    def handle_starttag(self, tag, attrs):
        told = dict(attrs)
        if tag in ("p", "li") and self.stack and self.stack[-1]["tag"] == tag:
            self.handle_endtag(tag)  # an open paragraph or item ends where the next begins
        if tag in BREAKS:
            self._add("\n")
        if self.stack and self.stack[-1]["main"]:
            self.sections += 1
        style = told.get("style") or ""
        hides = tag in UNSEEN or "hidden" in told or bool(_HIDING.search(style))
        if tag == "img" and not hides and not self.unseen and told.get("alt"):
            self.alts.append(told["alt"])
        if tag in EMPTY:
            return
        names = (told.get("class") or "").split()
        named = "data-block-name" in told
        block = None
        if self.main_open and (named or "block" in names):
            self.is_eds |= named
            if not any(e["block"] is not None for e in self.stack):
                block = told.get("data-block-name") or next((n for n in names if n != "block"), "block")
                self.blocks.append({"name": block, "lines": 0})
                block = len(self.blocks) - 1
        self.begun += 1
        self.open[tag] += 1
        self.unseen += hides
        main = tag == "main" and not self.main_seen  # any further one is not looked at
        if main:
            self.main_open = self.main_seen = True
        self.stack.append(
            {"tag": tag, "first": len(self.parts), "from": self.size, "begun": self.begun, "block": block, "main": main, "hides": hides, "faint": bool(_FAINT.search(style))}
        )

    def handle_endtag(self, tag):
        if tag in BREAKS:
            self._add("\n")
        if not self.open[tag]:
            return
        while self.stack:
            e = self.stack.pop()
            self.open[e["tag"]] -= 1
            seen = not self.unseen
            self.unseen -= e["hides"]
            if e["main"]:
                self.main_open = False
            if e["tag"] in _WANTED and seen and not e["faint"] and self.size - (self.last in " \n") - e["from"] < LONGEST:
                self.texts[e["begun"]] = "".join(self.parts[e["first"] :])
            if e["block"] is not None:
                said = "".join(self.parts[e["first"] :])
                self.blocks[e["block"]]["lines"] = sum(bool(x.strip()) for x in said.split("\n"))
            if e["tag"] == tag:
                break

    def handle_data(self, data):
        if self.unseen:
            if self.stack[-1]["tag"] == "title" and not self.title:
                self.title = " ".join(data.split())
            return
        self._add(data.replace("\n", " "))

    def _add(self, data):
        if self.unseen:
            return
        self.parts.append(data)
        shown = "\n" if data == "\n" else _SPACE.sub(" ", data)
        if shown[:1] in (" ", "\n") and self.last in (" ", "\n"):
            self.last = "\n" if shown[0] == "\n" else self.last
            shown = shown[1:]
        self.size += len(shown)
        self.last = shown[-1] if shown else self.last

    def done(self):
        self.close()
        while self.stack:
            self.handle_endtag(self.stack[-1]["tag"])
        return self


def read_page(html: str) -> _Reader:
    reader = _Reader()
    reader.feed(html)
    return reader.done()


def page_lines(pages: DataFrame, alt: bool = False) -> DataFrame:
    """page_id, ord, line of each page's distinct visible lines, as their elements begin; with ``alt`` also what images are said to show."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = [(i, n, line) for i, h in zip(part["page_id"], part["html"], strict=True) for n, line in enumerate(read_page(h or "").all_lines(alt))]
            yield pd.DataFrame(rows, columns=["page_id", "ord", "line"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, ord int, line string")


def page_blocks(pages: DataFrame) -> DataFrame:
    """is_eds, sections and named blocks of each page's main element, in document order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for i, h in zip(part["page_id"], part["html"], strict=True):
                r = read_page(h or "")
                rows.append((i, r.is_eds, r.sections, [b["name"] for b in r.blocks], [b["lines"] for b in r.blocks]))
            yield pd.DataFrame(rows, columns=["page_id", "is_eds", "sections", "names", "line_counts"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, is_eds boolean, sections int, names array<string>, line_counts array<int>")


def titles(pages: DataFrame) -> DataFrame:
    """S7."""
    title = F.trim(F.regexp_replace(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    return pages.select("page_id", title.alias("title"))
