"""Personal data in texts, also where it is disguised.

Base spans are exact matches per kind in the text as it is. For disguised ones two transducers rewrite the text: the first turns
look-alike characters into ASCII and drops invisible ones, the second turns spelled digits, "plus", and at and dot
disguises into the characters they stand for. Each keeps its pieces as (place in its output, place in its input), so
spans found in the last output are mapped back to source characters through both.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from pagelattice.llm.common import id_and_text, map_rows

KINDS = ("email", "ip", "card", "phone")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

# Fixed values of the contract: the classes and patterns of the four kinds.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: The contract's pattern; a match can only begin where a run of digits does, since what follows the run decides.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int]


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches: the run of local characters before an @ that a domain follows."""
    floor, at = 0, text.find("@")
    while at >= 0:
        run = text[floor:at]
        start = floor + len(run.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        floor = m.end() if m else at + 1  # no local part reaches over an @
        at = text.find("@", floor)


def addresses(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            yield m.span()


def luhn(digits: str) -> bool:
    back = [int(c) for c in reversed(digits)]
    return (sum(back[::2]) + sum(sum(divmod(2 * d, 10)) for d in back[1::2])) % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            yield m.span()


FINDERS: dict[str, Callable[[str], Iterator[Span]]] = {"email": emails, "ip": addresses, "card": cards, "phone": phones}


class Rewritten:
    """A transducer's output, with the way back to its input."""

    def __init__(self, source: str, changes: Iterator[tuple[int, int, str]]):
        """``changes``: (start, end, replacement) by rising, separate places."""
        parts, self.begins, self.origins, at, length = [], [], [], 0, 0
        for start, end, new in changes:
            for piece, origin in ((source[at:start], (at, None)), (new, (start, end))):
                if piece:
                    parts.append(piece)
                    self.begins.append(length)
                    self.origins.append(origin)
                    length += len(piece)
            at = end
        if at < len(source):
            parts.append(source[at:])
            self.begins.append(length)
            self.origins.append((at, None))
        self.text = "".join(parts)

    def _piece(self, at: int) -> int:
        return bisect.bisect_right(self.begins, at) - 1

    def back(self, start: int, end: int) -> Span:
        """The smallest span of the input whose rewriting covers the output's span."""
        first, last = self._piece(start), self._piece(end - 1)
        (a, replaced), (b, until) = self.origins[first], self.origins[last]
        return (a if replaced is not None else a + start - self.begins[first]), (until if until is not None else b + end - self.begins[last])


#: Letters of other scripts that look like the ASCII letter behind them.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M",
    "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɡ": "g",
}
#: Signs that stand for an ASCII one.
SIGNS = {"﹫": "@", "․": ".", "。": ".", "．": ".", "‧": ".", "∙": ".", "﹒": ".", "﹢": "+", "⁺": "+", "﹣": "-", "−": "-", "⁄": "/", "【": "[", "】": "]"}
INVISIBLE = "­​‌‍⁠﻿"


def _glyphs() -> dict[str, str]:
    table = LOOKALIKES | SIGNS | dict.fromkeys(INVISIBLE, "")
    table |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    table |= {chr(c): "-" for c in range(0x2010, 0x2016)}
    table |= {chr(c): " " for c in (0xA0, 0x202F, 0x205F, 0x3000, *range(0x2000, 0x200B))}
    digits = (c for c in map(chr, range(0x80, 0x1FBFA)) if unicodedata.category(c) == "Nd")
    return {c: str(unicodedata.decimal(c)) for c in digits} | table


GLYPHS = _glyphs()
_GLYPH = re.compile("[" + re.escape("".join(GLYPHS)) + "]")

#: Spelled digits of the corpus' four languages.
DIGIT_WORDS = {
    w: str(n)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for n, w in enumerate(words.split())
}
_WORD = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
#: A row of at least four spelled digits, with digits and dots between them, perhaps behind a plus. Runs end at any other word.
_SPELLED = re.compile(
    rf"(?<![^\W_])(?:(?:plus|\+)[\x20-]*)?{_WORD}(?:(?:[\x20,-]{{1,2}}|[\x20]+(?:dot|punkt|point|punto)[\x20]+)(?:{_WORD}|[0-9]+)(?![^\W_])){{3,}}", re.IGNORECASE
)
_SPELLED_PART = re.compile(rf"{_WORD}|[0-9]+|plus|\+|dot|punkt|point|punto", re.IGNORECASE)
_AT = r"(?:at|ät|arroba|arobase|@)"
_DOT = r"(?:dot|punkt|point|punto|\.)"
_BRACKETED = re.compile(rf"[\x20\t]*([\[({{<])[\x20\t]*(?:({_AT})|{_DOT})[\x20\t]*[\])}}>][\x20\t]*", re.IGNORECASE)
#: Bare "name at host dot zone": the words count only together.
_BARE = re.compile(
    r"(?<![^\W_])[A-Za-z0-9_%+-]+(?:[\x20]+dot[\x20]+[A-Za-z0-9_%+-]+)*([\x20]+at[\x20]+)[A-Za-z0-9-]+(?:(?:[\x20]+dot[\x20]+|\.)[A-Za-z0-9-]+)+", re.IGNORECASE
)
_BARE_PART = re.compile(r"[\x20]+(at|dot)[\x20]+", re.IGNORECASE)


def plain_characters(text: str) -> Rewritten:
    """First transducer: look-alikes to ASCII, invisible characters out."""
    return Rewritten(text, ((m.start(), m.end(), GLYPHS[m[0]]) for m in _GLYPH.finditer(text)))


def _spoken(text: str) -> Iterator[tuple[int, int, str]]:
    lower = text.lower()
    for run in _SPELLED.finditer(text):
        parts = list(_SPELLED_PART.finditer(text, *run.span()))
        for m in parts:
            word = m[0].lower()
            yield m.start(), m.end(), DIGIT_WORDS.get(word) or ("+" if word in ("plus", "+") else m[0] if word.isdigit() else ".")
        yield from ((a.end(), b.start(), "") for a, b in zip(parts, parts[1:], strict=False) if a.end() < b.start())
    yield from ((m.start(), m.end(), "@" if m[2] else ".") for m in _BRACKETED.finditer(text))
    if " at " in lower and " dot " in lower:
        for run in _BARE.finditer(text):
            if " dot " in run[0].lower():
                yield from ((m.start(), m.end(), "@" if m[1].lower() == "at" else ".") for m in _BARE_PART.finditer(text, *run.span()))


def spoken_characters(text: str) -> Rewritten:
    """Second transducer: spelled digits and at and dot disguises to the characters they stand for. Of overlapping changes the first counts."""
    changes, reached = [], 0
    for start, end, new in sorted(_spoken(text)):
        if start >= reached:
            changes.append((start, end, new))
            reached = end
    return Rewritten(text, iter(changes))


def scan(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans by kind, and the further ones that only the rewritten text shows; code points, end exclusive."""
    base = {kind: list(find(text)) for kind, find in FINDERS.items()}
    added: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    first = plain_characters(text) if not text.isascii() else Rewritten(text, iter(()))
    second = spoken_characters(first.text)
    if second.text == text:
        return base, added
    for kind, find in FINDERS.items():
        taken = sorted(base[kind])
        for a, b in find(second.text):
            start, end = first.back(*second.back(a, b))
            at = bisect.bisect_left(taken, (start, start))
            clear = (at == len(taken) or taken[at][0] >= end) and (at == 0 or taken[at - 1][1] <= start)
            if clear and text[start:end] != second.text[a:b]:
                added[kind].append((start, end))
    return base, added


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in sorted(spans[kind]))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Counts of base spans, their digest, all spans, and how many of them only the rewritten text shows, for each row's whole text.

    A null or empty text has none: zeros, the digest of the empty text, an empty string. Repeated rows give repeated
    results, null ids stay null, an empty table gives no rows, other columns are ignored. Texts of any length are read
    whole, in time that grows with their length. No shuffle.
    """

    def make():
        def step(rows: dict) -> dict:
            found = [scan(t) for t in rows["text"]]
            out = {f"n_{kind}": [len(base[kind]) for base, _ in found] for kind in KINDS}
            return {"doc_id": rows["doc_id"]} | out | {
                "base_sha256": [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found],
                "spans": [joined({k: base[k] + more[k] for k in KINDS}) for base, more in found],
                "n_added": [sum(map(len, more.values())) for _, more in found],
            }

        return step

    return map_rows(id_and_text(docs), SCHEMA, make)
