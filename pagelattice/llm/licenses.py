"""Licence scans: an Aho-Corasick automaton over words, and a shunting-yard reader of licence expressions.

Two kinds of needles share one automaton over the normalised words of a text: the base phrases, and
further notice phrases. Identifier tags ("SPDX-License-Identifier: ...") are found by a second
automaton in the raw lower-cased text, and the expression behind a tag is read by a shunting-yard
parser with the operators WITH, AND and OR, in falling order of precedence.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from pagelattice.llm.common import id_and_text, map_rows

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double, expression string, satisfiable_by string, n_unread long"
)

# Fixed values of the contract: phrase and label.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further phrases of licence notices, in the words they have after normalisation.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "the software is provided as is without warranty": "mit",
    "licensed under the mit": "mit",
    "licensed under the apache license": "apache-2",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons zero": "cc0",
    "all rights reserved": "all-rights-reserved",
    "released into the public domain": "public-domain",
}
TAG = "spdx-license-identifier:"
#: Identifiers as they stand in tags and the label each belongs to. Any other identifier is a label of its own.
WHOLE = {
    "mit": "mit", "mit-0": "mit", "apache-2": "apache-2", "apache-2.0": "apache-2", "isc": "isc", "unlicense": "public-domain",
    "bsd": "bsd", "0bsd": "bsd", "bsd-1-clause": "bsd", "bsd-2-clause": "bsd", "bsd-3-clause": "bsd",
}
#: Names that count with any version behind them; each is its label.
VERSIONED = frozenset(("apache", "gpl", "lgpl", "agpl", "mpl", "cc0", "cc-by", "cc-by-sa", "cc-by-nc", "cc-by-nd", "cc-by-nc-sa", "cc-by-nc-nd"))
#: Labels that allow commercial use without a duty to share alike.
PERMISSIVE = frozenset({"mit", "apache-2", "apache", "bsd", "isc", "cc0", "cc-by", "public-domain"})
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

#: Lower-cases A-Z and turns ASCII characters that are not of a word into spaces; other bytes stay.
_NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
_TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+\-]*|)")


class ExpressionError(ValueError):
    """The text is not a licence expression."""


def expression_tokens(text: str) -> list[str]:
    """Identifiers, operators and brackets from the start of ``text`` as far as they make sense."""
    out: list[str] = []
    at, depth, operand = 0, 0, True
    while True:
        m = _TOKEN.match(text, at)
        t = m[1]
        word = t.lower()
        if not t:
            break
        if operand:
            if word in PRECEDENCE or t == ")":
                break
            depth += t == "("
            operand = t == "("
        else:
            if t == ")":
                if not depth:
                    break
                depth -= 1
            elif word in PRECEDENCE:
                operand = True
            else:
                break
        out.append(word if word in PRECEDENCE else t)
        at = m.end()
    while out and (out[-1] in PRECEDENCE or out[-1] == "("):
        out.pop()
    return out


def to_postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: operators after their operands, operators of equal rank from left to right."""
    out: list[str] = []
    waiting: list[str] = []
    for t in tokens:
        if t in PRECEDENCE:
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[t]:
                out.append(waiting.pop())
            waiting.append(t)
        elif t == "(":
            waiting.append(t)
        elif t == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                raise ExpressionError("a bracket closes that was not opened")
            waiting.pop()
        else:
            out.append(t)
    while waiting:
        t = waiting.pop()
        if t != "(":  # a bracket that the line end cuts off counts as closed there
            out.append(t)
    return out


_VERSION = re.compile(r"(?:-v?[0-9]+(?:\.[0-9]+)*)?(?:-only|-or-later)?\+?$")


def family(identifier: str) -> str:
    """The label of a whole identifier, with or without a version; no mere beginning counts."""
    name = identifier.lower()
    plain = re.sub(r"(?:-only|-or-later)?\+?$", "", name)
    if plain in WHOLE:
        return WHOLE[plain]
    bare = _VERSION.sub("", name)
    return bare if bare in VERSIONED else name


def evaluated(postfix: list[str]) -> tuple[set[str], bool]:
    """All licences of an expression, and whether permissive ones alone can fulfil it.

    OR asks for either side and AND for both, so no list of the ways to fulfil it is needed. An exception
    changes neither label nor answer. Labels are gathered once, so time grows with the number of terms.
    """
    labels: list[str] = []
    stack: list[tuple[int, bool]] = []  # where a term's labels begin, and its answer
    for t in postfix:
        if t not in PRECEDENCE:
            stack.append((len(labels), family(t) in PERMISSIVE))
            labels.append(family(t))
            continue
        if len(stack) < 2:
            raise ExpressionError("an operator lacks an operand")
        right, left = stack.pop(), stack.pop()
        if t == "with":
            del labels[right[0] :]
            stack.append(left)
        else:
            stack.append((left[0], left[1] or right[1] if t == "or" else left[1] and right[1]))
    if len(stack) != 1:
        raise ExpressionError("operands without an operator")
    return set(labels), stack[0][1]


class LicenceScanner:
    def __init__(self):
        import ahocorasick

        self.phrases = ahocorasick.Automaton()
        needles: dict[str, tuple[list[str], list[str]]] = {}
        for source, slot in ((BASE, 0), (NOTICES, 1)):
            for phrase, label in source.items():
                needles.setdefault(f" {phrase} ", ([], []))[slot].append(label)
        for needle, labels in needles.items():
            self.phrases.add_word(needle, (needle.count(" "), *labels))
        self.phrases.make_automaton()
        self.tags = ahocorasick.Automaton()
        self.tags.add_word(TAG, len(TAG))
        self.tags.make_automaton()

    def expressions(self, text: str) -> list[list[str]]:
        """The tokens behind each tag; none where no expression begins there."""
        lower = text.translate(_LOWER) if "icense-" in text or "ICENSE-" in text else text.lower()
        if TAG not in lower:
            return []
        found = []
        for end, _ in self.tags.iter(text.translate(_LOWER)):
            line_end = text.find("\n", end)
            found.append(expression_tokens(text[end + 1 : line_end if line_end >= 0 else len(text)]))
        return found

    def scan(self, text: str) -> dict:
        words = text.encode().translate(_NORMAL).split()
        line = b" ".join([b"", *words, b""]).decode()
        starts: list[int] = []
        base: set[str] = set()
        added: set[str] = set()
        notices = spaces = counted = 0
        for end, (parts, own, more) in self.phrases.iter(line):  # by rising end
            if own:
                spaces += line.count(" ", counted, end + 1)
                counted = end + 1
                starts += [spaces - parts] * len(own)
                base.update(own)
            if more:
                notices += 1
                added.update(more)
        shown, ways, unread = [], [], 0
        for tokens in self.expressions(text):
            try:
                postfix = to_postfix(tokens)
                licences, permissive = evaluated(postfix)
            except ExpressionError:
                unread += 1
                continue
            shown.append(" ".join(postfix))
            added |= licences
            ways.append("permissive" if permissive else "restricted")
        # evidence from independent signs, each of a fixed strength
        doubt = 0.1 ** bool(starts) * 0.4 ** min(notices, 4) * 0.02 ** bool(shown)
        return {
            "n_words": len(words),
            "n_base": len(starts),
            "first_word": min(starts, default=None),
            "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | added)),
            "score": 1 - doubt,
            "expression": "; ".join(dict.fromkeys(shown)),
            "satisfiable_by": ",".join(sorted(set(ways))),
            "n_unread": unread,
        }


_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def scan_documents(docs: DataFrame) -> DataFrame:
    """Licence words, places of base phrases, labels and a score for each row's whole text.

    A null or empty text has no words, null first and last word, empty labels and score 0. Repeated
    rows give repeated results, null ids stay null, an empty table gives no rows, other columns are
    ignored. Texts of any length are read whole, in time that grows with their length. Tags without an
    expression behind them are counted in ``n_unread``. No shuffle.
    """

    def make():
        scanner = LicenceScanner()

        def step(rows: dict) -> dict:
            found = [scanner.scan(t) for t in rows["text"]]
            names = [p.strip().split()[0] for p in SCHEMA.split(",")][1:]
            return {"doc_id": rows["doc_id"]} | {n: [f[n] for f in found] for n in names}

        return step

    return map_rows(id_and_text(docs), SCHEMA, make)
