"""Line normalisation as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as browsers' regular expressions take it, and characters without width.
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"
NO_WIDTH = r"[\u200b-\u200d\ufeff]"
#: Phrases of cookie notices; lines that hold one are dropped.
COOKIE_PHRASES = ("accept all", "accept cookies", "cookie preferences", "we use cookies", "this website uses cookies")
#: Page chrome that takes no part in layout comparison.
CHROME = (r"(?i)^text size:?$", r"(?i)^letter spacing:?$", r"(?i)^[slm]$")
LEAST_LENGTH = 2
#: The characters of SPACE and NO_WIDTH one by one: a search for each is much cheaper than an expression over every character.
ASCII_SPACES = "\t\n\x0b\f\r"
WIDE_SPACES = "\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
WITHOUT_WIDTH = "\u200b\u200c\u200d\ufeff"
#: No text of CHROME is longer.
CHROME_LENGTH = 16
#: Of a byte what ``key_of`` keeps of it: small letters and digits, anything else is a space.
KEPT = bytes(c if chr(c).isalnum() else 32 for c in bytes(range(128)).lower()) + b" " * 128
_NO_WIDTH = re.compile(NO_WIDTH)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _holds(c: Column, parts: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(p)) for p in parts])


def _is_wide(c: Column) -> Column:
    """Whether a character is not ASCII."""
    return F.octet_length(c) != F.length(c)


def _one_space(c: Column) -> Column:
    odd = _holds(c, [*ASCII_SPACES, "  "]) | (_is_wide(c) & _holds(c, WIDE_SPACES))
    return F.when(odd, F.regexp_replace(c, SPACE, " ")).otherwise(c)


def _with_width(c: Column) -> Column:
    return F.when(_is_wide(c) & _holds(c, WITHOUT_WIDTH), F.regexp_replace(c, NO_WIDTH, "")).otherwise(c)


def _trimmed(c: Column) -> Column:
    return F.trim(once(c, _one_space))


def line(c: Column | str) -> Column:
    """Characters without width go, white space becomes one space, trimmed, lower case; null is ''."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(_trimmed(once(F.coalesce(c, F.lit("")), _with_width)))


def is_boilerplate(normal: Column, least: int = LEAST_LENGTH) -> Column:
    """P2, of a normalised line."""
    return reduce(lambda a, b: a | b, [F.contains(normal, F.lit(p)) for p in COOKIE_PHRASES], F.length(normal) < least)


def visible_lines(lines: Column) -> Column:
    """P3 over an array of raw lines: normalised, without boilerplate, first occurrences in order."""
    return F.array_distinct(F.filter(F.transform(lines, line), lambda x: ~is_boilerplate(x)))


def key_of_line(normal: Column) -> Column:
    return F.trim(F.regexp_replace(normal, "[^a-z0-9]+", " "))


def key(c: Column | str) -> Column:
    """The normalised line with all but a-z and 0-9 turned into spaces."""
    return key_of_line(line(c))


def key_of(value: str | None) -> str:
    """``key`` of one text in a Python worker."""
    value = value or ""
    if not value.isascii():  # two capitals outside ASCII have small letters in it
        value = _NO_WIDTH.sub("", value).lower()
    return b" ".join(value.encode("ascii", "replace").translate(KEPT).split()).decode()


def tokens(k: Column) -> Column:
    """Words of a key; none for the empty key."""
    return F.filter(F.split(k, " "), lambda t: t != "")


def crawl_key(c: Column | str) -> Column:
    """P5: like ``key``, but characters without width part words."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9 ]", " "), " +", " "))


def is_chrome(c: Column) -> Column:
    """P8's first half: whether a text is page chrome; long texts are not, and take no expression."""
    text = F.regexp_replace(c, f"^{SPACE}|{SPACE}$", "")
    told = reduce(lambda a, b: a | b, [F.rlike(text, F.lit(p)) for p in CHROME])
    bare = F.btrim(c, F.lit(f" {ASCII_SPACES}\x85{WIDE_SPACES}"))  # \x85 too: as the last line break it lets the expression end before it
    return F.when(F.length(bare) > CHROME_LENGTH, False).otherwise(told)


def is_noise(c: Column) -> Column:
    """No ASCII letter, or a single word of at most two characters."""
    text = F.regexp_replace(c, f"^{SPACE}|{SPACE}$", "")
    return ~F.rlike(text, F.lit("[a-zA-Z]")) | (~F.rlike(text, F.lit(SPACE)) & (F.length(text) <= 2))


def java_replacement(to: str) -> str:
    """A replacement with $& and $1 written as Java's $0 and $1; other backslashes and dollars are literal."""
    out = to.replace("\\", "\\\\")
    out = re.sub(r"\$(?![&\d$])", r"\\$", out)
    return out.replace("$$", "\\$").replace("$&", "$0")


def with_rules(c: Column, rules: Iterable[dict]) -> Column:
    """Recipe rules in order, {from, to} literally or {ignorePattern, flags}; then white space collapsed."""
    out = F.coalesce(c, F.lit(""))
    for rule in rules:
        if isinstance(rule.get("from"), str):
            literal = re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", rule["from"])
            out = F.regexp_replace(out, F.lit(f"(?iu){literal}"), F.lit(java_replacement(rule.get("to") or "")))
        elif isinstance(rule.get("ignorePattern"), str):
            flags = rule.get("flags") or "gi"
            switches = "".join(f for f in ("i", "m", "s") if f in flags) + ("u" if "i" in flags else "")
            pattern = (f"(?{switches})" if switches else "") + rule["ignorePattern"]
            out = F.regexp_replace(out, F.lit(pattern), F.lit("")) if "g" in flags else _first_removed(out, pattern)
    return _trimmed(out)


def _first_removed(c: Column, pattern: str) -> Column:
    at = F.regexp_instr(c, F.lit(pattern))
    found = F.length(F.regexp_substr(c, F.lit(pattern)))
    return F.when(at == 0, c).otherwise(F.concat(F.substring(c, F.lit(1), at - 1), F.substring(c, at + found, F.length(c))))


def match_key(c: Column, rules: Iterable[dict] = ()) -> Column:
    """The key after the recipe's rules."""
    rules = list(rules)
    return key(with_rules(c, rules) if rules else c)


def slug(index: Column, source: Column, target: Column) -> Column:
    """Pair-<index of four digits at least>-<10 hex digits of the addresses' SHA-256>."""
    digest = F.substring(F.sha2(F.concat(source, F.lit("|"), target), 256), 1, 10)
    return F.format_string("pair-%04d-%s", index, digest)


def file_name(src: Column, tag: Column, kind: Column) -> Column:
    """An image's label, the file name of its address without query, at most 40 characters."""
    name = F.substring(F.substring_index(F.substring_index(src, "/", -1), "?", 1), 1, 40)
    absent = lambda c: F.when(c == "", None).otherwise(c)
    return F.when(F.length(src) > 0, name).otherwise(F.coalesce(absent(tag), absent(kind), F.lit("image")))


def csv_field(c: Column) -> Column:
    """Quoted if it holds a comma, a quote or a line break; null is empty."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(F.rlike(text, F.lit(r'[",\n\r]')), quoted).otherwise(text)


def dom_signature(lines: Column) -> Column:
    """16 hex digits of the SHA-256 of the lines joined by line breaks."""
    return F.substring(F.sha2(F.concat_ws("\n", lines), 256), 1, 16)


def state_signature(lines: Column) -> Column:
    """SHA-1 of the sorted crawl keys."""
    return F.sha1(F.concat_ws("\n", F.sort_array(lines)))


def selector(c: Column) -> Column:
    """A selector without extensions of one library, the first of a list; null if nothing is left."""
    out = c
    for pattern, to in (
        (r"(?i):contains\([^)]*\)", ""), (r"(?i):has-text\([^)]*\)", ""), (r"(?i):has\([^)]*\)", ""), (r"(?i):visible", ""),
        (r"(?i):hidden", ""), (r"(?i):first", ":first-of-type"), (r"(?i):last", ":last-of-type"), (r",\s*,", ","), (r",\s*$", ""),
        (r"^\s*,", ""),
    ):
        out = F.regexp_replace(out, pattern, to)
    out = F.trim(out)
    parts = F.filter(F.transform(F.split(out, ","), F.trim), lambda p: p != "")
    first = F.when(F.contains(out, F.lit(",")) & (F.size(parts) > 0), F.get(parts, 0)).otherwise(out)
    return F.when((out == "") | F.endswith(out, F.lit(",")), None).otherwise(first)


def luminance(c: Column) -> Column:
    """P20: 0 to 1 for rgb()/rgba() colours, null for others and for transparent ones."""
    inside = F.regexp_extract(c, r"rgba?\(([^)]+)\)", 1)
    numbers = F.transform(F.split(inside, ","), lambda p: F.trim(p).try_cast("double"))
    alpha = F.get(numbers, 3)
    light = (0.299 * F.get(numbers, 0) + 0.587 * F.get(numbers, 1) + 0.114 * F.get(numbers, 2)) / 255
    return F.when(alpha < 0.05, None).otherwise(light)
