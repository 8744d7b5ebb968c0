"""Boxes as column expressions. A box is a struct of x, y, width, height; pixels are whole, the rest are shares of a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(c + 0.5)


def box(x, y, width, height) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"))


def normal_box(b: Column, names: set[str]) -> Column:
    """A box from any of the usual field names, of those that the struct has."""

    def first(*options: str, default: Column | None = None) -> Column:
        found = [b[o].cast("double") for o in options if o in names]
        return F.coalesce(*found, *([default] if default is not None else [])) if found or default is not None else F.lit(None).cast("double")

    zero = F.lit(0.0)
    return F.when(b.isNull(), None).otherwise(
        box(first("x", "left", default=zero), first("y", "top", default=zero), first("width", "w"), first("height", "h"))
    )


def is_usable(b: Column) -> Column:
    """All four numbers are there and the box has an area."""
    known = b["x"].isNotNull() & b["y"].isNotNull() & b["width"].isNotNull() & b["height"].isNotNull()
    return F.coalesce(known & (b["width"] > 0) & (b["height"] > 0), F.lit(False))


def clamped(b: Column, width: Column, height: Column) -> Column:
    """The box inside an image, a pixel in size at least."""
    x = F.greatest(F.lit(0), F.least(b["x"], width - 1))
    y = F.greatest(F.lit(0), F.least(b["y"], height - 1))
    return box(x, y, F.greatest(F.lit(1), F.least(b["width"], width - x)), F.greatest(F.lit(1), F.least(b["height"], height - y)))


def to_pixels(b: Column, width: Column, height: Column) -> Column:
    """Shares of a page to pixels, clamped."""
    return clamped(box(rounded(b["x"] * width), rounded(b["y"] * height), rounded(b["width"] * width), rounded(b["height"] * height)), width, height)


def to_shares(b: Column, width: Column, height: Column) -> Column:
    """Pixels to shares of a page."""
    w, h = (F.when(c == 0, 1).otherwise(F.coalesce(c, F.lit(1))) for c in (width, height))
    return box(b["x"] / w, b["y"] / h, b["width"] / w, b["height"] / h)


def inside_block(control: Column, block: Column) -> Column:
    """A control in shares of a block to shares of the page."""
    return box(
        block["x"] + control["x"] * block["width"],
        block["y"] + control["y"] * block["height"],
        control["width"] * block["width"],
        control["height"] * block["height"],
    )


def centre(b: Column) -> Column:
    """P15."""
    return F.struct((b["x"] + b["width"] / 2).alias("x"), (b["y"] + b["height"] / 2).alias("y"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union, 0 without overlap."""
    w = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    both = w * h
    union = a["width"] * a["height"] + b["width"] * b["height"] - both
    return F.when((w <= 0) | (h <= 0) | (union <= 0), 0.0).otherwise(both / union)


def placement(delta: Column, tolerance) -> Column:
    """Aligned, lower or higher, by how far a middle lies below the other."""
    return (
        F.when(F.abs(delta) <= tolerance, "aligned").when(delta > tolerance, "lower_on_page").otherwise("higher_on_page")
    )


def relative_delta(source: Column, target: Column, source_height: Column, target_height: Column) -> Column:
    """The middles' places on their pages, target less source."""
    one = lambda c: F.when(F.coalesce(c, F.lit(0)) == 0, 1).otherwise(c)
    return (target["y"] + target["height"] / 2) / one(target_height) - (source["y"] + source["height"] / 2) / one(source_height)


def absolute_placement(source: Column, target: Column, height: Column) -> Column:
    """The same in pixels, with a tolerance of 100 px or 5 % of the page."""
    delta = target["y"] + target["height"] / 2 - source["y"] - source["height"] / 2
    return placement(delta, F.greatest(F.lit(100.0), F.when(F.coalesce(height, F.lit(0)) == 0, 1).otherwise(height) * 0.05))


# Labels of rows of cards, of what is none, and of the text below cards.
NOT_CARDS = (
    "(?i)hero|banner|masthead|jumbotron|footer|disclosure|legal|disclaimer|connect with us|account login|navigation|nav bar|"
    "site header|sticky nav"
)
CARDS = (
    r"(?i)\bcards?\b|happening now|card row|promotional cards|promo cards|three card|3 card|category icon|icon row|tile row|"
    r"teaser row|borrowing.*\bcards?\b|financing.*\bcards?\b"
)
CARD_TEXT = "(?i)link|headline|cta|caption|title row|text row|promo cards with headlines"
ROW_HEIGHT, ROW_EXTENSION, FRAGMENT_HEIGHT, STRIP_HEIGHT = 620, 200, 280, 280


def is_card_row(label: Column) -> Column:
    """P18."""
    text = F.trim(F.coalesce(label, F.lit("")))
    return (text != "") & ~F.rlike(text, F.lit(NOT_CARDS)) & F.rlike(text, F.lit(CARDS))


def is_card_text(label: Column) -> Column:
    return F.rlike(F.coalesce(label, F.lit("")), F.lit(CARD_TEXT))


def is_incomplete_row(b: Column, label: Column) -> Column:
    return F.coalesce(is_card_row(label) & (b["height"] < ROW_HEIGHT), F.lit(False))


def needs_expansion(shares: Column, label: Column, remainder: Column) -> Column:
    low = (rounded(shares["height"] * remainder) < ROW_HEIGHT) & (shares["height"] < 0.55)
    return F.coalesce(is_card_row(label) & low, F.lit(False))


def is_strip(b: Column, label: Column) -> Column:
    return F.coalesce((b["y"] <= 100) & (b["height"] <= STRIP_HEIGHT) & (is_card_row(label) | is_card_text(label)), F.lit(False))


def is_fragment(b: Column, label: Column) -> Column:
    named = is_card_text(label) | (is_card_row(label) & (b["height"] < 200))
    return F.coalesce((b["y"] <= 100) & (b["height"] <= FRAGMENT_HEIGHT) & named, F.lit(False))


def extended_row(b: Column, label: Column, remainder: Column) -> Column:
    """An incomplete row of cards reaches further down, by ROW_EXTENSION at most."""
    wanted = F.greatest(b["height"], F.least(F.lit(ROW_HEIGHT), b["height"] + ROW_EXTENSION))
    height = F.least(wanted, remainder - b["y"])
    return box(b["x"], b["y"], b["width"], F.when(is_incomplete_row(b, label) & (height > b["height"]), height).otherwise(b["height"]))


def merged_row(before: Column, fragment: Column) -> Column:
    """A row and the fragment below it."""
    x = F.least(before["x"], fragment["x"])
    right = F.greatest(before["x"] + before["width"], fragment["x"] + fragment["width"])
    return box(x, before["y"], right - x, before["height"] + fragment["y"] + fragment["height"])


def height_below(b: Column, width: Column, height: Column) -> Column:
    """Rows of an image left below a box, one at least."""
    c = clamped(b, width, height)
    return F.greatest(F.lit(1), height - c["y"] - c["height"])
