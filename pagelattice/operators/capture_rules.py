"""Rules about captured pages that need boxes and styles of elements: visibility, image sizes, prompts, manifests."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelattice.functions import geometry

LONG_EDGE, CROP_EDGE, LEAST_EDGE, MOST_EDGE = 1568, 800, 256, 4096
LEAST_OPACITY = 0.05
#: Budgets of a pair (K7).
BUDGETS = {"iterations": 40, "triggers": 120, "states": 40, "activations": 30, "next_clicks": 12, "per_selector": 15}


def edge(value: str | int | None, default: int) -> int:
    """A whole number at the start of a setting, between the least and the most; the default for anything else."""
    m = re.match(r"\s*[-+]?\d+", "" if value is None else str(value))
    return min(MOST_EDGE, max(LEAST_EDGE, int(m[0]))) if m else default


def edges(settings: Mapping[str, str], given: Mapping[str, int] | None = None) -> dict[str, int]:
    """What is given comes before an image's own setting, and that before the common one; crops have none in common."""
    given = given or {}

    def first(name: str, *keys: str) -> str | int | None:
        found = [given.get(name), *(settings.get(k) for k in keys)]
        return next((v for v in found if v is not None), None)

    return {
        "segment": edge(first("segment", "SEGMENT_MAX_EDGE", "LONG_EDGE"), LONG_EDGE),
        "target": edge(first("target", "TARGET_MAX_EDGE", "LONG_EDGE"), LONG_EDGE),
        "crop": edge(first("crop", "CROP_MAX_EDGE"), CROP_EDGE),
    }


def is_shown(display: Column, visibility: Column, opacity: Column) -> Column:
    """P25: an element's own style."""
    return (display != "none") & (visibility != "hidden") & (F.coalesce(opacity, F.lit(1.0)) >= LEAST_OPACITY)


def is_off_page(box: Column, width: Column, height: Column) -> Column:
    return (box["x"] + box["width"] <= 1) | (box["y"] + box["height"] <= 1) | (box["x"] >= width - 1) | (box["y"] >= height - 1)


def is_clipped(box: Column, clip: Column) -> Column:
    """Whether an ancestor's box that clips leaves a pixel at most of the element in either direction."""
    w = F.least(box["x"] + box["width"], clip["x"] + clip["width"]) - F.greatest(box["x"], clip["x"])
    h = F.least(box["y"] + box["height"], clip["y"] + clip["height"]) - F.greatest(box["y"], clip["y"])
    return (w <= 1) | (h <= 1)


def visible_nodes(nodes: DataFrame, ancestors: DataFrame, pages: DataFrame) -> DataFrame:
    """Nodes (page_id, node, box) that no ancestor hides and that lie on their page (page_id, width, height).

    ``ancestors`` has a row for each node and ancestor, the node itself included with ``itself`` true:
    page_id, node, itself, display, visibility, opacity, clips, box, closed_details (an ancestor that is
    closed and whose summary does not hold the node).
    """
    joined = ancestors.join(nodes.select("page_id", "node", F.col("box").alias("own")), ["page_id", "node"])
    hidden = ~is_shown(F.col("display"), F.col("visibility"), F.col("opacity")) | F.col("closed_details")
    hidden = hidden | (~F.col("itself") & F.col("clips") & is_clipped(F.col("own"), F.col("box")))
    away = joined.where(hidden).select("page_id", "node").distinct()
    on_page = nodes.join(pages, "page_id").where(~is_off_page(F.col("box"), F.col("width"), F.col("height")))
    return on_page.join(away, ["page_id", "node"], "left_anti").select(nodes.columns)


def match_prompt(base: str, source: Column, width: Column, height: Column, target_height: Column, matched: Column) -> Column:
    """The question for a block's place on the target: where it lies on the source, and what is taken already.

    ``matched`` is an array of structs of what has been matched; an empty one is not mentioned.
    """
    place = F.to_json(geometry.to_shares(source, width, height))
    centre = F.format_string("%.1f%%", 100 * (source["y"] + source["height"] / 2) / height)
    taken = F.when(F.size(matched) > 0, F.concat(F.lit("\n\nAlready matched on the target; choose none of these:\n"), F.to_json(matched)))
    heights = F.when(target_height != height, F.format_string("\n\nThe source page is %s px high, the target page %s px; go by relative height.", height, target_height))
    where = F.concat(F.lit(f"{base}\n\nThe block on the source page, in shares of the page: "), place, F.lit("; its centre is "), centre, F.lit(" from the top."))
    return F.concat(where, F.coalesce(taken, F.lit("")), F.coalesce(heights, F.lit("")))


def manifest(segments: DataFrame) -> DataFrame:
    """Entries of expandable segments, block and controls in shares of the page.

    ``segments``: pair_id, iter, label, rect (pixels in the rest), remainder_top, width, height, expandable,
    kind, controls (array of role and bbox in shares of the block), passes.
    """
    on_page = geometry.box(F.col("rect.x"), F.col("rect.y") + F.col("remainder_top"), F.col("rect.width"), F.col("rect.height"))
    found = segments.where("expandable").withColumn("block", geometry.to_shares(on_page, F.col("width"), F.col("height")))
    known = F.filter("controls", lambda c: c["bbox"].isNotNull())
    mapped = F.transform(known, lambda c: F.struct(F.coalesce(c["role"], F.lit("other")).alias("role"), geometry.inside_block(c["bbox"], F.col("block")).alias("bbox")))
    return found.select(
        "pair_id", "iter", "label", F.coalesce("kind", F.lit("unknown")).alias("kind"), "block", mapped.alias("controls"),
        F.coalesce("passes", F.lit(4)).alias("suggested_passes"), "remainder_top",
    )


def element_of_overlay(overlays: DataFrame, answers: DataFrame) -> DataFrame:
    """Each overlay (page_id, ord) with the element that a recorded answer chose for it, null without an answer."""
    return overlays.join(answers.select("page_id", "ord", "element"), ["page_id", "ord"], "left")
