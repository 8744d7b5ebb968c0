"""Acceptance of block matches, and the replay of recorded segment and match answers."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagelattice.functions import geometry
from pagelattice.operators.groups import spread


@dataclass(frozen=True)
class MatchThresholds:
    confidence: float = 0.85
    confidence_if_reordered: float = 0.9
    vertical_delta: float = 0.14
    height_skew: float = 0.75
    iou_with_prior: float = 0.2
    #: An offset alone rejects a match, whatever its confidence; without it a confident reordered match passes.
    offset_rejects: bool = True


def overlap(a: dict, b: dict) -> float:
    w = min(a["x"] + a["width"], b["x"] + b["width"]) - max(a["x"], b["x"])
    h = min(a["y"] + a["height"], b["y"] + b["height"]) - max(a["y"], b["y"])
    if w <= 0 or h <= 0:
        return 0.0
    union = a["width"] * a["height"] + b["width"] * b["height"] - w * h
    return w * h / union if union > 0 else 0.0


def accept(found: bool, confidence: float | None, source: dict, target: dict | None, heights: tuple, prior: list[dict], use: MatchThresholds) -> dict:
    """Whether a match is accepted, and why not."""
    if not found or target is None:
        return {"accepted": False, "reasons": ["invalid_bbox" if found else "ai_not_found"], "placement": None, "delta": None}
    sure = confidence or 0.0
    source_height, target_height = (h or 1 for h in heights)
    delta = (target["y"] + target["height"] / 2) / target_height - (source["y"] + source["height"] / 2) / source_height
    aligned = abs(delta) <= use.vertical_delta
    reasons = ["confidence_below_min"] if sure < use.confidence else []
    if not aligned:
        reasons += ["reordered_low_confidence"] if sure < use.confidence_if_reordered else []
        reasons += ["relative_vertical_offset_exceeded"] if use.offset_rejects else []
    skew = abs(math.log((target["height"] or 1) / (source["height"] or 1)))
    if skew > use.height_skew and not (aligned and sure >= use.confidence):
        reasons.append("height_ratio_mismatch")
    if any(overlap(target, p) > use.iou_with_prior for p in prior):
        reasons.append("overlaps_prior_match")
    where = "aligned" if aligned else "lower_on_page" if delta > 0 else "higher_on_page"
    return {"accepted": not reasons, "reasons": reasons, "placement": where, "delta": abs(delta)}


def _own_reasons(use: MatchThresholds) -> tuple[Column, Column, Column]:
    """(reasons, placement, delta) of a usable match by itself, without what was accepted before it."""
    or_one = lambda c: F.when(F.coalesce(c, F.lit(0)) == 0, 1).otherwise(c)
    middle = lambda side: (F.col(f"{side}.y") + F.col(f"{side}.height") / 2) / or_one(F.col(f"{side}_height"))
    sure, delta = F.coalesce("confidence", F.lit(0.0)), middle("target") - middle("source")
    aligned = F.abs(delta) <= use.vertical_delta
    skew = F.abs(F.log(or_one(F.col("target.height")) / or_one(F.col("source.height"))))
    reasons = [
        (sure < use.confidence, "confidence_below_min"),
        (~aligned & (sure < use.confidence_if_reordered), "reordered_low_confidence"),
        (~aligned & F.lit(use.offset_rejects), "relative_vertical_offset_exceeded"),
        ((skew > use.height_skew) & ~(aligned & (sure >= use.confidence)), "height_ratio_mismatch"),
    ]
    where = F.when(aligned, "aligned").when(delta > 0, "lower_on_page").otherwise("higher_on_page")
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in reasons])), where, F.abs(delta)


def _too_much_in_common(a: Column, b: Column, most: float) -> Column:
    w = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    union = a["width"] * a["height"] + b["width"] * b["height"] - w * h
    return (w > 0) & (h > 0) & (union > 0) & (w * h / F.when(union > 0, union) > most)


def accept_in_order(matches: DataFrame, use: MatchThresholds | None = None) -> DataFrame:
    """G4 as a fold: matches of a pair in order of ``iter``, each against the targets accepted before it.

    ``matches``: pair_id, iter, found, confidence, source and target (boxes, target null if unusable),
    source_height, target_height. The fold's state is the array of accepted boxes, which are those of one page; what a match
    shows by itself is decided before it.
    """
    use = use or MatchThresholds()
    usable = F.coalesce("found", F.lit(False)) & F.col("target").isNotNull()
    reasons, where, delta = _own_reasons(use)
    why_not = F.array(F.when(F.coalesce("found", F.lit(False)), "invalid_bbox").otherwise("ai_not_found"))
    judged = matches.select(
        F.col("pair_id").cast("string").alias("pair_id"), "iter", usable.alias("usable"), "target",
        F.when(usable, reasons).otherwise(why_not).alias("reasons"), F.when(usable, where).alias("placement"), F.when(usable, delta).cast("double").alias("delta"),
    )
    in_order = F.array_sort(F.collect_list(F.struct(*[c for c in judged.columns if c != "pair_id"])))
    box = judged.schema["target"].dataType.simpleString()
    start = F.struct(F.array().cast(f"array<{box}>").alias("prior"), F.array().cast("array<boolean>").alias("hits"))

    def step(state: Column, m: Column) -> Column:
        hit = m["usable"] & F.exists(state["prior"], lambda p: F.coalesce(_too_much_in_common(m["target"], p, use.iou_with_prior), F.lit(False)))
        accepted = m["usable"] & (F.size(m["reasons"]) == 0) & ~hit
        prior = F.when(accepted, F.concat(state["prior"], F.array(m["target"]))).otherwise(state["prior"])
        return F.struct(prior.alias("prior"), F.concat(state["hits"], F.array(hit)).alias("hits"))

    folded = judged.groupBy("pair_id").agg(in_order.alias("m")).withColumn("hit", F.aggregate("m", start, step)["hits"])
    each = folded.select("pair_id", F.explode(F.arrays_zip("m", "hit")).alias("e")).select("pair_id", "e.m.*", "e.hit")
    told = F.when(F.col("hit"), F.concat("reasons", F.array(F.lit("overlaps_prior_match")))).otherwise(F.col("reasons"))
    return each.select("pair_id", F.col("iter").cast("int").alias("iter"), (F.col("usable") & (F.size(told) == 0)).alias("accepted"), told.alias("reasons"), "placement", "delta")


def remainder_offsets(cuts: DataFrame) -> DataFrame:
    """Where the rest of a page begins before each cut (pair_id, iter, y, height)."""
    before = Window.partitionBy("pair_id").orderBy("iter").rowsBetween(Window.unboundedPreceding, -1)
    return cuts.withColumn("remainder_top", F.coalesce(F.sum(F.col("y") + F.col("height")).over(before), F.lit(0)))


def height_after_removals(regions: DataFrame) -> DataFrame:
    """Rows of a target page left after its matched bands (pair_id, page_height, y, height) are cut out, bottom first.

    A band is clamped to what is there when its turn comes; bands above never move, so this is an ordered fold.
    """
    bands = F.reverse(F.array_sort(F.collect_list(F.struct("y", "height"))))

    def cut(height, band):
        y = F.greatest(F.lit(0), F.least(band["y"], height - 1))
        return F.greatest(F.lit(1), height - F.greatest(F.lit(1), F.least(band["height"], height - y)))

    return regions.groupBy("pair_id", "page_height").agg(bands.alias("bands")).select(
        "pair_id", "page_height", F.aggregate("bands", F.col("page_height"), cut).alias("rows_left")
    )


_CARDS, _NOT_CARDS, _CARD_TEXT = (re.compile(p) for p in (geometry.CARDS, geometry.NOT_CARDS, geometry.CARD_TEXT))


@functools.lru_cache(maxsize=4096)
def _card_row(label: str | None) -> bool:
    name = (label or "").strip()
    return bool(name) and not _NOT_CARDS.search(name) and bool(_CARDS.search(name))


def merges_into_previous(before: dict | None, label: str | None, rect: dict) -> bool:
    """A strip or fragment right below a row of cards that is incomplete or unmatched belongs to it."""
    if not before or not _card_row(before["label"]) or rect["y"] > 100:
        return False
    row, words = _card_row(label), bool(_CARD_TEXT.search(label or ""))
    strip = rect["height"] <= geometry.STRIP_HEIGHT and (row or words)
    fragment = rect["height"] <= geometry.FRAGMENT_HEIGHT and (words or row and rect["height"] < 200)
    return (strip or fragment) and (before["rect"]["height"] < geometry.ROW_HEIGHT or not before["matched"])


REPLAYED = (
    "pair_id string, iter int, label string, remainder_top double, y double, height double, status string, accepted boolean, "
    "reasons array<string>, merged_from array<int>, attempts int, finished_reason string"
)


PAIRS_AT_ONCE = 500


@dataclass(frozen=True)
class ReplayLimits:
    """``width``, ``height``: the least size of a block in pixels. ``retries``: of an answer without a box. ``expansions``: of a row of cards."""

    iterations: int = 40
    width: int = 50
    height: int = 40
    retries: int = 2
    expansions: int = 3
    share: float = 0.55


def _usable(box: dict | None) -> bool:
    if not box:
        return False
    wide, high = box.get("width"), box.get("height")
    return wide is not None and high is not None and box.get("x") is not None and box.get("y") is not None and wide > 0 and high > 0


def _pixels(share: dict, width: float, height: float) -> dict:
    r = math.floor
    x, y = min(max(r(share["x"] * width + 0.5), 0), width - 1), min(max(r(share["y"] * height + 0.5), 0), height - 1)
    wide, high = r(share["width"] * width + 0.5), r(share["height"] * height + 0.5)
    return {"x": x, "y": y, "width": max(1, min(wide, width - x)), "height": max(1, min(high, height - y))}


def _segment(m: dict, left: float, limits: ReplayLimits) -> tuple[dict | None, str | None, int, str | None]:
    """The box and label that an iteration ends up with, how many further answers it took, and why the page ends here.

    An answer without a usable box is asked again; a row of cards that is too low is asked for more, until it is high enough or
    grows no more.
    """
    box, label, taken = m["segment"], m["label"], 0
    for again in list(m["retries"] if m["retries"] is not None else [])[: limits.retries]:
        if _usable(box):
            break
        taken += 1
        if again["done"]:
            return None, label, taken, "segment_done"
        box, label = again["segment"] or box, again["label"] or label
    last = 0
    for more in list(m["expansions"] if m["expansions"] is not None else [])[: limits.expansions]:
        low = box is not None and box["height"] is not None and math.floor(box["height"] * left + 0.5) < geometry.ROW_HEIGHT and box["height"] < limits.share
        if not (_card_row(label) and low):
            break
        taken += 1
        if more["segment"] is None or more["segment"]["height"] is None or more["done"]:
            break
        high = math.floor(more["segment"]["height"] * left + 0.5)
        if 0 < last >= high:
            break
        last, box, label = high, more["segment"], more["label"]
    return (box, label, taken, None) if _usable(box) else (None, label, taken, "invalid_segment_bbox")


def _plain(column: pa.Array) -> list:
    """``to_pylist`` of a column that is not nested."""
    if not (pa.types.is_integer(column.type) or pa.types.is_floating(column.type) or pa.types.is_boolean(column.type)):
        return column.to_pylist()
    found = column.fill_null(pa.scalar(0, pa.int8()).cast(column.type)).to_numpy(zero_copy_only=False).tolist()
    return [v if there else None for v, there in zip(found, column.is_valid().to_pylist(), strict=True)] if column.null_count else found


def _maker(column: pa.Array) -> Callable[[int], object]:
    """Makes the value at a place; a list is made when it is walked, for most answers are never asked again."""
    if pa.types.is_struct(column.type):
        fields = [(f.name, _maker(c)) for f, c in zip(column.type, column.flatten(), strict=True)]
        make = lambda i: {name: value(i) for name, value in fields}
    elif pa.types.is_list(column.type):
        ends = column.offsets.to_numpy().tolist()
        first, value = ends[0], _maker(column.values.slice(ends[0], ends[-1] - ends[0]))  # a slice has the values of the whole
        make = lambda i: _Later(value, range(ends[i] - first, ends[i + 1] - first))
    else:
        return _plain(column).__getitem__
    if not column.null_count:
        return make
    there = column.is_valid().to_pylist()
    return lambda i: make(i) if there[i] else None


@dataclass(frozen=True, slots=True)
class _Later:
    value: Callable[[int], object]
    places: range

    def __iter__(self) -> Iterator:
        return map(self.value, self.places)


def replay_pair(answers: list[dict], use: MatchThresholds, limits: ReplayLimits) -> list[dict]:
    """G5-G7 for the answers of one pair in their order; at most ``limits.iterations`` rows."""
    rows: list[dict] = []
    rects: dict[int, dict] = {}  # the box of each row within the rest of the page that it was cut from
    prior: dict[int, dict] = {}  # accepted targets, which a merge takes back
    top, reason = 0.0, "max_iterations"
    for m in answers:
        if m["iter"] > limits.iterations:
            break
        left = max(1.0, m["height"] - top)
        if left < limits.height:
            reason = "source_exhausted"
            break
        if not m["parsed"] or m["done"]:
            reason = "segment_done" if m["parsed"] else "segment_parse_failed"
            break
        box, label, attempts, ended = _segment(m, left, limits)
        if box is None:
            reason = ended
            break
        rect, merged = _pixels(box, m["width"], left), []
        before = rows[-1] if rows and rows[-1]["iter"] == m["iter"] - 1 and rows[-1]["status"] != "skipped" else None
        if before is not None:
            was = rects[before["iter"]]
            joined = {
                "x": min(was["x"], rect["x"]), "y": was["y"], "height": was["height"] + rect["y"] + rect["height"],
                "width": max(was["x"] + was["width"], rect["x"] + rect["width"]) - min(was["x"], rect["x"]),
            }
            told = {"label": before["label"], "rect": was, "matched": before["status"] == "matched"}
            if merges_into_previous(told, label, rect) and joined["height"] >= limits.height:
                merged, rect, top = [before["iter"], m["iter"]], joined, before["remainder_top"]
                label = f"{before['label'] or 'card row'} (images + links)"
                prior.pop(before["iter"], None)
                rows.pop()
        if _card_row(label) and rect["height"] < geometry.ROW_HEIGHT:
            rect = {**rect, "height": max(rect["height"], min(geometry.ROW_HEIGHT, rect["height"] + geometry.ROW_EXTENSION, left - rect["y"]))}
        on_page = {**rect, "y": top + rect["y"]}
        row = {"pair_id": m["pair_id"], "iter": m["iter"], "label": label, "remainder_top": top, "y": on_page["y"], "height": rect["height"], "merged_from": merged, "attempts": attempts}
        small = lambda b: b["width"] < limits.width or b["height"] < limits.height
        if small(rect):
            rows.append({**row, "status": "skipped", "accepted": False, "reasons": ["bbox_too_small"]})
        else:
            target = _pixels(m["target"], m["target_width"], m["target_height"]) if m["found"] and m["target"] is not None else None
            if target is not None and not small(target):
                told = accept(True, m["confidence"], on_page, target, (m["height"], m["target_height"]), list(prior.values()), use)
            else:
                told = {"accepted": False, "reasons": ["bbox_too_small"] if m["found"] else []}
            if told["accepted"]:
                prior[m["iter"]] = target
            rows.append({**row, "status": "matched" if told["accepted"] else "missing", "accepted": told["accepted"], "reasons": told["reasons"]})
        rects[m["iter"]] = rect
        top += rect["y"] + rect["height"]
    for k, row in enumerate(rows):
        row["finished_reason"] = reason if k == len(rows) - 1 else None
    return rows


def replay(answers: DataFrame, max_iterations: int = 40, use: MatchThresholds | None = None, limits: ReplayLimits | None = None) -> DataFrame:
    """The segment and match loop of a pair over recorded answers.

    ``answers``: pair_id, iter, label, segment (box in shares of the rest, null if none), done, parsed,
    found, confidence, target (box in shares of the target page), width, height, target_width,
    target_height; and where there are any, ``retries`` and ``expansions``: arrays of (segment, label, done) in the order they were
    given. Segments are asked again and expanded (G6), merged (G5) and extended (P19), matches accepted (G4), and the rest of the
    page moves on. Blocks below the least size are passed over. The last row of a pair tells why it ended.

    A merge starts where the previous block's rest of the page started, so places on the page stay true where that block did
    not begin at the top of the rest. A pair has at most ``max_iterations`` rows, whatever the size of the run.
    """
    use, limits = use or MatchThresholds(), limits or ReplayLimits(iterations=max_iterations)
    for name in ("retries", "expansions"):
        if name not in answers.columns:
            answers = answers.withColumn(name, F.lit(None).cast(f"array<struct<segment:{answers.schema['segment'].dataType.simpleString()},label:string,done:boolean>>"))

    told = F.struct("iter", *[c for c in answers.columns if c not in ("iter", "pair_id")])
    kept = spread(answers.where(F.col("iter") <= limits.iterations + 1).withColumn("pair_id", F.col("pair_id").cast("string")), "pair_id").groupBy("pair_id")
    held = to_arrow_schema(StructType.fromDDL(REPLAYED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAIRS_AT_ONCE):
                part = batch.slice(at, PAIRS_AT_ONCE)
                told = map(_maker(part.column("answers")), range(part.num_rows))
                rows = [r for pair, found in zip(part.column("pair_id").to_pylist(), told, strict=True) for r in replay_pair([m | {"pair_id": pair} for m in found], use, limits)]
                yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in held], schema=held)

    # a pair's answers are one row, so a task takes many pairs in a batch instead of a group each
    return kept.agg(F.array_sort(F.collect_list(told)).alias("answers")).mapInArrow(run, REPLAYED)


def extra_blocks(blocks: DataFrame, least_width: int = 50, least_height: int = 40) -> DataFrame:
    """Reported blocks (pair_id, label, bbox in shares, width, height) large enough, in pixels."""
    pixels = geometry.to_pixels(F.col("bbox"), F.col("width"), F.col("height"))
    found = blocks.where("bbox is not null").withColumn("rect", pixels)
    return found.where((F.col("rect.height") >= least_height) & (F.col("rect.width") >= least_width))


def overlaps(boxes: DataFrame, above: float = 0.2) -> DataFrame:
    """Pairs of boxes (pair_id, ord, box) of a pair that overlap by more than ``above``.

    Boxes meet where their rows share a stripe of the page, so a pair's boxes are not all compared; a pair
    of boxes counts in the first stripe that both touch.
    """
    stripe = 400
    touched = boxes.withColumn("stripe", F.explode(F.sequence(F.floor(F.col("box.y") / stripe), F.floor((F.col("box.y") + F.col("box.height")) / stripe))))
    a, b = (touched.select("pair_id", "stripe", F.col("ord").alias(f"{n}_ord"), F.col("box").alias(n)) for n in ("a", "b"))
    met = a.join(b, ["pair_id", "stripe"]).where("a_ord < b_ord").withColumn("iou", geometry.iou(F.col("a"), F.col("b")))
    first = F.floor(F.greatest(F.col("a.y"), F.col("b.y")) / stripe)
    return met.where((F.col("iou") > above) & (F.col("stripe") == first)).select("pair_id", "a_ord", "b_ord", "iou")
