"""Screening: a verdict from image similarity, text recall and page heights."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    """G2; each can be set as SCREEN_<NAME>, in capitals, in a mapping of settings."""

    pass_image_min: float = 0.94
    pass_text_recall_min: float = 0.96
    pass_height_min: float = 0.85
    pass_height_max: float = 1.15
    fail_image_max: float = 0.35
    fail_text_recall_max: float = 0.25
    fail_height_min: float = 0.5
    fail_height_max: float = 2.0
    fail_signals_required: int = 2
    fail_require_all: bool = False
    skip_on_pass: bool = False

    @classmethod
    def loaded(cls, settings: Mapping[str, str] | None = None, prefix: str = "SCREEN_") -> Thresholds:
        """Defaults, with settings that are numbers or switches; anything else is passed over."""
        settings = os.environ if settings is None else settings
        found = {}
        for f in fields(cls):
            raw = settings.get(prefix + f.name.upper())
            if raw is None:
                continue
            if isinstance(f.default, bool):
                found[f.name] = raw.strip().lower() in ("1", "true", "yes", "on")
            else:
                try:
                    found[f.name] = type(f.default)(float(raw))
                except ValueError:
                    continue
        return cls(**found)


def height_ratio(source: Column, target: Column) -> Column:
    """Source by target; 1 if both are 0, 0 if one is."""
    s, t = (F.coalesce(c, F.lit(0)) for c in (source, target))
    return F.when((s > 0) & (t > 0), s / t).when(s == t, 1.0).otherwise(0.0)


def verdict(image: Column, recall: Column, ratio: Column, use: Thresholds | None = None) -> Column:
    """G1: struct of verdict, skip_ai, reasons and number of fail signals (null for a pass)."""
    t = use or Thresholds()
    image_ok, text_ok = image >= t.pass_image_min, recall >= t.pass_text_recall_min
    height_ok = ratio.between(t.pass_height_min, t.pass_height_max)
    low_image, low_text = image < t.fail_image_max, recall < t.fail_text_recall_max
    bad_height = (ratio > 0) & ((ratio < t.fail_height_min) | (ratio > t.fail_height_max))
    signals = sum((c.cast("int") for c in (low_image, low_text, bad_height)), F.lit(0))
    required = 3 if t.fail_require_all else t.fail_signals_required
    listed = lambda *pairs: F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in pairs]))
    passed = ["pass_all_signals"] + ["ai_skipped_by_env"] * t.skip_on_pass
    below = listed((~image_ok, "image_below_pass"), (~text_ok, "text_below_pass"), (~height_ok, "height_outside_pass_band"))
    extreme = listed((low_image, "extreme_low_image"), (low_text, "extreme_low_text_recall"), (bad_height, "extreme_height_mismatch"))

    def row(name: str, skip: bool, reasons: Column, count: Column) -> Column:
        return F.struct(F.lit(name).alias("verdict"), F.lit(skip).alias("skip_ai"), reasons.alias("reasons"), count.alias("fail_signals"))

    return (
        F.when(image_ok & text_ok & height_ok, row("pass", t.skip_on_pass, F.array(*map(F.lit, passed)), F.lit(None).cast("int")))
        .when(signals >= required, row("fail", True, extreme, signals))
        .otherwise(row("needs_ai", False, F.when(F.size(below) > 0, below).otherwise(F.array(F.lit("gray_zone"))), signals))
    )


def rank(c: Column) -> Column:
    return F.when(c == "fail", 3).when(c == "needs_ai", 2).when(c == "pass", 1).otherwise(0)


def worst(screened: DataFrame, key: str = "pair_id") -> DataFrame:
    """The worst verdict of a pair's profiles."""
    return screened.groupBy(key).agg(F.max_by("verdict", rank(F.col("verdict"))).alias("aggregate_verdict"))


def finished_reason(verdict: Column, text_only: Column, screening_only: Column, skip_ai: Column) -> Column:
    """Why a pair ends before the model loop; null if it goes on."""
    return (
        F.when(text_only, "text_only")
        .when(skip_ai & (verdict == "pass"), "screening_pass")
        .when(skip_ai & (verdict == "fail"), "screening_fail")
        .when(screening_only, "screening_only")
    )
