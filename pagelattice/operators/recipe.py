"""Recipes: per-site settings read from YAML, with defaults and a check."""

from __future__ import annotations

import re
from typing import Any

import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F

PROFILES = {
    "desktop": {"viewport": (1920, 1080), "scale": 1.0, "mobile": False, "touch": False},
    "mobile": {"device": "iPhone 13", "viewport": (390, 664), "scale": 3.0, "mobile": True, "touch": True},
    "tablet": {"device": "iPad (gen 7)", "viewport": (810, 1080), "scale": 2.0, "mobile": True, "touch": True},
}
PROVENANCE = {"by": "human", "confidence": 1, "reviewed": True}


class RecipeError(ValueError):
    """A recipe that cannot be used."""


def profile(name: str | None = None) -> dict[str, Any]:
    """A device profile by name, desktop by default."""
    name = name or "desktop"
    if name not in PROFILES:
        raise KeyError(f"unknown profile {name!r}; known: {', '.join(PROFILES)}")
    return {"name": name} | PROFILES[name]


def with_defaults(given: Any) -> dict[str, Any]:
    """Sections that are absent or of a wrong kind take their defaults; lists are replaced whole."""
    g = given if isinstance(given, dict) else {}
    as_list = lambda v: v if isinstance(v, list) else []
    as_map = lambda v: v if isinstance(v, dict) else {}
    interaction = as_map(g.get("interaction"))
    return {
        "site": {"sourceOrigin": "", "targetOrigin": ""} | as_map(g.get("site")),
        "profiles": as_list(g.get("profiles")) or ["desktop"],
        **{k: as_list(g.get(k)) for k in ("ignore", "mask", "normalize", "knownDiffs")},
        "interaction": {k: as_list(interaction.get(k)) for k in ("denylist", "hints")},
        "provenance": as_map(g.get("provenance")),
    }


def problems(recipe: dict[str, Any]) -> tuple[list[str], list[str]]:
    """S3: errors and warnings."""
    errors = []
    warnings = [f"unknown profile {p!r}" for p in recipe["profiles"] if p not in PROFILES]

    def has_selector(rule: Any) -> bool:
        return isinstance(rule, dict) and isinstance(rule.get("selector"), str) and bool(rule["selector"].strip())

    for section, rules in (("ignore", recipe["ignore"]), ("mask", recipe["mask"]), ("interaction.hints", recipe["interaction"]["hints"])):
        errors += [f"{section}[{i}] needs a selector" for i, r in enumerate(rules) if not has_selector(r)]
    for i, r in enumerate(recipe["normalize"]):
        if not isinstance(r, dict):
            errors.append(f"normalize[{i}] is no rule")
        elif isinstance(r.get("ignorePattern"), str):
            try:
                re.compile(r["ignorePattern"])
            except re.error as e:
                errors.append(f"normalize[{i}] has a pattern that does not compile: {e}")
        elif not isinstance(r.get("from"), str):
            errors.append(f"normalize[{i}] needs from and to, or ignorePattern")
    return errors, warnings


def load(content: str, strict: bool = True) -> tuple[dict[str, Any], list[str], list[str]]:
    """Recipe, errors and warnings of a YAML or JSON text."""
    try:
        recipe = with_defaults(yaml.safe_load(content))
    except yaml.YAMLError as e:
        raise RecipeError(f"not YAML: {e}") from e
    errors, warnings = problems(recipe)
    if errors and strict:
        raise RecipeError("; ".join(errors))
    return recipe, errors, warnings


def is_denied(recipe: dict[str, Any], selector: Column) -> Column:
    """P26."""
    return F.coalesce(selector.isin(*recipe["interaction"]["denylist"]), F.lit(False)) if recipe["interaction"]["denylist"] else F.lit(False)


def provenance(recipe: dict[str, Any], field: str) -> dict[str, Any]:
    """Who set a field; a human by default."""
    return recipe["provenance"].get(field) or PROVENANCE
