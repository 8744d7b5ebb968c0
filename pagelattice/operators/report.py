"""Run-level tables: summaries of pairs, priorities, triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelattice.operators.screening import rank


def with_fields(pairs: DataFrame, part: DataFrame, prefix: str, key: str = "pair_id") -> DataFrame:
    """A part's columns beside the pairs, prefixed, null where the part has no row."""
    return pairs.join(part.select(key, *[F.col(c).alias(f"{prefix}_{c}") for c in part.columns if c != key]), key, "left")


def triage(pairs: DataFrame) -> DataFrame:
    """Pairs in order of review: verdict, lines missing entirely, coverage, place. Needs idx, verdict, missing_entirely, coverage.

    The place is told by one sort of the run's summary rows, a row for each pair.
    """
    order = [rank(F.col("verdict")).desc(), F.col("missing_entirely").desc(), F.col("coverage").asc(), F.col("idx").asc()]
    return pairs.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def removal_priority(kind: Column, urgency: Column, location: Column, bounds: Column) -> Column:
    """Points for the kind, urgency and place of an overlay."""
    points = lambda c, n: F.when(c, n).otherwise(0)
    return (
        points(kind == "cookie-banner", 100)
        + points(kind == "age-verification", 150)
        + points(urgency == "high", 50)
        + points(urgency == "medium", 25)
        + points(F.coalesce((location == "center") | F.contains(bounds, F.lit("full")), F.lit(False)) | F.coalesce(location == "center", F.lit(False)), 30)
    )


def first_overlays(overlays: DataFrame, most: int = 8) -> DataFrame:
    """K3: the overlays (page_id, ord, type, urgency, location, bounds) of a page to remove first."""
    points = removal_priority(F.col("type"), F.col("urgency"), F.col("location"), F.col("bounds"))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy(F.col("priority").desc(), "ord"))
    return overlays.withColumn("priority", points).withColumn("place", place).where(F.col("place") <= most)


def capture_summary(states: DataFrame) -> DataFrame:
    """States and lines of each profile of a capture (pair_id, role, profile, state_id, lines: array)."""
    return states.groupBy("pair_id", "role", "profile").agg(
        F.count("*").alias("states"), F.sum(F.size("lines")).alias("lines"), F.sum(F.aggregate("lines", F.lit(0), lambda n, x: n + F.length(x))).alias("characters")
    )
