"""Content across device profiles: what is missing entirely, and what only moved to another profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.operators.audit import audit_lines
from pagelattice.operators.groups import spread


def union_of_profiles(lines: DataFrame) -> DataFrame:
    """A4: the distinct lines of a side over all profiles, in order of first sight (profile rank, place)."""
    # the profile tells nothing more, but the same columns as for the audit by profile need no shuffle of their own
    first = lines.groupBy("pair_id", "line").agg(F.min(F.struct("rank", "ord", "profile")).alias("at"))
    return first.select("pair_id", "line", F.col("at.rank").alias("rank"), F.col("at.ord").alias("ord"))


def shared_profiles(source: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pair_id, profile) on both sides, and on the source alone."""
    a, b = (side.select("pair_id", "profile").distinct() for side in (source, target))
    return a.join(b, ["pair_id", "profile"], "left_semi"), a.join(b, ["pair_id", "profile"], "left_anti")


def rollup(source: DataFrame, target: DataFrame) -> DataFrame:
    """Each distinct missed line of the shared profiles, probed again in the target of all profiles.

    Lines are (pair_id, profile, rank, ord, line), rank being the profile's place. A miss that the union
    holds is viewport_shifted, any other missing_entirely; it carries the first profile that misses it. Each side is shuffled once, by
    pair: its profiles stay beside each other, and what follows needs no other order.
    """
    source, target = (spread(side.select("pair_id", "profile", "rank", "ord", "line"), "pair_id") for side in (source, target))
    source, seen = (side.withColumn("ord", F.struct("rank", "ord")) for side in (source, target))
    audited = audit_lines(source, seen, ["pair_id", "profile"], "inner", ["pair_id"]).where("match_type = 'missing'")  # inner: shared profiles alone
    first = audited.where("normal <> ''").groupBy("pair_id", "normal").agg(F.min_by(F.struct("profile", "line"), "ord").alias("first"))
    # the profile comes along in place of an order, so nothing is joined back
    probes = first.select("pair_id", F.col("first.profile").alias("ord"), F.col("first.line").alias("line"))
    everywhere = union_of_profiles(target).withColumn("ord", F.struct("rank", "ord"))
    found = audit_lines(probes, everywhere.select("pair_id", "ord", "line"))
    kind = F.when(F.col("match_type") == "missing", "missing_entirely").otherwise("viewport_shifted")
    return found.select("pair_id", kind.alias("classification"), F.col("ord").alias("missing_under_profile"), F.col("line").alias("source_line"))


def rollup_summary(pairs: DataFrame, rolled: DataFrame) -> DataFrame:
    counts = rolled.groupBy("pair_id").agg(
        F.count_if(F.col("classification") == "missing_entirely").alias("missing_entirely"),
        F.count_if(F.col("classification") == "viewport_shifted").alias("viewport_shifted"),
    )
    found = pairs.select("pair_id").join(counts, "pair_id", "left").na.fill(0, ["missing_entirely", "viewport_shifted"])
    return found.withColumn("status", F.when(F.col("missing_entirely") > 0, "discrepancies").otherwise("ok"))
