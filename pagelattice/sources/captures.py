"""Captures as a folder of files, and what a run starts from.

A capture is a JSON file below ``pair_id=<n>/role=<source or target>/profile=<name>``, one for each attempt. The folders are
partition columns of the scan, so filters on pair, role and profile decide which folders are opened at all. Browsers stay
outside; whatever writes such files can feed a run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice import run

ITEM = "struct<text:string,x:int,y:int,w:int,h:int>"
FIELDS = f"attempt int, error string, height int, visible array<string>, expanded array<string>, items array<{ITEM}>"
PLACE = "pair_id long, role string, profile string"
#: Attempts after the first, and the wait before each of them in milliseconds, by step and at most.
RETRIES, WAIT, LONGEST_WAIT = 5, 5000, 25000


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each attempt to capture (pair_id, role, profile). A broken file counts as an attempt that failed."""
    rows = spark.read.schema(f"{FIELDS}, broken string, {PLACE}").option("multiLine", "true").option("columnNameOfCorruptRecord", "broken").json(folder)
    error = F.when(F.col("broken").isNotNull(), "broken capture").otherwise(F.col("error"))
    return rows.withColumns({"error": error, "attempt": F.coalesce("attempt", F.lit(0))}).drop("broken")


def write(captures: DataFrame, folder: str) -> None:
    """Captures (FIELDS and PLACE) as such files, added to those that are there."""
    captures.write.mode("append").partitionBy("pair_id", "role", "profile").json(folder)


def wait_before(attempt: Column) -> Column:
    """Milliseconds that passed before an attempt (from 0) began."""
    waits = F.transform(F.sequence(F.lit(1), F.greatest(attempt, F.lit(1))), lambda n: F.least(n * WAIT, F.lit(LONGEST_WAIT)))
    return F.when(attempt < 1, 0).otherwise(F.aggregate(waits, F.lit(0), lambda a, b: a + b)).cast("long")


def wanted(pairs: DataFrame, profiles: Sequence[str]) -> DataFrame:
    """(pair_id, role, profile, rank) of a list of pairs (idx ...): both roles under each profile, in the profiles' order."""
    both = F.explode(F.array(F.lit("source"), F.lit("target"))).alias("role")
    ranked = F.array(*[F.struct(F.lit(p).alias("profile"), F.lit(n).alias("rank")) for n, p in enumerate(profiles)])
    return pairs.select(F.col("idx").alias("pair_id"), both).select("*", F.explode(ranked).alias("p")).select("pair_id", "role", "p.*")


def settled(captures: DataFrame, grid: DataFrame) -> DataFrame:
    """For each wanted capture its first attempt without an error, else its last error.

    Attempts beyond ``RETRIES`` do not count, and a capture that nobody tried has the error ``not captured``. Of several files of one
    attempt the smallest by its fields counts. ``attempts`` and ``waited`` tell what it took.
    """
    keys = ["pair_id", "role", "profile"]
    found = F.struct("error", "height", "visible", "expanded", "items", "attempt")
    tried = captures.where(F.col("attempt").between(0, RETRIES))
    # a success before any failure, the earliest of successes, the latest of failures
    order = F.struct(F.col("error").isNotNull(), F.when(F.col("error").isNull(), F.col("attempt")).otherwise(-F.col("attempt")), F.coalesce("error", F.lit("")), found)
    best = tried.groupBy(*keys).agg(F.min_by(found, order).alias("c"))
    out = grid.join(best, keys, "left").select(*grid.columns, "c.*")
    missing = F.when(F.col("attempt").isNull(), "not captured").otherwise(F.col("error"))
    return out.withColumns({"error": missing, "attempts": F.coalesce(F.col("attempt") + 1, F.lit(0)), "waited": F.coalesce(wait_before(F.col("attempt")), F.lit(0))}).drop("attempt")


def lines(found: DataFrame) -> DataFrame:
    """The lines of settled captures: pair_id, role, profile, rank, kind, ord, line."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("lines")) for k in ("visible", "expanded")])
    each = found.where("error is null").select("pair_id", "role", "profile", "rank", F.explode(kinds).alias("k"))
    return each.select("pair_id", "role", "profile", "rank", "k.kind", F.posexplode("k.lines").alias("ord", "line")).withColumn("ord", F.col("ord").cast("long"))


def items(found: DataFrame, profile: str) -> DataFrame:
    """The positioned texts of one profile: pair_id, role, ord, text, x, y, w, h."""
    there = found.where((F.col("profile") == profile) & F.col("error").isNull())
    return there.select("pair_id", "role", F.posexplode("items").alias("ord", "i")).select("pair_id", "role", "ord", "i.*")


def heights(found: DataFrame, similarity: DataFrame) -> DataFrame:
    """Page heights of both roles beside a pair's similarity of pictures (pair_id, profile, image_similarity), as the run reads them."""
    high = lambda role: F.max(F.when(F.col("role") == role, F.col("height"))).alias(f"{role}_height")
    return similarity.join(found.groupBy("pair_id", "profile").agg(high("source"), high("target")), ["pair_id", "profile"])


def failures(found: DataFrame) -> DataFrame:
    """pair_id and error of captures that failed; one of them fails its pair."""
    return found.where("error is not null").select("pair_id", F.concat_ws(" ", "role", "profile", "error").alias("error"))


def of_run(spark: SparkSession, folder: str, pairs: DataFrame, similarity: DataFrame, profiles: Sequence[str] = ("desktop", "mobile"), profile: str = "desktop") -> run.Captures:
    """What ``run.run`` starts from, from a folder of captures; ``pairs`` are those of ``run.pair_list``."""
    found = settled(read(spark, folder).where(F.col("profile").isin(*profiles)), wanted(pairs, profiles))
    return run.Captures(pairs, lines(found), items(found, profile), heights(found, similarity), failures(found))
