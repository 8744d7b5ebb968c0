"""Lists of address pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelattice.functions.text import slug


def parse(lines: DataFrame) -> DataFrame:
    """Pairs of a file's lines (n from 0, line): idx, source_url, target_url, slug.

    Blank lines count for nothing. The first line that is left is a header if it starts with
    source,target. A line is cut at its first comma, which must not stand first; each side loses one
    quote at either end. A target may hold commas. The index runs over the file, whose lines are few.
    """
    kept = lines.where(F.trim(F.regexp_replace("line", "[\\r\\ufeff]", "")) != "")
    kept = kept.withColumn("first", F.row_number().over(Window.orderBy("n")) == 1)
    kept = kept.where(~(F.col("first") & F.rlike("line", F.lit(r"(?i)^source\s*,\s*target"))))
    at = F.instr("line", ",")
    side = lambda c: F.regexp_replace(F.regexp_replace(c, "^[\\s\\ufeff\\u00a0]+|[\\s\\ufeff\\u00a0]+$", ""), '^"|"$', "")
    halves = kept.where(at > 1).select("n", side(F.substring("line", F.lit(1), at - 1)).alias("source_url"), side(F.substring("line", at + 1, F.length("line"))).alias("target_url"))
    found = halves.where("source_url <> '' and target_url <> ''")
    found = found.withColumn("idx", F.row_number().over(Window.orderBy("n")) - 1)
    return found.select("idx", "source_url", "target_url", slug(F.col("idx"), F.col("source_url"), F.col("target_url")).alias("slug"))


def read(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    return parse(lines)
