"""The event log of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "ts timestamp, slug string, event string, data string"
LONGEST = 8000


def shortened(c: Column) -> Column:
    """Texts over 8000 characters are cut, and say by how much."""
    over = F.length(c) - LONGEST
    return F.when(over > 0, F.concat(F.substring(c, 1, LONGEST), F.format_string("… [%d more]", over))).otherwise(c)


def write(events: DataFrame, path: str) -> None:
    events.withColumn("data", shortened(F.col("data"))).write.mode("append").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def in_last_minute(events: DataFrame, key: str, ts: str = "ts", seconds: int = 60) -> DataFrame:
    """For each event how many of its key fall into the minute up to it, and the pause before it."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    by = Window.partitionBy(key).orderBy("__at")
    found = events.withColumn("__at", at)
    return found.withColumns(
        {"in_window": F.count("*").over(by.rangeBetween(-seconds * 1_000_000, 0)), "pause": (F.col("__at") - F.lag("__at").over(by)) / 1e6}
    ).drop("__at")


def breaches(events: DataFrame, key: str, most: int = 30, least_pause: float = 0.5) -> DataFrame:
    """Events that a limit of ``most`` a minute and ``least_pause`` seconds between them would have held back."""
    found = in_last_minute(events, key)
    return found.where((F.col("in_window") > most) | (F.col("pause") < least_pause))
