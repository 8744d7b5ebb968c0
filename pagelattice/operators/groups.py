"""Grouped Python functions over many small groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes of the rows that a Python worker is handed at once.
HANDED = 4 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by its keys into the session's number of shuffle partitions.

    Rows of grouped functions are few and their work is long, so partitions must not be merged for
    being small in bytes; a number that is asked for is kept. The groups need no further exchange.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bounds of a batch to ``HANDED`` bytes, whatever its rows; bounds memory, changes no result."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    if before is None or not before.isdigit() or not 0 < int(before) <= HANDED:
        spark.conf.set(name, str(HANDED))
