"""A content-addressed store of answers as a Parquet table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, value string, created_at timestamp, shard string"


def key(model: Column, version: Column, text: Column, images: Column) -> Column:
    """A request's key: SHA-256 of model, version, text and the images' own digests. The model is part of it."""
    parts = F.concat(F.array(*(F.sha2(c, 256) for c in (model, version, text))), images)
    return F.sha2(F.array_join(parts, "|"), 256)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("ignoreMissingFiles", "true").parquet(path)


def misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (key, ...) whose answer is not stored, each key once."""
    return requests.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def write(answers: DataFrame, path: str) -> None:
    """Appends answers (key, value); null values are not stored."""
    rows = answers.where("value is not null").dropDuplicates(["key"])
    rows = rows.select("key", "value", F.current_timestamp().alias("created_at"), F.substring("key", 1, 2).alias("shard"))
    rows.write.mode("append").partitionBy("shard").parquet(path)


def stats(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Hits, misses and the share of hits in percent."""
    known = cache.select("key").distinct().withColumn("hit", F.lit(True))
    told = requests.join(known, "key", "left").agg(
        F.count("*").alias("requests"), F.count_if(F.col("hit")).alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses")
    )
    return told.withColumn("hit_percent", F.when(F.col("requests") > 0, F.round(100 * F.col("hits") / F.col("requests"), 1)).otherwise(0.0))
