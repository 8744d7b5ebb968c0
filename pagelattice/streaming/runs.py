"""Extensions over streams: events of runs by the minute, and line recall of pairs as captures arrive."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.sources import events


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(events.SCHEMA).json(folder)


def by_minute(stream: DataFrame, late: str = "2 minutes") -> DataFrame:
    """Events of each kind in each minute; events later than ``late`` are not waited for."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 minute"), "event").agg(F.count("*").alias("n"))


def new_captures(stream: DataFrame, content: Sequence[str], keys: Sequence[str] = ("pair_id", "role", "profile"), at: str = "captured_at", keep: str = "7 days") -> DataFrame:
    """Captures whose ``content`` was not seen under their keys for ``keep``, so that a re-run compares only what changed.

    The state is a digest for each key and content, dealt over the state stores by hash, and goes once the watermark has passed it: a page
    that comes back after that counts as new. Captures that are older than the newest of earlier batches less ``keep`` are late and do not
    come through. Those without a time are never held against others: they all come through and move no watermark, for which the stream is
    read twice. Null keys and contents equal each other.
    """
    digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    told = stream.withColumn("digest", digest)
    timed = told.where(F.col(at).isNotNull()).withWatermark(at, keep).dropDuplicatesWithinWatermark([*keys, "digest"])
    return timed.unionByName(told.where(F.col(at).isNull()))


def each_batch(stream: DataFrame, analyse: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Runs the batch analytics over each batch of captures; a batch that is run again replaces its own rows."""

    def one(batch: DataFrame, number: int) -> None:
        analyse(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
