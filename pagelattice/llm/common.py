"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset and driver and executors are one process (tests, one machine) a folder of our own is set;
    a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"/tmp/checkpoints/{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_scopes = threading.local()


def _removed(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``written`` makes inside are removed at its end, with the shuffle files that nothing refers to any more.

    What is to outlive it must be written inside with ``result=True``; it then belongs to the scope around.
    """
    stack = _scopes.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        for name in stack.pop():
            _removed(spark, name)
        gc.collect()
        spark._jvm.System.gc()


def written(df: DataFrame, name: str, result: bool = False, partition_by: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=partition_by)
    stack = _scopes.__dict__.get("stack", [])
    if len(stack) > result:
        stack[-1 - result].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def by_key(df: DataFrame, key: str, name: str) -> Iterator[DataFrame]:
    """``df`` written to buckets of ``key``, one for each shuffle partition: joins by ``key`` inside do not shuffle it again."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}-{uuid.uuid4().hex}".replace("-", "_")
    path = f"{shared_dir(spark)}/tables/{table}"
    df.repartition(parts, key).write.format("parquet").bucketBy(parts, key).option("path", path).saveAsTable(table)
    try:
        yield spark.table(table)
    finally:
        spark.sql(f"DROP TABLE {table}")
        _removed(spark, path)


@contextlib.contextmanager
def steady_scans(spark: SparkSession) -> Iterator[None]:
    """Scans inside are split alike in every job, also where executors come or go meanwhile: the number of cores is asked for once."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.set(name, before or str(spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: Rows that pass to a Python worker at once. Spark's own 10,000 rows of documents are tens of megabytes, held several times.
ARROW_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's number of rows in a batch to ``ARROW_ROWS``; bounds memory, changes no result."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


@functools.cache
def _trim() -> Callable[[], None]:
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc has no such call
        call = ctypes.CDLL(None).malloc_trim
        return lambda: call(0)
    return lambda: None


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, after which the worker gives freed memory back to the system; workers outlive tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        _trim()()

    return wrapped


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text as the empty one; other columns play no part."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """place and the text compressed; what is shuffled by document stays small."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            data = [squeeze(t.encode()) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("place"), pa.array(data, pa.binary())], names=["place", "data"])


def crc_mod(column: str, modulus: int):
    """crc32 of the id written as decimal text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


class Remembered:
    """Results of a worker by key, in two generations: once ``most`` are held, those not used since the last turn go.

    Only speed depends on what is held.
    """

    def __init__(self, most: int):
        self.most, self.held, self.before = most, {}, {}

    def missing(self, keys: set) -> list:
        """Those of ``keys`` that are to be put into ``held``; the others are in it now."""
        if len(self.held) > self.most:
            self.before, self.held = self.held, {}
        new = keys.difference(self.held)
        if not self.before:
            return list(new)
        back = [k for k in new if k in self.before]
        self.held.update(zip(back, map(self.before.__getitem__, back), strict=True))
        return list(new.difference(back))


def map_rows(df: DataFrame, schema: T.StructType | str, make: Callable[[], Callable[[dict], dict]]) -> DataFrame:
    """``mapInArrow`` over column dictionaries: ``make()`` runs once a task and gives the batch function.

    The batch function takes {column: list} and returns {column: list} of any one length.
    """
    kinds = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                found = step({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(trimmed(run), kinds)


#: Rows that a Python worker holds as objects at a time; bounds memory, changes no result.
ROWS_AT_ONCE = 1000
