"""Valid-time enrichment of sales: time-paged map state in a streaming query that is started once a batch.

A state group holds versions and waiting sales in pages of a day: map state from day to page, and a
directory of the pages with their counts. A start of the query adds the batch's rows to the group, emits
the sales that are due with their client's version (own page or the nearest earlier one), and prunes versions up to
the horizon. Pages up to there are drained and dropped; the one version that each client keeps of them goes to a page
before all others.

Clients are dealt over groups by hash. A client with more than a group's fair share of all rows is dealt over time
slices instead, each a group of its own. Slices tell after each start what they hold; from these rows the next
start learns which slice keeps the client's last version up to the horizon, and a sale without a version in its own slice
finds the nearest earlier slice that has one. So neither a client's rows nor its versions meet in one task.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from pagelattice.llm.common import scratch, shared_dir, written

#: Fixed values of the contract: number of batches, first day since 1970, days that the batches span.
BATCHES, FIRST_DAY, DAYS = 12, 19723, 152
DAY = 86_400_000_000
#: The page of versions up to the horizon, before all days.
DRAINED = -(2**40)
#: State groups of ordinary clients for each shuffle partition.
GROUPS_A_PARTITION = 1

SALE, CHANGE, TICK, PASSED = range(4)
ID_NULL, CLIENT_NULL, TIME_NULL, CENTS_NULL, SETTLED = 1, 2, 4, 8, 16

FEED = "kind int, part long, slice long, id long, client long, at long, cents long, flags int, op string"
OUT = (
    "rec string, id long, batch long, n_held long, change_id long, balance_cents long, op string, "
    "client long, slice long, timed boolean, settled boolean, alive boolean"
)
VERSION = pa.schema([("client", pa.int64()), ("at", pa.int64()), ("id", pa.int64()), ("cents", pa.int64()), ("flags", pa.int32()), ("op", pa.string())])
WAITING = pa.schema([("client", pa.int64()), ("at", pa.int64()), ("id", pa.int64()), ("flags", pa.int32())])
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max

Rows = dict[str, np.ndarray]


def _packed(rows: Rows, schema: pa.Schema) -> bytes:
    return pa.record_batch([pa.array(rows[f.name], f.type) for f in schema], schema=schema).serialize().to_pybytes()


def _unpacked(data: bytes, schema: pa.Schema) -> Rows:
    batch = pa.ipc.read_record_batch(pa.py_buffer(data), schema)
    return {f.name: batch.column(i).to_numpy(zero_copy_only=False) for i, f in enumerate(schema)}


def _joined(parts: list[Rows], schema: pa.Schema) -> Rows:
    if len(parts) == 1:
        return parts[0]
    kinds = {f.name: object if f.type == pa.string() else f.type.to_pandas_dtype() for f in schema}
    return {n: np.concatenate([p[n] for p in parts]) if parts else np.empty(0, kind) for n, kind in kinds.items()}


def _taken(rows: Rows, which: np.ndarray) -> Rows:
    return {n: a[which] for n, a in rows.items()}


def _whole(values: np.ndarray, missing: np.ndarray) -> pd.array:
    return pd.arrays.IntegerArray(values.astype(np.int64), missing.astype(bool))


def last_versions(versions: Rows, client: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each (client, at) the index of the client's last version up to then, or -1; ``versions`` are in order."""
    n = len(versions["client"])
    clients = np.concatenate([versions["client"], client])
    order = np.lexsort((np.arange(len(clients)) >= n, np.concatenate([versions["at"], at]), clients))
    latest = np.maximum.accumulate(np.where(order < n, order, -1))
    found = np.empty(len(clients), np.int64)
    found[order] = latest
    found = found[n:]
    if n:
        found[(found >= 0) & (versions["client"][found] != client)] = -1
    return found


class Pages:
    """Pages of one kind of rows in map state, read and written by day."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, schema: pa.Schema):
        self.state, self.schema = handle.getMapState(name, "day long", "n long, rows binary"), schema

    def read(self, days: list[int]) -> list[Rows]:
        return [_unpacked(self.state.getValue((d,))[1], self.schema) for d in days]

    def write(self, counts: dict[int, int], day: int, rows: Rows) -> None:
        """Replaces a page; one without rows is dropped."""
        if n := len(rows["at"]):
            self.state.updateValue((day,), (n, _packed(rows, self.schema)))
            counts[day] = n
        elif day in counts:
            self.state.removeKey((day,))
            del counts[day]


class DayPages(StatefulProcessor):
    """One start's work on a group. ``horizon``: H in microseconds; ``late_before``: the changes' watermark."""

    def __init__(self, batch: int, horizon: int, late_before: int):
        self.batch, self.horizon, self.late_before = batch, horizon, late_before

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.versions = Pages(handle, "versions", VERSION)
        self.waiting = Pages(handle, "waiting", WAITING)
        self.directory = handle.getValueState("directory", "days array<long>, versions array<long>, waiting array<long>")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        given = pd.concat(list(rows), ignore_index=True)
        yield self.step(int(key[1]), {n: given[n].to_numpy() for n in given.columns})

    def step(self, slice_: int, given: Rows) -> pd.DataFrame:
        listed = self.directory.get() if self.directory.exists() else ([], [], [])
        n_versions = {d: n for d, n in zip(listed[0], listed[1], strict=True) if n}
        n_waiting = {d: n for d, n in zip(listed[0], listed[2], strict=True) if n}
        had_state = bool(listed[0])

        changes = _taken(given, given["kind"] == CHANGE)
        late = changes["at"] < self.late_before
        new = _taken(changes, ~late & (changes["flags"] & CLIENT_NULL == 0))
        new["flags"] = new["flags"] & (ID_NULL | CENTS_NULL)
        sales = _taken(given, given["kind"] == SALE)

        held = _joined([*self.versions.read(sorted(n_versions)), {f.name: new[f.name] for f in VERSION}], VERSION)
        passed = (given["kind"] == PASSED).any()
        if passed:  # a later slice has the client's last version up to the horizon
            held = _taken(held, held["flags"] & SETTLED == 0)
        held = _taken(held, np.lexsort((np.where(held["flags"] & ID_NULL, LEAST, held["id"]), held["at"], held["client"])))

        # due: new sales and pages of waiting ones before the horizon
        pages = [d for d in sorted(n_waiting) if d * DAY < self.horizon]
        waiting = _joined([*self.waiting.read(pages), {f.name: sales[f.name] for f in WAITING}], WAITING)
        due = (waiting["flags"] & TIME_NULL != 0) | (waiting["at"] < self.horizon) | (self.horizon == MOST)
        emitted, stay = _taken(waiting, due), _taken(waiting, ~due)
        out = [self.late_rows(_taken(changes, late)), self.sale_rows(slice_, emitted, held)]
        stay_day = stay["at"] // DAY
        for day in sorted(set(stay_day.tolist()) | set(pages)):
            own = _taken(stay, stay_day == day)
            if day not in pages and day in n_waiting and len(own["at"]):
                own = _joined([*self.waiting.read([day]), own], WAITING)
            self.waiting.write(n_waiting, day, own)

        # prune: of each client's versions up to the horizon the last stays
        below = held["at"] <= self.horizon
        next_too = np.zeros(len(below), bool)
        next_too[:-1] = below[1:] & (held["client"][1:] == held["client"][:-1])
        gone = below & next_too
        newly = below & (held["flags"] & SETTLED == 0)
        if slice_ >= 0 and (had_state or len(held["at"]) or len(stay["at"])):
            left = bool(n_waiting) or not gone.all()
            out.append(self.page_row(slice_, held, bool(below.any()), left, int(given["client"][0])))
        held["flags"] = np.where(newly, held["flags"] | SETTLED, held["flags"])
        if passed or newly.any():
            self.versions.write(n_versions, DRAINED, _taken(held, below & ~gone))
        held = _taken(held, ~below)
        day = held["at"] // DAY
        for d in sorted({*(new["at"] // DAY).tolist(), *(d for d in n_versions if d != DRAINED and d * DAY <= self.horizon)}):
            self.versions.write(n_versions, d, _taken(held, day == d))

        days = sorted({*n_versions, *n_waiting})
        if days:
            self.directory.update((days, [n_versions.get(d, 0) for d in days], [n_waiting.get(d, 0) for d in days]))
        elif had_state:
            self.directory.clear()
        return pd.concat(out, ignore_index=True) if len(out) > 1 else out[0]

    def frame(self, rec: str, n: int, **columns) -> pd.DataFrame:
        none = np.ones(n, bool)
        whole = {c: _whole(np.zeros(n, np.int64), none) for c in ("id", "n_held", "change_id", "balance_cents", "client", "slice")}
        flags = {c: np.zeros(n, bool) for c in ("timed", "settled", "alive")}
        base = {"rec": np.full(n, rec, object), "batch": np.full(n, self.batch, np.int64), "op": np.full(n, None, object)} | whole | flags | columns
        return pd.DataFrame({c.split()[0]: base[c.split()[0]] for c in OUT.split(", ")})

    def late_rows(self, changes: Rows) -> pd.DataFrame:
        return self.frame("late", len(changes["id"]), id=_whole(changes["id"], changes["flags"] & ID_NULL))

    def sale_rows(self, slice_: int, sales: Rows, held: Rows) -> pd.DataFrame:
        """Sales with their version; those of a slice have no count yet, and may still find a version in an earlier slice."""
        known = sales["flags"] & CLIENT_NULL == 0
        timed = sales["flags"] & TIME_NULL == 0
        found = np.where(known & timed, last_versions(held, sales["client"], np.where(timed, sales["at"], LEAST)), -1)
        count = np.searchsorted(held["client"], sales["client"], "right") - np.searchsorted(held["client"], sales["client"])
        has, n = found >= 0, len(found)
        flags, pick = np.full(n, ID_NULL | CENTS_NULL, np.int32), found[has]
        ids, cents, op = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, None, object)
        ids[has], cents[has], op[has], flags[has] = held["id"][pick], held["cents"][pick], held["op"][pick], held["flags"][pick]
        alone = np.full(n, slice_ != -1)
        return self.frame(
            "sale", n, id=_whole(sales["id"], sales["flags"] & ID_NULL), n_held=_whole(np.where(known, count, 0), alone),
            change_id=_whole(ids, flags & ID_NULL), balance_cents=_whole(cents, flags & CENTS_NULL), op=op,
            client=_whole(sales["client"], ~known), slice=_whole(np.full(n, slice_), ~alone), timed=timed, alive=has,
        )

    def page_row(self, slice_: int, held: Rows, settled: bool, alive: bool, client: int) -> pd.DataFrame:
        """What a slice held when its sales were emitted: count and last version; whether one settles, and whether anything stays."""
        n = len(held["at"])
        flags = int(held["flags"][-1]) if n else ID_NULL | CENTS_NULL
        one = lambda name: np.array([held[name][-1] if n else 0], np.int64)
        return self.frame(
            "page", 1, n_held=_whole(np.array([n]), np.zeros(1)), client=_whole(np.array([client]), np.zeros(1)),
            slice=_whole(np.array([slice_]), np.zeros(1)), change_id=_whole(one("id"), np.array([flags & ID_NULL])),
            balance_cents=_whole(one("cents"), np.array([flags & CENTS_NULL])), op=np.array([held["op"][-1] if n else None], object),
            settled=np.array([settled]), alive=np.array([alive]), timed=np.array([n > 0]),
        )


def micros(name: str) -> Column:
    """Microseconds since 1970 of a timestamp as its clock shows it, whatever zone the session has."""
    c = F.col(name)
    seconds = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.expr(f"extract(SECOND FROM `{name}`)") * 1_000_000).cast("long")


def _batch(day: Column) -> Column:
    """Days before the first count as the first; a missing day goes to the last batch."""
    return F.greatest(F.lit(0), F.least(F.lit(BATCHES - 1), F.floor((day - FIRST_DAY) * BATCHES / DAYS))).cast("int")


def _day(name: str) -> Column:
    return F.datediff(F.col(name).cast("date"), F.lit("1970-01-01").cast("date"))


def _flags(**null: int) -> Column:
    return sum((F.when(F.col(c).isNull(), bit).otherwise(0) for c, bit in null.items()), F.lit(0)).cast("int")


def events(sales: DataFrame, changes: DataFrame) -> DataFrame:
    """Both tables' rows with their batch: kind, id, client, at, cents, flags, op; missing numbers are 0 and flagged."""
    sale = sales.select(
        F.lit(SALE).alias("kind"), F.col("sale_id").cast("long").alias("id"), F.col("client_id").cast("long").alias("client"),
        micros("sold_at").alias("at"), F.lit(None).cast("long").alias("cents"), F.lit(None).cast("string").alias("op"), _batch(_day("arrived_at")).alias("batch"),
    )
    balance = F.floor(F.col("balance").cast("double") * 100 + 0.5)
    change = changes.distinct().where("valid_at is not null").select(
        F.lit(CHANGE).alias("kind"), F.col("change_id").cast("long").alias("id"), F.col("client_id").cast("long").alias("client"),
        micros("valid_at").alias("at"), F.when(F.abs(F.col("balance")) < 9e16, balance).cast("long").alias("cents"), "op",
        _batch(_day("valid_at") + F.coalesce(F.pmod(F.crc32(F.col("change_id").cast("string").cast("binary")), F.lit(4)), F.lit(0))).alias("batch"),
    )
    both = sale.unionByName(change).withColumn("flags", _flags(id=ID_NULL, client=CLIENT_NULL, at=TIME_NULL, cents=CENTS_NULL))
    return both.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("id", "client", "at", "cents")})


@dataclass(frozen=True)
class Crowd:
    """Clients with more rows than a group's fair share, and the width in microseconds of their time slices."""

    widths: dict[int, int]


def crowded_clients(rows: DataFrame, parts: int) -> Crowd:
    """Clients with over 1 / ``parts`` of the rows, fewer than ``parts`` by that, and slices with a batch's fair share."""
    known = rows.where(F.col("flags").bitwiseAND(CLIENT_NULL) == 0)
    many = known.groupBy("client").agg(F.count("*").alias("n"))
    timed = rows.where(F.col("flags").bitwiseAND(TIME_NULL) == 0)
    span = timed.agg((F.max("at") - F.min("at") + 1).alias("span"))
    total = rows.agg(F.count("*").alias("total"))
    found = many.join(total).join(span).where(F.col("n") * parts > F.col("total")).collect()
    return Crowd({r["client"]: max(1_000_000, int((r["span"] or DAY) * (r["total"] / (parts * BATCHES)) / r["n"])) for r in found})


def group_ids(spark: SparkSession, partitions: int) -> list[int]:
    """Numbers of ordinary groups that hash to different partitions, ``GROUPS_A_PARTITION`` for each where that many are found.

    Only the balance of the partitions hangs on it.
    """
    near = spark.range(20 * partitions * GROUPS_A_PARTITION)
    where = F.pmod(F.hash("id", F.lit(-1).cast("long")), F.lit(partitions))
    ids = near.groupBy(where.alias("at")).agg(F.slice(F.sort_array(F.collect_list("id")), 1, GROUPS_A_PARTITION).alias("ids"))
    return sorted(i for r in ids.collect() for i in r["ids"])


def dealt(rows: DataFrame, crowd: Crowd, ids: list[int]) -> DataFrame:
    """``rows`` with their group: (part, -1) by hash for ordinary clients, (client, slice) for crowded ones.

    Sales without a client have no versions and go by their id; those of a crowded client without a time go to slices below -1.
    """
    no_client = F.col("flags").bitwiseAND(CLIENT_NULL) != 0
    no_time = F.col("flags").bitwiseAND(TIME_NULL) != 0
    by = F.when(no_client, F.col("id")).otherwise(F.col("client"))
    parts = len(ids)
    part = F.array(*(F.lit(i).cast("long") for i in ids))[F.pmod(F.xxhash64(by), F.lit(parts)).cast("int")]
    if not crowd.widths:
        return rows.withColumns({"part": part, "slice": F.lit(-1).cast("long")})
    width = F.create_map(*(F.lit(x).cast("long") for pair in crowd.widths.items() for x in pair))[F.col("client")]
    width = F.when(~no_client, width)
    lone = -2 - F.pmod(F.xxhash64("id"), F.lit(parts))
    slice_ = F.when(width.isNull(), F.lit(-1)).when(no_time, lone).otherwise(F.floor(F.col("at") / width) + 2**40)
    return rows.withColumns({"part": F.when(width.isNull(), part).otherwise(F.col("client")), "slice": slice_.cast("long")})


def _ticks(spark: SparkSession, ids: list[int]) -> DataFrame:
    """One row for each ordinary group, so that it drains in a start without rows of its own."""
    values = {"kind": TICK, "slice": -1, "id": 0, "client": 0, "at": 0, "cents": 0, "flags": 0, "op": None}
    kinds = {n: k for n, k in (f.split() for f in FEED.split(", "))}
    groups = spark.createDataFrame([(i,) for i in ids], "part long").coalesce(1)
    return groups.select(*("part" if n == "part" else F.lit(values[n]).cast(k).alias(n) for n, k in kinds.items()))


def _slice_ticks(pages: DataFrame) -> DataFrame:
    """One row for each slice that holds anything; all but the latest that settled a version are told that theirs is passed."""
    latest = {r["client"]: r["latest"] for r in pages.where("settled").groupBy("client").agg(F.max("slice").alias("latest")).collect()}
    passed = F.lit(False)
    if latest:  # one entry for a crowded client at most
        passed = F.col("settled") & (F.col("slice") < F.create_map(*(F.lit(x).cast("long") for pair in latest.items() for x in pair))[F.col("client")])
    zero = F.lit(0).cast("long")
    return pages.where("alive").select(
        F.when(passed, PASSED).otherwise(TICK).cast("int").alias("kind"), F.col("client").alias("part"), "slice", zero.alias("id"), "client",
        zero.alias("at"), zero.alias("cents"), F.lit(0).alias("flags"), F.lit(None).cast("string").alias("op"),
    )


def horizons(rows: DataFrame) -> list[tuple[int, int]]:
    """(H, watermark of the changes) of each batch, from the largest times of the batches before it."""
    timed = rows.where(F.col("flags").bitwiseAND(TIME_NULL) == 0)
    most = {(r["batch"], r["kind"]): r["most"] for r in timed.groupBy("batch", "kind").agg(F.max("at").alias("most")).collect()}
    seen, out = {SALE: LEAST, CHANGE: LEAST}, []
    for b in range(BATCHES):
        out.append((int(min(seen.values())), int(seen[CHANGE])))
        seen = {k: max(v, most.get((b, k), LEAST)) for k, v in seen.items()}
    return out


@contextlib.contextmanager
def _settings(spark: SparkSession, **values: str) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # many small stores: no disk is set aside for each, and those of earlier starts are closed soon
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.maintenanceInterval": "2s",
    # a store ends with its task: the next start opens stores of its own, and those of 13 starts together would fill an executor
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.minBatchesToRetain": "2",
    # the other manager starts a process for each file that it renames in a folder of the operating system
    "spark.sql.streaming.checkpointFileManagerClass": "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def enriched_sales(sales: DataFrame, changes: DataFrame) -> DataFrame:
    """Each sale with its client's version as of its time, and each late change.

    A sale without a client has no versions, one without a time no version but its client's count. Changes without a time
    are ignored, those without a client can only be late; a null change id comes before all others, and counts as 0
    in a change's batch. Rows that
    repeat count once among changes and each among sales. A missing arrival goes to the last batch. Balances that are no
    finite number have null cents. Two empty tables give no rows. Other columns of the sales are ignored; those of
    the changes tell repeated rows apart.
    """
    spark = sales.sparkSession
    base = f"{shared_dir(spark)}/valid-time-{uuid.uuid4().hex}"
    feed, out = f"{base}/feed", [f"{base}/out/{b}" for b in range(BATCHES + 1)]
    columns = [f.split()[0] for f in FEED.split(", ")]
    with scratch(spark), _settings(spark, **SETTINGS):
        rows = written(events(sales, changes).hint("rebalance", "batch"), "events", partition_by="batch")
        ids = group_ids(spark, int(spark.conf.get("spark.sql.shuffle.partitions")))
        crowd = crowded_clients(rows, len(ids))
        rows = dealt(rows, crowd, ids)
        limits = [*horizons(rows), (MOST, LEAST)]
        for batch, (horizon, late_before) in enumerate(limits):
            given = rows.where(F.col("batch") == batch).select(*columns).unionByName(_ticks(spark, ids))
            if batch and crowd.widths:
                given = given.unionByName(_slice_ticks(spark.read.schema(OUT).parquet(out[batch - 1]).where("rec = 'page'")).select(*columns))
            given.write.mode("append").parquet(feed)
            (
                spark.readStream.schema(FEED).parquet(feed)
                .groupBy("part", "slice")
                .transformWithStateInPandas(DayPages(batch, horizon, late_before), OUT, "Append", "None")
                .writeStream.foreachBatch(lambda df, _, to=out[batch]: df.write.mode("overwrite").parquet(to))
                .outputMode("append").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
            )
    found = spark.read.schema(OUT).parquet(*out)
    return resolved(found, bool(crowd.widths)).select(*(f.split()[0] for f in OUT.split(", ")[:7]))


def resolved(found: DataFrame, crowded: bool) -> DataFrame:
    """Sales of slices get their client's count, and the last version of the nearest earlier slice where their own has none."""
    done = found.where("rec <> 'page' and slice is null")
    if not crowded:
        return done
    pages = found.where("rec = 'page'")
    open_ = found.where("rec = 'sale' and slice is not null")
    version = F.when(F.col("timed"), F.struct("change_id", "balance_cents", "op"))
    where_sold = open_.groupBy("client", "batch", "slice").agg(F.lit(0).cast("long").alias("n"), F.first(F.lit(None).cast("struct<change_id:long,balance_cents:long,op:string>")).alias("version"))
    known = pages.select("client", "batch", "slice", F.col("n_held").alias("n"), version.alias("version")).unionByName(where_sold)
    known = known.groupBy("client", "batch", "slice").agg(F.sum("n").alias("n"), F.max("version").alias("version"))
    all_ = Window.partitionBy("client", "batch")
    earlier = all_.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    directory = known.select("client", "batch", "slice", F.sum("n").over(all_).alias("all_held"), F.last("version", ignorenulls=True).over(earlier).alias("before"))
    joined = open_.join(directory, ["client", "batch", "slice"], "left")
    back = F.col("timed") & ~F.col("alive")
    named = {c: F.when(back, F.col(f"before.{c}")).otherwise(F.col(c)) for c in ("change_id", "balance_cents", "op")}
    return done.unionByName(joined.withColumns(named | {"n_held": F.coalesce("all_held", F.lit(0))}).select(*done.columns))
