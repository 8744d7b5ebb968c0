"""Importance resampling towards a target: scores by array look-up, a top draw by merging sorted runs.

1. Words of corpus and target are counted by bucket (crc32 modulo ``BUCKETS``); the sums of all tasks are two arrays
   of that fixed length, from which the array of gains follows.
2. A second pass scores each text by that array: the floored mean of its words' gains, and a Gumbel term from its id.
3. Eligible rows form runs: each task writes its own in falling order of score. Splitters from a sample of the runs
   cut the order (score, id, place) into ranges, whose sizes are counted exactly.
4. For each range that begins before the draw's end, one task merges its pieces of all runs by a tournament tree and
   gives ranks, counting from what lies in the ranges before; the range with the draw's end stops at the exact count.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.common import Remembered, id_and_text, map_rows, trimmed, written

#: Fixed values of the contract: buckets, least words of a drawn document, percent that is drawn, seed of the noise.
BUCKETS, LEAST_WORDS, PERCENT, SEED = 10000, 20, 10, 2024
#: Rows of a range that one task merges, on average, and samples for each range from which splitters are taken.
RANGE_ROWS, SAMPLES = 1 << 18, 64
#: Ranges beyond which they get larger instead; bounds what the driver holds.
MOST_RANGES = 1 << 14
#: Words that a worker remembers with their buckets; bounds memory, changes no result.
WORDS_HELD = 1 << 19

#: Lower-cases A-Z and turns ASCII characters that are not of a word into spaces; other bytes stay.
_NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
SCORED = "doc_id long, n_features long, weight long, score long, place long"


class Buckets:
    """Buckets of a text's words."""

    def __init__(self):
        self.known = Remembered(WORDS_HELD)

    def of(self, text: str) -> np.ndarray:
        words = text.encode().translate(_NORMAL).split()
        held = self.known.held
        try:
            return np.array(list(map(held.__getitem__, words)), np.int64)
        except KeyError:
            for w in self.known.missing(set(words)):
                self.known.held[w] = zlib.crc32(w) % BUCKETS
            return np.array(list(map(self.known.held.__getitem__, words)), np.int64)


_buckets = Buckets()


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many words of all texts fall into each bucket; every task gives at most one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                total += np.bincount(_buckets.of(text.as_py()), minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    found = np.zeros(BUCKETS, np.int64)
    for r in texts.select("text").mapInArrow(trimmed(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        found[r["bucket"]] = r["n"]
    return found


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the target's smoothed share of a bucket over the source's."""
    all_s, all_t = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_s / ((s + 1.0) * all_t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None) -> int:
    """A Gumbel term in thousandths, the same for an id wherever it is computed."""
    h = int(hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_features, weight, score of each row, with a place that tells rows with one id apart."""

    def make():
        def step(rows: dict) -> dict:
            sizes, weights, scores = [], [], []
            for i, text in zip(rows["doc_id"], rows["text"], strict=True):
                found = _buckets.of(text)
                n = len(found)
                weights.append(int(gain[found].sum()) // n if n else 0)
                sizes.append(n)
                scores.append(weights[-1] + noise(i))
            return {"doc_id": rows["doc_id"], "n_features": sizes, "weight": weights, "score": scores, "place": rows["place"]}

        return step

    return map_rows(id_and_text(docs).withColumn("place", F.monotonically_increasing_id()), SCORED, make)


def sorted_runs(rows: DataFrame) -> DataFrame:
    """Each task's rows in the draw's order, with the task's number and their position in its run."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("place")]
    return rows.withColumn("run", F.spark_partition_id()).sortWithinPartitions(*order)


def _key(rows: dict[str, np.ndarray]) -> list[tuple]:
    return list(zip((-rows["score"]).tolist(), rows["doc_id"].tolist(), rows["place"].tolist(), strict=True))


class TournamentTree:
    """A tree of losers over sorted runs: ``pop`` gives (run, position) of the least head left, or None.

    A run's next head plays only against the losers on its way to the root.
    """

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.size = 1 << max(0, len(runs) - 1).bit_length()
        self.losers = [-1] * self.size
        winners = [-1] * self.size + [i if i < len(runs) else -1 for i in range(self.size)]
        for node in range(self.size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.before(a, b) else (b, a)
        self.winner = winners[1]

    def before(self, a: int, b: int) -> bool:
        if b < 0 or self.at[b] == len(self.runs[b]):
            return True
        if a < 0 or self.at[a] == len(self.runs[a]):
            return False
        return self.runs[a][self.at[a]] <= self.runs[b][self.at[b]]

    def pop(self) -> tuple[int, int] | None:
        run = self.winner
        if run < 0 or self.at[run] == len(self.runs[run]):
            return None
        found = run, self.at[run]
        self.at[run] += 1
        node = (run + self.size) // 2
        while node:
            other = self.losers[node]
            if not self.before(run, other):
                self.losers[node], run = run, other
            node //= 2
        self.winner = run
        return found


def merged_ranks(rows: dict[str, np.ndarray], first: int, draw: int) -> np.ndarray:
    """Ranks of one range's rows, which come run by run: ``first`` and on for its order, 0 beyond ``draw``."""
    n = len(rows["run"])
    starts = np.flatnonzero(np.diff(rows["run"], prepend=-1))
    keys = _key(rows)
    ends = [*starts[1:].tolist(), n]
    tree = TournamentTree([keys[a:b] for a, b in zip(starts.tolist(), ends, strict=True)])
    ranks = np.zeros(n, np.int64)
    for rank in range(first, min(draw, first + n - 1) + 1):
        run, at = tree.pop()
        ranks[starts[run] + at] = rank
    return ranks


def _splitters(runs: DataFrame, eligible: int) -> list[tuple[int, int, int]]:
    """Keys that cut the order into ranges of about ``RANGE_ROWS``, from a sample whose size depends on their number alone."""
    n = min(MOST_RANGES, -(-eligible // RANGE_ROWS))
    if n < 2:
        return []
    # rows are hashed, so that the sample is the same whenever it is read
    share = min(1.0, n * SAMPLES / eligible)
    picked = runs.where(F.pmod(F.xxhash64("place"), F.lit(1 << 30)) < int(share * (1 << 30)))
    keys = sorted((-r["score"], r["key"], r["place"]) for r in picked.select("score", "key", "place").collect())
    return sorted({keys[i * len(keys) // n] for i in range(1, n)}) if keys else []


LEAST_ID = np.iinfo(np.int64).min


def _ranged(rows: DataFrame, cuts: list[tuple[int, int, int]]) -> DataFrame:
    """``rows`` with the number of their range: how many splitters their key reaches."""
    if not cuts:
        return rows.withColumn("range", F.lit(0))
    table = np.array(cuts, np.int64).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, c = -batch.column("score").to_numpy(), batch.column("key").to_numpy(), batch.column("place").to_numpy()
            n, m = len(a), table.shape[1]
            order = np.lexsort(
                (np.arange(n + m) < n, np.concatenate([c, table[2]]), np.concatenate([b, table[1]]), np.concatenate([a, table[0]]))
            )
            passed = np.empty(n + m, np.int64)
            passed[order] = np.cumsum(order >= n)
            yield batch.append_column("range", pa.array(passed[:n], pa.int32()))

    kinds = ", ".join(f"{n} {k}" for n, k in rows.dtypes)
    return rows.mapInArrow(run, f"{kinds}, range int")


def resampled(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score of every row, and the rank of those that are drawn.

    Null and empty texts have no words, weight 0 and are not eligible. A null id gives the noise of the empty text and comes before
    other ids. Rows that repeat are drawn each; among rows with one score and id the order is that of their places. An
    empty table gives no rows, an empty target gains for rare words. Texts of any length are read whole; other columns are
    ignored.
    """
    gain = gains(bucket_counts(id_and_text(docs)), bucket_counts(target.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))))
    runs = written(sorted_runs(scored(docs, gain)), "runs").withColumn("key", F.coalesce("doc_id", F.lit(LEAST_ID)))
    can = F.col("n_features") >= LEAST_WORDS
    eligible = runs.where(can).count()
    draw = PERCENT * eligible // 100
    ranged = _ranged(runs.where(can), _splitters(runs.where(can), eligible))
    sizes = {r["range"]: r["n"] for r in ranged.groupBy("range").agg(F.count("*").alias("n")).collect()}
    before, firsts = 0, {}
    for number in sorted(sizes):
        if before < draw:
            firsts[number] = before + 1
        before += sizes[number]
    last = max(firsts, default=-1)
    columns = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            rows = {n: whole.column(n).to_numpy() for n in ("score", "place", "run")} | {"doc_id": whole.column("key").to_numpy()}
            ranks = merged_ranks(rows, firsts[whole.column("range")[0].as_py()], draw)
            drawn = pa.array(ranks, pa.int64(), mask=ranks == 0)
            return pa.RecordBatch.from_arrays([whole.column(n) for n in columns] + [drawn], names=[*columns, "rank"])

        parts: list[pa.RecordBatch] = []
        for batch in batches:
            number = batch.column("range").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if parts and parts[0].column("range")[0].as_py() != number[a]:
                    yield one(parts)
                    parts = []
                parts.append(batch.slice(a, b - a))
        if parts:
            yield one(parts)

    schema = "doc_id long, n_features long, weight long, score long, rank long"
    order = [F.col("score").desc(), F.col("key"), F.col("place")]
    drawn = ranged.where(F.col("range") <= last).repartition("range").sortWithinPartitions("range", "run", *order)
    rest = ranged.where(F.col("range") > last).select(*columns, none)
    short = runs.where(~can).select(*columns, none)
    return drawn.mapInArrow(run, schema).unionByName(rest).unionByName(short)
