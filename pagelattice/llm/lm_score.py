"""Language-model scores by deleted interpolation.

The probability of a word w after a word v is
    a(b) c(v,w)/c(v) + u(b) c(w)/N + z(b) / (V+1),
with counts of the training documents, b the bucket of the context's frequency (the number of binary
digits of c(v)) and a, u, z >= 0 with sum 1 in each bucket. The mixture weights are learned by
expectation-maximisation on counts of a deleted part of the training documents, with the n-gram
estimates taken from the rest; scores then use the counts of all training documents. EM starts from
the solution on a coarse grid of estimates and goes on over the exact counts, as an aggregation with
one row for each distinct (bucket, counts), until no weight moves by more than ``TOLERANCE``.

Counting at scale: a task cuts its documents into batches of bounded size, and gives for each batch
the sorted distinct keys (64-bit hashes) of its words and word pairs with their counts, dealt by key
range. A reducer for a range sums the counts of all batches and answers each batch with the totals of
its keys, in their order, so answers need no keys. Batch and answers then meet again, and the texts
are scored with whole-corpus counts. A frequent word is one key per batch, so no range is hot. A batch
gives a row only for a range in which it has a key, so rows are never more than keys, however many
ranges a large corpus has. Nothing that grows with the corpus is held by one task, broadcast or sent to
the driver.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.common import id_and_text, scratch, steady_scans, trimmed, written

FOLDS, HELD_OUT, DELETED = 7, 2, 3
#: Bytes of text of a batch, and of the corpus per range of keys; they bound memory and change no result.
BATCH_BYTES, RANGE_BYTES, LEAST_RANGES = 4 << 20, 10 << 20, 48
#: Steps per octave of the coarse grid that EM starts from, and its rounds there.
STEPS, ROUNDS = 2, 60
#: EM over the exact counts ends when no weight moves by more, or after so many rounds.
TOLERANCE, MOST_ROUNDS = 1e-4, 60
BUCKETS = 64

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: The end of a text, which is also the context of its first word; no word is empty.
END = xxhash.xxh64_intdigest(b"")

FORWARD = "range int, pairs boolean, batch long, deleted boolean, keys binary, n_all binary, n_deleted binary"
ANSWER = (
    "batch long, deleted boolean, pairs boolean, range int, n int, c_all binary, c_deleted binary, "
    "total long, total_deleted long, distinct long"
)
TEXTS = "batch long, doc_id long, text string"
SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def fold(doc_id: int | None) -> int:
    """crc32 of the id as text; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def keys_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each token of all texts, ends included: its key, its context's key, the pair's key; and each text's size."""
    vocabulary = _Vocabulary()
    of = vocabulary.__getitem__
    ids, sizes = [], np.zeros(len(texts), np.int64)
    end = of(b"")
    for i, text in enumerate(texts):
        words = text.encode().translate(_LOWER).split()  # splits at \x20 and \x09-\x0D
        found = np.fromiter(map(of, words), np.int32, len(words))
        ids += [found, [end]]
        sizes[i] = len(words) + 1
    tokens = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))
    word = hashes[tokens]
    context = np.empty_like(word)
    context[1:] = word[:-1]
    if len(sizes):
        context[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = END
    pair = context * np.uint64(0x9E3779B97F4A7C15) ^ word * np.uint64(0xC2B2AE3D27D4EB4F)
    pair ^= pair >> np.uint64(31)
    pair *= np.uint64(0xD6E8FEB86659FD93)
    pair ^= pair >> np.uint64(32)
    return word, context, pair, sizes


def pack_counts(counts: np.ndarray) -> bytes:
    """One byte for each count below 255; larger ones follow with their places."""
    large = np.flatnonzero(counts >= 255).astype("<u4")
    small = np.minimum(counts, 255).astype(np.uint8)
    return small.tobytes() + large.tobytes() + counts[large].astype("<u8").tobytes()


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, np.uint8, n).astype(np.int64)
    many = (len(data) - n) // 12
    if many:
        counts[np.frombuffer(data, "<u4", many, n)] = np.frombuffer(data, "<u8", many, n + 4 * many)
    return counts


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, list, list]]:
    """(batch, deleted, doc_ids, texts), the same at every run over the same rows; deleted documents have their own."""
    first = TaskContext.get().partitionId() << 24
    held: dict[bool, tuple[list, list]] = {False: ([], []), True: ([], [])}
    size = {False: 0, True: 0}
    made = 0
    for batch in batches:
        lengths = pc.binary_length(batch.column(1)).to_pylist()
        for doc, text, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), lengths, strict=True):
            d = fold(doc) == DELETED
            held[d][0].append(doc)
            held[d][1].append(text)
            size[d] += length + 16
            if size[d] >= BATCH_BYTES:
                yield first + made, d, *held[d]
                held[d], size[d], made = ([], []), 0, made + 1
    for d in (False, True):
        if held[d][0]:
            yield first + made, d, *held[d]
            made += 1


def _distinct(keys: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    unique, at = np.unique(keys, return_inverse=True)
    return unique, np.bincount(at, weights, len(unique)).astype(np.int64)


def _forward(ranges: int):
    width = np.uint64(-(-(1 << 64) // ranges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, deleted, docs, texts in _batched(batches):
            word, _, pair, sizes = keys_of(texts)
            training = np.repeat([fold(d) != HELD_OUT for d in docs], sizes).astype(np.float64)
            rows = []
            for pairs, keys in ((False, word), (True, pair)):
                unique, n_all = _distinct(keys, training)
                n_deleted = n_all if deleted else np.zeros_like(n_all)
                of = (unique // width).astype(np.int64)
                starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(unique)], strict=True):
                    rows.append((int(of[a]), pairs, batch, deleted, unique[a:b].tobytes(), pack_counts(n_all[a:b]), pack_counts(n_deleted[a:b])))
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
            names = [p.strip().split()[0] for p in FORWARD.split(",")]
            for at in range(0, len(rows), 32):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 32], k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def _sum_range(rows: pa.Table) -> pa.Table:
    """The totals of one range's keys, as answers to its batches."""
    t = rows.to_pydict()
    keys = [np.frombuffer(k, np.uint64) for k in t["keys"]]
    sizes = [len(k) for k in keys]
    unique, at = np.unique(np.concatenate(keys), return_inverse=True)
    totals = []
    for name in ("n_all", "n_deleted"):
        n = np.concatenate([unpack_counts(d, s) for d, s in zip(t[name], sizes, strict=True)])
        totals.append(np.bincount(at, n, len(unique)).astype(np.int64))
    out = {n: [] for n in ("c_all", "c_deleted")}
    begin = 0
    for s in sizes:
        here = at[begin : begin + s]
        out["c_all"].append(pack_counts(totals[0][here]))
        out["c_deleted"].append(pack_counts(totals[1][here]))
        begin += s
    once = lambda v: [int(v), *[0] * (len(sizes) - 1)]
    return pa.table(
        {
            "batch": pa.array(t["batch"], pa.int64()),
            "deleted": pa.array(t["deleted"], pa.bool_()),
            "pairs": pa.array(t["pairs"], pa.bool_()),
            "range": pa.array(t["range"], pa.int32()),
            "n": pa.array(sizes, pa.int32()),
            "c_all": pa.array(out["c_all"], pa.binary()),
            "c_deleted": pa.array(out["c_deleted"], pa.binary()),
            "total": pa.array(once(totals[0].sum()), pa.int64()),
            "total_deleted": pa.array(once(totals[1].sum()), pa.int64()),
            "distinct": pa.array(once((totals[0] > 0).sum()), pa.int64()),
        }
    )


def _texts(only_deleted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, deleted, docs, texts in _batched(batches):
            if only_deleted and not deleted:
                continue
            for at in range(0, len(docs), 500):
                part = docs[at : at + 500]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch] * len(part), pa.int64()), pa.array(part, pa.int64()), pa.array(texts[at : at + 500], pa.string())],
                    names=["batch", "doc_id", "text"],
                )

    return run


def _counts(answers: pa.Table, pairs: bool, keys: np.ndarray, names: tuple[str, ...]) -> list[np.ndarray]:
    """For each name the corpus counts of ``keys``."""
    t = answers.to_pydict()
    rows = sorted((t["range"][i], i) for i, p in enumerate(t["pairs"]) if p == pairs)
    unique, at = np.unique(keys, return_inverse=True)
    if sum(t["n"][i] for _, i in rows) != len(unique):
        raise RuntimeError("a batch changed between two scans of the documents; stage them as a table first")
    return [np.concatenate([unpack_counts(t[n][i], t["n"][i]) for _, i in rows])[at] for n in names]


def bucket(context_counts: np.ndarray) -> np.ndarray:
    """The number of binary digits of a context's count."""
    return np.ceil(np.log2(context_counts + 1.0)).astype(np.int64)


def estimates(c_pair, c_context, c_word, total: int, distinct: int):
    """Maximum-likelihood estimates of a pair and of a word, and the uniform one."""
    with np.errstate(divide="ignore", invalid="ignore"):
        p2 = np.where(c_context > 0, c_pair / np.maximum(c_context, 1), 0.0)
    return p2, c_word / max(total, 1), 1.0 / (distinct + 1)


def spread_weights(weights: np.ndarray, shown: set[int]) -> np.ndarray:
    """A bucket that the deleted part doesn't show takes the nearest lower one's weights; no weight is zero."""
    weights = weights.copy()
    for k in range(1, len(weights)):
        if k not in shown and (k - 1 in shown or k > 1):
            weights[k] = weights[k - 1]
    weights = np.maximum(weights, 1e-9)
    return weights / weights.sum(1, keepdims=True)


def first_weights() -> np.ndarray:
    weights = np.tile([0.5, 0.4, 0.1], (BUCKETS, 1))
    weights[0] = [0.0, 0.9, 0.1]  # a context that was not seen has no pairs
    return weights


def coarse(histogram: list[tuple]) -> np.ndarray:
    """EM on a grid: buckets x (pair, word, uniform) weights from (bucket, pair step, word step, tokens), a null step being zero."""
    weights = first_weights()
    if histogram:
        b = np.array([h[0] for h in histogram])
        n = np.array([h[3] for h in histogram], float)
        ratios = np.array([[0.0 if x is None else 2.0 ** (x / STEPS) for x in (h[1], h[2])] + [1.0] for h in histogram])
        for _ in range(ROUNDS):
            share = weights[b] * ratios
            share *= (n / share.sum(1))[:, None]
            sums = np.stack([np.bincount(b, share[:, k], BUCKETS) for k in range(3)], 1) + 1e-9 * weights
            weights = sums / sums.sum(1, keepdims=True)
    return weights


def learned(seen: DataFrame, total: int, distinct: int) -> np.ndarray:
    """EM over ``seen`` (bucket, c_pair, c_context, c_word, n) until the weights of all buckets stand still.

    A round is one aggregation to a row a bucket; no more reaches the driver.
    """
    spark = seen.sparkSession
    p2 = F.when(F.col("c_context") > 0, F.col("c_pair") / F.greatest("c_context", F.lit(1))).otherwise(F.lit(0.0))
    seen = seen.select("bucket", "n", p2.alias("p2"), (F.col("c_word") / F.lit(float(max(total, 1)))).alias("p1"))
    p0 = 1.0 / (distinct + 1)
    step = lambda p: F.when(F.col(p) > 0, F.round(STEPS * F.log2(F.col(p) / F.lit(p0))).cast("long"))
    # at most one row for each cell of a fixed grid
    grid = seen.groupBy("bucket", step("p2").alias("s2"), step("p1").alias("s1")).agg(F.sum("n").alias("n")).collect()
    shown = {r.bucket for r in grid}
    weights = coarse([tuple(r) for r in grid])
    for _ in range(MOST_ROUNDS if grid else 0):
        now = spark.createDataFrame([(k, *map(float, w)) for k, w in enumerate(weights)], "bucket long, w2 double, w1 double, w0 double")
        parts = [F.col("w2") * F.col("p2"), F.col("w1") * F.col("p1"), F.col("w0") * F.lit(p0)]
        shared = seen.join(F.broadcast(now), "bucket").select("bucket", "n", *[p.alias(f"s{k}") for k, p in enumerate(parts)], sum(parts).alias("all"))  # 64 rows
        sums = shared.groupBy("bucket").agg(*[F.sum(F.col("n") * F.col(f"s{k}") / F.col("all")).alias(f"s{k}") for k in range(3)]).collect()
        before = weights.copy()
        for r in sums:
            found = np.array([r.s0, r.s1, r.s2]) + 1e-9
            weights[r.bucket] = found / found.sum()
        if np.abs(weights - before).max() <= TOLERANCE:
            break
    else:
        if grid:
            warnings.warn(f"the weights still moved by more than {TOLERANCE} after {MOST_ROUNDS} rounds", stacklevel=2)
    return spread_weights(weights, shown)


def score_documents(docs: DataFrame, stage: bool = False) -> DataFrame:
    """Counts and log10 probabilities of each row of ``docs`` under the base and the interpolated model.

    A null text counts as empty: one token, the end. A null id belongs to the training documents.
    Repeated rows count each time and get equal scores; an empty table gives no rows; other columns
    are ignored; texts of any length are read whole. ``docs`` must be a scan of files, which is split alike in all jobs here even where the
    number of cores changes between them; anything else needs ``stage=True``, which writes it first. The scores are written as well.
    """
    with steady_scans(docs.sparkSession):
        return written(_scored(docs, stage), "lm-scores")


def _scored(docs: DataFrame, stage: bool) -> DataFrame:
    spark = docs.sparkSession
    docs = id_and_text(docs)
    if stage:
        docs = written(docs, "lm-documents")
    size = docs.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    ranges = max(LEAST_RANGES, -(-size // RANGE_BYTES))
    forward = docs.mapInArrow(trimmed(_forward(ranges)), FORWARD)
    answers = written(forward.groupBy("range", "pairs").applyInArrow(_sum_range, ANSWER), "lm-counts")
    sums = answers.groupBy("pairs").agg(*[F.sum(c).alias(c) for c in ("total", "total_deleted", "distinct")]).collect()
    words = next((r for r in sums if not r.pairs), None)
    total, rest, distinct = (words.total, words.total - words.total_deleted, words.distinct) if words else (0, 0, 0)

    def observe(key: tuple, texts: pa.Table, counted: pa.Table) -> pa.Table:
        names = ("bucket", "c_pair", "c_context", "c_word")
        found = np.zeros((0, 4), np.int64), np.zeros(0, np.int64)
        if texts.num_rows and counted.num_rows:
            word, context, pair, _ = keys_of(texts.column("text").to_pylist())
            c_all, c_del = _counts(counted, False, word, ("c_all", "c_deleted"))
            unique, first = np.unique(word, return_index=True)
            c_word = c_all - c_del
            c_context = c_word[first][np.searchsorted(unique, context)]
            c_pair = np.subtract(*_counts(counted, True, pair, ("c_all", "c_deleted")))
            found = np.unique(np.stack([bucket(c_context), c_pair, c_context, c_word], 1), axis=0, return_counts=True)
        return pa.table({**{k: pa.array(found[0][:, i], pa.int64()) for i, k in enumerate(names)}, "n": pa.array(found[1], pa.int64())})

    seen = (
        docs.mapInArrow(trimmed(_texts(True)), TEXTS)
        .groupBy("batch")
        .cogroup(answers.where("deleted").groupBy("batch"))
        .applyInArrow(observe, "bucket long, c_pair long, c_context long, c_word long, n long")
        .groupBy("bucket", "c_pair", "c_context", "c_word")
        .agg(F.sum("n").alias("n"))
    )
    with scratch(spark):
        found = learned(written(seen, "lm-held-out"), rest, distinct)
    weights = spark.sparkContext.broadcast(found)  # 64 x 3 numbers

    def score(key: tuple, texts: pa.Table, counted: pa.Table) -> pa.Table:
        doc_ids = texts.column("doc_id").to_pylist()
        word, context, pair, sizes = keys_of(texts.column("text").to_pylist())
        if doc_ids:
            (c_word,) = _counts(counted, False, word, ("c_all",))
            unique, first = np.unique(word, return_index=True)
            c_context = c_word[first][np.searchsorted(unique, context)]
            (c_pair,) = _counts(counted, True, pair, ("c_all",))
            p2, p1, p0 = estimates(c_pair, c_context, c_word, total, distinct)
            w = weights.value[bucket(c_context)]
            model = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0)
            base = np.log10((c_word + 1) / (total + 1 * (distinct + 1)))
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            known, base, model = (np.add.reduceat(x, starts) for x in ((c_word > 0).astype(np.int64), base, model))
        else:
            known = base = model = []
        return pa.table(
            {
                "doc_id": pa.array(doc_ids, pa.int64()),
                "held_out": pa.array([fold(d) == HELD_OUT for d in doc_ids], pa.bool_()),
                "n_tokens": pa.array(sizes, pa.int64()),
                "n_known": pa.array(known, pa.int64()),
                "train_tokens": pa.array([total] * len(doc_ids), pa.int64()),
                "base_score": pa.array(base, pa.float64()),
                "score": pa.array(model, pa.float64()),
            }
        )

    return docs.mapInArrow(trimmed(_texts(False)), TEXTS).groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(score, SCORES)
