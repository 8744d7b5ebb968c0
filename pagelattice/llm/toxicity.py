"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has probability p = sigmoid(bias + sum of the weights of
its words and of their first letters), and the document is toxic with probability
1 - product(1 - p) (noisy-or). Weights are trained from document labels alone; the sentences with the
largest p are then the offending ones.

Training takes at most ``TOXIC_ROWS`` + ``CLEAN_ROWS`` labelled documents of at most ``LONGEST``
characters, the ones with the smallest hash of their id, so it is bounded at any input size and the
same at every run. Scoring covers the whole text of every document, without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.common import crc_mod, id_and_text, map_rows, trimmed

TOXIC_ROWS, CLEAN_ROWS, LONGEST = 1800, 2700, 20_000
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: Beginnings of words that are features besides the words themselves.
BEGINNINGS = (4, 5, 6)
#: A feature is used if the likelihood ratio statistic of its presence against the label reaches this.
LEAST_EVIDENCE = 15.0
#: Words whose weight a worker remembers; beyond it the memory is emptied, and results stay the same.
REMEMBERED = 150_000

SCHEMA = (
    "doc_id long, held_out boolean, score double, predicted int, worst_sentence int, worst_score double, "
    "offending array<int>"
)

_SENTENCE = re.compile(r"[.!?\n]+")
_WORD = re.compile(r"\w+")


def sentences(text: str) -> list[list[str]]:
    """Lower-case words of each sentence that has any."""
    return [words for part in _SENTENCE.split(text.lower()) if (words := _WORD.findall(part))]


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) >= n)]


def telling(clean: Counter[str], toxic: Counter[str], clean_n: int, toxic_n: int) -> list[str]:
    """Features, in order, whose presence in documents depends on the label."""
    names = sorted(clean.keys() | toxic.keys())
    if not clean_n:
        return names
    n = np.array([[clean[f] for f in names], [toxic[f] for f in names]], float)
    sizes = np.array([[clean_n], [toxic_n]], float)
    share = n.sum(0) / sizes.sum()
    statistic = np.zeros(len(names))
    for seen, expected in ((n, sizes * share), (sizes - n, sizes * (1 - share))):
        statistic += 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0).sum(0)
    return [f for f, x in zip(names, statistic, strict=True) if x >= LEAST_EVIDENCE]


class Model:
    """Weights of features; everything else weighs nothing."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    @classmethod
    def trained(cls, texts: list[str], labels: list[int], rounds: int = 300, rate: float = 0.5, ridge: float = 2e-4) -> Model:
        """Gradient descent with per-weight rates (AdaGrad) on the noisy-or likelihood of the labels."""
        if not any(labels):
            return cls({}, -math.inf)
        bags = [sentences(t) for t in texts]
        seen: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
        for bag, label in zip(bags, labels, strict=True):
            seen[label].update({f for w in {w for s in bag for w in s} for f in features(w)})
        index = {f: i for i, f in enumerate(telling(*seen, labels.count(0), labels.count(1)))}
        del seen
        ids: dict[str, list[int]] = {}
        at, sizes, owner = [], [], []
        for b, bag in enumerate(bags):
            for s in bag:
                found = set()
                for w in set(s):
                    if w not in ids:
                        ids[w] = [index[f] for f in features(w) if f in index]
                    found.update(ids[w])
                at.append(np.fromiter(found, np.int32, len(found)))
                sizes.append(len(found))
                owner.append(b)
        if not at:
            return cls({}, -math.inf)
        at, sizes, owner = np.concatenate(at), np.array(sizes), np.array(owner)
        row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        y = np.array(labels, float)
        w, bias = np.zeros(len(index)), -8.0
        sums, bias_sum = np.full(len(index), 1e-8), 1e-8
        # a class weighs as much as the other
        share = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
        for _ in range(rounds):
            z = np.clip(bias + np.bincount(row, w[at], len(sizes)), -30, 30)
            p = 1 / (1 + np.exp(-z))
            none = np.exp(np.bincount(owner, np.log1p(-p), len(y)))  # that no sentence is toxic
            pull = np.where(y > 0, -none / np.maximum(1 - none, 1e-9), 1.0) * share
            g = pull[owner] * p
            grad = np.bincount(at, g[row], len(index)) / len(y) + ridge * w
            bias_grad = g.sum() / len(y)
            sums += grad * grad
            bias_sum += bias_grad**2
            w -= rate * grad / np.sqrt(sums)
            bias -= 0.5 * rate * bias_grad / math.sqrt(bias_sum)
        kept = {f: float(w[i]) for f, i in index.items() if w[i]}
        return cls(kept, float(bias))

    def memory(self) -> dict[str, float]:
        weights = self.weights

        class Memory(dict):
            def __missing__(self, word: str) -> float:
                found = math.fsum(weights.get(f, 0.0) for f in features(word))
                self[word] = found
                return found

        return Memory()

    def sentence_scores(self, text: str, memory: dict[str, float]) -> list[float]:
        of = memory.__getitem__
        out = []
        for words in sentences(text):
            z = self.bias + sum(map(of, words))
            out.append(1 / (1 + math.exp(-z)) if z > -700 else 0.0)
        return out

    @staticmethod
    def combined(scores: list[float]) -> float:
        """Noisy-or; 0 for no sentence."""
        none = 1.0
        for p in scores:
            none *= 1 - p
        return 1 - none


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The bounded sample: label and text."""
    fit = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (crc_mod("doc_id", FOLDS) != HELD_OUT))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = fit.where("toxic = 1").orderBy(*order).limit(2 * TOXIC_ROWS).unionByName(fit.where("toxic = 0").orderBy(*order).limit(2 * CLEAN_ROWS))
    texts = id_and_text(docs).where(F.length("text").between(1, LONGEST))
    found = texts.join(F.broadcast(ids), "doc_id").select("toxic", "doc_id", "text")
    pick = [F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text")]
    parts = [found.where(F.col("toxic") == y).orderBy(*pick).limit(n) for y, n in ((1, TOXIC_ROWS), (0, CLEAN_ROWS))]
    return parts[0].unionByName(parts[1])


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    rows = training_rows(docs, labels).select("toxic", "text").collect()  # at most TOXIC_ROWS + CLEAN_ROWS
    return Model.trained([r.text for r in rows], [r.toxic for r in rows])


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Score, prediction and offending sentences of each row of ``docs``.

    A null or empty text, or one without words, has score 0 and no offending sentence. Without toxic
    training rows every score is 0. Repeated rows give repeated results, null ids stay null, an empty
    table gives no rows, other columns play no part. ``worst_sentence`` and ``offending`` number the
    sentences that have words from 0; of equal scores the first is the worst.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))

    def make():
        use = model.value
        memory = use.memory()

        def one(text: str) -> tuple:
            scores = use.sentence_scores(text, memory)
            worst = max(range(len(scores)), key=scores.__getitem__, default=None)
            total = use.combined(scores)
            return total, int(total >= threshold), worst, scores[worst] if scores else 0.0, [i for i, p in enumerate(scores) if p >= 0.5]

        def step(rows: dict) -> dict:
            if len(memory) > REMEMBERED:
                memory.clear()
            found = [one(t) for t in rows["text"]]
            names = ("score", "predicted", "worst_sentence", "worst_score", "offending")
            return {"doc_id": rows["doc_id"], "held_out": rows["held_out"]} | {n: [f[i] for f in found] for i, n in enumerate(names)}

        return step

    rows = id_and_text(docs).withColumn("held_out", crc_mod("doc_id", FOLDS) == HELD_OUT)
    return map_rows(rows, SCHEMA, make)


def kept_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is not predicted toxic; a null text is kept.

    Training draws on the labels of the training folds that belong to ``docs``. No shuffle: scores are
    told row by row and rows pass whole.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = model.value
        memory = use.memory()
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                if len(memory) > REMEMBERED:
                    memory.clear()
                part = batch.slice(begin, 500)
                texts = part.column(at).to_pylist()
                clean = [t is None or use.combined(use.sentence_scores(t, memory)) < threshold for t in texts]
                yield part.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(trimmed(keep), docs.schema)
