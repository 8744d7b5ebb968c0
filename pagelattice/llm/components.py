"""Connected components of a link table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.common import scratch, written


def connected(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b: long), component being its smallest node.

    Contraction: each node points at the smallest of itself and its neighbours, pointers are followed
    once more, the links are rewritten between the nodes pointed at, and so on until no link is left.
    Minima are aggregated before they are shuffled and nothing but a count reaches the driver, so a
    node with many links is no burden to one task. Links to null and from a node to itself count for
    nothing; an empty table gives an empty result.
    """
    with scratch(links.sparkSession):
        return _contracted(links)


def _contracted(links: DataFrame) -> DataFrame:
    links = links.select("a", "b").where("a is not null and b is not null and a <> b").distinct()
    links = written(links, "links")
    label = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        point = written(point.select("node", F.least("node", "least").alias("to")), "pointers")
        further = point.select(F.col("node").alias("to"), F.col("to").alias("next"))
        point = written(point.join(further, "to").select("node", F.col("next").alias("to")), "pointers")
        if label is None:
            label = point.select("node", F.col("to").alias("component"))
        else:
            moved = point.select(F.col("node").alias("component"), F.col("to").alias("next"))
            label = label.join(moved, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
        label = written(label, "components")
        for side in ("a", "b"):
            links = links.join(point.select(F.col("node").alias(side), "to"), side).drop(side).withColumnRenamed("to", side)
        links = written(links.where("a <> b").select("a", "b").distinct(), "links")
    found = label if label is not None else links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return written(found, "components", result=True)


def merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label`` (each node's smallest known companion) after linking nodes ``i`` with nodes ``j``."""
    a, b = label[i], label[j]
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0)
    if not len(pairs):
        return label
    root = np.arange(len(label))
    while True:
        least = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        new = root.copy()
        np.minimum.at(new, pairs[:, 0], least)
        np.minimum.at(new, pairs[:, 1], least)
        np.minimum.at(new, root[pairs[:, 0]], least)
        np.minimum.at(new, root[pairs[:, 1]], least)
        new = new[new]
        if (new == root).all():
            return root[label]
        root = new
