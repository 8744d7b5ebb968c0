"""Near-duplicate vectors by int8 quantised tile products with rigorous error bounds.

A unit vector u is stored as codes q of int8, a scale s and the length of the error e = u - s q. For two
vectors,
    u.v <= s_u s_v (q_u.q_v) + |s_u q_u| |e_v| + |e_u|,
so the integer product of two tiles of codes tells which pairs can reach the threshold; only those are
computed in full precision. The product is exact: it is taken over at most ``EXACT`` dimensions at a time,
whose sums a float32 holds without rounding, so that it runs at the speed of a matrix product. What the
arithmetic of the bound itself can lose is bounded from the dimension (``lost``). Equal vectors are one class
with a count, and a class is compared once.

Most tiles need half of that: with the length of a vector's second half as one more number after its first half, the product
of two such heads is never below the cosine, so codes of the heads come first (``Heads``). Only where they
leave many pairs of a tile do the codes of the whole vectors follow.

All classes are compared: they are dealt by hash into groups of bounded size, and a cell of the grid
compares two groups. A cell gives the number of links of each class and a spanning forest of its
links, never the pairs. The number of cells grows with the square of the classes, which is the
method's price; a cell's memory does not grow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.common import scratch, written
from pagelattice.llm.components import connected, merged

THRESHOLD = 0.9
#: Vectors of a group of the grid, and rows of a tile.
GROUP, TILE = 4096, 512
#: Dimensions whose products of codes sum to less than 2**24.
EXACT = (1 << 24) // 127**2
#: Pairs computed in full precision at a time, and links merged at a time.
PAIRS = 100_000
#: A tile of which heads leave more than this part is compared by whole codes.
MANY = 1 / 256


def lost(dimension: int) -> float:
    """More than rounding to float64 can move a cosine and its bound: norms, quotients and sums of ``dimension`` terms."""
    return (4 * dimension + 32) * 2.0**-52


class Quantised:
    """Codes, scales, error lengths and code lengths of the rows of ``unit``."""

    def __init__(self, unit: np.ndarray):
        scale = np.abs(unit).max(1) / 127
        self.codes = np.rint(unit / scale[:, None]).astype(np.int8)
        stored = scale[:, None] * self.codes
        self.scale = scale
        self.error = np.linalg.norm(unit - stored, axis=1)
        self.length = np.linalg.norm(stored, axis=1)

    def products(self, rows: slice, other: Quantised, columns: slice) -> np.ndarray:
        """The integer products of two tiles of codes, exactly."""
        a, b = self.codes[rows], other.codes[columns]
        out = None
        for at in range(0, a.shape[1], EXACT):
            part = a[:, at : at + EXACT].astype(np.float32) @ b[:, at : at + EXACT].astype(np.float32).T
            out = part if out is None else out.astype(np.float64) + part
        return out

    def possible(self, rows: slice, other: Quantised, columns: slice, threshold: float) -> np.ndarray:
        """Whether the bound of a pair of rows reaches ``threshold``; the columns' largest error stands for all of theirs."""
        least = threshold - lost(self.codes.shape[1]) - self.error[rows] - self.length[rows] * other.error[columns].max(initial=0)
        needed = np.outer(least / self.scale[rows], 1 / other.scale[columns])
        needed -= np.abs(needed) * 2.0**-20
        return self.products(rows, other, columns) >= needed


class Heads:
    """Codes of the first half of each row of ``unit`` and of the length of its rest, under one scale, so that a row needs one bound."""

    def __init__(self, unit: np.ndarray):
        self.dimension = unit.shape[1]
        first = min(self.dimension // 2, EXACT - 1)
        head = np.column_stack([unit[:, :first], np.linalg.norm(unit[:, first:], axis=1)])
        self.scale = np.abs(head).max() / 127
        codes = np.rint(head / self.scale).astype(np.int8)
        stored = self.scale * codes
        self.codes = codes.astype(np.float32)  # as products take them
        self.error = np.linalg.norm(head - stored, axis=1)
        self.length = np.linalg.norm(stored, axis=1)

    def possible(self, rows: slice, other: Heads, columns: slice, threshold: float) -> np.ndarray:
        """Whether the bound of a pair of rows reaches ``threshold``, by an exact product of integers."""
        least = threshold - lost(self.dimension) - self.error[rows] - self.length[rows] * other.error[columns].max(initial=0)
        needed = least / (self.scale * other.scale)
        needed -= np.abs(needed) * 2.0**-20
        return self.codes[rows] @ other.codes[columns].T >= needed.astype(np.float32)[:, None]


def near_pairs(x: np.ndarray, y: np.ndarray | None, threshold: float):
    """Arrays (i, j) of rows of x and y, or of x and later rows of x, with cosine >= threshold, tile by tile."""
    norms_x = np.linalg.norm(x, axis=1)
    z, norms_z = (x, norms_x) if y is None else (y, np.linalg.norm(y, axis=1))
    heads = Heads(x / norms_x[:, None])
    others = heads if y is None else Heads(z / norms_z[:, None])
    whole = None
    for a in range(0, len(x), TILE):
        for b in range(a if y is None else 0, len(z), TILE):
            tile = slice(a, a + TILE), slice(b, b + TILE)
            maybe = heads.possible(tile[0], others, tile[1], threshold)
            at = np.flatnonzero(maybe)
            if len(at) > MANY * maybe.size:
                whole = whole or (Quantised(x / norms_x[:, None]), Quantised(z / norms_z[:, None]))
                at = np.flatnonzero(maybe & whole[0].possible(tile[0], whole[1], tile[1], threshold))
            i, j = np.divmod(at, maybe.shape[1])
            i, j = i + a, j + b
            if y is None:
                later = i < j
                i, j = i[later], j[later]
            for at in range(0, len(i), PAIRS):
                s, t = i[at : at + PAIRS], j[at : at + PAIRS]
                near = np.einsum("ij,ij->i", x[s], z[t]) / (norms_x[s] * norms_z[t]) >= threshold
                yield s[near], t[near]


def _gathered(pairs):
    """The same pairs in fewer arrays, of ``PAIRS`` or little more."""
    held = []
    for found in pairs:
        held.append(found)
        if sum(len(i) for i, _ in held) >= PAIRS:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held = []
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _cell(threshold: float):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        low, high = (k.as_py() for k in key)
        group, ids, many = (rows.column(n).to_numpy() for n in ("part", "node", "many"))
        lists = rows.column("embedding").combine_chunks()
        values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.cumsum(size) - size
        links = np.zeros(len(ids), np.int64)
        label = np.arange(len(ids))
        # in one order wherever a cell runs again
        order = np.argsort(ids, kind="stable")
        ids, many, group, size, start = ids[order], many[order], group[order], size[order], start[order]
        for d in np.unique(size):  # vectors of different dimensions have no cosine
            here = np.flatnonzero((size == d) & (group == low))
            there = np.flatnonzero((size == d) & (group == high)) if low != high else None
            if not len(here) or there is not None and not len(there):
                continue
            take = lambda at: values[start[at][:, None] + np.arange(d)]
            for i, j in _gathered(near_pairs(take(here), None if there is None else take(there), threshold)):
                i, j = here[i], (here if there is None else there)[j]
                np.add.at(links, i, many[j])
                np.add.at(links, j, many[i])
                label = merged(label, i, j)
        linked = links > 0
        return pa.table({"node": ids[linked], "links": links[linked], "root": ids[label[linked]]})

    return run


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do
    rows with a null id, which have a null component and are not kept. Each repeated row counts as a
    vector of its own. Vectors of different dimensions never link. Labels and other columns play no
    part; an empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    valid = F.coalesce(F.col("vec_id").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("valid", valid)
    with scratch(vectors.sparkSession):
        classes = rows.where("valid").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many"))
        # numbered once and for all by being written: two classes may carry the same smallest id
        classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
        groups = max(1, -(-classes.count() // GROUP))
        dealt = (
            classes.withColumn("part", F.pmod(F.xxhash64("embedding"), F.lit(groups)))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
            .select(F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "many", "embedding")
        )
        found = dealt.groupBy("low", "high").applyInArrow(_cell(threshold), "node long, links long, root long")
        found = written(found, "vector-links")
        component = connected(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
        linked = classes.select("node", "rep").join(component, "node")
        least = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
        sums = found.groupBy("node").agg(F.sum("links").alias("links"))
        told = (
            classes.join(sums, "node", "left")
            .join(linked.join(least, "component").select("node", "component_id"), "node", "left")
            .select(
                "embedding",
                F.lit(True).alias("valid"),
                (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"),
                F.coalesce("component_id", "rep").alias("component_id"),
            )
        )
        told = written(told, "vector-components", result=True)  # so that the join exchanges both sides and a frequent vector's rows can be split
    out = rows.join(told, ["embedding", "valid"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
