"""Positioned text: reading order, fingerprints, sequence alignment, drift.

Items are (pair_id, side, ord, text, x, y, w, h, font_size). What depends on order or on earlier results runs in
one Python function per pair; the rest are windows and aggregates over its result, so the alignment runs once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagelattice.functions import text
from pagelattice.operators.groups import spread

DRIFT, REFLOW, FUZZY_LENGTH, FUZZY_SHARE = 24, 0.9, 6, 0.15
COALESCE_EM, LOCAL_NEIGHBOURS = 0.6, 10
#: Keys of fewer characters are told apart by two and three letters in a row, longer ones by two and five.
LONG_KEY = 48
#: Pairs of keys that are weighed at once, and numbers that are held as counts of letters in a row.
PAIRS, HELD = 1 << 14, 1 << 22
#: Slots of letter counts: digits, the space, and letters by their place among 64.
SLOTS = 64
_SLOT = np.arange(256) % SLOTS
_SLOT[48:58], _SLOT[32] = np.arange(10), 10


def first_items(items: DataFrame, keys: list[str]) -> DataFrame:
    """Items with a text, the first of equal (normalised text, x, y)."""
    normal = items.withColumn("norm", text.line("text")).where("norm <> ''")
    rank = F.row_number().over(Window.partitionBy(*keys, "norm", "x", "y").orderBy("ord"))
    return normal.withColumn("__n", rank).where("__n = 1").drop("__n")


def reading_order(items: list[dict], tolerance: float | None = None) -> list[dict]:
    """Lines are gathered by the running mean of their items' middles, then read from left to right.

    The tolerance is 0.6 of the upper median height, rounded with halves up, and 6 at least.
    """
    if not items:
        return items
    heights = sorted(it["h"] for it in items)
    tolerance = max(6, math.floor(heights[len(heights) // 2] * 0.6 + 0.5)) if tolerance is None else tolerance
    found = sorted(items, key=lambda it: (it["y"], it["x"], it["ord"]))
    lines, number, mean, size = [], -1, 0.0, 0
    for it in found:
        m = it["y"] + it["h"] / 2
        if number >= 0 and abs(m - mean) <= tolerance:
            size += 1
            mean = (mean * (size - 1) + m) / size
        else:
            number, mean, size = number + 1, m, 1
        lines.append(number)
    return [it for _, it in sorted(zip(lines, found, strict=True), key=lambda p: (p[0], p[1]["x"]))]


def coalesced(ordered: pd.DataFrame) -> pd.DataFrame:
    """An item continues the one before if both share a line, a font size to within 1, and a small gap."""
    return pd.DataFrame(_coalesced(ordered.to_dict("records")), columns=ordered.columns)


def _coalesced(ordered: list[dict]) -> list[dict]:
    out: list[dict] = []
    for it in ordered:
        prev = out[-1] if out else None
        if prev is not None:
            same_line = abs(prev["y"] + prev["h"] / 2 - it["y"] - it["h"] / 2) <= min(prev["h"], it["h"]) * 0.5
            gap = it["x"] - prev["x"] - prev["w"]
            em = it["font_size"] or prev["font_size"] or 16
            if same_line and abs((prev["font_size"] or 0) - (it["font_size"] or 0)) <= 1 and -3 <= gap <= COALESCE_EM * em:
                prev["w"] = max(prev["x"] + prev["w"], it["x"] + it["w"]) - prev["x"]
                prev["h"] = max(prev["y"] + prev["h"], it["y"] + it["h"]) - prev["y"]
                for c in ("text", "norm"):
                    prev.setdefault("parts", {k: [prev[k]] for k in ("text", "norm")})[c].append(it[c])
                continue
        out.append(it)
    for it in out:
        parts = it.pop("parts", None)
        if parts:  # joined once: a line of many items is not copied for each
            it["text"], it["norm"] = " ".join(" ".join(parts["text"]).split()), " ".join(parts["norm"])
    return out


def ordered_items(items: DataFrame, keys: list[str], coalesce: bool = False) -> DataFrame:
    """Items of W4 in reading order, with ``index`` from 0. The items of a page are gathered in a row, so batches hold many pages."""
    first = first_items(spread(items, *keys), keys)
    columns = [c for c in first.columns if c not in keys]
    gathered = first.groupBy(*keys).agg(F.collect_list(F.struct(*columns)).alias("items"))
    schema = first.select(*keys, *columns, F.lit(0).alias("index")).schema
    held = to_arrow_schema(schema)

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            rows = []
            for page in part.to_pylist():
                found = reading_order(page["items"])
                own = {k: page[k] for k in keys}
                rows += [own | it | {"index": i} for i, it in enumerate(_coalesced(found) if coalesce else found)]
            yield pa.RecordBatch.from_pylist(rows, schema=held)

    return gathered.mapInArrow(pages, schema).select(*first.columns, "index")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few pages at a time; only those become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, PAGES):
            yield batch.slice(at, PAGES)


def with_deltas(ordered: DataFrame, keys: list[str]) -> DataFrame:
    """Distance to the item before; 0 for the first."""
    before = Window.partitionBy(*keys).orderBy("index")
    return ordered.withColumns({f"d{c}": F.coalesce(F.col(c) - F.lag(c).over(before), F.lit(0)) for c in ("x", "y")})


def prepared(items: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    """Without page chrome, with a key that is not empty."""
    found = items.where(~text.is_chrome(F.col("text"))).withColumn("key", text.match_key(F.col("text"), rules or []))
    return found.where("key <> ''")


def most_edits(a: Column, b: Column) -> Column:
    """Edits that two keys may differ by: 15 % of the shorter one, 1 at least; none below 6 characters."""
    shorter = F.least(F.length(a), F.length(b))
    return F.when(shorter < FUZZY_LENGTH, 0).otherwise(F.greatest(F.lit(1), F.floor(shorter * F.lit(FUZZY_SHARE)).cast("int")))


def keys_alike(a: Column, b: Column) -> Column:
    """J11."""
    near = (F.least(F.length(a), F.length(b)) >= FUZZY_LENGTH) & (F.abs(F.length(a) - F.length(b)) <= most_edits(a, b))
    return (a == b) | (near & (F.levenshtein(a, b) <= most_edits(a, b)))


def _edits_within(a: str, b: str, most: int) -> bool:
    """Whether the Levenshtein distance is at most ``most``, by bit-parallel rows of differences (Myers 1999)."""
    if abs(len(a) - len(b)) > most:
        return False
    if not a or not b:
        return max(len(a), len(b)) <= most
    same = next((i for i, (c, d) in enumerate(zip(a, b, strict=False)) if c != d), min(len(a), len(b)))
    a, b = a[same:], b[same:]
    same = next((i for i, (c, d) in enumerate(zip(reversed(a), reversed(b), strict=False)) if c != d), min(len(a), len(b)))
    a, b = a[: len(a) - same], b[: len(b) - same]
    if not a or not b:
        return max(len(a), len(b)) <= most
    all_, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    places = _places(a, set(b))
    up, down, distance, left, apart = all_, 0, len(a), len(b), abs(len(a) - len(b))
    for at, c in enumerate(b):
        if at % 32 == 0 and at <= len(a):  # the least that begins of equal length cost, less what the lengths differ by
            square = (1 << at) - 1
            if at + (up & square).bit_count() - (down & square).bit_count() - apart > most:
                return False
        same = places.get(c, 0)
        vertical = same | down
        horizontal = ((same & up) + up ^ up) | same
        rise = (down | ~(horizontal | up)) & all_
        fall = up & horizontal
        distance += 1 if rise & last else -1 if fall & last else 0
        left -= 1
        if distance - left > most:
            return False
        rise = (rise << 1 | 1) & all_
        fall = fall << 1 & all_
        up = (fall | ~(vertical | rise)) & all_
        down = rise & vertical
    return distance <= most


def _places(a: str, asked: set[str]) -> dict[str, int]:
    """Of each asked character its places in ``a`` as bits, the first place last."""
    found: dict[str, int] = {}
    if len(a) < 2048:
        for i, c in enumerate(a):
            found[c] = found.get(c, 0) | 1 << i
        return found
    codes = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
    return {c: int.from_bytes(np.packbits(codes == ord(c), bitorder="little").tobytes(), "little") for c in asked}


def _letters(keys: list[str]) -> np.ndarray:
    """How often a key holds each letter; letters that share a slot only make keys look more alike."""
    coded = [k.encode("latin-1", "replace") for k in keys]
    rows = np.repeat(np.arange(len(keys)), [len(c) for c in coded])
    at = rows * SLOTS + _SLOT[np.frombuffer(b"".join(coded), np.uint8)]
    return np.bincount(at, minlength=len(keys) * SLOTS).reshape(-1, SLOTS).astype(np.int32)


def _grams(k: str, q: int) -> np.ndarray:
    """How often a key holds each ``q`` letters in a row, in so many slots that few share one."""
    c = np.frombuffer(k.encode("latin-1", "replace"), np.uint8).astype(np.int64)
    code = c[: len(c) - q + 1].copy()
    for i in range(1, q):
        code = code * 31 + c[i : len(c) - q + 1 + i]
    size = 1 << (10 if q == 2 else min(18, max(8, (16 * len(k)).bit_length())))
    return np.bincount((code * 0x9E3779B1 >> 13) & size - 1, minlength=size).astype(np.int32)


class _Near:
    """Whether the counts of letters in a row of two keys differ by no more than ``most`` edits can change; holds a bounded number of counts."""

    def __init__(self):
        self.held, self.size = {}, 0

    def counts(self, k: str, q: int) -> np.ndarray:
        found = self.held.get((k, q))
        if found is None:
            if self.size > HELD:
                self.held, self.size = {}, 0
            found = self.held[k, q] = _grams(k, q)
            self.size += len(found)
        return found

    def __call__(self, a: str, b: str, most: int) -> bool:
        for q in (2, 3 if min(len(a), len(b)) < LONG_KEY else 5):  # the one tells other words, the other another order
            x, y = self.counts(a, q), self.counts(b, q)
            size = min(len(x), len(y))
            x, y = (g if len(g) == size else g.reshape(-1, size).sum(0) for g in (x, y))
            if int(np.abs(x - y).sum()) > 2 * q * most:
                return False
        return True


def _alike(a: list[str], b: list[str]) -> list[list[int]]:
    """For each key of ``a`` the places of its alike keys in ``b``, rising; equal keys share one list.

    An edit changes the length by 1, the letter counts by 2 and the counts of q letters in a row by 2 q at most, so keys are looked up in
    a window of lengths, and both counts exclude most of those before any edit distance is computed.
    """
    places: dict[str, list[int]] = {}
    for j, k in enumerate(b):
        places.setdefault(k, []).append(j)
    found = {k: [k] if k in places else [] for k in a}
    left, right = ([k for k in keys if len(k) >= FUZZY_LENGTH] for keys in (found, places))
    if left and right:
        right.sort(key=len)
        sizes = np.array([len(k) for k in right])
        lengths = np.array([len(k) for k in left])
        most = np.maximum(1, np.floor(lengths * FUZZY_SHARE).astype(int))
        lo, hi = np.searchsorted(sizes, lengths - most), np.searchsorted(sizes, lengths + most, "right")
        counts_near = _Near()
        begun, upto = 0, np.cumsum(hi - lo)
        while begun < len(left):  # as many keys as have a bounded number of pairs, one at least
            end = max(begun + 1, int(np.searchsorted(upto, (upto[begun - 1] if begun else 0) + PAIRS, "right")))
            n = (hi - lo)[begun:end]
            i = np.repeat(np.arange(begun, end), n)
            j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[begun:end], n)
            allowed = np.maximum(1, np.floor(np.minimum(lengths[i], sizes[j]) * FUZZY_SHARE).astype(int))
            told = np.abs(lengths[i] - sizes[j]) <= allowed
            i, j, allowed = i[told], j[told], allowed[told]
            if len(i):
                (u, i_at), (v, j_at) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
                own, other = _letters([left[k] for k in u.tolist()]), _letters([right[k] for k in v.tolist()])
                apart = np.concatenate([np.abs(own[i_at[s : s + PAIRS]] - other[j_at[s : s + PAIRS]]).sum(1) for s in range(0, len(i), PAIRS)])
                near = apart <= 2 * allowed
                for x, y, edits in zip(i[near].tolist(), j[near].tolist(), allowed[near].tolist(), strict=True):
                    k, other_key = left[x], right[y]
                    if k != other_key and counts_near(k, other_key, edits) and _edits_within(k, other_key, edits):
                        found[k].append(other_key)
            begun = end
    at = {k: sorted(j for other_key in alike for j in places[other_key]) if len(alike) > 1 else places[alike[0]] if alike else [] for k, alike in found.items()}
    return [at[k] for k in a]


def alike_places(a: list[str], b: list[str]) -> list[np.ndarray]:
    """``_alike`` as arrays; equal keys share one."""
    found = _alike(a, b)
    made = {id(p): np.array(p, np.int64) for p in found}
    return [made[id(p)] for p in found]


def _row_above(below: int, alike: int, whole: int) -> int:
    """The table's row of an item from the row of the next one (Hyyrö 2004): a bit is unset where a cell is one more than the cell right of it."""
    met = below & alike
    return (below + met | below - met) & whole


def _bits(places: Sequence[int], m: int) -> int:
    """The places as bits, the last place first."""
    if len(places) < 64:
        out = 0
        for j in places:
            out |= 1 << m - 1 - int(j)
        return out
    held = np.zeros(m, np.uint8)
    held[np.asarray(places)] = 1
    return int.from_bytes(np.packbits(held).tobytes(), "big") >> -m % 8


def walk(alike: Sequence[Sequence[int]], m: int) -> list[tuple[int, int]]:
    """Steps (i, j) of a longest common subsequence of items with these alike places among ``m`` others; -1 for the side that a step skips.

    Of equally long ones the walk prefers a match, then a step on the source side. A row of the table is a number of ``m`` bits. Only every
    k-th row is kept, k being the root of its height; the walk makes the rows between two of them again when it comes there, so memory
    grows with the root of the product of both lengths and a row, not with the product.
    """
    n = len(alike)
    height, whole = max(1, math.isqrt(n)), (1 << m) - 1
    known: dict[int, int] = {}

    def bits(i: int) -> int:
        """The alike places of an item; equal keys share theirs, so those of many places are known for a while."""
        if len(alike[i]) < 64:
            return _bits(alike[i], m)
        if len(known) > height:
            known.clear()
        if id(alike[i]) not in known:
            known[id(alike[i])] = _bits(alike[i], m)
        return known[id(alike[i])]

    kept, row = {n: whole}, whole
    for i in range(n - 1, -1, -1):
        row = _row_above(row, bits(i), whole)
        if i % height == 0:
            kept[i] = row
    steps, i, j, top, rows, own = [], 0, 0, -1, [], []
    while i < n and j < m:
        if i - i % height != top:
            top = i - i % height
            own = [bits(k) for k in range(top, min(n, top + height))]
            rows = [kept[min(n, top + height)]]
            for places in reversed(own):
                rows.append(_row_above(rows[-1], places, whole))
            rows.reverse()
        at, rest = m - 1 - j, (1 << m - j) - 1
        here, below = rows[i - top], rows[i + 1 - top]
        if own[i - top] >> at & 1:
            steps.append((i, j))
            i, j = i + 1, j + 1
        # the cell below is as large as the one to the right if that is one less than this one, or if both are as large as this one
        elif not here >> at & 1 or (below & rest).bit_count() == (here & rest).bit_count():
            steps.append((i, -1))
            i += 1
        else:
            steps.append((-1, j))
            j += 1
    return steps + [(k, -1) for k in range(i, n)] + [(-1, k) for k in range(j, m)]


def alignment(alike: np.ndarray) -> list[tuple[int, int]]:
    """``walk`` over a table of all pairs."""
    return walk([np.flatnonzero(row) for row in alike], alike.shape[1])


#: Pairs that a worker holds as Python objects.
PAGES = 64
ITEM = ("ord", "text", "x", "y", "w", "h", "key")
ALIGNED = (
    "pair_id string, op int, side string, ord int, text string, x int, y int, w int, h int, key string, status string, segment int, "
    "counterpart int, other_x int, other_y int, other_w int, other_h int, other_text string"
)


def aligned_pair(pair_id, source: list[dict], target: list[dict], only: tuple[str, str] | None = None) -> list[tuple]:
    """J9, A7, J10 for one pair: a row for each item, in the order of the walk, or for those of ``only`` one side and status.

    Status is matched, reflow, moved, missing (source) or extra (target). ``segment`` numbers the runs of
    unmatched steps of a pair, from 0, and is null for matches. ``counterpart`` is the other item's place.
    """
    sides = {"source": source, "target": target}
    keys = {k: [item["key"] for item in v] for k, v in sides.items()}
    alike = _alike(keys["source"], keys["target"])
    steps = walk(alike, len(target))
    status = {k: [""] * len(v) for k, v in sides.items()}
    other = {k: [-1] * len(v) for k, v in sides.items()}
    segment = {k: [None] * len(v) for k, v in sides.items()}
    runs: list[tuple[list[int], list[int]]] = []
    run: tuple[list[int], list[int]] | None = None
    for i, j in steps:
        if i >= 0 and j >= 0:
            status["source"][i] = status["target"][j] = "matched"
            other["source"][i], other["target"][j] = j, i
            run = None
            continue
        if run is None:
            run = ([], [])
            runs.append(run)
        run[0 if i >= 0 else 1].append(i if i >= 0 else j)
    for number, (s, t) in enumerate(runs):
        for side, at in (("source", s), ("target", t)):
            for k in at:
                segment[side][k] = number
        words = [w for i in s for w in keys["source"][i].split()]
        there = {w for j in t for w in keys["target"][j].split()}
        if words and there and sum(w in there for w in words) / len(words) >= REFLOW:
            for side, at, facing in (("source", s, t), ("target", t, s)):
                for k, item in enumerate(at):
                    status[side][item] = "reflow"
                    other[side][item] = facing[min(k, len(facing) - 1)]
        else:
            for i in s:
                status["source"][i] = "missing"
            for j in t:
                status["target"][j] = "extra"
    free = {j for j, st in enumerate(status["target"]) if st == "extra"}
    for i, st in enumerate(status["source"]):
        if st == "missing" and free and (j := next((j for j in alike[i] if j in free), None)) is not None:
            free.remove(j)
            status["source"][i] = status["target"][j] = "moved"
            other["source"][i], other["target"][j] = j, i
    out = []
    row = lambda item: tuple(item[c] for c in ITEM)
    for op, (i, j) in enumerate(steps):
        for side, facing, at in (("source", "target", i), ("target", "source", j)):
            if at < 0 or only and only != (side, status[side][at]):
                continue
            to = other[side][at]
            peer = row(sides[facing][to]) if to >= 0 else None
            there = (None,) * 6 if peer is None else (peer[0], *peer[2:6], peer[1])
            out.append((pair_id, op, side, *row(sides[side][at]), status[side][at], segment[side][at], *there))
    return out


def by_page(
    sides: Sequence[DataFrame], columns: Sequence[str], run: Callable[[object, list[dict], list[dict]], list[tuple]], schema: str, how: str = "full"
) -> DataFrame:
    """The rows that ``run`` makes of a pair's id and its items on either side, in order of ``ord``.

    The items of a side are gathered in the pair's row, so that batches hold many pairs and a pair costs no call of its own; both sides are
    dealt once by pair (nothing is shuffled where they are so already). A side without items is empty; ``how`` is inner to leave out its pair.
    A few pairs at a time become Python objects.
    """
    gathered = [
        spread(side.select("pair_id", *columns), "pair_id").groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        for side, name in zip(sides, ("source", "target"), strict=True)
    ]
    made = StructType.fromDDL(schema)
    held = to_arrow_schema(made)
    met = gathered[0].join(gathered[1], "pair_id", how).select(F.col("pair_id").cast(made["pair_id"].dataType).alias("pair_id"), "source", "target")

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in map(pa.RecordBatch.to_pydict, _parts(batches)):
            rows = [r for p in zip(part["pair_id"], part["source"], part["target"], strict=True) for r in run(p[0], p[1] or [], p[2] or [])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), held, strict=True)], schema=held)

    return met.mapInArrow(pages, schema)


def _texts(items: DataFrame, rules: list[dict] | None, *columns: str) -> DataFrame:
    """Items without page chrome, and with ``told``, which their key is made of, where that is not the text itself."""
    found = items.where(~text.is_chrome(F.col("text")))
    told = [text.with_rules(F.col("text"), rules).alias("told")] if rules else []
    # aliases keep the sides apart where both come from one table
    return found.select(*(F.col(c).alias(c) for c in ("pair_id", *columns)), *told)


def _keyed(items: list[dict]) -> list[dict]:
    """P8's second half: the items whose key is not empty, with it."""
    for item in items:
        item["key"] = text.key_of(item["told"] if "told" in item else item["text"])
    return [item for item in items if item["key"]]


def align(source: DataFrame, target: DataFrame, rules: list[dict] | None = None, only: tuple[str, str] | None = None) -> DataFrame:
    """J9, J10, A7 over the items of both sides, ordered by ``ord`` within a pair; of those the rows of ``only`` one side and status, if asked.

    Keys are made where the items are aligned.
    """
    columns = [c for c in ITEM if c != "key"]
    run = lambda pair_id, s, t: aligned_pair(pair_id, _keyed(s), _keyed(t), only)
    return by_page([_texts(side, rules, *columns) for side in (source, target)], [*columns, *(["told"] if rules else [])], run, ALIGNED)


def steps(source: DataFrame, target: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    """pair_id, op, source_ord, target_ord: the steps of the walk alone, for pairs whose sides both have items with a key."""

    def run(pair_id, s: list[dict], t: list[dict]) -> list[tuple]:
        s, t = _keyed(s), _keyed(t)
        if not s or not t:
            return []
        found = walk(_alike([i["key"] for i in s], [i["key"] for i in t]), len(t))
        return [(pair_id, op, s[i]["ord"] if i >= 0 else None, t[j]["ord"] if j >= 0 else None) for op, (i, j) in enumerate(found)]

    columns = ["ord", "text"]
    kept = [_texts(side, rules, *columns) for side in (source, target)]
    return by_page(kept, [*columns, *(["told"] if rules else [])], run, "pair_id string, op int, source_ord int, target_ord int", "inner")


def alike_items(source: DataFrame, target: DataFrame) -> DataFrame:
    """J11 within pairs: pair_id, source_ord and target_ord of prepared items with alike keys."""

    def run(pair_id, s: list[dict], t: list[dict]) -> list[tuple]:
        found = _alike([i["key"] for i in s], [i["key"] for i in t])
        return [(pair_id, item["ord"], t[j]["ord"]) for item, places in zip(s, found, strict=True) for j in places]

    kind = source.schema["pair_id"].dataType.simpleString()
    return by_page([source, target], ["ord", "key"], run, f"pair_id {kind}, source_ord long, target_ord long")


def segments(aligned: DataFrame) -> DataFrame:
    """The runs of unmatched items that are no reflow, counted before items moved were found."""
    src, tgt = F.col("side") == "source", F.col("side") == "target"
    sample = lambda c: F.slice(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("op", "text")))), lambda s: s["text"]), 1, 5)
    return (
        aligned.where("segment is not null and status <> 'reflow'")
        .groupBy("pair_id", "segment")
        .agg(
            F.count_if(src).alias("missing_count"),
            F.count_if(tgt).alias("extra_count"),
            *[f(F.when(c, e)).alias(n) for n, f, c, e in (
                ("source_top", F.min, src, F.col("y")), ("source_bottom", F.max, src, F.col("y") + F.col("h")),
                ("target_top", F.min, tgt, F.col("y")), ("target_bottom", F.max, tgt, F.col("y") + F.col("h")),
            )],
            sample(src).alias("missing_sample"),
            sample(tgt).alias("extra_sample"),
        )
    )


def _gaps(aligned: DataFrame) -> DataFrame:
    """The rows with ``is_match`` on source matches, and for these the gap to the match before on either side."""
    matched = (F.col("side") == "source") & (F.col("status") == "matched")
    before = Window.partitionBy("pair_id", "is_match").orderBy("op")
    gap = lambda c: F.when(F.col("is_match"), F.col(c) - F.lag(c).over(before))
    return aligned.withColumn("is_match", matched).withColumns({"source_gap": gap("y"), "target_gap": gap("other_y")})


def drift(aligned: DataFrame, tolerance: int = DRIFT) -> DataFrame:
    """Matches whose gap to the match before differs between the sides by more than the tolerance."""
    found = _gaps(aligned).where("is_match").select("pair_id", "op", "text", F.col("y").alias("source_y"), F.col("other_y").alias("target_y"), "source_gap", "target_gap")
    return found.withColumn("gap_delta", F.abs(F.col("source_gap") - F.col("target_gap"))).where(F.col("gap_delta") > tolerance)


def overlay_index(aligned: DataFrame) -> DataFrame:
    """Source items are numbered; target items carry the number before them and how many follow it so far."""
    walk = Window.partitionBy("pair_id").orderBy("op", "side").rowsBetween(Window.unboundedPreceding, 0)
    number = F.sum((F.col("side") == "source").cast("int")).over(walk)
    out = aligned.withColumn("n", number)
    since = F.sum(((F.col("side") == "target") & (F.col("status") != "matched")).cast("int"))
    k = since.over(Window.partitionBy("pair_id", "n").orderBy("op", "side").rowsBetween(Window.unboundedPreceding, 0))
    index = F.when(F.col("side") == "source", F.col("n").cast("string")).otherwise(F.concat_ws(":", F.col("n"), F.when(F.col("status") == "matched", 0).otherwise(k)))
    return out.withColumn("idx", index).drop("n").withColumns(
        {"matched": F.col("status").isin("matched", "reflow"), "moved": F.col("status") == "moved"}
    )


def summary(aligned: DataFrame) -> DataFrame:
    """A5; reflow and moved items are not part of the coverage. The alignment is read once."""
    src = F.col("side") == "source"
    aligned = _gaps(aligned)
    count = lambda c, name: F.count_if(c).alias(name)
    base = aligned.groupBy("pair_id").agg(
        count(src, "source_count"),
        count(~src, "target_count"),
        count(src & (F.col("status") == "matched"), "matched_count"),
        count(F.col("status") == "missing", "missing_count"),
        count(F.col("status") == "extra", "extra_count"),
        count(src & (F.col("status") == "moved"), "moved_count"),
        F.size(F.collect_set(F.when(F.col("status") == "reflow", F.col("segment")))).cast("long").alias("reflow_segments"),
        F.size(F.collect_set(F.when(F.col("status") != "reflow", F.col("segment")))).cast("long").alias("divergence_segments"),
        count(F.abs(F.col("source_gap") - F.col("target_gap")) > DRIFT, "drift_count"),
    )
    return base.withColumns(
        {
            "coverage": F.when(F.col("source_count") > 0, F.col("matched_count") / F.col("source_count")).otherwise(1.0),
            "status": F.when(F.col("missing_count") > 0, "discrepancies").otherwise("ok"),
        }
    )


def _median(values: Column) -> Column:
    """The median of an array's numbers, of two the mean; null if there are none."""
    sorted_ = F.array_sort(F.array_compact(values))
    at = lambda k: F.get(sorted_, F.floor(k).cast("int")).cast("double")
    n = F.size(sorted_)
    return (at((n - 1) / 2) + at(n / 2)) / 2


def local_drift(matches: DataFrame, neighbours: int = LOCAL_NEIGHBOURS) -> DataFrame:
    """How far a match (pair_id, ord, x, y, other_x, other_y) departs from the median shift of its nearest ones.

    Nearest is by source y, then by place. Of the items at one y only the first ``neighbours`` + 1 can be
    among the nearest, and they come from as many values of y on either side at most. So the items at a y are one
    row, which sees the rows around it; matches are neither joined nor multiplied before they are sorted.
    """
    other = ("ord", "x", "y", "other_x", "other_y")
    items = F.array_sort(F.collect_list(F.struct("ord", *[c for c in matches.columns if c not in ("ord", "pair_id")])))
    by_y = spread(matches, "pair_id").groupBy("pair_id", F.col("y").alias("at_y")).agg(items.alias("items"))
    few = F.transform(F.slice("items", 1, neighbours + 1), lambda o: F.struct(*[o[c].alias(c) for c in other]))
    around = Window.partitionBy("pair_id").orderBy("at_y").rowsBetween(-neighbours, neighbours)
    seen = by_y.withColumn("few", few).withColumn("near", F.flatten(F.collect_list("few").over(around))).drop("few", "at_y")
    each = seen.select("pair_id", "near", F.explode("items").alias("m")).select("pair_id", "near", "m.*")
    own = lambda o: (o["ord"] != F.col("ord")) & F.col("pair_id").isNotNull()
    told = lambda o: F.struct(F.abs(o["y"] - F.col("y")).alias("d"), o["ord"].alias("ord"), (o["other_x"] - o["x"]).alias("dx"), (o["other_y"] - o["y"]).alias("dy"))
    found = each.withColumn("near", F.slice(F.array_sort(F.transform(F.filter("near", own), told)), 1, neighbours))
    found = found.withColumns({m: _median(F.col(f"near.{d}")) for m, d in (("mdx", "dx"), ("mdy", "dy"))})
    shift = F.greatest(F.abs(F.col("other_x") - F.col("x") - F.col("mdx")), F.abs(F.col("other_y") - F.col("y") - F.col("mdy")))
    found = found.withColumn("drift", F.coalesce(shift, F.lit(0.0)))
    colour = F.when(F.col("drift") <= 20, "good").when(F.col("drift") <= 40, "fair").otherwise("poor")
    return found.select("pair_id", "ord", "drift", colour.alias("grade"))
