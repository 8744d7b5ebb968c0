"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits that differ in at most 3 bits differ in at most one bit in one of their two
halves. For a half of 32 bits the anchors are the words whose first 31 bits are a code word of the
perfect Hamming code (covering radius 1) and whose last bit is free: 2**27 of them. A fingerprint lives
at the anchor nearest to it and visits every anchor that can be the nearest one of a half that differs
in one bit: the anchors within radius 1 + 1 with the same free bit, and the nearest one with the free bit
changed. Linked fingerprints therefore meet at an anchor, at which residents are compared with visitors.

Equal fingerprints are one before they are compared. A fingerprint makes two residents and about 33
visitors however many documents carry it. Each meets the residents of its anchors, one for every 2**27
distinct fingerprints if they are spread evenly: up to a billion or so the work is in proportion to
them, beyond that the comparisons, of two words each, grow with their square. An anchor with many rows is
dealt over a grid of cells, and anchors give spanning forests of their links and not all of them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.common import by_key, id_and_text, map_rows, scratch, squeezed, trimmed, written
from pagelattice.llm.components import connected, merged

WORDS, SEED, BITS = 3, 42, 3
#: Fingerprints of a document where groups may be linked by any of several.
LANES = 12
#: Near-duplicates: the Jaccard index, as a fraction, of the sets of shingles of so many words.
ALIKE, ALIKE_WORDS = (4, 5), 5
#: Hashes that more texts have come last where first hashes are chosen, and how many of them; only speed depends on both.
OFTEN, MOST_OFTEN = 16, 200_000
#: Nodes of a hash beyond which they are compared with some of them again before all of its pairs are, with how many, and the orders in which
#: these are chosen; only speed depends on them.
CROWDED, HUBS, ORDERS = 32, 16, 3
#: Bits of a code word, of them check bits, covering radius, and free bits behind the code word.
CODE, CHECK, RADIUS, FREE = 31, 5, 1, 1
#: x^5 + x^2 + 1, a generator of the Hamming code.
GENERATOR = 0b100101

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def shingle_hashes(text: str, words: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; none for a text without words."""
    found = text.encode().translate(_LOWER).split()  # splits at \x20 and \x09-\x0D
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([digest(joined, seed)] if found else [], "<u8")
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    spans = zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], seed) for a, b in spans], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; 0 for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """A bit is set if over half of the shingles' hashes have it; 0 for a text without words."""
    return majority(shingle_hashes(text, words, seed))


def fingerprints_of(text: str, lanes: int, words: int = WORDS, seed: int = SEED) -> list[int]:
    """``lanes`` independent fingerprints; the first is ``fingerprint``, the others mix the same hashes anew."""
    hashes = shingle_hashes(text, words, seed)
    out = [majority(hashes)]
    for k in range(1, lanes):
        mixed = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        mixed = (mixed ^ mixed >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ mixed >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        out.append(majority(mixed ^ mixed >> np.uint64(31)))
    return out


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


class Anchors:
    """Nearest and reachable anchors of 32-bit halves."""

    def __init__(self):
        of_bit = [self._syndrome(1 << i) for i in range(CODE)]
        near: list[list[int]] = [[] for _ in range(1 << CHECK)]
        for weight in range(RADIUS + 2):
            for bits in itertools.combinations(range(CODE), weight):
                syndrome = 0
                for b in bits:
                    syndrome ^= of_bit[b]
                near[syndrome].append(sum(1 << b for b in bits))
        self.of_bit = np.array(of_bit, np.uint32)
        self.leader = np.array([n[0] for n in near], np.uint32)  # the lightest pattern, of weight RADIUS at most
        self.most = max(map(len, near))
        self.patterns = np.zeros((len(near), self.most), np.uint32)
        self.many = np.array([len(n) for n in near])
        for s, n in enumerate(near):
            self.patterns[s, : len(n)] = n

    @staticmethod
    def _syndrome(word: int) -> int:
        for i in range(CODE - 1, CHECK - 1, -1):
            if word >> i & 1:
                word ^= GENERATOR << (i - CHECK)
        return word

    def syndromes(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), np.uint32)
        for i in range(CODE):
            out ^= np.where(words >> np.uint32(i) & np.uint32(1), self.of_bit[i], np.uint32(0))
        return out

    def of(self, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest anchors; row numbers and anchors of all visits."""
        code = halves & np.uint32((1 << CODE) - 1)
        syndrome = self.syndromes(code)
        nearest = halves ^ self.leader[syndrome]
        within = np.arange(self.most) < self.many[syndrome][:, None]
        rows = [np.nonzero(within)[0]]
        visits = [(halves[:, None] ^ self.patterns[syndrome])[within]]
        for i in range(FREE):
            rows.append(np.arange(len(halves)))
            visits.append(nearest ^ np.uint32(1 << (CODE + i)))
        return nearest, np.concatenate(rows), np.concatenate(visits)


def _places(resident: bool):
    """(anchor, fingerprint) of residents or of visitors (print, lane); the anchor's higher bits tell half and lane."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors()
        for batch in batches:
            prints = np.array(batch.column(0).to_pylist(), np.int64)
            lanes = np.array(batch.column(1).to_pylist(), np.int64)
            for half in (0, 1):
                part = (prints.view(np.uint64) >> np.uint64(32 * half)).astype(np.uint32)
                nearest, rows, visits = anchors.of(part)
                at, row = (nearest, np.arange(len(prints))) if resident else (visits, rows)
                place = at.astype(np.int64) | np.int64(half << 32) | lanes[row] << 33
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(prints[row])], names=["anchor", "resident" if resident else "visitor"])

    return run


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fingerprint (signed) of each row; a null text counts as empty."""

    def make():
        return lambda rows: {"doc_id": rows["doc_id"], "print": [signed(fingerprint(t, words)) for t in rows["text"]]}

    return map_rows(id_and_text(docs), "doc_id long, print long", make)


#: Marks a resident among the rows of an anchor, and rows of a unit and pairs of a step that are held at a time.
_RESIDENT = 1 << 50
_UNIT_ROWS, _STEP_PAIRS = 1 << 18, 1 << 19
#: Rows of an anchor beyond which it is dealt over cells of about so many.
_ANCHOR_ROWS = 1 << 16


def _spanned(lane: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A spanning forest of the links (a, b) of each lane: every node but the smallest with the smallest of its tree."""
    keys, at = np.unique(np.concatenate([np.stack([lane, a], 1), np.stack([lane, b], 1)]), axis=0, return_inverse=True)
    at = at.reshape(-1)
    label = merged(np.arange(len(keys)), at[: len(a)], at[len(a) :])
    child = np.flatnonzero(label != np.arange(len(keys)))
    return keys[child, 0], keys[label[child], 1], keys[child, 1]


def _meet(bits: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        anchor, cell = rows.column("anchor").to_numpy(), rows.column("cell").to_numpy()
        place = anchor & (_RESIDENT - 1)
        order = np.lexsort((cell, place))
        place, cell, prints, resident = place[order], cell[order], rows.column("print").to_numpy()[order], (anchor & _RESIDENT)[order] > 0
        starts = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (cell[1:] != cell[:-1])]))
        sizes = np.diff(np.append(starts, len(place)))
        group = np.repeat(np.arange(len(starts)), sizes)
        hosts = np.flatnonzero(resident & (sizes[group] > 1))
        many = sizes[group[hosts]]
        ends = np.cumsum(many)
        found = [np.zeros(0, np.int64)] * 3
        begin = 0
        while begin < len(hosts):
            done = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, done + _STEP_PAIRS, side="right")))
            n = many[begin:stop]
            host = np.repeat(hosts[begin:stop], n)
            guest = np.arange(len(host)) - np.repeat(np.cumsum(n) - n, n) + starts[group[host]]
            apart = np.bitwise_count((prints[host] ^ prints[guest]).view(np.uint64))
            near = (apart > 0) & (apart <= bits)
            if near.any():
                new = place[host[near]] >> 33, prints[host[near]], prints[guest[near]]
                found = _spanned(*[np.concatenate(x) for x in zip(found, new, strict=True)])
            begin = stop
        return pa.table(dict(zip(("lane", "a", "b"), map(pa.array, found), strict=True)))

    return run


def spanning_links(prints: DataFrame, bits: int = BITS, anchor_rows: int = _ANCHOR_ROWS) -> DataFrame:
    """(lane, a, b) that join all fingerprints (print, lane), distinct, of one lane that differ in at most ``bits`` (up to 3) bits.

    Residents and visitors of an anchor meet in one place; a unit of anchors gives a spanning forest of the
    links it sees, so what it gives is bounded by its fingerprints, however close they lie together. An
    anchor with more than ``anchor_rows`` is a square of cells, each of which has a part of its residents
    and a part of its visitors.
    """
    if bits > BITS:
        raise ValueError("the anchors cover differences of up to 3 bits")
    prints = prints.select("print", F.col("lane").cast("long").alias("lane"))
    hosts = prints.mapInArrow(trimmed(_places(True)), "anchor long, resident long").select("anchor", F.col("resident").alias("print"), F.lit(True).alias("host"))
    guests = prints.mapInArrow(trimmed(_places(False)), "anchor long, visitor long").select("anchor", F.col("visitor").alias("print"), F.lit(False).alias("host"))
    rows = hosts.unionByName(guests)
    hot = rows.groupBy("anchor").count().where(F.col("count") > anchor_rows)
    hot = written(hot.select("anchor", F.expr(f"(count + {anchor_rows - 1}) div {anchor_rows}").alias("side")), "hot-anchors")
    if hot.isEmpty():
        rows = rows.withColumn("cell", F.lit(0).cast("long"))
    else:
        rows = rows.join(hot, "anchor", "left").withColumn("side", F.coalesce("side", F.lit(1)).cast("long"))
        part, along = F.pmod(F.xxhash64("print"), F.col("side")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("side") - 1))
        rows = rows.withColumn("part", part).withColumn("along", along)
        rows = rows.withColumn("cell", F.when(F.col("host"), F.col("part") * F.col("side") + F.col("along")).otherwise(F.col("along") * F.col("side") + F.col("part")))
    units = max(1, -(-prints.count() * 32 // _UNIT_ROWS))
    unit = F.pmod(F.xxhash64("anchor", "cell"), F.lit(units)).alias("unit")
    marked = F.when(F.col("host"), F.col("anchor").bitwiseOR(F.lit(_RESIDENT))).otherwise(F.col("anchor")).alias("anchor")
    return rows.select(unit, marked, "cell", "print").groupBy("unit").applyInArrow(_meet(bits), "lane long, a long, b long").distinct()


def grouped(table: DataFrame, id_column: str, bits: int = BITS) -> DataFrame:
    """(print, component_id): the smallest id among all that carry a fingerprint linked to ``print``."""
    with scratch(table.sparkSession):
        first = written(table.groupBy("print").agg(F.min(id_column).alias("first")), "prints")
        component = connected(spanning_links(first.select("print", F.lit(0).alias("lane")), bits).select("a", "b")).withColumnRenamed("node", "print")
        linked = first.join(component, "print")
        least = linked.groupBy("component").agg(F.min("first").alias("least"))
        told = linked.join(least, "component").select("print", "least")
        told = first.join(told, "print", "left").select("print", F.coalesce("least", "first").alias("component_id"))
        # written, so that a join with it exchanges both sides and a frequent fingerprint's rows can be split
        return written(told, "groups", result=True)


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint, component_id of each row of ``docs`` (doc_id, text).

    A null or empty text, or one without words, has fingerprint zero and is linked like any other.
    Repeated rows are given each. A null id stays null and is never a component's id; a component
    without any id has a null one. An empty table gives no rows; other columns are ignored. Texts of any
    length are read whole.
    """
    table = written(fingerprints(docs, words), "fingerprints")
    told = grouped(table, "doc_id", bits)
    return table.join(told, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def alike_needed(n: int) -> int:
    """The fewest common shingles with which a set of ``n`` can have the Jaccard index ``ALIKE``, whatever the other's size."""
    return -(-n * ALIKE[0] // ALIKE[1])


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard index of ``ALIKE`` or more; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * ALIKE[1] >= ALIKE[0] * (len(a) + len(b) - both)


def shingle_set(text: str) -> np.ndarray:
    """The distinct hashes of the text's shingles of ``ALIKE_WORDS`` words, sorted."""
    return np.unique(shingle_hashes(text, ALIKE_WORDS, SEED))


def _described(lanes: int, words: int):
    def make():
        def step(rows: dict) -> dict:
            prints = [[signed(p) for p in fingerprints_of(t, lanes, words)] for t in rows["text"]]
            content = [xxhash.xxh3_128_digest(shingle_set(t).tobytes()) for t in rows["text"]]
            return {"place": rows["place"], "doc_id": rows["doc_id"], "prints": prints, "content": content}

        return step

    return make


def _low_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lower hashes of each text: those that ``first_hashes`` are mostly taken from."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            found = [shingle_set(t) for t in batch.column("text").slice(at, 500).to_pylist()]
            low = np.concatenate([f[: np.searchsorted(f, _LOW)] for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(low.view("<i8"))], names=["hash"])


def keys_in_order(found: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The keys of a set of hashes, sorted: by value, but those of ``often`` (sorted) last. The order is one for all sets."""
    keys = found >> np.uint64(1)
    if len(often) and len(found):
        at = np.minimum(np.searchsorted(often, found), len(often) - 1)
        keys |= (often[at] == found).astype(np.uint64) << np.uint64(63)
    keys.sort()
    return keys


def first_hashes(found: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first keys of a set: of two alike sets the first common key is one of the first of both.

    If it came later in one of them, too few hashes would be left for the Jaccard index.
    """
    return (keys_in_order(found, often)[: len(found) - alike_needed(len(found)) + 1] ^ np.uint64(1 << 63)).view("<i8")


def parities(found: np.ndarray) -> np.ndarray:
    """256 bits, in four words: the parity of the set's hashes of each remainder. Two sets differ in as many hashes as bits, or more."""
    odd = np.bincount((found & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


#: Below it are the hashes that are counted in all texts.
_LOW = np.uint64(1 << 62)


def _firsts(often: np.ndarray):
    def make():
        def step(rows: dict) -> dict:
            out: dict[str, list] = {"node": rows["node"], "size": [], "bits": [], "firsts": [], "whole": []}
            for t in rows["text"]:
                found = shingle_set(t)
                firsts = first_hashes(found, often) if len(found) else found.view("<i8")
                # one of the first hashes is not among those that were counted in all texts, nor one that many have
                beyond = len(firsts) > 0 and int(firsts[-1]) + (1 << 63) >= int(_LOW) >> 1
                out["size"].append(len(found))
                out["bits"].append(parities(found).tolist())
                out["firsts"].append([] if beyond else firsts.tolist())
                out["whole"].append(found.view("<i8").tolist() if beyond else [])
            return out

        return step

    return make


def _second(often: np.ndarray):
    def make():
        def step(rows: dict) -> dict:
            firsts = [first_hashes(np.array(w, "<i8").view("<u8"), often).tolist() if w else f for w, f in zip(rows["whole"], rows["firsts"], strict=True)]
            return {"node": rows["node"], "firsts": firsts}

        return step

    return make


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the rows (a, b, a_data, b_data) whose texts are alike."""
    expand = zstandard.ZstdDecompressor().decompress
    last, held = None, None
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            a, b, one, other = (batch.column(c).slice(at, 200).to_pylist() for c in ("a", "b", "a_data", "b_data"))
            keep = []
            for k in range(len(a)):
                if a[k] != last:
                    last, held = a[k], shingle_set(expand(one[k]).decode())
                keep.append(alike(held, shingle_set(expand(other[k]).decode())))
            kept = [[x for x, good in zip(side, keep, strict=True) if good] for side in (a, b)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in kept], names=["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose texts in ``texts`` (node, data) have a Jaccard index of ``ALIKE`` or more."""
    with scratch(pairs.sparkSession):
        pairs = written(pairs, "candidates")
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        needed = written(texts.join(nodes, "node", "left_semi"), "candidate-texts")
        for side in ("b", "a"):
            pairs = pairs.join(needed.select(F.col("node").alias(side), F.col("data").alias(f"{side}_data")), side)
        return written(pairs.select("a", "b", "a_data", "b_data").mapInArrow(trimmed(_verified), "a long, b long"), "alike", result=True)


def _possible(a: dict, b: dict):
    """Whether two sets can be alike, from their sizes, from the places of a first common hash, and from their parities.

    With n hashes in both together they need 4 n / 9 in common, which cannot be more than there are from that
    place on, and may have n / 9 that only one has.
    """
    both = a["size"] + b["size"]
    few, many = F.least(a["size"], b["size"]), F.greatest(a["size"], b["size"])
    total, part = ALIKE[0] + ALIKE[1], ALIKE[0]
    out = (few * ALIKE[1] >= many * ALIKE[0]) & (F.least(a["size"] - a["at"], b["size"] - b["at"]) * total >= both * part)
    apart = sum((F.bit_count(a["bits"][k].bitwiseXOR(b["bits"][k])) for k in range(4)), F.lit(0))
    return out & (apart * total <= both * (total - 2 * part))


def met_by_prints(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, prints) that join all whose fingerprints at one place differ in at most ``bits`` bits."""
    with scratch(nodes.sparkSession):
        flat = nodes.select("node", F.posexplode("prints").alias("lane", "print"))
        first = written(flat.groupBy("lane", "print").agg(F.min("node").alias("rep")), "prints")
        same = flat.join(first, ["lane", "print"]).where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
        met = spanning_links(first, bits)
        for side in ("a", "b"):
            met = met.join(first.select("lane", F.col("print").alias(side), F.col("rep").alias(f"{side}_rep")), ["lane", side])
        pairs = met.select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")).unionByName(same)
        return written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "print-pairs", result=True)


def _often(hashes: DataFrame) -> np.ndarray:
    """Those of ``hashes`` (hash) that many texts have, at most ``MOST_OFTEN``, sorted."""
    count = hashes.groupBy("hash").count().where(F.col("count") > OFTEN)
    found = count.orderBy(F.desc("count"), "hash").limit(MOST_OFTEN).select("hash").collect()
    return np.sort(np.array([r.hash for r in found], "<i8").view("<u8"))


def met_by_hashes(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(hash, node, size, at, bits): the first hashes that several of ``nodes`` have in ``texts`` (node, text), and their places.

    Hashes that many texts have come last. They are found among the lower quarter of all hashes, from which most
    texts have their first ones, and then among all hashes of the texts for which that quarter does not suffice.
    """
    with scratch(texts.sparkSession):
        often = _often(texts.mapInArrow(trimmed(_low_hashes), "hash long"))
        # texts are not shuffled, only what is made of them
        firsts = map_rows(texts, "node long, size long, bits array<bigint>, firsts array<bigint>, whole array<bigint>", _firsts(often))
        firsts = written(firsts.join(nodes.select("node"), "node", "left_semi"), "firsts")
        high = firsts.select(F.explode("whole").alias("hash")).where(F.col("hash").between(0, int(_LOW) - 1) == F.lit(False))
        both = np.union1d(often, _often(high))
        flat = map_rows(firsts.select("node", "firsts", "whole"), "node long, firsts array<bigint>", _second(both))
        flat = flat.select("node", F.posexplode("firsts").alias("at", "hash"))
        several = flat.groupBy("hash").count().where("count > 1").select("hash")
        shared = written(flat.join(written(several, "shared-hashes"), "hash", "left_semi"), "shared")
        return written(shared.join(firsts.select("node", "size", "bits"), "node"), "met", result=True)


def _stars(met: DataFrame, order: int, hubs: int = 1) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of each node of a hash in ``met`` with ``hubs`` of its nodes, and (hash, least, n) of these; n is how many each stands for.

    They are the first in an order of their own for each hash and each ``order``, so that a group of alike nodes mostly meets some of its own.
    """
    columns = [c for c in met.columns if c != "hash"]
    rank = F.xxhash64("hash", "node", F.lit(order))
    keys = ["hash", *[F.pmod(F.xxhash64("node", F.lit(order)), F.lit(hubs)).alias("hub")] * (hubs > 1)]
    least = written(met.groupBy(*keys).agg(F.min(F.struct(rank.alias("rank"), *columns)).alias("least"), F.count("*").alias("n")), "least")
    own, other = {c: F.col(c) for c in columns}, {c: F.col("least")[c] for c in columns}
    apart = own["component"] != other["component"] if "component" in columns else own["node"] != other["node"]
    stars = met.join(least, "hash").where(apart & _possible(own, other))
    return stars.select(F.least("least.node", "node").alias("a"), F.greatest("least.node", "node").alias("b")), least


def _apart(met: DataFrame, component: DataFrame) -> DataFrame:
    """The rows of ``met`` whose hash several components have, with their component and the number ``n`` of rows of the hash."""
    told = met.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    told = written(told.select(*met.columns, "component"), "unjoined")
    apart = told.groupBy("hash").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low < high")
    return written(told.join(written(apart.select("hash", "n"), "apart"), "hash"), "left")


def groups_of(prints: DataFrame, texts: DataFrame, bits: int = BITS, complete: bool = True) -> DataFrame:
    """(node, component) of the nodes that have a link; links have a Jaccard index of ``ALIKE`` or more.

    ``prints`` is (node, prints), ``texts`` (node, text), which may have more rows. Candidates are pairs that meet by a fingerprint.
    With ``complete``, also all others that can be alike: such pairs share one of their first hashes. Every
    node with a hash is first compared with one that has it, the first in a random order; where a hash then has more than ``CROWDED``
    nodes and several components, again with ``HUBS`` others; then the pairs of a hash that are not
    in one component by then. Pairs that sizes, places and parities keep below ``ALIKE`` never leave the join.
    """
    pairs = met_by_prints(prints, bits)
    data = texts.withColumnRenamed("node", "place").mapInArrow(trimmed(squeezed), "place long, data binary").withColumnRenamed("place", "node")
    if not complete:
        return connected(verified(pairs, data))
    met = met_by_hashes(prints, texts)
    columns = ("node", "size", "at", "bits")
    stars, least = _stars(met, 0)
    # texts are shuffled once; what is looked up in them later comes to where they lie
    with by_key(data, "node", "all-texts") as data:
        linked = verified(stars.unionByName(pairs).distinct(), data)
        # with two nodes the pair has been compared
        left = _apart(met.join(least.where("n > 2").select("hash"), "hash"), connected(linked))
        for order in range(1, ORDERS):
            crowded = left.where(F.col("n") > CROWDED).select("hash", *columns, "component")
            if crowded.isEmpty():
                break
            linked = linked.unionByName(verified(_stars(crowded, order, HUBS)[0].distinct(), data))
            left = _apart(left.select("hash", *columns), connected(linked))
        sides = [left.select("hash", *[F.col(c).alias(f"{s}_{c}") for c in (*columns, "component")]) for s in "ab"]
        a, b = ({c: F.col(f"{s}_{c}") for c in (*columns, "component")} for s in "ab")
        rest = sides[0].join(sides[1], "hash").where((a["node"] < b["node"]) & (a["component"] != b["component"]) & _possible(a, b))
        rest = rest.select(a["node"].alias("a"), b["node"].alias("b")).distinct()
        return connected(linked.unionByName(verified(rest, data)))


def one_of_each_group(docs: DataFrame, lanes: int = LANES, words: int = WORDS, bits: int = BITS, complete: bool = False) -> DataFrame:
    """The rows of ``docs`` less near-duplicates: of each group the row with the smallest id stays.

    Two texts are linked if their sets of five-word shingles have a Jaccard index of 0.8 or more, which is
    computed for every link, and if one of ``lanes`` independent fingerprints brings them together, the first
    of which is that of ``near_duplicates``. With ``complete`` all texts of that similarity are linked, whatever
    their fingerprints; without it, more lanes find more of them. Rows are written with their place, which
    decides between equal ids; null ids come last. Texts without words are one group. An empty table
    gives no rows; all columns are kept.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("place"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    rows = written(rows, "placed")
    with scratch(docs.sparkSession):
        table = rows.select("place", F.col("row.doc_id").cast("long").alias("doc_id"), F.coalesce("row.text", F.lit("")).alias("text"))
        schema = "place long, doc_id long, prints array<bigint>, content binary"
        table = written(map_rows(table, schema, _described(lanes, words)), "fingerprints")
        order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "place", "prints")
        first = table.groupBy("content").agg(F.min(order).alias("first"))
        nodes = written(first.select("first.none", "first.id", F.col("first.place").alias("node"), "first.prints"), "nodes")
        texts = rows.select(F.col("place").alias("node"), F.coalesce("row.text", F.lit("")).alias("text"))
        component = groups_of(nodes.select("node", "prints"), texts, bits, complete)
        told = nodes.join(component, "node", "left")
        stays = told.groupBy(F.coalesce("component", "node").alias("component")).agg(F.min(F.struct("none", "id", F.col("node").alias("place"))).alias("first"))
        stays = written(stays.select(F.col("first.place").alias("place")), "stays", result=True)
    return rows.join(stays, "place", "left_semi").select(*[F.col("row")[c].alias(c) for c in docs.columns])
