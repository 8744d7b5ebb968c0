"""Removal of repeated strings with a run-length index.

Every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere in the corpus is marked.

1. Anchors bring equal strings together. The anchor of a window of LENGTH bytes is its leftmost substring
   of ``GRAM`` bytes with the smallest hash, so equal windows have equal anchors, and neighbouring windows
   mostly share one. The windows of one anchor form a block of text. Blocks whose anchor occurs once hold
   nothing that repeats.
2. Equal blocks become one with a count. The distinct blocks are dealt by anchor into units of bounded
   size. An anchor with more than ``HOT_BYTES`` of distinct blocks is not collected: what its windows share
   is widened, on the side on which a window has more room, by half of the room that is left, which cuts
   its blocks into smaller ones with anchors of their own, and so on; at the latest when the anchor
   is the whole window its blocks are one.
3. Each unit gets a run-length index (``RunIndex``): the Burrows-Wheeler transform of its windows as runs,
   and the text positions sampled at both ends of each run. Nothing else of the order is kept.
4. Matching statistics stream through the text from sample to sample. The window at the head of a run is
   compared with the one at the tail of the run before, its neighbour in the order; inside a run the
   neighbour and the match move on with the text, the match one byte shorter a step.
5. Marks go back to all places of a block and are united for each document.

Nothing but sizes reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.common import scratch, squeezed, trimmed, written

LENGTH, GRAM = 200, 64
#: Distinct block bytes of a unit, and from how many bytes on an anchor is widened.
UNIT_BYTES, HOT_BYTES = 1 << 20, 4 << 20
#: Bytes of whole anchors that are sorted at a time.
SORTED_BYTES = 1 << 18
#: Bytes that are hashed at a time.
_CHUNK_BITS = 18
_CHUNK = 1 << _CHUNK_BITS

_BYTE = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) | 1 for b in range(256)], np.uint64)
_STEP = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit polynomial hash of each substring of ``gram`` bytes (a power of two), by doubling."""
    h, n, factor = _BYTE[data], 1, _STEP
    while n < gram:
        h = h[:-n] * np.uint64(factor) + h[n:]
        n, factor = 2 * n, factor * factor & _MASK
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values)
    blocks = np.concatenate([values, np.full(-n % width, _MASK, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def blocks_of(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, text number - first, anchor hash, start, size) of blocks, a chunk of texts at a time.

    A text longer than a chunk is taken in chunks that share all but one byte of a window.
    """
    pieces: list[tuple[int, int, bytes]] = []
    held = 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), _CHUNK - length + 1):
            piece = text[at : at + _CHUNK]
            if len(piece) < length:
                continue
            if held + len(piece) > _CHUNK:
                yield _chunk_blocks(pieces, length, gram)
                pieces, held = [], 0
            pieces.append((i, at, piece))
            held += len(piece)
    if pieces:
        yield _chunk_blocks(pieces, length, gram)


def _chunk_blocks(pieces, length, gram):
    data = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
    hashes = gram_hashes(data, gram)
    low = np.uint64(_CHUNK - 1)
    least = sliding_minimum(hashes & ~low | np.arange(len(hashes), dtype=np.uint64), length - gram + 1)
    place = (least & low).astype(np.int64)  # of the anchor, for each window
    ends = np.cumsum([len(p) for _, _, p in pieces])
    starts = np.arange(len(place))
    owner = np.searchsorted(ends, starts, side="right")
    inside = starts + length <= ends[owner]
    starts, place, owner = starts[inside], place[inside], owner[inside]
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])]))
    last = np.concatenate([first[1:] - 1, [len(starts) - 1]])
    owner = owner[first]
    number = np.array([i for i, _, _ in pieces])[owner]
    begin = starts[first] - (ends - np.array([len(p) for _, _, p in pieces]))[owner] + np.array([at for _, at, _ in pieces])[owner]
    return number, hashes[place[first]].view(np.int64), begin, starts[last] - starts[first] + length


#: Ends a block; no byte of UTF-8.
_END = b"\xff"


class RunIndex:
    """The run-length Burrows-Wheeler transform of the windows of blocks, sampled at the ends of its runs.

    Windows are numbered through all blocks. They are ordered by the text from them to the end of their
    block and an end mark, then by number, as suffixes with a mark of its own behind each block are. The
    transform's letter of a window is the byte before it; the first windows of blocks have none and are runs
    of their own. Kept are the runs (letter, length) and the windows at their heads and tails.
    """

    def __init__(self, blocks: list[bytes], length: int = LENGTH):
        self.length = length
        sizes = np.array([len(b) for b in blocks])
        widest = int(sizes.max(initial=length))
        self.many = sizes - length + 1
        self.first = np.cumsum(self.many) - self.many
        text = np.frombuffer(b"".join(b + _END * widest for b in blocks), np.uint8)
        begin = np.cumsum(sizes + widest) - sizes - widest
        at = np.repeat(begin - self.first, self.many) + np.arange(self.many.sum())
        views = np.lib.stride_tricks.sliding_window_view(text, widest)
        order = np.argsort(views[at].view(f"S{widest}").reshape(-1), kind="stable")
        letter = text[at - 1].astype(np.int16)
        letter[self.first] = -1
        letter = letter[order]
        turn = np.flatnonzero((letter[1:] != letter[:-1]) | (letter[1:] < 0)) + 1
        heads = np.concatenate([[0], turn])
        self.letters, self.lengths = letter[heads], np.diff(np.append(heads, len(order)))
        self.heads, self.tails = order[heads], order[np.append(turn, len(order)) - 1]
        # the match of each head with the tail before it, as far as both blocks reach
        room = np.repeat(sizes, self.many) - (np.arange(len(at)) - np.repeat(self.first, self.many))
        self.matches = np.zeros(len(heads), np.int64)
        for k in range(1, len(heads), 4096):
            a, b = self.heads[k : k + 4096], self.tails[k - 1 : k - 1 + len(self.heads[k : k + 4096])]
            same = views[at[a]] == views[at[b]]
            match = np.where(same.all(1), widest, same.argmin(1))
            self.matches[k : k + 4096] = np.minimum(match, np.minimum(room[a], room[b]))

    @property
    def runs(self) -> int:
        return len(self.heads)

    def statistics(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, neighbour, match) of each head of a run, by window: what holds until the next one, the match shrinking."""
        by_place = np.argsort(self.heads)
        before = np.concatenate([[0], self.tails[:-1]])
        return self.heads[by_place], before[by_place], self.matches[by_place]

    def repeated(self) -> np.ndarray:
        """For each window whether another one equals it.

        A window that equals another either equals the one before it in the order, or is the one before it
        for the next; a window inside a run has the neighbour that the run's head carries on to it, as far
        as matches of LENGTH go.
        """
        n = int(self.many.sum())
        head, neighbour, match = self.statistics()
        steps = np.minimum(np.append(head[1:], n) - head, match - self.length + 1)
        found = steps > 0
        change = np.zeros(n + 1, np.int64)
        for start in (head[found], neighbour[found]):
            np.add.at(change, start, 1)
            np.add.at(change, start + steps[found], -1)
        return np.cumsum(change[:-1]) > 0


def spans_of(flags: np.ndarray, length: int = LENGTH) -> list[int]:
    """Start and end of each maximal run of covered bytes, given windows that repeat, as one flat list."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > length)
    starts = at[np.concatenate([[0], cut + 1])]
    ends = at[np.concatenate([cut, [len(at) - 1]])] + length
    return np.stack([starts, ends], 1).reshape(-1).tolist()


def united(spans: np.ndarray) -> np.ndarray:
    """Maximal covered runs of n x 2 spans; touching spans are one."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[new, 0], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(spans) - 1]])]], 1)


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                texts = [t.encode() for t in batch.column("text").slice(at, 500).to_pylist()]
                for _, anchor, _, _ in blocks_of(texts, length):
                    anchor, n = np.unique(anchor, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(n)], names=["anchor", "n"])

    return run


def _places(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                texts = [t.encode() for t in batch.column("text").slice(at, 500).to_pylist()]
                place = np.array(batch.column("place").slice(at, 500).to_pylist(), np.int64)
                for number, anchor, start, size in blocks_of(texts, length):
                    spans = zip(number.tolist(), start.tolist(), (start + size).tolist(), strict=True)
                    content = np.array([digest(texts[i][a:b]) for i, a, b in spans], np.uint64).view(np.int64)
                    columns = (anchor, content, place[number], start, size)
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["anchor", "content", "place", "start", "size"])

    return run


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    expand = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            rows: list[tuple] = []
            part = batch.slice(at, 200)
            for data, wanted in zip(part.column("data").to_pylist(), part.column("wanted").to_pylist(), strict=True):
                text = expand(data)
                rows += [(w["anchor"], w["content"], w["n"], text[w["start"] : w["start"] + w["size"]]) for w in wanted]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["anchor", "content", "n", "block"])


def _unit(length: int):
    def run(rows: pa.Table) -> pa.Table:
        anchors = np.array(rows.column("anchor").to_pylist())
        many = np.array(rows.column("n").to_pylist())
        blocks = rows.column("block").to_pylist()
        spans: list[list[int]] = [[]] * len(blocks)
        order = np.argsort(anchors, kind="stable")
        sizes = np.array([len(b) for b in blocks])[order]
        # an index holds whole anchors: equal windows never have different ones
        new = np.flatnonzero(np.concatenate([[True], anchors[order][1:] != anchors[order][:-1]]))
        totals = np.add.reduceat(sizes, new)
        begin, held = 0, 0
        for k, stop in enumerate([*new[1:].tolist(), len(order)]):
            held += int(totals[k])
            if held < SORTED_BYTES and stop < len(order):
                continue
            part = order[begin:stop]
            index = RunIndex([blocks[i] for i in part], length)
            flags = index.repeated() | np.repeat(many[part] > 1, index.many)
            for i, f in zip(part.tolist(), np.split(flags, index.first[1:]), strict=True):
                spans[i] = spans_of(f, length)
            begin, held = stop, 0
        told = pa.array(spans, pa.list_(pa.int64()))
        return pa.table({"anchor": rows.column("anchor"), "content": rows.column("content"), "spans": told})

    return run


def widths(length: int, gram: int) -> list[int]:
    """How many bytes the windows of an anchor share at each level: half of the rest is added each time."""
    out = [gram]
    while out[-1] < length:
        out.append(out[-1] + (length - out[-1] + 1) // 2)
    return out


def widened(block: bytes, core: int, width: int, more: int, length: int) -> Iterator[tuple[int, bytes, int, bytes]]:
    """(first window, block, core, what is shared) of the two parts of a block whose windows share block[core:core+width].

    A window with ``more`` bytes or more before the core shares those with its part, any other that many behind it.
    """
    many = len(block) - length + 1
    if core >= more:
        yield 0, block[: min(many - 1, core - more) + length], core - more, block[core - more : core + width]
    first = max(0, core - more + 1)
    if first < many:
        yield first, block[first:], core - first, block[core : core + width + more]


def _widen(length: int, level: int):
    width, wider = widths(length, GRAM)[level : level + 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            rows: list[tuple] = []
            columns = (batch.column(c).to_pylist() for c in ("anchor", "content", "n", "core", "block"))
            for anchor, content, n, core, block in zip(*columns, strict=True):
                if core is None:  # the leftmost place at which all windows can have it
                    core = max(0, len(block) - length)
                    hashes = gram_hashes(np.frombuffer(block, np.uint8), GRAM).view(np.int64)
                    core += int(np.argmax(hashes[core : length - GRAM + 1] == anchor))
                for side, (base, part, at, shared) in enumerate(widened(block, core, width, wider - width, length)):
                    side = 0 if at + wider <= core - base + width else 1
                    key = digest(shared, 2 * level + side)
                    rows.append((anchor, content, base, key - (1 << 63), digest(part, at) - (1 << 63), n, at, len(part), part))
            columns = list(zip(*rows, strict=True)) or [[]] * 9
            kinds = [*[pa.int64()] * 8, pa.binary()]
            names = ("of_anchor", "of_content", "base", "anchor", "content", "n", "core", "size", "block")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def numbered(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as the struct ``row`` with a ``place`` of their own.

    Written once: numbers given anew by each scan depend on how files are split, and rows would be taken for others.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("place"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    return written(rows, "numbered")


def marks_of(blocks: DataFrame, sizes: DataFrame, length: int, unit_bytes: int, hot_bytes: int, level: int = 0) -> DataFrame:
    """(anchor, content, spans) of the distinct ``blocks`` (anchor, content, n, core, block), given the bytes of each anchor."""
    total, most = sizes.agg(F.sum("bytes"), F.max("bytes")).first()
    units = max(1, -(-(total or 0) // unit_bytes))
    calm = blocks
    last = level + 1 == len(widths(length, GRAM))
    hot = sizes.where(F.col("bytes") > hot_bytes).select("anchor")
    if (most or 0) > hot_bytes and not last:
        blocks = written(blocks, "repeat-texts")
        calm = blocks.join(hot, "anchor", "left_anti")
    marks = (
        calm.withColumn("unit", F.pmod(F.xxhash64("anchor"), F.lit(units)))
        .groupBy("unit")
        .applyInArrow(_unit(length), "anchor long, content long, spans array<bigint>")
        .where(F.size("spans") > 0)
    )
    if (most or 0) <= hot_bytes or last:
        return marks
    schema = "of_anchor long, of_content long, base long, anchor long, content long, n long, core long, size long, block binary"
    parts = written(blocks.join(hot, "anchor", "left_semi").mapInArrow(trimmed(_widen(length, level)), schema), "repeat-parts")
    distinct = parts.groupBy("anchor", "content").agg(F.sum("n").alias("n"), F.first("core").alias("core"), F.first("size").alias("size"), F.first("block").alias("block"))
    distinct = written(distinct, "repeat-distinct")
    sizes = distinct.groupBy("anchor").agg(F.sum("size").alias("bytes"))
    inner = written(marks_of(distinct, sizes, length, unit_bytes, hot_bytes, level + 1), "repeat-inner")
    back = parts.select("of_anchor", "of_content", "base", "anchor", "content").join(inner, ["anchor", "content"])
    back = back.select(F.col("of_anchor").alias("anchor"), F.col("of_content").alias("content"), F.transform("spans", lambda x: x + F.col("base")).alias("spans"))
    return marks.unionByName(back.groupBy("anchor", "content").agg(F.flatten(F.collect_list("spans")).alias("spans")))


def repeated_spans(rows: DataFrame, length: int = LENGTH, unit_bytes: int = UNIT_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(place, spans): for each row of ``rows`` (place, text) with repeated strings their maximal spans of bytes, unsorted."""
    anchors = rows.mapInArrow(trimmed(_anchors(length)), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    # written, so that both sides of the join are exchanged and a frequent anchor's places can be split
    twice = written(anchors.where("n > 1").select("anchor"), "repeat-anchors")
    places = rows.mapInArrow(trimmed(_places(length)), "anchor long, content long, place long, start long, size long")
    places = written(places.join(twice, "anchor", "left_semi"), "repeat-places")
    blocks = (
        places.groupBy("anchor", "content")
        .agg(F.count("*").alias("n"), F.min(F.struct("place", "start", "size")).alias("one"))
        .select("anchor", "content", "n", "one.*")
    )
    blocks = written(blocks, "repeat-blocks")
    sizes = blocks.groupBy("anchor").agg(F.sum("size").alias("bytes"))
    wanted = blocks.groupBy("place").agg(F.collect_list(F.struct("anchor", "content", "n", "start", "size")).alias("wanted"))
    texts = rows.mapInArrow(trimmed(squeezed), "place long, data binary")
    cut = texts.join(wanted, "place").select("data", "wanted").mapInArrow(trimmed(_cut_out), "anchor long, content long, n long, block binary")
    cut = cut.withColumn("core", F.lit(None).cast("long"))
    marks = written(marks_of(cut, sizes, length, unit_bytes, hot_bytes), "repeat-marks")
    found = places.join(marks, ["anchor", "content"])
    moved = F.transform("spans", lambda x: x + F.col("start"))
    return found.select("place", moved.alias("spans")).groupBy("place").agg(F.flatten(F.collect_list("spans")).alias("spans"))


#: What is given of the remaining bytes: the bytes, their SHA-256, or text without characters that were cut in two.
FORMS = {
    "bytes": (lambda b: b, "binary", pa.binary()),
    "sha256": (lambda b: hashlib.sha256(b).hexdigest(), "string", pa.string()),
    "text": (lambda b: b.decode("utf-8", "ignore"), "string", pa.string()),
}


def _told(form: str):
    give, _, kind = FORMS[form]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                out: dict[str, list] = {n: [] for n in ("place", "n_bytes", "n_removed", "n_spans", "kept", "spans")}
                for place, data, flat in zip(*(part.column(c).to_pylist() for c in ("place", "data", "spans")), strict=True):
                    text = expand(data)
                    spans = united(np.array(flat, np.int64).reshape(-1, 2)).tolist() if flat else []
                    keep, begin = [], 0
                    for a, b in spans:
                        keep.append(text[begin:a])
                        begin = b
                    keep.append(text[begin:])
                    kept = b"".join(keep)
                    row = (place, len(text), len(text) - len(kept), len(spans), give(kept), [x for s in spans for x in s])
                    for name, value in zip(out, row, strict=True):
                        out[name].append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), kind, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return run


def without_repeats(placed: DataFrame, length: int = LENGTH, form: str = "bytes", **limits: int) -> DataFrame:
    """place, n_bytes, n_removed, n_spans, kept, spans (start, end, start, ...) of each row of ``placed``.

    ``placed`` is a table of ``numbered`` whose rows have a column ``text``; ``kept`` is given as ``form``
    (FORMS) tells. A null text counts as empty; a text below ``length`` bytes has no string to
    remove. Rows with equal texts are documents of their own, so a text of ``length`` bytes or more that
    occurs twice is removed whole in both. An empty table gives no rows.
    """
    rows = placed.select("place", F.coalesce("row.text", F.lit("")).alias("text"))
    with scratch(placed.sparkSession):
        spans = written(repeated_spans(rows, length, **limits), "repeat-spans", result=True)
    texts = rows.mapInArrow(trimmed(squeezed), "place long, data binary")
    schema = f"place long, n_bytes long, n_removed long, n_spans long, kept {FORMS[form][1]}, spans array<bigint>"
    return texts.join(spans, "place", "left").select("place", "data", "spans").mapInArrow(trimmed(_told(form)), schema)


def digests(docs: DataFrame, length: int = LENGTH, **limits: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the remaining bytes of each row of ``docs``.

    A null text counts as empty, repeated rows are documents of their own and hold each other's strings, null
    ids stay null, an empty table gives no rows, other columns are ignored. Texts of any length are read whole.
    """
    placed = numbered(docs.select("doc_id", "text"))
    ids = placed.select("place", F.col("row.doc_id").cast("long").alias("doc_id"))
    found = without_repeats(placed, length, "sha256", **limits).withColumnRenamed("kept", "kept_sha256")
    return ids.join(found, "place").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")


def cleaned(docs: DataFrame, length: int = LENGTH, **limits: int) -> DataFrame:
    """``docs`` with repeated strings taken out of ``text``, and ``n_chars``, if there is one, counted anew.

    Bytes of a character that is cut in two are dropped with the rest of it. Null texts stay null. Repeated
    rows of 200 bytes or more stay with an empty text each, an empty table gives an empty one.
    """
    placed = numbered(docs)
    found = without_repeats(placed, length, "text", **limits).where("n_removed > 0")
    both = placed.join(found.select("place", "kept"), "place", "left")
    values = {c: F.col("row")[c] for c in docs.columns}
    values["text"] = F.coalesce("kept", values["text"])
    if "n_chars" in values:
        counted = F.length("kept").cast(docs.schema["n_chars"].dataType)
        values["n_chars"] = F.when(F.col("kept").isNotNull(), counted).otherwise(values["n_chars"])
    return both.select(*[v.alias(c) for c, v in values.items()])
