"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Documents are cut into whole windows and a rest. Rests are gathered into batches that fill ``WINDOWS``
windows but for ``SLACK`` tokens each; a batch is partitioned by differencing: every piece starts as a
partition of its own (one window holds it, the others are empty), and the two partitions with the
largest imbalance are merged with opposing order until one is left, whose windows are near-equal. If a
window is over capacity, the window count rises by one and the batch is differenced again. Only the
rest that ends a batch is cut, and the last tokens of a task, which go into powers of two.

Memory is bounded by a batch: one batch's ids and one document's ids. No shuffle; a task that is run
again gives the same sequences, for it sees the same rows in the same order.
"""

from __future__ import annotations

import functools
import heapq
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pagelattice.llm.common import id_and_text, trimmed
from pagelattice.llm.fragments import FragmentIds, spread

CAPACITY = 2048
#: Windows of a batch, and the tokens that a batch leaves free in each, so that differencing mostly fits at once.
WINDOWS, SLACK = 64, 20
#: Ended documents carry this id last.
END_ID = 1

SCHEMA = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
)


def differenced(lengths: list[int], windows: int) -> list[list[int]]:
    """Indices of ``lengths`` in each of ``windows`` near-equal windows, by multiway differencing."""
    if not lengths:
        return [[] for _ in range(windows)]
    if windows == 1:
        return [list(range(len(lengths)))]
    # A partition: imbalance, order of making, sums ascending from 0, and the windows' contents.
    heap = [(-n, i, [0] * (windows - 1) + [n], [None] * (windows - 1) + [(None, None, i)]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        _, _, sums, held = heapq.heappop(heap)
        _, _, others, their = heapq.heappop(heap)
        both = [(s + o, i, h, t) for i, (s, o, h, t) in enumerate(zip(sums, reversed(others), held, reversed(their), strict=True))]
        both.sort(key=lambda x: x[:2])
        least = both[0][0]
        sums = [x[0] - least for x in both]
        # contents stay a tree until the end; nothing is copied at a merge
        held = [(h, t, None) if h and t else h or t for _, _, h, t in both]
        heapq.heappush(heap, (-sums[-1], made, sums, held))
        made += 1
    out = []
    for tree in heap[0][3]:
        found, rest = [], [tree] if tree else []
        while rest:
            left, right, item = rest.pop()
            if item is not None:
                found.append(item)
            else:
                rest += [left, right]
        out.append(sorted(found))
    return out


def packed(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Indices of ``lengths``, none over ``capacity``, in near-equal windows that hold at most ``capacity`` each."""
    windows = max(1, -(-sum(lengths) // capacity)) if lengths else 0
    while True:
        groups = differenced(lengths, windows)
        if all(sum(lengths[i] for i in g) <= capacity for g in groups):
            return [g for g in groups if g]
        windows += 1


# What a lower-case Latin-1 character is to the file's pre-tokeniser: white space, a letter, a numeral, or any other.
_SPACE, _LETTER, _NUMERAL, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*range(0x61, 0x7B), 0xAA, 0xB5, 0xBA, *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = _LETTER
_KIND[[*range(0x30, 0x3A), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = _NUMERAL
_KIND[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0]] = _SPACE
_CUT = re.compile(r"[ \t\n\r]+")


def pieces_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of a lower-case Latin-1 text: contractions, letters, single numerals, other characters."""
    text = np.frombuffer(raw, np.uint8)
    kind = _KIND[text]
    before = np.concatenate([[_SPACE], kind[:-1]])
    begins = (kind != _SPACE) & ((kind != before) | (kind == _NUMERAL))
    # an apostrophe that begins a piece takes the letters of a contraction with it, and what follows begins another
    at = np.flatnonzero(begins & (text == 0x27))
    padded = np.concatenate([text, np.zeros(3, np.uint8)])
    one, two = padded[at + 1], padded[at + 2]
    single = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    double = (one == 0x72) & (two == 0x65) | (one == 0x76) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)
    begins[at[single | double] + 1] = False
    for taken, n in ((single, 2), (double, 3)):
        after = at[taken] + n
        after = after[after < len(text)]
        begins[after[kind[after] != _SPACE]] = True
    ends = (kind != _SPACE) & np.concatenate([begins[1:] | (kind[1:] == _SPACE), [True]])
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


class WordIds:
    """Ids of a text by a tokenizer of lower-case words with word ends that drops white space.

    The normaliser and pre-tokeniser of the file act within pieces only, and distinct pieces are encoded
    once and remembered. New pieces are encoded in one run, with spaces between them, and told apart by
    the ids that end a word; ASCII ones, which are normal already, by the file's model alone. Texts beyond
    Latin-1, or that may hold special tokens, are cut at ASCII white space instead, and those parts are
    encoded one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        #: For words in printable ASCII, whose bytes the vocabulary writes as themselves.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.memory = FragmentIds(self._encode)

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that are one pre-token each, and how many each has."""
        printable = np.array([p.isascii() and p.decode("latin-1").isprintable() for p in pieces])
        many, found, at = np.zeros(len(pieces), np.int64), [], []
        for tokenizer, which in ((self.bare, np.flatnonzero(printable)), (self.tokenizer, np.flatnonzero(~printable))):
            for begin in range(0, len(which), 4096):
                some = which[begin : begin + 4096]
                part = b" ".join([pieces[k] for k in some.tolist()]).decode("latin-1")
                ids = np.array(tokenizer.encode_batch_fast([part], add_special_tokens=False)[0].ids, np.uint32)
                stops = np.flatnonzero(self.ends[ids]) + 1
                if len(stops) != len(some):
                    raise ValueError("a piece is not one pre-token; the file is not of the expected kind")
                many[some] = np.diff(stops, prepend=0)
                found.append(ids)
                at.append(some)
        order = np.concatenate(at)
        first = np.empty(len(pieces), np.int64)
        first[order] = np.cumsum(many[order]) - many[order]
        return np.concatenate(found)[spread(first, many)], many

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian 32-bit integers."""
        raws: list[bytes | None] = []
        for t in texts:
            try:
                raws.append(None if "<|" in t else t.lower().encode("latin-1"))
            except UnicodeEncodeError:
                raws.append(None)
        plain = [r for r in raws if r is not None]
        raw = b"\n".join(plain)
        starts, ends = pieces_of(raw)
        ids, many = self.memory.of(raw, starts, ends)
        data = ids.astype("<u4").tobytes()
        tokens = np.concatenate([[0], np.cumsum(many)])
        places = np.cumsum([0, *(len(r) + 1 for r in plain)])
        cuts = (4 * tokens[np.searchsorted(starts, places)]).tolist()
        found = iter(zip(cuts, cuts[1:], strict=False))
        out = []
        for r, t in zip(raws, texts, strict=True):
            if r is None:
                parts = self.tokenizer.encode_batch_fast(_CUT.split(t), add_special_tokens=False)
                out.append(b"".join([np.array(e.ids, "<u4").tobytes() for e in parts]))
            else:
                a, b = next(found)
                out.append(data[a:b])
        return out


@functools.cache
def words_of(path: str) -> WordIds:
    """One for each worker and file, so that later tasks of the worker remember its pieces too."""
    return WordIds(path)


class Packer:
    """Takes documents' ids one after another and gives rows of SCHEMA."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY):
        self.capacity, self.sequence = capacity, first_sequence
        self.slack = min(SLACK, capacity // 64)
        self.most = WINDOWS * (capacity - self.slack)
        self.largest = 1 << (capacity.bit_length() - 1)
        self.rests: list[tuple[int | None, int, bytes, int]] = []  # doc_id, start, ids, tokens of the document
        self.held = 0
        self.rows: list[tuple] = []

    def _row(self, doc, start, ids, total, offset):
        self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, self.sequence, offset))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, at, step = len(ids) // 4, 0, self.capacity
        while total - at >= step:
            self._row(doc_id, at, ids[4 * at : 4 * (at + step)], total, 0)
            self.sequence += 1
            at += step
        room = self.most - self.held
        while at < total:  # a batch is filled to the last token; what is over begins the next
            n = min(total - at, room)
            self.rests.append((doc_id, at, ids[4 * at : 4 * (at + n)], total))
            self.held += n
            at, room = at + n, room - n
            if not room:
                self.flush()
                room = self.most

    def flush(self) -> None:
        for window in packed([len(r[2]) // 4 for r in self.rests], self.capacity):
            offset = 0
            for i in window:
                doc, at, ids, total = self.rests[i]
                self._row(doc, at, ids, total, offset)
                offset += len(ids) // 4
            self.sequence += 1
        self.rests, self.held = [], 0

    def finish(self) -> None:
        """The last batch: as many windows as it fills but for the slack, by differencing, then powers of two, which need no padding."""
        over = self.held - self.held // self.capacity * (self.capacity - self.slack)
        last = []
        while over and self.rests:
            doc, at, ids, total = self.rests.pop()
            n = min(over, len(ids) // 4)
            keep = len(ids) // 4 - n
            last.append((doc, at + keep, ids[4 * keep :], total))
            if keep:
                self.rests.append((doc, at, ids[: 4 * keep], total))
            over -= n
        self.flush()
        rest = sum(len(r[2]) // 4 for r in last)
        last.reverse()
        while rest:
            size, offset = min(self.largest, 1 << (rest.bit_length() - 1)), 0
            while offset < size:
                doc, at, ids, total = last.pop(0)
                n = min(size - offset, len(ids) // 4)
                self._row(doc, at, ids[: 4 * n], total, offset)
                if n < len(ids) // 4:
                    last.insert(0, (doc, at + n, ids[4 * n :], total))
                offset += n
            self.sequence += 1
            rest -= size


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of the documents' ids (and END_ID after each) in sequences of at most ``capacity``.

    A null text counts as empty, so its document is the end id alone. Repeated rows are packed each,
    null ids stay null, an empty table gives no rows, and other columns are ignored. A text of any
    length is read whole; one of more than ``capacity`` tokens fills windows of its own first. Sequences
    are numbered within a task from 2**33 times its partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path)
        end = np.array([END_ID], "<u4").tobytes()
        context = TaskContext.get()
        packer = Packer((context.partitionId() if context else 0) << 33, capacity)
        names = [f.name for f in SCHEMA]

        def rows() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True)) or [[] for _ in names]
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                for doc, ids in zip(part.column(0).to_pylist(), words.encode_batch(part.column(1).to_pylist()), strict=True):
                    packer.add(doc, ids + end)
            yield rows()
        packer.finish()
        yield rows()

    return id_and_text(docs).mapInArrow(trimmed(run), SCHEMA)
