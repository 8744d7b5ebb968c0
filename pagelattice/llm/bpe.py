"""Byte-pair encoding by forced-boundary splitting, and decoding.

A pair of neighbouring bytes that occurs inside no vocabulary token cannot be bridged by any merge,
so a cut between them is certain. A text is cut at such pairs, the fragments are encoded
independently (each distinct one once), and the ids are concatenated.

The library's pre-tokeniser must cut a fragment as it cuts it in its text. Its pattern reads from left
to right; it takes a contraction, else a run of letters, of numerals or of other visible characters
with one space before it, else white space up to the last one before a visible character. So a cut at a
certain pair is used
* after any visible character: what is left of it is read the same, for only white space looks ahead;
* before any character but an apostrophe: a run that is cut in two goes on as a run of the same kind,
  and no contraction begins there; before an apostrophe only after an ASCII letter or numeral, which
  end their run there anyway.
Certain pairs behind white space are not used, since white space is read by what follows it.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re

import numpy as np
from pyspark.sql import DataFrame

from pagelattice.llm.common import id_and_text, map_rows
from pagelattice.llm.fragments import FragmentIds, spread

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if b not in set(shown)]
    return table | {chr(256 + i): b for i, b in enumerate(hidden)}


def pairs_inside(tokens: list[bytes]) -> np.ndarray:
    """256 x 256 booleans: whether the pair of bytes stands inside some token."""
    inside = np.zeros((256, 256), bool)
    joined = np.frombuffer(b"".join(tokens), np.uint8)
    if len(joined) < 2:
        return inside
    within = np.ones(len(joined) - 1, bool)
    ends = np.cumsum([len(t) for t in tokens])
    within[[e - 1 for e in ends[:-1] if 0 < e < len(joined)]] = False
    inside[joined[:-1][within], joined[1:][within]] = True
    return inside


def usable_cuts(certain: np.ndarray) -> np.ndarray:
    """The certain pairs of bytes at which the pre-tokeniser allows a cut, white space beyond ASCII aside."""
    usable = certain.copy()
    usable[[*range(0x21), 0x7F]] = False
    usable[:, 0x80:0xC0] = False  # not inside a character
    letters = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]
    usable[np.setdiff1d(np.arange(256), letters), 0x27] = False
    return usable


def wide_spaces(text: np.ndarray) -> np.ndarray:
    """Places of last bytes of characters that may be white space beyond ASCII: all of the rows of the code in which there is any."""
    at = np.flatnonzero(text >= 0x80)
    last, before = text[at], text[at - 1]
    two = (before == 0xC2) & ((last == 0x85) | (last == 0xA0)) & (at > 0)
    lead = text[at - 2]
    three = (lead == 0xE2) & ((before == 0x80) | (before == 0x81)) | (lead == 0xE1) & (before == 0x9A) | (lead == 0xE3) & (before == 0x80)
    return at[two | three & (at > 1)]


#: A text whose last character ``wide_spaces`` would tell.
_WIDE_END = re.compile(rb"(?:\xC2[\x85\xA0]|(?:\xE1\x9A|\xE2[\x80\x81]|\xE3\x80)[\x80-\xBF])\Z")


class ForcedBoundaryCodec:
    """Encodes and decodes like the library's tokenizer of a byte-level vocabulary file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        of = byte_alphabet()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            known = all(c in of for c in token)
            self.bytes_of[i] = bytes(of[c] for c in token) if known else token.encode()
        self.sizes = np.array([len(b) for b in self.bytes_of])
        self.first = np.cumsum(self.sizes) - self.sizes
        self.pool = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        #: Pairs of bytes inside no token, and those of them at which texts are cut.
        self.certain = ~pairs_inside(self.bytes_of)
        self.usable = usable_cuts(self.certain)
        self.flat = self.usable.reshape(-1)
        self.between = self._parting()
        self.memory = FragmentIds(self._encode)

    def _parting(self) -> bytes | None:
        """An unassigned character with a usable cut before and after it, whatever its neighbours, to part fragments by."""
        visible = self.usable.any(1)
        starts = np.array([b for b in range(256) if b != 0x27 and not 0x80 <= b < 0xC0])
        last = next((b for b in range(0x80, 0xC0) if self.usable[b, starts].all()), None)
        lead = next((b for b in (0xF1, 0xF2, 0xF3) if self.usable[visible, b].all()), None)
        return None if last is None or lead is None else bytes([lead, 0x85, 0x85, last])

    def boundaries(self, raw: bytes) -> np.ndarray:
        """Whether there is a cut before each byte of ``raw``, its end included."""
        text = np.frombuffer(raw, np.uint8)
        cut = np.zeros(len(text) + 1, bool)
        if len(text) > 1:
            cut[1:-1] = self.flat[text[:-1].astype(np.uint16) << 8 | text[1:]]
            cut[wide_spaces(text) + 1] = False
        return cut

    def decoded(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for, before they are read as UTF-8."""
        return self.pool[spread(self.first[ids], self.sizes[ids])].tobytes()

    def _encode(self, fragments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the fragments, each encoded by itself, and how many each has."""
        ends = self.usable[:, self.between[0]].tolist() if self.between else [False] * 256
        joined = np.array([ends[f[-1]] and f[0] != 0x27 and (f[-1] < 0x80 or not _WIDE_END.search(f)) for f in fragments])
        many = np.zeros(len(fragments), np.int64)
        found, at = [], []
        together = np.flatnonzero(joined)
        for begin in range(0, len(together), 4096):
            # cuts around the character between them are usable, so they are encoded in one run and told apart by their bytes
            some = together[begin : begin + 4096]
            parts = [fragments[k] for k in some.tolist()]
            ids = np.array(self.tokenizer.encode_batch_fast([self.between.join(parts).decode()], add_special_tokens=False)[0].ids, np.uint32)
            sizes = np.array([len(f) for f in parts])
            starts = np.cumsum(sizes + len(self.between)) - sizes - len(self.between)
            places = np.cumsum(self.sizes[ids]) - self.sizes[ids]
            first, last = np.searchsorted(places, starts), np.searchsorted(places, starts + sizes)
            many[some] = last - first
            found.append(ids[spread(first, last - first)])
            at.append(some)
        alone = np.flatnonzero(~joined)
        for k, e in zip(alone.tolist(), self.tokenizer.encode_batch_fast([fragments[k].decode() for k in alone.tolist()], add_special_tokens=False), strict=True):
            found.append(np.array(e.ids, np.uint32))
            many[k] = len(e.ids)
        order = np.concatenate([*at, alone])
        first = np.empty(len(fragments), np.int64)
        first[order] = np.cumsum(many[order]) - many[order]
        return np.concatenate(found)[spread(first, many)], many

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """For each text its ids as little-endian 32-bit integers, and the bytes they decode to."""
        raws = [t.encode() for t in texts]
        raw = b"".join(raws)
        places = np.cumsum([0, *map(len, raws)])
        cut = self.boundaries(raw)
        cut[places] = True  # texts begin fragments of their own
        starts = np.flatnonzero(cut)
        starts, ends = starts[:-1], starts[1:]
        ids, many = self.memory.of(raw, starts, ends)
        tokens = np.concatenate([[0], np.cumsum(many)])[np.searchsorted(starts, places)]
        said = self.decoded(ids)
        ends = np.concatenate([[0], np.cumsum(self.sizes[ids])])[tokens].tolist()
        data, tokens = ids.astype("<u4").tobytes(), (4 * tokens).tolist()
        return [(data[a:b], said[c:d]) for a, b, c, d in zip(tokens, tokens[1:], ends, ends[1:], strict=False)]


@functools.cache
def codec_of(path: str) -> ForcedBoundaryCodec:
    """One for each worker and file, so that later tasks of the worker remember its fragments too."""
    return ForcedBoundaryCodec(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of ``docs`` (doc_id, text).

    A null text counts as empty and gives no ids. Repeated rows give repeated results, null ids stay
    null, an empty table gives an empty result, and other columns are ignored. A text of any length is
    read whole. No shuffle.
    """

    def make():
        codec = codec_of(path)

        def step(rows: dict) -> dict:
            found = []
            texts = rows["text"]
            for at in range(0, len(texts), 100):
                found += codec.encode_batch(texts[at : at + 100])
            return {
                "doc_id": rows["doc_id"],
                "n_tokens": [len(i) // 4 for i, _ in found],
                "ids_sha256": [hashlib.sha256(i).hexdigest() for i, _ in found],
                "decoded_sha256": [hashlib.sha256(b.decode("utf-8", "replace").encode()).hexdigest() for _, b in found],
            }

        return step

    return map_rows(id_and_text(docs), SCHEMA, make)
