"""Lossless WebP (VP8L): a decoder of the whole format, an encoder, and text payloads stored as images.

The decoder reads prefix codes (simple and normal, with meta codes), back-references, the colour
cache and the four transforms, and gives an array of height x width x 4 samples (R, G, B, A). Where
only green varies, as in images with a palette, all tokens of the image are read by array operations:
what would be read is looked up at every bit, and then followed from token to token. Where all codes are flat
(each symbol in use has a code of the same length and none refers back) pixels are cut out of the
bits at once. Any other image is read symbol by symbol.

The encoder stores grey samples with a palette in falling order of frequency, a prefix code made for
such ranks, and back-references to strings of ``LEAST_MATCH`` samples or more; few or evenly used
colours get bundled indices or flat codes, whichever is shorter. The predictor, cross-colour and the colour cache
gain nothing on such an image, which has one channel and no slopes.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import math
import struct
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

from pagelattice.llm.common import id_and_text, map_rows
from pagelattice.llm.runs_dedup import gram_hashes

#: Samples of a row, which is also the unit that payloads are padded to.
WIDTH = 576
#: Most rows of an image; longer payloads continue in another image.
MOST_ROWS = 16384

SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)

# Fixed values of the format: the order in which lengths of the code-length code are stored, and the
# (x, y) offsets of distance codes 1 to 120.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
GREEN, RED, BLUE, ALPHA, DISTANCE = range(5)
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
#: Shortest string that the encoder refers back to, how far apart the places are that it looks for, and longest reference of the format.
LEAST_MATCH, SOURCE_STEP, MOST_MATCH = 32, 16, 4096
#: Longest code of the encoder.
LONGEST_CODE = 12
CACHE_MULTIPLIER = 0x1E35A7BD


class WebPError(ValueError):
    """The data are not lossless WebP."""


class Bits:
    """Reads bits from the least significant up."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def ahead(self, n: int) -> int:
        """The next ``n`` bits without reading on; zeros beyond the end."""
        first = self.at >> 3
        word = int.from_bytes(self.data[first : first + (n + 15) // 8], "little") >> (self.at & 7)
        return word & ((1 << n) - 1)

    def read(self, n: int) -> int:
        if self.at + n > self.end:
            raise WebPError("data end early")
        first = self.at >> 3
        word = int.from_bytes(self.data[first : first + 8], "little") >> (self.at & 7)
        self.at += n
        return word & ((1 << n) - 1)


class PrefixCode:
    """A canonical prefix code over an alphabet, given by code lengths."""

    def __init__(self, lengths: list[int] | dict[int, int]):
        pairs = lengths.items() if isinstance(lengths, dict) else enumerate(lengths)
        used = sorted((n, s) for s, n in pairs if n)
        self.flat = len({n for n, _ in used}) == 1 or len(used) == 1
        self.single = used[0][1] if len(used) == 1 else None
        self.symbols = [s for _, s in used]
        self.bits = 0 if self.single is not None else used[0][0] if used else 0
        if not used:
            raise WebPError("a prefix code without symbols")
        self.codes: dict[tuple[int, int], int] = {}
        if self.single is None:
            if sum(2.0**-n for n, _ in used) != 1:
                raise WebPError("a prefix code that is not complete")
            code = last = 0
            for n, s in used:
                code <<= n - last
                last = n
                self.codes[n, code] = s
                code += 1

    @functools.cached_property
    def table(self) -> tuple[int, np.ndarray, np.ndarray]:
        """Window size, and for each window of the bits ahead the symbol that it begins with and its code's length."""
        if self.single is not None:
            return 0, np.array([self.single], np.int16), np.zeros(1, np.uint8)
        window = max(n for n, _ in self.codes)
        symbols, sizes = np.zeros(1 << window, np.int16), np.zeros(1 << window, np.uint8)
        for (n, code), symbol in self.codes.items():
            first = int(f"{code:0{n}b}"[::-1], 2)
            symbols[first :: 1 << n] = symbol
            sizes[first :: 1 << n] = n
        return window, symbols, sizes

    def read(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        code = n = 0
        while True:
            code, n = code << 1 | bits.read(1), n + 1
            if (n, code) in self.codes:
                return self.codes[n, code]


#: Codes read before: for each alphabet size and number of stored bits, the code that the bits stand for.
#: Stored codes end by themselves, so equal leading bits are the same code.
_SEEN: dict[int, dict[int, dict[int, PrefixCode]]] = {}
_MOST_SEEN = 4096


def read_code(bits: Bits, alphabet: int) -> PrefixCode:
    seen = _SEEN.setdefault(alphabet, {})
    if seen:
        window = bits.ahead(max(seen))
        for n, codes in seen.items():
            code = codes.get(window & ((1 << n) - 1))
            if code is not None and bits.at + n <= bits.end:
                bits.at += n
                return code
    start = bits.at
    code = _read_new_code(bits, alphabet)
    n = bits.at - start
    if n <= 4096 and sum(map(len, seen.values())) < _MOST_SEEN:
        end, bits.at = bits.at, start
        seen.setdefault(n, {})[bits.ahead(n)] = code
        bits.at = end
    return code


def _read_new_code(bits: Bits, alphabet: int) -> PrefixCode:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        found = [bits.read(8 if wide else 1)]
        if two:
            found.append(bits.read(8))
        return PrefixCode({s: 1 for s in found})
    lengths = [0] * 19
    for i in range(4 + bits.read(4)):
        lengths[LENGTH_ORDER[i]] = bits.read(3)
    code = PrefixCode(lengths)
    left = alphabet
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
        if left > alphabet:
            raise WebPError("more code lengths than symbols")
    out: list[int] = []
    before = 8
    while len(out) < alphabet and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            out.append(s)
            before = s or before
        elif s == 16:
            out += [before] * (3 + bits.read(2))
        else:
            out += [0] * (3 + bits.read(3) if s == 17 else 11 + bits.read(7))
    if len(out) > alphabet:
        raise WebPError("code lengths run over the alphabet")
    return PrefixCode(out)


def _value(prefix: int, bits: Bits) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _flat_pixels(bits: Bits, group: list[PrefixCode], n: int) -> np.ndarray | None:
    """Pixels of a single group of flat codes as ARGB, or None where they need reading one by one."""
    if not all(c.flat for c in group[:4]) or max(group[GREEN].symbols) >= LITERALS:
        return None
    widths = [group[c].bits for c in (GREEN, RED, BLUE, ALPHA)]
    each = sum(widths)
    if bits.at + n * each > bits.end:
        raise WebPError("data end early")
    out = np.zeros(n, np.uint32)
    raw = None
    if each:
        first, skip = bits.at >> 3, bits.at & 7
        raw = np.unpackbits(np.frombuffer(bits.data, np.uint8, offset=first, count=(skip + n * each + 7) >> 3), bitorder="little")
        raw = raw[skip : skip + n * each].reshape(n, each)
        bits.at += n * each
    at = 0
    for which, shift, width in zip((GREEN, RED, BLUE, ALPHA), (8, 16, 0, 24), widths, strict=True):
        code = group[which]
        if not width:
            out |= np.uint32(code.symbols[0] << shift)
            continue
        spread = np.zeros((n, 16 if width > 8 else 8), np.uint8)
        spread[:, spread.shape[1] - width :] = raw[:, at : at + width]
        index = np.packbits(spread, axis=1)
        index = index[:, 0] if width <= 8 else index[:, 0].astype(np.uint16) << 8 | index[:, 1]
        out |= np.array(code.symbols, np.uint32)[index] << np.uint32(shift)
        at += width
    return out


def _extra(prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many bits follow a length or distance prefix, and the least value."""
    extra = np.maximum(prefix - 2, 0) >> 1
    return extra, np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << extra) + 1)


def _green_pixels(bits: Bits, group: list[PrefixCode], n: int, width: int) -> np.ndarray | None:
    """Pixels of a group in which only green varies, without a colour cache, or None."""
    if any(group[c].single is None for c in (RED, BLUE, ALPHA)):
        return None
    rest = np.uint32(group[ALPHA].single << 24 | group[RED].single << 16 | group[BLUE].single)
    first, total = bits.at >> 3, bits.end - (bits.at & ~7)
    data = bits.data[first:] + bytes(24)
    words = np.ndarray((total // 8 + 9,), "<u8", data, strides=(1,))
    window, symbols, sizes = group[GREEN].table
    ahead = np.ndarray((total // 8 + 1,), "<u4", data, strides=(1,))[:, None] >> np.arange(8, dtype=np.uint32)
    here = (ahead & np.uint32((1 << window) - 1)).reshape(-1).astype(np.int64)
    symbol, after = symbols[here], np.arange(len(here)) + sizes[here]
    jumps = np.flatnonzero(symbol >= LITERALS)
    length, back = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(jumps):
        # what a reference at each of these bits would be: length, distance prefix, distance

        def read(place: np.ndarray, many: np.ndarray) -> np.ndarray:
            place = np.minimum(place, total)
            return (words[place >> 3] >> (place & 7).astype(np.uint64)).astype(np.int64) & (1 << many) - 1

        place = after[jumps]
        extra, least = _extra(symbol[jumps].astype(np.int64) - LITERALS)
        length = least + read(place, extra)
        place = place + extra
        window, codes, many = group[DISTANCE].table
        found = read(place, np.full(len(place), window))
        place = place + many[found]
        extra, least = _extra(codes[found].astype(np.int64))
        code = least + read(place, extra)
        near = np.array([max(1, x + y * width) for x, y in NEAR])
        back = np.where(code <= len(NEAR), near[np.minimum(code, len(NEAR)) - 1], code - len(NEAR))
        after[jumps] = place + extra
    if group[GREEN].single is not None:
        if group[GREEN].single >= LITERALS:
            return None
        return np.full(n, rest | np.uint32(group[GREEN].single << 8), np.uint32)
    # eight tokens a step, then the seven between
    np.minimum(after, total, out=after)
    after[total:] = total
    two = after[after]
    four = two[two]
    step = memoryview(four[four])
    place, begin, starts = bits.at & 7, bits.at & 7, []
    known = 0
    while place < total and 8 * known < n:
        starts.append(place)
        place = step[place]
        known += 1
    tokens = np.empty((len(starts), 8), np.int64)
    tokens[:, 0] = starts
    for k in range(1, 8):
        tokens[:, k] = after[tokens[:, k - 1]]
    tokens = tokens.reshape(-1)
    tokens = tokens[tokens < total]
    refers = np.flatnonzero(symbol[tokens] >= LITERALS)
    which = np.searchsorted(jumps, tokens[refers])
    many = np.ones(len(tokens), np.int64)
    many[refers] = length[which]
    ends = np.cumsum(many)
    last = int(np.searchsorted(ends, n))
    if last == len(ends) or after[tokens[last]] > total or ends[last] != n:
        raise WebPError("data end early or run over the image")
    bits.at += int(after[tokens[last]]) - begin
    green = np.zeros(n, np.uint8)
    plain = symbol[tokens[: last + 1]] < LITERALS
    green[(ends - many)[: last + 1][plain]] = symbol[tokens[: last + 1][plain]]
    for k, w in zip(refers.tolist(), which.tolist(), strict=True):
        if k > last:
            break
        a, m, d = int(ends[k] - many[k]), int(many[k]), int(back[w])
        if d > a:
            raise WebPError("a back-reference out of the image")
        if d >= m:
            green[a : a + m] = green[a - d : a - d + m]
        else:
            green[a : a + m] = np.resize(green[a - d : a], m)
    return green.astype(np.uint32) << np.uint32(8) | rest


def _entropy_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as ARGB of height x width."""
    cache_bits = 0
    if bits.read(1):
        cache_bits = bits.read(4)
        if not 1 <= cache_bits <= 11:
            raise WebPError("colour cache of a wrong size")
    meta, meta_bits, groups_n = None, 0, 1
    if main and bits.read(1):
        meta_bits = bits.read(3) + 2
        meta = _entropy_image(bits, -(-width >> meta_bits), -(-height >> meta_bits), False) >> 8 & 0xFFFF
        groups_n = int(meta.max()) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    sizes = (LITERALS + LENGTHS + cache_size, 256, 256, 256, DISTANCES)
    groups = [[read_code(bits, n) for n in sizes] for _ in range(groups_n)]
    total = width * height
    if groups_n == 1 and (flat := _flat_pixels(bits, groups[0], total)) is not None:
        return flat.reshape(height, width)
    if groups_n == 1 and not cache_bits and (green := _green_pixels(bits, groups[0], total, width)) is not None:
        return green.reshape(height, width)
    out = [0] * total
    cache = [0] * cache_size
    at = 0
    while at < total:
        g = groups[meta[(at // width) >> meta_bits, (at % width) >> meta_bits]] if meta is not None else groups[0]
        s = g[GREEN].read(bits)
        if s < LITERALS:
            red, blue = g[RED].read(bits), g[BLUE].read(bits)
            fresh = [g[ALPHA].read(bits) << 24 | red << 16 | s << 8 | blue]
        elif s < LITERALS + LENGTHS:
            n = _value(s - LITERALS, bits)
            d = _value(g[DISTANCE].read(bits), bits)
            d = max(1, NEAR[d - 1][0] + NEAR[d - 1][1] * width) if d <= len(NEAR) else d - len(NEAR)
            if d > at or at + n > total:
                raise WebPError("a back-reference out of the image")
            fresh = [out[at - d + i % d] for i in range(n)]
        else:
            fresh = [cache[s - LITERALS - LENGTHS]]
        for p in fresh:
            out[at] = p
            at += 1
            if cache_bits:
                cache[(CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
    return np.array(out, np.uint32).reshape(height, width)


def _channels(argb: np.ndarray) -> np.ndarray:
    """Height x width x (A, R, G, B) as int32."""
    return np.stack([argb >> s & 0xFF for s in (24, 16, 8, 0)], -1).astype(np.int32)


def _argb(channels: np.ndarray) -> np.ndarray:
    c = channels.astype(np.uint32) & 0xFF
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _pick(left, top, corner):
    near = np.abs(top - corner).sum(), np.abs(left - corner).sum()
    return left if near[0] < near[1] else top


def _predicted(mode: int, left, top, corner, right):
    """The prediction from the neighbours left, above, above left and above right."""
    half = lambda a, b: (a + b) >> 1
    if mode == 5:
        return half(half(left, right), top)
    if mode == 6:
        return half(left, corner)
    if mode == 7:
        return half(left, top)
    if mode == 10:
        return half(half(left, corner), half(top, right))
    if mode == 11:
        return _pick(left, top, corner)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    mean = half(left, top)
    delta = mean - corner
    return np.clip(mean + np.fix(delta / 2).astype(np.int32), 0, 255)


def _undo_predictor(argb: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    px = _channels(argb)
    height, width = argb.shape
    px[0, 0, 0] += 255
    px[0] = np.cumsum(px[0], 0) & 0xFF
    for y in range(1, height):
        row, above = px[y], px[y - 1]
        row[0] = (row[0] + above[0]) & 0xFF
        right = np.concatenate([above[1:], row[:1]])  # the last column sees the row's first pixel
        x = 1
        while x < width:
            block = x >> bits
            end = min(width, (block + 1) << bits)
            mode = int(modes[y >> bits, block] >> 8 & 0xF)
            here = slice(x, end)
            if mode in (0, 14, 15):
                row[here, 0] += 255
            elif mode == 1:
                row[here] = row[x - 1] + np.cumsum(row[here], 0)
            elif mode in (2, 3, 4):
                row[here] += above[here] if mode == 2 else right[here] if mode == 3 else above[x - 1 : end - 1]
            elif mode in (8, 9):
                row[here] += (above[here] + (above[x - 1 : end - 1] if mode == 8 else right[here])) >> 1
            else:
                for i in range(x, end):
                    row[i] = (row[i] + _predicted(mode, row[i - 1], above[i], above[i - 1], right[i])) & 0xFF
            row[here] &= 0xFF
            x = end
    return _argb(px)


def _undo_cross_colour(argb: np.ndarray, elements: np.ndarray, bits: int) -> np.ndarray:
    height, width = argb.shape
    e = elements[np.arange(height)[:, None] >> bits, np.arange(width)[None, :] >> bits]
    signed = lambda v: (v & 0xFF).astype(np.uint8).astype(np.int8).astype(np.int32)
    px = _channels(argb)
    green = signed(px[..., 2])
    px[..., 1] = (px[..., 1] + (signed(e) * green >> 5)) & 0xFF
    px[..., 3] = (px[..., 3] + (signed(e >> 8) * green >> 5) + (signed(e >> 16) * signed(px[..., 1]) >> 5)) & 0xFF
    return _argb(px)


def _undo_green(argb: np.ndarray) -> np.ndarray:
    px = _channels(argb)
    px[..., 1] += px[..., 2]
    px[..., 3] += px[..., 2]
    return _argb(px)


def bundling(colours: int) -> int:
    """The power of two of the palette indices that share a pixel."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _undo_palette(argb: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    index = argb >> 8 & 0xFF
    share = bundling(len(palette))
    if share:
        each = 8 >> share
        shifts = np.arange(1 << share, dtype=np.uint32) * each
        index = (index[..., None] >> shifts & ((1 << each) - 1)).reshape(len(argb), -1)[:, :width]
    table = np.zeros(256, np.uint32)
    table[: len(palette)] = palette
    return table[index]


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """The first image of ``data`` as height x width x (R, G, B, A), and where its file ends."""
    if len(data) < 20 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise WebPError("not a lossless WebP file")
    length = struct.unpack("<I", data[16:20])[0]
    end = 8 + struct.unpack("<I", data[4:8])[0]
    bits = Bits(data[20 : 20 + length])
    if bits.read(8) != 0x2F:
        raise WebPError("no VP8L signature")
    width, height, alpha = bits.read(14) + 1, bits.read(14) + 1, bits.read(1)
    if bits.read(3):
        raise WebPError("an unknown version")
    undo, coded = [], width
    seen = set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise WebPError("a transform occurs twice")
        seen.add(kind)
        if kind in (0, 1):
            size = bits.read(3) + 2
            table = _entropy_image(bits, -(-coded >> size), -(-height >> size), False)
            undo.append((_undo_predictor if kind == 0 else _undo_cross_colour, table, size))
        elif kind == 2:
            undo.append((_undo_green,))
        else:
            colours = bits.read(8) + 1
            table = _channels(_entropy_image(bits, colours, 1, False))[0]
            undo.append((_undo_palette, _argb(np.cumsum(table, 0)), coded))
            coded = -(-coded >> bundling(colours))
    argb = _entropy_image(bits, coded, height, True)
    for step, *args in reversed(undo):
        argb = step(argb, *args)
    out = np.empty((height, width, 4), np.uint8)
    for i, s in enumerate((16, 8, 0, 24)):
        out[..., i] = argb >> s & 0xFF
    if not alpha:
        out[..., 3] = 255
    return out, end


class BitWriter:
    def __init__(self):
        self.value = self.n = 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def array(self) -> np.ndarray:
        raw = np.frombuffer(self.value.to_bytes((self.n + 7) // 8, "little"), np.uint8)
        return np.unpackbits(raw, bitorder="little")[: self.n]

    def code(self, code: int, n: int) -> None:
        """A prefix code, most significant bit first."""
        self.put(int(f"{code:0{n}b}"[::-1], 2) if n else 0, n)


@functools.cache
def _single_code(symbol: int) -> tuple[int, int]:
    out = BitWriter()
    out.put(0b101, 3)  # simple, one symbol, of eight bits
    out.put(symbol, 8)
    return out.value, out.n


@functools.cache
def _flat_code(width: int, alphabet: int) -> tuple[int, int]:
    """A normal code in which the first 2**width symbols have codes of ``width`` bits: value and number of bits."""
    out = BitWriter()
    out.put(0, 1)
    lengths = [0] * 19
    lengths[width] = lengths[16] = lengths[18] = 2
    lengths[17] = 2
    stored = max(LENGTH_ORDER.index(s) for s in (width, 16, 17, 18)) + 1
    out.put(stored - 4, 4)
    for s in LENGTH_ORDER[:stored]:
        out.put(lengths[s], 3)
    out.put(0, 1)
    order = sorted((width, 16, 17, 18))
    put = lambda s: out.code(order.index(s), 2)
    left = 1 << width
    put(width)
    left -= 1
    while left:
        if left < 3:
            put(width)
            left -= 1
        else:
            n = min(6, left)
            put(16)
            out.put(n - 3, 2)
            left -= n
    left = alphabet - (1 << width)
    while left:
        n = min(138, left)
        n -= 3 * (0 < left - n < 3)  # a run has three at least
        if n >= 11:
            put(18)
            out.put(n - 11, 7)
        else:
            n = min(10, left)
            put(17)
            out.put(n - 3, 3)
        left -= n
    return out.value, out.n


@functools.cache
def _palette_codes() -> tuple[int, int]:
    """No colour cache, and the codes of a palette's steps: any byte in three channels, 0 or 255 in alpha."""
    out = BitWriter()
    out.put(0, 1)
    out.put(*_flat_code(8, LITERALS + LENGTHS))
    out.put(*_flat_code(8, 256))
    out.put(*_flat_code(8, 256))
    out.put(0b0011, 4)  # simple, two symbols, the first of one bit: 0
    out.put(255, 8)
    out.put(*_single_code(0))
    return out.value, out.n


def huffman_lengths(weights: list[float], longest: int) -> list[int]:
    """Lengths of a prefix code for the weights; small ones are raised until no code is longer than ``longest``."""
    while True:
        heap = [(w, i, [i]) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        lengths = [0] * len(weights)
        made = len(heap)
        while len(heap) > 1:
            (v, _, a), (w, _, b) = heapq.heappop(heap), heapq.heappop(heap)
            for k in a + b:
                lengths[k] += 1
            heapq.heappush(heap, (v + w, made, a + b))
            made += 1
        if max(lengths) <= longest:
            return lengths
        least = min(weights)
        weights = [max(w, 2 * least) for w in weights]


def canonical(lengths: list[int]) -> np.ndarray:
    """The code of each symbol, its first bit lowest, as it is written."""
    out, code, last = np.zeros(len(lengths), np.int64), 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        last = n
        out[s] = int(f"{code:0{n}b}"[::-1], 2)
        code += 1
    return out


def written_code(lengths: list[int]) -> tuple[int, int]:
    """A normal code as it is stored, each length by itself: value and number of bits."""
    out = BitWriter()
    out.put(0, 1)
    used = Counter(lengths)
    own = huffman_lengths([used.get(n, 0) + 0.5 for n in range(16)], 7)
    codes = canonical(own)
    out.put(len(LENGTH_ORDER) - 4, 4)
    for s in LENGTH_ORDER:
        out.put(own[s] if s < 16 else 0, 3)
    out.put(0, 1)
    for n in lengths:
        out.put(int(codes[n]), own[n])
    return out.value, out.n


@functools.cache
def rank_codes() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, int]:
    """Lengths and codes for ranks of samples and for lengths, lengths and codes for distances, and all of them as they are stored.

    One prefix code serves all texts, since samples are coded by rank: weights fall by a ninth a rank.
    """
    ranks = [0.11 * math.exp(-r / 9) + 0.0006 for r in range(LITERALS)]
    green = huffman_lengths(ranks + [0.002] * LENGTHS, LONGEST_CODE)
    far = huffman_lengths([0.3] * 4 + [0.2] * 10 + [1.0] * 20 + [0.2] * 6, LONGEST_CODE)
    out = BitWriter()
    out.put(0, 3)  # no more transforms, no colour cache, no meta codes
    out.put(*written_code(green))
    for symbol in (0, 0, 255):
        out.put(*_single_code(symbol))
    out.put(*written_code(far))
    return np.array(green), canonical(green), np.array(far), canonical(far), out.value, out.n


def matches_in(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, distance, length) of strings that stand earlier as well, in order, without overlaps."""
    if len(x) < 2 * LEAST_MATCH:
        return []
    hashes = gram_hashes(x, LEAST_MATCH)
    sources = np.arange(0, len(hashes), SOURCE_STEP)[::-1]
    bits = len(sources).bit_length() + 2
    slot = (hashes >> np.uint64(64 - bits)).astype(np.int32)
    table = np.zeros(1 << bits, np.int32)
    table[slot[sources]] = sources  # the first place of a hash, unless another one has taken its slot
    source = table[slot]
    hit = np.flatnonzero((hashes[source] == hashes) & (source < np.arange(len(hashes), dtype=np.int32)))
    out, k, end = [], 0, 0
    while k < len(hit):
        at = int(hit[k])
        begin = int(source[at])
        most = min(MOST_MATCH, len(x) - at)
        differs = x[begin : begin + most] != x[at : at + most]
        n = int(np.argmax(differs)) if differs.any() else most
        if n >= LEAST_MATCH:
            out.append((at, at - begin, n))
            end = at + n
        else:  # equal hashes of other strings
            end = at + 1
        k = int(np.searchsorted(hit, end))
    return out


def _prefix(value: int) -> tuple[int, int, int]:
    """Prefix of a length or distance from 1 on, and the bits that follow: value and number."""
    d = value - 1
    if d < 4:
        return d, 0, 0
    h = d.bit_length() - 1
    return 2 * h + (d >> (h - 1) & 1), d & (1 << (h - 1)) - 1, h - 1


def _bits_of(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The lowest ``sizes`` bits of each value, one after another."""
    ends = np.cumsum(sizes)
    at = np.arange(int(ends[-1])) - np.repeat(ends - sizes, sizes)
    return (np.repeat(values, sizes) >> at & 1).astype(np.uint8)


def _ranked(coded: np.ndarray, width: int) -> np.ndarray:
    """The bits of an image of ranks: codes, samples and references."""
    length, code, far_length, far_code, value, n = rank_codes()
    head = BitWriter()
    head.put(value, n)
    values, sizes = code[coded], length[coded]
    found = matches_in(coded)
    if found:
        parts_v, parts_n, at = [], [], 0
        for place, distance, many in found:
            prefix, more, size = _prefix(many)
            far, rest, rest_size = _prefix(1 if distance == width else 2 if distance == 1 else distance + len(NEAR))
            parts_v += [values[at:place], [code[LITERALS + prefix], more, far_code[far], rest]]
            parts_n += [sizes[at:place], [length[LITERALS + prefix], size, far_length[far], rest_size]]
            at = place + many
        values, sizes = np.concatenate([*parts_v, values[at:]]).astype(np.int64), np.concatenate([*parts_n, sizes[at:]]).astype(np.int64)
    return np.concatenate([head.array(), _bits_of(values, sizes)])


def encode_grey(samples: np.ndarray) -> bytes:
    """A lossless WebP file of height x width grey samples: a palette, and prefix codes of ranks with back-references or flat ones."""
    height, width = samples.shape
    counts = np.bincount(samples.reshape(-1), minlength=256)
    colours = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
    index = np.zeros(256, np.uint8)
    index[colours] = np.arange(len(colours), dtype=np.uint8)
    coded = index[samples]
    share = bundling(len(colours))
    if share:
        each, many = 8 >> share, 1 << share
        padded = np.zeros((height, -(-width // many) * many), np.uint8)
        padded[:, :width] = coded
        coded = np.zeros((height, padded.shape[1] // many), np.uint8)
        for i in range(many):
            coded |= padded[:, i::many] << (i * each)
    head = BitWriter()
    head.put(0x2F, 8)
    head.put(width - 1, 14)
    head.put(height - 1, 14)
    head.put(0, 4)  # no alpha, version 0
    head.put(1, 1)
    head.put(3, 2)
    head.put(len(colours) - 1, 8)
    head.put(*_palette_codes())
    # each colour: its step in green, red and blue by 8 bits each, and whether alpha steps to 255
    steps = np.diff(colours, prepend=0).astype(np.uint8)
    table = np.zeros((len(colours), 25), np.uint8)
    table[:, :24] = np.tile(np.unpackbits(steps[:, None], axis=1), 3)
    table[0, 24] = 1
    bits = int(coded.max()).bit_length()
    if not share and bits:
        body = _ranked(coded.reshape(-1), width)
    if share or not bits or len(body) > coded.size * bits:
        tail = BitWriter()
        tail.put(0, 3)  # no more transforms, no colour cache, no meta codes
        tail.put(*(_flat_code(bits, LITERALS + LENGTHS) if bits else _single_code(0)))
        for symbol in (0, 0, 255, 0):
            tail.put(*_single_code(symbol))
        flat = np.unpackbits(coded.reshape(-1, 1), axis=1)[:, 8 - bits :].reshape(-1) if bits else np.zeros(0, np.uint8)
        body = np.concatenate([tail.array(), flat])
    data = np.packbits(np.concatenate([head.array(), table.reshape(-1), body]), bitorder="little").tobytes()
    odd = len(data) & 1
    return b"RIFF" + struct.pack("<I", 12 + len(data) + odd) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data + b"\0" * odd


def payload_of(text: bytes) -> bytes:
    """The text and bytes 255 up to a positive multiple of WIDTH."""
    size = max(1, -(-len(text) // WIDTH)) * WIDTH
    return text + b"\xff" * (size - len(text))


def store(payload: bytes) -> bytes:
    """One image file after another, each of at most MOST_ROWS rows."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return b"".join(encode_grey(rows[at : at + MOST_ROWS]) for at in range(0, len(rows), MOST_ROWS))


def stored_samples(media: bytes) -> np.ndarray:
    """The grey samples of all images in ``media``, rows of WIDTH."""
    found, at = [], 0
    while at < len(media):
        pixels, size = decode(media[at:] if at else media)
        found.append(np.ascontiguousarray(pixels[..., 1]))
        at += size
    return np.concatenate(found)


def feature_of(samples: np.ndarray) -> str:
    """Size, mean and spread of the samples, and their shares in eight bands of 32 values."""
    counts = np.bincount(samples.reshape(-1), minlength=256)
    n, values = int(counts.sum()), np.arange(256)
    mean = float(counts @ values) / n
    spread = max(0.0, float(counts @ values**2) / n - mean * mean) ** 0.5
    bands = "/".join(f"{x / n:.4f}" for x in counts.reshape(8, 32).sum(1).tolist())
    return f"{samples.shape[1]}x{samples.shape[0]} mean={mean:.4f} std={spread:.4f} bands={bands}"


def media_documents(docs: DataFrame) -> DataFrame:
    """Each row's text stored as lossless WebP, read back, and described.

    A null or empty text is a payload of one row of 255. Repeated rows and equal texts give equal
    values, null ids stay null, an empty table gives no rows, other columns are ignored. Texts of any
    length are stored whole, in several images where one does not hold them. No shuffle.
    """

    def make():
        def one(text: str) -> tuple:
            raw = text.encode()
            media = store(payload_of(raw))
            samples = stored_samples(media)
            back = samples.tobytes()
            return (
                len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]),
                len(media), hashlib.sha256(media).hexdigest(), feature_of(samples),
            )

        def step(rows: dict) -> dict:
            names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
            found = [one(t) for t in rows["text"]]
            return {"doc_id": rows["doc_id"]} | {n: [f[i] for f in found] for i, n in enumerate(names)}

        return step

    return map_rows(id_and_text(docs), SCHEMA, make)
