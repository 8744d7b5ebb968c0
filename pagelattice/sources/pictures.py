"""Screenshots as PNG files, read by ``binaryFile`` and turned into samples inside tasks.

All colour types, depths and both orders of rows of the format are read. A file that is broken gives an error in its row and fails
nothing else.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Fixed values of the format: samples a pixel by colour type.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Fixed values of the format: first column, first row, step of columns and step of rows of the seven passes of an interlaced picture.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
#: More pixels than these are an error, not a picture; a page of 1,440 by 60,000 pixels stays below.
MOST_PIXELS = 100_000_000


class BrokenPicture(ValueError):
    """The bytes are no whole PNG file."""


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(path, png) of the PNG files below a folder; partition folders become columns."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "false").load(folder)
    return files.withColumnRenamed("content", "png").drop("modificationTime", "length")


def sizes(pictures: DataFrame) -> DataFrame:
    """Width and height of ``pictures`` (png), from the first bytes alone; null where they do not begin a PNG file."""
    number = lambda at: F.conv(F.hex(F.substring("png", at, 4)), 16, 10).cast("long")
    begins = F.substring("png", 1, 16) == F.lit(SIGNATURE + b"\0\0\0\rIHDR")
    return pictures.withColumns({"width": F.when(begins, number(17)), "height": F.when(begins, number(21))})


def _chunks(data: bytes) -> Iterable[tuple[bytes, bytes]]:
    if data[:8] != SIGNATURE:
        raise BrokenPicture("no PNG file")
    at = 8
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(data) < at + 12 + size or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise BrokenPicture("broken part")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise BrokenPicture("no end")


def unfiltered(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """The bytes of filtered ``rows`` (height, bytes a row), of filters ``kinds``; ``step`` bytes are a pixel.

    A byte needs those left of it, above it and left of that one. Filters 1 and 2 need one of the first two, so a run of rows of either is one sum.
    In a run of rows among which are filters 3 and 4 all three lie on earlier diagonals, so a diagonal is one operation over its rows.
    """
    if (kinds > 4).any():
        raise BrokenPicture("unknown filter")
    if not kinds.any():
        return rows
    height, wide = len(rows), rows.shape[1] // step
    raw = rows.reshape(height, wide, step)
    out = np.empty_like(raw)
    above = np.zeros((wide, step), np.uint8)
    at = 0
    while at < height:
        if kinds[at] > 2:
            plain = np.flatnonzero(kinds[at:] <= 2)
            end = at + int(plain[0]) if len(plain) else height
            out[at:end] = _by_diagonals(kinds[at:end], raw[at:end], above)
        else:
            other = np.flatnonzero(kinds[at:] != kinds[at])
            end = at + int(other[0]) if len(other) else height
            if kinds[at] == 2:
                np.cumsum(raw[at:end], axis=0, dtype=np.uint8, out=out[at:end])
                out[at:end] += above
            elif kinds[at] == 1:
                np.cumsum(raw[at:end], axis=1, dtype=np.uint8, out=out[at:end])
            else:
                out[at:end] = raw[at:end]
        above, at = out[end - 1], end
    return out.reshape(height, wide * step)


def _by_diagonals(kinds: np.ndarray, raw: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Rows of filters 3 and 4, from the row ``above`` them on."""
    height, wide, step = raw.shape
    out = np.zeros((height + 1, wide + 1, step), np.int16)
    out[0, 1:] = above
    mean = (kinds == 3)[:, None]
    for t in range(height + wide - 1):
        y = np.arange(max(0, t - wide + 1), min(height, t + 1))
        x = t - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        near_left, near_up, near_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        paeth = np.where((near_left <= near_up) & (near_left <= near_corner), left, np.where(near_up <= near_corner, up, corner))
        out[y + 1, x + 1] = (raw[y, x] + np.where(mean[y], (left + up) >> 1, paeth)) & 255
    return out[1:, 1:].astype(np.uint8)


def _samples(stream: bytes, at: int, width: int, height: int, depth: int, count: int) -> tuple[np.ndarray, int]:
    """(height, width, count) of the samples of one pass that begins at a place of the stream, and where it ends."""
    wide = (width * count * depth + 7) // 8
    end = at + height * (wide + 1)
    if end > len(stream):
        raise BrokenPicture("too few rows")
    lines = np.frombuffer(stream, np.uint8, height * (wide + 1), at).reshape(height, wide + 1)
    rows = unfiltered(lines[:, 0], lines[:, 1:], max(1, count * depth // 8))
    if depth == 16:
        found = np.ascontiguousarray(rows).view(">u2").astype(np.uint16)
    elif depth == 8:
        found = rows
    else:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
        found = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)[:, : width * count]
    return found.reshape(height, width, count), end


def decode(data: bytes) -> np.ndarray:
    """(height, width, 4) of red, green, blue and alpha, 8 bits each; of deeper samples the upper 8 bits."""
    head, palette, clear, parts = None, None, None, []
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body) if len(body) == 13 else None
        elif kind == b"PLTE":
            palette = np.frombuffer(body[: len(body) // 3 * 3], np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            parts.append(body)
    if head is None or head[3] not in SAMPLES or head[2] not in (1, 2, 4, 8, 16) or head[6] > 1 or not 0 < head[0] * head[1] <= MOST_PIXELS:
        raise BrokenPicture("unknown kind of picture")
    width, height, depth, colour, _, _, interlaced = head
    count = SAMPLES[colour]
    passes = PASSES if interlaced else ((0, 0, 1, 1),)
    shapes = [(x, y, dx, dy, max(0, -(-(width - x) // dx)), max(0, -(-(height - y) // dy))) for x, y, dx, dy in passes]
    shapes = [s for s in shapes if s[4] and s[5]]
    most = sum(h * ((w * count * depth + 7) // 8 + 1) for *_, w, h in shapes)
    try:
        stream = zlib.decompressobj().decompress(b"".join(parts), most)
    except zlib.error as e:
        raise BrokenPicture("broken samples") from e
    found = np.zeros((height, width, count), np.uint16 if depth == 16 else np.uint8)
    at = 0
    for x, y, dx, dy, w, h in shapes:
        found[y::dy, x::dx], at = _samples(stream, at, w, h, depth, count)
    return _coloured(found, depth, colour, palette, clear)


def _coloured(found: np.ndarray, depth: int, colour: int, palette: np.ndarray | None, clear: bytes | None) -> np.ndarray:
    out = np.full((*found.shape[:2], 4), 255, np.uint8)
    if colour == 3:
        if palette is None or int(found.max()) >= len(palette):
            raise BrokenPicture("no such colour")
        out[..., :3] = palette[found[..., 0]]
        if clear is not None:
            alpha = np.full(len(palette), 255, np.uint8)
            given = np.frombuffer(clear, np.uint8)[: len(palette)]
            alpha[: len(given)] = given
            out[..., 3] = alpha[found[..., 0]]
        return out
    full = (found >> 8).astype(np.uint8) if depth == 16 else found if depth == 8 else found * np.uint8(255 // ((1 << depth) - 1))
    if colour in (4, 6):
        out[..., 3] = full[..., -1]
        out[..., :3] = full[..., :-1]
        return out
    out[..., :3] = full
    if clear is not None and len(clear) >= 2 * found.shape[2]:
        out[(found == np.frombuffer(clear, ">u2", found.shape[2])).all(axis=2), 3] = 0
    return out


def encode(samples: np.ndarray) -> bytes:
    """A PNG file of (height, width, n) samples of 8 bits: grey, grey and alpha, colours, or colours and alpha for n of 1 to 4."""
    height, width, count = samples.shape
    part = lambda kind, body: struct.pack(">I4s", len(body), kind) + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, (0, 4, 2, 6)[count - 1], 0, 0, 0)
    rows = samples.reshape(height, width * count)
    # each row less the one above it, which is filter 2
    lines = np.concatenate([np.full((height, 1), 2, np.uint8), np.diff(rows, axis=0, prepend=np.zeros((1, width * count), np.uint8))], axis=1)
    return SIGNATURE + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines.tobytes(), 6)) + part(b"IEND", b"")


def grey(picture: np.ndarray) -> np.ndarray:
    """(height, width) of 8-bit grey: the luminance of linear light, seen before white where a pixel is clear."""
    levels = np.arange(256) / 255
    linear = np.where(levels <= 0.04045, levels / 12.92, ((levels + 0.055) / 1.055) ** 2.4)
    out = np.empty(picture.shape[:2], np.uint8)
    for at in range(0, len(picture), 256):
        part = picture[at : at + 256]
        alpha = part[..., 3:4].astype(np.float32) / 255
        solid = np.floor(255 + (part[..., :3].astype(np.float32) - 255) * alpha + 0.5).astype(np.uint8)
        y = linear[solid] @ np.array([0.2126, 0.7152, 0.0722])
        back = np.where(y <= 0.0031308, y * 12.92, 1.055 * np.maximum(y, 0.0031308) ** (1 / 2.4) - 0.055)
        out[at : at + 256] = np.floor(back * 255 + 0.5)
    return out


def _made_taps(have: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For ``size`` places over ``have``: places read and their weights, by tap, and the weights' sums. A windowed sinc of three lobes, as wide as the reduction asks for."""
    ratio = have / size
    wide = max(1.0, ratio)
    centre = (np.arange(size) + 0.5) * ratio - 0.5
    first = np.ceil(centre - 3 * wide).astype(int)
    places = first + np.arange(int(6 * wide) + 1)[:, None]
    t = (places - centre) / wide
    weights = np.where(np.abs(t) < 3, np.sinc(t) * np.sinc(t / 3), 0.0)
    total = np.zeros(size)
    for weight in weights:
        total += weight
    return np.clip(places, 0, have - 1), weights, total


_kept_taps = functools.lru_cache(maxsize=256)(_made_taps)
#: Taps of more numbers than these are made anew; 256 kept ones take 32 MB at most.
MOST_TAPS = 1 << 13


def _taps(have: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (_kept_taps if (6 * max(1.0, have / size) + 1) * size <= MOST_TAPS else _made_taps)(have, size)


def _along(picture: np.ndarray, size: int, axis: int) -> np.ndarray:
    """An axis, 0 or 1, of ``picture`` in ``size`` places."""
    have = picture.shape[axis]
    if have == size:
        return picture
    places, weights, total = _taps(have, size)
    lines = np.ascontiguousarray(picture.swapaxes(0, axis))  # a place reads whole lines
    out = np.zeros((size, *lines.shape[1:]))
    part = np.empty_like(out)
    for place, weight in zip(places, weights[:, :, None, None], strict=True):
        np.multiply(lines[place], weight, out=part)
        out += part
    out /= total[:, None, None]
    return out.swapaxes(0, axis)


def is_opaque_grey(picture: np.ndarray) -> bool:
    """Whether all pixels of (height, width, 4) are grey and none is clear."""
    level = picture[..., 0]
    return bool((picture[..., 3] == 255).all() and (level == picture[..., 1]).all() and (level == picture[..., 2]).all())


@functools.lru_cache(maxsize=256)
def _opaque(high: tuple[int, int], wide: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Alpha of an opaque picture made smaller, as it is computed: the few different rows, and the row of each place from above."""
    levels, which = np.unique(_along(np.full((high[0], 1, 1), 255, np.float32), high[1], 0), return_inverse=True)
    return np.clip(_along(np.broadcast_to(levels[:, None, None], (len(levels), wide[0], 1)), wide[1], 1), 0, 255), which.ravel()


def resized(picture: np.ndarray, width: int, longest: int) -> np.ndarray:
    """``picture`` at a width, or less where its longer edge would pass ``longest``; colours count by their alpha.

    Of an opaque grey picture one colour is computed.
    """
    have_high, have_wide = picture.shape[:2]
    scale = width / have_wide
    if max(have_wide, have_high) * scale > longest:
        scale = longest / max(have_wide, have_high)
    wide, high = (max(1, int(n * scale + 0.5)) for n in (have_wide, have_high))
    if (wide, high) == (have_wide, have_high):
        return picture
    if is_opaque_grey(picture):
        levels, which = _opaque((have_high, high), (have_wide, wide))
        level = _along(_along(picture[..., :1].astype(np.float32), high, 0), wide, 1)
        level = np.clip(np.floor(level * 255 / levels[which] + 0.5), 0, 255).astype(np.uint32)
        return (np.ascontiguousarray(level) * 0x010101 | 0xFF000000).astype("<u4").view(np.uint8)
    share = picture[..., 3:].astype(np.float32) / 255
    alpha = np.clip(_along(_along(share * 255, high, 0), wide, 1), 0, 255)
    colours = _along(_along(picture[..., :3] * share, high, 0), wide, 1)
    colours = np.where(alpha > 0, colours * 255 / np.maximum(alpha, 1e-9), 0)
    return np.clip(np.floor(np.concatenate([colours, alpha], axis=2) + 0.5), 0, 255).astype(np.uint8)


def on_one_canvas(a: np.ndarray, b: np.ndarray, filling: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Both pictures at the upper left of a canvas that holds either; one that fills it is its own."""
    high, wide = (max(x, y) for x, y in zip(a.shape[:2], b.shape[:2], strict=True))
    out = []
    for picture in (a, b):
        if picture.shape[:2] == (high, wide):
            out.append(picture)
            continue
        canvas = np.empty((high, wide, 4), np.uint8)
        canvas[:] = filling
        canvas[: picture.shape[0], : picture.shape[1]] = picture
        out.append(canvas)
    return out[0], out[1]
