"""The decoder on streams that use every part of the format, made by a plain encoder of its own."""

import heapq
from collections import Counter

import numpy as np
import pytest

from pagelattice.llm import webp
from pagelattice.llm.webp import BitWriter


def code_lengths(counts, most=15):
    """Huffman code lengths of used symbols."""
    if len(counts) == 1:
        return {next(iter(counts)): 0}
    heap = [(n, i, (s,)) for i, (s, n) in enumerate(sorted(counts.items()))]
    heapq.heapify(heap)
    depth = Counter()
    k = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            depth[s] += 1
        heapq.heappush(heap, (a[0] + b[0], k, a[2] + b[2]))
        k += 1
    assert max(depth.values()) <= most
    return dict(depth)


def canonical(lengths):
    code, last, out = 0, 0, {}
    for n, s in sorted((n, s) for s, n in lengths.items()):
        code <<= n - last
        last = n
        out[s] = (code, n)
        code += 1
    return out


def put_code(out, lengths, alphabet):
    """Writes a code; one symbol as a simple code, others with plain code lengths."""
    if len(lengths) == 1:
        symbol = next(iter(lengths))
        if symbol < 256:
            out.put(0b101, 3)
            out.put(symbol, 8)
            return {symbol: (0, 0)}
        lengths = {symbol: 1, 0 if symbol else 1: 1}
    out.put(0, 1)
    flat = [lengths.get(s, 0) for s in range(alphabet)]
    inner = code_lengths(Counter(flat))
    if len(inner) == 1:
        inner = {next(iter(inner)): 1, 16: 1}
    stored = [inner.get(s, 0) for s in webp.LENGTH_ORDER]
    out.put(19 - 4, 4)
    for n in stored:
        assert n < 8
        out.put(n, 3)
    out.put(0, 1)
    table = canonical(inner)
    for n in flat:
        out.code(*table[n])
    return canonical(lengths)


def prefix(value):
    """Prefix code, extra bits and their number of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    bits = v.bit_length() - 2
    second = v >> bits & 1
    return 2 * (bits + 1) + second, v - ((2 + second) << bits), bits


def put_image(out, argb, main, cache_bits=0, references=False):
    """An entropy-coded image; with a cache and back-references to the pixel before, if asked for."""
    flat = [int(p) for p in argb.reshape(-1)]
    width = argb.shape[1]
    out.put(int(bool(cache_bits)), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    steps, cache, at = [], [None] * (1 << cache_bits), 0
    while at < len(flat):
        run = 0
        if references and at >= width:
            while at + run < len(flat) and run < 40 and flat[at + run] == flat[at + run - width]:
                run += 1
        p = flat[at]
        slot = (webp.CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if run >= 3:
            steps.append(("ref", run))
        elif cache_bits and cache[slot] == p:
            steps.append(("cache", slot))
            run = 1
        else:
            steps.append(("pixel", p))
            run = 1
        for q in flat[at : at + run]:
            if cache_bits:
                cache[(webp.CACHE_MULTIPLIER * q & 0xFFFFFFFF) >> (32 - cache_bits)] = q
        at += run
    green, red, blue, alpha, distance = (Counter() for _ in range(5))
    for kind, v in steps:
        if kind == "pixel":
            green[v >> 8 & 255] += 1
            red[v >> 16 & 255] += 1
            blue[v & 255] += 1
            alpha[v >> 24] += 1
        elif kind == "ref":
            green[256 + prefix(v)[0]] += 1
            distance[prefix(1)[0]] += 1
        else:
            green[280 + v] += 1
    sizes = (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    g, r, b, a, d = (put_code(out, code_lengths(c or Counter({0: 1})), n) for c, n in zip((green, red, blue, alpha, distance), sizes, strict=True))
    for kind, v in steps:
        if kind == "pixel":
            out.code(*g[v >> 8 & 255])
            out.code(*r[v >> 16 & 255])
            out.code(*b[v & 255])
            out.code(*a[v >> 24])
        elif kind == "ref":
            code, extra, n = prefix(v)
            out.code(*g[256 + code])
            out.put(extra, n)
            out.code(*d[prefix(1)[0]])  # distance code 1 is the pixel above
        else:
            out.code(*g[280 + v])


def split(p):
    return [p >> s & 255 for s in (24, 16, 8, 0)]


def join(c):
    return (c[0] & 255) << 24 | (c[1] & 255) << 16 | (c[2] & 255) << 8 | c[3] & 255


def predict(mode, left, top, corner, right):
    half = lambda a, b: [(x + y) // 2 for x, y in zip(a, b, strict=True)]
    clip = lambda v: max(0, min(255, v))
    if mode == 11:
        apart = lambda o: sum(abs(x + y - z - w) for x, y, z, w in zip(left, top, corner, o, strict=True))
        return left if apart(left) < apart(top) else top
    if mode == 13:
        mean = half(left, top)
        return [clip(m + int((m - c) / 2)) for m, c in zip(mean, corner, strict=True)]
    return {
        0: [255, 0, 0, 0], 1: left, 2: top, 3: right, 4: corner, 5: half(half(left, right), top), 6: half(left, corner), 7: half(left, top),
        8: half(corner, top), 9: half(top, right), 10: half(half(left, corner), half(top, right)),
        12: [clip(x + y - z) for x, y, z in zip(left, top, corner, strict=True)],
    }[mode]


def predictor_residuals(argb, modes, bits):
    h, w = argb.shape
    out = np.zeros_like(argb)
    at = lambda y, x: split(int(argb[y, x]))
    for y in range(h):
        for x in range(w):
            if x == y == 0:
                p = [255, 0, 0, 0]
            elif y == 0:
                p = at(0, x - 1)
            elif x == 0:
                p = at(y - 1, 0)
            else:
                right = at(y - 1, x + 1) if x + 1 < w else at(y, 0)
                p = predict(int(modes[y >> bits, x >> bits]), at(y, x - 1), at(y - 1, x), at(y - 1, x - 1), right)
            out[y, x] = join([a - b for a, b in zip(at(y, x), p, strict=True)])
    return out


def wrap(out, width, height):
    head = BitWriter()
    head.put(0x2F, 8)
    head.put(width - 1, 14)
    head.put(height - 1, 14)
    head.put(1, 1)
    head.put(0, 3)
    head.put(out.value, out.n)
    data = head.value.to_bytes((head.n + 7) // 8, "little")
    data += b"\0" * (len(data) & 1)
    return b"RIFF" + (12 + len(data)).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data


def image(seed=1, h=13, w=17):
    rng = np.random.default_rng(seed)
    smooth = np.add.outer(np.arange(h) * 3, np.arange(w) * 5)[..., None] + rng.integers(0, 9, (h, w, 4))
    smooth[5:9] = smooth[4]
    c = (smooth % 256).astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def as_argb(pixels):
    p = pixels.astype(np.uint32)
    return p[..., 3] << 24 | p[..., 0] << 16 | p[..., 1] << 8 | p[..., 2]


@pytest.mark.parametrize(("cache", "refs"), [(0, False), (4, False), (0, True), (6, True)])
def test_entropy_coding(cache, refs):
    argb = image()
    out = BitWriter()
    out.put(0, 1)
    put_image(out, argb, True, cache, refs)
    pixels, end = webp.decode(wrap(out, 17, 13))
    assert (as_argb(pixels) == argb).all()


@pytest.mark.parametrize("seed", range(3))
def test_predictor_cross_colour_green(seed):
    argb = image(seed)
    h, w = argb.shape
    rng = np.random.default_rng(seed)
    modes = rng.permutation(np.arange(20) % 14)[:20].reshape(4, 5)
    residual = predictor_residuals(argb, modes, 2)
    factors = rng.integers(0, 256, (2, 3, 3))
    signed = lambda v: v - 256 if v > 127 else v
    crossed = np.zeros_like(residual)
    for y in range(h):
        for x in range(w):
            a, r, g, b = split(int(residual[y, x]))
            g2r, g2b, r2b = (signed(int(v)) for v in factors[y >> 3, x >> 3])
            b -= (g2b * signed(g) >> 5) + (r2b * signed(r) >> 5)
            r -= g2r * signed(g) >> 5
            crossed[y, x] = join([a, r, g, b])
    green = np.zeros_like(crossed)
    for y in range(h):
        for x in range(w):
            a, r, g, b = split(int(crossed[y, x]))
            green[y, x] = join([a, r - g, g, b - g])
    out = BitWriter()
    out.put(1, 1)
    out.put(0, 2)
    out.put(0, 3)
    put_image(out, (modes << 8).astype(np.uint32) | np.uint32(255 << 24), False)
    out.put(1, 1)
    out.put(1, 2)
    out.put(1, 3)
    put_image(out, (factors[..., 2] << 16 | factors[..., 1] << 8 | factors[..., 0]).astype(np.uint32), False)
    out.put(1, 1)
    out.put(2, 2)
    out.put(0, 1)
    put_image(out, green, True, 5)
    assert (as_argb(webp.decode(wrap(out, w, h))[0]) == argb).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 7, 16, 17, 200, 256])
def test_palette_round_trip(colours):
    rng = np.random.default_rng(colours)
    values = rng.permutation(256)[:colours].astype(np.uint8)
    grey = rng.choice(values, (5, 576))
    media = webp.encode_grey(grey)
    pixels, end = webp.decode(media)
    assert end == len(media) and (pixels[..., :3] == grey[..., None]).all() and (pixels[..., 3] == 255).all()


def test_several_images_and_errors():
    data = bytes(np.random.default_rng(1).integers(0, 256, 576 * 3, dtype=np.uint8))
    rows = np.frombuffer(data, np.uint8).reshape(-1, 576)
    media = webp.encode_grey(rows[:2]) + webp.encode_grey(rows[2:])
    assert webp.stored_samples(media).tobytes() == data
    for broken in (b"", media[:30], b"RIFX" + media[4:]):
        with pytest.raises(webp.WebPError):
            webp.decode(broken)


def test_texts_are_read_back_through_prefix_codes_and_references(monkeypatch):
    """Ordinary texts are stored with the code of ranks and with references, and the decoder meets both."""
    rng = np.random.default_rng(19)
    words = [f"{a}{b}" for a in ("some", "text", "Wörter", "of") for b in ("", "ly", "ing", "s, and", ".")]
    count = {"green": 0, "referring": 0, "slow": 0}
    green, read = webp._green_pixels, webp.PrefixCode.read

    def counted(bits, group, n, width):
        out = green(bits, group, n, width)
        count["green"] += out is not None
        return out

    monkeypatch.setattr(webp, "_green_pixels", counted)
    for k in range(60):
        text = " ".join(rng.choice(words, int(rng.integers(60, 900))))
        if k % 2:
            text += text[: int(rng.integers(40, len(text)))] + "=" * int(rng.integers(0, 3000))
        payload = webp.payload_of(text.encode())
        media = webp.store(payload)
        assert webp.stored_samples(media).tobytes() == payload
        count["referring"] += len(webp.matches_in(np.frombuffer(payload, np.uint8))) > 0
        assert len(media) < 0.95 * len(payload) + 1300
        # symbol by symbol, as any other decoder reads it
        with pytest.MonkeyPatch.context() as m:
            m.setattr(webp, "_green_pixels", lambda *a: None)
            m.setattr(webp, "_flat_pixels", lambda *a: None)
            assert webp.stored_samples(media).tobytes() == payload
    assert count["green"] >= 58 and count["referring"] >= 55


def test_awkward_payloads():
    rng = np.random.default_rng(20)
    for raw in (b"", b"x", b"xy", bytes(range(256)) * 9, b"ab" * 3000, rng.integers(0, 256, 5000, dtype=np.uint8).tobytes(), b"\xff" * 2000, bytes(10_000)):
        payload = webp.payload_of(raw)
        assert webp.stored_samples(webp.store(payload)).tobytes() == payload


def test_prefixes_of_all_values():
    for value in [*range(1, 5000), 10**5, 10**6]:
        prefix, more, size = webp._prefix(value)
        extra, least = webp._extra(np.array([prefix]))
        assert extra[0] == size and least[0] + more == value
    lengths = webp.huffman_lengths([2.0**-k for k in range(30)], 9)
    assert max(lengths) <= 9 and sum(2.0**-n for n in lengths) == 1
