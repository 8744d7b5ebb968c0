"""Pictures: the reader against a plain decoder, and the operators over files against loops over pixels."""

import struct
import zlib

import numpy as np
import pytest

from pagelattice.operators import images
from pagelattice.sources import pictures


def part(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def paeth(a, b, c):
    return min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]


def filtered(rows, kinds, step):
    """The filters as the format states them, byte by byte."""
    out = b""
    for y, row in enumerate(rows):
        above = rows[y - 1] if y else bytes(len(row))
        out += bytes([kinds[y]])
        for x, v in enumerate(row):
            a, b, c = row[x - step] if x >= step else 0, above[x], above[x - step] if x >= step else 0
            out += bytes([(v - (0, a, b, (a + b) // 2, paeth(a, b, c))[kinds[y]]) & 255])
    return out


def file_of(samples, depth, colour, rng, interlaced=False, more=b""):
    """A file of (height, width, count) samples, each row with a filter at random, the data in two parts."""
    height, width, count = samples.shape
    stream = b""
    for x, y, dx, dy in pictures.PASSES if interlaced else ((0, 0, 1, 1),):
        sub = samples[y::dy, x::dx]
        if not sub.size:
            continue
        rows = []
        for r in sub.reshape(len(sub), -1):
            bits = "".join(f"{int(v):0{depth}b}" for v in r)
            bits += "0" * (-len(bits) % 8)
            rows.append(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)))
        stream += filtered(rows, rng.integers(0, 5, len(rows)).tolist(), max(1, count * depth // 8))
    data = zlib.compress(stream)
    head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, int(interlaced))
    return pictures.SIGNATURE + part(b"IHDR", head) + more + part(b"IDAT", data[:7]) + part(b"IDAT", data[7:]) + part(b"IEND", b"")


KINDS = [(0, d) for d in (1, 2, 4, 8, 16)] + [(3, d) for d in (1, 2, 4, 8)] + [(c, d) for c in (2, 4, 6) for d in (8, 16)]


@pytest.mark.parametrize("colour,depth", KINDS)
@pytest.mark.parametrize("interlaced", [False, True])
def test_every_kind_of_file(colour, depth, interlaced):
    rng = np.random.default_rng(colour * 100 + depth)
    for height, width in ((1, 1), (3, 2), (9, 17), (20, 11)):
        count = pictures.SAMPLES[colour]
        samples = rng.integers(0, 1 << depth, (height, width, count))
        palette = rng.integers(0, 256, (1 << min(depth, 8), 3)).astype(np.uint8)
        clear = bytes(rng.integers(0, 256, min(3, len(palette))).tolist())
        more = part(b"PLTE", palette.tobytes()) + part(b"tRNS", clear) if colour == 3 else b""
        if colour in (0, 2):
            more = part(b"tRNS", struct.pack(f">{count}H", *samples[0, 0].tolist()))
        found = pictures.decode(file_of(samples, depth, colour, rng, interlaced, more))
        for y in range(height):
            for x in range(width):
                v = samples[y, x].tolist()
                eight = [n >> 8 if depth == 16 else n * 255 // ((1 << depth) - 1) for n in v]
                if colour == 3:
                    wanted = [*palette[v[0]].tolist(), clear[v[0]] if v[0] < len(clear) else 255]
                elif colour in (4, 6):
                    wanted = [*(eight[:-1] * 3)[:3], eight[-1]]
                else:
                    wanted = [*(eight * 3)[:3], 0 if v == samples[0, 0].tolist() else 255]
                assert found[y, x].tolist() == wanted


@pytest.mark.parametrize("count", [1, 2, 3, 4])
def test_round_trip(count):
    samples = np.random.default_rng(count).integers(0, 256, (300, 7, count)).astype(np.uint8)
    found = pictures.decode(pictures.encode(samples))
    assert (found[..., -1] == (samples[..., -1] if count in (2, 4) else 255)).all()
    assert (found[..., :3] == samples[..., : 3 if count > 2 else 1]).all()


def test_broken_files():
    good = pictures.encode(np.zeros((5, 5, 1), np.uint8))
    flipped = bytearray(good)
    flipped[45] ^= 1
    short = pictures.SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", 9, 9, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"\0" * 20)) + part(b"IEND", b"")
    for data in (b"", b"GIF89a", good[:-12], good[: len(good) // 2], bytes(flipped), short):
        with pytest.raises(pictures.BrokenPicture):
            pictures.decode(data)


def test_grey_and_sizes():
    shades = np.arange(256, dtype=np.uint8).reshape(16, 16, 1)
    assert (pictures.grey(pictures.decode(pictures.encode(shades))) == shades[..., 0]).all()
    # red alone: 0.2126 of linear light
    red = np.array([[[255, 0, 0, 255], [255, 0, 0, 0]]], np.uint8)
    assert pictures.grey(red).tolist() == [[127, 255]]
    flat = np.full((40, 30, 4), (9, 80, 200, 255), np.uint8)
    small = pictures.resized(flat, 10, 1000)
    assert small.shape == (13, 10, 4) and (small == flat[0, 0]).all()
    assert pictures.resized(flat, 300, 20).shape == (20, 15, 4)
    assert pictures.resized(flat, 30, 40) is flat


def test_pictures_in_folders(spark, tmp_path):
    rng = np.random.default_rng(5)
    wide = {1: rng.integers(0, 256, (33, 20, 3)).astype(np.uint8), 2: rng.integers(0, 256, (5, 20, 3)).astype(np.uint8)}
    other = {1: wide[1].copy(), 2: rng.integers(0, 256, (9, 24, 3)).astype(np.uint8)}
    other[1][:6] = 255 - other[1][:6]
    for role, found in (("source", wide), ("target", other)):
        for pair, samples in found.items():
            folder = tmp_path / f"pair_id={pair}" / f"role={role}"
            folder.mkdir(parents=True)
            (folder / "page.png").write_bytes(pictures.encode(samples))
    broken = tmp_path / "pair_id=3" / "role=source"
    broken.mkdir(parents=True)
    (broken / "page.png").write_bytes(b"no picture at all")
    files = pictures.read(spark, str(tmp_path))
    assert {(r.pair_id, r.role): (r.width, r.height) for r in pictures.sizes(files).collect()} == {
        (1, "source"): (20, 33), (1, "target"): (20, 33), (2, "source"): (20, 5), (2, "target"): (24, 9), (3, "source"): (None, None),
    }
    pairs = files.groupBy("pair_id").pivot("role", ["source", "target"]).agg({"png": "first"})
    rows = {r.pair_id: r for r in images.compare_pictures(pairs, width=20, longest=1000).collect()}
    assert rows[3].error.startswith("source: ") and rows[3].similarity is None
    yiq = ((0.29889531, 0.58662247, 0.11448223), (0.59597799, -0.27417610, -0.32180189), (0.21147017, -0.52261711, 0.31114694))
    a, b = wide[1].astype(int), other[1].astype(int)
    per_row = []
    for y in range(33):
        n = 0
        for x in range(20):
            d = [sum(w * (p - q) for w, p, q in zip(k, a[y, x], b[y, x], strict=True)) for k in yiq]
            n += 0.5053 * d[0] ** 2 + 0.299 * d[1] ** 2 + 0.1957 * d[2] ** 2 > 352.15
        per_row.append(n)
    assert rows[1].similarity == pytest.approx(1 - sum(per_row) / 660)
    assert rows[1].bands == pytest.approx([1 - sum(per_row[4 * k : 33 if k == 7 else 4 * k + 4]) / (100 if k == 7 else 80) for k in range(8)])
    assert (rows[2].width, rows[2].height) == (20, 8)  # 24 x 9 at a width of 20, and the lower one below


def test_hashes_of_files(spark):
    grey = np.random.default_rng(7).integers(0, 256, (120, 150)).astype(np.uint8)
    files = spark.createDataFrame([("a", bytearray(pictures.encode(grey[..., None]))), ("b", bytearray(b"broken")), ("d", bytearray(b"x"))], "image_id string, png binary")
    boxes = [("a", 0, 3.0, 4.0, 90.0, 64.0), ("a", 1, 100.4, 60.6, 70.0, 80.0), ("a", 2, 0.0, 0.0, 39.0, 90.0), ("b", 0, 0.0, 0.0, 50.0, 50.0), ("c", 0, 0.0, 0.0, 50.0, 50.0)]
    found = {(r.image_id, r.ord): r for r in images.hash_pictures(spark.createDataFrame(boxes, "image_id string, ord int, x double, y double, w double, h double"), files).collect()}
    assert set(found) == {b[:2] for b in boxes}
    assert found["a", 2].icon and found["b", 0].error == "no PNG file" and found["c", 0].error == "no picture"
    for left, top, wide, high, ord_ in ((3, 4, 90, 64, 0), (100, 61, 70, 80, 1)):
        bits = ""
        for r in range(8):
            means = []
            for c in range(9):
                x0, x1 = left + c * wide // 9, left + (c + 1) * wide // 9 - 1
                y0, y1 = top + r * high // 8, top + (r + 1) * high // 8 - 1
                x0, x1, y0, y1 = min(x0, 149), min(x1, 149), min(y0, 119), min(y1, 119)
                cells = [int(grey[y, x]) for y in range(y0, y1 + 1, max(1, (y1 - y0 + 1) // 8)) for x in range(x0, x1 + 1, max(1, (x1 - x0 + 1) // 8))]
                means.append(sum(cells) / len(cells))
            bits += "".join("1" if p < q else "0" for p, q in zip(means, means[1:]))
        assert found["a", ord_].hash == f"{int(bits, 2):016x}"


def test_queries_on_awkward_rows(spark, tmp_path):
    """Null and empty texts are one white row, repeated rows stay, a row without an id has its row, an empty table gives none."""
    import duckdb

    from pagelattice.plans import picture_queries

    rows = [(1, None), (2, ""), (3, "one line"), (3, "one line"), (4, "ä\n" * 200_000), (None, "x\ny")]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    documents.write.parquet(str(tmp_path / "some" / "documents.parquet"))
    documents.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    key = lambda r: tuple((v is None, v) for v in r)
    for folder, n in (("some", 6), ("none", 0)):
        found = picture_queries.picture_bands(spark, str(tmp_path / folder))
        con = duckdb.connect()
        con.execute(f"create view documents as select * from read_parquet('{tmp_path}/{folder}/documents.parquet/*.parquet')")
        wanted = [tuple(r) for r in con.execute(f"select {', '.join(found.columns)} from ({picture_queries.BANDS})").fetchall()]
        got = [tuple(r) for r in found.collect()]
        assert len(got) == n and sorted(got, key=key) == sorted(wanted, key=key)
        assert picture_queries.picture_similarity(spark, str(tmp_path / folder)).where("error is not null").count() == 0
        hashes = picture_queries.picture_hashes(spark, str(tmp_path / folder)).collect()
        assert {r.image_id for r in hashes} == {r[0] for r in (rows if n else [])}
        assert sum(r.image_id == 4 for r in hashes) == (-(-600_000 // 65_536) if n else 0)


def _resized_plainly(picture, wide, high):
    def along(p, size):
        have = len(p)
        if have == size:
            return p
        ratio, broad = have / size, max(1.0, have / size)
        out = np.zeros((size, *p.shape[1:]))
        for i in range(size):
            centre = (i + 0.5) * ratio - 0.5
            first = int(np.ceil(centre - 3 * broad))
            t = (np.arange(first, first + int(6 * broad) + 1) - centre) / broad
            w = np.where(np.abs(t) < 3, np.sinc(t) * np.sinc(t / 3), 0.0)
            out[i] = np.tensordot(w, p[np.clip(first + np.arange(len(w)), 0, have - 1)], 1) / w.sum()
        return out

    alpha = picture[..., 3:] / 255
    small = along(along(np.concatenate([picture[..., :3] * alpha, alpha * 255], axis=2), high).swapaxes(0, 1), wide).swapaxes(0, 1)
    alpha = np.clip(small[..., 3:], 0, 255)
    return np.concatenate([np.where(alpha > 0, small[..., :3] * 255 / np.maximum(alpha, 1e-9), 0), alpha], axis=2)


def test_pictures_of_a_size_are_weighed_once(monkeypatch):
    """Many pictures of one size need the weights of their sizes once; greys, colours and clear pixels come out as by the plain rule."""
    rng = np.random.default_rng(11)
    asked = []
    monkeypatch.setattr(np, "sinc", lambda t, _f=np.sinc: (asked.append(1), _f(t))[1])
    for kind in ("grey", "colour", "clear"):
        for high, wide, width, longest in ((9, 16, 32, 64), (40, 16, 32, 30), (7, 16, 5, 64)):
            asked.clear()
            for _ in range(20):
                picture = rng.integers(0, 256, (high, wide, 4)).astype(np.uint8)
                if kind != "clear":
                    picture[..., 3] = 255
                if kind == "grey":
                    picture[..., 1:3] = picture[..., :1]
                small = pictures.resized(picture, width, longest)
            assert len(asked) <= 4
            plain = _resized_plainly(picture, small.shape[1], small.shape[0])
            assert (np.abs(small - np.clip(plain, 0, 255)) <= 0.5 + 1e-6).all()


def test_greys_are_compared_as_colours_are():
    levels = np.arange(256, dtype=np.uint8)
    a, b = np.empty((256, 256, 4), np.uint8), np.empty((256, 256, 4), np.uint8)
    a[..., :3], b[..., :3], a[..., 3], b[..., 3] = levels[:, None, None], levels[None, :, None], 255, 255
    clear = b.copy()
    clear[0, 0, 3] = 254  # one clear pixel, so that colours are computed
    assert (images.differing_pixels(a, b) == images.differing_pixels(a, clear)).all()


def test_a_worker_is_handed_few_bytes(spark):
    """A thousand pictures of 64 KB come in many batches, not in one of the session's number of rows."""
    from pagelattice.plans import adapters

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        texts = spark.range(0, 1000, 1, 1).selectExpr("id", "repeat(cast(id as string), 64 * 1024 div length(cast(id as string))) as png")
        adapters.pictures(texts, "png")
        held = texts.mapInArrow(lambda parts: (p.select(["id"]).slice(0, 1) for p in parts), "id long")
        assert held.count() >= 10
    finally:
        spark.conf.set(name, before)
