"""Images: perceptual hashes, pixel comparison, and matching by hash and place."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelattice.functions import text
from pagelattice.operators.groups import small_batches, spread
from pagelattice.sources import pictures as png

ICON, FLAT_LOW, FLAT_HIGH = 40, 3, 61
HASH_MOST, COPY_MOST, WINDOW_LEAST, WINDOW_SHARE = 10, 6, 60, 1.5


def hamming_hex(a: Column, b: Column) -> Column:
    """A16 of hashes as hex digits: differing bits; 64 if one is null or their lengths differ.

    Sixteen digits do not fit a signed number, so halves are compared.
    """

    def half(at: int) -> Column:
        x, y = (F.conv(F.substring(c, at, 8), 16, 10).try_cast("bigint") for c in (a, b))
        return F.bit_count(F.coalesce(x, F.lit(0)).bitwiseXOR(F.coalesce(y, F.lit(0))))

    same = F.coalesce((F.length(a) == F.length(b)) & (F.length(a) > 0), F.lit(False))
    return F.when(same, half(1) + half(9)).otherwise(64)


def hamming(a: Column, b: Column) -> Column:
    """A16 of hashes as 64-bit numbers."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)).cast("int"), F.lit(64))


def difference_hash(grey: np.ndarray, x: float, y: float, w: float, h: float) -> dict:
    """Of a box in a grey image, as 16 hex digits; or that it is an icon or flat.

    The box is cut into 8 x 9 cells; a bit tells that a cell is darker than the one right of it. A cell's
    mean takes every eighth of its width and height at most.
    """
    if min(w, h) < ICON:
        return {"hash": None, "icon": True, "flat": False}
    height, width = grey.shape
    left, top, wide, high = (math.floor(v + 0.5) for v in (x, y, w, h))

    def mean(x0: int, x1: int, y0: int, y1: int) -> float:
        x0, x1 = (min(max(v, 0), width - 1) for v in (x0, x1 - 1))
        y0, y1 = (min(max(v, 0), height - 1) for v in (y0, y1 - 1))
        part = grey[y0 : y1 + 1 : max(1, (y1 - y0 + 1) // 8), x0 : x1 + 1 : max(1, (x1 - x0 + 1) // 8)]
        return float(part.mean()) if part.size else 0.0

    edges_x = [left + c * wide // 9 for c in range(10)]
    edges_y = [top + r * high // 8 for r in range(9)]
    means = np.array([[mean(edges_x[c], edges_x[c + 1], edges_y[r], edges_y[r + 1]) for c in range(9)] for r in range(8)])
    bits = means[:, :-1] < means[:, 1:]
    ones = int(bits.sum())
    if ones <= FLAT_LOW or ones >= FLAT_HIGH:
        return {"hash": None, "icon": False, "flat": True}
    return {"hash": np.packbits(bits).tobytes().hex(), "icon": False, "flat": False}


def hash_nodes(nodes: DataFrame, images: DataFrame) -> DataFrame:
    """A15 over nodes (image_id, ord, x, y, w, h) and grey images (image_id, width, height, grey: binary)."""

    def run(part: pd.DataFrame, image: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, i in image.head(1).iterrows():
            grey = np.frombuffer(i["grey"], np.uint8).reshape(i["height"], i["width"])
            rows = [{"image_id": n.image_id, "ord": n.ord} | difference_hash(grey, n.x, n.y, n.w, n.h) for n in part.itertuples()]
        return pd.DataFrame(rows, columns=["image_id", "ord", "hash", "icon", "flat"])

    schema = "image_id string, ord int, hash string, icon boolean, flat boolean"
    return nodes.groupBy("image_id").cogroup(images.groupBy("image_id")).applyInPandas(run, schema)


def differing_pixels(a: np.ndarray, b: np.ndarray, threshold: float = 0.1) -> np.ndarray:
    """Pixels of two RGBA images whose YIQ distance exceeds the threshold; anti-aliased ones count too.

    Semi-transparent pixels are blended with white. The metric is the published perceptual one; a comparison
    library's own rounding may differ in single pixels. Opaque greys are looked up in a table of all pairs of levels.
    """
    if png.is_opaque_grey(a) and png.is_opaque_grey(b):
        return np.take(_differing_greys(threshold), (a[..., 0].astype(np.intp) << 8) | b[..., 0])
    return _differing_colours(a, b, threshold)


@functools.cache
def _differing_greys(threshold: float) -> np.ndarray:
    levels = np.arange(256, dtype=np.uint8).repeat(4).reshape(256, 1, 4)
    levels[..., 3] = 255
    return _differing_colours(np.broadcast_to(levels, (256, 256, 4)), np.broadcast_to(levels.swapaxes(0, 1), (256, 256, 4)), threshold).ravel()


def _differing_colours(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    def yiq(p: np.ndarray) -> np.ndarray:
        alpha = p[..., 3:4].astype(float) / 255
        r, g, b = np.moveaxis(255 + (p[..., :3].astype(float) - 255) * alpha, -1, 0)
        return np.stack(
            [
                r * 0.29889531 + g * 0.58662247 + b * 0.11448223,
                r * 0.59597799 - g * 0.27417610 - b * 0.32180189,
                r * 0.21147017 - g * 0.52261711 + b * 0.31114694,
            ]
        )

    d = yiq(a) - yiq(b)
    return (0.5053 * d[0] ** 2 + 0.299 * d[1] ** 2 + 0.1957 * d[2] ** 2) > 35215 * threshold * threshold


def compare_pixels(a: np.ndarray, b: np.ndarray, bands: int = 8, changed_below: float = 0.9) -> dict:
    """Similarity of two images of equal size, and of horizontal bands, the last of which takes the rest."""
    differ = np.concatenate([differing_pixels(a[at : at + 512], b[at : at + 512]) for at in range(0, len(a), 512)]) if len(a) else np.zeros((0, 1), bool)
    height = len(differ)
    step = max(1, height // bands)
    found = []
    for i in range(bands):
        start = i * step
        if start >= height:
            break
        part = differ[start : height if i == bands - 1 else min(height, start + step)]
        found.append(1 - float(part.mean()))
    share = float(differ.mean()) if differ.size else 0.0
    return {"similarity": 1 - share, "bands": found, "changed_bands": sum(s < changed_below for s in found)}


def compare_images(pairs: DataFrame, bands: int = 8) -> DataFrame:
    """A14 over (pair_id, width, height, source: binary, target: binary) of RGBA samples."""

    def run(batches):
        for part in batches:
            rows = []
            for p in part.itertuples():
                a, b = (np.frombuffer(raw, np.uint8).reshape(p.height, p.width, 4) for raw in (p.source, p.target))
                rows.append({"pair_id": p.pair_id} | compare_pixels(a, b, bands))
            yield pd.DataFrame(rows, columns=["pair_id", "similarity", "bands", "changed_bands"])

    return pairs.mapInPandas(run, "pair_id string, similarity double, bands array<double>, changed_bands int")


#: Width and longer edge of pictures that are compared, and the colour (with alpha) beside the smaller one.
COMPARE_WIDTH, LONGEST_EDGE, BESIDE = 512, 1024, (200, 200, 200, 255)


def _opened(data: bytes | None) -> tuple[np.ndarray | None, str | None]:
    if data is None:
        return None, "no picture"
    try:
        return png.decode(data), None
    except png.BrokenPicture as e:
        return None, str(e)


def compare_pictures(pairs: DataFrame, width: int = COMPARE_WIDTH, longest: int = LONGEST_EDGE, bands: int = 8) -> DataFrame:
    """A13, A14 over PNG files (pair_id, source: binary, target: binary): pair_id, width, height, similarity, bands, changed_bands, error.

    Both are made smaller, put on one canvas and compared. A picture that is absent or broken gives its error and nulls. There is no
    shuffle; a worker opens one pair at a time, and is handed a few megabytes of files.
    """
    small_batches(pairs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                (a, wrong), (b, wrong_too) = (_opened(batch.column(side)[k].as_py()) for side in ("source", "target"))
                row = {"pair_id": batch.column("pair_id")[k].as_py(), "error": wrong and f"source: {wrong}" or wrong_too and f"target: {wrong_too}"}
                if row["error"] is None:
                    a, b = png.on_one_canvas(png.resized(a, width, longest), png.resized(b, width, longest), BESIDE)
                    row |= {"height": a.shape[0], "width": a.shape[1]} | compare_pixels(a, b, bands)
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    kind = pairs.schema["pair_id"].dataType.simpleString()
    out = f"pair_id {kind}, width int, height int, similarity double, bands array<double>, changed_bands int, error string"
    schema = _arrow(out)
    return pairs.select("pair_id", "source", "target").mapInArrow(run, out)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def hash_pictures(nodes: DataFrame, pictures: DataFrame) -> DataFrame:
    """S12, A15 over nodes (image_id, ord, x, y, w, h) and PNG files (image_id, png): image_id, ord, hash, icon, flat, error.

    The nodes of a picture, which are those of one page, come to it in one row, so each file is opened once. Nodes whose picture is absent or
    broken keep their row with the error; pictures without nodes give none. A worker is handed a few megabytes of files.
    """
    small_batches(pictures.sparkSession)
    boxes = F.array_sort(F.collect_list(F.struct("ord", *[F.col(c).cast("double").alias(c) for c in "xywh"])))
    rows = nodes.groupBy("image_id").agg(boxes.alias("boxes")).join(pictures.select("image_id", "png"), "image_id", "left")

    def run(batches):
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                picture, wrong = _opened(batch.column("png")[k].as_py())
                dark = None if picture is None else png.grey(picture)
                for n in batch.column("boxes")[k].as_py():
                    row = {"image_id": batch.column("image_id")[k].as_py(), "ord": n["ord"], "error": wrong}
                    found.append(row if dark is None else row | difference_hash(dark, n["x"], n["y"], n["w"], n["h"]))
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    kinds = {c: nodes.schema[c].dataType.simpleString() for c in ("image_id", "ord")}
    out = f"image_id {kinds['image_id']}, ord {kinds['ord']}, hash string, icon boolean, flat boolean, error string"
    schema = _arrow(out)
    return rows.mapInArrow(run, out)


def near_anchors(nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """Nodes (pair_id, ord, x, y) with the nearest anchor (pair_id, anchor, x, y, cx, cy) of their pair.

    ``px``, ``py`` is where the anchor's own shift puts the node; of equally near anchors the first counts.
    """
    a = anchors.select("pair_id", "anchor", *[F.col(c).alias(f"a{c}") for c in ("x", "y", "cx", "cy")])
    distance = F.hypot(F.col("ax") - F.col("x"), F.col("ay") - F.col("y"))
    fields = F.struct("anchor", (F.col("acx") + F.col("x") - F.col("ax")).alias("px"), (F.col("acy") + F.col("y") - F.col("ay")).alias("py"), distance.alias("d"))
    best = nodes.join(a, "pair_id").groupBy("pair_id", "ord").agg(F.min_by(fields, F.struct(distance, "anchor")).alias("best"))
    return best.select("pair_id", "ord", "best.anchor", "best.px", "best.py", F.col("best.d").alias("anchor_distance"))


def candidates(source: DataFrame, target: DataFrame, predicted: DataFrame) -> DataFrame:
    """Pairs of image nodes (pair_id, ord, x, y, hash: long) within HASH_MOST bits, and within the window of their place."""
    s = source.where("hash is not null").join(predicted, ["pair_id", "ord"], "left")
    s = s.select("pair_id", F.col("ord").alias("s"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("hash").alias("sh"), "px", "py", "anchor_distance")
    t = target.where("hash is not null").select("pair_id", F.col("ord").alias("t"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("hash").alias("th"))
    known = F.col("px").isNotNull()
    error = F.when(known, F.hypot(F.col("tx") - F.col("px"), F.col("ty") - F.col("py"))).otherwise(F.abs(F.col("sy") - F.col("ty")) + F.abs(F.col("sx") - F.col("tx")))
    window = F.greatest(F.lit(float(WINDOW_LEAST)), WINDOW_SHARE * F.col("anchor_distance"))
    met = s.join(t, "pair_id").withColumns({"bits": hamming(F.col("sh"), F.col("th")), "error": error})
    return met.where((F.col("bits") <= HASH_MOST) & (~known | (F.col("error") <= window))).select("pair_id", "s", "t", "bits", "error")


def _bits(a: int, b: int) -> int:
    return ((a ^ b) & ((1 << 64) - 1)).bit_count()


def match_images(source: DataFrame, target: DataFrame, anchors: DataFrame) -> DataFrame:
    """One-to-one matches, best first by (bits, error); then copies of a matched image take free copies of its match.

    Gives a row for each image node with a hash: side, ord, idx, matched, and the counterpart's place.
    """
    predicted = near_anchors(source.where("hash is not null"), anchors)
    found = candidates(source, target, predicted)
    nodes = (
        source.where("hash is not null").join(predicted, ["pair_id", "ord"], "left").withColumn("side", F.lit("s"))
        .unionByName(target.where("hash is not null").withColumns({"side": F.lit("t")}), allowMissingColumns=True)
    )

    def run(part: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        s = part[part["side"] == "s"].sort_values("ord").to_dict("records")
        t = part[part["side"] == "t"].sort_values("ord").to_dict("records")
        place_s, place_t = ({n["ord"]: k for k, n in enumerate(side)} for side in (s, t))
        pair: dict[int, int] = {}
        used: set[int] = set()
        for c in met.sort_values(["bits", "error", "s", "t"], kind="stable").itertuples():
            i, j = place_s[c.s], place_t[c.t]
            if i not in pair and j not in used:
                pair[i] = j
                used.add(j)
        for i, n in enumerate(s):
            if i in pair:
                continue
            sibling = next((k for k in range(len(s)) if k != i and k in pair and _bits(n["hash"], s[k]["hash"]) <= COPY_MOST), None)
            if sibling is None:
                continue
            like = t[pair[sibling]]["hash"]
            x, y = (n["x"], n["y"]) if pd.isna(n["px"]) else (n["px"], n["py"])
            free = [(math.hypot(m["x"] - x, m["y"] - y), j) for j, m in enumerate(t) if j not in used and _bits(m["hash"], like) <= COPY_MOST]
            if free:
                pair[i] = min(free)[1]
                used.add(pair[i])
        rows = []
        for i, n in enumerate(s):
            j = pair.get(i)
            rows.append((n["pair_id"], "source", n["ord"], f"i{i + 1}", j is not None, None if j is None else t[j]["ord"]))
            if j is not None:
                rows.append((n["pair_id"], "target", t[j]["ord"], f"i{i + 1}:0", True, n["ord"]))
        for k, j in enumerate(j for j in range(len(t)) if j not in used):
            rows.append((t[j]["pair_id"], "target", t[j]["ord"], f"i+{k + 1}", False, None))
        frame = pd.DataFrame(rows, columns=["pair_id", "side", "ord", "idx", "matched", "counterpart"])
        return frame.astype({"ord": "Int32", "counterpart": "Int32"})

    schema = "pair_id string, side string, ord int, idx string, matched boolean, counterpart int"
    columns = ["pair_id", "side", "ord", "x", "y", "hash", "px", "py"]
    found = found.select(*[F.col(c).alias(c) for c in found.columns])  # names of its own, for the two sides share tables
    nodes = nodes.select(*[F.col(c).alias(c) for c in columns])
    return spread(nodes, "pair_id").groupBy("pair_id").cogroup(spread(found, "pair_id").groupBy("pair_id")).applyInPandas(run, schema)


def labelled(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("label", text.file_name(F.col("src"), F.col("tag"), F.col("kind")))
