"""Masks and redaction of raw frames: rows of pixels in, rows of pixels out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("gaussian", "pixelate", "blackout")


def gaussian(image: np.ndarray, strength: int) -> np.ndarray:
    """Blur with an odd kernel; sigma follows from its size, edges reflect."""
    k = max(1, strength) | 1
    sigma = 0.3 * ((k - 1) * 0.5 - 1) + 0.8
    weight = np.exp(-((np.arange(k) - k // 2) ** 2) / (2 * sigma * sigma))
    weight /= weight.sum()
    out = image.astype(float)
    for axis in (0, 1):
        n = out.shape[axis]
        at = np.abs(np.arange(-(k // 2), n + k // 2)) % max(2 * n - 2, 1)
        at = np.minimum(at, 2 * n - 2 - at) if n > 1 else at * 0
        padded = np.take(out, at, axis=axis)
        out = sum(w * (padded[i : i + n] if axis == 0 else padded[:, i : i + n]) for i, w in enumerate(weight))
    return np.rint(out).astype(np.uint8)


def pixelate(image: np.ndarray, strength: int) -> np.ndarray:
    """Shrink and enlarge again, nearest pixels."""
    for axis in (0, 1):
        n = image.shape[axis]
        small = max(1, n // max(1, strength))
        image = np.take(image, (np.arange(n) * small // n) * n // small, axis=axis)
    return image


def obscure(image: np.ndarray, kind: str, strength: int) -> np.ndarray:
    if kind == "gaussian":
        return gaussian(image, strength)
    return pixelate(image, strength) if kind == "pixelate" else np.zeros_like(image)


def check(kind: str, strength: int) -> str:
    """The kind in lower case; unknown kinds and strengths below 1 raise."""
    if kind.lower() not in KINDS or strength < 1:
        raise ValueError(f"no redaction {kind!r} of strength {strength}; there are {', '.join(KINDS)}")
    return kind.lower()


def polygon(points: list[tuple[float, float]], width: int, height: int) -> np.ndarray:
    """Pixels whose centre lies inside, by the even-odd rule."""
    x, y = np.meshgrid(np.arange(width) + 0.5, np.arange(height) + 0.5)
    inside = np.zeros((height, width), bool)
    for (ax, ay), (bx, by) in zip(points, [*points[1:], *points[:1]], strict=True):
        if ay != by:
            inside ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return inside


def bilinear(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Resize by the four nearest pixel centres."""
    out = image.astype(float)
    for axis, n in ((0, height), (1, width)):
        size = out.shape[axis]
        at = np.clip((np.arange(n) + 0.5) * size / n - 0.5, 0, size - 1)
        low = np.floor(at).astype(int)
        share = (at - low).reshape((-1, 1) if axis == 0 else (1, -1))
        out = np.take(out, low, axis=axis) * (1 - share) + np.take(out, np.minimum(low + 1, size - 1), axis=axis) * share
    return out


def prototype_mask(coefficients: np.ndarray, prototypes: np.ndarray, box: tuple[int, int, int, int], image: tuple[int, int], input_size: int) -> np.ndarray:
    """Mask of a box (x1, y1, x2, y2 in pixels of the image) from coefficients over prototypes of its letterboxed input."""
    height, width = image
    scale = min(input_size / width, input_size / height)
    plane = 1 / (1 + np.exp(-np.clip(np.tensordot(coefficients, prototypes, 1), -64, 64)))
    ph, pw = plane.shape
    used = plane[: max(1, round(ph * height * scale / input_size)), : max(1, round(pw * width * scale / input_size))]
    uh, uw = used.shape
    x1, y1, x2, y2 = box
    part = used[int(y1 * uh / height) : max(int(np.ceil(y2 * uh / height)), 1), int(x1 * uw / width) : max(int(np.ceil(x2 * uw / width)), 1)]
    return bilinear(part, y2 - y1, x2 - x1) > 0.5


def pack(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def unpack(bits: bytes, width: int, height: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=width * height).reshape(height, width).astype(bool)


REGION = "array<struct<x:int,y:int,w:int,h:int,points:array<struct<x:double,y:double>>,bits:binary>>"


def region_mask(regions: list | None, width: int, height: int) -> np.ndarray:
    """Union of rectangles, of polygons where a region has points, and of bitmaps where it has bits."""
    mask = np.zeros((height, width), bool)
    for r in regions or ():
        if r.get("bits") is not None:
            own = unpack(r["bits"], r["w"], r["h"])
            x, y = max(r["x"], 0), max(r["y"], 0)
            part = mask[y : max(r["y"] + r["h"], 0), x : max(r["x"] + r["w"], 0)]
            part |= own[y - r["y"] :, x - r["x"] :][: part.shape[0], : part.shape[1]]
        elif r.get("points"):
            mask |= polygon([(p["x"], p["y"]) for p in r["points"]], width, height)
        else:
            x, y = max(r["x"], 0), max(r["y"], 0)
            mask[y : max(r["y"] + r["h"], 0), x : max(r["x"] + r["w"], 0)] = True
    return mask


#: Frames that a task paints at a time.
PAINTED = 256


def gathered(regions: DataFrame, wanted: Column | None = None) -> DataFrame:
    """``video_id, frame, regions``: the regions of each frame in order of place, as :func:`redact` takes them. With
    ``wanted`` only such rows count, and a frame without any has an empty array."""
    points = "points" if "points" in regions.columns else F.lit(None).cast("array<struct<x:double,y:double>>").alias("points")
    bits = "bits" if "bits" in regions.columns else F.lit(None).cast("binary").alias("bits")
    row = F.struct(*(F.col(c).cast("int").alias(c) for c in "xywh"), points, bits)
    return regions.groupBy("video_id", "frame").agg(F.array_sort(F.collect_list(row if wanted is None else F.when(wanted, row)).cast(REGION)).alias("regions"))


def redact(frames: DataFrame, regions: DataFrame | None, kind: str = "gaussian", strength: int = 15, composite: bool = False) -> DataFrame:
    """Frames ``video_id, frame, width, height, pixels`` (RGB rows) with their regions obscured.

    ``regions`` has ``video_id, frame, x, y, w, h`` in pixels, and ``points`` for a polygon or ``bits`` for a mask
    (or null). Each rectangle is obscured by itself; with ``composite``, and for other shapes, the whole frame is obscured once and
    shows where any region lies. Regions are cut at the frame and
    taken in order of place; frames without any, or with null or short pixels, go
    through untouched. Regions gather by frame before the join, which moves pixels only where the regions are too
    large to broadcast. Frames that bring theirs in a column ``regions`` (:func:`gathered`) come with None in place of
    the table, and no pixels move. A frame is one row's work, and a task holds ``PAINTED`` of them beside a batch.
    """
    kind = check(kind, strength)
    source = frames.withColumnRenamed("regions", "_regions") if regions is None else frames.join(gathered(regions).withColumnRenamed("regions", "_regions"), ["video_id", "frame"], "left")
    columns = [c for c in frames.columns if regions is not None or c != "regions"]
    source = source.select(*columns, "_regions")
    schema = T.StructType([*source.select(*columns).schema.fields, T.StructField("redacted_pixels", T.LongType())])

    def paint(pixels: bytes | None, width: int, height: int, found: list | None) -> tuple[bytes | None, int]:
        if not found or pixels is None or len(pixels) < width * height * 3:
            return pixels, 0
        image = np.frombuffer(pixels, np.uint8).reshape(height, width, 3).copy()
        mask = region_mask(found, width, height)
        if composite or any(r["points"] or r["bits"] is not None for r in found):
            image[mask] = obscure(image, kind, strength)[mask]
        else:
            for r in found:
                y, x = slice(max(r["y"], 0), max(r["y"] + r["h"], 0)), slice(max(r["x"], 0), max(r["x"] + r["w"], 0))
                if image[y, x].size:
                    image[y, x] = obscure(image[y, x], kind, strength)
        return image.tobytes(), int(mask.sum())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in (whole.slice(at, PAINTED) for whole in batches for at in range(0, whole.num_rows, PAINTED)):
            got = [paint(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("pixels", "width", "height", "_regions")), strict=True)]
            rest = [pa.array([g[0] for g in got], pa.binary()) if c == "pixels" else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([g[1] for g in got], pa.int64())], names=[*columns, "redacted_pixels"])

    return source.mapInArrow(run, schema)


MASK = "video_id long, frame long, det_id long, x int, y int, w int, h int, bits binary"


PLANES = ("video_id", "frame", "tile_id")


def store_planes(prototypes: DataFrame, table: str, buckets: int = 64) -> DataFrame:
    """Prototypes as a table in buckets of their keys, one file each, in place of what it held; the table.

    Boxes that are decoded with it (:func:`decode_masks`) move to the buckets, and planes don't move again. That needs keys
    of the table's types. Of repeated keys the first in order of data stays. ``buckets`` says how many tasks decode.
    """
    rest = [c for c in prototypes.columns if c not in PLANES]
    once = prototypes.repartition(buckets, *PLANES).groupBy(*PLANES).agg(F.min_by(F.struct(*rest), "data").alias("p")).select(*PLANES, "p.*")
    once.write.mode("overwrite").bucketBy(buckets, *PLANES).sortBy(*PLANES).saveAsTable(table)
    return prototypes.sparkSession.table(table)


def decode_masks(boxes: DataFrame, prototypes: DataFrame, input_size: int) -> DataFrame:
    """Masks of boxes ``video_id, frame, tile_id, det_id, x1, y1, x2, y2`` (pixels) with ``coefficients``.

    ``prototypes`` has ``video_id, frame, tile_id, width, height`` of the image and ``data``, float16 planes of
    ``planes, plane_height, plane_width``. Of repeated keys the first in order of data counts. Boxes meet the planes
    of their tile as groups, so the planes travel once however many boxes they have, and not at all where
    :func:`store_planes` made the table; boxes without planes or pixels give no mask.
    """
    import pyarrow as pa

    keys = PLANES
    names = [f.split(" ")[0] for f in MASK.split(", ")]
    kinds = [pa.int64()] * 3 + [pa.int32()] * 4 + [pa.binary()]

    def decode(left, right):
        out = []
        if left.num_rows and right.num_rows:
            p = min(right.to_pylist(), key=lambda r: r["data"])
            planes = np.frombuffer(p["data"], np.float16).astype(float).reshape(p["planes"], p["plane_height"], p["plane_width"])
            for r in left.to_pylist():
                x1, y1, x2, y2 = (int(min(max(r[c], 0), p["width" if c[0] == "x" else "height"])) for c in ("x1", "y1", "x2", "y2"))
                if x2 > x1 and y2 > y1:
                    mask = prototype_mask(np.array(r["coefficients"], float), planes, (x1, y1, x2, y2), (p["height"], p["width"]), input_size)
                    out.append((r["video_id"], r["frame"], r["det_id"], x1, y1, x2 - x1, y2 - y1, pack(mask)))
        cols = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return boxes.groupBy(*keys).cogroup(prototypes.groupBy(*keys)).applyInArrow(decode, MASK)


def fuse_masks(masks: DataFrame, contributions: DataFrame) -> DataFrame:
    """Masks of kept boxes: each joined with those of the boxes that it suppressed (``nms.contributions``)."""
    import pyarrow as pa

    def join(rows):
        found = rows.to_pylist()
        x, y = min(r["x"] for r in found), min(r["y"] for r in found)
        w, h = max(r["x"] + r["w"] for r in found) - x, max(r["y"] + r["h"] for r in found) - y
        mask = region_mask([r | {"x": r["x"] - x, "y": r["y"] - y} for r in found], w, h)
        r = found[0]
        row = {"video_id": r["video_id"], "frame": r["frame"], "det_id": r["kept_id"], "x": x, "y": y, "w": w, "h": h, "bits": pack(mask)}
        kinds = [pa.int64()] * 3 + [pa.int32()] * 4 + [pa.binary()]
        return pa.table([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))

    owned = masks.join(contributions.select("video_id", "frame", "det_id", "kept_id"), ["video_id", "frame", "det_id"])
    return owned.groupBy("video_id", "frame", "kept_id").applyInArrow(join, MASK)


def mask_area(boxes: DataFrame, grid: int) -> DataFrame:
    """Cells of a ``grid`` x ``grid`` raster that the boxes of a frame cover together.

    A box gives one row for each raster row that it touches, its columns as bits; bits of a raster row are joined
    before the shuffle, so no row for a cell exists.
    """
    first = lambda c: F.floor(F.col(c) * grid).cast("int")
    last = lambda a, b: F.greatest(first(a), (F.ceil(F.col(b) * grid) - 1).cast("int"))
    rows = boxes.select("video_id", "frame", first("x1").alias("a"), last("x1", "x2").alias("b"), F.explode(F.sequence(first("y1"), last("y1", "y2"))).alias("cy"))
    words = {}
    for k in range(-(-(grid + 1) // 62)):  # a box that begins on the far edge touches one column more
        low, high = F.greatest(F.col("a"), F.lit(62 * k)) - 62 * k, F.least(F.col("b"), F.lit(62 * k + 61)) - 62 * k
        bits = F.call_function("shiftleft", F.call_function("shiftleft", F.lit(1).cast("long"), high - low + 1) - 1, low)
        words[f"w{k}"] = F.when(high >= low, bits).otherwise(F.lit(0))
    joined = rows.groupBy("video_id", "frame", "cy").agg(*(F.bit_or(v).alias(k) for k, v in words.items()))
    cells = sum((F.bit_count(k) for k in words), F.lit(0))
    return joined.groupBy("video_id", "frame").agg(F.sum(cells).cast("long").alias("cells"))
