"""Masks as runs of raster rows: ``y, start, stop`` (the columns from ``start`` up to, not including, ``stop``).

A mask is any number of rows under its keys; they may overlap until :func:`combine` puts them in order. Set operations are
one sweep over the ends of runs in windows of a raster row, so no mask is ever one value, and no pair of runs is formed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("video_id", "frame", "det_id")
ROW = ("y", "start", "stop")
#: Crossings of polygons with raster rows that a task works out at once, or those of one mask.
CROSSINGS = 1 << 20


def of_boxes(boxes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Runs of pixel rectangles ``x, y, w, h``: one for each raster row. Empty and null ones have none."""
    solid = boxes.where("w > 0 AND h > 0 AND x IS NOT NULL AND y IS NOT NULL")
    start, stop = F.col("x").cast("long"), F.col("x").cast("long") + F.col("w")
    return solid.select(*keys, F.explode(F.sequence(F.col("y").cast("long"), F.col("y").cast("long") + F.col("h") - 1)).alias("y"), start.alias("start"), stop.alias("stop"))


def of_polygons(shapes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Runs of polygons ``points`` (array of ``x, y``): pixels whose centre lies inside, by the even-odd rule.

    Each edge crosses the raster rows between its ends; the crossings of a row, sorted, are where runs begin and end in turn.
    The polygons of a key are one mask and one row, so they are dealt once by their keys and crossings stay where they are.
    Fewer than three points, or null ones, cover nothing.
    """
    corners = shapes.where(F.size("points") > 2).select(*keys, F.col("points").alias("p"))
    whole = corners.groupBy(*keys).agg(F.collect_list("p").alias("p"))
    schema = shapes.select(*keys).schema.add("y", "long").add("start", "long").add("stop", "long")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            masks = batch.column("p")
            polygons = masks.flatten()
            points, ends = polygons.flatten(), np.cumsum(np.r_[0, polygons.value_lengths().to_numpy()])
            x, y = (points.flatten()[i].to_numpy(zero_copy_only=False).astype(float) for i in (points.type.get_field_index("x"), points.type.get_field_index("y")))
            mask = np.repeat(np.arange(len(masks)), masks.value_lengths().to_numpy())
            for own, found in _crossed(np.repeat(mask, np.diff(ends)), x, y, ends):
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(own)) for k in keys), *map(pa.array, found)], names=[*keys, *ROW])

    return whole.mapInArrow(run, schema)


def _crossed(mask: np.ndarray, x: np.ndarray, y: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, tuple]]:
    """Masks and ``y, start, stop`` of the runs of polygons; ``ends`` are where the corners of each begin and end."""
    ahead = np.arange(1, len(x) + 1)
    ahead[ends[1:] - 1] = ends[:-1]
    by = y[ahead]
    # rows whose centre line lies between the ends, the lower one counted; none where an end is missing
    low, high = (np.nan_to_num(np.ceil(end(y, by) - 0.5)).astype(np.int64) for end in (np.minimum, np.maximum))
    crossings = high - low
    edges = np.flatnonzero(crossings > 0)
    part = np.cumsum(np.bincount(mask, crossings, minlength=1)).astype(np.int64) // CROSSINGS
    for some in np.split(edges, np.flatnonzero(np.diff(part[mask[edges]])) + 1) if len(edges) else ():
        n = crossings[some]
        e = np.repeat(some, n)
        row = low[e] + np.arange(len(e)) - np.repeat(np.cumsum(n) - n, n)
        at = (x[ahead[e]] - x[e]) * (row + 0.5 - y[e]) / (by[e] - y[e]) + x[e]
        known = ~np.isnan(at)
        # the first column whose centre isn't left of the crossing
        column = np.ceil(np.where(known, at, 0) - 0.5).astype(np.int64)
        order = np.lexsort((column, np.where(known, at, -np.inf), row, mask[e]))
        own, row, column, known = mask[e][order], row[order], column[order], known[order]
        begin = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (row[1:] != row[:-1])])
        place = np.arange(len(own)) - np.repeat(begin, np.diff(np.r_[begin, len(own)]))
        inner = np.flatnonzero((place[:-1] % 2 == 0) & (place[1:] == place[:-1] + 1) & known[:-1] & known[1:] & (column[1:] > column[:-1]))
        yield own[inner], (row[inner], column[inner], column[inner + 1])


def of_bits(masks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Runs of bitmaps ``x, y, w, h, bits`` (rows of bits, packed; ``pixels.pack``). A task reads one mask at a time."""
    schema = masks.select(*keys).schema.add("y", "long").add("start", "long").add("stop", "long")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            owner, rows = [], []
            for i, (x, y, w, h, bits) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("x", "y", "w", "h", "bits")), strict=True)):
                if bits is None or not w or not h:
                    continue
                mask = np.unpackbits(np.frombuffer(bits, np.uint8), count=w * h).reshape(h, w)
                turn = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
                (at, start), (_, stop) = np.nonzero(turn == 1), np.nonzero(turn == -1)
                rows.append(np.stack([at + y, start + x, stop + x]))
                owner.append(np.full(len(at), i))
            if rows:
                own, found = pa.array(np.concatenate(owner)), np.concatenate(rows, axis=1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(own) for k in keys), *map(pa.array, found)], names=[*keys, *ROW])

    return masks.select(*keys, "x", "y", "w", "h", "bits").mapInArrow(run, schema)


def _swept(sides: Sequence[DataFrame], keys: Sequence[str], inside: Column) -> DataFrame:
    """Maximal runs where ``inside`` holds; it tells from the counts ``n0, n1, ...`` how many runs of each side lie over a column."""
    ends = None
    for i, side in enumerate(sides):
        add = [F.lit(k == i).cast("int").alias(f"d{k}") for k in range(len(sides))]
        both = F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("stop").alias("at"), F.lit(-1).alias("d")))).alias("e")
        own = side.where("stop > start").select(*keys, "y", both, *add).select(*keys, "y", "e.at", *((F.col("e.d") * F.col(f"d{k}")).alias(f"d{k}") for k in range(len(sides))))
        ends = own if ends is None else ends.unionByName(own)
    place = [*keys, "y"]
    # all that happens at a column counts at once, so adjoining runs are one
    events = ends.groupBy(*place, "at").agg(*(F.sum(f"d{k}").alias(f"d{k}") for k in range(len(sides))))
    order = Window.partitionBy(*place).orderBy("at")
    counted = events.withColumns({f"n{k}": F.sum(f"d{k}").over(order) for k in range(len(sides))})
    turned = counted.withColumn("on", inside).withColumn("was", F.coalesce(F.lag("on").over(order), F.lit(False))).where("on <> was")
    return turned.withColumn("stop", F.lead("at").over(order)).where("on").select(*place, F.col("at").alias("start"), "stop")


def combine(runs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The union of all runs under a key: apart from each other, none empty."""
    return _swept([runs], keys, F.col("n0") > 0)


def intersect(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """What both masks of a key cover."""
    return _swept([a, b], keys, (F.col("n0") > 0) & (F.col("n1") > 0))


def subtract(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """What the first mask of a key covers and the second doesn't."""
    return _swept([a, b], keys, (F.col("n0") > 0) & (F.col("n1") == 0))


def clip(runs: DataFrame, width: Column | int, height: Column | int) -> DataFrame:
    """Runs cut at a picture."""
    cut = runs.withColumns({"start": F.greatest("start", F.lit(0)), "stop": F.least("stop", F.lit(width) if isinstance(width, int) else width)})
    return cut.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("stop") > F.col("start")))


def measure(combined: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``area``, the tight bounds ``x, y, w, h`` and the ``mask_id`` of combined masks.

    The id is a digest of the runs in order, so equal masks have equal ids wherever they lie; see :func:`keyed`. A mask's
    runs meet in one row there: as many as its picture has rows, times the gaps in them.
    """
    runs = F.array_sort(F.collect_list(F.struct(*ROW)))
    text = F.array_join(F.transform(runs, lambda r: F.concat_ws(":", *(r[c] for c in ROW))), ",")
    x, y = F.min("start"), F.min("y")
    return combined.groupBy(*keys).agg(
        F.sum(F.col("stop") - F.col("start")).alias("area"), x.alias("x"), y.alias("y"), (F.max("stop") - x).alias("w"), (F.max("y") + 1 - y).alias("h"), F.md5(text).alias("mask_id")
    )


def keyed(combined: DataFrame, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """``keys, mask_id`` of each mask, and the runs of each different mask once, under its ``mask_id``."""
    named = measure(combined, keys).select(*keys, "mask_id")
    once = named.groupBy("mask_id").agg(F.min(F.struct(*keys)).alias("k")).select("mask_id", "k.*")
    return named, combined.join(once, list(keys)).select("mask_id", *ROW)


def overlap(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``keys, area_a, area_b, area_both, iou`` of two masks of a key; a side without a mask has area 0."""
    area = lambda df, name: df.groupBy(*keys).agg(F.sum(F.col("stop") - F.col("start")).alias(name))
    one, two, both = area(combine(a, keys), "area_a"), area(combine(b, keys), "area_b"), area(intersect(a, b, keys), "area_both")
    met = one.join(two, list(keys), "full").join(both, list(keys), "left").fillna(0, ["area_a", "area_b", "area_both"])
    return met.withColumn("iou", F.col("area_both") / (F.col("area_a") + F.col("area_b") - F.col("area_both")))


def fused(runs: DataFrame, contributions: DataFrame) -> DataFrame:
    """Masks of kept boxes as runs: each joined with those of the boxes that it suppressed (``nms.contributions``)."""
    owned = runs.join(contributions.select("video_id", "frame", "det_id", "kept_id"), list(KEYS))
    return combine(owned.select("video_id", "frame", F.col("kept_id").alias("det_id"), *ROW))


def crop(frames: DataFrame, regions: DataFrame) -> DataFrame:
    """``pixels`` of regions ``x, y, w, h`` of frames ``width, height, pixels`` (RGB rows), cut at the frame, as rows of the regions.

    Rows of pixels are substrings, put together on the JVM. Regions outside the frame, and frames without pixels or with
    too few, give no row.
    """
    return cut(regions.join(frames.select("video_id", "frame", "width", "height", "pixels"), ["video_id", "frame"]))


def cut(met: DataFrame, source: str | Column = "pixels", digits: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """As :func:`crop`, of regions that have the ``width, height, pixels`` of their frame beside them.

    Where pixels follow from something smaller, that is ``source``, and ``digits(source, y)`` gives a raster row in hexadecimal
    from it: then only rows of regions are made, never a whole frame, and no filter asks for one.
    """
    x, y = F.greatest("x", F.lit(0)), F.greatest("y", F.lit(0))
    inner = {"_x": x, "_y": y, "w": F.least(F.col("x") + F.col("w"), "width") - x, "h": F.least(F.col("y") + F.col("h"), "height") - y}
    whole = "" if digits else " AND length(pixels) >= width * height * 3"
    met = met.withColumns(inner).where("w > 0 AND h > 0" + whole).withColumns({"x": F.col("_x"), "y": F.col("_y")}).drop("_x", "_y")
    x, y, w, h, width = (F.col(c).cast("int") for c in ("x", "y", "w", "h", "width"))
    stored = lambda at, r: F.hex(F.substring(at, (3 * (r * width + x) + 1).cast("int"), 3 * w))
    line = (lambda at, r: F.substring(digits(at, r), 6 * x + 1, 6 * w)) if digits else stored
    # inside a lambda the source is worked out once, not again for each row
    made = F.transform(F.array(source), lambda at: F.array_join(F.transform(F.sequence(y, y + h - 1), lambda r: line(at, r)), ""))[0]
    return met.withColumn("pixels", F.unhex(made)).drop("width", "height")
