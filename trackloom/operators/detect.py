"""From raw candidates to detections: class choice, score filter, geometry, suppression; and the tile grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import boxes as B
from trackloom.functions.boxes import Box

from . import nms


def decode(candidates: DataFrame, n_classes: int, low: float = 0.1, high: float = 0.5) -> DataFrame:
    """Candidates ``video_id, frame, det_id, cx, cy, w, h, scores`` with their tile's ``pad_x, pad_y, scale_x,
    scale_y, tile_width, tile_height, offset_x, offset_y, frame_width, frame_height`` become relative boxes.

    Scores below ``low`` go before any geometry; boxes without area after clipping go last.
    """
    label, score = B.best_class(F.col("scores"), n_classes)
    scored = candidates.withColumns({"object_class": label, "confidence": score}).where(F.col("confidence") >= low)
    local = B.unletterbox(Box.centred("cx", "cy", "w", "h"), "pad_x", "pad_y", "scale_x", "scale_y", "tile_width", "tile_height")
    whole = B.shift(local, "offset_x", "offset_y", "frame_width", "frame_height")
    put = scored.withColumns(whole.columns()).where("x2 > x1 AND y2 > y1")
    return put.withColumns({**B.relative(Box.of(), "frame_width", "frame_height").columns(), "is_confident": F.col("confidence") >= high}).select(
        "video_id", "frame", "det_id", *("x1", "y1", "x2", "y2"), "confidence", "object_class", "is_confident", "frame_width", "frame_height"
    )


def postprocess(candidates: DataFrame, n_classes: int, classes: list[int] | None = None, low: float = 0.1, high: float = 0.5, overlap: float = 0.3) -> DataFrame:
    """:func:`decode`, then the class filter, then suppression by class.

    Suppression is by class, so the filter gives the same rows before it, and reaches the scan from there.
    """
    found = decode(candidates, n_classes, low, high)
    if classes is not None:
        found = found.where(F.col("object_class").isin(classes))
    return nms.suppress(found, overlap)


def allowed_classes(wanted: list[str] | None, names: list[str]) -> list[int] | None:
    """Class ids of names (any case) or numbers; ``None``, an empty list or ``*`` allows all, unknown names none."""
    if not wanted or "*" in wanted:
        return None
    known = {n.strip().lower(): i for i, n in enumerate(names)}
    tidy = [str(w).strip().lower() for w in wanted]
    return sorted({known[w] for w in tidy if w in known} | {int(w) for w in tidy if w.isdigit() and int(w) < len(names)})


def _starts(length: Column, size: int, step: int) -> Column:
    """Tile starts along an edge; the last tile moves back inside."""
    full = F.sequence(F.lit(0), F.greatest(F.ceil((length - size) / step), F.lit(0)).cast("int"))
    return F.array_distinct(F.transform(full, lambda i: F.greatest(F.least(i * step, length - size), F.lit(0))))


def tile_grid(width: Column, height: Column, size: int, overlap: float) -> Column:
    """``offset_x, offset_y`` of all tiles of an image, row by row."""
    step = max(1, size - int(size * overlap))
    xs, ys = _starts(width, size, step), _starts(height, size, step)
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(x.alias("offset_x"), y.alias("offset_y")))))


def tiles(images: DataFrame, size: int = 640, overlap: float = 0.2) -> DataFrame:
    """Tiles ``tile_id, offset_x, offset_y, tile_width, tile_height`` of images with ``frame_width, frame_height``.

    Neighbours overlap by a share of the size; an image smaller than a tile is one tile.
    """
    grid = tile_grid(F.col("frame_width"), F.col("frame_height"), size, overlap)
    cut = images.select("*", F.posexplode(grid).alias("tile_id", "tile")).select("*", "tile.*").drop("tile")
    return cut.withColumns({"tile_width": F.least(F.lit(size), F.col("frame_width")), "tile_height": F.least(F.lit(size), F.col("frame_height"))})


def paired(dets: DataFrame, shifts: Column, shapes: Column, width: Column, height: Column) -> DataFrame:
    """Detections with ``shift_x, shift_y, full_height, full_width`` of their frame: the n-th present frame of a video takes
    the n-th entry of the arrays ``shifts`` (x, y) and ``shapes`` (height, width).

    The arrays may be literals or columns, the same in all rows of a frame; they are made once a frame. Where ``shapes`` has
    no n-th entry, or is null, the size is ``height`` and ``width``; a missing shift, and any entry that doesn't have two
    numbers or is null, gives zeros.
    """
    order = Window.partitionBy("video_id").orderBy("frame")
    nth = F.dense_rank().over(order) - 1
    placed = dets.withColumns({"_nth": nth, "_fresh": ~F.col("frame").eqNullSafe(F.lag("frame").over(order)) | (F.row_number().over(order) == 1)})

    def entry(of: Column, name: str) -> Column:
        # inside a lambda the array is made once
        return F.transform(F.array(of), lambda v: F.struct(F.get(v, F.col("_nth")).alias("at"), F.coalesce(F.col("_nth") >= F.size(v), F.lit(True)).alias("beyond"), v.isNull().alias("none")))[0].alias(name)

    made = F.when(F.col("_fresh"), F.struct(entry(shifts, "shift"), entry(shapes, "shape")))
    spread = F.first("_made", ignorenulls=True).over(Window.partitionBy("video_id", "frame"))
    placed = placed.withColumn("_made", made).withColumn("_made", spread)

    def part(of: str, k: int) -> Column:
        found = F.col(f"_made.{of}.at")
        return F.coalesce(F.when(F.size(found) == 2, F.get(found, F.lit(k))), F.lit(0)).cast("long")

    beyond = F.col("_made.shape.beyond") | F.col("_made.shape.none")
    full = {name: F.when(beyond, own.cast("long")).otherwise(part("shape", k)) for k, (name, own) in enumerate({"full_height": height, "full_width": width}.items())}
    return placed.withColumns({"shift_x": part("shift", 0), "shift_y": part("shift", 1), **full}).drop("_nth", "_fresh", "_made")
