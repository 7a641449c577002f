"""Greedy non-maximum suppression as one aggregation: boxes of a frame (and class) fold into those kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators.assign import touching
from trackloom.functions.boxes import Box, iou

FRAME = ("video_id", "frame")


def _ranked(df: DataFrame, keys: tuple[str, ...], threshold: float) -> DataFrame:
    """Per group: ``boxes`` by falling confidence (equal ones by falling det_id) and ``kept``, those that survive.

    The group of a frame is what a detector gives for one image, which bounds it.
    """
    row = F.struct((-F.col("confidence")).alias("ns"), (-F.col("det_id")).alias("nd"), "det_id", "x1", "y1", "x2", "y2", *(c for c in ("confidence", "object_class", "is_confident") if c not in keys))
    grouped = df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("boxes"))
    overlaps = lambda k, b: iou(Box.of(k), Box.of(b)) > threshold
    step = lambda acc, b: F.when(F.exists(acc, lambda k: overlaps(k, b)), acc).otherwise(F.array_append(acc, b))
    return grouped.withColumn("kept", F.aggregate("boxes", F.filter("boxes", lambda b: F.lit(False)), step))


def suppress(df: DataFrame, threshold: float = 0.3, keys: tuple[str, ...] = (*FRAME, "object_class")) -> DataFrame:
    """Detections that survive; a box goes if it overlaps a better kept one of its group by more than the threshold.

    Filters on the keys are pushed below the aggregation. Without ``object_class`` among the keys classes compete.
    No rows give no rows; null confidences come last.
    """
    rest = [c for c in ("det_id", "x1", "y1", "x2", "y2", "confidence", "object_class", "is_confident") if c not in keys]
    return _ranked(df, keys, threshold).select(*keys, F.inline("kept")).select(*keys, *rest)


def contributions(df: DataFrame, threshold: float = 0.3, keys: tuple[str, ...] = (*FRAME, "object_class")) -> DataFrame:
    """``det_id`` of every box with ``kept_id``, the box that it is part of: itself, or the best one that suppressed it."""
    owner = lambda kept, b: F.element_at(F.filter(kept, lambda k: (k["det_id"] == b["det_id"]) | (iou(Box.of(k), Box.of(b)) > threshold)), 1)
    ranked = _ranked(df, keys, threshold)
    member = F.transform("boxes", lambda b: F.struct(b["det_id"].alias("det_id"), owner(F.col("kept"), b)["det_id"].alias("kept_id")))
    return ranked.select(*keys, F.inline(member))


def _shared(a: Box, b: Box) -> Column:
    """Area of the intersection."""
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)) * F.greatest(zero, F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))


def combine(df: DataFrame, threshold: float = 0.5, keys: tuple[str, ...] = (*FRAME, "object_class")) -> DataFrame:
    """Non-maximum merging: parts of one object that tiles cut become one box.

    By falling confidence (equal ones by falling det_id) a box joins the best box before it that it shares at least
    ``threshold`` of the smaller area with, and so that one's group; otherwise it starts a group. A group is the
    smallest box around its parts under the ``det_id`` of its best, with the best confidence and ``n_parts``. Without
    ``object_class`` among the keys classes merge, and the best part names the class. No rows give no rows.
    """
    rest = [c for c in ("object_class",) if c not in keys]
    row = F.struct((-F.col("confidence")).alias("ns"), (-F.col("det_id")).alias("nd"), "det_id", "x1", "y1", "x2", "y2", "confidence", "is_confident", *rest, F.col("det_id").alias("kept_id"))
    grouped = df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("boxes"))

    def meets(k: Column, b: Column) -> Column:
        a, c = Box.of(k), Box.of(b)
        inner = _shared(a, c)
        return (inner > 0) & (inner >= threshold * F.least(a.area(), c.area()))

    owner = lambda acc, b: F.coalesce(F.get(F.filter(acc, lambda k: meets(k, b)), F.lit(0))["kept_id"], b["det_id"])
    step = lambda acc, b: F.array_append(acc, b.withField("kept_id", owner(acc, b)))
    parts = grouped.select(*keys, F.inline(F.aggregate("boxes", F.filter("boxes", lambda b: F.lit(False)), step)))
    best = lambda c: F.min_by(c, F.struct("ns", "nd")).alias(c)
    hull = [F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")]
    made = parts.groupBy(*keys, "kept_id").agg(*hull, F.max("confidence").alias("confidence"), F.bool_or("is_confident").alias("is_confident"), F.count("*").alias("n_parts"), *(best(c) for c in rest))
    return made.withColumnRenamed("kept_id", "det_id")


def overlapping_pairs(df: DataFrame, threshold: float, keys: tuple[str, ...] = (*FRAME, "object_class"), grid: int = 16, extent: float = 1.0) -> DataFrame:
    """Pairs of boxes of one group that overlap by more than the threshold, 0 at least, each pair once, with their IoU.

    Boxes meet in the cells of a raster over ``extent`` (:func:`assign.touching`), so those apart are not compared.
    """
    if threshold < 0:
        raise ValueError("boxes that don't touch are no pair")
    overlap: Column = iou(Box.of("a."), Box.of("b."))
    met = touching(df, keys, grid, extent)
    return met.select(*keys, F.col("a.det_id").alias("det_a"), F.col("b.det_id").alias("det_b"), overlap.alias("iou")).where(F.col("iou") > threshold)


def placed(df: DataFrame) -> DataFrame:
    """Survivors with ``place``, from 0: their order in a frame by falling confidence, equal ones by class, then as they
    survived in it."""
    from pyspark.sql import Window

    order = Window.partitionBy(*FRAME).orderBy(F.desc("confidence"), "object_class", F.desc("det_id"))
    return df.withColumn("place", (F.row_number().over(order) - 1).cast("long"))


def renumber(df: DataFrame) -> DataFrame:
    """Detections numbered anew in each frame by falling confidence, the order in which trackers take them."""
    from pyspark.sql import Window

    order = Window.partitionBy(*FRAME).orderBy(F.desc("confidence"), "object_class", "det_id")
    return df.withColumn("det_id", (F.row_number().over(order) - 1).cast("long"))
