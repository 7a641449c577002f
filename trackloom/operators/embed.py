"""What stands in a box, as a vector: frames joined to boxes, patches cut and resized, a model run in each task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.operators.pixels import bilinear

KEYS = ("video_id", "frame")


def channel_last(image: np.ndarray) -> np.ndarray:
    """Channels behind rows and columns, where an image of at most four channels has them in front."""
    return np.moveaxis(image, 0, 2) if image.ndim == 3 and image.shape[0] <= 4 else image


def rgb(image: np.ndarray) -> np.ndarray:
    """Three channels of bytes, rows one after another: grey is repeated, further channels go, values are clipped."""
    if image.ndim == 2:
        image = image[:, :, None]
    image = np.repeat(image, 3, axis=2) if image.shape[2] == 1 else image[:, :, :3]
    return np.ascontiguousarray(image if image.dtype == np.uint8 else np.clip(image, 0, 255).astype(np.uint8))


def crop(image: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray | None:
    """The part of a box inside the image; None if there is none."""
    rows, columns = (slice(max(a, 0), max(a + n, 0)) for a, n in ((y, h), (x, w)))
    part = image[rows, columns]
    return part if part.size else None


def patch(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """A model's input: resized, between 0 and 1, channels first."""
    sized = np.stack([bilinear(image[:, :, c], height, width) for c in range(3)], axis=0)
    return (sized / 255).astype(np.float32)


def frame_at(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """``video_id, frame`` of all frames that the rows are in, with ``_at``: that frame, or the last one before it that there is."""
    asked, there = rows.select(*KEYS).distinct().withColumn("_there", F.lit(False)), frames.select(*KEYS).distinct().withColumn("_there", F.lit(True))
    both = asked.union(there).groupBy(*KEYS).agg(F.bool_or("_there").alias("_there"), F.bool_or(~F.col("_there")).alias("_asked"))
    last = F.last(F.when(F.col("_there"), F.col("frame")), ignorenulls=True).over(Window.partitionBy("video_id").orderBy("frame"))
    return both.withColumn("_at", last).where("_asked").select(*KEYS, "_at")


def frames_for(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """``rows`` with the ``width, height, pixels`` of their frame, or of the last frame before it that there is.

    Only keys are looked up: pixels meet the rows in one join on the frame found. Rows before a video's first frame
    get nulls; frames that come twice count once.
    """
    shown = frames.dropDuplicates(list(KEYS)).select("video_id", F.col("frame").alias("_at"), "width", "height", "pixels")
    return rows.join(frame_at(rows, frames), list(KEYS)).join(shown, ["video_id", "_at"], "left").drop("_at")


def embed(boxes: DataFrame, frames: DataFrame, open_model: Callable[[], Callable[[np.ndarray], np.ndarray]], height: int = 128, width: int = 128, batch_size: int = 32) -> DataFrame:
    """``boxes`` (``video_id, frame``, relative corners, and any others but pixels) with an ``embedding`` of what they show.

    ``open_model()`` runs once in a task and returns a function from a batch of patches to one vector each; a model
    of several outputs axes is flattened. Boxes without a frame, or that show nothing, get null. A task holds a batch
    of frames and ``batch_size`` patches.
    """
    columns = [c for c in boxes.columns if c != "embedding"]
    source = frames_for(boxes.select(*columns), frames)
    schema = T.StructType([*boxes.select(*columns).schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = open_model()
        for batch in batches:
            vectors: list = [None] * batch.num_rows
            waiting: list[tuple[int, np.ndarray]] = []

            def flush() -> None:
                if waiting:
                    made = model(np.stack([p for _, p in waiting]))  # noqa: B023
                    for (i, _), v in zip(waiting, made, strict=True):
                        vectors[i] = np.asarray(v, float).ravel().tolist()  # noqa: B023
                    waiting.clear()

            found = zip(*(batch.column(c).to_pylist() for c in ("x1", "y1", "x2", "y2", "width", "height", "pixels")), strict=True)
            for i, (x1, y1, x2, y2, w, h, data) in enumerate(found):
                if None in (x1, y1, x2, y2, w, h, data) or len(data) < w * h * 3:
                    continue
                image = np.frombuffer(data, np.uint8, w * h * 3).reshape(h, w, 3)
                part = crop(image, round(x1 * w), round(y1 * h), round((x2 - x1) * w), round((y2 - y1) * h))
                if part is not None:
                    waiting.append((i, patch(part, height, width)))
                if len(waiting) == batch_size:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(vectors, pa.list_(pa.float64()))], names=[*columns, "embedding"])

    return source.select(*columns, "width", "height", "pixels").mapInArrow(run, schema)
