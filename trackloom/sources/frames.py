"""Frames as rows: uncompressed video and images in, video segments and image files out."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.sources import video
from trackloom.sources.video import FRAME


def read_videos(
    spark: SparkSession, path: str, pixels: bool = True, frames: Sequence[int] | None = None, batch_size: int = 16, span_bytes: int = 64 << 20, first: int | None = None, last: int | None = None
) -> DataFrame:
    """Frames of YUV4MPEG2 files; ``video_id`` is the hash of a file's path. Without pixels only first lines are read.

    ``frames`` names those to read, ``first`` and ``last`` bound them: no other bytes are read, ranges of a file without any
    have no task, and numbers that a video lacks give no rows. Frames leave a task ``batch_size`` at a time, the last ones in
    a smaller batch. A file is split into tasks every ``span_bytes``; one with parameters on its frames, or cut off, is one.
    """
    if batch_size < 1:
        raise ValueError("a batch holds at least one frame")
    video.register(spark)
    asked = {"batchSize": batch_size, "spanBytes": span_bytes, "first": first, "last": last, "frames": None if frames is None else json.dumps([int(n) for n in frames])}
    columns = FRAME if pixels else FRAME.removesuffix(", pixels binary")
    found = spark.read.format("y4m").options(**{k: v for k, v in asked.items() if v is not None}).schema(columns).load(path)
    return found if pixels else found.withColumn("pixels", F.lit(None).cast("binary"))


#: Suffixes of image files; anything else is read as video.
IMAGES = (".jpg", ".jpeg", ".png", ".bmp", ".webp")


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """Frames of a path: images by suffix, otherwise video. A path that isn't there raises."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        raise FileNotFoundError(path)
    return read_images(spark, path) if path.lower().endswith(IMAGES) else read_videos(spark, path)


def png(pixels: bytes, width: int, height: int) -> bytes:
    """An RGB image as a PNG file."""
    chunk = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
    head = width.to_bytes(4, "big") + height.to_bytes(4, "big") + bytes([8, 2, 0, 0, 0])
    lines = b"".join(b"\0" + pixels[y * width * 3 : (y + 1) * width * 3] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def images(frames: DataFrame) -> DataFrame:
    """``video_id, frame, content``: each frame as a PNG file; null where there are no pixels."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = zip(*(batch.column(c).to_pylist() for c in ("pixels", "width", "height")), strict=True)
            made = [None if p is None else png(p, w, h) for p, w, h in found]
            yield pa.RecordBatch.from_arrays([batch.column("video_id"), batch.column("frame"), pa.array(made, pa.binary())], names=["video_id", "frame", "content"])

    return frames.select("video_id", "frame", "width", "height", "pixels").mapInArrow(run, "video_id long, frame long, content binary")


def describe(frames: DataFrame) -> DataFrame:
    """Size, frames, rate and length of each video."""
    made = frames.groupBy("video_id").agg(F.max("width").alias("width"), F.max("height").alias("height"), (F.max("frame") + 1).alias("frame_count"), F.max("pts").alias("_last"))
    rate = F.when(F.col("_last") > 0, (F.col("frame_count") - 1) / F.col("_last"))
    return made.withColumns({"fps": rate, "duration": F.col("frame_count") / rate}).drop("_last")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files as frame 0 of a video each; Spark decodes them. Unreadable files are left out."""
    images = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*").where("nChannels IN (1, 3, 4)")
    source = images.select(F.xxhash64("origin").alias("video_id"), "width", "height", "nChannels", "data")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for w, h, n, data in zip(*(batch.column(c).to_pylist() for c in ("width", "height", "nChannels", "data")), strict=True):
                image = np.frombuffer(data, np.uint8).reshape(h, w, n)
                out.append((image[:, :, [0, 0, 0]] if n == 1 else image[:, :, 2::-1]).tobytes())  # stored blue first
            zero = [0] * batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("video_id"), pa.array(zero, pa.int64()), pa.array(zero, pa.float64()), batch.column("width"), batch.column("height"), pa.array(out, pa.binary())], names=["video_id", "frame", "pts", "width", "height", "pixels"])

    return source.mapInArrow(run, FRAME)


def segments(frames: DataFrame, length: int = 300, rate: int = 25) -> DataFrame:
    """``video_id, segment, content``: each run of ``length`` frames as a YUV4MPEG2 (4:4:4) stream.

    The sink of redacted frames: a segment, not a video, is the unit that one task holds.
    """

    def encode(rows):
        import pyarrow as pa

        rows = rows.sort_by("frame")
        w, h = rows.column("width")[0].as_py(), rows.column("height")[0].as_py()
        parts = [f"YUV4MPEG2 W{w} H{h} F{rate}:1 Ip A1:1 C444\n".encode()]
        for data in rows.column("pixels").to_pylist():
            r, g, b = np.moveaxis(np.frombuffer(data, np.uint8).reshape(h, w, 3).astype(float), 2, 0)
            y = 0.299 * r + 0.587 * g + 0.114 * b
            planes = (16 + y * 219 / 255, 128 + (b - y) / 1.772 * 224 / 255, 128 + (r - y) / 1.402 * 224 / 255)
            parts += [b"FRAME\n", *(np.clip(np.rint(p), 0, 255).astype(np.uint8).tobytes() for p in planes)]
        return pa.table({"video_id": rows.column("video_id")[:1], "segment": rows.column("segment")[:1], "content": pa.array([b"".join(parts)], pa.binary())})

    cut = frames.select("video_id", F.floor(F.col("frame") / length).alias("segment"), "frame", "width", "height", "pixels")
    return cut.groupBy("video_id", "segment").applyInArrow(encode, "video_id long, segment long, content binary")


def write_segments(frames: DataFrame, path: str, length: int = 300, rate: int = 25, batch: str | None = None) -> None:
    """Frames as video files ``video-segment.y4m`` below a path, whole ones or none (see :class:`video.FileSink`)."""
    _write(segments(frames, length, rate), path, "{video_id}-{segment:06d}.y4m", batch)


def write_images(frames: DataFrame, path: str, batch: str | None = None) -> None:
    """Frames as PNG files ``video/frame.png`` below a path; those without pixels give none."""
    _write(images(frames), path, "{video_id}/{frame:08d}.png", batch)


def _write(rows: DataFrame, path: str, name: str, batch: str | None) -> None:
    video.register(rows.sparkSession)
    out = rows.write.format("named_files").option("name", name).mode("append")
    (out if batch is None else out.option("batch", batch)).save(path)
