"""Detections, jobs and vectors read from warehouse tables: a deterministic view of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.functions.boxes import Box


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str, low: float = 0.1, high: float = 0.5) -> DataFrame:
    """``lineitem`` as detections: a supplier is a video, a month a frame, a line a box.

    ``det_id`` numbers the boxes of a frame, so no window spans a whole video.
    """
    line = table(spark, sf_dir, "lineitem")
    order = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_shipdate")
    raw = line.where(F.col("l_quantity") / 50 >= low).select(F.col("l_suppkey").alias("video_id"), ((F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate") - 1).cast("long").alias("frame"), *order)
    # only what the numbers follow from is dealt; all else is made of it where it lies
    numbered = raw.withColumn("det_id", (F.row_number().over(Window.partitionBy("video_id", "frame").orderBy(*order)) - 1).cast("long")).select(
        "video_id",
        "frame",
        "det_id",
        (((F.col("l_partkey") * 37) % 17).cast("double") / 16 * 0.8 + 0.1).alias("cx"),
        (((F.col("l_partkey") * 11) % 13).cast("double") / 12 * 0.8 + 0.1).alias("cy"),
        (0.1 + 0.02 * F.col("l_linenumber").cast("double")).alias("w"),
        (0.05 + 0.002 * F.col("l_quantity")).alias("h"),
        (F.col("l_quantity") / 50).alias("confidence"),
        (F.col("l_linenumber") % 5).cast("long").alias("object_class"),
    )
    box = Box.centred("cx", "cy", "w", "h")
    return numbered.select(
        "video_id",
        "frame",
        "det_id",
        F.greatest(F.lit(0.0), box.x1).alias("x1"),
        F.greatest(F.lit(0.0), box.y1).alias("y1"),
        F.least(F.lit(1.0), box.x2).alias("x2"),
        F.least(F.lit(1.0), box.y2).alias("y2"),
        "confidence",
        "object_class",
        (F.col("confidence") >= high).alias("is_confident"),
    )


#: The same view for SQL.
DETECTIONS_SQL = """det AS (
  SELECT video_id, frame, CAST(row_number() OVER (PARTITION BY video_id, frame ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS BIGINT) AS det_id,
    greatest(0e0, cx - w / 2e0) AS x1, greatest(0e0, cy - h / 2e0) AS y1, least(1e0, cx + w / 2e0) AS x2, least(1e0, cy + h / 2e0) AS y2,
    confidence, object_class, confidence >= 0.5e0 AS is_confident
  FROM (SELECT l_suppkey AS video_id, CAST((year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1 AS BIGINT) AS frame,
      l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_shipdate,
      CAST((l_partkey * 37) % 17 AS DOUBLE) / 16e0 * 0.8e0 + 0.1e0 AS cx, CAST((l_partkey * 11) % 13 AS DOUBLE) / 12e0 * 0.8e0 + 0.1e0 AS cy,
      0.1e0 + 0.02e0 * CAST(l_linenumber AS DOUBLE) AS w, 0.05e0 + 0.002e0 * l_quantity AS h,
      l_quantity / 50e0 AS confidence, CAST(l_linenumber % 5 AS BIGINT) AS object_class
    FROM lineitem WHERE l_quantity / 50e0 >= 0.1e0))"""


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as progress reports: a user is a job, ``props.k`` its progress."""
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("job_id"),
        F.row_number().over(order).cast("long").alias("sequence"),
        "event_id",
        "ts",
        F.get_json_object("props", "$.k").cast("double").alias("progress"),
        F.col("event_type").alias("stage"),
        "value",
    )


JOBS_SQL = """jobs AS (
  SELECT user_id AS job_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS sequence, event_id, ts,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS progress, event_type AS stage, value FROM events)"""
