"""Event-time operators over streams of job reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(reports: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Reports and their value by window and stage; windows close once the watermark passes them."""
    seen = reports.withWatermark("ts", late) if reports.isStreaming else reports
    made = seen.groupBy(F.window("ts", width).alias("w"), "stage").agg(F.count("*").alias("n_reports"), F.round(F.sum("value"), 6).alias("total_value"))
    return made.select(F.col("w.start").alias("window_start"), "stage", "n_reports", "total_value")


def latest(reports: DataFrame) -> DataFrame:
    """The last report of each job, kept up to date (``update`` or ``complete`` mode)."""
    last = F.max(F.struct("sequence", "progress", "stage")).alias("last")
    return reports.groupBy("job_id").agg(last, F.count("*").alias("n_reports")).select("job_id", "last.*", "n_reports")
