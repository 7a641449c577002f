"""Progress reports of jobs: latest state, changes, rolling rates, throttling."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

def order() -> WindowSpec:
    return Window.partitionBy("job_id").orderBy("sequence")


def latest(reports: DataFrame) -> DataFrame:
    """The last report of each job. Partial maxima combine before the shuffle."""
    last = F.max(F.struct("sequence", "progress", "stage", "ts")).alias("last")
    return reports.groupBy("job_id").agg(last, F.count("*").alias("n_reports")).select("job_id", "last.*", "n_reports")


def changes(reports: DataFrame) -> DataFrame:
    """Reports whose progress or stage differs from the one before."""
    was = [F.lag(c).over(order()) for c in ("progress", "stage")]
    return reports.withColumns({"_p": was[0], "_s": was[1]}).where(~(F.col("progress").eqNullSafe(F.col("_p")) & F.col("stage").eqNullSafe(F.col("_s")))).drop("_p", "_s")


def rolling_rate(reports: DataFrame, units: Column, seconds: Column, records: int = 5) -> DataFrame:
    """Units per second over the last records; 0 where no time has passed."""
    last = order().rowsBetween(1 - records, 0)
    u, s = F.sum(units).over(last), F.sum(seconds).over(last)
    return reports.withColumn("rate", F.when(s > 0, u / s).otherwise(F.lit(0.0)))


def percent(done: Column, total: Column) -> Column:
    return F.round(F.least(F.greatest(done / F.greatest(total, F.lit(1)) * 100, F.lit(0.0)), F.lit(100.0)), 2)


def throttled(reports: DataFrame, points: float = 5.0, seconds: float = 2.0) -> DataFrame:
    """Reports that get through: the first, any at 100 or more, and those ``points`` or ``seconds`` past the last that did.

    What gets through depends on what did before, so a task walks its jobs' reports in order with the last one sent.
    """
    ordered = reports.select("job_id", "sequence", "progress", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).repartition("job_id").sortWithinPartitions("job_id", "sequence")

    def walk(batches: Iterator) -> Iterator:
        job, progress, us = object(), 0.0, 0
        for rows in batches:
            go = []
            for j, p, t in zip(rows["job_id"], rows["progress"], rows["us"], strict=True):
                sent = j != job or p >= 100 or p - progress >= points or t - us >= seconds * 1e6
                if sent:
                    job, progress, us = j, p, t
                go.append(sent)
            yield rows.loc[go, ["job_id", "sequence"]]

    return ordered.mapInPandas(walk, "job_id long, sequence long")


#: States of a job, and those that a report may lead to.
MOVES = {"running": ("running", "done", "error", "cancelled"), "done": (), "error": (), "cancelled": ()}


def settled(reports: DataFrame, state: Column) -> DataFrame:
    """Reports up to the first that ends a job; later ones don't count."""
    ended = F.max(F.when(state.isin("done", "error", "cancelled"), 1).otherwise(0)).over(order().rowsBetween(Window.unboundedPreceding, -1))
    return reports.withColumns({"state": state, "_ended": F.coalesce(ended, F.lit(0))}).where("_ended = 0").drop("_ended")
