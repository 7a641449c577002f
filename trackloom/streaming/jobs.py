"""Progress reports of jobs as a stream: one settled, change-only feed, and a table of latest states that replays leave alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trackloom.operators import jobs
from trackloom.sources import shared

CHANGE = "job_id long, sequence long, progress double, stage string, state string"
#: Where a job's feed stands: its last report, and the state that ended it, if one did.
LAST = "sequence long, progress double, stage string, ended string"


class Feed(StatefulProcessor):
    """The last report of a job. Once one ended the job, nothing follows; the entry stays for ``keep_ms`` to refuse more."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", LAST, self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = self.last.get() if self.last.exists() else None
        sequence, progress, stage, ended = found or (None, None, None, None)
        out = []
        for r in pd.concat(list(rows)).sort_values("sequence", kind="stable").itertuples():
            if ended is not None or (sequence is not None and r.sequence <= sequence):
                continue
            own = None if pd.isna(r.progress) else float(r.progress)
            if sequence is None or (own, r.stage) != (progress, stage):
                out.append((key[0], int(r.sequence), own, r.stage, r.state))
            sequence, progress, stage = int(r.sequence), own, r.stage
            ended = r.state if r.state in jobs.MOVES and not jobs.MOVES[r.state] else None
        self.last.update((sequence, progress, stage, ended))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGE.split(", ")])

    def close(self) -> None:
        pass


def feed(reports: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """``job_id, sequence, progress, stage, state`` of a stream of reports with these columns: the first of each job and those
    whose progress or stage differs from the one before, up to the one that ends it.

    Rows are those of ``jobs.changes(jobs.settled(...))``. A job's reports come in rising sequence over the micro-batches,
    in any order within one; what was passed already, so a replayed report, is left out. Jobs are keys of the state store,
    which needs RocksDB; with ``keep_ms`` an entry leaves it so long after its last report.
    """
    made = reports.select("job_id", "sequence", F.col("progress").cast("double").alias("progress"), "stage", "state")
    return made.groupBy("job_id").transformWithStateInPandas(Feed(keep_ms), CHANGE, "Append", "None" if keep_ms is None else "ProcessingTime")


def upsert(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps each job's latest row in a table below a path.

    A micro-batch leaves one row a job in a folder of its number, in place of what an earlier try left there. So a replay
    changes nothing, and a batch costs its own rows, not the table's.
    """

    def put(rows: DataFrame, batch: int) -> None:
        _latest(rows).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return put


def _latest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("job_id").agg(F.max_by(F.struct("sequence", "progress", "stage", "state"), "sequence").alias("r")).select("job_id", "r.*")


def table(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``upsert`` keeps: of each job the row with the highest sequence."""
    return _latest(spark.read.schema(CHANGE).parquet(f"{path}/ba*=*"))


def compact(spark: SparkSession, path: str, upto: int) -> None:
    """Puts the rows of batches up to one into one folder and deletes theirs. No stream may write them meanwhile.

    Its files appear once all are complete, and only then others go: whatever an interruption leaves gives the same table.
    """
    names = [f.getPath().getName() for f in _found(spark, f"{path}/ba*=*")]
    old = [n for n in names if int(n.split("=")[1]) <= upto and n != f"base={upto}"]
    if old and not _found(spark, f"{path}/base={upto}/_SUCCESS"):
        _latest(spark.read.schema(CHANGE).parquet(*(f"{path}/{n}" for n in old))).write.mode("overwrite").parquet(f"{path}/base={upto}")
    for n in old:
        shared.forget(spark, f"{path}/{n}")


def _found(spark: SparkSession, pattern: str) -> list:
    target = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return list(target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target) or ())
