"""Progress of running work as reports of a job: Spark counts rows while they pass, so no second pass is needed.

Reports are small files that the driver writes below a path, for ``jobs.latest`` and the like, or as a stream for ``jobs.feed``.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from datetime import datetime, timezone
from typing import TypeVar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from trackloom.operators.jobs import MOVES
from trackloom.sources.video import files, store

REPORT = "job_id long, sequence long, progress double, stage string, state string, rows long, ts timestamp"
#: What a watched stream calls its count.
ROWS = "rows"
T = TypeVar("T")


def read(spark: SparkSession, path: str) -> DataFrame:
    """All reports below a path."""
    return spark.read.schema(REPORT).json(f"{path}/*.json")


class Reports:
    """Reports of one job. Those that are neither ``points`` further nor ``seconds`` later than the last one written are left
    out, but for the first of a stage, any at 100 and any that ends the job; nothing is written after that one.

    A job that is taken up again goes on from its last report. A report is a file named by job and sequence, so one that
    is made again after a restart replaces itself. ``total`` is what counts as all rows; without one progress is null.
    """

    def __init__(self, path: str, job_id: int, total: int | None = None, points: float = 5.0, seconds: float = 2.0):
        self.path, self.job_id, self.total, self.points, self.seconds = path, job_id, total, points, seconds
        self.cancelled, self._at = False, 0.0
        store(path)[0].create_dir(store(path)[1], recursive=True)
        own = [p for p, _ in files(path) if p.rsplit("/", 1)[1].startswith(f"{job_id}-")]
        with store(own[-1])[0].open_input_file(store(own[-1])[1]) if own else _Nothing() as f:
            self.last = json.loads(f.read()) if own else None

    @property
    def tag(self) -> str:
        return f"trackloom-job-{self.job_id}"

    def add(self, stage: str, rows: int, state: str = "running", sequence: int | None = None) -> bool:
        """Write a report, unless it is left out; whether it was written. An older ``sequence`` than the last is left out."""
        last, now = self.last, time.monotonic()
        sequence = sequence or (last["sequence"] if last else 0) + 1
        if last and (not MOVES[last["state"]] or sequence < last["sequence"]):
            return False
        progress = None if self.total is None else round(min(max(rows / max(self.total, 1) * 100, 0.0), 100.0), 2)
        further = not last or last["stage"] != stage or state != last["state"] or (progress or 0) >= 100 or (progress or 0) - (last["progress"] or 0) >= self.points
        if not further and now - self._at < self.seconds:
            return False
        made = {"job_id": self.job_id, "sequence": sequence, "progress": progress, "stage": stage, "state": state, "rows": rows, "ts": datetime.now(timezone.utc).isoformat()}
        system, base = store(self.path)
        name = f"{self.job_id}-{sequence:018d}.json"
        with system.open_output_stream(f"{base}/_{name}") as f:
            f.write(json.dumps(made).encode())
        system.move(f"{base}/_{name}", f"{base}/{name}")
        self.last, self._at = made, now
        return True

    def run(self, stage: str, df: DataFrame, action: Callable[[DataFrame], T]) -> T:
        """``action`` of the rows, with a report before and one after, by the rows that passed. It has to run a job of them.

        An action that fails ends the job as an error, or as cancelled after :meth:`cancel`; what it raised goes on.
        """
        spark, seen = df.sparkSession, Observation()
        self.add(stage, 0)
        spark.addTag(self.tag)
        try:
            made = action(df.observe(seen, F.count(F.lit(1)).alias(ROWS)))
        except BaseException:
            self.add(stage, self.last["rows"], "cancelled" if self.cancelled else "error")
            raise
        finally:
            spark.removeTag(self.tag)
        self._at = 0.0
        self.add(stage, seen.get[ROWS])
        return made

    def done(self) -> None:
        """Ends the job."""
        self.add(self.last["stage"] if self.last else "", self.last["rows"] if self.last else 0, "done")

    def cancel(self, spark: SparkSession) -> None:
        """Stops what :meth:`run` runs, from another thread."""
        self.cancelled = True
        spark.interruptTag(self.tag)


class _Nothing:
    def __enter__(self) -> None:
        return None

    def __exit__(self, *why: object) -> None:
        return None


def watched(df: DataFrame, name: str) -> DataFrame:
    """A stream whose rows are counted in every micro-batch, for the :class:`Watch` of that name."""
    return df.observe(name, F.count(F.lit(1)).alias(ROWS))


class Watch(StreamingQueryListener):
    """Feeds a stream's counts to reports: ``spark.streams.addListener(Watch(reports, name))`` before the query starts.

    A micro-batch's number is its report's sequence, so a replayed one counts once. A query that stops ends the job, as an
    error if it failed, unless ``keep_open``.
    """

    def __init__(self, reports: Reports, name: str, keep_open: bool = False):
        self.reports, self.name, self.keep_open = reports, name, keep_open
        last = reports.last or {"rows": 0, "sequence": 0}
        self.rows, self.batch, self.run = last["rows"], last["sequence"] - 1, None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        found = p.observedMetrics.get(self.name)
        if found is None:
            return
        self.run = p.runId
        if p.batchId > self.batch:
            self.batch = p.batchId
            self.rows += found[ROWS]
            self.reports.add(self.name, self.rows, sequence=p.batchId + 1)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.runId != self.run:
            return
        if event.exception or not self.keep_open:
            self.reports.add(self.name, self.rows, "error" if event.exception else "done", sequence=self.batch + 2)
