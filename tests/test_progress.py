"""Counts of running work as reports, and planes in buckets."""

import time

import numpy as np
import pytest

from trackloom.operators import jobs, pixels
from trackloom.streaming import progress


def test_a_run_reports_what_passed(spark, tmp_path):
    path = f"{tmp_path}/reports"
    work = progress.Reports(path, 7, total=1000)
    rows = spark.range(1000)
    work.run("detect", rows.where("id % 2 = 0"), lambda df: df.write.parquet(f"{tmp_path}/a"))
    assert spark.read.parquet(f"{tmp_path}/a").count() == 500
    assert work.run("track", rows, lambda df: df.count()) == 1000
    again = progress.Reports(path, 7, total=1000)  # the job is taken up again
    again.done()
    assert not again.add("track", 1000)
    found = progress.read(spark, path)
    assert [(r.sequence, r.progress, r.stage, r.state, r.rows) for r in found.orderBy("sequence").collect()] == [
        (1, 0.0, "detect", "running", 0),
        (2, 50.0, "detect", "running", 500),
        (3, 0.0, "track", "running", 0),
        (4, 100.0, "track", "running", 1000),
        (5, 100.0, "track", "done", 1000),
    ]
    last = jobs.latest(found).first()
    assert (last.job_id, last.sequence, last.progress, last.n_reports) == (7, 5, 100.0, 5)
    assert last.ts is not None


def test_reports_are_throttled_and_errors_end_a_job(spark, tmp_path):
    work = progress.Reports(f"{tmp_path}/r", 1, total=100, seconds=3600)
    assert [work.add("a", n) for n in (0, 4, 5, 9, 10, 100, 100)] == [True, False, True, False, True, True, True]
    assert work.add("b", 100) and not work.add("b", 100, sequence=1)
    with pytest.raises(Exception, match="(?i)division"):
        work.run("c", spark.sql("SELECT 1 / (id - 3) AS x FROM range(9)"), lambda df: df.collect())
    assert work.last["state"] == "error" and not work.add("d", 1)
    empty = progress.Reports(f"{tmp_path}/r", 2)
    assert empty.run("x", spark.range(0), lambda df: df.count()) == 0
    found = progress.read(spark, f"{tmp_path}/r")
    last = jobs.latest(found).join(found.select("job_id", "sequence", "state"), ["job_id", "sequence"])
    assert {(r.job_id, r.stage, r.state, r.progress) for r in last.collect()} == {(1, "c", "error", 0.0), (2, "x", "running", None)}


def test_a_stream_reports_each_batch_once(spark, tmp_path):
    """A stream in two runs, of three and two files: its reports go on, one a micro-batch, and end with it."""
    reports, source = f"{tmp_path}/reports", f"{tmp_path}/in"

    def feed(files, keep_open):
        for k in files:
            spark.range(10 * (k + 1)).coalesce(1).write.mode("append").parquet(source)
            time.sleep(0.01)
        watch = progress.Watch(progress.Reports(reports, 3, total=150, seconds=0), "rows in", keep_open)
        spark.streams.addListener(watch)
        try:
            df = progress.watched(spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source), "rows in")
            query = df.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
            until = time.time() + 30
            while time.time() < until and (watch.batch < files[-1] or not (keep_open or watch.reports.last["state"] == "done")):
                time.sleep(0.1)
        finally:
            spark.streams.removeListener(watch)

    feed([0, 1, 2], True)
    feed([3, 4], False)
    got = [(r.sequence, r.rows, r.progress, r.state) for r in progress.read(spark, reports).orderBy("sequence").collect()]
    assert [(s, state) for s, _, _, state in got] == [(1, "running"), (2, "running"), (3, "running"), (4, "running"), (5, "running"), (6, "done")]
    assert got[2][1:3] == (60, 40.0) and got[4][1:3] == (150, 100.0) and got[5][1] == 150


def test_planes_in_buckets_do_not_move_again(spark):
    rng = np.random.default_rng(3)
    keys = [(v, f, 0) for v in (1, 2) for f in range(5)]
    planes = [(*k, 16, 16, 2, 8, 8, bytearray(rng.normal(0, 4, (2, 8, 8)).astype(np.float16).tobytes())) for k in keys for _ in range(2)]
    proto = spark.createDataFrame(planes, "video_id long, frame long, tile_id int, width int, height int, planes int, plane_height int, plane_width int, data binary")
    boxes = spark.createDataFrame([(*k, i, 1.0, 2.0, 12.0 + i, 13.0, [1.0, float(i)]) for k in [*keys, (3, 0, 0)] for i in range(3)], "video_id long, frame long, tile_id int, det_id long, x1 double, y1 double, x2 double, y2 double, coefficients array<double>")
    try:
        stored = pixels.store_planes(proto, "test_planes", 4)
        assert stored.count() == len(keys)
        masks = pixels.decode_masks(boxes, stored, 16)
        plan = masks._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
        assert sorted(masks.collect()) == sorted(pixels.decode_masks(boxes, proto, 16).collect())
    finally:
        spark.sql("DROP TABLE IF EXISTS test_planes")
