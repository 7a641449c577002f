"""Streams with keyed state against the batch operators: restarts, replays, ends."""

import pytest

from trackloom.operators import jobs, trackers
from trackloom.streaming import jobs as feeds
from trackloom.streaming.trackers import track_stream

DETS = "video_id long, frame long, det_id long, x1 double, y1 double, x2 double, y2 double, confidence double, is_confident boolean, mask long"
REPORTS = "job_id long, sequence long, progress double, stage string, state string"


def ran(stream, at, each=None):
    """The rows that a stream adds when it runs over what is there, from its checkpoint."""
    out = []
    took = each or (lambda df, batch: out.extend(df.collect()))
    q = stream.writeStream.option("checkpointLocation", str(at)).trigger(availableNow=True).foreachBatch(took).start()
    if not q.awaitTermination(60):
        q.stop()
        raise TimeoutError
    return out


def walked(video, frames, step=0.01):
    return [(video, f, i, 0.1 + 0.3 * i + step * f, 0.1, 0.2 + 0.3 * i + step * f, 0.2, 0.5 + 0.04 * ((f + i) % 9), True, None if f % 4 == 2 else 10 * f + i) for f in frames for i in range(3) if (f + i) % 7]


@pytest.mark.parametrize("kind", ["sort", "oc_sort", "botsort", "fused"])
def test_tracks_of_a_restarted_stream(spark, tmp_path, kind):
    """Three runs from one checkpoint give the rows of the batch over all; the state is one entry a live track."""
    s = trackers.settings(kind, forget_after=5)
    parts = [walked(v, range(a, a + 6)) for a in (0, 6, 12) for v in (1, 2)]
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(DETS).parquet(str(tmp_path / "in"))
    got = []
    for n in range(3):
        spark.createDataFrame([*parts[2 * n], *parts[2 * n + 1]], DETS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got += ran(track_stream(source, kind, s), tmp_path / "c")
    want = trackers.track(spark.createDataFrame([r for p in parts for r in p], DETS), kind, s).collect()
    near = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    assert sorted(map(near, got), key=str) == sorted(map(near, want), key=str)
    entries = spark.read.format("statestore").option("stateVarName", "tracks").load(str(tmp_path / "c")).count()
    assert 0 < entries <= 2 * max(r.track_id for r in want)


def test_a_silent_video_leaves_the_state(spark, tmp_path):
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(DETS).parquet(str(tmp_path / "in"))
    held = []
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else the stream waits for time to pass
    for n, video in enumerate((1, 2, 2)):
        spark.createDataFrame(walked(video, range(4 * n, 4 * n + 4)), DETS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ran(track_stream(source, "sort", idle_ms=1), tmp_path / "c")
        places = spark.read.format("statestore").option("stateVarName", "place").load(str(tmp_path / "c"))
        held.append({r.key.video_id for r in places.select("key").collect()})
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert held[0] == {1} and 1 not in held[1] | held[2]


def reports(seed, n=200):
    """Jobs whose reports repeat, stand still, end, and go on after their end."""
    import random

    rng = random.Random(seed)
    rows = []
    for job in range(8):
        done = rng.randint(5, n // 8)
        for k in range(n // 8):
            state = rng.choice(["done", "error", "cancelled"]) if k == done else "running"
            rows.append((job, k, None if k == 2 else float(k // 3 * 5), "load" if k < 4 else "run", state))
    return rows


def test_feed_and_table(spark, tmp_path):
    """The feed has the rows of the batch operators; replays, of reports or of whole micro-batches, change nothing."""
    (tmp_path / "in").mkdir()
    rows = reports(1)
    source = spark.readStream.schema(REPORTS).parquet(str(tmp_path / "in"))
    seen, batches, put = [], [], feeds.upsert(str(tmp_path / "table"))

    def each(df, batch):
        df.persist()
        put(df, batch)
        put(df, batch)  # tried again
        seen.extend(df.collect())
        batches.append(batch)

    for low, high in ((0, 9), (9, 18), (5, 12), (18, 99)):  # the third is sent again
        spark.createDataFrame([r for r in rows if low <= r[1] < high], REPORTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ran(feeds.feed(source), tmp_path / "c", each=each)
    given = spark.createDataFrame(rows, REPORTS)
    want = jobs.changes(jobs.settled(given, given["state"])).select("job_id", "sequence", "progress", "stage", "state").collect()
    key = lambda r: (r.job_id, r.sequence)
    assert sorted(seen, key=key) == sorted(want, key=key)
    last = {}
    for r in sorted(want, key=key):
        last[r.job_id] = r
    latest = lambda: sorted(feeds.table(spark, str(tmp_path / "table")).collect(), key=key)
    assert latest() == [last[j] for j in sorted(last)]
    for upto in (batches[1], batches[1], batches[-1]):
        feeds.compact(spark, str(tmp_path / "table"), upto)
        assert latest() == [last[j] for j in sorted(last)]
    assert [p.name for p in (tmp_path / "table").iterdir()] == [f"base={batches[-1]}"]
