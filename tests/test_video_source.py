"""The video source reads the bytes that a query needs, over several tasks; the file sink leaves whole files, once."""

import os
import subprocess
import sys
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trackloom.sources import frames as frames_io
from trackloom.sources import video

W, H = 8, 6
STEP = 6 + 3 * W * H


def stream(n, mark=b"FRAME\n", rate="10:1"):
    rng = np.random.default_rng(n)
    return f"YUV4MPEG2 W{W} H{H} F{rate} C444\n".encode() + b"".join(mark + rng.integers(16, 235, 3 * W * H, np.uint8).tobytes() for _ in range(n))


def want(path, only=lambda n: True):
    """Rows of a file, decoded from its start."""
    return [(video.video_id(f"file:{path}"), *r) for r in video.decode(path.read_bytes()) if only(r[0])]


@pytest.fixture
def folder(tmp_path):
    for name, n in (("a.y4m", 40), ("b.y4m", 7), ("c.y4m", 0), ("_part", 3), (".hidden", 3)):
        (tmp_path / name).write_bytes(stream(n))
    (tmp_path / "odd.y4m").write_bytes(stream(5, b"FRAME Ip\n"))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.y4m").write_bytes(stream(3))
    return tmp_path


def test_rows_whatever_the_ranges(spark, folder):
    paths = [folder / p for p in ("a.y4m", "b.y4m", "c.y4m", "odd.y4m", "sub/d.y4m")]
    every = sorted(r for p in paths for r in want(p))
    for span in (100, STEP, 5 * STEP + 1, 64 << 20):
        got = frames_io.read_videos(spark, str(folder), span_bytes=span, batch_size=4)
        assert sorted(map(tuple, got.collect())) == every
    assert frames_io.read_videos(spark, str(folder / "a.y4m"), span_bytes=10 * STEP).rdd.getNumPartitions() == 5
    assert frames_io.read_videos(spark, str(folder / "*b*")).count() == 7
    assert frames_io.read_videos(spark, str(folder / "c.y4m")).count() == 0
    hashed = spark.read.format("binaryFile").load(str(folder / "a.y4m")).select(F.xxhash64("path")).first()[0]
    assert hashed == video.video_id(f"file:{folder}/a.y4m")
    with pytest.raises(Exception, match="nowhere"):
        frames_io.read_videos(spark, str(folder / "nowhere")).count()


def test_frames_that_are_asked_for(spark, folder):
    """They are ranges of their own: one frame is one task, and queries of one frame set don't disturb each other."""
    path = folder / "a.y4m"
    read = lambda **asked: frames_io.read_videos(spark, str(path), span_bytes=4 * STEP, **asked)
    for asked, only in (
        ({"frames": [13]}, lambda n: n == 13),
        ({"first": 3, "last": 5}, lambda n: 3 <= n <= 5),
        ({"frames": [39, 2, 3, 77, -1]}, lambda n: n in (39, 2, 3)),
        ({"frames": [1, 2, 3], "first": 2}, lambda n: n in (2, 3)),
        ({"frames": []}, lambda n: False),
        ({"first": 99}, lambda n: False),
    ):
        assert sorted(map(tuple, read(**asked).collect())) == want(path, only)
    assert read(frames=[13]).rdd.getNumPartitions() == 1 and read(first=8, last=17).rdd.getNumPartitions() == 3
    every = read()
    one, two = every.where("frame = 1"), every.where("frame = 2")
    assert [r.frame for r in one.union(two).collect()] == [1, 2] and every.count() == 40
    by_video = spark.read.format("y4m").option("videos", f"[{video.video_id(f'file:{folder}/b.y4m')}]").load(str(folder))
    assert by_video.rdd.getNumPartitions() == 1 and by_video.count() == 7
    odd = frames_io.read_videos(spark, str(folder / "odd.y4m"), span_bytes=10, first=3)
    assert sorted(map(tuple, odd.collect())) == want(folder / "odd.y4m", lambda n: n >= 3)


def test_bytes_read(folder, monkeypatch):
    """Beside a file's first line, only wanted frames are read, and none without a column of pixels."""
    path, read = str(folder / "a.y4m"), []
    plain = video.Opened.bytes
    monkeypatch.setattr(video.Opened, "bytes", lambda self, at, size: read.append((at, size)) or plain(self, at, size))
    first = video.layout((folder / "a.y4m").read_bytes()).first

    def rows(columns, **asked):
        reader = video.VideoSource({"path": path, "spanBytes": str(4 * STEP), **asked}).reader(StructType.fromDDL(columns))
        parts = reader.partitions()
        read.clear()
        return [r for p in parts for b in reader.read(p) for r in b.to_pylist()], len(parts)

    head = 4096
    got, parts = rows(video.FRAME, first="13", last="13")
    assert (len(got), parts) == (1, 1) and [r for r in read if r[1] != head] == [(first + 13 * STEP, STEP)]
    got, parts = rows("frame long, pts double")
    assert [r["frame"] for r in got] == list(range(40)) and all(set(r) == {"frame", "pts"} for r in got) and {r[1] for r in read} == {head}
    got, _ = rows(video.FRAME, frames="[5, 6, 30]")
    assert len(got) == 3 and sorted(r for r in read if r[1] != head) == [(first + 5 * STEP, 2 * STEP), (first + 30 * STEP, STEP)]
    with pytest.raises(ValueError):
        rows("frame long, title string")


def test_broken_files(spark, tmp_path):
    (tmp_path / "text").write_bytes(b"no video")
    (tmp_path / "moved").write_bytes(stream(4).replace(b"FRAME\n", b"FRAMES", 1))
    for name in ("text", "moved"):
        with pytest.raises(Exception, match="not a YUV4MPEG2 stream|doesn't start"):
            frames_io.read_videos(spark, str(tmp_path / name)).collect()


# ---- the sink


def contents(path):
    return {str(p.relative_to(path)): p.read_bytes() for p in path.rglob("*") if p.is_file() and not str(p.relative_to(path)).startswith("_")}


def test_segments_and_images_on_disk(spark, tmp_path, folder):
    got = frames_io.read_videos(spark, str(folder / "a.y4m"))
    frames_io.write_segments(got, str(tmp_path / "out"), length=16, rate=10)
    names = sorted(contents(tmp_path / "out"))
    assert [n.split("-")[-1] for n in names] == ["000000.y4m", "000001.y4m", "000002.y4m"] and not list((tmp_path / "out").glob("_work*"))
    back = frames_io.read_videos(spark, str(tmp_path / "out"))
    assert back.count() == 40 and sorted(r["count"] for r in back.groupBy("video_id").count().collect()) == [8, 16, 16]
    frames_io.write_images(got.where("frame < 3"), str(tmp_path / "png"))
    assert len(contents(tmp_path / "png")) == 3
    assert frames_io.read_media(spark, str(next((tmp_path / "png").rglob("*.png")))).count() == 1


def test_batches_count_once(spark, tmp_path):
    out = tmp_path / "out"
    frames_io.video.register(spark)
    put = lambda rows, **o: spark.createDataFrame(rows, "k long, content binary").write.format("named_files").options(name="{k}.bin", **o).mode("append").save(str(out))
    put([(1, b"a"), (2, b"b"), (3, None)], batch="7")
    assert contents(out) == {"1.bin": b"a", "2.bin": b"b"}
    put([(1, b"other"), (9, b"new")], batch="7")
    assert contents(out) == {"1.bin": b"a", "2.bin": b"b"}
    put([(1, b"c")], batch="8")
    assert contents(out) == {"1.bin": b"c", "2.bin": b"b"}
    with pytest.raises(Exception, match="several rows name one file"):
        put([(5, b"x"), (5, b"y")])
    with pytest.raises(Exception, match="names no file"):
        spark.createDataFrame([("../x", b"y")], "k string, content binary").write.format("named_files").options(name="{k}").mode("append").save(str(out))
    spark.createDataFrame([(6, b"z")], "k long, content binary").write.format("named_files").options(name="{k}.bin").mode("overwrite").save(str(out))
    assert contents(out) == {"6.bin": b"z"} and not list(out.glob("_work*"))


def test_stream_of_files(spark, tmp_path):
    """A batch that is tried again after its commit adds nothing."""
    spark.createDataFrame([(1, b"a"), (2, b"b")], "k long, content binary").write.parquet(str(tmp_path / "in"))
    video.register(spark)
    for _ in range(2):
        source = spark.readStream.schema("k long, content binary").parquet(str(tmp_path / "in"))
        q = source.writeStream.format("named_files").option("name", "{k}").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(60)
        assert contents(tmp_path / "out") == {"1": b"a", "2": b"b"}
        for part in list((tmp_path / "c" / "commits").iterdir()):
            part.unlink()  # as if the driver was lost before it noted the batch


def test_failed_tasks_leave_no_half_and_no_second_file(tmp_path):
    """A task fails after it wrote a file, once, and runs again; a job whose tasks always fail leaves nothing."""
    code = f"""
        import os, sys
        from pyspark.sql import SparkSession
        from trackloom.sources import video
        spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
        spark.sparkContext.setLogLevel("OFF")
        video.register(spark)
        root = {str(tmp_path)!r}

        def some(batches, always):
            for batch in batches:
                yield batch.slice(0, 1)
                flag = root + "/failed"
                if always or not os.path.exists(flag):
                    open(flag, "w").close()
                    os._exit(1) if not always else exec("raise RuntimeError('always')")
                yield batch.slice(1)

        rows = spark.createDataFrame([(i, bytes([i]) * 1000) for i in range(40)], "k long, content binary").repartition(4)
        for name, always in (("once", False), ("never", True)):
            made = rows.mapInArrow(lambda b, a=always: some(b, a), rows.schema)
            try:
                made.write.format("named_files").option("name", "{{k}}").mode("append").save(root + "/" + name)
            except Exception as e:
                print("failed", name)
    """
    env = os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)}
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], env=env, capture_output=True, text=True, timeout=180)
    assert out.stdout.split() == ["failed", "never"], out.stdout + out.stderr[-2000:]
    assert (tmp_path / "failed").exists() and contents(tmp_path / "once") == {str(i): bytes([i]) * 1000 for i in range(40)}
    assert not list((tmp_path / "once").glob("_work*"))
    assert not (tmp_path / "never").exists() or contents(tmp_path / "never") == {}  # a task that ends after the abort may leave work aside
