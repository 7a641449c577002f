"""Trackers, links, both directions, pixels, sources and streams against plain loops and scenarios."""

import itertools
import math
import random
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from trackloom.operators import bidirectional, detect, infer, lanes, link, pictures, pixels, trackers
from trackloom.operators import motion as M
from trackloom.operators import tracks as tr
from trackloom.schema import detections
from trackloom.sources import frames as frames_io
from trackloom.streaming import events
from trackloom.streaming.trackers import track_stream

cloudpickle.register_pickle_by_value(sys.modules[__name__])
DETS = "video_id long, frame long, det_id long, x1 double, y1 double, x2 double, y2 double, confidence double, is_confident boolean"


def dets(spark, rows, high=0.5):
    return spark.createDataFrame([(*r, r[7] >= high) for r in rows], DETS)


def moving(start, count, x, y, vx, vy, video=1, ident=0, w=0.05, h=0.05, score=0.9):
    return [(video, start + k, ident, x + vx * k, y + vy * k, x + vx * k + w, y + vy * k + h, score) for k in range(count)]


def ids(df):
    return {(r.frame, r.track_id): r for r in df.collect()}


def test_filter_is_the_dense_one():
    rng = np.random.default_rng(1)
    f = M.Filters()
    start = np.array([0.1, 0.2, 0.3, 0.4])
    f.add(start)
    move, see = np.eye(8), np.eye(4, 8)
    move[:4, 4:] = np.eye(4)
    mean, cov = np.r_[M.to_xyah(start), np.zeros(4)], np.eye(8) * 10
    for k in range(200):
        f.predict()
        mean, cov = move @ mean, move @ cov @ move.T + np.diag([1] * 4 + [0.01] * 4)
        if k % 3:
            z = start + rng.normal(0, 0.01, 4)
            f.update(0, z)
            gain = cov @ see.T @ np.linalg.inv(see @ cov @ see.T + 0.01 * np.eye(4))
            mean = mean + gain @ (M.to_xyah(z) - see @ mean)
            cov = cov - gain @ see @ cov
    assert np.allclose(f.mean[0], mean, atol=1e-9) and np.allclose(f.cov[0], [cov[0, 0], cov[0, 4], cov[4, 4]], atol=1e-9)


def test_assignment_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n, m = rng.integers(1, 6, 2).tolist()
        cost = rng.integers(0, 9, (n, m)).astype(float)
        got = M.assign(cost)
        few, many = min(n, m), max(n, m)
        wide = cost if n <= m else cost.T
        best = min(sum(wide[i, p[i]] for i in range(few)) for p in itertools.permutations(range(many), few))
        assert len({r for r, _ in got}) == len({c for _, c in got}) == len(got) == few
        assert math.isclose(sum(cost[r, c] for r, c in got), best)


def test_low_scores_bridge_in_pools(spark):
    rows = [(1, f, 0, 0.1, 0.1, 0.5, 0.5, s) for f, s in enumerate((0.9, 0.25, 0.9))]
    for kind in ("bytetrack", "oc_sort", "fused"):
        got = trackers.track(dets(spark, rows), kind, trackers.settings(kind, dilate=0.0)).orderBy("frame").collect()
        assert [(r.frame, r.track_id) for r in got] == [(0, 1), (1, 1), (2, 1)]


def test_second_gate(spark):
    rows = [(1, 0, 0, 0.1, 0.1, 0.2, 0.2, 0.9), (1, 1, 0, 0.3, 0.1, 0.4, 0.2, 0.9)]
    s = trackers.settings("botsort", gate_first=0.1, gate_second=0.5, camera=False)
    assert {r.track_id for r in trackers.track(dets(spark, rows), "botsort", s).collect()} == {1}
    assert {r.track_id for r in trackers.track(dets(spark, rows), "botsort", trackers.settings("botsort", gate_first=0.1, gate_second=0.1, camera=False)).collect()} == {1, 2}


def test_gap_and_videos(spark):
    rows = [(v, f, 0, x / 100, 0.1, x / 100 + 0.2, 0.3, 0.9) for v in (1, 2) for f, x in ((0, 10), (1, 12), (3, 16), (4, 18))]
    for kind in trackers.KINDS:
        got = trackers.track(dets(spark, rows), kind, trackers.settings(kind, camera=False)).collect()
        assert {(r.video_id, r.track_id) for r in got} == {(1, 1), (2, 1)}, kind
        assert all(0 <= r.x1 <= r.x2 <= 1 and 0 <= r.y1 <= r.y2 <= 1 for r in got)


def test_misses_hide_and_rates_prune(spark):
    rows = [*moving(0, 3, 0.1, 0.1, 0, 0), *moving(0, 12, 0.8, 0.8, 0, 0, ident=1)]
    got = trackers.track(dets(spark, rows), "sort", trackers.settings("sort", max_misses=2, gate=0.1)).collect()
    assert max(r.frame for r in got if r.track_id == 1) == 4
    pruned = trackers.track(dets(spark, rows), "sort", trackers.settings("sort", max_misses=50, gate=0.1, min_rate=0.6)).collect()
    assert max(r.frame for r in pruned if r.track_id == 1) < 7


def test_embeddings_keep_identities_apart(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, f, i, x, 0.1, x + 0.05, 0.2, 0.9, True, e) for f in range(4) for i, (x, e) in enumerate([(0.10, a), (0.14, b)] if f < 2 else [(0.10, b), (0.14, a)])]
    df = spark.createDataFrame(rows, DETS + ", embedding array<double>")
    got = trackers.track(df, "fused", trackers.settings("fused", dilate=0.0)).where("frame = 3").collect()
    assert {r.track_id: r.x1 > 0.12 for r in got} == {1: True, 2: False}


def test_pictures_keep_a_missed_track():
    s, t = trackers.settings("hybrid_sot", drift=0.0), trackers.Tracks()
    frame = lambda boxes, scores: trackers.Frame(np.array(boxes, float).reshape(-1, 4), np.array(scores, float), np.array(scores) >= 0.5)
    trackers.step("hybrid_sot", s, t, 0, frame([[0.1, 0.1, 0.2, 0.2]], [0.9]))
    for k in range(1, 6):
        out = trackers.step("hybrid_sot", s, t, k, frame([[0.8, 0.8, 0.1, 0.1]], [0.2]), lambda f, i, box: [0.1, 0.1, 0.2, 0.2])
        assert [r[0] for r in out] == [1]
    assert t.number["score"][0] == pytest.approx(0.9**6)
    trackers.step("hybrid_sot", s, t, 6, frame([[0.1, 0.1, 0.2, 0.2]], [0.2]), lambda f, i, box: [0.1, 0.1, 0.2, 0.2])
    assert t.number["score"][0] == 0.2  # the low detection at the place took over


def test_tracks_cross_batches(spark):
    rng = random.Random(4)
    rows = [(v, f, i, *(lambda x, y: (x, y, x + 0.05, y + 0.05))(rng.random() * 0.9, rng.random() * 0.9), rng.choice([0.3, 0.8])) for v in range(3) for f in range(40) for i in range(4)]
    df = dets(spark, rows)
    whole = sorted(map(tuple, trackers.track(df, "bytetrack").collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    assert sorted(map(tuple, trackers.track(df, "bytetrack").collect())) == whole
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_no_detections(spark):
    empty = dets(spark, [])
    assert trackers.track(empty, "sort").count() == 0
    assert bidirectional.bidirectional(empty).count() == 0
    assert link.link(trackers.track(empty, "sort")).count() == 0


def test_stream_gives_the_rows_of_the_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(v, f, i, x, y, x + 0.1, y + 0.1, 0.8, True) for v in (1, 2) for f in range(12) for i in range(3) for x, y in [(0.2 * i + 0.01 * f, rng.random() * 0.02)]]
    for part in range(4):
        spark.createDataFrame([r for r in rows if r[1] // 3 == part], DETS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(DETS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    s = trackers.settings("sort", forget_after=300)
    q = track_stream(source, "sort", s).writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted(map(tuple, trackers.track(spark.createDataFrame(rows, DETS), "sort", s).collect()))
    assert sorted(map(tuple, spark.table("tracked").collect())) == want


def test_windows_of_a_stream(spark, tmp_path):
    rows = [(j, i, float(i), "view", 1.0, f"2024-01-0{1 + i % 3} 10:00:00") for j in range(2) for i in range(9)]
    df = spark.createDataFrame(rows, "job_id long, sequence long, progress double, stage string, value double, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for f, name in ((events.windowed, "windows"), (events.latest, "last")):
        q = f(source).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, f(df).collect()))


def obs(spark, parts):
    rows = [(1, i, f, x, y, x + 0.01, y + 0.015, 0.9) for i, found in parts.items() for _, f, _, x, y, *_ in found]
    return spark.createDataFrame(rows, "video_id long, track_id long, frame long, x1 double, y1 double, x2 double, y2 double, score double")


def test_fragments_link(spark):
    a = moving(0, 12, 100 / 1920, 200 / 1080, 3 / 1920, 0.5 / 1080)
    b = moving(15, 12, 136 / 1920 + 9 / 1920, 206 / 1080 + 1.5 / 1080, 3.1 / 1920, 0.6 / 1080)
    far = moving(80, 12, 0.9, 0.9, -0.002, 0)
    got = {r.track_id: r.new_id for r in link.link(obs(spark, {7: a, 9: b, 11: far})).collect()}
    assert got == {7: 1, 9: 1, 11: 2}
    named = tr.remap(obs(spark, {7: a, 9: b}), link.link(obs(spark, {7: a, 9: b})))
    assert sorted(r.frame for r in tr.fill_gaps(named).collect()) == [12, 13, 14]


def test_fragments_that_do_not_link(spark):
    a = moving(0, 12, 0.1, 0.2, 0.002, 0)
    for b in (moving(62, 12, 0.2, 0.2, 0.002, 0), moving(14, 12, 0.13, 0.2, -0.002, 0), moving(14, 5, 0.128, 0.2, 0.002, 0)):
        assert {r.new_id for r in link.link(obs(spark, {1: a, 2: b})).collect()} == {1, 2}


def test_both_directions_merge(spark):
    rows = [r for f in (moving(0, 20, 0.1, 0.2, 0.01, 0), moving(0, 20, 0.1, 0.7, 0.01, 0, ident=1)) for r in f if r[1] not in (11, 12)]
    got = bidirectional.bidirectional(dets(spark, rows), "sort", trackers.settings("sort", gate=0.2, dilate=0.0)).collect()
    assert {r.track_id for r in got} == {1, 2}
    assert {r.frame for r in got} == set(range(20)) - {11, 12}
    assert {r.origin for r in got} <= {"forward", "backward", "merged"} and any(r.origin == "merged" for r in got)


def test_slots_of_present_frames(spark):
    rows = [(1, f, i, 0.1, 0.1, 0.2, 0.2, s) for f, found in {0: [0.9, 0.9], 3: [0.9], 4: [0.2], 9: [0.9, 0.9]}.items() for i, s in enumerate(found)]
    got = sorted((r.frame, r.track_id) for r in tr.slots(detections(dets(spark, rows))).collect())
    assert got == [(0, 1), (0, 2), (3, 1), (9, 3), (9, 4)]


# ---- pixels


def test_redaction_changes_regions_only(spark):
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (40, 60, 3), dtype=np.uint8)
    frame = spark.createDataFrame([(1, 0, 60, 40, bytearray(image.tobytes())), (1, 1, 60, 40, bytearray(image.tobytes())), (2, 0, 60, 40, None)], "video_id long, frame long, width int, height int, pixels binary")
    rois = spark.createDataFrame([(1, 0, 20, 10, 30, 20), (1, 0, 55, 35, 50, 50), (1, 0, -50, 0, 10, 10)], "video_id long, frame long, x int, y int, w int, h int")
    mask = np.zeros((40, 60), bool)
    mask[10:30, 20:50] = mask[35:, 55:] = True
    for kind in pixels.KINDS:
        got = {(r.video_id, r.frame): r for r in pixels.redact(frame, rois, kind.upper(), 7).collect()}
        out = np.frombuffer(got[1, 0].pixels, np.uint8).reshape(40, 60, 3)
        assert (out[~mask] == image[~mask]).all() and (out[mask] != image[mask]).any() and got[1, 0].redacted_pixels == mask.sum()
        assert kind != "blackout" or not out[mask].any()
        assert got[1, 1].pixels == image.tobytes() and got[2, 0].pixels is None
    with pytest.raises(ValueError):
        pixels.redact(frame, rois, "swirl")


def test_kernels():
    flat = np.full((9, 11, 3), 77, np.uint8)
    assert (pixels.gaussian(flat, 4) == 77).all() and (pixels.gaussian(flat[:1, :1], 9) == 77).all()
    step = np.zeros((1, 21, 1), np.uint8)
    step[:, 10:] = 200
    k = np.exp(-(np.arange(-2, 3) ** 2) / (2 * 1.1**2))
    assert pixels.gaussian(step, 5)[0, 10, 0] == round(200 * (k / k.sum())[2:].sum())
    assert np.unique(pixels.pixelate(np.arange(16, dtype=np.uint8).reshape(4, 4, 1), 2)).size == 4
    square = pixels.polygon([(1, 1), (4, 1), (4, 3), (1, 3)], 6, 5)
    assert square.sum() == 6 and square[1:3, 1:4].all()
    up = pixels.bilinear(np.array([[0.0, 1.0]]), 1, 4)
    assert np.allclose(up, [[0, 0.25, 0.75, 1]])
    plane = np.full((1, 8, 8), -9.0)
    plane[0, :, 4:] = 9
    assert pixels.prototype_mask(np.ones(1), plane, (0, 0, 16, 16), (16, 16), 16).sum() == 16 * 8


def test_polygons_composite(spark):
    frame = spark.createDataFrame([(1, 0, 8, 8, bytearray(bytes(range(192))))], "video_id long, frame long, width int, height int, pixels binary")
    rois = spark.createDataFrame([(1, 0, 0, 0, 0, 0, [(0.0, 0.0), (8.0, 0.0), (0.0, 8.0)])], "video_id long, frame long, x int, y int, w int, h int, points array<struct<x:double,y:double>>")
    r = pixels.redact(frame, rois, "blackout", 1).first()
    assert 28 <= r.redacted_pixels <= 36


def test_masks_decode_fuse_and_redact(spark):
    planes = np.zeros((2, 8, 8), np.float16)
    planes[0], planes[1] = -9, -9
    planes[0, :, :4], planes[1, :4, :] = 9, 9
    proto = spark.createDataFrame([(1, 0, 0, 16, 16, 2, 8, 8, bytearray(planes.tobytes()))] * 2, "video_id long, frame long, tile_id int, width int, height int, planes int, plane_height int, plane_width int, data binary")
    rows = [(1, 0, 0, 0, 0.0, 0.0, 16.0, 16.0, [1.0, 0.0]), (1, 0, 0, 1, 0.0, 0.0, 16.0, 16.0, [0.0, 1.0]), (1, 0, 0, 2, 4.0, 4.0, 4.0, 9.0, [1.0, 0.0]), (1, 1, 0, 3, 0.0, 0.0, 9.0, 9.0, [1.0, 0.0])]
    boxes = spark.createDataFrame(rows, "video_id long, frame long, tile_id int, det_id long, x1 double, y1 double, x2 double, y2 double, coefficients array<double>")
    masks = pixels.decode_masks(boxes, proto, 16)
    got = {r.det_id: pixels.unpack(r.bits, r.w, r.h) for r in masks.collect()}
    assert set(got) == {0, 1} and got[0][:, :8].all() and not got[0][:, 8:].any() and got[1].sum() == 128
    owners = spark.createDataFrame([(1, 0, 0, 0), (1, 0, 1, 0)], "video_id long, frame long, det_id long, kept_id long")
    fused = pixels.fuse_masks(masks, owners)
    r = fused.first()
    assert fused.count() == 1 and pixels.unpack(r.bits, r.w, r.h).sum() == 192
    frame = spark.createDataFrame([(1, 0, 16, 16, bytearray(b"\x07" * 768))], "video_id long, frame long, width int, height int, pixels binary")
    out = pixels.redact(frame, fused, "blackout", 1).first()
    assert out.redacted_pixels == 192 and out.pixels.count(0) == 192 * 3


def test_mask_area(spark):
    rng = random.Random(1)
    pick = lambda: sorted(rng.choice([0.0, 1.0, rng.random()]) for _ in range(2))
    rows = [(1, f, *(x for pair in zip(pick(), pick(), strict=True) for x in pair)) for f in range(20) for _ in range(3)]
    df = spark.createDataFrame(rows, "video_id long, frame long, x1 double, y1 double, x2 double, y2 double")
    for grid in (7, 62, 130):
        span = lambda a, b: range(math.floor(a * grid), max(math.floor(a * grid), math.ceil(b * grid) - 1) + 1)  # noqa: E731, B023
        want = {f: set() for f in range(20)}
        for _, f, x1, y1, x2, y2 in rows:
            want[f] |= {(i, j) for i in span(x1, x2) for j in span(y1, y2)}
        assert {r.frame: r.cells for r in pixels.mask_area(df, grid).collect()} == {f: len(c) for f, c in want.items()}


# ---- sources


def test_video_round_trip(spark, tmp_path):
    rgb = [np.full((6, 8, 3), c, np.uint8) for c in ((250, 0, 0), (0, 120, 10), (30, 30, 200))]
    df = spark.createDataFrame([(1, i, 8, 6, bytearray(p.tobytes())) for i, p in enumerate(rgb)], "video_id long, frame long, width int, height int, pixels binary")
    made = frames_io.segments(df, length=2, rate=24).orderBy("segment").collect()
    assert len(made) == 2
    for r in made:
        (tmp_path / f"{r.segment}.y4m").write_bytes(r.content)
    got = frames_io.read_videos(spark, str(tmp_path))
    assert got.count() == 3
    first = [np.frombuffer(r.pixels, np.uint8).reshape(6, 8, 3) for r in got.where("frame = 0").collect()]
    assert sorted(min(int(np.abs(p.astype(int) - q).max()) for q in rgb) for p in first)[-1] <= 4
    assert sorted(r.frame_count for r in frames_io.describe(got).collect()) == [1, 2]
    assert frames_io.read_videos(spark, str(tmp_path), pixels=False).where("pixels IS NULL").count() == 3


def test_inference_to_detections(spark):
    image = np.zeros((50, 100, 3), np.uint8)
    frame = spark.createDataFrame([(1, 0, 100, 50, 100, 50, bytearray(image.tobytes()))], "video_id long, frame long, width int, height int, frame_width int, frame_height int, pixels binary")

    def session():
        def run(images):
            raw = np.zeros((len(images), 6, 3), np.float32)
            raw[:, :, 0] = [32, 16, 20, 10, 0.2, 0.9]
            raw[:, :, 1] = [33, 16, 20, 10, 0.1, 0.6]
            return raw

        return run

    found = infer.candidates(detect.tiles(frame, 128), session, 64)
    assert found.count() == 2
    r = detect.postprocess(found, 2).collect()
    assert len(r) == 1 and r[0].object_class == 1 and r[0].confidence == pytest.approx(0.9)
    assert (r[0].x1, r[0].x2) == (pytest.approx(22 / 64), pytest.approx(42 / 64))


def test_frames_are_cut_in_the_task(spark):
    """Tiles cut in the task give the rows of tiles cut before; large frames shrink first, and boxes stay shares of them."""
    rng = np.random.default_rng(2)
    sizes = [(100, 50), (64, 64), (200, 120), (30, 20)]
    rows = [(1, k, w, h, w, h, bytearray(rng.integers(0, 256, w * h * 3, np.uint8).tobytes())) for k, (w, h) in enumerate(sizes)]
    schema = "video_id long, frame long, width int, height int, frame_width int, frame_height int, pixels binary"
    frames = spark.createDataFrame([*rows, (1, 9, 8, 8, 8, 8, None), (1, 10, 8, 8, 8, 8, bytearray(b"short")), (1, 11, 0, 0, 0, 0, bytearray())], schema)

    def session():
        def run(images):  # where a tile is brightest, and how bright it is on the whole
            raw = np.zeros((len(images), 5, 2), np.float32)
            for raw_, image in zip(raw, images, strict=True):
                y, x = divmod(int(image.sum(axis=0).argmax()), image.shape[2])
                raw_[:, 0] = [x, y, 10, 6, image.mean()]
            return raw

        return run

    cut = infer.candidates(detect.tiles(spark.createDataFrame(rows, schema), 64), session, 64)
    got = infer.tiled_candidates(frames, session, 64, 64)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, got.collect())) == sorted(map(str, cut.collect())) and got.count() > len(rows)
    small = infer.tiled_candidates(frames, session, 64, 64, inference_size=60)
    assert {(r.frame, r.frame_width, r.frame_height) for r in small.collect()} == {(0, 60, 30), (1, 60, 60), (2, 60, 36), (3, 30, 20)}
    assert small.count() == len(rows)


def test_shrinking_by_area():
    rng = np.random.default_rng(4)
    image = rng.integers(0, 256, (13, 17, 3), np.uint8)
    small, (h, w) = infer.area(image, 5, 7), (13 / 5, 17 / 7)
    for i in range(5):
        for j in range(7):
            held = np.zeros(3)
            for y in range(13):
                for x in range(17):
                    held += image[y, x] * max(0, min(y + 1, (i + 1) * h) - max(y, i * h)) * max(0, min(x + 1, (j + 1) * w) - max(x, j * w))
            assert np.abs(small[i, j] - held / (h * w)).max() <= 0.5 + 1e-6
    assert (infer.area(image, 13, 17) == image).all() and (infer.area(np.full((9, 8, 3), 255, np.uint8), 4, 3) == 255).all()


def test_the_best_provider_there_is():
    assert infer.provider(["CPUExecutionProvider", "TensorrtExecutionProvider", "CUDAExecutionProvider"]) == "CUDAExecutionProvider"
    assert infer.provider(["QNNExecutionProvider", "OpenVINOExecutionProvider"]) == "OpenVINOExecutionProvider"
    assert infer.provider(["other"]) == "CPUExecutionProvider"


def test_every_kind_by_name(spark):
    from trackloom.schema import TRACK

    given = dets(spark, moving(0, 12, 0.1, 0.1, 0.01, 0.01))
    for kind in ("Dummy", "SORT", "bytetrack", " botsort", "oc_sort", "Fused", "hybrid_SOT", "Bidirectional"):
        got = bidirectional.tracker(given, kind)
        assert got.schema.names == TRACK.names and {r.track_id for r in got.collect()} == {1}
    with pytest.raises(ValueError):
        bidirectional.tracker(given, "none")


def test_dummy_shows_detections_as_they_are(spark):
    rows = [(1, f, i, 0.2 + 0.3 * i, 0.2, 1.4 + 0.3 * i, 0.4, 0.9 - 0.5 * (i == 2), i != 2, None if f == 1 else 10 * f + i) for f in range(3) for i in range(3)]
    got = bidirectional.tracker(spark.createDataFrame(rows, DETS + ", mask long"), "dummy").collect()
    assert len(got) == 6
    for r in got:
        _, _, _, x1, y1, x2, y2, score, _, mask = rows[3 * r.frame + r.track_id - 1]
        assert (r.x1, r.y1, r.x2, r.y2, r.score, r.mask) == (x1, y1, x2, y2, score, mask)
        assert (r.width, r.height, r.state, r.age, r.last_seen, r.should_blur) == (x2 - x1, y2 - y1, "confirmed", 1, r.frame, True)


@pytest.mark.parametrize("kind", ["sort", "bytetrack", "botsort", "oc_sort", "fused", "hybrid_sot", "bidirectional"])
def test_masks_stay_with_tracks(spark, kind):
    """A track carries the mask of the detection it was seen by, and none where it was missed."""
    rows = [(1, f, i, 0.2 + 0.4 * i, 0.2, 0.3 + 0.4 * i, 0.4, 0.9, True, None if (f, i) == (4, 0) else 100 * f + i) for f in range(12) for i in range(2) if not (i and 5 < f < 8)]
    got = bidirectional.tracker(spark.createDataFrame(rows, DETS + ", mask long").repartition(3), kind).collect()
    seen = {(r.frame, round(r.x1 / 0.4) if r.x1 > 0.05 else 0) for r in got}
    assert {(r[1], r[2]) for r in rows} - seen <= {(f, i) for f in (0, 1, 2, 3, 8, 9, 10, 11) for i in (0, 1)}  # the first ones may be tentative
    for r in got:
        i = int(r.x1 > 0.4)
        assert r.mask == (None if (r.frame, i) == (4, 0) or (i and 5 < r.frame < 8) else 100 * r.frame + i)


def test_merged_masks(spark):
    """The backward mask counts first, else the forward one; tables without masks merge as before."""
    schema = "video_id long, track_id long, frame long, x1 double, y1 double, x2 double, y2 double, score double, state string, age long, last_seen long, should_blur boolean, mask long"
    side = lambda masks: spark.createDataFrame([(1, 1, f, 0.1, 0.1, 0.2, 0.2, 0.5, "confirmed", 1, f, True, m) for f, m in masks.items()], schema)
    forward, backward = side({0: 5, 1: 6, 2: None, 3: None}), side({1: 16, 2: 17, 3: None, 4: 18, 0: None})
    chosen = spark.createDataFrame([(1, 1, 1, 0.9)], "video_id long, forward_id long, backward_id long, mean_iou double")
    got = tr.merge(forward, backward, chosen)
    assert {r.frame: r.mask for r in got.collect()} == {0: 5, 1: 16, 2: 17, 3: None, 4: 18}
    assert "mask" not in tr.merge(forward.drop("mask"), backward, chosen).columns


def test_pictures_that_look_different_are_not_followed():
    s = trackers.settings("hybrid_sot", visual_age=5, drift=0.5)
    box, vector = np.array([[0.1, 0.1, 0.1, 0.1]]), np.array([1.0, 0.0])
    for shown, kept in (((box[0], np.array([1.0, 0.1])), True), ((box[0], np.array([0.0, 1.0])), False)):
        t, asked = trackers.Tracks(), []
        trackers.step("hybrid_sot", s, t, 0, trackers.Frame(box, np.array([0.9]), np.array([True]), [vector]))
        none = trackers.Frame(np.zeros((0, 4)), np.zeros(0), np.zeros(0, bool), [])
        for frame in (1, 2, 3):
            trackers.step("hybrid_sot", s, t, frame, none, lambda *a: asked.append(a) or shown)
        assert len(asked) == (3 if kept else 1) and (t.number["misses"][0] == 0) == kept


def test_vectors_join_the_cost_of_both_kinds(spark):
    """Two boxes swap places; their vectors tell them apart, in batch, for both kinds that know vectors."""
    rows = []
    for frame in range(6):
        for i in (0, 1):
            at = 0.1 + 0.01 * ((i + frame) % 2)
            rows.append((1, frame, i, at, 0.1, at + 0.1, 0.2, 0.9, True, [1.0, 0.0] if i else [0.0, 1.0]))
    given = spark.createDataFrame(rows, DETS + ", embedding array<double>")
    for kind in ("fused", "hybrid_sot"):
        kept = trackers.track(given, kind, trackers.settings(kind, gate_first=0.5, smooth=1.0)).collect()
        side = {}
        for r in kept:
            side.setdefault(r.track_id, []).append((r.frame, r.x1))
        assert len(side) == 2 and all(len({round(x, 3) for _, x in v}) > 1 for v in side.values())


def video_file(n, w=8, h=6):
    rng = np.random.default_rng(n)
    return f"YUV4MPEG2 W{w} H{h} F10:1 C444\n".encode() + b"".join(b"FRAME\n" + rng.integers(16, 235, 3 * w * h, np.uint8).tobytes() for _ in range(n))


def test_frames_by_number_batches_and_kind_of_file(spark, tmp_path):
    (tmp_path / "a.y4m").write_bytes(video_file(7))
    path = str(tmp_path / "a.y4m")
    every = {r.frame: r.pixels for r in frames_io.read_videos(spark, path, batch_size=3).collect()}
    assert sorted(every) == list(range(7)) and every[0] != every[6]
    assert {r.frame: r.pixels for r in frames_io.read_videos(spark, path, frames=[6, 2, 99, -1]).collect()} == {2: every[2], 6: every[6]}
    assert [r.pixels for r in frames_io.read_videos(spark, path, pixels=False).collect()] == [None] * 7
    with pytest.raises(ValueError):
        frames_io.read_videos(spark, path, batch_size=0)
    with pytest.raises(FileNotFoundError):
        frames_io.read_media(spark, str(tmp_path / "b.png"))
    assert frames_io.read_media(spark, path).count() == 7
    made = frames_io.images(frames_io.read_videos(spark, path, frames=[2])).first()
    (tmp_path / "c.png").write_bytes(made.content)
    assert frames_io.read_media(spark, str(tmp_path / "c.png")).first().pixels == every[2]


def test_patches():
    from trackloom.operators import embed

    image = np.arange(90, dtype=np.uint8).reshape(6, 5, 3)
    assert (embed.channel_last(np.moveaxis(image, 2, 0)) == image).all() and embed.channel_last(image) is image
    assert embed.rgb(np.full((2, 2), 300.0)).tolist() == [[[255] * 3] * 2] * 2
    assert embed.rgb(np.dstack([image, image])).tolist() == image.tolist()
    assert (embed.crop(image, -1, 1, 3, 9) == image[1:, :2]).all() and embed.crop(image, 5, 0, 2, 2) is None
    assert np.allclose(embed.patch(image, 6, 5), np.moveaxis(image, 2, 0) / 255)


def test_vectors_of_boxes(spark):
    """The mean colour as a model: boxes of a frame, of the last frame before, and of none."""
    from trackloom.operators import embed

    image = lambda v: bytearray(bytes([v, 0, 255 - v]) * 20)
    shown = spark.createDataFrame([(1, 0, 5, 4, image(10)), (1, 3, 5, 4, image(200)), (2, 5, 5, 4, image(7))], "video_id long, frame long, width int, height int, pixels binary")
    boxes = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.5, 0.5, "a"), (1, 2, 0.2, 0.2, 0.9, 1.0, "b"), (1, 4, 0.0, 0.0, 1.0, 1.0, "c"), (2, 4, 0.0, 0.0, 1.0, 1.0, "d"), (2, 5, 2.0, 2.0, 3.0, 3.0, "e"), (1, 2, 0.0, 0.0, 1.0, 1.0, "f")], "video_id long, frame long, x1 double, y1 double, x2 double, y2 double, name string")
    got = {r.name: r.embedding for r in embed.embed(boxes, shown, lambda: lambda batch: batch.mean(axis=(2, 3)), 3, 2, batch_size=2).collect()}
    want = {"a": 10, "b": 10, "c": 200, "f": 10}
    assert set(got) == set("abcdef") and got["d"] is None and got["e"] is None
    assert all(np.allclose(np.array(got[k]) * 255, [v, 0, 255 - v], atol=1e-3) for k, v in want.items())


def test_models_and_their_notes(spark, tmp_path):
    from trackloom.schema import CLASSES
    from trackloom.sources import models

    for name, note in {"one": '{"classes": {"10": "c", "2": "Plate"}, "default_blur": ["plate", "x"]}', "two": '{"classes": ["head", "dog"]}', "three": "not json", "four": None, "five": '{"default_blur": "HEAD"}'}.items():
        (tmp_path / f"{name}.onnx").write_bytes(b"12345")
        if note is not None:
            (tmp_path / f"{name}.classes.json").write_text(note)
    got = {r.name: r for r in models.listing(spark, str(tmp_path), ("two",)).collect()}
    assert {k: (r.filename, r.size_bytes, r.immutable) for k, r in got.items()} == {k: (f"{k}.onnx", 5, k == "two") for k in ("one", "two", "three", "four", "five")}
    usual = [c for c in CLASSES if c in ("plate", "head")]
    assert {k: (r.classes, r.default_blur) for k, r in got.items()} == {"one": (["Plate", "c"], ["Plate"]), "two": (["head", "dog"], ["head"]), "three": (list(CLASSES), usual), "four": (list(CLASSES), usual), "five": (list(CLASSES), ["head"])}


def test_a_long_gap_is_one_walk_of_the_filter(monkeypatch):
    """The observations on the way to a track that was away come in one call, and give what one call each gives."""
    calls, update = [], M.Filters.update
    monkeypatch.setattr(M.Filters, "update", lambda self, at, tlwh: calls.append(1) or update(self, at, tlwh))
    t, s = trackers.Tracks(), trackers.settings("oc_sort")
    see = lambda frame, x: trackers.step("oc_sort", s, t, frame, trackers.Frame(np.array([[x, 0.2, 0.1, 0.1]]), np.array([0.9]), np.array([True])))
    see(0, 0.2), see(1, 0.201)
    calls.clear()
    see(40, 0.203)
    assert len(calls) == 1 and len(t.extra) == 1
    one, many = M.Filters(), M.Filters()
    path = np.random.default_rng(1).random((30, 4)) + 0.1
    for f in (one, many):
        f.add(path[0])
    for box in path:
        many.update(0, box)
    one.follow(0, path)
    assert (one.mean == many.mean).all() and (one.cov == many.cov).all()


def test_narrow_and_wide_assignments_agree(monkeypatch):
    rng = np.random.default_rng(4)
    for _ in range(300):
        cost = rng.integers(0, 6, rng.integers(1, 12, 2)).astype(float)
        narrow = M.assign(cost)
        with monkeypatch.context() as m:
            m.setattr(M, "NARROW", 0)
            assert M.assign(cost) == narrow


def test_vectors_are_made_units_once(monkeypatch):
    """Tracks and detections that are all within reach: lengths are taken of each vector, not of each pair."""
    rng, calls, unit = np.random.default_rng(3), [], trackers._unit
    t, s = trackers.Tracks(), trackers.settings("fused")
    made = lambda: trackers.Frame(np.c_[0.4 + rng.random((12, 2)) * 0.01, np.full((12, 2), 0.1)], np.full(12, 0.9), np.ones(12, bool), list(rng.random((12, 64))))
    trackers.step("fused", s, t, 0, made())
    monkeypatch.setattr(trackers, "_unit", lambda v: calls.append(1) or unit(v))
    trackers.step("fused", s, t, 1, made())
    assert len(calls) < 12 * 12


@pytest.mark.parametrize("pairs", [1 << 20, 40])
@pytest.mark.parametrize(("kind", "changes"), [("sort", {}), ("sort", {"min_rate": 0.5}), ("bytetrack", {"gate": 0.2}), ("bytetrack", {"forget_after": 3}), ("botsort", {"gate_first": 0.15, "gate_second": 0.1})])
def test_videos_side_by_side_have_the_tracks_of_each_alone(kind, changes, pairs, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lanes, "PAIRS", pairs)
    rng, s, n = np.random.default_rng(3), trackers.settings(kind, **changes), 6000
    video, frame = rng.choice([-40, -2, 0, 1, 5, 31, 32, 33, 900], n), rng.integers(0, 60, n)
    places = rng.integers(0, [[6], [6]], (2, n)) * 0.1 + rng.choice([0, 0.02], n)  # many are equally far apart
    rows = {"video_id": video, "frame": frame, "x1": places[0], "y1": places[1], "x2": places[0] + 0.2, "y2": places[1] + 0.1, "confidence": rng.integers(1, 11, n) / 10}
    rows["is_confident"] = rows["confidence"] >= 0.5
    by = np.lexsort((video, frame, video >> lanes.BITS))
    rows = {k: v[by] for k, v in rows.items()}
    names = [f.split()[0] for f in trackers.OUTPUT.split(", ")]
    batches = [pa.RecordBatch.from_arrays([pa.array(v[at : at + 77]) for v in rows.values()], names=list(rows)) for at in range(0, n, 77)]
    got = [tuple(r.values()) for b in lanes.walk(trackers.KINDS[kind], s, names)(iter(batches)) for r in b.to_pylist()]
    want = []
    for v in np.unique(video).tolist():
        t = trackers.Tracks()
        for f in np.unique(frame[video == v]).tolist():
            own = {k: c[(rows["video_id"] == v) & (rows["frame"] == f)] for k, c in rows.items()}
            want += trackers._rows_of(v, f, trackers.step(kind, s, t, f, trackers._frame_of(own)), [])
    assert len(want) > 5000
    assert sorted(got) == sorted(want)


def test_trackers_by_centres_walk_videos_side_by_side(spark, monkeypatch):
    taken, walk = [], lanes.walk
    monkeypatch.setattr(lanes, "walk", lambda *a: taken.append(a) or walk(*a))
    for kind in trackers.KINDS:
        trackers.track(dets(spark, [(1, 0, 0, 0.1, 0.1, 0.2, 0.2, 0.9)]), kind)
    assert len(taken) == 3


def _looked_at(spark, videos: int = 40, frames: int = 14):
    """Detections that come and go at random over a few places, with vectors, some of them null, and frames, some of them missing."""
    rng, rows, shown = np.random.default_rng(7), [], []
    for video in range(videos):
        spots, back = rng.uniform(0.05, 0.8, (5, 2)), rng.integers(0, 255, (24, 32, 3), np.uint8)
        for frame in range(frames):
            if rng.random() < 0.8:
                shown.append((video, frame, 32, 24, back.tobytes()))
            for i in np.flatnonzero(rng.random(5) < 0.6).tolist():
                (x, y), score = (spots[i] + rng.uniform(0, 0.02, 2)).tolist(), float(rng.uniform(0.1, 1))
                vector = (np.eye(3)[i % 3] + rng.uniform(0, 0.9, 3)).tolist() if rng.random() < 0.8 else None
                rows.append((video, frame, i, x, y, x + 0.15, y + 0.15, score, score > 0.5, vector))
    dets = spark.createDataFrame(rows, "video_id long, frame long, det_id long, x1 double, y1 double, x2 double, y2 double, confidence double, is_confident boolean, embedding array<double>")
    return dets, spark.createDataFrame(shown, "video_id long, frame long, width int, height int, pixels binary")


@pytest.mark.parametrize("kind", ["fused", "hybrid_sot"])
def test_videos_with_vectors_walk_side_by_side(spark, same, kind):
    """As those with masks walk, one after another."""
    dets, _ = _looked_at(spark)
    found = trackers.track(dets, kind)
    assert "hashpartitioning(_lane" in found._jdf.queryExecution().executedPlan().toString()
    one = trackers.track(dets.withColumn("mask", F.lit(1).cast("long")), kind).drop("mask")
    same(found.toPandas(), one.toPandas())


@pytest.mark.parametrize("vector", [None, lambda patch: patch.mean(axis=(0, 1))])
def test_pictures_of_several_videos_are_looked_for_at_once(spark, same, vector):
    dets, shown = _looked_at(spark)
    dets = dets.drop("embedding")
    sight = lambda: pictures.Sight(pictures.Template(3), vector)
    found = trackers.track(dets, "hybrid_sot", frames=shown, sight=sight)
    assert "hashpartitioning(_lane" in found._jdf.queryExecution().executedPlan().toString()
    one = trackers.track(dets.withColumn("mask", F.lit(1).cast("long")), "hybrid_sot", frames=shown, sight=sight).drop("mask")
    same(found.toPandas(), one.toPandas())


def test_a_search_for_several_pictures_finds_what_each_alone_does():
    rng, eye = np.random.default_rng(3), pictures.Template(2)
    images = [rng.integers(0, 255, size, np.uint8) for size in ((20, 30, 3), (16, 18, 3))]
    after = [np.roll(images[0], (1, 2), axis=(0, 1)), images[1]]
    boxes = [(0, 1, 6, 4), (3, 5, 4, 7), (22, 12, 8, 8), (5, 5, 3, 3), (10, 2, 8, 9)]
    of = [0, 0, 0, 1, 1]
    alone, many = [eye.start(images[i], b) for i, b in zip(of, boxes, strict=True)], eye.start_many([images[i] for i in of], boxes)
    for shown in (after, images):
        want = [eye.find(shown[i], e) for i, e in zip(of, alone, strict=True)]
        assert eye.find_many([shown[i] for i in of], many) == want
    assert eye.start_many([np.full((9, 9, 3), 7, np.uint8)], [(1, 1, 4, 4)]) == [None]


def test_pictures_that_stay_are_searched_once(monkeypatch):
    """An image that comes again is no search for patches that stayed in their place, found or not; the places are those of a search."""
    rng, eye = np.random.default_rng(4), pictures.Template(3)
    image, other = (rng.integers(0, 255, (20, 30, 3), np.uint8) for _ in range(2))
    moved = np.roll(image, (1, 2), axis=(0, 1))
    boxes = [(4, 5, 6, 4), (12, 8, 5, 7)]
    alone, many = [eye.start(image, b) for b in boxes], eye.start_many([image] * 2, boxes)
    searched, search = [], eye._search
    monkeypatch.setattr(eye, "_search", lambda images, held: searched.append(len(held)) or search(images, held))
    for shown in (image, image, moved, moved, moved, other, other, moved):
        assert eye.find_many([shown] * 2, many) == [eye.find(shown, e) for e in alone]
    assert searched == [0, 0, 2, 2, 0, 2, 0, 2]

    seen = pictures.Sight(eye, lambda patch: searched.append("vector") or patch.mean(axis=(0, 1)))
    lane = lanes.Lane(trackers.KINDS["hybrid_sot"], trackers.settings("hybrid_sot"), seen)
    for data in (image, image.copy(), other, None):
        lane.show(7, 30, 20, None if data is None else data.tobytes())
        lane.show(8, 30, 20, image.tobytes())
        searched.append(lane.images[7])
    first, again, third, gone = searched[-4:]
    assert first is again and third is not first and (third == other).all() and gone is None
    del searched[:], first, again
    _, held, _ = seen.start_many([third], np.array([[0.2, 0.2, 0.3, 0.3]]))
    for _ in range(3):
        seen.find_many([third], list(held))
    assert searched.count("vector") == 2 and list(seen.known) == [id(third)]
    del third
    assert not seen.known


@pytest.mark.parametrize("pairs", [1 << 20, 40])
@pytest.mark.parametrize("changes", [{}, {"min_rate": 0.5}, {"forget_after": 3}, {"smooth": 1.0, "max_misses": 2}])
def test_videos_by_overlap_walk_side_by_side(changes, pairs, monkeypatch):
    """Rounds by overlap with momentum: the tracks of each video alone."""
    test_videos_side_by_side_have_the_tracks_of_each_alone("oc_sort", changes, pairs, monkeypatch)


def test_overlap_takes_lanes(spark, monkeypatch):
    """Where a pair's overlap is more than all else that its track and detection could have, no assignment is worked out."""
    rows = [*moving(0, 9, 0.1, 0.1, 0.01, 0, w=0.2, h=0.2), *moving(0, 9, 0.25, 0.1, 0.01, 0, ident=1, w=0.2, h=0.2)]
    found = trackers.track(dets(spark, rows), "oc_sort")
    assert "hashpartitioning(_lane" in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.frame, r.track_id) for r in found.collect()} == {(f, i) for f in range(9) for i in (1, 2)}
    lane, asked = lanes.Lane(trackers.KINDS["oc_sort"], trackers.settings("oc_sort")), []
    monkeypatch.setattr(lanes, "assign", lambda cost: asked.append(cost.shape) or M.assign(cost))
    box = np.array([[0.1, 0.1, 0.2, 0.2], [0.25, 0.1, 0.2, 0.2]])
    for f, shift in enumerate((0, 0.01, 0.02, 0.105)):
        lane.step(f, np.zeros(2, int), box + [shift, 0, 0, 0], np.full(2, 0.9), np.ones(2, bool))
        assert len(asked) == (f == 3)


@pytest.mark.parametrize("kind", ["sort", "bytetrack", "oc_sort", "fused"])
def test_both_directions_meet_in_one_task(spark, same, kind):
    """Only detections are dealt and nothing is written; rows are those of joins of both passes."""
    given, _ = _looked_at(spark)
    found = bidirectional.bidirectional(given, kind)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "parquet" not in plan
    joined = bidirectional._by_joins(given, kind, None, 0.3, 0.6)
    assert {r.origin for r in joined.select("origin").distinct().collect()} >= {"forward", "merged"}
    one, two = (df.withColumn("score", F.round("score", 12)).toPandas() for df in (found, joined))
    same(one, two)


@pytest.mark.parametrize(("held", "pairs"), [(1 << 20, 1 << 20), (50, 1 << 20), (50, 7), (1, 1)])
def test_long_videos_lie_in_a_file(spark, held, pairs, monkeypatch):
    """Rows beyond those held go to a file and come back; sums are folded in parts; batches cut frames anywhere."""
    import pyarrow as pa

    given, _ = _looked_at(spark, videos=6)
    rows = trackers.both_ways(given, "sort").where("state <> 'tentative'").select("video_id", *bidirectional._READ)
    table = rows.toArrow().sort_by([(c, "ascending") for c in ("video_id", "frame", "_side", "track_id")])
    ask = lambda size: sorted(map(repr, pa.Table.from_batches(list(bidirectional._merged(0.3, 0.6)(iter(table.to_batches(max_chunksize=size))))).to_pylist()))
    want, files = ask(10000), []
    monkeypatch.setattr(bidirectional, "HELD", held)
    monkeypatch.setattr(bidirectional, "PAIRS", pairs)
    monkeypatch.setattr(bidirectional.tempfile, "TemporaryFile", lambda own=bidirectional.tempfile.TemporaryFile, **k: files.append(own(**k)) or files[-1])
    for size in (7, 10000):
        assert ask(size) == want and len(want) > 100
    assert bool(files) == (held < 100) and all(f.closed for f in files)
