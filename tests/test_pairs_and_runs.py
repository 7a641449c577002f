"""Grid joins against all pairs, assignment against permutations, mask runs against rasters."""

import itertools
import random

import numpy as np
import pytest

from trackloom.functions.boxes import Box, centre_distance, iou
from trackloom.operators import assign, nms, pixels, runs
from trackloom.operators import tracks as tr
from pyspark.sql import functions as F

BOX = "video_id long, frame long, {} long, object_class long, x1 double, y1 double, x2 double, y2 double"


def boxes(spark, rng, n, name, size=0.1, low=-0.3, high=1.2):
    rows = []
    for i in range(n):
        x, y = rng.uniform(low, high), rng.uniform(low, high)
        rows.append((1, rng.randint(0, 3), i, rng.randint(0, 1), x, y, x + rng.uniform(-0.01, size), y + rng.uniform(0, size)))
    return spark.createDataFrame(rows, BOX.format(name))


@pytest.mark.parametrize("gate", [0.0, 0.05, 0.3, 5.0])
def test_gated_pairs(spark, gate):
    rng = random.Random(3)
    t, d = boxes(spark, rng, 60, "track_id"), boxes(spark, rng, 80, "det_id")
    same = spark.createDataFrame([(1, 0, 900, 0, 0.5, 0.5, 0.6, 0.6), (1, 0, 901, 0, 0.5 + gate, 0.5, 0.6 + gate, 0.6)], BOX.format("track_id"))
    t = t.union(same)
    d = d.union(same.withColumnRenamed("track_id", "det_id"))
    met = t.alias("t").join(d.alias("d"), [F.col("t.video_id") == F.col("d.video_id"), F.col("t.frame") == F.col("d.frame")])
    want = met.select("t.video_id", "t.frame", "t.track_id", "d.det_id", centre_distance(Box.of("t."), Box.of("d.")).alias("distance")).where(F.col("distance") <= gate)
    assert sorted(map(tuple, tr.gated_pairs(t, d, gate).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize(("size", "extent"), [(0.1, 1.0), (1.5, 1.0), (40.0, 100.0)])
def test_overlapping_pairs(spark, size, extent):
    d = boxes(spark, random.Random(4), 120, "det_id", size, -0.3 * extent, 1.2 * extent)
    keys = ("video_id", "frame", "object_class")
    met = d.alias("a").join(d.alias("b"), [*(F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys), F.col("a.det_id") < F.col("b.det_id")])
    want = met.select(*(f"a.{k}" for k in keys), F.col("a.det_id").alias("det_a"), F.col("b.det_id").alias("det_b"), iou(Box.of("a."), Box.of("b.")).alias("iou"))
    for threshold in (0.0, 0.3):
        assert sorted(map(tuple, nms.overlapping_pairs(d, threshold, extent=extent).collect())) == sorted(map(tuple, want.where(F.col("iou") > threshold).collect()))


def test_pairs_of_a_full_frame(spark):
    """Ten thousand boxes of a frame: what is compared grows with what is near."""
    rng = np.random.default_rng(1)
    x, y = rng.random((2, 10_000))
    d = spark.createDataFrame([(1, 0, i, 0, float(a), float(b), float(a) + 0.01, float(b) + 0.01) for i, (a, b) in enumerate(zip(x, y, strict=True))], BOX.format("det_id"))
    mine = Box.of()
    met = assign.near(d, d, ["video_id", "frame"], 0.01, (mine.cx, mine.cy), (mine.cx, mine.cy)).count()
    near = tr.gated_pairs(d.withColumnRenamed("det_id", "track_id"), d, 0.01).count()
    assert near <= met < 4 * near < 1_000_000
    assert assign.touching(d, ["video_id", "frame"], grid=64).count() < 200_000


def best(costs, gate):
    """The most that any one-to-one choice saves."""
    tracks, dets = sorted({t for t, _ in costs}), sorted({d for _, d in costs})
    short, long, cost = (tracks, dets, costs) if len(tracks) <= len(dets) else (dets, tracks, {(d, t): c for (t, d), c in costs.items()})
    return max(sum(gate + 10 - cost[p] for p in zip(short, pick, strict=True) if p in cost) for pick in itertools.permutations(long, len(short)))


@pytest.mark.parametrize("small", [0, 2, assign.SMALL])
def test_assignment(spark, small, monkeypatch):
    """Sparse and dense frames, chains, ties, repeats and nulls; small components on the JVM, larger ones by paths."""
    monkeypatch.setattr(assign, "SMALL", small)
    rng, rows, frames = random.Random(small), [], {}
    for frame in range(30):
        share = rng.choice([0.2, 0.4, 0.9])
        costs = {(t, 100 + d): rng.choice([0.0, 0.125, 0.25, rng.random() * 0.3]) for t in range(rng.randint(1, 6)) for d in range(rng.randint(1, 6)) if rng.random() < share}
        if costs:
            frames[frame] = costs
            rows += [(1, frame, t, d, c) for (t, d), c in costs.items()]
            rows += [(1, frame, t, d, c + 0.01) for (t, d), c in list(costs.items())[:2]] + [(1, frame, 0, 100, 0.5), (1, frame, None, 100, 0.0), (1, frame, 0, 100, None)]
    chain = {(t, 100 + t + k): 0.1 + 0.05 * k for t in range(40) for k in (0, 1)}
    rows += [(1, 99, t, d, c) for (t, d), c in chain.items()]
    got = {}
    for r in assign.choose(spark.createDataFrame(rows, "video_id long, frame long, track_id long, det_id long, cost double").repartition(4), 0.3).collect():
        got.setdefault(r.frame, []).append(r)
    for frame, costs in frames.items():
        found = got[frame]
        assert len({r.track_id for r in found}) == len({r.det_id for r in found}) == len(found)
        assert all(costs[r.track_id, r.det_id] == r.cost for r in found)
        assert sum(10.3 - r.cost for r in found) == pytest.approx(best(costs, 0.3))
    assert len(got[99]) == 40 and sum(r.cost for r in got[99]) == pytest.approx(4.0) and {r.component for r in got[99]} == {0}
    assert assign.choose(spark.createDataFrame([], "video_id long, frame long, track_id long, det_id long, cost double"), 0.3).count() == 0


# ---- masks


def raster(rows, n=60, low=20):
    out = {}
    for *key, y, start, stop in rows:
        out.setdefault(tuple(key), np.zeros((n, n), bool))[y + low, start + low : stop + low] = True
    return out


def shapes(rng, n):
    return [(1, rng.randint(0, 1), i % 6, rng.randint(-5, 20), rng.randint(-5, 20), rng.randint(-1, 12), rng.randint(0, 12)) for i in range(n)]


RECT = "video_id long, frame long, det_id long, x int, y int, w int, h int"


def test_set_operations(spark):
    rng = random.Random(6)
    a, b = (runs.of_boxes(spark.createDataFrame(shapes(rng, 20), RECT)) for _ in range(2))
    ra, rb = (raster(map(tuple, s.collect())) for s in (a, b))
    empty = np.zeros((60, 60), bool)
    for made, both in ((runs.combine(a), lambda p, q: p), (runs.intersect(a, b), lambda p, q: p & q), (runs.subtract(a, b), lambda p, q: p & ~q)):
        rows = [tuple(r) for r in made.collect()]
        want = {k: both(ra.get(k, empty), rb.get(k, empty)) for k in ra.keys() | rb.keys()}
        assert {k: m.tolist() for k, m in raster(rows).items()} == {k: m.tolist() for k, m in want.items() if m.any()}
        by_row = sorted(rows)
        assert all(p[:4] != q[:4] or p[5] < q[4] for p, q in itertools.pairwise(by_row)) and all(r[4] < r[5] for r in rows)
    for r in runs.measure(runs.combine(a)).collect():
        m = ra[r.video_id, r.frame, r.det_id]
        y, x = np.nonzero(m)
        assert (r.area, r.x, r.y, r.w, r.h) == (m.sum(), x.min() - 20, y.min() - 20, x.max() - x.min() + 1, y.max() - y.min() + 1)
    for r in runs.overlap(a, b).collect():
        p, q = (s.get((r.video_id, r.frame, r.det_id), empty) for s in (ra, rb))
        assert (r.area_a, r.area_b, r.area_both) == (p.sum(), q.sum(), (p & q).sum()) and r.iou == pytest.approx((p & q).sum() / (p | q).sum())
    cut = raster(map(tuple, runs.clip(runs.combine(a), 15, 10).collect()))
    assert all((m == ra[k])[20:30, 20:35].all() and m.sum() == m[20:30, 20:35].sum() for k, m in cut.items())


def test_equal_masks_have_equal_ids(spark):
    rows = [(1, 0, 0, 2, 2, 4, 3), (1, 0, 1, 2, 2, 4, 2), (1, 0, 1, 2, 4, 4, 1), (1, 5, 7, 2, 2, 2, 3), (1, 5, 7, 3, 2, 3, 3), (1, 0, 3, 3, 2, 4, 3)]
    named, once = runs.keyed(runs.combine(runs.of_boxes(spark.createDataFrame(rows, RECT))))
    ids = {(r.frame, r.det_id): r.mask_id for r in named.collect()}
    assert ids[0, 0] == ids[0, 1] == ids[5, 7] != ids[0, 3]
    assert once.count() == 6 and once.select("mask_id").distinct().count() == 2


def test_polygons_and_bits(spark):
    rng = random.Random(8)
    rows = [(1, 0, i, [(rng.uniform(-3, 30), rng.choice([rng.uniform(-3, 30), float(rng.randint(0, 20)), rng.randint(0, 20) + 0.5])) for _ in range(rng.randint(3, 8))]) for i in range(40)]
    rows += [(1, 0, 90, [(1.0, 1.0), (5.0, 5.0)]), (1, 0, 91, None), (1, 0, 92, [(0.0, 0.5), (4.0, 0.5), (4.0, 2.5), (0.0, 2.5)])]
    made = runs.of_polygons(spark.createDataFrame(rows, "video_id long, frame long, det_id long, points array<struct<x:double,y:double>>"))
    got = {k[2]: m for k, m in raster(map(tuple, made.collect())).items()}
    for _, _, i, points in rows:
        shifted = [(x + 20, y + 20) for x, y in points or ()]
        want = pixels.polygon(shifted, 60, 60) if len(shifted) > 2 else np.zeros((60, 60), bool)
        assert (got.get(i, np.zeros((60, 60), bool)) == want).all(), i
    masks = {i: np.random.default_rng(i).random((7, 11)) < 0.5 for i in range(5)}
    given = [(1, 0, i, 3, 2, 11, 7, bytearray(pixels.pack(m))) for i, m in masks.items()] + [(1, 0, 8, 0, 0, 3, 3, None), (1, 0, 9, 0, 0, 0, 0, bytearray())]
    back = raster(map(tuple, runs.of_bits(spark.createDataFrame(given, RECT + ", bits binary")).collect()))
    assert {k[2] for k in back} == set(masks) and all((back[1, 0, i][22:29, 23:34] == m).all() for i, m in masks.items())


def test_fused_masks(spark):
    """Runs of kept boxes with those they suppressed, as the bitmaps are joined."""
    rng = random.Random(9)
    given = []
    for i in range(6):
        w, h = rng.randint(1, 9), rng.randint(1, 9)
        given.append((1, 0, i, rng.randint(0, 9), rng.randint(0, 9), w, h, bytearray(pixels.pack(np.random.default_rng(i).random((h, w)) < 0.6))))
    masks = spark.createDataFrame(given, RECT + ", bits binary")
    owners = spark.createDataFrame([(1, 0, i, i // 3 * 3) for i in range(6)], "video_id long, frame long, det_id long, kept_id long")
    got = raster(map(tuple, runs.fused(runs.of_bits(masks), owners).collect()))
    for r in pixels.fuse_masks(masks, owners).collect():
        want = np.zeros((60, 60), bool)
        want[r.y + 20 : r.y + 20 + r.h, r.x + 20 : r.x + 20 + r.w] = pixels.unpack(r.bits, r.w, r.h)
        assert (got[1, 0, r.det_id] == want).all()


def test_crop(spark):
    image = np.random.default_rng(3).integers(0, 256, (6, 8, 3), np.uint8)
    frames = spark.createDataFrame([(1, 0, 8, 6, bytearray(image.tobytes())), (1, 1, 8, 6, None), (1, 2, 8, 6, bytearray(b"short"))], "video_id long, frame long, width int, height int, pixels binary")
    regions = spark.createDataFrame([(1, 0, 0, 2, 1, 3, 4), (1, 0, 1, -2, -1, 4, 3), (1, 0, 2, 6, 4, 9, 9), (1, 0, 3, 8, 0, 2, 2), (1, 0, 4, 0, 0, 0, 3), (1, 1, 5, 0, 0, 2, 2), (1, 2, 6, 0, 0, 2, 2)], RECT)
    got = {r.det_id: r for r in runs.crop(frames, regions).collect()}
    assert sorted(got) == [0, 1, 2]
    for r in got.values():
        assert bytes(r.pixels) == image[r.y : r.y + r.h, r.x : r.x + r.w].tobytes()
    assert [(got[1].x, got[1].y, got[1].w, got[1].h), (got[2].w, got[2].h)] == [(0, 0, 2, 2), (2, 2)]


def test_pixels_made_from_keys_do_not_travel(spark):
    """Queries whose pixels follow from keys make them where regions lie: no join, and one exchange, of detections."""
    from trackloom.plans import queries as plans

    for name in ("redact_gaussian", "redact_pixelate", "redact_blackout", "redact_polygon", "region_crop"):
        plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1, name


def test_frames_bring_their_regions(spark):
    from trackloom.operators import pixels

    frames = spark.createDataFrame([(1, n, 4, 2, bytes(range(24))) for n in range(3)], "video_id long, frame long, width int, height int, pixels binary")
    regions = spark.createDataFrame([(1, 0, 1, 0, 2, 1), (1, 0, 0, 0, 1, 1), (1, 2, 3, 1, 9, 9)], "video_id long, frame long, x int, y int, w int, h int")
    want = sorted(map(tuple, pixels.redact(frames, regions, "blackout", 3).collect()))
    own = frames.join(pixels.gathered(regions), ["video_id", "frame"], "left")
    got = pixels.redact(own, None, "blackout", 3)
    assert sorted(map(tuple, got.collect())) == want and [r[-1] for r in want] == [3, 0, 1]


def test_pairs_travel_by_frame(spark):
    """Pairs of boxes take no exchange behind the detections' own; no row travels once for each of its cells."""
    from trackloom.plans import queries as plans

    plan = plans.QUERIES["iou_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    plan = plans.QUERIES["pair_gate"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "_c" in line.partition("hashpartitioning")[2]]


def test_numbers_of_detections_travel_alone(spark):
    """What follows from a line is made behind the exchange: the six columns of the order and two keys go through it."""
    from trackloom.sources import tables

    plan = tables.detections(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
    text = plan.toString()
    exchange = text[text.index("Exchange") :]
    assert "% 17" not in exchange and "/ 50.0) AS" not in exchange


@pytest.mark.parametrize("crowd", [1, 4, 64])
def test_crowded_frames_split(spark, crowd, monkeypatch):
    """Parts of a crowded frame give the pairs of the whole one, each once."""
    monkeypatch.setattr(assign, "CROWD", crowd)
    test_overlapping_pairs(spark, 0.4, 1.0)
    test_gated_pairs(spark, 0.05)


def test_crossings_stay_with_their_polygons(spark):
    """Polygons take no exchange behind the detections' own, and no window over their crossings."""
    from trackloom.plans import queries as plans

    plan = plans.QUERIES["mask_polygon_runs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Window [") == 1


def test_lists_are_made_once_a_frame(spark):
    """Entries by place; only the first detection of a frame makes the lists."""
    from trackloom.operators import detect

    dets = spark.createDataFrame([(1, f, i) for f in (3, 5, 9) for i in range(3)], "video_id long, frame long, det_id long")
    shifts, shapes = F.array(F.array(F.col("video_id"), F.lit(2)), F.array(F.lit(3))), F.array(F.array(F.lit(4), F.lit(5)))
    made = detect.paired(dets, shifts, shapes, F.lit(7), F.lit(8))
    got = {(r.frame, r.shift_x, r.shift_y, r.full_height, r.full_width) for r in made.collect()}
    assert got == {(3, 1, 2, 4, 5), (5, 0, 0, 8, 7), (9, 0, 0, 8, 7)} and made.count() == 9
    assert "_fresh" in made._jdf.queryExecution().executedPlan().toString()


def test_regions_make_their_own_rows_of_pixels(spark):
    """Rows made from a smaller source give the pixels of the whole frame's; no digest is asked for before the exchange."""
    from trackloom.plans import queries as plans

    image = np.random.default_rng(5).integers(0, 256, (6, 8, 3), np.uint8)
    regions = [(1, 0, 0, 2, 1, 3, 4), (1, 0, 1, -2, -1, 4, 3), (1, 0, 2, 6, 4, 9, 9), (1, 0, 3, 8, 0, 2, 2), (1, 0, 4, 0, 0, 0, 3)]
    met = spark.createDataFrame([(*r, 8, 6, bytearray(image.tobytes()), image.tobytes().hex()) for r in regions], RECT + ", width int, height int, pixels binary, code string")
    want = sorted(map(tuple, runs.cut(met.drop("code")).collect()))
    made = runs.cut(met.drop("pixels"), "code", lambda at, y: at.substr(48 * y + 1, F.lit(48))).drop("code")
    assert len(want) == 3 and sorted(map(tuple, made.collect())) == want
    plan = plans.region_crop(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "md5" in plan and "md5" not in plan[plan.index("Exchange") :]


def test_pictures_are_made_by_many_tasks(spark):
    """Keys of frames are far smaller than their pictures, so a fixed number of partitions makes these, not one sized by keys."""
    from trackloom.plans import queries as plans

    plan = plans._frames(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("md5") < plan.index("REPARTITION_BY_NUM") and "md5" not in plan[plan.index("REPARTITION_BY_NUM") :]
    plan = plans.hybrid_pictures(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan[plan.rindex("md5") :].split("+- ")[1]
