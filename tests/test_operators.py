"""The relational operators: known values, properties, and every query against its SQL."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trackloom import config
from trackloom.functions import boxes as B
from trackloom.functions import text as X
from trackloom.functions.boxes import Box
from trackloom.operators import detect, jobs, nms
from trackloom.operators import tracks as tr
from trackloom.plans import queries as plans
from trackloom.schema import DETECTION, detections

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, duck, same, name):
    same(plans.queries()[name](spark, DATA).toPandas(), duck(plans.oracle_sql()[name], DATA))


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert plans.queries()[name](spark, DATA).limit(5).count() == 5


def one(spark, **columns):
    return spark.range(1).select(*(v.alias(k) for k, v in columns.items())).first()


def lit_box(*v):
    return Box(*(F.lit(float(x)) for x in v))


def test_known_values(spark):
    r = one(spark, iou=B.iou(lit_box(0, 0, 20, 20), lit_box(5, 5, 20, 20)), none=B.iou(lit_box(0, 0, 1, 1), lit_box(2, 2, 3, 3)), empty=B.iou(lit_box(0, 0, 0, 0), lit_box(0, 0, 0, 0)))
    assert (r.iou, r.none, r.empty) == (225 / 400, 0, 0)
    r = one(spark, **dict(zip("xywh", B.roi(lit_box(0.1, 0.1, 0.3, 0.3), F.lit(200), F.lit(100)), strict=True)))
    assert tuple(r) == (20, 10, 40, 20)
    r = one(spark, **B.relative(B.unletterbox(Box.centred(F.lit(150.0), F.lit(100.0), F.lit(120.0), F.lit(80.0)), 10.0, 10.0, 0.5, 0.5, 200.0, 200.0), F.lit(200), F.lit(200)).columns())
    assert tuple(r) == (0.8, 0.5, 1.0, 1.0)
    r = one(spark, **B.downscale(F.lit(400), F.lit(200), 256))
    assert (r.new_width, r.new_height) == (256, 128)
    r = one(spark, **dict(zip("xywh", B.inflate(F.lit(10), F.lit(10), F.lit(20), F.lit(10), 1.2, F.lit(100), F.lit(100)), strict=True)))
    assert tuple(r) == (8, 9, 24, 12)
    r = one(spark, gone=B.clamp_pixels(F.lit(200), F.lit(0), F.lit(5), F.lit(5), F.lit(100), F.lit(100))[0])
    assert r.gone is None
    back = B.from_xyah(*B.xyah(lit_box(0.1, 0.2, 0.5, 0.4))).columns()
    assert [round(v, 12) for v in one(spark, **back)] == [0.1, 0.2, 0.5, 0.4]


def test_text_rules(spark):
    r = one(spark, a=X.class_list(F.lit(" Plate,, HEAD ")), b=X.default_blur(F.array(F.lit("Plate"), F.lit("dog")), F.array(F.lit("head"), F.lit("PLATE"))), c=X.blurred_name(F.lit("a.b/c.mp4")), d=X.input_size(F.lit("1281_x")), e=X.input_size(F.lit("best")), f=X.safe_name(F.lit("../a b.onnx")), g=X.cache_key(F.create_map(F.lit("z"), F.lit("1"), F.lit("a"), F.lit("2"))), h=X.progress_message(F.lit("p"), F.lit(2.0), F.lit(7400)))
    assert r.a == ["plate", "head"] and r.b == ["plate"] and r.c == "a.b/c_blurred.mp4" and (r.d, r.e) == (1312, 640)
    names = one(spark, n=X.class_names(F.create_map(*(F.lit(x) for x in ("10", "c", "2", "b", "1", "a")))), t=X.class_names(F.create_map(*(F.lit(x) for x in ("10", "c", "x", "b", "1", "a")))))
    assert tuple(names) == (["a", "b", "c"], ["a", "c", "b"])
    assert (r.f, r.g, r.h) == (".._a_b.onnx", "a=2|z=1", "p | 2.00fps | eta 1:01:40")


def test_optional_columns(spark):
    df = detections(spark.createDataFrame([(1, 2, 3, 0.0, 0.0, 1.0, 1.0, 0.4)], "video_id long, frame long, det_id long, x1 double, y1 double, x2 double, y2 double, confidence double"))
    assert df.schema == DETECTION or [f.name for f in df.schema] == DETECTION.names
    assert df.first().is_confident and df.first().mask is None


def test_allowed_classes():
    names = ["bike", "head", "person"]
    assert detect.allowed_classes(None, names) is None and detect.allowed_classes(["*"], names) is None
    assert detect.allowed_classes([" HEAD", "2", "7", "cat"], names) == [1, 2]
    assert detect.allowed_classes(["cat"], names) == []


boxes_ = st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9), st.integers(1, 6), st.integers(1, 6), st.integers(0, 4), st.integers(0, 1)), min_size=1, max_size=14)


@given(st.lists(boxes_, min_size=1, max_size=4))
@settings(max_examples=8, deadline=None)
def test_suppression_is_greedy(spark, frames):
    rows = [(1, f, i, x / 10, y / 10, (x + w) / 10, (y + h) / 10, s / 4, c, True) for f, found in enumerate(frames) for i, (x, y, w, h, s, c) in enumerate(found)]
    df = spark.createDataFrame(rows, "video_id long, frame long, det_id long, x1 double, y1 double, x2 double, y2 double, confidence double, object_class long, is_confident boolean")

    def iou(a, b):
        w, h = max(0.0, min(a[5], b[5]) - max(a[3], b[3])), max(0.0, min(a[6], b[6]) - max(a[4], b[4]))
        return w * h / ((a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - w * h)

    kept = []
    for r in sorted(rows, key=lambda r: (-r[7], -r[2])):
        if all(k[1] != r[1] or k[8] != r[8] or iou(k, r) <= 0.3 for k in kept):
            kept.append(r)
    got = nms.suppress(df)
    assert sorted((r.frame, r.det_id) for r in got.collect()) == sorted((r[1], r[2]) for r in kept)
    assert nms.suppress(got).count() == got.count()


def test_parts_of_one_object_merge(spark):
    found = [(1, 1, 0, 0.0, 0.0, 0.4, 0.4, 0.9, 0, True), (1, 1, 1, 0.2, 0.0, 0.6, 0.4, 0.8, 0, False), (1, 1, 2, 0.35, 0.0, 0.75, 0.4, 0.7, 0, False), (1, 1, 3, 0.0, 0.0, 0.4, 0.4, 0.6, 1, True), (1, 2, 4, 0.9, 0.9, 0.9, 0.9, 0.5, 0, None)]
    df = spark.createDataFrame(found, "video_id long, frame long, det_id long, x1 double, y1 double, x2 double, y2 double, confidence double, object_class long, is_confident boolean")
    got = {r.det_id: (r.x1, r.x2, r.confidence, r.n_parts, r.object_class) for r in nms.combine(df).collect()}
    assert got == {0: (0.0, 0.75, 0.9, 3, 0), 3: (0.0, 0.4, 0.6, 1, 1), 4: (0.9, 0.9, 0.5, 1, 0)}
    got = nms.combine(df.where("frame = 1"), keys=("video_id", "frame")).collect()
    assert [(r.det_id, r.n_parts, r.object_class) for r in got] == [(0, 4, 0)]
    assert nms.combine(df.where("frame = 9")).count() == 0


def test_filters_reach_the_scan_below_suppression(spark):
    plan = nms.suppress(plans.S.detections(spark, DATA)).where("video_id = 3")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_suppkey,3)" in plan


def test_gaps_are_filled_and_not_redacted(spark):
    df = spark.createDataFrame([(1, 1, f, f / 100, 0.1, f / 100 + 0.1, 0.2, 1.0) for f in (0, 1, 5, 6)], "video_id long, track_id long, frame long, x1 double, y1 double, x2 double, y2 double, score double")
    got = tr.fill_gaps(df).orderBy("frame").collect()
    assert [(r.frame, round(r.x1, 9), r.should_blur) for r in got] == [(2, 0.02, False), (3, 0.03, False), (4, 0.04, False)]


def test_throttle_sequence(spark):
    at = [0.0, 0.0, 0.0, 2.1, 2.1, 2.1, 4.2, 4.2]
    rows = [(1, i, float(p), t) for i, (p, t) in enumerate(zip((0, 2, 5, 6, 6, 6, 6, 100), at, strict=True))]
    df = spark.createDataFrame(rows, "job_id long, sequence long, progress double, t double").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    assert [r.sequence for r in jobs.throttled(df).orderBy("sequence").collect()] == [0, 2, 3, 6, 7]


def test_layers(tmp_path):
    first = {"tracking": {"kind": "bytetrack", "params": {"gate": 0.2}}, "blur.strength": 21, "detection__confidence": 0.6, "video": {"quality": None}}
    c = config.resolve(first)
    assert (c.tracking.settings().gate, c.blur.strength, c.detection.confidence) == (0.2, 21, 0.6)
    assert config.resolve(first, {"tracking.kind": "botsort"}).tracking.settings().gate == 0.4
    (tmp_path / "c.toml").write_text(config.to_toml(c))
    assert config.load(tmp_path / "c.toml") == c
    assert config.resolve({"model.name": "x_b1.onnx"}).detection.batch_size == 1
    for bad in ({"blur.strength": 0}, {"what": {}}, {"blur.what": 1}, {"tracking.kind": "none"}, {"tracking.base": "dummy"}, {"tracking.weight": 2}, {"detection.confidence": 2}):
        with pytest.raises(ValueError):
            config.resolve(bad)


def test_every_kind_runs_by_its_settings(spark):
    """Any case counts; links join what a gap broke, and fill it."""
    rows = [(1, f, 0, 0.1 + 0.004 * f, 0.1, 0.2 + 0.004 * f, 0.2, 0.9, True) for f in range(45) if not 20 <= f < 24]
    given = spark.createDataFrame(rows, "video_id long, frame long, det_id long, x1 double, y1 double, x2 double, y2 double, confidence double, is_confident boolean")
    for kind in ("Dummy", "SORT", "Bidirectional"):
        c = config.resolve({"tracking.kind": kind, "tracking.base": "Sort"}).tracking
        got = c.apply(given).collect()
        assert {r.frame for r in got} >= {f for f in range(45) if not 20 <= f < 24} - {0, 1, 44} and len({r.track_id for r in got}) == 1
    assert config.resolve({"tracking.kind": "bidirectional", "tracking.base": "botsort"}).tracking.settings().confirm_after == 3


def test_sql_functions(spark):
    from trackloom.functions import sql

    assert len(sql.register(spark)) == 4
    r = spark.sql("SELECT box_iou(0, 0, 20, 20, 5, 5, 20, 20) AS i, box_iou(0, 0, 0, 0, 0, 0, 0, 0) AS z, box_distance(0, 0, 2, 2, 3, 4, 5, 6) AS d, score_pool(0.3, 0.1, 0.5) AS p, clipped_sigmoid(0) AS s").first()
    assert tuple(r) == (225 / 400, 0, 5, "low", 0.5)


def test_table_functions_for_sql(spark):
    from trackloom.functions import sql
    from trackloom.operators import trackers
    from trackloom.sources import tables

    assert sql.register_tables(spark) == ["track", "nms"]
    dets = tables.detections(spark, DATA).where("video_id < 3")
    dets.createOrReplaceTempView("some_detections")
    kept = spark.sql("SELECT * FROM nms(TABLE(some_detections) PARTITION BY (video_id, frame, object_class) ORDER BY (confidence DESC, det_id DESC), 0.3e0)")
    want = nms.suppress(dets).select("video_id", "frame", "det_id")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, want.collect()))
    got = spark.sql("SELECT * FROM track(TABLE(some_detections) PARTITION BY video_id ORDER BY (frame, det_id), 'ByteTrack')")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, trackers.track(dets, "bytetrack").collect()))


def test_suppression_in_sql_text(spark):
    from trackloom.functions import sql
    from trackloom.sources import tables

    assert sql.register_arrays(spark) == ["nms_kept"]
    dets = tables.detections(spark, DATA)
    dets.createOrReplaceTempView("boxes_of_frames")
    row = ", ".join(f"'{c}', {c}" for c in ("det_id", "x1", "y1", "x2", "y2", "confidence"))
    kept = spark.sql(f"WITH g AS (SELECT video_id, frame, object_class, nms_kept(collect_list(named_struct({row})), 0.3D) AS kept FROM boxes_of_frames GROUP BY ALL) SELECT video_id, frame, object_class, inline(kept) FROM g")
    assert "Python" not in kept._jdf.queryExecution().executedPlan().toString()
    columns = ["video_id", "frame", "object_class", "det_id", "x1", "confidence"]
    assert sorted(kept.select(columns).collect()) == sorted(nms.suppress(dets).select(columns).collect())
    some = "named_struct('det_id', {}L, 'x1', 0D, 'y1', 0D, 'x2', 1D, 'y2', 1D, 'confidence', {})".format
    r = spark.sql(f"SELECT nms_kept(array({some(1, 'CAST(null AS DOUBLE)')}, {some(2, '0.1D')}, {some(3, '0.1D')}), 0.5D) AS a, nms_kept(CAST(array() AS ARRAY<STRUCT<det_id: BIGINT, x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE, confidence: DOUBLE>>), 0.5D) AS b, nms_kept(null, 0.5D) AS c").first()
    assert ([k.det_id for k in r.a], r.b, r.c) == ([3], [], None)


def test_slots_are_sorted_twice(spark):
    """Ids as a plain loop gives them: frames without sure boxes end runs, flags may be null, numbers of boxes have gaps."""
    rng, rows, want = random.Random(4), [], {}
    for video in range(6):
        ids, before, live = 0, 0, {}
        for frame in sorted(rng.sample(range(40), 25)):
            sure = 0
            for k in range(rng.randrange(1, 6)):
                flag = rng.choice([True, True, False, None])
                rows.append((video, frame, 3 * k + 1, 0.1, 0.1, 0.2, 0.2, 0.9, flag, 1))
                if flag:
                    if sure >= before:
                        ids += 1
                        live[sure] = ids
                    want[video, frame, 3 * k + 1] = live[sure]
                    sure += 1
            before = sure
    schema = "video_id long, frame long, det_id long, x1 double, y1 double, x2 double, y2 double, confidence double, is_confident boolean, object_class long"
    found = tr.slots(spark.createDataFrame(rows, schema).repartition(3))
    assert {(r.video_id, r.frame, r.det_id): r.track_id for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert (plan.count("Sort ["), plan.count("Exchange hashpartitioning")) == (2, 1)
