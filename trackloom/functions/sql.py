"""Box functions for SQL text, as SQL functions: the optimiser sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

_AB = "ax1 DOUBLE, ay1 DOUBLE, ax2 DOUBLE, ay2 DOUBLE, bx1 DOUBLE, by1 DOUBLE, bx2 DOUBLE, by2 DOUBLE"
_INNER = "(greatest(0D, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0D, least(ay2, by2) - greatest(ay1, by1)))"
_UNION = f"((ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - {_INNER})"

FUNCTIONS = {
    "box_iou": (_AB, "DOUBLE", f"CASE WHEN {_UNION} > 0 THEN {_INNER} / {_UNION} ELSE 0D END"),
    "box_distance": (_AB, "DOUBLE", "sqrt(pow((ax1 + ax2 - bx1 - bx2) / 2, 2) + pow((ay1 + ay2 - by1 - by2) / 2, 2))"),
    "score_pool": ("score DOUBLE, low DOUBLE, high DOUBLE", "STRING", "CASE WHEN score >= high THEN 'high' WHEN score >= low THEN 'low' ELSE 'none' END"),
    "clipped_sigmoid": ("x DOUBLE", "DOUBLE", "1 / (1 + exp(-least(greatest(x, -64D), 64D)))"),
}


def register(spark: SparkSession) -> list[str]:
    """Temporary functions of this session; returns their names."""
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)


_BOX = "STRUCT<det_id: BIGINT, x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE, confidence: DOUBLE>"
_KB = "(greatest(0D, least(k.x2, b.x2) - greatest(k.x1, b.x1)) * greatest(0D, least(k.y2, b.y2) - greatest(k.y1, b.y1)))"
_KB_UNION = f"((k.x2 - k.x1) * (k.y2 - k.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_KB})"
_FIRST = "array_sort(boxes, (a, b) -> CASE WHEN a.confidence <=> b.confidence THEN CAST(sign(b.det_id - a.det_id) AS INT) WHEN b.confidence IS NULL OR a.confidence > b.confidence THEN -1 ELSE 1 END)"


def register_arrays(spark: SparkSession) -> list[str]:
    """``nms_kept(boxes, threshold)`` for SQL text: of an array of boxes those that suppression keeps, best first.

    ``SELECT video_id, frame, inline(nms_kept(collect_list(named_struct('det_id', det_id, 'x1', x1, ...)), 0.3D))`` by group
    gives the boxes of :func:`nms.suppress` without a Python worker. Null gives null, no boxes give none.
    """
    body = f"aggregate({_FIRST}, CAST(array() AS ARRAY<{_BOX}>), (kept, b) -> CASE WHEN exists(kept, k -> {_KB_UNION} > 0 AND {_KB} / {_KB_UNION} > threshold) THEN kept ELSE array_append(kept, b) END)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION nms_kept(boxes ARRAY<{_BOX}>, threshold DOUBLE) RETURNS ARRAY<{_BOX}> RETURN {body}")
    return ["nms_kept"]


def register_tables(spark: SparkSession) -> list[str]:
    """Table functions ``track`` and ``nms`` for SQL text; returns their names.

    ``SELECT * FROM track(TABLE(dets) PARTITION BY video_id ORDER BY (frame, det_id), 'bytetrack')`` gives the rows of
    :func:`trackers.track`; ``nms(TABLE(dets) PARTITION BY (video_id, frame, object_class) ORDER BY (confidence DESC,
    det_id DESC), 0.3e0)`` the ``video_id, frame, det_id`` of the boxes that :func:`nms.suppress` keeps. The partitioning is the
    caller's, as in the operators: a call holds one video's tracks, or one group's kept boxes. Columns are found by name.
    Whole tables go faster through the operators.
    """
    import numpy as np
    from pyspark.sql.functions import udtf

    from trackloom.operators import motion, trackers

    @udtf(returnType=trackers.OUTPUT)
    class Track:
        def __init__(self) -> None:
            self.state, self.rows, self.video, self.frame, self.kind = trackers.Tracks(), [], None, None, "sort"

        def _step(self):
            columns = {c: np.array([r[c] for r in self.rows]) for c in ("x1", "y1", "x2", "y2", "confidence")}
            columns["is_confident"] = np.array([r["is_confident"] is not False for r in self.rows])
            found = trackers.step(self.kind, trackers.settings(self.kind), self.state, self.frame, trackers._frame_of(columns))
            self.rows = []
            yield from trackers._rows_of(self.video, self.frame, found, [])

        def eval(self, row, kind: str = "sort"):
            self.kind = kind.lower()
            if self.rows and row["frame"] != self.frame:
                yield from self._step()
            self.video, self.frame = row["video_id"], row["frame"]
            self.rows.append(row.asDict())

        def terminate(self):
            if self.rows:
                yield from self._step()

    @udtf(returnType="video_id long, frame long, det_id long")
    class Suppress:
        def __init__(self) -> None:
            self.kept = np.zeros((0, 4))

        def eval(self, row, threshold: float = 0.3):
            box = np.array([[row["x1"], row["y1"], row["x2"] - row["x1"], row["y2"] - row["y1"]]])
            if not (motion.overlaps(box, self.kept) > threshold).any():
                self.kept = np.concatenate([self.kept, box])
                yield row["video_id"], row["frame"], row["det_id"]

    found = {"track": Track, "nms": Suppress}
    for name, function in found.items():
        spark.udtf.register(name, function)
    return list(found)
