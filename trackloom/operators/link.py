"""Offline linking: fragments of one object become one track, pair by pair, best first."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators import tracks as tr

#: Limits that hold whatever the settings say, and how much of either end counts.
MAX_GAP, MAX_ERROR, MAX_BEND, STEPS, ENDS = 30, 0.05, 0.02, 5, 6


def _ends(tracks: DataFrame) -> DataFrame:
    """The first and last observations of each track, as arrays of ``frame, center_x, center_y``; nothing between."""
    up, down = Window.partitionBy(*tr.TRACK).orderBy("frame"), Window.partitionBy(*tr.TRACK).orderBy(F.desc("frame"))
    ranked = tr.centres(tracks).withColumns({"i": F.row_number().over(up), "j": F.row_number().over(down)}).where(f"i <= {ENDS} OR j <= {ENDS}")
    point = F.struct("frame", "center_x", "center_y")
    take = lambda c: F.array_sort(F.collect_list(F.when(F.col(c) <= ENDS, point)))
    return ranked.groupBy(*tr.TRACK).agg(take("i").alias("head"), take("j").alias("tail"))


def scores(pairs: DataFrame) -> DataFrame:
    """``error``, the mean error of the forward prediction a frame, and ``bend``, how much the joined path bends.

    ``tail`` and ``head`` are the last observations of one track and the first of the next, as arrays of ``frame,
    center_x, center_y``. The bend is what a parabola leaves of the path (root mean square of the worse coordinate), or the
    worst error of a prediction if that is more; it is infinite where one is over 1. The parabola comes from sums over the
    path, in terms that are orthogonal over its frames, so nothing leaves the JVM.
    """
    norm = lambda x, y: f"sqrt(({x}) * ({x}) + ({y}) * ({y}))"
    rate = lambda p, q, c: f"(g.{q}.center_{c} - g.{p}.center_{c}) / nullif(g.{q}.frame - g.{p}.frame, 0)"
    total = lambda v: f"aggregate(g.pts, 0D, (s, o) -> s + {v})"
    plain = lambda side: f"transform(g.{side}, o -> struct(double(o.frame) AS t, o.center_x AS x, o.center_y AS y))"
    between = ", ".join(f"g.t.center_{c} * (1 - k / g.gap) + g.h.center_{c} * (k / g.gap) AS {c}" for c in "xy")
    ahead = norm(*(f"g.t.center_{c} + g.b{c} * (g.gap + k + 1) - o.center_{c}" for c in "xy"))
    back = norm(*(f"g.h.center_{c} - g.a{c} * (k + 1) - o.center_{c}" for c in "xy"))
    curve = "(o.t * o.t - g.s3 / g.s2 * o.t - g.s2 / g.n)"
    left = lambda c: f"(o.{c} - g.m{c} - g.t{c} / g.s2 * o.t - coalesce(g.c{c} / g.n2, 0D) * {curve})"
    steps = [
        {"p": "element_at(g.tail, 1)", "t": "element_at(g.tail, -1)", "h": "element_at(g.head, 1)", "q": "element_at(g.head, -1)"},
        {"gap": "g.h.frame - g.t.frame", **{f"v{c}": rate("p", "t", c) for c in "xy"}, **{f"w{c}": rate("h", "q", c) for c in "xy"}},
        {**{f"b{c}": f"if({norm('g.vx', 'g.vy')} >= 1e-6D, g.v{c}, 0D)" for c in "xy"}, **{f"a{c}": f"if({norm('g.wx', 'g.wy')} >= 1e-6D, g.w{c}, 0D)" for c in "xy"}},
        {
            "ahead": f"transform(slice(g.head, 1, {STEPS}), (o, k) -> {ahead} / (g.gap + k + 1))",
            "back": f"transform(slice(reverse(g.tail), 1, {STEPS}), (o, k) -> {back} / (k + 1))",
            "path": f"concat({plain('tail')}, if(g.gap > 1, transform(sequence(1L, greatest(g.gap - 1, 1L)), k -> struct(double(g.t.frame + k) AS t, {between})), filter({plain('tail')}, o -> false)), {plain('head')})",
        },
        {"n": "double(size(g.path))", "middle": "aggregate(g.path, 0D, (s, o) -> s + o.t) / size(g.path)", "worst": "greatest(array_max(g.ahead), array_max(g.back))", "error": "aggregate(g.ahead, 0D, (s, v) -> s + v) / size(g.ahead)"},
        {"pts": "transform(g.path, o -> struct(o.t - g.middle AS t, o.x AS x, o.y AS y))"},
        {"s2": total("o.t * o.t"), "s3": total("o.t * o.t * o.t"), **{f"m{c}": f"{total(f'o.{c}')} / g.n" for c in "xy"}, **{f"t{c}": total(f"o.t * o.{c}") for c in "xy"}},
        {"n2": f"nullif({total(f'{curve} * {curve}')}, 0D)", **{f"c{c}": total(f"{curve} * o.{c}") for c in "xy"}},
        {f"r{c}": f"sqrt({total(f'{left(c)} * {left(c)}')} / g.n)" for c in "xy"},
    ]
    # a step names its values in a lambda, so each is written, and computed, once
    found, known = "array(struct(tail AS tail, head AS head))", ["tail", "head"]
    for step in steps:
        found = f"transform({found}, g -> struct({', '.join([*(f'g.{k} AS {k}' for k in known), *(f'{v} AS {k}' for k, v in step.items())])}))"
        known += step
    found = f"transform({found}, g -> struct(g.error AS error, if(g.worst <= 1, if(g.n > 2, greatest(g.rx, g.ry, g.worst), g.worst), double('Infinity')) AS bend))[0]"
    return pairs.withColumn("_score", F.expr(found)).select(*pairs.columns, "_score.error", "_score.bend")


def rated_pairs(tracks: DataFrame, max_gap: int = MAX_GAP, gate: float = 0.4, eligible: int = 10) -> DataFrame:
    """``video_id, prev_id, next_id`` of link candidates with their ``error`` and ``bend``."""
    ends = _ends(tracks)
    a = ends.select(tr.VIDEO, F.col("track_id").alias("prev_id"), "tail")
    b = ends.select(tr.VIDEO, F.col("track_id").alias("next_id"), "head")
    pairs = tr.link_candidates(tracks, min(max_gap, MAX_GAP), gate, eligible).join(a, [tr.VIDEO, "prev_id"]).join(b, [tr.VIDEO, "next_id"])
    return scores(pairs.select(tr.VIDEO, "prev_id", "next_id", "tail", "head")).drop("tail", "head")


def scored_pairs(tracks: DataFrame, max_gap: int = MAX_GAP, gate: float = 0.4, frame_gate: float = MAX_ERROR) -> DataFrame:
    """Rated pairs within the limits."""
    return rated_pairs(tracks, max_gap, gate).where((F.col("error") <= min(frame_gate, MAX_ERROR)) & (F.col("bend") <= MAX_BEND))


def close(error: float, least: float) -> bool:
    """Whether an error counts as the least one, so that the smoother path decides. Fixed values."""
    return error - least <= 1e-8 + 1e-5 * least


def link(tracks: DataFrame, max_gap: int = MAX_GAP, gate: float = 0.4, frame_gate: float = MAX_ERROR) -> DataFrame:
    """``track_id, new_id`` of every track: linked fragments share an id, and ids count from 1 by start frame.

    The best pair links first: of those whose error is close to the least one, the smoothest, then the smaller ids. Both
    scores look at no more than the ends of a fragment, and a fragment that may link has more observations than that, so
    links made don't change the scores of the pairs left; what a link takes away is the end of one fragment and the start
    of another. So the pairs of a video are walked once by error; a task holds the links of one video and the pairs that
    are close to the least one left.
    """
    pairs = scored_pairs(tracks, max_gap, gate, frame_gate)
    columns = [tr.VIDEO, "error", "bend", "prev_id", "next_id"]
    ordered = pairs.repartition(tr.VIDEO).sortWithinPartitions(*columns).select(*columns)

    def chain(batches: Iterator) -> Iterator:
        import pyarrow as pa

        video, parent, ended, near = None, {}, set(), []

        def settle(error: float) -> None:
            """Links made while the least error left is one that ``error`` isn't close to."""
            nonlocal near
            while near and not close(error, near[0][0]):
                _, before, after = min((bend, before, after) for e, bend, before, after in near if close(e, near[0][0]))
                ended.add(before)
                parent[after] = before
                near = [p for p in near if p[2] not in ended and p[3] not in parent]

        def roots() -> pa.RecordBatch:
            settle(float("inf"))
            out = []
            for track in parent:
                root = track
                while root in parent:
                    root = parent[root]
                out.append((video, track, root))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*out, strict=True)) or [()] * 3], names=["video_id", "track_id", "root"])

        for batch in batches:
            for v, error, bend, before, after in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if v != video:
                    yield roots()
                    video, parent, ended, near = v, {}, set(), []
                settle(error)
                if before not in ended and after not in parent:
                    near.append((error, bend, before, after))
        yield roots()

    roots = ordered.mapInArrow(chain, "video_id long, track_id long, root long")
    starts = tracks.groupBy(*tr.TRACK).agg(F.min("frame").alias("start_frame"))
    rooted = starts.join(roots, list(tr.TRACK), "left").withColumn("root", F.coalesce("root", "track_id"))
    first = rooted.groupBy(tr.VIDEO, "root").agg(F.min("start_frame").alias("s"))
    named = first.withColumn("new_id", F.row_number().over(Window.partitionBy(tr.VIDEO).orderBy("s", "root")).cast("long"))
    return rooted.join(named, [tr.VIDEO, "root"]).select(*tr.TRACK, "new_id")
