"""Pairs within reach, found by a grid, and the best one-to-one choice among them, component by component."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.motion import assign
from trackloom.sources.shared import keep

FRAME = ("video_id", "frame")
PAIR = (*FRAME, "track_id", "det_id")
#: Detections of a component up to which sets of them are tried on the JVM; larger ones take augmenting paths.
SMALL = 5
#: Boxes of a frame that meet one another without a raster.
CROWD = 64


def _listed(df: DataFrame, keys: Sequence[str], row: Sequence[str | Column], name: str) -> DataFrame:
    """The rows of a key as one list of structs."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.collect_list(F.struct(*row)).alias(name))


def _parts(lists: DataFrame, side: Column) -> DataFrame:
    """``side`` x ``side`` parts ``_px, _py`` of each row; a small one stays whole."""
    strip = F.explode(F.sequence(F.lit(0), F.col("_g") - 1))
    return lists.withColumn("_g", side.cast("int")).withColumn("_px", strip).withColumn("_py", strip)


def near(a: DataFrame, b: DataFrame, keys: Sequence[str], gate: float, at: Sequence[Column], to: Sequence[Column]) -> DataFrame:
    """``keys`` and, as structs ``a`` and ``b``, the other columns of rows with equal keys whose points ``at`` and ``to`` may
    lie within the gate.

    Points fall into cells a little wider than the gate; one of ``a`` meets those of ``b`` in its own and the eight
    cells around, each once. So pairs grow with what is near, not with the square of a frame's boxes. Each table is dealt
    by its keys once, with the boxes of a frame in one row; a crowded frame splits by cells where it lies.
    """
    width = max(gate, 1e-9) * (1 + 1e-9)
    cell = lambda point: [F.floor(v / width).alias(f"_c{c}") for v, c in zip(point, "xy", strict=True)]
    one, two = (_listed(df, keys, [*(c for c in df.columns if c not in keys), *cell(point)], name) for df, point, name in ((a, at, "_a"), (b, to, "_b")))
    met = one.join(two, list(keys))
    few = F.size("_a").cast("long") * F.size("_b") <= CROWD * CROWD
    met = _parts(met, F.when(few, 1).otherwise(F.ceil(F.sqrt(F.greatest(F.size("_a"), F.size("_b")) / CROWD)) + 2))
    whole, around = F.col("_g") == 1, lambda r, c: F.pmod(F.col(f"_p{c}") - r[f"_c{c}"] + 1, F.col("_g")) <= 2
    own = F.filter("_a", lambda r: (F.pmod(r["_cx"], F.col("_g")) == F.col("_px")) & (F.pmod(r["_cy"], F.col("_g")) == F.col("_py")))
    met = met.select(*keys, F.when(whole, F.col("_a")).otherwise(own).alias("_a"), F.when(whole, F.col("_b")).otherwise(F.filter("_b", lambda r: around(r, "x") & around(r, "y"))).alias("_b"))
    pairs = met.select(*keys, F.explode("_a").alias("a"), "_b").select(*keys, "a", F.explode("_b").alias("b"))
    return pairs.where(" AND ".join(f"b._c{c} - a._c{c} BETWEEN -1 AND 1" for c in "xy"))


def touching(df: DataFrame, keys: Sequence[str], grid: int = 16, extent: float = 1.0) -> DataFrame:
    """``keys`` and pairs of boxes (structs ``a`` and ``b`` of ``det_id`` and corners, the lower ``det_id`` first) with equal
    keys that share area, each pair once.

    The boxes of a group are one list. A crowded one splits where it lies, by a raster of up to ``grid`` x ``grid`` cells: a
    box lies in all cells that it covers, what lies beyond ``extent`` counts to the outermost ones, and a pair is met
    in the cell where its common part begins.
    """
    lists = _listed(df.where("x2 > x1 AND y2 > y1"), keys, ("det_id", "x1", "y1", "x2", "y2"), "_b").where("size(_b) > 1")
    part = _parts(lists, F.when(F.size("_b") <= CROWD, 1).otherwise(F.least(F.lit(grid), F.ceil(F.sqrt(F.size("_b") * 4 / CROWD)))))
    whole = F.col("_g") == 1
    cell = lambda v: F.least(F.greatest(F.floor(v * F.col("_g") / extent), F.lit(0)), F.col("_g") - 1)
    within = lambda r, c: (cell(r[f"{c}1"]) <= F.col(f"_p{c}")) & (cell(r[f"{c}2"]) >= F.col(f"_p{c}"))
    part = part.withColumn("_b", F.when(whole, F.col("_b")).otherwise(F.filter("_b", lambda r: within(r, "x") & within(r, "y"))))
    pairs = part.withColumn("a", F.explode("_b")).withColumn("b", F.explode("_b"))
    pairs = pairs.where("a.det_id < b.det_id AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2")
    first = [cell(F.greatest(f"a.{c}1", f"b.{c}1")) == F.col(f"_p{c}") for c in "xy"]
    return pairs.where(whole | (first[0] & first[1])).select(*keys, "a", "b")


def components(pairs: DataFrame, rounds: int = 4) -> DataFrame:
    """``pairs`` with ``component``: the least track of the tracks and detections of a frame that pairs connect.

    Labels pass over tracks and detections in turn, ``rounds`` times a step, until a step changes none. Frames are dealt
    once a step; the windows within need no further exchange.
    """
    while True:
        again = pairs if "component" in pairs.columns else pairs.withColumn("component", F.col("track_id"))
        again = again.withColumn("_before", F.col("component")).repartition(*FRAME)
        for _ in range(rounds):
            for side in ("track_id", "det_id"):
                again = again.withColumn("component", F.min("component").over(Window.partitionBy(*FRAME, side)))
        again = keep(again.withColumn("_moved", F.col("component") < F.col("_before")))
        pairs = again.drop("_before", "_moved")
        if again.where("_moved").isEmpty():
            return pairs


def choose(pairs: DataFrame, gate: float) -> DataFrame:
    """The pairs of the best one-to-one choice in each frame: each pair ``video_id, frame, track_id, det_id, cost`` within
    the gate saves ``gate + 10 - cost``, and what is chosen saves most.

    A frame's choice is that of its components. One of up to ``SMALL`` detections is a fold over its tracks that keeps, for
    every set of detections, the best way to take it; larger ones take augmenting paths, a component a task's group. Of
    equally good choices a small component takes the one whose pairs come first. Repeated pairs count once, at their least
    cost; null ids and costs, and costs beyond the gate, leave a pair out.
    """
    once = pairs.where(F.col("cost") <= gate).dropna(subset=list(PAIR)).groupBy(*PAIR).agg(F.min("cost").alias("cost"))
    found = components(once)
    group = (*FRAME, "component")
    sized = found.withColumn("_at", F.dense_rank().over(Window.partitionBy(*group).orderBy("det_id")) - 1)
    sized = keep(sized.withColumn("_n", F.max("_at").over(Window.partitionBy(*group)) + 1))
    rows = sized.where(F.col("_n") <= SMALL).groupBy(*group, "_n", "track_id").agg(F.array_sort(F.collect_list(F.struct("det_id", "_at", "cost"))).alias("edges"))
    grouped = rows.groupBy(*group, "_n").agg(F.array_sort(F.collect_list(F.struct("track_id", "edges"))).alias("tracks"))
    state = "struct(double(0) AS cost, array_repeat(struct(bigint(0) AS track_id, bigint(0) AS det_id, double(0) AS cost), 0) AS picks, 0 AS taken)"
    grown = f"""flatten(transform(acc, s -> transform(filter(t.edges, e -> s.taken & shiftleft(1, e._at) = 0),
        e -> struct(s.cost + e.cost - {gate + 10!r}D AS cost, array_append(s.picks, struct(t.track_id AS track_id, e.det_id AS det_id, e.cost AS cost)) AS picks, s.taken | shiftleft(1, e._at) AS taken))))"""
    best = f"""aggregate(tracks, array({state}), (acc, t) -> transform(array(concat(acc, {grown})),
        g -> filter(transform(sequence(0, shiftleft(1, _n) - 1), k -> array_min(filter(g, s -> s.taken = k))), s -> s IS NOT NULL))[0])"""
    small = grouped.select(*group, F.array_min(F.expr(best))["picks"].alias("picks")).select(*group, F.inline("picks"))

    def paths(rows):
        import pyarrow as pa

        data = {c: np.asarray(rows.column(c).to_pylist()) for c in ("track_id", "det_id", "cost")}
        (ids, r), (dets, c) = (np.unique(data[k], return_inverse=True) for k in ("track_id", "det_id"))
        cost = np.full((len(ids), len(dets)), gate + 10.0)
        cost[r, c] = data["cost"]
        real = {*zip(r.tolist(), c.tolist(), strict=True)}
        pick = [(ids[i], dets[j], cost[i, j]) for i, j in assign(cost) if (i, j) in real]
        key = [pa.array([rows.column(k)[0].as_py()] * len(pick), pa.int64()) for k in group]
        return pa.table([*key, *(pa.array([p[k] for p in pick], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64())))], names=[*group, "track_id", "det_id", "cost"])

    large = sized.where(F.col("_n") > SMALL).select(*group, "track_id", "det_id", "cost").groupBy(*group)
    return small.unionByName(large.applyInArrow(paths, "video_id long, frame long, component long, track_id long, det_id long, cost double"))
