"""Relational operators over tracks: slots, summaries, renumbering, gaps, velocities, links and merges."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.boxes import Box, centre_distance, dilate, iou
from trackloom.operators.assign import near
from trackloom.schema import BOX

VIDEO = "video_id"
TRACK = (VIDEO, "track_id")


def placed(rows: DataFrame) -> DataFrame:
    """Rows with ``place``, from 0: their order in a video by frame and track."""
    order = Window.partitionBy(VIDEO).orderBy("frame", "track_id")
    return rows.withColumn("place", (F.row_number().over(order) - 1).cast("long"))


def slots(dets: DataFrame, share: float | None = 0.0) -> DataFrame:
    """The simplest tracker: the n-th confident box of a frame keeps its id while each present frame has an n-th one.

    Boxes grow by ``share`` and are clipped; None leaves them as they are. Masks stay with their boxes.
    Frames count when they hold any detection. Ids number a video's runs by start, then slot: a slot that the frame before
    lacked starts the next one, so ids are counted in the order of frames and boxes, and a slot carries its own from frame
    to frame. Rows are dealt once, by video, and sorted twice: all windows but the last share one order.
    """
    rows = Window.partitionBy(VIDEO).orderBy("frame", "det_id")
    until, own = rows.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(VIDEO, "frame").orderBy("det_id").rowsBetween(Window.unboundedPreceding, 0)
    sure = F.coalesce("is_confident", F.lit(False))
    counted = dets.withColumn("upto", F.sum(sure.cast("int")).over(until))
    based = counted.withColumn("base", F.first(F.col("upto") - sure.cast("int")).over(own)).withColumn("slot", F.col("upto") - F.col("base") - 1)
    # the frame before began at the base of the row before a frame's first
    before = based.withColumn("last", F.lag("base").over(rows)).withColumn("had", F.first(F.col("base") - F.coalesce("last", "base")).over(own))
    opened = sure & (F.col("slot") >= F.col("had"))
    begun = before.withColumn("begun", F.when(opened, F.sum(opened.cast("int")).over(until))).where("is_confident")
    carried = Window.partitionBy(VIDEO, "slot").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    named = begun.withColumn("track_id", F.last("begun", ignorenulls=True).over(carried))
    x, y, w, h = dilate(Box.of(), share or 0.0)
    box = [F.col(c) for c in BOX] if share is None else [v.alias(c) for c, v in zip(BOX, (x, y, x + w, y + h), strict=True)]
    return named.select(VIDEO, "frame", "track_id", "det_id", *box, F.col("confidence").alias("score"), "object_class", F.lit("confirmed").alias("state"), *(["mask"] if "mask" in dets.columns else []))


def summaries(tracks: DataFrame, eligible: int = 10) -> DataFrame:
    """Start, end, observations and mean score of each track, and whether the linker may use it."""
    n = F.count("*")
    return tracks.groupBy(*TRACK).agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), n.alias("n_obs"), F.round(F.avg("score"), 9).alias("mean_score")).withColumn("eligible", F.col("n_obs") >= eligible)


def detection_rate(tracks: DataFrame, least: float) -> DataFrame:
    """Tracks seen in at least a share of the frames that they span."""
    rated = summaries(tracks).withColumn("rate", F.col("n_obs") / F.greatest(F.lit(1), F.col("end_frame") - F.col("start_frame") + 1))
    return rated.where(F.col("rate") >= least).select(*TRACK, "n_obs", "rate")


def renumbering(tracks: DataFrame) -> DataFrame:
    """``track_id`` and ``new_id``: 1, 2, ... by start frame, equal ones by old id."""
    order = Window.partitionBy(VIDEO).orderBy("start_frame", "track_id")
    return tracks.groupBy(*TRACK).agg(F.min("frame").alias("start_frame")).select(*TRACK, F.row_number().over(order).cast("long").alias("new_id"))


def remap(tracks: DataFrame, mapping: DataFrame) -> DataFrame:
    """Tracks under the ids of ``mapping`` (``video_id, track_id, new_id``); ids that it lacks stay."""
    out = tracks.join(mapping.select(*TRACK, F.col("new_id").alias("_new")), list(TRACK), "left")
    return out.withColumns({"old_id": F.col("track_id"), "track_id": F.coalesce("_new", "track_id")}).drop("_new")


def fill_gaps(tracks: DataFrame) -> DataFrame:
    """Observations between consecutive ones that lie apart: boxes and scores on the line between, never redacted."""
    order = Window.partitionBy(*TRACK).orderBy("frame")
    ends = ("frame", "x1", "y1", "x2", "y2", "score")
    gaps = tracks.select(*TRACK, *ends, *(F.lead(c).over(order).alias(f"next_{c}") for c in ends)).where("next_frame > frame + 1")
    each = gaps.withColumn("at", F.explode(F.sequence(F.col("frame") + 1, F.col("next_frame") - 1)))
    t = (F.col("at") - F.col("frame")).cast("double") / (F.col("next_frame") - F.col("frame")).cast("double")
    between = [(F.col(c) + (F.col(f"next_{c}") - F.col(c)) * t).alias(c) for c in ends[1:]]
    return each.select(*TRACK, F.col("at").alias("frame"), *between, F.lit("confirmed").alias("state"), F.lit(False).alias("should_blur"))


def centres(tracks: DataFrame) -> DataFrame:
    box = Box.of()
    return tracks.select(*TRACK, "frame", box.cx.alias("center_x"), box.cy.alias("center_y"))


def velocities(tracks: DataFrame, span: int = 5, eligible: int = 2) -> DataFrame:
    """Mean velocity over the first and the last ``span`` steps of each track with ``eligible`` observations or more.

    Only the ends of a track travel: the rows within ``span`` of either end.
    """
    up, down = Window.partitionBy(*TRACK).orderBy("frame"), Window.partitionBy(*TRACK).orderBy(F.desc("frame"))
    ranked = centres(tracks).withColumns({"i": F.row_number().over(up), "j": F.row_number().over(down)})
    point = F.struct("frame", "center_x", "center_y")
    pick = ranked.where(f"i <= {span + 1} OR j <= {span + 1}").groupBy(*TRACK).agg(
        F.max(F.when(F.col("i") == 1, point)).alias("first"),
        F.max(F.when(F.col("i") <= span + 1, point)).alias("head"),
        F.max(F.when(F.col("j") == 1, point)).alias("last"),
        F.min(F.when(F.col("j") <= span + 1, point)).alias("tail"),
        F.max("i").alias("n_obs"),
    )
    speed = lambda a, b, c: (F.col(b)[c] - F.col(a)[c]) / (F.col(b)["frame"] - F.col(a)["frame"]).cast("double")
    return pick.where(f"head.frame > first.frame AND n_obs >= {eligible}").select(
        *TRACK, F.col("first.frame").alias("start_frame"), F.col("last.frame").alias("end_frame"),
        *(F.col(f"{end}.center_{a}").alias(f"{end}_{a}") for end in ("first", "last") for a in "xy"),
        *(speed("first", "head", f"center_{a}").alias(f"head_v{a}") for a in "xy"),
        *(speed("tail", "last", f"center_{a}").alias(f"tail_v{a}") for a in "xy"),
    )


def link_candidates(tracks: DataFrame, max_gap: int = 30, gate: float = 0.4, eligible: int = 10) -> DataFrame:
    """Pairs of tracks where the second starts within ``max_gap`` frames of the first one's end, near it and moving alike.

    A range join: ends and starts meet in bins as wide as the gap, so a bin meets its own and the next.
    """
    ends = velocities(tracks, eligible=eligible)
    a = ends.select(VIDEO, F.col("track_id").alias("prev_id"), "end_frame", "last_x", "last_y", "tail_vx", "tail_vy", F.explode(F.array(F.floor(F.col("end_frame") / max_gap), F.floor(F.col("end_frame") / max_gap) + 1)).alias("bin"))
    b = ends.select(VIDEO, F.col("track_id").alias("next_id"), "start_frame", "first_x", "first_y", "head_vx", "head_vy", F.floor(F.col("start_frame") / max_gap).alias("bin"))
    met = a.join(b, [VIDEO, "bin"]).withColumn("gap", F.col("start_frame") - F.col("end_frame")).where(f"gap BETWEEN 1 AND {max_gap}")
    dx, dy = F.col("first_x") - F.col("last_x"), F.col("first_y") - F.col("last_y")
    na = F.sqrt(F.col("tail_vx") * F.col("tail_vx") + F.col("tail_vy") * F.col("tail_vy"))
    nb = F.sqrt(F.col("head_vx") * F.col("head_vx") + F.col("head_vy") * F.col("head_vy"))
    scored = met.withColumns({"distance": F.sqrt(dx * dx + dy * dy), "na": na, "nb": nb, "along": F.col("tail_vx") * F.col("head_vx") + F.col("tail_vy") * F.col("head_vy")})
    still = "(na < 1e-6 AND nb < 1e-6)"
    alike = "(na >= 1e-6 AND nb >= 1e-6 AND along / (na * nb) >= 0.8e0 AND greatest(na, nb) / greatest(least(na, nb), 1e-6) <= 3e0)"
    return scored.where(f"distance <= {gate!r}e0 AND ({still} OR {alike})").select(VIDEO, "prev_id", "next_id", "gap", F.round("distance", 9).alias("distance"))


def reverse(dets: DataFrame) -> DataFrame:
    """Detections with each video's frames counted from its last one."""
    last = dets.groupBy(VIDEO).agg(F.max("frame").alias("_last"))
    return dets.join(last, VIDEO).withColumn("frame", F.col("_last") - F.col("frame")).drop("_last")


def pair_by_overlap(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Mean IoU, over the frames that they share, of each forward with each backward track.

    Rows are dealt by video once. A frame's tracks meet there, and pairs are counted where they arise, so no pair travels.
    """
    side = lambda rows, k: rows.dropna(subset=[VIDEO, "frame"]).select(VIDEO, "frame", F.lit(k).alias("_side"), "track_id", *BOX)
    dealt = side(forward, "f").unionByName(side(backward, "b")).repartition(VIDEO)
    own = lambda k: F.collect_list(F.when(F.col("_side") == k, F.struct("track_id", *BOX))).alias(k)
    met = dealt.groupBy(VIDEO, "frame").agg(own("f"), own("b")).select(VIDEO, F.explode("f").alias("f"), "b").select(VIDEO, "f", F.explode("b").alias("b"))
    return met.groupBy(VIDEO, F.col("f.track_id").alias("forward_id"), F.col("b.track_id").alias("backward_id")).agg(F.count("*").alias("n_frames"), F.round(F.avg(iou(Box.of("f."), Box.of("b."))), 9).alias("mean_iou"))


def choose_pairs(pairs: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One partner each: forward tracks, by id, take the best backward track above the threshold that is still free;
    equal ones the smaller id. A task walks its videos' pairs in this order and holds the ids taken in one video.
    """
    columns = [VIDEO, "forward_id", "backward_id", "mean_iou"]
    near = pairs.where(F.col("mean_iou") > threshold).select(*columns)
    ordered = near.repartition(VIDEO).sortWithinPartitions(VIDEO, "forward_id", F.desc("mean_iou"), "backward_id")

    def walk(batches: Iterator) -> Iterator:
        import pyarrow as pa

        video, last, taken = None, None, set()
        for batch in batches:
            go = []
            for v, f, b in zip(*(batch.column(c).to_pylist() for c in columns[:3]), strict=True):
                if v != video:
                    video, last, taken = v, None, set()
                free = f != last and b not in taken
                if free:
                    last = f
                    taken.add(b)
                go.append(free)
            yield batch.filter(pa.array(go, pa.bool_()))

    return ordered.mapInArrow(walk, ordered.schema)


def merged_ids(forward: DataFrame, backward: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``track_id, merged_id`` of the forward and of the backward tracks.

    A video's forward tracks count from 1 in the order in which they appear; partners share an id; the backward
    tracks left follow in the order in which the backward pass meets them, which is by their last frame.
    """
    order = Window.partitionBy(VIDEO).orderBy("first", "track_id")
    f = forward.groupBy(*TRACK).agg(F.min("frame").alias("first")).select(*TRACK, F.row_number().over(order).cast("long").alias("merged_id"))
    own = chosen.select(VIDEO, F.col("forward_id").alias("track_id"), F.col("backward_id").alias("_back")).join(f, list(TRACK)).select(VIDEO, F.col("_back").alias("track_id"), "merged_id")
    top = f.groupBy(VIDEO).agg(F.max("merged_id").alias("_top"))
    met = backward.groupBy(*TRACK).agg(F.max("frame").alias("last")).join(own, list(TRACK), "left").join(top, VIDEO, "left")
    alone = F.row_number().over(Window.partitionBy(VIDEO, F.col("merged_id").isNull()).orderBy(F.desc("last"), "track_id"))
    return f, met.select(*TRACK, F.coalesce("merged_id", F.coalesce("_top", F.lit(0)) + alone).alias("merged_id"))


def merge(forward: DataFrame, backward: DataFrame, chosen: DataFrame, weight: float = 0.6) -> DataFrame:
    """Both directions frame by frame: chosen partners under one id, the rest as they are (see :func:`merged_ids`).

    Where both have a frame the backward box stands, scores blend with ``weight`` on the backward one, the later state
    (in the order of their names) and the larger age hold, the track is seen in this frame, and either one redacts; of masks, where both sides have them, the backward one counts first.
    A frame that one direction alone has keeps that one's values.
    """
    masks = ["mask"] if {"mask"} <= {*forward.columns} & {*backward.columns} else []
    own = ("x1", "y1", "x2", "y2", "score", "state", "age", "last_seen", "should_blur", *masks)
    sides = []
    for side, rows, ids in zip("fb", (forward, backward), merged_ids(forward, backward, chosen), strict=True):
        sides.append(rows.join(ids, list(TRACK)).select(VIDEO, "frame", F.col("merged_id").alias("track_id"), *(F.col(c).alias(f"{side}_{c}") for c in own)))
    both = sides[0].join(sides[1], [VIDEO, "frame", "track_id"], "full")
    origin = F.when(F.col("b_state").isNull(), "forward").when(F.col("f_state").isNull(), "backward").otherwise("merged")
    either = lambda c: F.coalesce(f"b_{c}", f"f_{c}")
    met = (origin == "merged")
    return both.select(
        VIDEO, "frame", "track_id", *(either(c).alias(c) for c in own[:4]),
        F.when(met, F.col("f_score") * (1 - weight) + F.col("b_score") * weight).otherwise(either("score")).alias("score"),
        F.greatest("f_state", "b_state").alias("state"),
        F.greatest("f_age", "b_age").alias("age"),
        F.when(met, F.col("frame")).otherwise(either("last_seen")).alias("last_seen"),
        (F.coalesce("f_should_blur", F.lit(False)) | F.coalesce("b_should_blur", F.lit(False))).alias("should_blur"),
        *(either(c).alias(c) for c in masks),
        origin.alias("origin"),
    )


def gated_pairs(tracks: DataFrame, dets: DataFrame, gate: float) -> DataFrame:
    """Track boxes and detections of one frame whose centres lie within the gate. They meet by cells as wide as it."""
    mine, found = Box.of(), Box.of()
    one, two = (df.select(VIDEO, "frame", key, *BOX) for df, key in ((tracks, "track_id"), (dets, "det_id")))
    met = near(one, two, [VIDEO, "frame"], gate, (mine.cx, mine.cy), (found.cx, found.cy))
    pairs = met.select(VIDEO, "frame", F.col("a.track_id"), F.col("b.det_id"), centre_distance(Box.of("a."), Box.of("b.")).alias("distance"))
    return pairs.where(F.col("distance") <= gate)


def camera_shift(dets: DataFrame) -> DataFrame:
    """Mean move of the centres between consecutive present frames, paired by ordinal up to the shorter frame."""
    box = Box.of()
    order = Window.partitionBy(VIDEO).orderBy("frame")
    frames = dets.select(VIDEO, "frame").distinct().withColumn("before", F.lag("frame").over(order))
    ordinal = Window.partitionBy(VIDEO, "frame").orderBy("det_id")
    now = dets.select(VIDEO, "frame", F.row_number().over(ordinal).alias("n"), box.cx.alias("cx"), box.cy.alias("cy"))
    was = now.select(VIDEO, F.col("frame").alias("before"), "n", F.col("cx").alias("px"), F.col("cy").alias("py"))
    met = now.join(frames, [VIDEO, "frame"]).join(was, [VIDEO, "before", "n"])
    return met.groupBy(VIDEO, "frame").agg(F.count("*").alias("n_pairs"), *((F.round(F.avg(F.col(f"c{a}") - F.col(f"p{a}")), 9) + 0.0).alias(f"shift_{a}") for a in "xy"))
