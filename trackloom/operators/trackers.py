"""Trackers as declared rounds of association over one keyed state, in batch and in streams.

A tracker is a row of ``KINDS``: which detections each round takes, by which cost and gate, and what may start a
track. One step function runs them all. Videos are Spark's keys: a video's frames come to one task in order, and
the task holds the live tracks of one video only, however long it is.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from trackloom.operators import lanes
from trackloom.operators.motion import IOU_LIMIT, Filters, assign, distances, overlaps, to_tlwh
from trackloom.operators.pictures import ORDER, Sight, beside


@dataclass(frozen=True)
class Settings:
    """Tracker parameters. The defaults, and those of each kind in ``OVERRIDES``."""

    gate: float = 0.4
    confirm_after: int = 2
    max_misses: int = 8
    low_pool: bool = False
    dilate: float = 0.2
    smooth: float = 0.65
    embedding_gate: float = 0.55
    min_rate: float = 0.0
    gate_first: float = 0.05
    gate_second: float = 0.02
    camera: bool = False
    drift: float = 0.15
    visual_age: int = 6
    high: float = 0.5
    low: float = 0.1
    #: Frames after which a track that isn't seen is forgotten; None keeps it, as the batch trackers do.
    forget_after: int | None = None


#: Fixed values.
OVERRIDES = {
    "sort": {},
    "bytetrack": {"gate": 0.05, "max_misses": 10, "smooth": 1.0, "low_pool": True},
    "botsort": {"confirm_after": 3, "max_misses": 5, "smooth": 1.0, "low_pool": True, "camera": True},
    "oc_sort": {"gate": 0.05, "max_misses": 10, "smooth": 0.9, "low_pool": True},
    "fused": {"gate": 0.1, "confirm_after": 3, "max_misses": 5, "smooth": 1.0, "low_pool": True, "gate_first": 0.08, "gate_second": 0.15},
    "hybrid_sot": {"gate": 0.05, "confirm_after": 5, "max_misses": 2, "dilate": 0.25, "smooth": 1.0, "visual_age": 10, "drift": 0.05},
}


@dataclass(frozen=True)
class Round:
    pool: str  # sure, high, low, all, or low_left
    cost: str  # centre, iou or fused
    gate: str = "gate"


@dataclass(frozen=True)
class Kind:
    rounds: tuple[Round, ...]
    start: str = "high"
    momentum: bool = False
    prune: bool = False


KINDS = {
    "sort": Kind((Round("sure", "centre"),), "sure", prune=True),
    "hybrid_sot": Kind((Round("high", "fused", "gate_first"), Round("low", "fused", "gate_second"))),
    "bytetrack": Kind((Round("high", "centre"), Round("low", "centre"))),
    "botsort": Kind((Round("all", "centre", "gate_first"), Round("all", "centre", "gate_second"), Round("low_left", "centre", "gate_second"))),
    "oc_sort": Kind((Round("high", "iou"), Round("low", "iou")), momentum=True, prune=True),
    "fused": Kind((Round("high", "fused", "gate_first"), Round("low", "fused", "gate_second"))),
}


def settings(kind: str, **changes: object) -> Settings:
    """Settings of a kind, in any case, with changes; unknown kinds and names raise."""
    return replace(Settings(**OVERRIDES[kind.lower()]), **changes)


def input_columns(dets: DataFrame, kind: str) -> list[str]:
    """The columns that a tracker reads: the vectors where there are any and the kind's cost knows them, masks if any."""
    vectors = "embedding" in dets.columns and any(r.cost == "fused" for r in KINDS[kind].rounds)
    return [*_INPUT, *["embedding"] * vectors, *["mask"] * ("mask" in dets.columns)]


def output(columns: list[str]) -> str:
    """Schema of what a tracker gives for these input columns."""
    return OUTPUT + ", mask long" * ("mask" in columns)


@dataclass
class Frame:
    """Detections of one frame, in order."""

    tlwh: np.ndarray
    score: np.ndarray
    sure: np.ndarray
    embedding: list = field(default_factory=list)
    mask: list = field(default_factory=list)


_COLUMNS = ("id", "hits", "misses", "age", "seen", "hidden", "score")


@dataclass
class Tracks:
    """Live tracks of one video: a column for each property. ``extra`` holds what some kinds add by track."""

    filters: Filters = field(default_factory=Filters)
    smooth: np.ndarray = field(default_factory=lambda: np.zeros((0, 4)))
    number: dict[str, np.ndarray] = field(default_factory=lambda: {c: np.zeros(0) for c in _COLUMNS})
    extra: list[dict] = field(default_factory=list)
    next_id: int = 1
    centres: np.ndarray | None = None

    def add(self, tlwh: np.ndarray, score: np.ndarray, frame: int) -> None:
        """A track for each box, in order."""
        k = len(tlwh)
        self.filters.add(tlwh)
        self.smooth = np.concatenate([self.smooth, tlwh])
        fresh = {"id": np.arange(self.next_id, self.next_id + k), "hits": 1, "misses": 0, "age": 1, "seen": frame, "hidden": 0, "score": score}
        self.number = {c: np.concatenate([v, np.broadcast_to(fresh[c], k)]) for c, v in self.number.items()}
        self.extra += [{"last": box, "at": frame} for box in tlwh]
        self.next_id += k

    def keep(self, which: np.ndarray) -> None:
        self.filters.keep(which)
        self.smooth = self.smooth[which]
        self.number = {c: v[which] for c, v in self.number.items()}
        self.extra = [e for e, w in zip(self.extra, which.tolist(), strict=True) if w]


def _unit(v: np.ndarray) -> np.ndarray:
    return v / (np.sqrt(v @ v) + 1e-8)


def _looks(e: dict) -> tuple[np.ndarray, list[np.ndarray]]:
    """Unit vectors of a track: the mean one and those seen last, worked out once after they change."""
    if "looks" not in e:
        e["looks"] = _unit(e["mean"]), [_unit(v) for v in e["seen"]]
    return e["looks"]


def _cost(round_: Round, t: Tracks, rows: np.ndarray, f: Frame, cols: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Cost of each track with each detection, and which pairs may meet."""
    boxes, found = t.smooth[rows], f.tlwh[cols]
    if round_.cost == "iou":
        iou = overlaps(boxes, found)
        return 1 - iou, iou >= IOU_LIMIT
    if s.camera and t.centres is not None and len(t.centres):
        n = min(len(t.centres), len(cols))
        now = found[:n, :2] + found[:n, 2:] / 2
        boxes = boxes - np.r_[(now - t.centres[:n]).mean(axis=0), 0, 0]
    cost = distances(boxes, found)
    gate = getattr(s, round_.gate) or s.gate
    ok = cost <= gate
    if round_.cost == "fused":
        shape = lambda b: np.maximum(b[:, 2] / np.maximum(b[:, 3], 1e-6), 1e-6)
        cost = cost + 0.1 * np.minimum(1, np.abs(shape(boxes)[:, None] - shape(found)[None]))
        units = [None if f.embedding[d] is None else _unit(f.embedding[d]) for d in cols] if f.embedding else [None] * len(cols)
        for r, c in zip(*(v.tolist() for v in np.nonzero(ok)), strict=True):
            e, own = t.extra[rows[r]], units[c]
            if own is None or not len(e.get("seen", ())):
                continue
            mean, seen = _looks(e)
            like = (float(mean @ own), max(float(v @ own) for v in seen))
            ok[r, c] = min(like) >= s.embedding_gate
            cost[r, c] += 0.3 * (1 - like[0]) + 0.2 * (1 - like[1])
        ok &= cost <= gate + 1
    return cost, ok


def _associate(round_: Round, t: Tracks, rows: np.ndarray, f: Frame, cols: np.ndarray, s: Settings) -> list[tuple[int, int]]:
    if not len(rows) or not len(cols):
        return []
    cost, ok = _cost(round_, t, rows, f, cols, s)
    if not ok.any():
        return []
    if round_.cost == "iou":  # tracks apart from all detections cost 1 each; no more of them can be taken than there are detections
        apart = np.flatnonzero((cost == 1).all(axis=1))
        if len(rows) - len(apart) + len(cols) <= len(rows):
            kept = np.delete(np.arange(len(rows)), apart[len(cols) :])
            rows, cost, ok = rows[kept], cost[kept], ok[kept]
    else:  # pairs out of reach all cost the same, so tracks and detections without any other drop out
        near, found = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
        rows, cols, ok = rows[near], cols[found], ok[np.ix_(near, found)]
        cost = np.where(ok, cost[np.ix_(near, found)], (getattr(s, round_.gate) or s.gate) + 10)
    return [(int(rows[r]), int(cols[c])) for r, c in assign(cost) if ok[r, c]]


def _see(t: Tracks, at: np.ndarray, f: Frame, by: np.ndarray, frame: int, s: Settings, momentum: bool) -> None:
    """Detections ``by`` join tracks ``at``, one each."""
    tlwh, score = f.tlwh[by], f.score[by]
    t.filters.update(at, tlwh)
    for i, d, box in zip(at.tolist(), by.tolist(), tlwh, strict=True):
        e = t.extra[i]
        if f.mask:
            e["mask"] = f.mask[d]
        if momentum:
            gap = max(1, frame - e["at"])
            e["move"] = (box - e["last"]) / gap
            if gap > 1 and "before" in e:
                # observations on the way there, from the one before the last
                t.filters.follow(i, e["before"] + (box - e["before"]) * (np.arange(1, gap) / gap)[:, None])
            e["before"] = e["last"]
        e["last"], e["at"], e["lost"] = box, frame, False
    n = t.number
    n["score"][at], n["seen"][at], n["misses"][at], n["hidden"][at] = score, frame, 0, 0
    n["hits"][at] += 1
    t.smooth[at] = s.smooth * to_tlwh(t.filters.mean[at, :4]) + (1 - s.smooth) * t.smooth[at]


def _remember(e: dict, embedding: np.ndarray | None, weight: float) -> None:
    if embedding is None:
        return
    e["seen"] = [*e.get("seen", ()), np.asarray(embedding, float)][-3:]
    _blend(e, _unit(embedding), weight)


def _blend(e: dict, unit: np.ndarray, weight: float) -> None:
    e.pop("looks", None)
    e["mean"] = unit if "mean" not in e else _unit(0.5 * e["mean"] + 0.5 * max(weight, 1e-3) * unit)


def step(kind: str, s: Settings, t: Tracks, frame: int, f: Frame, visual: Callable | Sight | None = None) -> list[tuple]:
    """Advance the tracks of a video by a frame; rows ``track_id, x, y, w, h, state, age, last_seen, score, mask``.

    ``visual(frame, track_id, box)`` may return the box where a picture shows a track that no detection met, or that
    box and the vector of what is in it (``hybrid_sot`` only). A ``pictures.Sight`` in its place remembers the picture of
    every detection that meets a track. Association uses the smoothed box of the last frame, not the prediction.
    """
    rules, n = KINDS[kind], t.number
    t.filters.predict()
    n["age"] += 1
    n["misses"] += 1
    if rules.momentum:
        for i, e in enumerate(t.extra):
            if "move" in e and n["misses"][i] <= 3:
                t.filters.mean[i, :4] += 0.5 * e["move"]
    is_high = f.score >= s.high
    is_low = ~is_high & (f.score >= max(0.0, s.low)) & s.low_pool
    pools = {"sure": f.sure, "high": is_high, "low": is_low, "all": np.ones(len(f.score), bool), "low_left": is_low}
    free_track, free_det, matches = np.ones(len(n["id"]), bool), np.ones(len(f.score), bool), []
    for round_ in rules.rounds:
        found = _associate(round_, t, np.flatnonzero(free_track), f, np.flatnonzero(pools[round_.pool] & free_det), s)
        for i, d in found:
            free_track[i] = free_det[d] = False
        matches += found
    if matches:
        at, by = np.array(matches).T
        _see(t, at, f, by, frame, s, rules.momentum)
    for i, d in matches if f.embedding else ():
        _remember(t.extra[i], f.embedding[d], float(f.score[d]))
    if kind == "hybrid_sot" and isinstance(visual, Sight):
        for i, d in matches:
            _remember(t.extra[i], visual.start(t.extra[i], f.tlwh[d]), float(f.score[d]))
    spare = [int(d) for d in np.flatnonzero(~f.sure & free_det)]
    missed = np.flatnonzero(free_track)
    if kind == "hybrid_sot" and visual:
        missed = np.array([i for i in missed if not _shown(t, i, frame, f, spare, s, visual)], np.int64)
    n["seen"][missed] = frame
    for i in missed if f.mask else ():
        t.extra[i]["mask"] = None
    gone = n["misses"][missed] > s.max_misses
    n["hidden"][missed[gone]] = 1
    alive = missed[~gone]
    t.smooth[alive] = s.smooth * to_tlwh(t.filters.mean[alive, :4]) + (1 - s.smooth) * t.smooth[alive]
    fresh = np.flatnonzero(pools[rules.start] & free_det)
    if len(fresh):
        t.add(f.tlwh[fresh], f.score[fresh], frame)
        for e, d in zip(t.extra[-len(fresh) :], fresh, strict=True):
            if f.embedding:
                _remember(e, f.embedding[d], float(f.score[d]))
            if f.mask:
                e["mask"] = f.mask[d]
    if s.camera:
        t.centres = f.tlwh[:, :2] + f.tlwh[:, 2:] / 2
    n = t.number
    shown = np.flatnonzero(n["hidden"] == 0)
    box = t.smooth[shown]
    x, y = (np.clip(box[:, k] - box[:, k + 2] * s.dilate / 2, 0, 1) for k in (0, 1))
    w, h = (np.clip(box[:, k] * (1 + s.dilate), 0, 1 - c) for k, c in ((2, x), (3, y)))
    state = np.where(n["hits"][shown] >= s.confirm_after, "confirmed", "tentative")
    whole = [n[c][shown].astype(np.int64).tolist() for c in ("id", "age", "seen")]
    out = list(zip(whole[0], *(v.tolist() for v in (x, y, w, h, state)), *whole[1:], n["score"][shown].tolist(), [t.extra[i].get("mask") for i in shown] if f.mask else [None] * len(shown), strict=True))
    live = np.ones(len(n["id"]), bool)
    if rules.prune and s.min_rate > 0:
        live &= n["hits"] / np.maximum(n["age"], 1) >= s.min_rate
    if s.forget_after is not None:
        live &= n["misses"] <= s.forget_after
    if not live.all():
        t.keep(live)
    return out


def _shown(t: Tracks, i: int, frame: int, f: Frame, spare: list[int], s: Settings, visual: Callable | Sight) -> bool:
    """A picture may keep a missed track: by a low detection at its box, which is used once, or by the box itself.

    A picture that no longer looks like the track is not asked again until a detection meets it; in this frame the
    track then stays as it was.
    """
    n, e = t.number, t.extra[i]
    if n["misses"][i] > s.visual_age or e.get("lost"):
        e.pop("picture", None)  # is not asked again until a detection brings a new one
        return False
    found = visual.find(e) if isinstance(visual, Sight) else visual(frame, int(n["id"][i]), t.smooth[i])
    if found is None:
        return False
    box, vector = found if isinstance(found, tuple) and len(found) == 2 else (found, None)
    if vector is not None and len(e.get("seen", ())):
        own = _unit(np.asarray(vector, float))
        if float(_looks(e)[0] @ own) < s.embedding_gate:
            e["lost"] = True
            return True
        _blend(e, own, float(n["score"][i]))
        if max(float(x @ own) for x in _looks(e)[1]) < s.embedding_gate:
            e["lost"] = True
            return True
    box = np.asarray(box, float)
    if s.drift > 0 and distances(box[None], t.smooth[i][None])[0, 0] > s.drift:
        return False
    if spare:
        near = overlaps(box[None], f.tlwh[spare])[0]
        if near.max() > 0.1:
            d = spare.pop(int(near.argmax()))
            _see(t, np.array([i]), f, np.array([d]), frame, s, False)
            if isinstance(visual, Sight):
                _remember(e, visual.start(e, f.tlwh[d]), float(f.score[d]))
            return True
    t.filters.update(i, box)
    t.smooth[i] = s.smooth * to_tlwh(t.filters.mean[i, :4]) + (1 - s.smooth) * t.smooth[i]
    n["score"][i] *= 0.9
    n["seen"][i], n["misses"][i] = frame, 0
    return True


OUTPUT = "video_id long, frame long, track_id long, x1 double, y1 double, x2 double, y2 double, width double, height double, state string, age long, last_seen long, score double, should_blur boolean"
_INPUT = ("video_id", "frame", "det_id", "x1", "y1", "x2", "y2", "confidence", "is_confident")


def _frame_of(rows: dict[str, np.ndarray]) -> Frame:
    x1, y1, x2, y2 = (rows[c].astype(float) for c in ("x1", "y1", "x2", "y2"))
    own = [None if e is None else np.asarray(e, float) for e in rows["embedding"]] if "embedding" in rows else []
    masks = [None if m is None or m != m else int(m) for m in rows["mask"].tolist()] if "mask" in rows else []
    return Frame(np.stack([x1, y1, x2 - x1, y2 - y1], axis=1), rows["confidence"].astype(float), rows["is_confident"].astype(bool), own, masks)


def _rows_of(video: int, frame: int, found: list[tuple], columns: list[str]) -> list[tuple]:
    masks = "mask" in columns
    return [(video, frame, i, x, y, x + w, y + h, w, h, state, age, seen, score, True, *[mask] * masks) for i, x, y, w, h, state, age, seen, score, mask in found]


def _known(dets: DataFrame, columns: list[str]) -> DataFrame:
    known = dets.dropna(subset=["video_id", "frame", "x1", "y1", "x2", "y2", "confidence"]).withColumn("is_confident", F.coalesce("is_confident", F.lit(True)))
    return known.select(*columns)


def both_ways(dets: DataFrame, kind: str = "sort", settings_: Settings | None = None) -> DataFrame:
    """Rows of :func:`track` and of the same tracker from each video's last frame to its first, without masks; ``_side`` is 0 and 1.

    Detections are dealt once, and each partition has all rows of its videos. On the way back frames count below 0 within.
    """
    kind = kind.lower()
    columns = [c for c in input_columns(dets, kind) if c != "mask"]
    dealt = _known(dets, columns).withColumn("_lane", lanes.lane()).repartition("_lane")
    sided = dealt.withColumn("_side", F.explode(F.array(F.lit(0).cast("byte"), F.lit(1).cast("byte"))))
    turned = lambda c: F.when(F.col("_side") == 1, -F.col(c)).otherwise(F.col(c))
    ordered = sided.withColumn("frame", turned("frame")).sortWithinPartitions("_lane", "_side", "frame", "video_id", "det_id").drop("_lane")
    schema = StructType.fromDDL(OUTPUT).add("_side", "byte")
    found = ordered.mapInArrow(lanes.look(KINDS[kind], settings_ or settings(kind), schema.names, "embedding" in columns, sides=True), schema)
    return found.withColumns({c: turned(c) for c in ("frame", "last_seen")})


def track(
    dets: DataFrame,
    kind: str = "sort",
    settings_: Settings | None = None,
    visual: Callable | None = None,
    frames: DataFrame | None = None,
    sight: Callable[[], Sight] | None = None,
) -> DataFrame:
    """Tracks of each video's detections. Frames without detections are no steps; order in a frame is ``det_id``.

    Every visible track gives a row for every present frame. An ``embedding`` column, where there is one, joins
    the cost of ``fused`` and ``hybrid_sot``; a ``mask`` column gives each row the mask of the detection that it was seen
    by, null in frames where none was. ``kind`` may be in any case; ``bidirectional.tracker`` takes all kinds. Null flags count as confident; null coordinates, confidences or frames leave the row out;
    no rows give no rows. A task takes a lane of videos side by side (:mod:`lanes`); a ``visual`` or masks have it walk its
    videos one after another with the state of one video, with the same rows.

    With ``frames`` (``video_id, frame, width, height, pixels``) ``hybrid_sot`` looks for tracks that no detection met:
    ``sight()``, once in a task, gives the :class:`pictures.Sight` to do so. Pixels move once, those of frames that have
    detections only; a frame that is missing shows the last one before it.
    """
    kind = kind.lower()
    s = settings_ or settings(kind)
    if (frames is None) != (sight is None) or (sight and (visual or kind != "hybrid_sot")):
        raise ValueError("frames and a sight come together, for hybrid_sot and in place of visual")
    columns = input_columns(dets, kind)
    known = _known(dets, columns)
    if not visual and "mask" not in columns:
        laned = (beside(known, frames) if sight else known).withColumn("_lane", lanes.lane(lanes.SEEN if sight else lanes.BITS))
        ordered = laned.repartition("_lane").sortWithinPartitions("_lane", "frame", "video_id", *(ORDER if sight else ["det_id"]))
        names = StructType.fromDDL(OUTPUT).names
        centres = all(r.cost == "centre" for r in KINDS[kind].rounds)
        return ordered.drop("_lane").mapInArrow(lanes.walk(KINDS[kind], s, names) if centres else lanes.look(KINDS[kind], s, names, "embedding" in columns, sight), OUTPUT)
    order = ("video_id", "frame", *(ORDER if sight else ["det_id"]))
    read = [*columns, *("_picture", "width", "height", "pixels")] if sight else columns
    ordered = (beside(known, frames) if sight else known).select(*read).repartition("video_id").sortWithinPartitions(*order)

    shape = to_arrow_schema(StructType.fromDDL(output(columns)))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, held, t = None, None, Tracks()
        seen = sight() if sight else None

        def pictured(rows: dict[str, np.ndarray], fresh: bool) -> dict[str, np.ndarray]:
            """Shows the frame's picture, if one comes; the rows of detections that are left."""
            if fresh:
                seen.show(None, None, None)
            at = np.flatnonzero(rows["_picture"] == 0)
            if len(at):
                seen.show(*(rows[c][at[0]] if c == "pixels" else int(rows[c][at[0]]) for c in ("width", "height", "pixels")))
            return {c: v[len(at) :] for c, v in rows.items()}

        def walk(rows: dict[str, np.ndarray], last: bool) -> tuple[list[tuple], dict | None]:
            """Rows of all whole frames; the last frame waits for the next batch."""
            nonlocal key, t
            out: list[tuple] = []
            edge = np.flatnonzero(np.r_[True, (rows["video_id"][1:] != rows["video_id"][:-1]) | (rows["frame"][1:] != rows["frame"][:-1]), True])
            stop = len(edge) - 1 if last else len(edge) - 2
            for a, b in zip(edge[:stop], edge[1 : stop + 1], strict=True):
                video, frame = int(rows["video_id"][a]), int(rows["frame"][a])
                fresh, own = video != key, {c: v[a:b] for c, v in rows.items()}
                if fresh:
                    key, t = video, Tracks()
                if seen:
                    own = pictured(own, fresh)
                    if not len(own["frame"]):
                        continue
                out += _rows_of(video, frame, step(kind, s, t, frame, _frame_of(own), seen or visual), columns)
            return out, None if last else {c: v[edge[-2] :] for c, v in rows.items()}

        def table(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * len(shape)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, shape, strict=True)], schema=shape)

        for batch in batches:
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in read}
            if held:
                rows = {c: np.concatenate([held[c], v]) for c, v in rows.items()}
            if len(rows["frame"]):
                out, held = walk(rows, False)
                yield table(out)
        if held:
            yield table(walk(held, True)[0])

    return ordered.mapInArrow(run, output(columns))


def dump(t: Tracks) -> bytes:
    return pickle.dumps(t)


def load(blob: bytes) -> Tracks:
    return pickle.loads(blob)
