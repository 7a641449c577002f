"""Tracking in both directions: a tracker forward and backward, paired by overlap, merged frame by frame."""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators import tracks as tr
from trackloom.operators.trackers import KINDS, Settings, both_ways, track
from trackloom.schema import TRACK, conform, detections
from trackloom.sources.shared import keep


#: Pairs of rows that are compared at once; rows of a video that a task holds in memory, those beyond lie in a file; rows that
#: go out at once.
PAIRS, HELD, ROWS = 1 << 20, 1 << 20, 1 << 15
_READ = ("frame", "track_id", "x1", "y1", "x2", "y2", "score", "age", "last_seen", "_side")
OUTPUT = "video_id long, frame long, track_id long, x1 double, y1 double, x2 double, y2 double, score double, state string, age long, last_seen long, should_blur boolean, origin string"


def bidirectional(dets: DataFrame, kind: str = "sort", settings_: Settings | None = None, overlap: float = 0.3, weight: float = 0.6) -> DataFrame:
    """Merged tracks of both passes that are to be redacted. Tentative rows don't count. See :func:`tracks.merge` for
    what holds where both passes have one.

    Both passes walk in one task, where the rows of a video then meet in order of frames, so only detections are dealt and
    nothing is written (:class:`_Video`). With masks detections are worked out and each pass runs once, when this is
    called: both passes, pairing and merging read tables in the shared folder.
    """
    if "mask" in dets.columns:
        return _by_joins(dets, kind, settings_, overlap, weight)
    rows = both_ways(dets, kind, settings_).where("state <> 'tentative'").select("video_id", *_READ)
    return rows.sortWithinPartitions("video_id", "frame", "_side", "track_id").mapInArrow(_merged(overlap, weight), OUTPUT)


def _by_joins(dets: DataFrame, kind: str, settings_: Settings | None, overlap: float, weight: float) -> DataFrame:
    dets = keep(dets)
    forward = keep(track(dets, kind, settings_).where("state <> 'tentative'"))
    last = dets.groupBy("video_id").agg(F.max("frame").alias("_last"))
    turned = track(tr.reverse(dets), kind, settings_).where("state <> 'tentative'")
    backward = keep(turned.join(last, "video_id").withColumns({c: F.col("_last") - F.col(c) for c in ("frame", "last_seen")}).drop("_last"))
    chosen = tr.choose_pairs(tr.pair_by_overlap(forward, backward), overlap)
    return tr.merge(forward, backward, chosen, weight).where("should_blur")


class _Folded:
    """Columns of values folded by the columns of keys before them; what comes is folded in when it has become as long as the rest."""

    def __init__(self, keys: int, folds: list[np.ufunc]):
        self.keys, self.folds, self.parts, self.done, self.size = keys, folds, [], 0, 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.size += len(columns[0])
        if self.size > 2 * self.done + PAIRS:
            self.all()

    def all(self) -> list[np.ndarray]:
        """All keys, sorted, with what their values give."""
        columns = [np.concatenate(x) for x in zip(*self.parts, strict=True)] or [np.zeros(0, np.int64)] * (self.keys + len(self.folds))
        order = np.lexsort(columns[self.keys - 1 :: -1])
        columns = [v[order] for v in columns]
        fresh = np.zeros(len(order), bool)
        fresh[:1] = True
        for key in columns[: self.keys]:
            fresh[1:] |= key[1:] != key[:-1]
        at = np.flatnonzero(fresh)
        columns = [v[at] for v in columns[: self.keys]] + [fold.reduceat(v, at) if len(at) else v for fold, v in zip(self.folds, columns[self.keys :], strict=True)]
        self.parts, self.done, self.size = [columns], len(at), len(at)
        return columns


class _Video:
    """Rows of both passes of a video, in order of frames: each goes in once, and merged out once all pairs are known.

    The rules are those of ``tracks.pair_by_overlap``, ``choose_pairs`` and ``merge``. Held are sums of pairs that shared a frame,
    the ends of tracks, and up to ``HELD`` rows; those beyond lie in a file of the task.
    """

    def __init__(self):
        self.tail: dict[str, np.ndarray] | None = None
        self.parts: list[dict[str, np.ndarray]] = []
        self.size, self.file = 0, None
        # sums by forward and backward track: shared frames, overlaps; first frames of forward tracks, last ones of backward tracks
        self.pairs = _Folded(2, [np.add, np.add])
        self.ends = [_Folded(1, [np.minimum]), _Folded(1, [np.maximum])]

    def add(self, rows: dict[str, np.ndarray], last: bool = False) -> None:
        """More rows; the last frame waits for what may follow."""
        if self.tail:
            rows = {c: np.concatenate([self.tail[c], v]) for c, v in rows.items()}
        n = len(rows["frame"])
        whole = n if last else int(np.searchsorted(rows["frame"], rows["frame"][-1])) if n else 0
        self.tail = None if last else {c: v[whole:] for c, v in rows.items()}
        if not whole:
            return
        rows = {c: v[:whole] for c, v in rows.items()}
        back = rows["_side"] == 1
        for side in (0, 1):
            self.ends[side].add(rows["track_id"][back == side], rows["frame"][back == side])
        self._pair(rows, back)
        self.parts.append(rows)
        self.size += whole
        if self.size > HELD:
            self.file = self.file or tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).split(",")[0])
            for part in self.parts:
                pickle.dump(part, self.file)
            self.parts, self.size = [], 0

    def _pair(self, rows: dict[str, np.ndarray], back: np.ndarray) -> None:
        f, b = np.flatnonzero(~back), np.flatnonzero(back)
        begin, end = (np.searchsorted(rows["frame"][b], rows["frame"][f], side) for side in ("left", "right"))
        part = np.cumsum(end - begin) // PAIRS
        edge = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(f)]
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            many = (end - begin)[i:j]
            one = np.repeat(f[i:j], many)
            two = b[np.arange(len(one)) - np.repeat(np.cumsum(many) - many - begin[i:j], many)]
            low, high = ({c: (rows[f"{c}{k}"][one], rows[f"{c}{k}"][two]) for c in "xy"} for k in (1, 2))
            w, h = (np.maximum(0.0, np.minimum(*high[c]) - np.maximum(*low[c])) for c in "xy")
            area = [(high["x"][k] - low["x"][k]) * (high["y"][k] - low["y"][k]) for k in (0, 1)]
            union = area[0] + area[1] - w * h
            iou = np.divide(w * h, union, out=np.zeros_like(w), where=union > 0)
            self.pairs.add(rows["track_id"][one], rows["track_id"][two], np.ones(len(one), np.int64), iou)

    def ids(self, overlap: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """Tracks of each side, sorted, with their merged ids."""
        forward, backward, n, total = self.pairs.all()
        mean = np.floor(total / np.maximum(n, 1) * 1e9 + 0.5) / 1e9
        near = np.flatnonzero(mean > overlap)
        last, mate = None, {}
        for i in near[np.lexsort((backward[near], -mean[near], forward[near]))].tolist():
            if forward[i] != last and int(backward[i]) not in mate:
                last = forward[i]
                mate[int(backward[i])] = int(last)
        (own, first), (back, end) = self.ends[0].all(), self.ends[1].all()
        number = np.empty(len(own), np.int64)
        number[np.lexsort((own, first))] = np.arange(1, len(own) + 1)
        other = np.array([number[np.searchsorted(own, mate[v])] if v in mate else 0 for v in back.tolist()], np.int64)
        alone = np.flatnonzero(other == 0)
        other[alone[np.lexsort((back[alone], -end[alone]))]] = len(own) + np.arange(1, len(alone) + 1)
        return [(own, number), (back, other)]

    def merged(self, overlap: float, weight: float) -> Iterator[list[np.ndarray]]:
        """Columns of the merged rows, part by part; origins by number."""
        (own, number), (back, other) = self.ids(overlap)
        for rows in self._all():
            side = rows["_side"] == 1
            new = np.empty(len(side), np.int64)
            new[~side], new[side] = number[np.searchsorted(own, rows["track_id"][~side])], other[np.searchsorted(back, rows["track_id"][side])]
            order = np.lexsort((side, new, rows["frame"]))
            rows, new, side = {c: v[order] for c, v in rows.items()}, new[order], side[order]
            met = np.flatnonzero((new[1:] == new[:-1]) & (rows["frame"][1:] == rows["frame"][:-1]))  # the forward rows of those that both have
            rows["score"][met + 1] = rows["score"][met] * (1 - weight) + rows["score"][met + 1] * weight
            rows["age"][met + 1] = np.maximum(rows["age"][met], rows["age"][met + 1])
            rows["last_seen"][met + 1] = rows["frame"][met]
            origin = side.astype(np.int8)
            origin[met + 1] = 2
            left = np.delete(np.arange(len(new)), met)
            yield [v[left] for v in (rows["frame"], new, *(rows[c] for c in _READ[2:-1]), origin)]

    def _all(self) -> Iterator[dict[str, np.ndarray]]:
        if self.file:
            size = self.file.tell()
            self.file.seek(0)
            while self.file.tell() < size:
                yield pickle.load(self.file)
            self.file.close()
        yield from self.parts


def _merged(overlap: float, weight: float):
    """Walks rows of both passes sorted by video, frame and side, a video at a time."""

    def table(out: list[tuple[int, list[np.ndarray]]]):
        import pyarrow as pa

        n = [len(found[0]) for _, found in out]
        frame, track, x1, y1, x2, y2, score, age, seen, origin = (np.concatenate(x) for x in zip(*(found for _, found in out), strict=True))
        own = np.repeat([v for v, _ in out], n)
        state = pa.DictionaryArray.from_arrays(np.zeros(len(own), np.int8), ["confirmed"]).cast(pa.string())
        origins = pa.DictionaryArray.from_arrays(origin, ["forward", "backward", "merged"]).cast(pa.string())
        arrays = [*map(pa.array, (own, frame, track, x1, y1, x2, y2, score)), state, pa.array(age), pa.array(seen), pa.array(np.ones(len(own), bool)), origins]
        return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in OUTPUT.split(", ")])

    def run(batches: Iterator) -> Iterator:
        key, video, out, size = None, _Video(), [], 0
        none = {c: np.zeros(0, np.int64) for c in _READ}

        def ended() -> Iterator:
            nonlocal out, size
            video.add(none, True)
            for found in video.merged(overlap, weight):
                out.append((key, found))
                size += len(found[0])
                if size >= ROWS:
                    yield table(out)
                    out, size = [], 0

        for batch in batches:
            own = batch.column("video_id").to_numpy()
            rows = {c: batch.column(c).to_numpy() for c in _READ}
            edge = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True][: len(own) + 1]).tolist() if len(own) else [0]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if key is not None and key != own[a]:
                    yield from ended()
                    video = _Video()
                key = int(own[a])
                video.add({c: v[a:b] for c, v in rows.items()})
        if key is not None:
            yield from ended()
        if out:
            yield table(out)

    return run


def tracker(dets: DataFrame, kind: str, settings_: Settings | None = None, base: str = "bytetrack") -> DataFrame:
    """Tracks by any kind, named in any case: those of :func:`trackers.track`, ``dummy`` (:func:`tracks.slots`) or
    ``bidirectional`` over ``base``. All give the columns of ``schema.TRACK``; unknown kinds raise. ``dummy`` shows
    confident detections as they are, each of age 1."""
    kind = kind.strip().lower()
    if kind == "dummy":
        made = tr.slots(detections(dets), None).withColumns({"width": F.col("x2") - F.col("x1"), "height": F.col("y2") - F.col("y1"), "last_seen": F.col("frame")})
        return conform(made, TRACK, should_blur=True, origin="forward", age=1)
    if kind == "bidirectional":
        made = bidirectional(dets, base.strip().lower(), settings_)
        return conform(made.withColumns({"width": F.col("x2") - F.col("x1"), "height": F.col("y2") - F.col("y1")}), TRACK)
    if kind not in KINDS:
        raise ValueError(f"no tracker {kind!r}; there are dummy, bidirectional, {', '.join(KINDS)}")
    return conform(track(dets, kind, settings_), TRACK, origin="forward")
