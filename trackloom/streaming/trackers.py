"""Trackers over unbounded detections: the batch step function, with an entry in Spark's state store for each track."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trackloom.operators import trackers

#: A video's place, and what a track's entry holds beside its id, which is the key.
PLACE = "last long, next_id long, centres array<array<double>>"
ENTRY = (
    "mean array<double>, cov array<double>, smooth array<double>, number array<double>, last array<double>, at long, "
    "before array<double>, move array<double>, lost boolean, seen array<array<double>>, look array<double>, mask long"
)
_VECTORS, _NUMBERS = ("last", "before", "move"), ("hits", "misses", "age", "seen", "hidden", "score")


def entries(t: trackers.Tracks) -> dict[int, tuple]:
    """Live tracks by id, as rows of ``ENTRY``."""
    plain = lambda v: None if v is None else np.asarray(v, float).tolist()
    out = {}
    for i, e in enumerate(t.extra):
        numbers = [float(t.number[c][i]) for c in _NUMBERS]
        last, before, move = (plain(e.get(c)) for c in _VECTORS)
        seen = [plain(v) for v in e["seen"]] if "seen" in e else None
        out[int(t.number["id"][i])] = (plain(t.filters.mean[i]), plain(t.filters.cov[i]), plain(t.smooth[i]), numbers, last, int(e["at"]), before, move, bool(e.get("lost")), seen, plain(e.get("mean")), e.get("mask"))
    return out


def restored(rows: dict[int, tuple], next_id: int, centres: list | None) -> trackers.Tracks:
    """The tracks that ``entries`` were made of, in the order of their ids."""
    t = trackers.Tracks(next_id=int(next_id), centres=None if centres is None else np.array([list(c) for c in centres], float).reshape(-1, 2))
    if not rows:
        return t
    ids = sorted(rows)
    found = [rows[i] for i in ids]
    whole = lambda k: np.array([list(r[k]) for r in found], float)
    t.filters.mean, t.filters.cov, t.smooth, numbers = (whole(k) for k in range(4))
    t.number = {"id": np.array(ids), **dict(zip(_NUMBERS, numbers.T.copy(), strict=True))}
    for _, _, _, _, last, at, before, move, lost, seen, look, mask in found:
        e = {"at": int(at), "lost": bool(lost), "mask": mask}
        e |= {c: np.array(v, float) for c, v in zip(_VECTORS, (last, before, move), strict=True) if v is not None}
        e |= {} if seen is None else {"seen": [np.array(list(v), float) for v in seen]}
        e |= {} if look is None else {"mean": np.array(look, float)}
        t.extra.append(e)
    return t


class Tracker(StatefulProcessor):
    """State of a video: its place as a value, its tracks as a map. A timer ends a video that sends nothing."""

    def __init__(self, kind: str, settings: trackers.Settings, columns: list[str], idle_ms: int | None):
        self.kind, self.settings, self.columns, self.idle_ms = kind, settings, columns, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", PLACE)
        self.tracks = handle.getMapState("tracks", "track_id long", ENTRY)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kind, s = self.kind, self.settings
        last, next_id, centres = self.place.get() if self.place.exists() else (-1, 1, None)
        before = {int(k[0]): tuple(v) for k, v in self.tracks.iterator()} if self.tracks.exists() else {}
        t = restored(before, next_id, centres)
        out, given = [], pd.concat(list(rows)).sort_values(["frame", "det_id"], kind="stable")
        for frame, of_frame in given[given["frame"] > last].groupby("frame", sort=True):
            found = trackers.step(kind, s, t, int(frame), trackers._frame_of({c: of_frame[c].to_numpy() for c in self.columns}))
            out += trackers._rows_of(int(key[0]), int(frame), found, self.columns)
            last = int(frame)
        after = entries(t)
        for i in before.keys() - after.keys():
            self.tracks.removeKey((i,))
        for i, row in after.items():
            if row != before.get(i):
                self.tracks.updateValue((i,), row)
        self.place.update((int(last), int(t.next_id), None if t.centres is None else t.centres.tolist()))
        if self.idle_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=[c.strip().split(" ")[0] for c in trackers.output(self.columns).split(",")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.place.clear()
        self.tracks.clear()
        return iter(())

    def close(self) -> None:
        pass


def track_stream(dets: DataFrame, kind: str = "sort", settings_: trackers.Settings | None = None, idle_ms: int | None = None) -> DataFrame:
    """Tracks of a stream of detections, keyed by ``video_id``; rows are those of the batch tracker.

    A micro-batch must hold whole frames, a video's frames in rising order over the batches. Frames that were
    already passed are dropped. Each track is an entry of its own in the state store, so a batch writes what it changed.
    Set ``forget_after`` so that tracks out of sight leave the state; with ``idle_ms`` a video without detections for so
    long leaves it as a whole, and would start anew (a stream then runs batches without data as time passes, unless
    ``spark.sql.streaming.noDataMicroBatches.enabled`` is false). An ``embedding`` column is used as in the batch. The
    session needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    kind = kind.lower()
    s, columns = settings_ or trackers.settings(kind, forget_after=300), trackers.input_columns(dets, kind)
    made = Tracker(kind, s, columns, idle_ms)
    return dets.select(*columns).groupBy("video_id").transformWithStateInPandas(made, trackers.output(columns), "Append", "None" if idle_ms is None else "ProcessingTime")
