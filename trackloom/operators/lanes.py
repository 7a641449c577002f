"""Trackers, many videos side by side: one step takes a frame of each video of a lane.

The steps are those of ``trackers.step``, number by number, over the tracks of all videos of a lane at once. A lane is
``1 << BITS`` neighbouring video ids, so a task holds the live tracks of so many videos at most; with pictures it is
``1 << SEEN``, since a task holds a picture of each video.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from trackloom.operators.motion import DRIFT, IOU_LIMIT, MEASURED, START, TURN, assign, overlaps, to_tlwh, to_xyah
from trackloom.operators.pictures import Sight, picture

#: Videos of a lane, as a power of two, without and with pictures; pairs of tracks and detections that are compared at once,
#: if of several videos; rows that go out at once; pairs whose vectors are compared at once.
BITS, SEEN, PAIRS, ROWS, LOOKS = 5, 4, 1 << 20, 1 << 15, 1 << 14
_WHOLE = ("video", "id", "hits", "misses", "age", "seen", "hidden", "kept", "dim", "lost")
_LOOKS = ("mean_of", "mean_look", "looks")
#: What a pair has to overlap more than all others of its track and its detection together to be sure; far above rounding.
SURE = 1e-9


def lane(bits: int = BITS) -> Column:
    return F.shiftright("video_id", bits)


class Vectors:
    """A vector for each of some detections, of ``dim`` numbers and zeros behind them; ``dim`` is -1 where there is none."""

    def __init__(self, values: np.ndarray, dim: np.ndarray):
        self.values, self.dim = values, dim

    @classmethod
    def of(cls, found: list) -> Vectors:
        dim = np.array([-1 if v is None else len(v) for v in found], np.int64)
        values = np.zeros((len(found), int(dim.max(initial=0))))
        for i in np.flatnonzero(dim > 0):
            values[i, : dim[i]] = found[i]
        return cls(values, dim)

    def __getitem__(self, which: np.ndarray) -> Vectors:
        return Vectors(self.values[which], self.dim[which])


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.matmul(a[:, None, :], b[:, :, None])[:, 0, 0]


def _unit(v: np.ndarray) -> np.ndarray:
    return v / (np.sqrt(_dot(v, v)) + 1e-8)[:, None]


def _padded(v: np.ndarray, width: int) -> np.ndarray:
    return np.pad(v, [(0, 0)] * (v.ndim - 1) + [(0, width - v.shape[-1])]) if v.shape[-1] < width else v


def _pairs(own: np.ndarray, dets: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """These tracks, each with every detection of its video."""
    wide = dets[own[rows]]
    r = np.repeat(rows, wide)
    return r, np.arange(len(r)) - np.repeat(np.cumsum(wide) - wide - first[own[rows]], wide)


def _others(key: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """The largest of the other values under a key, 0 where there is none; keys are below ``n``."""
    top, second = np.zeros((2, n))
    np.maximum.at(top, key, value)
    best = value == top[key]
    np.maximum.at(second, key[~best], value[~best])
    alone = np.bincount(key[best], minlength=n) == 1
    return np.where(best & alone[key], second[key], top[key])


class Lane:
    """Live tracks of a lane's videos, in the order in which they began: a column for each property."""

    def __init__(self, rules, s, sight: Sight | None = None):
        self.rules, self.s, self.sight = rules, s, sight
        self.t = {c: np.zeros(0, np.int64) for c in _WHOLE} | {"score": np.zeros(0), "mean": np.zeros((0, 8)), "cov": np.zeros((0, 3)), "smooth": np.zeros((0, 4))}
        self.t |= {"mean_of": np.zeros((0, 0)), "mean_look": np.zeros((0, 0)), "looks": np.zeros((0, 3, 0)), "picture": np.zeros(0, object)}
        if rules.momentum:  # tracks that were seen again, so have two hits or more, have a move and a box before the last
            self.t |= {"last": np.zeros((0, 4)), "at": np.zeros(0, np.int64), "before": np.zeros((0, 4)), "move": np.zeros((0, 4))}
        self.next_id: dict[int, int] = {}
        self.centres: dict[int, np.ndarray] = {}
        self.images: dict[int, np.ndarray | None] = {}

    def step(self, frame: int, video: np.ndarray, tlwh: np.ndarray, score: np.ndarray, sure: np.ndarray, vectors: Vectors | None = None) -> list[np.ndarray]:
        """Advance the videos of these detections, sorted by video, by a frame; columns of the rows to show."""
        if vectors is not None:
            vectors = self._fitted(vectors)
        t, s = self.t, self.s
        videos, begin, count = np.unique(video, return_index=True, return_counts=True)
        at = np.searchsorted(videos, t["video"])
        active = np.flatnonzero(videos[np.minimum(at, len(videos) - 1)] == t["video"])
        active = active[np.argsort(at[active], kind="stable")]
        self._predict(active)
        is_high = score >= s.high
        is_low = ~is_high & (score >= max(0.0, s.low)) & s.low_pool
        pools = {"sure": sure, "high": is_high, "low": is_low, "all": np.ones(len(score), bool), "low_left": is_low}
        free_track, free_det = np.ones(len(active), bool), np.ones(len(score), bool)
        own, of_det = at[active], np.repeat(np.arange(len(videos)), count)
        met = []
        for round_ in self.rules.rounds:
            rows, cols = np.flatnonzero(free_track), np.flatnonzero(pools[round_.pool] & free_det)
            likes = None
            if round_.cost == "fused":
                likes = self._likes(active[rows], None if vectors is None else vectors[cols])
            r, c = self._associate(None if round_.cost == "iou" else getattr(s, round_.gate) or s.gate, t["smooth"][active[rows]], own[rows], tlwh[cols], of_det[cols], videos, likes)
            free_track[rows[r]] = free_det[cols[c]] = False
            met.append((active[rows[r]], cols[c]))
        to, by = (np.concatenate(x) for x in zip(*met, strict=True))
        self._see(to, by, tlwh, score, frame)
        if vectors is not None:
            self._remember(to, vectors[by], score[by])
        missed = active[free_track]
        if self.sight:
            self._start(to, video[by], tlwh[by], score[by])
            missed = missed[~self._shown(missed, own[free_track], videos, tlwh, score, np.flatnonzero(~sure & free_det), of_det, frame)]
        t["seen"][missed] = frame
        gone = t["misses"][missed] > s.max_misses
        t["hidden"][missed[gone]] = 1
        self._smooth(missed[~gone])
        fresh = np.flatnonzero(pools[self.rules.start] & free_det)
        born = self._add(fresh, video, tlwh, score, frame)
        if vectors is not None:
            self._remember(born, vectors[fresh], score[fresh])
        if s.camera:
            self.centres |= {int(v): tlwh[b : b + n, :2] + tlwh[b : b + n, 2:] / 2 for v, b, n in zip(videos, begin, count, strict=True)}
        t = self.t
        shown = np.r_[active, born]
        out = self._rows(shown[t["hidden"][shown] == 0], frame)
        live = np.ones(len(t["id"]), bool)
        if self.rules.prune and s.min_rate > 0:
            live &= t["hits"] / np.maximum(t["age"], 1) >= s.min_rate
        if s.forget_after is not None:
            live &= t["misses"] <= s.forget_after
        if not live.all():
            self.t = {k: v[: len(live)][live] for k, v in t.items()}
        return out

    def _predict(self, at: np.ndarray) -> None:
        t = self.t
        p, c, v = t["cov"][at].T
        t["mean"][at, :4] += t["mean"][at, 4:]
        t["cov"][at] = np.stack([p + 2 * c + v + DRIFT, c + v, v + TURN], axis=1)
        t["age"][at] += 1
        t["misses"][at] += 1
        if self.rules.momentum:
            moving = at[(t["hits"][at] > 1) & (t["misses"][at] <= 3)]
            t["mean"][moving, :4] += 0.5 * t["move"][moving]

    def _associate(self, gate: float | None, boxes: np.ndarray, own: np.ndarray, found: np.ndarray, of_det: np.ndarray, videos: np.ndarray, likes: Callable | None) -> tuple[np.ndarray, np.ndarray]:
        """Places of tracks and detections that meet; both are sorted by video. ``likes`` adds what else a pair costs;
        without a gate they meet by overlap."""
        n = len(videos)
        tracks, dets = np.bincount(own, minlength=n), np.bincount(of_det, minlength=n)
        first = np.r_[0, np.cumsum(dets)]
        if self.s.camera:
            boxes = self._shifted(boxes, own, found, of_det, first, videos)
        part = np.cumsum(tracks * dets) // PAIRS
        edge = np.r_[0, np.flatnonzero(np.diff(part)) + 1, n]
        row_edge = np.r_[0, np.cumsum(tracks)]
        parts = [np.arange(row_edge[a], row_edge[b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        out = [self._over(boxes, own, found, dets, first, rows) if gate is None else self._met(gate, boxes, own, found, dets, first, rows, likes) for rows in parts]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _met(self, gate: float, boxes: np.ndarray, own: np.ndarray, found: np.ndarray, dets: np.ndarray, first: np.ndarray, rows: np.ndarray, likes: Callable | None) -> tuple[np.ndarray, np.ndarray]:
        r, c = _pairs(own, dets, first, rows)
        x, y = ((boxes[:, k] + boxes[:, k + 2] / 2)[r] - (found[:, k] + found[:, k + 2] / 2)[c] for k in (0, 1))
        cost = np.sqrt(x * x + y * y)
        ok = cost <= gate
        r, c, cost = r[ok], c[ok], cost[ok]
        if likes:
            shape = lambda b: np.maximum(b[:, 2] / np.maximum(b[:, 3], 1e-6), 1e-6)
            more, ok = likes(r, c)
            cost = cost + 0.1 * np.minimum(1, np.abs(shape(boxes)[r] - shape(found)[c])) + more
            ok &= cost <= gate + 1
            r, c, cost = r[ok], c[ok], cost[ok]
        # where each track of a video has one detection within reach and the other way round, there is no choice
        several = (np.bincount(r, minlength=1)[r] > 1) | (np.bincount(c, minlength=1)[c] > 1)
        crowded = np.isin(own[r], own[r[several]])
        pick_r, pick_c = [r[~crowded]], [c[~crowded]]
        r, c, cost = r[crowded], c[crowded], cost[crowded]
        cut = np.r_[0, np.flatnonzero(np.diff(own[r])) + 1, len(r)] if len(r) else np.zeros(1, int)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            (near, i), (there, j) = (np.unique(v[a:b], return_inverse=True) for v in (r, c))
            costs = np.full((len(near), len(there)), gate + 10)
            costs[i, j] = cost[a:b]
            taken = [(p, q) for p, q in assign(costs) if costs[p, q] < gate + 10]
            pick_r.append(near[[p for p, _ in taken]])
            pick_c.append(there[[q for _, q in taken]])
        return np.concatenate(pick_r), np.concatenate(pick_c)

    def _over(self, boxes: np.ndarray, own: np.ndarray, found: np.ndarray, dets: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By overlap, as ``trackers._associate`` has it. A pair that overlaps more than what its track and its detection could
        have of others together is in every best choice; only videos where that leaves pairs open are worked out."""
        r, c = _pairs(own, dets, first, rows)
        x, y = (np.maximum(np.minimum((boxes[:, k] + boxes[:, k + 2])[r], (found[:, k] + found[:, k + 2])[c]) - np.maximum(boxes[r, k], found[c, k]), 0) for k in (0, 1))
        inner = x * y
        union = (boxes[:, 2] * boxes[:, 3])[r] + (found[:, 2] * found[:, 3])[c] - inner
        iou = np.divide(inner, union, out=np.zeros_like(inner), where=union > 0)
        ok = iou >= IOU_LIMIT
        near = np.flatnonzero(iou > 0)
        a, b, much = r[near], c[near], iou[near]
        sure = ok[near] & (much > _others(a, much, len(boxes)) + _others(b, much, len(found)) + SURE)
        met_r, met_c = np.zeros(len(boxes), bool), np.zeros(len(found), bool)
        met_r[a[sure]] = met_c[b[sure]] = True
        open_ = np.unique(own[r[ok & ~met_r[r] & ~met_c[c]]])
        stay = sure & ~np.isin(own[a], open_)
        pick_r, pick_c = [a[stay]], [b[stay]]
        begin, end = np.searchsorted(own[r], open_), np.searchsorted(own[r], open_, "right")
        for i, j, m in zip(begin.tolist(), end.tolist(), dets[open_].tolist(), strict=True):
            cost, good, there = (1 - iou[i:j]).reshape(-1, m), ok[i:j].reshape(-1, m), r[i:j:m]
            apart = np.flatnonzero((cost == 1).all(axis=1))  # no more of these can be taken than there are detections
            if len(apart) > m:
                kept = np.delete(np.arange(len(there)), apart[m:])
                cost, good, there = cost[kept], good[kept], there[kept]
            taken = [(p, q) for p, q in assign(cost) if good[p, q]]
            pick_r.append(there[np.array([p for p, _ in taken], np.int64)])
            pick_c.append(c[i] + np.array([q for _, q in taken], np.int64))
        return np.concatenate(pick_r), np.concatenate(pick_c)

    def _fitted(self, vectors: Vectors) -> Vectors:
        """Vectors as wide as those that tracks hold."""
        width = max(vectors.values.shape[1], self.t["mean_of"].shape[1])
        self.t |= {c: _padded(self.t[c], width) for c in _LOOKS}
        return Vectors(_padded(vectors.values, width), vectors.dim)

    def _likes(self, at: np.ndarray, vectors: Vectors | None) -> Callable:
        """What pairs of these tracks and detections cost by their vectors, and which may meet; those without pass."""
        t, s = self.t, self.s
        units = None if vectors is None else _unit(vectors.values)

        def likes(r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            more, ok = np.zeros(len(r)), np.ones(len(r), bool)
            both = np.zeros(0, int) if units is None else np.flatnonzero((t["kept"][at[r]] > 0) & (vectors.dim[c] >= 0))
            for a in range(0, len(both), LOOKS):
                some = both[a : a + LOOKS]
                mean, best = self._like(at[r[some]], units[c[some]], vectors.dim[c[some]])
                ok[some] = np.minimum(mean, best) >= s.embedding_gate
                more[some] = 0.3 * (1 - mean) + 0.2 * (1 - best)
            return more, ok

        return likes

    def _like(self, at: np.ndarray, units: np.ndarray, dim: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How much tracks look like unit vectors: in the mean, and at best of those seen last."""
        t = self.t
        if (t["dim"][at] != dim).any():
            raise ValueError("vectors of a video differ in length")
        best = np.full(len(at), -np.inf)
        for k in range(3):
            there = np.flatnonzero(t["kept"][at] > k)
            best[there] = np.maximum(best[there], _dot(t["looks"][at[there], k], units[there]))
        return _dot(t["mean_look"][at], units), best

    def _remember(self, at: np.ndarray, vectors: Vectors, weight: np.ndarray) -> None:
        """Tracks keep the last three vectors and a mean."""
        t, some = self.t, np.flatnonzero(vectors.dim >= 0)
        if len(some):
            at, units, dim = at[some], _unit(vectors.values[some]), vectors.dim[some]
            new = t["kept"][at] == 0
            if (t["dim"][at[~new]] != dim[~new]).any():
                raise ValueError("vectors of a video differ in length")
            t["dim"][at] = dim
            t["looks"][at, t["kept"][at] % 3] = units
            t["kept"][at] += 1
            t["mean_of"][at[new]] = units[new]
            t["mean_look"][at[new]] = _unit(units[new])
            self._blend(at[~new], units[~new], weight[some][~new])

    def _blend(self, at: np.ndarray, units: np.ndarray, weight: np.ndarray) -> None:
        mean = _unit(0.5 * self.t["mean_of"][at] + (0.5 * np.maximum(weight, 1e-3))[:, None] * units)
        self.t["mean_of"][at], self.t["mean_look"][at] = mean, _unit(mean)

    def show(self, video: int, width: int | None, height: int | None, data: bytes | None) -> None:
        """The picture of a video until its next one; one that shows the same again stays the same object."""
        before, now = self.images.get(video), picture(width, height, data)
        same = before is not None and now is not None and before.shape == now.shape and before.data == now.data
        self.images[video] = before if same else now

    def _start(self, at: np.ndarray, video: np.ndarray, tlwh: np.ndarray, score: np.ndarray) -> None:
        """Tracks that detections met remember the pictures there."""
        begun, held, found = self.sight.start_many([self.images.get(v) for v in video.tolist()], tlwh)
        self.t["picture"][at[begun]] = held
        if self.sight.vector:
            self._remember(at[begun], self._fitted(Vectors.of(found)), score[begun])

    def _shown(self, missed: np.ndarray, own: np.ndarray, videos: np.ndarray, tlwh: np.ndarray, score: np.ndarray, spare: np.ndarray, of_det: np.ndarray, frame: int) -> np.ndarray:
        """Which of these tracks pictures keep, as ``trackers._shown`` has it for each in turn."""
        t, s, shown = self.t, self.s, np.zeros(len(missed), bool)
        tired = (t["misses"][missed] > s.visual_age) | (t["lost"][missed] > 0)
        t["picture"][missed[tired]] = None
        images = [self.images.get(v) for v in videos.tolist()]
        ask = np.array([i for i in np.flatnonzero(~tired).tolist() if t["picture"][missed[i]] is not None and images[own[i]] is not None], np.int64)
        found, box, vectors = self.sight.find_many([images[v] for v in own[ask].tolist()], t["picture"][missed[ask]].tolist())
        ask = ask[found]
        if self.sight.vector and len(ask):
            looks = self._fitted(Vectors.of(vectors))
            t = self.t
            both = np.flatnonzero((looks.dim >= 0) & (t["kept"][missed[ask]] > 0))
            at, units, dim = missed[ask[both]], _unit(looks.values[both]), looks.dim[both]
            bad = self._like(at, units, dim)[0] < s.embedding_gate
            self._blend(at[~bad], units[~bad], t["score"][at[~bad]])
            bad[~bad] = self._like(at[~bad], units[~bad], dim[~bad])[1] < s.embedding_gate
            t["lost"][at[bad]] = 1
            shown[ask[both[bad]]] = True
            stay = np.delete(np.arange(len(ask)), both[bad])
            ask, box = ask[stay], box[stay]
        if s.drift > 0 and len(ask):
            x, y = (box[:, k] + box[:, k + 2] / 2 - (t["smooth"][missed[ask], k] + t["smooth"][missed[ask], k + 2] / 2) for k in (0, 1))
            close = ~(np.sqrt(x * x + y * y) > s.drift)
            ask, box = ask[close], box[close]
        shown[ask] = True
        met = self._spare(box, own[ask], tlwh, spare, of_det)
        by, left = np.array([d for _, d in met], np.int64), np.delete(np.arange(len(ask)), [i for i, _ in met])
        at = missed[ask[[i for i, _ in met]]] if met else np.zeros(0, np.int64)
        self._see(at, by, tlwh, score, frame)
        self._start(at, videos[of_det[by]], tlwh[by], score[by])
        at = missed[ask[left]]
        self._measure(at, box[left])
        self._smooth(at)
        t["score"][at] *= 0.9
        t["seen"][at], t["misses"][at] = frame, 0
        return shown

    def _spare(self, box: np.ndarray, own: np.ndarray, tlwh: np.ndarray, spare: np.ndarray, of_det: np.ndarray) -> list[tuple[int, int]]:
        """Boxes of pictures, in order, with the spare detection of their video that each lies over most, each used once."""
        met = []
        for v in np.intersect1d(own, of_det[spare]).tolist():
            left, boxes = spare[of_det[spare] == v].tolist(), np.flatnonzero(own == v)
            over = overlaps(box[boxes], tlwh[left])
            for i in np.flatnonzero((over > 0.1).any(axis=1)).tolist():
                best = int(over[i].argmax())
                if over[i, best] > 0.1:
                    met.append((int(boxes[i]), left[best]))
                    over[:, best] = -1
        return met

    def _shifted(self, boxes: np.ndarray, own: np.ndarray, found: np.ndarray, of_det: np.ndarray, first: np.ndarray, videos: np.ndarray) -> np.ndarray:
        """Boxes less the mean shift of their video's first centres since its frame before."""
        shift = np.zeros((len(videos), 2))
        for i in np.unique(of_det).tolist():
            before = self.centres.get(int(videos[i]))
            if before is not None and len(before):
                now = found[first[i] : first[i + 1]][: len(before)]
                shift[i] = (now[:, :2] + now[:, 2:] / 2 - before[: len(now)]).mean(axis=0)
        return boxes - np.pad(shift, ((0, 0), (0, 2)))[own]

    def _measure(self, at: np.ndarray, tlwh: np.ndarray) -> None:
        t = self.t
        p, c, v = t["cov"][at].T
        gain, turn = p / (p + MEASURED), c / (p + MEASURED)
        miss = to_xyah(tlwh) - t["mean"][at, :4]
        t["mean"][at, :4] += gain[:, None] * miss
        t["mean"][at, 4:] += turn[:, None] * miss
        t["cov"][at] = np.stack([(1 - gain) * p, (1 - gain) * c, v - turn * c], axis=1)

    def _see(self, at: np.ndarray, by: np.ndarray, tlwh: np.ndarray, score: np.ndarray, frame: int) -> None:
        t = self.t
        self._measure(at, tlwh[by])
        if self.rules.momentum:
            self._move(at, tlwh[by], frame)
        t["lost"][at] = 0
        t["score"][at], t["seen"][at], t["misses"][at], t["hidden"][at] = score[by], frame, 0, 0
        t["hits"][at] += 1
        self._smooth(at)

    def _move(self, at: np.ndarray, box: np.ndarray, frame: int) -> None:
        """Tracks remember how they moved; those that were away follow observations on the way there, from the one before the last."""
        t = self.t
        gap = np.maximum(1, frame - t["at"][at])
        t["move"][at] = (box - t["last"][at]) / gap[:, None]
        away = np.flatnonzero((gap > 1) & (t["hits"][at] > 1))
        self._follow(at[away], t["before"][at[away]], box[away], gap[away])
        t["before"][at], t["last"][at], t["at"][at] = t["last"][at], box, frame

    def _follow(self, at: np.ndarray, start: np.ndarray, box: np.ndarray, gap: np.ndarray) -> None:
        """Measurements on the lines between boxes, one for each frame between, of all tracks that still have one."""
        t, order = self.t, np.argsort(-gap, kind="stable")
        at, start, way, gap = at[order], start[order], (box - start)[order], gap[order]
        mean, (p, c, v) = t["mean"][at], t["cov"][at].T.copy()
        left = np.bincount(gap, minlength=1)
        left = len(gap) - np.cumsum(left)
        for k in range(1, int(gap.max(initial=0))):
            n = left[k]
            gain, turn = p[:n] / (p[:n] + MEASURED), c[:n] / (p[:n] + MEASURED)
            miss = to_xyah(start[:n] + way[:n] * (k / gap[:n])[:, None]) - mean[:n, :4]
            mean[:n, :4] += gain[:, None] * miss
            mean[:n, 4:] += turn[:, None] * miss
            p[:n], c[:n], v[:n] = (1 - gain) * p[:n], (1 - gain) * c[:n], v[:n] - turn * c[:n]
        t["mean"][at], t["cov"][at] = mean, np.stack([p, c, v], axis=1)

    def _smooth(self, at: np.ndarray) -> None:
        t, weight = self.t, self.s.smooth
        t["smooth"][at] = weight * to_tlwh(t["mean"][at, :4]) + (1 - weight) * t["smooth"][at]

    def _add(self, fresh: np.ndarray, video: np.ndarray, tlwh: np.ndarray, score: np.ndarray, frame: int) -> np.ndarray:
        """A track for each of these detections, in order; where they stand."""
        k, n = len(fresh), len(self.t["id"])
        if k:
            videos, begin, count = np.unique(video[fresh], return_index=True, return_counts=True)
            base = np.array([self.next_id.get(v, 1) for v in videos.tolist()])
            self.next_id |= dict(zip(videos.tolist(), (base + count).tolist(), strict=True))
            box = tlwh[fresh]
            made = {"video": video[fresh], "id": np.arange(k) + np.repeat(base - begin, count), "hits": 1, "misses": 0, "age": 1, "seen": frame, "hidden": 0, "score": score[fresh], "kept": 0, "dim": 0, "lost": 0, "picture": None, "at": frame}
            for c in _LOOKS:  # these are wide, so they have room for more tracks than there are
                if n + k > len(self.t[c]):
                    self.t[c] = np.concatenate([self.t[c][:n], np.zeros((k + n // 2, *self.t[c].shape[1:]))])
                self.t[c][n : n + k] = 0
            wide = {"mean": np.concatenate([to_xyah(box), np.zeros((k, 4))], axis=1), "cov": np.tile([START, 0.0, START], (k, 1)), "smooth": box, "last": box, "before": np.zeros((k, 4)), "move": np.zeros((k, 4))}
            self.t = {c: np.concatenate([v, wide[c] if c in wide else np.broadcast_to(made[c], k)]) if c not in _LOOKS else v for c, v in self.t.items()}
        return np.arange(n, n + k)

    def _rows(self, at: np.ndarray, frame: int) -> list[np.ndarray]:
        t, s = self.t, self.s
        box = t["smooth"][at]
        x, y = (np.clip(box[:, k] - box[:, k + 2] * s.dilate / 2, 0, 1) for k in (0, 1))
        w, h = (np.clip(box[:, k] * (1 + s.dilate), 0, 1 - c) for k, c in ((2, x), (3, y)))
        confirmed = t["hits"][at] >= s.confirm_after
        return [t["video"][at], np.full(len(at), frame), t["id"][at], x, y, x + w, y + h, w, h, confirmed, t["age"][at], t["seen"][at], t["score"][at]]


def walk(rules, s, names: list[str]):
    """Walks detections sorted by lane, frame, video and ``det_id``; a lane's last frame waits for the next batch."""
    return look(rules, s, names, False)


def look(rules, s, names: list[str], vectors: bool, sight: Callable[[], Sight] | None = None, sides: bool = False):
    """As :func:`walk`, for rounds whose costs know the ``embedding`` of detections, where there are any. With a ``sight`` rows of
    pictures stand before those of their video's frame (``pictures.beside``). With ``sides`` a lane's rows are sorted by ``_side`` first,
    each side is walked for itself, and rows tell theirs."""
    bits = SEEN if sight else BITS

    def table(out: list[list[np.ndarray]]):
        import pyarrow as pa

        columns = [np.concatenate(x) for x in zip(*out, strict=True)]
        state = pa.DictionaryArray.from_arrays(columns[9].astype(np.int8), ["tentative", "confirmed"]).cast(pa.string())
        arrays = [*map(pa.array, columns[:9]), state, *map(pa.array, columns[10:13]), pa.array(np.ones(len(columns[0]), bool)), *map(pa.array, columns[13:])]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches: Iterator) -> Iterator:
        key, tracks, held, out, size, seen = None, None, None, [], 0, sight() if sight else None
        columns = ["video_id", "frame", "x1", "y1", "x2", "y2", "confidence", "is_confident", *["embedding"] * vectors, *["_picture", "width", "height", "pixels"] * bool(sight), *["_side"] * sides]

        def pictured(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
            """Shows the pictures of a frame, the first of each video; the rows of detections that are left."""
            shown = rows["_picture"] == 0
            for i in np.flatnonzero(shown)[np.unique(rows["video_id"][shown], return_index=True)[1]].tolist():
                width, height = (None if v is None or v != v else int(v) for v in (rows["width"][i], rows["height"][i]))
                tracks.show(int(rows["video_id"][i]), width, height, rows["pixels"][i])
            return {c: v[~shown] for c, v in rows.items()}

        def frames(rows: dict[str, np.ndarray], last: bool) -> Iterator:
            nonlocal key, tracks, held
            place, side = rows["video_id"] >> bits, rows["_side"] if sides else np.zeros(len(rows["frame"]), np.int8)
            edge = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (side[1:] != side[:-1]) | (rows["frame"][1:] != rows["frame"][:-1]), True]).tolist()
            held = None if last else {c: v[edge[-2] :] for c, v in rows.items()}
            stop = len(edge) - 1 if last else len(edge) - 2
            for a, b in zip(edge[:stop], edge[1 : stop + 1], strict=True):
                if key != (key := (int(place[a]), int(side[a]))):
                    tracks = Lane(rules, s, seen)
                own = {c: v[a:b] for c, v in rows.items()}
                if sight:
                    own = pictured(own)
                    if not len(own["frame"]):
                        continue
                x1, y1, x2, y2, score = (own[c].astype(float) for c in ("x1", "y1", "x2", "y2", "confidence"))
                looks = Vectors.of(own["embedding"].tolist()) if vectors else None
                found = tracks.step(int(own["frame"][0]), own["video_id"], np.stack([x1, y1, x2 - x1, y2 - y1], axis=1), score, own["is_confident"].astype(bool), looks)
                yield [*found, np.full(len(found[0]), side[a])] if sides else found

        for batch in batches:
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
            rows |= {c: rows[c].astype(np.int64) for c in ("video_id", "frame")}
            if held:
                rows = {c: np.concatenate([held[c], v]) for c, v in rows.items()}
            if not len(rows["frame"]):
                continue
            for found in frames(rows, False):
                out.append(found)
                size += len(found[0])
                if size >= ROWS:
                    yield table(out)
                    out, size = [], 0
        if held:
            out += frames(held, True)
        if out:
            yield table(out)

    return run
