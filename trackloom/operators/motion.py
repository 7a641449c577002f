"""Constant-velocity filters of many tracks at once, and one-to-one assignment: the numeric core of the trackers."""

from __future__ import annotations

import numpy as np

#: Variances: measurement, start, position and velocity drift a frame. Fixed values.
MEASURED, START, DRIFT, TURN = 0.01, 10.0, 1.0, 0.01
#: Overlap from which on a track and a detection may meet in rounds by overlap. Fixed value.
IOU_LIMIT = 0.3
#: Columns up to which an assignment is worked out without arrays.
NARROW = 64


def to_xyah(tlwh: np.ndarray) -> np.ndarray:
    """Centre, aspect, height of boxes given as left, top, width, height."""
    h = np.maximum(tlwh[..., 3], 1e-6)
    return np.stack([tlwh[..., 0] + tlwh[..., 2] / 2, tlwh[..., 1] + tlwh[..., 3] / 2, tlwh[..., 2] / h, h], axis=-1)


def to_tlwh(xyah: np.ndarray) -> np.ndarray:
    w = xyah[..., 2] * xyah[..., 3]
    return np.stack([xyah[..., 0] - w / 2, xyah[..., 1] - xyah[..., 3] / 2, w, xyah[..., 3]], axis=-1)


class Filters:
    """``mean`` holds four values and their velocities. All four share one covariance, three numbers a track."""

    def __init__(self, n: int = 0):
        self.mean, self.cov = np.zeros((n, 8)), np.tile([START, 0.0, START], (n, 1))

    def add(self, tlwh: np.ndarray) -> None:
        """A filter for each box; one box may come without the outer dimension."""
        boxes = np.atleast_2d(tlwh)
        self.mean = np.concatenate([self.mean, np.concatenate([to_xyah(boxes), np.zeros((len(boxes), 4))], axis=1)])
        self.cov = np.concatenate([self.cov, np.tile([START, 0.0, START], (len(boxes), 1))])

    def keep(self, which: np.ndarray) -> None:
        self.mean, self.cov = self.mean[which], self.cov[which]

    def predict(self) -> None:
        p, c, v = self.cov.T
        self.mean[:, :4] += self.mean[:, 4:]
        self.cov = np.stack([p + 2 * c + v + DRIFT, c + v, v + TURN], axis=1)

    def update(self, at: int | np.ndarray, tlwh: np.ndarray) -> None:
        """A measurement of one track, or one of each of several tracks."""
        at = np.atleast_1d(at)
        p, c, v = self.cov[at].T
        gain, turn = p / (p + MEASURED), c / (p + MEASURED)
        miss = to_xyah(np.atleast_2d(tlwh)) - self.mean[at, :4]
        self.mean[at, :4] += gain[:, None] * miss
        self.mean[at, 4:] += turn[:, None] * miss
        self.cov[at] = np.stack([(1 - gain) * p, (1 - gain) * c, v - turn * c], axis=1)

    def follow(self, at: int, path: np.ndarray) -> None:
        """Measurements of one track, one after another, number by number: what :meth:`update` gives for each in turn."""
        mean, (p, c, v) = self.mean[at].tolist(), self.cov[at].tolist()
        for seen in to_xyah(path).tolist():
            gain, turn = p / (p + MEASURED), c / (p + MEASURED)
            for k in range(4):
                miss = seen[k] - mean[k]
                mean[k] += gain * miss
                mean[k + 4] += turn * miss
            p, c, v = (1 - gain) * p, (1 - gain) * c, v - turn * c
        self.mean[at], self.cov[at] = mean, (p, c, v)


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) with the least total cost; as many as the shorter side has.

    Shortest augmenting paths with potentials; among equal totals the one that rows, in order, find first.
    """
    if cost.size == 0:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assign(cost.T))
    n, m = cost.shape
    if m <= NARROW:
        return _assign_narrow(cost.tolist(), m)
    u, v, row_of = np.zeros(n), np.zeros(m), np.full(m, -1)
    for r in range(n):
        dist, via, open_ = np.full(m, np.inf), np.full(m, -1), np.ones(m, bool)
        row, column, length = r, -1, 0.0
        while True:
            reach = length + cost[row] - u[row] - v
            better = open_ & (reach < dist)
            dist[better], via[better] = reach[better], column
            column = int(np.argmin(np.where(open_, dist, np.inf)))
            length = dist[column]
            open_[column] = False
            if row_of[column] < 0:
                break
            row = row_of[column]
        done = np.flatnonzero(~open_)
        u[r] += length
        for c in done:
            if row_of[c] >= 0:
                u[row_of[c]] += length - dist[c]
            v[c] -= length - dist[c]
        while column >= 0:
            before = via[column]
            row_of[column] = row_of[before] if before >= 0 else r
            column = before
    return sorted((int(r), c) for c, r in enumerate(row_of.tolist()) if r >= 0)


def _assign_narrow(cost: list[list[float]], m: int) -> list[tuple[int, int]]:
    """The same steps number by number: arrays this short cost more to call than to compute."""
    u, v, row_of = [0.0] * len(cost), [0.0] * m, [-1] * m
    for r in range(len(cost)):
        dist, via, free, done = [np.inf] * m, [-1] * m, list(range(m)), []
        row, column, length = r, -1, 0.0
        while True:
            line, off, best, least = cost[row], u[row], free[0], np.inf
            for j in free:
                reach = length + line[j] - off - v[j]
                if reach < dist[j]:
                    dist[j], via[j] = reach, column
                if dist[j] < least:
                    best, least = j, dist[j]
            column, length = best, dist[best]
            free.remove(column)
            done.append(column)
            if row_of[column] < 0:
                break
            row = row_of[column]
        u[r] += length
        for c in done:
            if row_of[c] >= 0:
                u[row_of[c]] += length - dist[c]
            v[c] -= length - dist[c]
        while column >= 0:
            before = via[column]
            row_of[column] = row_of[before] if before >= 0 else r
            column = before
    return sorted((r, c) for c, r in enumerate(row_of) if r >= 0)


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of every box of one list with every one of the other, as left, top, width, height."""
    low = np.maximum(a[:, None, :2], b[None, :, :2])
    high = np.minimum(a[:, None, :2] + a[:, None, 2:], b[None, :, :2] + b[None, :, 2:])
    inner = np.prod(np.maximum(high - low, 0), axis=2)
    union = np.prod(a[:, 2:], axis=1)[:, None] + np.prod(b[:, 2:], axis=1)[None, :] - inner
    return np.divide(inner, union, out=np.zeros_like(inner), where=union > 0)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance between every two centres."""
    x, y = (((a[:, k] + a[:, k + 2] / 2)[:, None] - (b[:, k] + b[:, k + 2] / 2)[None]) for k in (0, 1))
    return np.sqrt(x * x + y * y)
