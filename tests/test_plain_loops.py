"""Trackers and redaction against plain loops: one object a track, dense filters, one frame at a time."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import motion as M
from trackloom.operators import nms, pictures
from trackloom.operators import tracks as tr
from trackloom.operators import trackers
from trackloom.plans import queries as plans
from trackloom.sources import tables

DATA = "/root/testdata/sf0.001"
#: Gates of each round, by tracker: fixed values.
GATES = {"sort": [0.4], "bytetrack": [0.05, 0.05], "botsort": [0.05, 0.02, 0.02], "oc_sort": [0.3, 0.3], "fused": [0.08, 0.15], "hybrid_sot": [0.05, 0.02]}
RULES = {
    "sort": dict(confirm=2, misses=8, smooth=0.65),
    "bytetrack": dict(confirm=2, misses=10, smooth=1.0),
    "botsort": dict(confirm=3, misses=5, smooth=1.0),
    "oc_sort": dict(confirm=2, misses=10, smooth=0.9),
    "fused": dict(confirm=3, misses=5, smooth=1.0),
    "hybrid_sot": dict(confirm=5, misses=2, smooth=1.0, dilate=0.25, low=False),
}
MOVE, SEE = np.eye(8), np.eye(4, 8)
MOVE[:4, 4:] = np.eye(4)


def xyah(b):
    x, y, w, h = b
    return np.array([x + w / 2, y + h / 2, w / max(h, 1e-6), max(h, 1e-6)])


def tlwh(m):
    return np.array([m[0] - m[2] * m[3] / 2, m[1] - m[3] / 2, m[2] * m[3], m[3]])


def centre(b):
    return b[0] + b[2] / 2, b[1] + b[3] / 2


def cosine(a, b):
    return float((a / (np.linalg.norm(a) + 1e-8)) @ (b / (np.linalg.norm(b) + 1e-8)))


def overlap(a, b):
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    inner = max(w, 0) * max(h, 0)
    return inner / (a[2] * a[3] + b[2] * b[3] - inner)


class Track:
    def __init__(self, number, box, score, frame):
        self.id, self.mean, self.cov = number, np.r_[xyah(box), np.zeros(4)], np.eye(8) * 10
        self.hits, self.misses, self.age, self.seen, self.score, self.hidden = 1, 0, 1, frame, score, False
        self.shown, self.last, self.at, self.before, self.move = np.array(box), np.array(box), frame, None, None
        self.looks, self.mean_look, self.held = [], None, None

    def look(self, vector, weight):
        unit = vector / (np.linalg.norm(vector) + 1e-8)
        mixed = unit if self.mean_look is None else 0.5 * self.mean_look + 0.5 * max(weight, 1e-3) * unit
        self.mean_look = mixed if self.mean_look is None else mixed / (np.linalg.norm(mixed) + 1e-8)
        self.looks = [*self.looks, vector][-3:]

    def predict(self):
        self.mean, self.cov = MOVE @ self.mean, MOVE @ self.cov @ MOVE.T + np.diag([1.0] * 4 + [0.01] * 4)
        self.age += 1
        self.misses += 1

    def measure(self, box):
        gain = self.cov @ SEE.T @ np.linalg.inv(SEE @ self.cov @ SEE.T + 0.01 * np.eye(4))
        self.mean = self.mean + gain @ (xyah(box) - SEE @ self.mean)
        self.cov = self.cov - gain @ SEE @ self.cov


def pairs(kind, tracks, found, gate, shift):
    """Pairs of least total cost among those within the gate; what has no such pair takes no part."""
    cost = np.full((len(tracks), len(found)), np.inf)
    for i, t in enumerate(tracks):
        for j, d in enumerate(found):
            if kind == "oc_sort":
                cost[i, j] = 1 - overlap(t.shown, d[0])
                continue
            (ax, ay), (bx, by) = centre(t.shown), centre(d[0])
            far = math.hypot(ax - shift[0] - bx, ay - shift[1] - by)
            if far > gate:
                continue
            if kind in ("fused", "hybrid_sot") and len(d) == 3:
                aspect = [max(b[2] / max(b[3], 1e-6), 1e-6) for b in (t.shown, d[0])]
                far += 0.1 * min(1, abs(aspect[0] - aspect[1]))
            elif kind in ("fused", "hybrid_sot"):
                aspect = [max(b[2] / max(b[3], 1e-6), 1e-6) for b in (t.shown, d[0])]
                far += 0.1 * min(1, abs(aspect[0] - aspect[1]))
                like = [cosine(t.mean_look, d[3]), max(cosine(v, d[3]) for v in t.looks)]
                if min(like) < 0.55:
                    continue
                far += 0.3 * (1 - like[0]) + 0.2 * (1 - like[1])
                if far > gate + 1:
                    continue
            cost[i, j] = far
    if kind == "oc_sort":
        return [(i, j) for i, j in M.assign(cost) if 1 - cost[i, j] >= gate]
    rows, cols = np.flatnonzero(np.isfinite(cost).any(axis=1)), np.flatnonzero(np.isfinite(cost).any(axis=0))
    small = cost[np.ix_(rows, cols)]
    return [(rows[i], cols[j]) for i, j in M.assign(np.where(np.isfinite(small), small, gate + 10)) if np.isfinite(small[i, j])]


def cut(image, box):
    """A fifth more than the box, in whole pixels of the image, and what is there in grey."""
    height, width = image.shape
    x, y, w, h = (round(v * n) for v, n in zip(box, (width, height) * 2))
    left, top, across, down = round(x + w / 2 - w * 0.6), round(y + h / 2 - h * 0.6), round(w * 1.2), round(h * 1.2)
    x1, y1, x2, y2 = max(left, 0), max(top, 0), min(left + across, width), min(top + down, height)
    return (x1, y1, x2 - x1, y2 - y1), image[y1:y2, x1:x2]


def seek(image, held, reach=8, least=0.7):
    """The place within reach that correlates most with what is held."""
    (x, y, w, h), part = held
    best = None
    for ny in range(max(y - reach, 0), min(y + reach, image.shape[0] - h) + 1):
        for nx in range(max(x - reach, 0), min(x + reach, image.shape[1] - w) + 1):
            like = round(np.corrcoef(image[ny : ny + h, nx : nx + w].ravel(), part.ravel())[0, 1], 9)
            rank = (-like, math.hypot(nx - x, ny - y), ny, nx)
            if like >= least and (best is None or rank < best):
                best = rank
    return best and (best[3], best[2], w, h)


def looked(t, frame, image, found, matched):
    """Whether a picture keeps a track that no detection met."""
    if image is None or t.held is None or t.misses > 10:
        t.held = None if t.misses > 10 else t.held
        return False
    at = seek(image, t.held)
    if at is None:
        return False
    t.held = (at, t.held[1])
    box = np.array(at) / np.tile(image.shape[::-1], 2)
    if math.dist(centre(box), centre(t.shown)) > 0.05:
        return False
    spare = [d for d in found if not d[2] and id(d) not in matched]
    near = max(spare, key=lambda d: overlap(box, d[0]), default=None)
    t.misses, t.seen = 0, frame
    if near is not None and overlap(box, near[0]) > 0.1:
        matched.add(id(near))
        box, t.score, t.hidden, t.held = near[0], near[1], False, cut(image, near[0])
        t.hits += 1
    else:
        t.score *= 0.9
    t.measure(box)
    t.shown = tlwh(t.mean)
    return True


def plain(kind, frames, images=None):
    """Rows of one video: ``frames`` holds the frame and its detections as box, score and flag, in order; ``images`` gives
    the picture of a frame."""
    rule, tracks, number, centres, out = RULES[kind], [], 1, None, []
    for frame, found in frames:
        for t in tracks:
            t.predict()
            if kind == "oc_sort" and t.move is not None and t.misses <= 3:
                t.mean[:4] += 0.5 * t.move
        high = [d for d in found if d[1] >= 0.5]
        low = [d for d in found if 0.1 <= d[1] < 0.5 and rule.get("low", True)]
        pools = {"sort": [[d for d in found if d[2]]], "botsort": [found, found, low]}.get(kind, [high, low])
        free, matched = list(tracks), set()
        for pool, gate in zip(pools, GATES[kind], strict=True):
            pool = [d for d in pool if id(d) not in matched]
            if not free or not pool:
                continue
            shift = (0.0, 0.0)
            if kind == "botsort" and centres:
                moved = [(centre(d[0])[0] - c[0], centre(d[0])[1] - c[1]) for d, c in zip(pool, centres)]
                shift = tuple(float(v) for v in np.mean(moved, axis=0))
            got = pairs(kind, free, pool, gate, shift)
            for i, j in got:
                t, d = free[i], pool[j]
                matched.add(id(d))
                t.measure(d[0])
                if kind == "oc_sort":
                    gap, box = max(1, frame - t.at), np.array(d[0])
                    t.move = (box - t.last) / gap
                    if gap > 1 and t.before is not None:
                        for k in range(1, gap):
                            t.measure(t.before + (box - t.before) * (k / gap))
                    t.before, t.last, t.at = t.last, box, frame
                if len(d) > 3:
                    t.look(d[3], d[1])
                t.score, t.seen, t.misses, t.hidden = d[1], frame, 0, False
                t.hits += 1
                t.shown = rule["smooth"] * tlwh(t.mean) + (1 - rule["smooth"]) * t.shown
                if images and images[frame] is not None:
                    t.held = cut(images[frame], d[0])
            free = [t for i, t in enumerate(free) if i not in {i for i, _ in got}]
        for t in free:
            if images and looked(t, frame, images[frame], found, matched):
                continue
            t.seen = frame
            if t.misses > rule["misses"]:
                t.hidden = True
            else:
                t.shown = rule["smooth"] * tlwh(t.mean) + (1 - rule["smooth"]) * t.shown
        for d in found:
            if id(d) not in matched and (d[2] if kind == "sort" else d[1] >= 0.5):
                tracks.append(Track(number, d[0], d[1], frame))
                if len(d) > 3:
                    tracks[-1].look(d[3], d[1])
                number += 1
        centres = [centre(d[0]) for d in found]
        for t in tracks:
            if not t.hidden:
                grow = rule.get("dilate", 0.2)
                x, y = (min(max(t.shown[k] - t.shown[k + 2] * grow / 2, 0), 1) for k in (0, 1))
                w, h = (min(max(t.shown[k] * (1 + grow), 0), 1 - c) for k, c in ((2, x), (3, y)))
                out.append((frame, t.id, "confirmed" if t.hits >= rule["confirm"] else "tentative", t.age, t.seen, x, y, w, h, t.score))
    return out


@pytest.fixture(scope="module")
def detections(spark):
    """The detections of the queries, each box moved a little: on the tables' grid many assignments cost the same."""
    noise = lambda n: (F.pmod(F.xxhash64("video_id", "frame", "det_id", F.lit(n)), F.lit(1000)) - 500) * 2e-5
    dets = nms.renumber(nms.suppress(tables.detections(spark, DATA)))
    x, y = noise(0), noise(1)
    angle = F.col("object_class") * 1.3 + F.pmod(F.xxhash64("video_id", "frame", "det_id"), F.lit(100)) * 0.006
    vector = F.array(F.cos(angle), F.sin(angle))  # by class, a little different each time
    return dets.withColumns({"x1": F.col("x1") + x, "x2": F.col("x2") + x, "y1": F.col("y1") + y, "y2": F.col("y2") + y, "embedding": vector}).cache()


@pytest.fixture(scope="module")
def videos(detections):
    held = defaultdict(lambda: defaultdict(list))
    for r in sorted(detections.collect(), key=lambda r: (r.video_id, r.frame, r.det_id)):
        held[r.video_id][r.frame].append(((r.x1, r.y1, r.x2 - r.x1, r.y2 - r.y1), r.confidence, r.is_confident, np.array(r.embedding)))
    return held


@pytest.mark.parametrize("kind", sorted(RULES))
def test_trackers_follow_plain_loops(detections, videos, kind):
    got = defaultdict(dict)
    for r in trackers.track(detections, kind).collect():
        got[r.video_id][r.frame, r.track_id] = r
    assert set(got) == set(videos)
    for video, frames in videos.items():
        want = plain(kind, sorted(frames.items()))
        assert len(want) == len(got[video])
        for frame, number, state, age, seen, *rest in want:
            r = got[video][frame, number]
            assert (r.state, r.age, r.last_seen, r.should_blur) == (state, age, seen, True)
            assert np.allclose((r.x1, r.y1, r.x2 - r.x1, r.y2 - r.y1, r.score), rest, atol=1e-7), (video, frame, number)


def test_passes_merge_as_a_plain_loop_does(spark):
    """The rule of the merged rows, written out for each video from the rows of both passes."""
    forward, backward = plans._two(spark, DATA)
    chosen = tr.choose_pairs(tr.pair_by_overlap(forward, backward))
    f, b, mate = forward.collect(), backward.collect(), {(r.video_id, r.forward_id): r.backward_id for r in chosen.collect()}
    got = {(r.video_id, r.frame, r.track_id): r for r in tr.merge(forward, backward, chosen).collect()}
    want = {}
    for video in {r.video_id for r in f}:
        own = sorted((r for r in f if r.video_id == video), key=lambda r: (r.frame, r.track_id))
        back = sorted((r for r in b if r.video_id == video), key=lambda r: (-r.frame, r.track_id))
        number, of_back = {}, {}
        for r in own:
            if r.track_id not in number:
                number[r.track_id] = len(number) + 1
                if (video, r.track_id) in mate:
                    of_back[mate[video, r.track_id]] = number[r.track_id]
        top = len(number)
        for r in back:
            if r.track_id not in of_back:
                top += 1
                of_back[r.track_id] = top
        there = {(r.frame, of_back[r.track_id]): r for r in back}
        for r in own:
            k = r.frame, number[r.track_id]
            other = there.pop(k, None)
            want[video, *k] = (r.x1, r.score, r.state, r.age, r.last_seen, r.should_blur, "forward") if other is None else (
                other.x1, 0.4 * r.score + 0.6 * other.score, max(r.state, other.state), max(r.age, other.age), r.frame, r.should_blur or other.should_blur, "merged")
        for k, r in there.items():
            want[video, *k] = (r.x1, r.score, r.state, r.age, r.last_seen, r.should_blur, "backward")
    assert set(got) == set(want)
    for k, (x1, score, *rest) in want.items():
        r = got[k]
        assert (r.x1, [r.state, r.age, r.last_seen, r.should_blur, r.origin]) == (x1, rest) and abs(r.score - score) < 1e-12
    assert {r[-1] for r in want.values()} >= {"forward", "merged"}


def average(image, k):
    """A weighted mean around each pixel, edges reflected without the edge pixel, one direction after the other."""
    sigma = 0.3 * ((k - 1) * 0.5 - 1) + 0.8
    weight = [math.exp(-((i - k // 2) ** 2) / (2 * sigma * sigma)) for i in range(k)]
    total = sum(weight)

    def bounce(i, n):
        while n > 1 and not 0 <= i < n:
            i = -i if i < 0 else 2 * (n - 1) - i
        return i if n > 1 else 0

    for axis in (0, 1):
        n = len(image) if axis == 0 else len(image[0])
        pick = lambda r, c, i: image[bounce(r + i, n)][c] if axis == 0 else image[r][bounce(c + i, n)]  # noqa: B023, E731
        image = [[[sum(w / total * pick(r, c, i - k // 2)[ch] for i, w in enumerate(weight)) for ch in range(3)] for c in range(len(image[0]))] for r in range(len(image))]
    return [[[round(v) for v in p] for p in line] for line in image]


def blocks(image, strength):
    """Nearest pixels of the image made ``strength`` times smaller, enlarged again."""
    h, w = len(image), len(image[0])
    sh, sw = max(1, h // strength), max(1, w // strength)
    small = [[image[(i * h) // sh][(j * w) // sw] for j in range(sw)] for i in range(sh)]
    return [[small[(i * sh) // h][(j * sw) // w] for j in range(w)] for i in range(h)]


@pytest.mark.parametrize("kind", ["gaussian", "pixelate", "blackout"])
def test_redaction_follows_plain_loops(spark, kind):
    from trackloom.operators import pixels

    chosen = plans._frames(spark, DATA).where("video_id = 1 AND frame % 4 = 0")
    regions = defaultdict(list)
    for r in plans._regions(spark, DATA).where("video_id = 1").collect():
        regions[r.frame].append((r.x, r.y, r.w, r.h))
    before = {r.frame: r.pixels for r in chosen.collect()}
    changed = 0
    for r in pixels.redact(chosen, plans._regions(spark, DATA), kind, 9).collect():
        image = np.frombuffer(before[r.frame], np.uint8).reshape(r.height, r.width, 3).astype(int).tolist()
        hit = set()
        for x, y, w, h in sorted(regions[r.frame]):
            part = [line[x : x + w] for line in image[y : y + h]]
            part = average(part, 9) if kind == "gaussian" else blocks(part, 9) if kind == "pixelate" else [[[0] * 3] * w] * h
            for i in range(h):
                image[y + i][x : x + w] = part[i]
            hit |= {(y + i, x + j) for i in range(h) for j in range(w)}
        out = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, 3)
        assert r.redacted_pixels == len(hit)
        assert np.abs(out.astype(int) - np.array(image)).max() <= (kind == "gaussian")  # a tie may round either way
        changed += r.pixels != before[r.frame]
    assert changed > 5


def test_settings_are_those_of_the_plain_loops():
    for kind, rule in RULES.items():
        s = trackers.settings(kind)
        assert (s.confirm_after, s.max_misses, s.smooth, s.dilate) == (rule["confirm"], rule["misses"], rule["smooth"], rule.get("dilate", 0.2))


def plain_score(tail, head):
    """Error and bend of two ends, arrays of frame, x, y, by the library's polynomial fit."""

    def velocity(p, q):
        v = (q[1:] - p[1:]) / (q[0] - p[0])
        return v if np.linalg.norm(v) >= 1e-6 else v * 0

    gap = head[0, 0] - tail[-1, 0]
    before, after = velocity(tail[0], tail[-1]), velocity(head[0], head[-1])
    ahead = [np.linalg.norm(tail[-1, 1:] + before * (gap + k) - head[k - 1, 1:]) / (gap + k) for k in range(1, min(5, len(head)) + 1)]
    back = [np.linalg.norm(head[0, 1:] - after * j - tail[-j, 1:]) / j for j in range(1, min(5, len(tail)) + 1)]
    between = [[tail[-1, 0] + k, *(tail[-1, 1:] * (1 - k / gap) + head[0, 1:] * (k / gap))] for k in range(1, int(gap))]
    path = np.array([*tail.tolist(), *between, *head.tolist()])
    bends = [np.sqrt(np.mean((path[:, c] - np.polyval(np.polyfit(path[:, 0], path[:, c], min(2, len(path) - 1)), path[:, 0])) ** 2)) for c in (1, 2)]
    worst = max(*ahead, *back)
    return np.mean(ahead), max(*bends, worst) if worst <= 1 else math.inf


def test_scores_of_links(spark):
    from trackloom.operators import link

    rng, rows = np.random.default_rng(8), []
    for i in range(60):
        size = lambda: int(rng.integers(2, 7))
        start, gap, steps = int(rng.integers(0, 90_000)), int(rng.integers(1, 30)), rng.integers(1, 4, 14)
        n, far = size(), 3.0 if i == 5 else 0.0
        frames = start + np.cumsum(steps)
        frames[n:] += gap - steps[n]
        at = rng.random(2) * (i % 7 > 0) + 0.004 * rng.normal(size=2) * (frames[:, None] - start) * (i % 5 > 0) + 0.001 * rng.normal(size=(14, 2)) * (i % 3 > 0)
        points = [(int(f), float(x) + far * (k >= n), float(y)) for k, (f, (x, y)) in enumerate(zip(frames, at, strict=True))]
        rows.append((i, points[:n], points[n : n + size()]))
    side = "array<struct<frame:long,center_x:double,center_y:double>>"
    for r in link.scores(spark.createDataFrame(rows, f"i long, tail {side}, head {side}")).collect():
        error, bend = plain_score(*(np.array([tuple(p) for p in s], float) for s in (r.tail, r.head)))
        assert math.isclose(r.error, error, abs_tol=1e-11) and (r.bend == bend or math.isclose(r.bend, bend, abs_tol=1e-10)), (r, error, bend)


def test_close_errors_leave_the_choice_to_the_smoother_path(spark, monkeypatch):
    """1e-8 apart over any decimal is close, 4e-6 apart is not; what is close is told from the least error that is left."""
    from trackloom.operators import link

    rows = [(1, 1, 11, 0.05, 0.01), (1, 2, 11, 0.05 + 1e-8, 0.001), (1, 1, 12, 0.05 + 4e-7, 0.0001), (1, 3, 13, 0.01, 0.01), (1, 4, 13, 0.01 + 4e-6, 0.001)]
    pairs = spark.createDataFrame(rows, "video_id long, prev_id long, next_id long, error double, bend double").repartition(2)
    monkeypatch.setattr(link, "scored_pairs", lambda *a: pairs)
    tracks = spark.createDataFrame([(1, i, i) for i in (1, 2, 3, 4, 11, 12, 13)], "video_id long, track_id long, frame long")
    got = {r.track_id: r.new_id for r in link.link(tracks).collect()}
    assert got[12] == got[1] and got[11] == got[2] and got[13] == got[3] and len({got[i] for i in (1, 2, 3, 4)}) == 4


def test_links_follow_a_plain_loop(spark):
    """The best pair links (close errors: the smoother one), then the best of those left; ids count by what starts first."""
    from trackloom.operators import link

    rng, rows = np.random.default_rng(6), []
    for video in (1, 2):
        for thing in range(6):  # side by side and alike, so fragments of one may go on in another
            at, number = np.array([0.1, 0.1 + 0.004 * thing]), thing
            for frame in range(60):
                if frame % 15 == 11 and rng.random() < 0.9:
                    number += 10
                if frame % 15 < 11 or rng.random() < 0.2:
                    x, y = (at + rng.normal(0, 2e-4, 2)).tolist()
                    rows.append((video, frame, number, x, y, x + 0.05, y + 0.05))
                at = at + [0.004, 0.0002]
    found = spark.createDataFrame(rows, "video_id long, frame long, track_id long, x1 double, y1 double, x2 double, y2 double").cache()
    pairs = [tuple(r) for r in link.scored_pairs(found).select("video_id", "prev_id", "next_id", "error", "bend").collect()]
    starts = {(r.video_id, r.track_id): r.s for r in found.groupBy("video_id", "track_id").agg(F.min("frame").alias("s")).collect()}
    got = {(r.video_id, r.track_id): r.new_id for r in link.link(found).collect()}
    assert set(got) == set(starts) and len(pairs) > 20
    joined, left = {}, list(pairs)
    while left:
        least = {v: min(p[3] for p in left if p[0] == v) for v in {p[0] for p in left}}
        best = min((p for p in left if np.isclose(p[3], least[p[0]])), key=lambda p: (p[0], p[4], p[1], p[2]))
        joined[best[0], best[2]] = best[0], best[1]
        left = [p for p in left if p[0] != best[0] or p[1] != best[1] and p[2] != best[2]]

    def root(k):
        return root(joined[k]) if k in joined else k

    for video in {v for v, _ in starts}:
        own = defaultdict(list)
        for k, s in starts.items():
            if k[0] == video:
                own[root(k)].append(s)
        order = sorted(own, key=lambda r: (min(own[r]), r[1]))
        assert {k: order.index(root(k)) + 1 for k in starts if k[0] == video} == {k: n for k, n in got.items() if k[0] == video}


def test_pictures_keep_tracks_as_a_plain_loop_does(spark):
    """A textured square moves over noise; its detections stop, come back weak once, and come back. One picture is missing,
    one video has no pictures at first, one none at all."""
    rng, rows, frames, images = np.random.default_rng(5), [], [], defaultdict(dict)
    for video in (1, 2, 3):
        back, square = rng.integers(0, 80, (48, 64), np.uint8), rng.integers(100, 255, (10, 12), np.uint8)
        for frame in range(24):
            x, y = 6 + frame, 10 + frame // 2
            image = back.copy()
            image[y : y + 10, x : x + 12] = square
            found = [(0.7, 0.7, 0.1, 0.1, 0.9)]
            if not 8 <= frame < 20:
                found.append((x / 64, y / 48, 12 / 64, 10 / 48, 0.8))
            if frame == 15:
                found.append(((x - 1) / 64, y / 48, 12 / 64, 10 / 48, 0.2))
            rows += [(video, frame, i, a, b, a + w, b + h, score, score > 0.5) for i, (a, b, w, h, score) in enumerate(found)]
            there = video < 3 and frame != 11 and (video, frame) >= (2, 3) or video == 1 and frame != 11
            if there:
                frames.append((video, frame, 64, 48, np.repeat(image[:, :, None], 3, axis=2).tobytes()))
            images[video][frame] = image.astype(float) if there else images[video].get(frame - 1)
    frames += [frames[0], (1, 99, 64, 48, b""), (4, 0, 64, 48, None)]
    dets = spark.createDataFrame(rows, "video_id long, frame long, det_id long, x1 double, y1 double, x2 double, y2 double, confidence double, is_confident boolean")
    shown = spark.createDataFrame(frames, "video_id long, frame long, width int, height int, pixels binary")
    found = trackers.track(dets, "hybrid_sot", frames=shown, sight=lambda: pictures.Sight(pictures.Template()))
    got = {(r.video_id, r.frame, r.track_id): r for r in found.collect()}
    want = {}
    for video in (1, 2, 3):
        held = [(f, [((r[3], r[4], r[5] - r[3], r[6] - r[4]), r[7], r[8]) for r in rows if r[:2] == (video, f)]) for f in range(24)]
        want |= {(video, r[0], r[1]): r for r in plain("hybrid_sot", held, images[video])}
    assert got.keys() == want.keys()
    for key, (_, _, state, age, seen, x, y, w, h, score) in want.items():
        r = got[key]
        assert (r.state, r.age, r.last_seen) == (state, age, seen), key
        assert np.allclose((r.x1, r.y1, r.width, r.height, r.score), (x, y, w, h, score), atol=1e-9), key
    ids = lambda v: {i for video, _, i in got if video == v}
    assert (len(ids(1)), len(ids(2)), len(ids(3))) == (2, 2, 3)  # without pictures the square is a new track when it comes back
    with pytest.raises(ValueError):
        trackers.track(dets, "sort", frames=shown, sight=lambda: None)


def test_pairs_of_both_passes_do_not_travel(spark):
    """Rows of both passes are dealt once, by video; what pairs in a frame is counted where it meets."""
    forward, backward = plans._two(spark, DATA)
    plan = tr.pair_by_overlap(forward, backward)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
