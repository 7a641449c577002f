"""Pictures beside a tracker: what stood in a detection's box is looked for where no detection meets the track.

Frames and detections of a video come to one task as one sorted run of rows (:func:`beside`), so a task holds one frame's
pixels of each video that it walks (``lanes.SEEN``) beside the tracks.
"""

from __future__ import annotations

import weakref
from collections.abc import Callable
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.embed import KEYS, crop, frame_at

#: How much larger than the detection the box is that a picture tracker follows. Fixed value.
GROWN = 1.2
#: Numbers that a search for several pictures works on at once, unless one needs more.
AT_ONCE = 1 << 21
#: Variance of a patch, as a share of its mean's square, from which on rounding can't make another place seem more like it.
CONTRAST = 1e-6


class Eye(Protocol):
    """Follows one object at a time from frame to frame; boxes are ``x, y, w, h`` in pixels."""

    def start(self, image: np.ndarray, box: tuple[int, int, int, int]) -> object | None:
        """What to remember of the object in the box."""

    def find(self, image: np.ndarray, held: object) -> tuple[float, float, float, float] | None:
        """Where the object is now, if it is seen."""


class Template:
    """An ``Eye`` that looks for the same grey pixels around the place where they were last.

    Likeness is normalised correlation; the best place counts if it reaches ``least``, of equal ones the nearest to the
    last place, then the upper left. Patches without any contrast are not remembered.
    """

    def __init__(self, reach: int = 8, least: float = 0.7):
        self.reach, self.least = reach, least

    def start(self, image: np.ndarray, box: tuple[int, int, int, int]) -> dict | None:
        part = crop(image, *box).sum(axis=2)
        part = part - part.mean()
        return {"box": box, "part": part / np.linalg.norm(part)} if part.any() else None

    def find(self, image: np.ndarray, held: dict) -> tuple[int, int, int, int] | None:
        x, y, w, h = held["box"]
        x0, y0 = max(x - self.reach, 0), max(y - self.reach, 0)
        area = image[y0 : y + h + self.reach, x0 : x + w + self.reach].sum(axis=2).astype(float)
        if area.shape[0] < h or area.shape[1] < w:
            return None
        # the remembered part has mean 0, so a window's own mean adds nothing to the product
        dot = np.einsum("abhw,hw->ab", np.lib.stride_tricks.sliding_window_view(area, (h, w)), held["part"])
        spread = _windows(area**2, h, w) - _windows(area, h, w) ** 2 / (h * w)
        like = np.round(np.where(spread > 1e-6, dot / np.sqrt(np.maximum(spread, 1e-6)), -1), 9)
        far = np.hypot((np.arange(like.shape[0]) + y0 - y)[:, None], np.arange(like.shape[1]) + x0 - x)
        best = np.lexsort((far.ravel(), -like.ravel()))[0]
        if like.ravel()[best] < self.least:
            return None
        dy, dx = divmod(int(best), like.shape[1])
        held["box"] = (x0 + dx, y0 + dy, w, h)
        return held["box"]

    def start_many(self, images: list[np.ndarray], boxes: list[tuple[int, int, int, int]]) -> list[dict | None]:
        """What :meth:`start` gives for each; an image that comes again is the same object."""
        out: list[dict | None] = []
        grey = _grey(images)
        for image, (x, y, w, h) in zip(images, boxes, strict=True):
            part = crop(grey[id(image)], x, y, w, h)
            mean = part.sum() / part.size
            part = part - mean
            square = float(np.vdot(part, part))
            # a patch of whole numbers is never less like itself than another place; without contrast rounding may say otherwise
            own = self.least <= 1 and image.dtype.kind in "ui" and square > CONTRAST * mean * mean * part.size
            out.append({"box": (x, y, w, h), "part": part / np.sqrt(square), "still": (weakref.ref(image), (x, y, w, h)) if own else None} if square else None)
        return out

    def find_many(self, images: list[np.ndarray], held: list[dict]) -> list[tuple[int, int, int, int] | None]:
        """What :meth:`find` gives for each, worked out together; an image that comes again is the same object.

        A search that left a patch in its place, found or not, ends the same way as long as the image is the same.
        """
        out = [e["still"][1] if e.get("still") and e["still"][0]() is image else e for image, e in zip(images, held, strict=True)]
        asked = [i for i, (box, e) in enumerate(zip(out, held, strict=True)) if box is e]
        before = [held[i]["box"] for i in asked]
        for i, was, box in zip(asked, before, self._search([images[i] for i in asked], [held[i] for i in asked]), strict=True):
            held[i]["still"] = (weakref.ref(images[i]), box) if held[i]["box"] == was else None
            out[i] = box
        return out

    def _search(self, images: list[np.ndarray], held: list[dict]) -> list[tuple[int, int, int, int] | None]:
        if not held:
            return []
        grey = _grey(images)
        order = list(grey)
        of = np.array([order.index(id(image)) for image in images], np.int64)
        table, out = _Table(list(grey.values())), []
        size = [(e["box"][3] + 2 * self.reach) * (2 * self.reach + 1) * (e["box"][2] + e["box"][3]) for e in held]
        a = 0
        while a < len(held):
            b, most = a + 1, size[a]
            while b < len(held) and (b + 1 - a) * max(most, size[b]) <= AT_ONCE:
                most, b = max(most, size[b]), b + 1
            out += self._find(table, of[a:b], held[a:b])
            a = b
        return out

    def _find(self, table: _Table, of: np.ndarray, held: list[dict]) -> list[tuple[int, int, int, int] | None]:
        reach, many = self.reach, 2 * self.reach + 1
        x, y, w, h = np.array([e["box"] for e in held], np.int64).T
        high, wide = int(h.max()), int(w.max())
        part = np.zeros((len(held), high, wide))
        for k, (e, bh, bw) in enumerate(zip(held, h.tolist(), w.tolist(), strict=True)):
            part[k, :bh, :bw] = e["part"]
        x0, y0 = np.maximum(x - reach, 0), np.maximum(y - reach, 0)
        # places of the upper left corner, as far as the box stays in the image and within reach
        down = np.minimum(y + reach, table.height[of] - h) - y0
        across = np.minimum(x + reach, table.width[of] - w) - x0
        area = table.grey(of, y0, x0, high + 2 * reach, wide + 2 * reach)
        # rows of parts against rows of areas, then along the diagonals where a part's rows meet an area's in turn
        rows = np.lib.stride_tricks.sliding_window_view(area, wide, axis=2).reshape(len(held), -1, wide)
        product = np.matmul(rows, part.transpose(0, 2, 1)).reshape(len(held), high + 2 * reach, many, high)
        dot = product[:, :many, :, 0].copy()
        for r in range(1, high):
            dot += product[:, r : r + many, :, r]
        total, squares = table.sums(of, y0, x0, h, w, many)
        spread = squares - total**2 / (h * w)[:, None, None]
        like = np.round(np.where(spread > 1e-6, dot / np.sqrt(np.maximum(spread, 1e-6)), -1), 9)
        at = np.arange(many)
        room = (at <= down[:, None])[:, :, None] & (at <= across[:, None])[:, None, :]
        like = np.where(room, like, -np.inf).reshape(len(held), -1)
        far = np.hypot((at + (y0 - y)[:, None])[:, :, None], (at + (x0 - x)[:, None])[:, None, :]).reshape(len(held), -1)
        most = like.max(axis=1)
        dy, dx = np.divmod(np.where(like == most[:, None], far, np.inf).argmin(axis=1), many)
        out: list[tuple[int, int, int, int] | None] = []
        for e, seen, left, top in zip(held, (most >= self.least).tolist(), (x0 + dx).tolist(), (y0 + dy).tolist(), strict=True):
            if seen:
                e["box"] = (left, top, *e["box"][2:])
            out.append(e["box"] if seen else None)
        return out


class _Table:
    """Grey images one after another, and sums of all that lies above and left of each pixel, which are whole numbers."""

    def __init__(self, images: list[np.ndarray]):
        self.height, self.width = np.array([i.shape for i in images], np.int64).reshape(-1, 2).T
        self.begin = np.r_[0, np.cumsum(self.height * self.width)]
        self.begin_added = np.r_[0, np.cumsum((self.height + 1) * (self.width + 1))]
        self.flat, self.above = np.zeros(self.begin[-1]), np.zeros((2, self.begin_added[-1]))
        for image, at, to, after in zip(images, self.begin.tolist(), self.begin_added.tolist(), self.begin_added[1:].tolist(), strict=False):
            self.flat[at : at + image.size] = image.ravel()
            sums = self.above[:, to:after].reshape(2, image.shape[0] + 1, image.shape[1] + 1)
            np.cumsum([image, image * image], axis=1, out=sums[:, 1:, 1:])
            np.cumsum(sums[:, 1:, 1:], axis=2, out=sums[:, 1:, 1:])

    def grey(self, of: np.ndarray, y: np.ndarray, x: np.ndarray, high: int, wide: int) -> np.ndarray:
        """Parts of images from a row and a column on; beyond the image stands what comes."""
        first = self.begin[of] + y * self.width[of] + x
        at = first[:, None, None] + (np.arange(high) * self.width[of][:, None])[:, :, None] + np.arange(wide)
        return self.flat.take(at, mode="clip")

    def sums(self, of: np.ndarray, y: np.ndarray, x: np.ndarray, h: np.ndarray, w: np.ndarray, many: int) -> list[np.ndarray]:
        """Sums of grey values and of their squares in boxes of a size, from each of ``many`` rows and columns on."""
        line = self.width[of] + 1
        first = self.begin_added[of] + y * line + x
        at = first[:, None, None] + (np.arange(many) * line[:, None])[:, :, None] + np.arange(many)
        low, right = (h * line)[:, None, None], w[:, None, None]
        corners = at + low + right, at, at + right, at + low
        found = [[c.take(i, mode="clip") for i in corners] for c in self.above]
        return [a + b - c - d for a, b, c, d in found]


def _grey(images: list[np.ndarray]) -> dict[int, np.ndarray]:
    return {k: image.astype(float) @ np.ones(3) for k, image in {id(image): image for image in images}.items()}


def _windows(values: np.ndarray, h: int, w: int) -> np.ndarray:
    """Sums of all windows."""
    c = np.zeros((values.shape[0] + 1, values.shape[1] + 1))
    c[1:, 1:] = values.cumsum(axis=0).cumsum(axis=1)
    return c[h:, w:] - c[:-h, w:] - c[h:, :-w] + c[:-h, :-w]


def pixels_of(tlwh: np.ndarray, width: int, height: int) -> tuple[int, int, int, int] | None:
    """Whole pixels of a relative box, grown about its centre and cut at the frame, as ``boxes.pixel_box`` and
    ``boxes.inflate`` have it; None where nothing is left."""
    put = [round(float(v) * n) for v, n in zip(tlwh, (width, height, width, height), strict=True)]
    x, y = min(max(put[0], 0), width), min(max(put[1], 0), height)
    w, h = min(max(put[2], 0), width - x), min(max(put[3], 0), height - y)
    if not w or not h:
        return None
    left, top, across, down = round(x + w / 2 - w * GROWN / 2), round(y + h / 2 - h * GROWN / 2), round(w * GROWN), round(h * GROWN)
    x1, y1, x2, y2 = max(left, 0), max(top, 0), min(left + across, width), min(top + down, height)
    return (x1, y1, x2 - x1, y2 - y1) if x2 > x1 and y2 > y1 else (x, y, w, h)


def picture(width: int | None, height: int | None, data: bytes | None) -> np.ndarray | None:
    """Rows of RGB pixels; None where they are null or too short."""
    whole = data is not None and width and height and len(data) >= width * height * 3
    return np.frombuffer(data, np.uint8, width * height * 3).reshape(height, width, 3) if whole else None


class Sight:
    """The ``visual`` of a tracker with frames: an eye, the frame of now, and what tracks remember in their own ``extra``.

    ``vector`` turns a patch into a vector; where it is given, a picture has to look like the track that it keeps. Vectors
    of the eye and an ``embedding`` column share a track's memory, so give one of them, or both of one length.
    """

    def __init__(self, eye: Eye, vector: Callable[[np.ndarray], np.ndarray] | None = None):
        self.eye, self.vector = eye, vector
        self.image: np.ndarray | None = None
        self.known: dict[int, tuple[weakref.ref, dict[tuple[int, int, int, int], np.ndarray]]] = {}

    def show(self, width: int | None, height: int | None, data: bytes | None) -> None:
        """The frame of now; null or short pixels show nothing."""
        self.image = picture(width, height, data)

    def start(self, e: dict, tlwh: np.ndarray) -> np.ndarray | None:
        """A track that a detection met remembers the picture there, or stays as it was where there is none."""
        box = None if self.image is None else pixels_of(tlwh, self.image.shape[1], self.image.shape[0])
        if box is None:
            return None
        e["picture"] = self.eye.start(self.image, box)
        return self._vector(box)

    def find(self, e: dict) -> tuple[np.ndarray, np.ndarray | None] | None:
        """The relative box where the track's picture is now, and the vector of what is in it."""
        box = self.eye.find(self.image, e["picture"]) if self.image is not None and e.get("picture") is not None else None
        if box is None:
            return None
        height, width = self.image.shape[:2]
        return np.array(box, float) / (width, height, width, height), self._vector(tuple(int(v) for v in box))

    def start_many(self, images: list[np.ndarray | None], tlwh: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        """Which of several tracks have a picture where a detection met them, what to remember of it, and its vector."""
        boxes = [None if image is None else pixels_of(box, image.shape[1], image.shape[0]) for image, box in zip(images, tlwh, strict=True)]
        begun = np.array([i for i, box in enumerate(boxes) if box is not None], np.int64)
        images, boxes = [images[i] for i in begun.tolist()], [boxes[i] for i in begun.tolist()]
        held = np.empty(len(begun), object)
        held[:] = self.eye.start_many(images, boxes) if hasattr(self.eye, "start_many") else [self.eye.start(*at) for at in zip(images, boxes, strict=True)]
        return begun, held, [self._vector(box, image) for image, box in zip(images, boxes, strict=True)]

    def find_many(self, images: list[np.ndarray], held: list) -> tuple[np.ndarray, np.ndarray, list]:
        """Which of several pictures are seen, their relative boxes and the vectors of what is in them."""
        boxes = self.eye.find_many(images, held) if hasattr(self.eye, "find_many") else [self.eye.find(*at) for at in zip(images, held, strict=True)]
        found = [i for i, box in enumerate(boxes) if box is not None]
        size = np.array([(*images[i].shape[1::-1], *images[i].shape[1::-1]) for i in found], float).reshape(-1, 4)
        vectors = [self._again(tuple(int(v) for v in boxes[i]), images[i]) for i in found] if self.vector else [None] * len(found)
        return np.array(found, np.int64), np.array([boxes[i] for i in found], float).reshape(-1, 4) / size, vectors

    def _again(self, box: tuple[int, int, int, int], image: np.ndarray) -> np.ndarray:
        """A vector that is remembered as long as its image is there."""
        known = self.known.get(id(image))
        if known is None:
            gone = lambda _, key=id(image): self.known.pop(key, None)
            known = self.known[id(image)] = weakref.ref(image, gone), {}
        if box not in known[1]:
            known[1][box] = self._vector(box, image)
        return known[1][box]

    def _vector(self, box: tuple[int, int, int, int], image: np.ndarray | None = None) -> np.ndarray | None:
        part = crop(self.image if image is None else image, *box) if self.vector else None
        return None if part is None else np.asarray(self.vector(part), float)


def beside(dets: DataFrame, frames: DataFrame) -> DataFrame:
    """Detections with the columns ``width, height, pixels``, and a row of nulls but for these before those of each frame.

    Only frames that a detection asks for come along: its own, or the last one before it. ``_picture`` is 0 in rows of
    frames; of frames that come twice the first in order of size and pixels is to be taken.
    """
    asked = frame_at(dets, frames).where("_at IS NOT NULL")
    shown = frames.select("video_id", F.col("frame").alias("_at"), "width", "height", "pixels")
    there = asked.select("video_id", "_at").distinct()
    taken = shown.join(there, ["video_id", "_at"], "left_semi").withColumnRenamed("_at", "frame").withColumn("_picture", F.lit(0))
    return dets.withColumn("_picture", F.lit(1)).unionByName(taken, allowMissingColumns=True)


#: The order of rows of a video's frame.
ORDER = ("_picture", "det_id", "width", "height", "pixels")
