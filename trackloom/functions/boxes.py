"""Box algebra as Column expressions: they stay inside generated code and push through filters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(v: Column | str | float | int) -> Column:
    return F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(v)


@dataclass(frozen=True)
class Box:
    """Corners of a box as columns."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, source: Column | str = "") -> Box:
        """From columns with a prefix (``"a."``, ``"prev_"``) or from a struct column."""
        return cls(*(source[c] if isinstance(source, Column) else F.col(f"{source}{c}") for c in ("x1", "y1", "x2", "y2")))

    @classmethod
    def tlwh(cls, x, y, w, h) -> Box:
        return cls(_c(x), _c(y), _c(x) + _c(w), _c(y) + _c(h))

    @classmethod
    def centred(cls, cx, cy, w, h) -> Box:
        return cls(_c(cx) - _c(w) / 2, _c(cy) - _c(h) / 2, _c(cx) + _c(w) / 2, _c(cy) + _c(h) / 2)

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1

    @property
    def cx(self) -> Column:
        return self.x1 + self.width / 2

    @property
    def cy(self) -> Column:
        return self.y1 + self.height / 2

    def area(self) -> Column:
        return self.width * self.height

    def columns(self, prefix: str = "") -> dict[str, Column]:
        return {f"{prefix}{n}": getattr(self, n) for n in ("x1", "y1", "x2", "y2")}

    def map(self, fx, fy) -> Box:
        return Box(fx(self.x1), fy(self.y1), fx(self.x2), fy(self.y2))

    def struct(self) -> Column:
        return F.struct(*(v.alias(k) for k, v in self.columns().items()))


def clip(v: Column, low, high) -> Column:
    return F.least(F.greatest(v, _c(low)), _c(high))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union is empty."""
    w = F.greatest(F.lit(0.0), F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1))
    h = F.greatest(F.lit(0.0), F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))
    union = a.area() + b.area() - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def centre_distance(a: Box, b: Box) -> Column:
    dx, dy = a.cx - b.cx, a.cy - b.cy
    return F.sqrt(dx * dx + dy * dy)


def unletterbox(box: Box, pad_x, pad_y, scale_x, scale_y, width, height) -> Box:
    """Undo padding and scaling, then clip to the image."""
    return box.map(lambda v: clip((v - _c(pad_x)) / _c(scale_x), 0.0, width), lambda v: clip((v - _c(pad_y)) / _c(scale_y), 0.0, height))


def shift(box: Box, dx, dy, width, height) -> Box:
    """From a tile to the whole image, clipped to it."""
    return box.map(lambda v: clip(v + _c(dx), 0.0, width), lambda v: clip(v + _c(dy), 0.0, height))


def relative(box: Box, width, height) -> Box:
    return box.map(lambda v: clip(v / F.greatest(_c(width), F.lit(1)), 0.0, 1.0), lambda v: clip(v / F.greatest(_c(height), F.lit(1)), 0.0, 1.0))


def is_absolute(box: Box) -> Column:
    """Coordinates over 1 mean pixels."""
    return F.greatest(box.x1, box.y1, box.x2, box.y2) > 1


def auto_relative(box: Box, width, height) -> Box:
    """Relative corners of a box in either unit, inverted corners swapped."""
    put = box.map(lambda v: F.when(is_absolute(box), v / _c(width)).otherwise(v), lambda v: F.when(is_absolute(box), v / _c(height)).otherwise(v))
    return Box(F.least(put.x1, put.x2), F.least(put.y1, put.y2), F.greatest(put.x1, put.x2), F.greatest(put.y1, put.y2))


def roi(box: Box, width, height) -> tuple[Column, Column, Column, Column]:
    """Pixel ``x, y, w, h`` of a relative box: clamped, rounded half to even, cut at the image. Empty ones have w or h 0."""
    put = box.map(lambda v: clip(F.rint(clip(v, 0.0, 1.0) * _c(width)), 0, width).cast("int"), lambda v: clip(F.rint(clip(v, 0.0, 1.0) * _c(height)), 0, height).cast("int"))
    return put.x1, put.y1, F.greatest(put.x2 - put.x1, F.lit(0)), F.greatest(put.y2 - put.y1, F.lit(0))


def dilate(box: Box, share: float) -> tuple[Column, Column, Column, Column]:
    """``x, y, w, h`` grown about the centre; the corner is clipped first, then what is left for the size."""
    w, h = box.width * (1 + share), box.height * (1 + share)
    x, y = clip(box.x1 - box.width * share / 2, 0.0, 1.0), clip(box.y1 - box.height * share / 2, 0.0, 1.0)
    return x, y, clip(w, 0.0, 1 - x), clip(h, 0.0, 1 - y)


def xyah(box: Box) -> tuple[Column, Column, Column, Column]:
    """Centre, aspect (width over height) and height, the height at least 1e-6 in the ratio."""
    return box.cx, box.cy, box.width / F.greatest(box.height, F.lit(1e-6)), box.height


def from_xyah(cx, cy, aspect, height) -> Box:
    return Box.centred(cx, cy, _c(aspect) * _c(height), height)


def clamp_pixels(x, y, w, h, width, height) -> tuple[Column, Column, Column, Column]:
    """A pixel box cut at the frame; all null where nothing is left."""
    x1, y1 = clip(_c(x), 0, _c(width)), clip(_c(y), 0, _c(height))
    x2, y2 = clip(_c(x) + _c(w), 0, _c(width)), clip(_c(y) + _c(h), 0, _c(height))
    there = (x2 > x1) & (y2 > y1)
    return tuple(F.when(there, v) for v in (x1, y1, x2 - x1, y2 - y1))


def pixel_box(x, y, w, h, width, height) -> tuple[Column, Column, Column, Column]:
    """Whole pixels ``x, y, w, h`` of a relative box given by corner and size, cut at the frame; null where nothing is left."""
    put = [F.rint(_c(v) * _c(n)).cast("int") for v, n in ((x, width), (y, height), (w, width), (h, height))]
    left, top = clip(put[0], 0, _c(width)), clip(put[1], 0, _c(height))
    w, h = clip(put[2], 0, _c(width) - left), clip(put[3], 0, _c(height) - top)
    return tuple(F.when((w > 0) & (h > 0), v) for v in (left, top, w, h))


def relative_box(x, y, w, h, width, height) -> tuple[Column, Column, Column, Column]:
    """A pixel box by corner and size in shares of the frame; null for a frame without size."""
    there = (_c(width) > 0) & (_c(height) > 0)
    return tuple(F.when(there, _c(v) / _c(n)) for v, n in ((x, width), (y, height), (w, width), (h, height)))


def inflate(x, y, w, h, scale: float, width, height) -> tuple[Column, ...]:
    """A pixel box grown about its centre and cut at the frame; the box itself where nothing is left."""
    grown = [_c(v) * scale for v in (w, h)]
    made = clamp_pixels(F.rint(_c(x) + _c(w) / 2 - grown[0] / 2).cast("int"), F.rint(_c(y) + _c(h) / 2 - grown[1] / 2).cast("int"), F.rint(grown[0]).cast("int"), F.rint(grown[1]).cast("int"), width, height)
    return tuple(F.coalesce(m, _c(v)) for m, v in zip(made, (x, y, w, h), strict=True))


def letterbox(width, height, size: int, *, stride: int | None = None, fill: bool = False, enlarge: bool = True) -> dict[str, Column]:
    """Scale, rounded new size and right/bottom padding that fit an image into a square; null for an image without size.

    With a ``stride`` the padding is only what is left over it, else ``fill`` stretches the image to the square.
    Without ``enlarge`` a small image keeps its size.
    """
    width, height = (F.when((_c(width) > 0) & (_c(height) > 0), _c(v)) for v in (width, height))
    r = F.least(F.lit(float(size)) / width, F.lit(float(size)) / height, *[] if enlarge else [F.lit(1.0)])
    w, h = F.rint(width * r).cast("int"), F.rint(height * r).cast("int")
    pad = [F.lit(size) - w, F.lit(size) - h]
    if stride:
        pad = [F.pmod(p, F.lit(stride)) for p in pad]
    elif fill:
        w, h = (F.when(v.isNotNull(), F.lit(size)) for v in (width, height))
        pad = [F.when(v.isNotNull(), F.lit(0)) for v in (width, height)]
    return {"ratio": r, "new_width": w, "new_height": h, "pad_right": pad[0], "pad_bottom": pad[1], "scale_x": w / width, "scale_y": h / height}


def downscale(width, height, size: int) -> dict[str, Column]:
    """Size whose longest edge is at most ``size``, and its scale; smaller images stay."""
    longest = F.greatest(_c(width), _c(height))
    s = F.when(longest > size, F.lit(float(size)) / longest).otherwise(F.lit(1.0))
    fit = lambda v: F.greatest(F.lit(1), F.rint(_c(v) * s).cast("int"))
    return {"scale": s, "new_width": fit(width), "new_height": fit(height)}


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-clip(x, -64.0, 64.0)))


def best_class(scores: Column, n: int) -> tuple[Column, Column]:
    """Index of the highest of the first ``n`` scores (the first of equal ones), and the score."""
    some = F.slice(scores, 1, n)
    return (F.array_position(some, F.array_max(some)) - 1).cast("long"), F.array_max(some)
