"""Embedding arithmetic with higher-order functions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; each norm has a small number added, so zero vectors give 0."""
    return dot(a, b) / ((norm(a) + EPS) * (norm(b) + EPS))


def best_cosine(history: Column, b: Column) -> Column:
    return F.array_max(F.transform(history, lambda a: cosine(a, b)))


def _with(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: inside a lambda an expression runs for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def unit(a: Column) -> Column:
    return _with(a, lambda v: _with(norm(v) + EPS, lambda n: F.transform(v, lambda x: x.cast("double") / n)))


def blend(rep: Column, new: Column, weight: Column, alpha: float = 0.5) -> Column:
    """Moving average of unit vectors; a new one counts by its weight (0.001 at least). The first vector starts it."""
    w = F.greatest(weight, F.lit(1e-3)) * alpha
    moved = lambda u: unit(F.zip_with(rep, u, lambda a, b: a * (1 - alpha) + b * w))
    return _with(unit(new), lambda u: F.when(F.size(rep) == 0, u).otherwise(moved(u)))
