"""Distances between array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "L1", "L2", "Linf")
_NAN = float("nan")


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def square(a: Column) -> Column:
    """The squared length of a vector."""
    return _sum(F.transform(_double(a), lambda x: x * x))


def cosine_distance(a: Column, b: Column, square_a: Column | None = None, square_b: Column | None = None) -> Column:
    """1 - cosine; NaN, which sorts last, where a vector is zero.  Squared lengths that are at hand can be given."""
    size = F.sqrt((square(a) if square_a is None else square_a) * (square(b) if square_b is None else square_b))
    return F.coalesce(1.0 - F.try_divide(dot(a, b), size), F.lit(_NAN))


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Raises ValueError for a metric that is none of METRICS."""
    pairs = lambda f: F.zip_with(_double(a), _double(b), f)
    if metric == "cosine":
        return cosine_distance(a, b)
    if metric == "L1":
        return _sum(pairs(lambda x, y: F.abs(x - y)))
    if metric == "L2":
        return F.sqrt(_sum(pairs(lambda x, y: (x - y) * (x - y))))
    if metric == "Linf":
        return F.array_max(pairs(lambda x, y: F.abs(x - y)))
    raise ValueError(f"unknown metric {metric!r}; supported are {', '.join(METRICS)}")
