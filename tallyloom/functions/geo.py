"""Rings and centroids by higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ring_area2(ring: Column) -> Column:
    """Twice the signed area of a closed ring, an array of [x, y]."""
    pairs = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda p, q: p[0] * q[1] - q[0] * p[1])
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)


def ring_centroid(ring: Column) -> Column:
    """struct(x, y, area) of a closed ring; the mean vertex and area 0 if it is degenerate."""

    def total(axis: int) -> Column:
        a, b = F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1)
        terms = F.zip_with(a, b, lambda p, q: (p[axis] + q[axis]) * (p[0] * q[1] - q[0] * p[1]))
        return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)

    def mean(axis: int) -> Column:
        return F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[axis]) / F.size(ring)

    twice = ring_area2(ring)
    flat = F.abs(twice) < 1e-12
    x = F.when(flat, mean(0)).otherwise(total(0) / (3 * twice))
    y = F.when(flat, mean(1)).otherwise(total(1) / (3 * twice))
    return F.struct(x.alias("x"), y.alias("y"), F.when(flat, 0.0).otherwise(F.abs(twice) / 2).alias("area"))


def largest_part(parts: Column) -> Column:
    """Centroid of the largest of several outer rings; the first wins a tie."""
    each = F.transform(parts, lambda ring, i: F.struct(ring_centroid(ring)["area"].alias("area"), (-i).alias("i"), ring_centroid(ring).alias("c")))
    return F.array_max(F.transform(each, lambda e: F.struct(e["area"], e["i"], e["c"])))["c"]


def jitter(n: Column) -> Column:
    """A repeatable number in [0, 1) of an integer."""
    v = F.sin(n * 12.9898 + 78.233) * 43758.5453
    return v - F.floor(v)
