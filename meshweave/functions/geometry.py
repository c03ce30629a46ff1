"""Scalar geometry as Spark columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The least length and the share of a length that count as zero.
LEAST, SHARE = 1e-30, 1e-9


def epsilon(length: Column) -> Column:
    return F.greatest(length * SHARE, F.lit(LEAST))


def vector(p: Column, q: Column) -> tuple[Column, Column, Column]:
    return tuple(q[a] - p[a] for a in "xyz")


def dot(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return reduce(lambda p, q: p + q, (x * y for x, y in zip(a, b, strict=True)))


def cross(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: tuple[Column, ...]) -> Column:
    return F.sqrt(dot(a, a))


def triangle_area(p: Column, q: Column, r: Column) -> Column:
    return norm(cross(vector(p, q), vector(p, r))) / 2


def tetra_volume(p: Column, q: Column, r: Column, s: Column) -> Column:
    """Signed: positive if s lies on the side that p, q, r turn counter-clockwise to."""
    return dot(cross(vector(p, q), vector(p, r)), vector(p, s)) / 6


def mean_of(vtx: Column, axis: str) -> Column:
    """Mean of an axis over an array of vertices."""
    return F.aggregate(vtx, F.lit(0.0), lambda s, v: s + v[axis]) / F.size(vtx)


def segment_distance2(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Squared distance of a point to a segment in the plane."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / length))).otherwise(0.0)
    gx, gy = px - (ax + t * dx), py - (ay + t * dy)
    return gx * gx + gy * gy


def morton(axes: list[Column], bits: int = 16) -> Column:
    """Interleaved bits of non-negative whole coordinates, the first axis lowest."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        for k, a in enumerate(axes):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(a.cast("long"), b).bitwiseAND(F.lit(1).cast("long")), b * len(axes) + k))
    return out


def transformed(x: Column, y: Column, z: Column, matrix: list[list[float]]) -> tuple[Column, Column, Column]:
    """An affine transform: three rows of four numbers."""
    return tuple(F.lit(float(r[0])) * x + F.lit(float(r[1])) * y + F.lit(float(r[2])) * z + F.lit(float(r[3])) for r in matrix)
