"""Candidate pairs of a spatial join, by buckets of grids of several steps.

Coordinates are columns x, y, z; boxes have xmin .. zmax. Every box belongs to the level whose step, a power of two, is
the least that is not smaller than its largest extent: there it touches at most two buckets on each axis, however large
or small the other boxes are. A point lies in one bucket of each level that boxes have. Two boxes meet at the level of
the larger one, and of the buckets they share there they are kept in one: that of the lower corner of their overlap.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshweave.plans.durable import dealt

AXES = ("x", "y", "z")
#: So many boxes at most, a few MB with all their buckets, are sent to every task; beyond that points and boxes are dealt.
FEW = 4096
#: Points that meet few boxes are dealt to tasks of at most about so many: their own files may be a single split.
POINTS = 50_000
#: Steps finer than this share (a power of two) of the largest coordinate count as none: their bucket numbers would not fit.
FINEST = 50


def cell_of(value: Column, size: float | Column) -> Column:
    return F.floor(value / (size if isinstance(size, Column) else F.lit(float(size)))).cast("long")


@dataclass(frozen=True)
class Extent:
    """The common box of a table of boxes and the levels they have; None where the table is empty."""

    levels: tuple[int, ...]
    floor: int
    low: dict[str, float]
    high: dict[str, float]
    count: int

    @staticmethod
    def of(boxes: DataFrame, axes: tuple[str, ...] = AXES) -> Extent | None:
        far = F.max(F.greatest(*(F.greatest(F.abs(f"{a}min"), F.abs(f"{a}max")) for a in axes), F.lit(0.0)))
        ends = [f(f"{a}{e}").alias(f"{e}{a}") for a in axes for e, f in (("min", F.min), ("max", F.max))]
        row = boxes.agg(F.count(F.lit(1)).alias("n"), far.alias("far"), F.collect_set(raw_level(axes)).alias("levels"), *ends).first()
        if row["far"] is None or any(row[f"min{a}"] is None for a in axes):
            return None
        floor = int(row["far"]).bit_length() - FINEST if row["far"] >= 1 else -FINEST - 1000 if row["far"] == 0 else int(f"{row['far']:e}".split("e")[1]) * 4 - FINEST
        known = sorted({max(v, floor) for v in row["levels"]}) or [0 if row["far"] == 0 else max(floor, 0)]
        return Extent(tuple(known), known[0], {a: row[f"min{a}"] for a in axes}, {a: row[f"max{a}"] for a in axes}, row["n"])


def widest(axes: tuple[str, ...]) -> Column:
    return F.greatest(*(F.col(f"{a}max") - F.col(f"{a}min") for a in axes), F.lit(0.0))


def raw_level(axes: tuple[str, ...]) -> Column:
    """The level of a box, NULL for a point."""
    size = widest(axes)
    return F.when(size > 0, F.ceil(F.log2(size)).cast("int"))


def level_of(extent: Extent, axes: tuple[str, ...]) -> Column:
    return F.greatest(raw_level(axes), F.lit(extent.floor))


def spread(boxes: DataFrame, level: Column, axes: tuple[str, ...] = AXES) -> DataFrame:
    """`boxes` once for each level of the array `level` and bucket they touch there: columns b_level and b_x, b_y, b_z."""
    boxes = boxes.withColumn("b_level", F.explode(level))
    step = F.pow(F.lit(2.0), F.col("b_level"))
    for a in axes:
        boxes = boxes.withColumn(f"b_{a}", F.explode(F.sequence(cell_of(F.col(f"{a}min"), step), cell_of(F.col(f"{a}max"), step))))
    return boxes


def within(extent: Extent, axes: tuple[str, ...]) -> Column:
    """Whether a box meets the common box of the other side: what lies outside takes no part."""
    return reduce(lambda p, q: p & q, ((F.col(f"{a}max") >= extent.low[a]) & (F.col(f"{a}min") <= extent.high[a]) for a in axes))


def tasks_for(n: int, spark: SparkSession) -> int:
    """Tasks for `n` rows of at most about POINTS each, and no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // POINTS))


def points_in_boxes(points: DataFrame, boxes: DataFrame, axes: tuple[str, ...] = AXES) -> DataFrame:
    """All columns of both for each point within a closed box. Names must not clash."""
    extent = Extent.of(boxes, axes)
    if extent is None:
        return points.join(boxes, F.lit(False))
    near = reduce(lambda p, q: p & q, (F.col(a).between(extent.low[a], extent.high[a]) for a in axes))
    few = extent.count <= FEW
    if few:
        near_points = points.where(near)
        points = near_points.repartition(tasks_for(near_points.count(), points.sparkSession), *axes)
    placed = points.where(near).withColumn("b_level", F.explode(F.array(*map(F.lit, extent.levels))))
    placed = placed.withColumns({f"b_{a}": cell_of(F.col(a), F.pow(F.lit(2.0), F.col("b_level"))) for a in axes})
    inside = reduce(lambda p, q: p & q, (F.col(a).between(F.col(f"{a}min"), F.col(f"{a}max")) for a in axes))
    keys = ["b_level", *(f"b_{a}" for a in axes)]
    touched = spread(boxes, F.array(level_of(extent, axes)), axes)
    return placed.join(F.broadcast(touched) if few else dealt(touched), keys).where(inside).drop(*keys)


def boxes_meeting(left: DataFrame, right: DataFrame, axes: tuple[str, ...] = AXES, prefix: str = "r_") -> DataFrame:
    """All columns of both (those of `right` prefixed) for each pair of closed boxes that meet. Where one side has few
    boxes, they are sent to every task and the others are dealt: large boxes of few would share few buckets."""
    known = [Extent.of(x, axes) for x in (left, right)]
    if None in known:
        return left.join(right.select(*(F.col(c).alias(f"{prefix}{c}") for c in right.columns)), F.lit(False))
    floor = min(x.floor for x in known)
    known = [Extent(x.levels, max(floor, x.floor), x.low, x.high, x.count) for x in known]
    sides = []
    few = [x.count * (1 + len(other.levels)) <= FEW for x, other in (known, known[::-1])]
    few[0] &= not few[1]
    for x, own, other, dealt_out in ((left, known[0], known[1], few[1]), (right, known[1], known[0], few[0])):
        if dealt_out:
            x = x.repartition(tasks_for(own.count, x.sparkSession), *(f"{a}{e}" for a in axes for e in ("min", "max")))
        larger = F.filter(F.array(*map(F.lit, other.levels)), lambda v: v >= F.col("b_own"))
        sides.append(spread(x.where(within(other, axes)).withColumn("b_own", level_of(own, axes)), F.array_union(F.array("b_own"), larger), axes))
    keys = ["b_level", *(f"b_{a}" for a in axes)]
    spread_right = sides[1].select(*(F.col(c).alias(f"{prefix}{c}") for c in right.columns), F.col("b_own").alias("b_other"), *keys)
    meets = reduce(lambda p, q: p & q, ((F.col(f"{a}min") <= F.col(f"{prefix}{a}max")) & (F.col(f"{prefix}{a}min") <= F.col(f"{a}max")) for a in axes))
    step = F.pow(F.lit(2.0), F.col("b_level"))
    once = reduce(lambda p, q: p & q, (F.col(f"b_{a}") == cell_of(F.greatest(F.col(f"{a}min"), F.col(f"{prefix}{a}min")), step) for a in axes))
    met = F.broadcast(sides[0]).join(spread_right, keys) if few[0] else sides[0].join(F.broadcast(spread_right) if few[1] else spread_right, keys)
    return met.where((F.col("b_level") == F.greatest("b_own", "b_other")) & meets & once).drop(*keys, "b_own", "b_other")


def inflated(boxes: DataFrame, tolerance: float, flat: bool, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Boxes larger by tolerance times their extent on each axis; lines and surfaces take their largest extent on all."""
    by = {a: (widest(axes) if flat else F.col(f"{a}max") - F.col(f"{a}min")) * F.lit(tolerance) for a in axes}
    return boxes.withColumns({f"{a}min": F.col(f"{a}min") - by[a] for a in axes} | {f"{a}max": F.col(f"{a}max") + by[a] for a in axes})
