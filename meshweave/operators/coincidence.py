"""Points that coincide: at one place, within a tolerance, or as the periodic image of one another."""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshweave.functions.periodicity import Periodicity, images_of
from meshweave.operators.candidates import AXES, boxes_meeting, cell_of
from meshweave.operators.components import components
from meshweave.plans.durable import removed, stored

#: Points of two cells that must be compared one by one are dealt to blocks of about so many.
BLOCK = 128
#: The directions of a cell's neighbours: -1, 0 or 1 on each axis.
DIRECTIONS = [d for d in product((-1, 0, 1), repeat=3)]


def squared(terms: list[Column]) -> Column:
    return reduce(lambda p, q: p + q, (t * t for t in terms))


def least_gap(a: str, b: str) -> Column:
    """The squared distance of two boxes whose columns begin with `a` and `b`."""
    return squared([F.greatest(F.col(f"{a}{x}min") - F.col(f"{b}{x}max"), F.col(f"{b}{x}min") - F.col(f"{a}{x}max"), F.lit(0.0)) for x in AXES])


def widest_gap(a: str, b: str) -> Column:
    """The squared distance of the two places of two boxes that are farthest apart."""
    return squared([F.greatest(F.col(f"{a}{x}max") - F.col(f"{b}{x}min"), F.col(f"{b}{x}max") - F.col(f"{a}{x}min")) for x in AXES])


def boxes_of(points: DataFrame, *keys: str) -> DataFrame:
    """The box, the number and the smallest id of the points of each key."""
    ends = [f(a).alias(f"{a}{e}") for a in AXES for e, f in (("min", F.min), ("max", F.max))]
    return points.groupBy(*keys).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), *ends)


def celled(points: DataFrame, tolerance: float) -> DataFrame:
    """`points` (id, x, y, z and more) with the cell they lie in; a cell's diagonal is the tolerance."""
    edge = tolerance * (1 - 1e-9) / math.sqrt(3)
    far = points.agg(F.max(F.greatest(*(F.abs(a) for a in AXES)))).first()[0]
    if far is not None and far / edge > 2**52:
        raise ValueError("the tolerance is finer than these coordinates can tell")
    return points.withColumn("cell", F.struct(*(cell_of(F.col(a), edge).alias(a) for a in AXES)))


def near_boxes(left: DataFrame, right: DataFrame, tolerance: float) -> DataFrame:
    """(a, b) and all columns of boxes_of() with these prefixes, for each box of `left` (key a) and of `right` (key b) at
    most the tolerance apart."""
    keys = [F.col(f"{a}{e}").alias(f"{a}{e}") for a in AXES for e in ("min", "max")]
    wide = [rows.select(side, *keys).withColumns({f"{a}min": F.col(f"{a}min") - tolerance / 2 for a in AXES} | {f"{a}max": F.col(f"{a}max") + tolerance / 2 for a in AXES}) for side, rows in (("a", left), ("b", right))]
    met = boxes_meeting(*wide).select("a", F.col("r_b").alias("b"))
    of = lambda side, rows: rows.select(*(F.col(c).alias(c if c == side else f"{side}_{c}") for c in rows.columns))
    return met.join(of("a", left), "a").join(of("b", right), "b").where(least_gap("a_", "b_") <= tolerance**2)


def touched(pairs: DataFrame, left: DataFrame, right: DataFrame, tolerance: float, kept: list[DataFrame]) -> DataFrame:
    """(a, b, u, v) for each of `pairs` (near_boxes()) with points u of a and v of b at most the tolerance apart, of which
    one is named. Only points near the other's box are compared, in blocks of about BLOCK."""
    sides = []
    for s, o, points in (("a", "b", left), ("b", "a", right)):
        gap = squared([F.greatest(F.col(f"{o}_{x}min") - F.col(x), F.col(x) - F.col(f"{o}_{x}max"), F.lit(0.0)) for x in AXES])
        near = stored(pairs.join(points, s).where(gap <= tolerance**2).select("a", "b", "id", *AXES))
        kept.append(near)
        blocks = near.groupBy("a", "b").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        sides.append((near.join(blocks, ["a", "b"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), blocks))
    rows = []
    for k, o, name in ((0, 1, {"own": "i", "other": "j"}), (1, 0, {"own": "j", "other": "i"})):
        every = sides[o][1].select("a", "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        rows.append(sides[k][0].join(every, ["a", "b"]).select("a", "b", *(F.col(c).alias(n) for c, n in name.items()), *(F.col(c).alias(f"{'uv'[k]}_{c}") for c in ("id", *AXES))))
    hits = rows[0].join(rows[1], ["a", "b", "i", "j"]).where(squared([F.col(f"u_{x}") - F.col(f"v_{x}") for x in AXES]) <= tolerance**2)
    return hits.groupBy("a", "b").agg(F.min(F.struct(F.col("u_id").alias("u"), F.col("v_id").alias("v"))).alias("l")).select("a", "b", "l.u", "l.v")


def close_links(places: DataFrame, tolerance: float) -> DataFrame:
    """Links (u, v), stored, of the places (id, x, y, z) whose components are those of all pairs at `tolerance` or less.

    Cells whose diagonal is the tolerance hold points that are all linked: each links with its cell's first. Cells
    meet where their boxes come within the tolerance. Most such pairs are settled by the boxes (all of both are near
    enough, or a single point each) or by the points that lie farthest in the direction of the other cell. Only cells
    that are then still apart have those of their points compared that are near the other's box; a link between two
    cells is as good as all of them. So a crowd at one place costs no more than its number, and pairs of points are
    not made where their cells are connected anyway.
    """
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(stored(df))
        return kept[-1]

    edge = tolerance / math.sqrt(3)
    placed = celled(places.select("id", *(F.col(a).cast("double").alias(a) for a in AXES)), tolerance)
    reach = [reduce(lambda p, q: p + q, (F.lit(float(s)) * F.col(a) for s, a in zip(d, AXES, strict=True))) for d in DIRECTIONS]
    tips = placed.groupBy("cell").agg(F.array(*(F.max_by(F.struct("id", *AXES), F.struct(r, "id")) for r in reach)).alias("tips"))
    cells = keep(boxes_of(placed, "cell"))
    crowded = cells.where("n > 1").select("cell", F.col("id").alias("v"))
    own = placed.join(crowded, "cell").where("id <> v").select(F.col("id").alias("u"), "v")
    both = near_boxes(cells.withColumnRenamed("cell", "a"), cells.withColumnRenamed("cell", "b"), tolerance).where("a_id < b_id")
    both = keep(both.withColumn("sure", widest_gap("a_", "b_") <= tolerance**2))
    # of the others: which way b lies from a, as a number among DIRECTIONS; 26 less that is the way back
    middle = lambda side, x: (F.col(f"{side}_{x}min") + F.col(f"{side}_{x}max")) / 2
    way = reduce(lambda p, q: p * 3 + q, (F.signum(F.round((middle("b", x) - middle("a", x)) / edge)).cast("int") + 1 for x in AXES), F.lit(0))
    open_ = both.where("not sure and a_n + b_n > 2").join(tips.select(F.col("cell").alias("a"), F.col("tips").alias("a_tips")), "a").join(tips.select(F.col("cell").alias("b"), F.col("tips").alias("b_tips")), "b")
    ends = F.get("a_tips", way), F.get("b_tips", 26 - way)
    open_ = keep(open_.withColumn("sure", squared([ends[0][x] - ends[1][x] for x in AXES]) <= tolerance**2).drop("a_tips", "b_tips"))
    pair = [F.col("a_id").alias("u"), F.col("b_id").alias("v")]
    links = keep(own.unionByName(both.where("sure").select(*pair)).unionByName(open_.where("sure").select(*pair)))
    if not open_.where("not sure").isEmpty():
        roots = components(links)
        kept.append(roots)
        root = lambda side: roots.select(F.col("node").alias(f"{side}_id"), F.col("root").alias(f"{side}_root"))
        apart = open_.where("not sure").join(root("a"), "a_id", "left").join(root("b"), "b_id", "left").where(F.coalesce("a_root", "a_id") != F.coalesce("b_root", "b_id"))
        points = [placed.withColumnRenamed("cell", s) for s in "ab"]
        links = links.unionByName(touched(keep(apart.drop("a_root", "b_root")), *points, tolerance, kept).select("u", "v"))
    made = stored(links)
    for x in kept:
        removed(x)
    return made


def coincident(points: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(gnum, same): the smallest number among the points that are reached from a point by steps of at most `tolerance`
    between points; with 0, among those at the very same place.

    A point without all its coordinates coincides with no other.
    """
    whole = reduce(lambda p, q: p & q, (F.col(a).isNotNull() & ~F.isnan(F.col(a).cast("double")) for a in AXES))
    rows = points.select("gnum", *(F.when(whole, F.col(a).cast("double") + 0.0).alias(a) for a in AXES))  # -0.0 is 0.0
    first = rows.where(F.col("x").isNotNull()).groupBy(*AXES).agg(F.min("gnum").alias("same"))
    if not tolerance:
        return rows.join(first, [*AXES], "left").select("gnum", F.coalesce("same", "gnum").alias("same"))
    first = stored(first)
    roots = components(close_links(first.withColumnRenamed("same", "id"), tolerance))
    linked = first.join(roots.withColumnRenamed("node", "same"), "same", "left")
    return rows.join(linked, [*AXES], "left").select("gnum", F.coalesce("root", "same", "gnum").alias("same"))


def periodic_links(points: DataFrame, periodicity: Periodicity, tolerance: float) -> DataFrame:
    """(gnum, tr_id, other): a point of class `gnum`, moved by the transform, lies within `tolerance` of a point of class
    `other`; classes are those of coincident(). Every link comes with its reverse, under the reverse transform's id.

    Images meet places as cells meet in close_links(): the points of one class and cell are a box, of which one pair
    of points within the tolerance is enough. Points without all their coordinates have no links.
    """
    classes = stored(coincident(points, tolerance))
    there = reduce(lambda p, q: p & q, (F.col(a).isNotNull() & ~F.isnan(F.col(a).cast("double")) for a in AXES))
    places = stored(points.where(there).join(classes, "gnum").groupBy(*(F.col(a).cast("double").alias(a) for a in AXES)).agg(F.min("same").alias("id")))
    moved = places.select("id", F.inline(images_of(periodicity.transforms())))
    left = stored(celled(moved, tolerance).select(F.struct("tr_id", "id", "cell").alias("a"), "id", *AXES))
    right = stored(celled(places, tolerance).select(F.struct("id", "cell").alias("b"), "id", *AXES))
    both = stored(near_boxes(boxes_of(left, "a"), boxes_of(right, "b"), tolerance).withColumn("sure", widest_gap("a_", "b_") <= tolerance**2))
    kept: list[DataFrame] = [classes, places, left, right, both]
    found = both.where("sure").select("a", "b").unionByName(touched(both.where("not sure and a_n + b_n > 2"), left, right, tolerance, kept).select("a", "b"))
    one = stored(found.select(F.col("a.id").alias("gnum"), F.col("a.tr_id").alias("tr_id"), F.col("b.id").alias("other")).distinct())
    for x in kept:
        removed(x)
    back = F.create_map(*(F.lit(x) for i in periodicity.transforms() for x in (i, periodicity.reverse(i))))
    return one.unionByName(one.select(F.col("other").alias("gnum"), back[F.col("tr_id")].alias("tr_id"), F.col("gnum").alias("other"))).distinct()


def periodic_classes(points: DataFrame, periodicity: Periodicity, tolerance: float) -> DataFrame:
    """(gnum, same): the smallest number that coincidence and periodic links together reach."""
    near = stored(coincident(points, tolerance))
    links = stored(periodic_links(points, periodicity, tolerance))
    roots = components(links.select(F.col("gnum").alias("u"), F.col("other").alias("v")))
    return near.join(roots.withColumnRenamed("node", "same"), "same", "left").select("gnum", F.coalesce("root", "same").alias("same"))
