"""Point location: which cell holds each target, with the weights of its vertices."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshweave.functions import highorder, shapes
from meshweave.operators.candidates import AXES, FEW, boxes_meeting, cell_of, inflated, points_in_boxes, tasks_for, widest
from meshweave.operators.nearest import nearest
from meshweave.plans.durable import dealt, stored

#: Element types by name with a locating function of their own: (points, vertices, order) to weights, projection, dist2, parameters.
USER_ELEMENTS: dict[str, Callable] = {}

LOCATED = "tgt_gnum long, src_gnum long, nodes array<long>, weights array<double>, dist2 double, proj array<double>, uvw array<double>"
#: Distances of at most this share of a cell's extent are rounding: the point lies in the cell.
TOUCHING = 1e-12
FLAT_TYPES = ("tria3", "quad4", "poly2d")


def flat_columns() -> list[Column]:
    """What the kernels take of a cell: type, order, vertex numbers, coordinates end to end and, for polyhedra, faces as JSON."""
    flat = F.flatten(F.transform("vtx", lambda v: F.array(v.x, v.y, v.z)))
    faces = F.when(F.col("elt_type") == "poly3d", F.to_json("faces"))
    return [F.col("elt_type"), F.col("order"), F.transform("vtx", lambda v: v.gnum).alias("nodes"), flat.alias("flat"), faces.alias("faces")]


def groups(batch: pa.RecordBatch, by: tuple[str, ...], lists: tuple[str, ...] = ("flat",)) -> Iterator[tuple[tuple, np.ndarray]]:
    """The rows of a batch with equal values of `by` and equal lengths of `lists`: (values of `by`, rows)."""
    codes = [batch.column(c).dictionary_encode() for c in by]
    parts = [np.asarray(pc.fill_null(c.indices, -1)) for c in codes] + [np.asarray(pc.fill_null(pc.list_value_length(batch.column(c)), 0)) for c in lists]
    if not batch.num_rows:
        return
    _, place = np.unique(np.stack(parts, axis=1), axis=0, return_inverse=True)
    place = place.ravel()
    order = np.argsort(place, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
        yield tuple(batch.column(c)[int(rows[0])].as_py() for c in by), rows


def rows_of(batch: pa.RecordBatch, column: str, rows: np.ndarray) -> np.ndarray:
    """Lists of one length of the given rows as an array (rows, length)."""
    picked = batch.column(column).take(pa.array(rows))
    return picked.flatten().to_numpy().reshape(len(rows), -1)


def listed(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(np.ascontiguousarray(values).ravel()))


def worked(batch: pa.RecordBatch, reach2: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """Candidate pairs, together by element type, order, number of vertices and faces: (rows of the batch, results). With
    `reach2`, those farther apart only have a distance beyond it; curved elements lower it to what another of their target's
    allows, by its nodes."""
    for (kind, order, faces), rows in groups(batch, ("elt_type", "order", "faces")):
        v = rows_of(batch, "flat", rows).reshape(len(rows), -1, 3)
        at = pa.array(rows)
        p = np.stack([batch.column(a).take(at).to_numpy() for a in AXES], axis=1)
        if kind in USER_ELEMENTS:
            made = USER_ELEMENTS[kind](p, v, order)
        elif kind.startswith("ho_"):
            if reach2 is not None:
                reach2[rows] = np.minimum(reach2[rows], nearest_nodes(batch.column("tgt_gnum").take(at).to_numpy(), p, v) ** 2)
            made = highorder.located(kind, order, p, v, None if reach2 is None else np.sqrt(reach2[rows]))
        elif kind == "poly3d":
            made = shapes.polyhedron(p, v, shapes.faces_of(kind, faces))
        else:
            made = shapes.located(kind, p, v)
        weights, near, d2, u = made
        extent = np.ptp(v, axis=1).max(axis=1)
        d2 = np.where(d2 > (TOUCHING * extent) ** 2, d2, 0.0)
        known = [batch.column(c).take(at) for c in ("tgt_gnum", "src_gnum", "nodes")]
        yield rows, pa.RecordBatch.from_arrays([*known, listed(weights), pa.array(d2), listed(near), listed(u)], ["tgt_gnum", "src_gnum", "nodes", "weights", "dist2", "proj", "uvw"])


def nearest_nodes(target: np.ndarray, p: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of the pairs the distance from its target to the nearest node of any of that target's elements, and a bit
    more: elements hold their nodes, so those farther away are not the closest."""
    own = np.sqrt(((v - p[:, None]) ** 2).sum(axis=2).min(axis=1)) * (1 + 1e-9) + 1e-6 * np.ptp(v, axis=1).max(axis=1)
    _, who = np.unique(target, return_inverse=True)
    least = np.full(len(target), np.inf)
    np.minimum.at(least, who, own)
    return least[who]


def firsts(made: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the pairs of a batch those that winners() can choose: of each target the nearest, and what its rounding may take
    for as near."""
    made = [m for m in made if m.num_rows]
    if not made:
        return
    _, who = np.unique(np.concatenate([m.column("tgt_gnum").to_numpy() for m in made]), return_inverse=True)
    d2 = np.concatenate([m.column("dist2").to_numpy() for m in made])
    least = np.full(who.max() + 1, np.inf)
    np.fmin.at(least, who, d2)
    kept, at = ~(d2 > least[who] * (1 + 1e-10)), 0  # distances that are no number stay
    for m in made:
        yield m.filter(pa.array(kept[at : at + m.num_rows]))
        at += m.num_rows


def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from firsts([made for _, made in worked(batch)])


def kernel_within_reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the pairs those at a squared distance of at most reach2; the others are not sent back."""
    for batch in batches:
        reach = batch.column("reach2").to_numpy().copy()
        yield from firsts([made.filter(pa.array(made.column("dist2").to_numpy() <= reach[rows])) for rows, made in worked(batch, reach)])


def winners(pairs: DataFrame, tasks: int) -> DataFrame:
    """Of each target's pairs the one of least distance (to twelve digits, at any scale), then of the smallest cell, in so
    many tasks."""
    rest = [c for c in pairs.columns if c != "tgt_gnum"]
    scale = F.pow(F.lit(10.0), F.floor(F.log10("dist2")))
    distance = F.when(F.col("dist2") > 0, F.round(F.col("dist2") / scale, 11) * scale).otherwise(0.0)
    return pairs.repartition(tasks, "tgt_gnum").groupBy("tgt_gnum").agg(F.min_by(F.struct(*rest), F.struct(distance, "src_gnum")).alias("best")).select("tgt_gnum", "best.*")


def evaluated(pairs: DataFrame) -> DataFrame:
    return pairs.select("tgt_gnum", "src_gnum", *AXES, "elt_type", "order", "nodes", "flat", "faces").mapInArrow(kernel, LOCATED)


def bulging(cells: DataFrame) -> DataFrame:
    """`cells` with boxes that hold curved elements whole, not only their nodes."""
    known = [tuple(r) for r in cells.where(F.col("elt_type").isin(*highorder.DIMENSIONS)).select("elt_type", "order").distinct().collect()]  # a row for each kind
    if not known:
        return cells
    by = F.lit(1.0)
    for kind, order in known:
        by = F.when((F.col("elt_type") == kind) & (F.col("order") == order), highorder.reach(kind, order)).otherwise(by)
    middle, half = {a: (F.col(f"{a}min") + F.col(f"{a}max")) / 2 for a in AXES}, {a: (F.col(f"{a}max") - F.col(f"{a}min")) / 2 * by for a in AXES}
    return cells.withColumns({f"{a}min": middle[a] - half[a] for a in AXES} | {f"{a}max": middle[a] + half[a] for a in AXES})


def boxed(cells: DataFrame) -> DataFrame:
    return bulging(cells).select(F.col("gnum").alias("src_gnum"), *flat_columns(), *(f"{a}{e}" for a in AXES for e in ("min", "max")))


def placed(points: DataFrame) -> DataFrame:
    return points.select(F.col("gnum").alias("tgt_gnum"), *(F.col(a).cast("double").alias(a) for a in AXES))


def locate(targets: DataFrame, cells: DataFrame, tolerance: float = 1e-3, every: bool = False) -> DataFrame:
    """A mapping of targets (gnum, x, y, z) to cells, as in mesh.cells(): the containing one, else the closest within the
    tolerance (a share of the cell's extent). With `every`, targets beyond all cells go to the cell that is closest.

    Candidates come from a bucket join of points and inflated boxes; cells travel as flat arrays. Ties on a shared face
    go to the smallest cell number.
    """
    flat = F.col("elt_type").isin("node", "edge2", "ho_edge", "ho_tria", "ho_quad", *FLAT_TYPES)
    every_cell = boxed(cells).withColumn("extent", widest(AXES))
    boxes = inflated(every_cell.where(flat), tolerance, True).unionByName(inflated(every_cell.where(~flat), tolerance, False))
    own = placed(targets)
    reach = F.pow(F.greatest(F.col("extent") * tolerance, F.lit(1e-30)), 2)
    pairs = points_in_boxes(own, boxes).withColumn("reach2", reach)
    found = pairs.select("tgt_gnum", "src_gnum", *AXES, "elt_type", "order", "nodes", "flat", "faces", "reach2")
    near = winners(found.mapInArrow(kernel_within_reach, LOCATED), tasks_for(own.count(), own.sparkSession))
    if not every:
        return near
    near = stored(near)
    rest = stored(own.join(near.select("tgt_gnum"), "tgt_gnum", "left_anti").withColumnRenamed("tgt_gnum", "gnum"))
    return near.unionByName(closest(rest, cells))


#: Cells of one size class are gathered in groups of this many of its extents, which far targets meet before they meet
#: any cell.
GROUP = 16
#: Balls that meet a group of cells in one task.
TOGETHER = 4096


def closest(targets: DataFrame, cells: DataFrame) -> DataFrame:
    """A mapping of every target to its closest cell, however far.

    The nearest vertex bounds the distance, and so does the closest of the cells whose boxes hold the target: in a large
    cell with far corners, that is the cell itself. The ball of that radius is compared with the boxes of whole groups
    of neighbouring cells of one size class first (a power of two, so that small cells beside a large one are not one
    group), then with the boxes of the cells of the groups it meets, so a far target does not meet them all.
    """
    corners = cells.select(F.explode("vtx").alias("v")).select(F.col("v.gnum").alias("gnum"), "v.x", "v.y", "v.z").distinct()
    by_vertex = nearest(targets, corners, 1).select(F.col("q_gnum").alias("tgt_gnum"), *(F.col(f"q{a}").alias(a) for a in AXES), "dist2")
    known, own = stored(boxed(cells)), placed(targets)
    within = points_in_boxes(own, known).select("tgt_gnum", "src_gnum", *AXES, "elt_type", "order", "nodes", "flat", "faces")
    held = stored(within.mapInArrow(kernel, LOCATED).groupBy("tgt_gnum").agg(F.min("dist2").alias("held2")))
    least = F.least(F.col("dist2"), F.coalesce("held2", F.col("dist2")))
    reach = by_vertex.join(held, "tgt_gnum", "left").select("tgt_gnum", *AXES, (F.sqrt(least) * (1 + 1e-12) + 1e-300).alias("r"))
    balls = reach.withColumns({f"{a}min": F.col(a) - F.col("r") for a in AXES} | {f"{a}max": F.col(a) + F.col("r") for a in AXES})
    size = F.greatest(widest(AXES), F.lit(1e-300))
    level = F.ceil(F.log2(size)).cast("int")
    step = F.pow(F.lit(2.0), F.col("level")) * GROUP
    grouped = known.withColumn("level", level).withColumn("group", F.struct("level", *(cell_of(F.col(f"{a}min"), step).alias(a) for a in AXES))).drop("level")
    ends = [(f"{a}{e}", f) for a in AXES for e, f in (("min", F.min), ("max", F.max))]
    whole = grouped.groupBy("group").agg(*(f(c).alias(c) for c, f in ends))

    def meets(prefix: str) -> Column:
        gaps = (F.greatest(F.col(f"{prefix}{a}min") - F.col(a), F.col(a) - F.col(f"{prefix}{a}max"), F.lit(0.0)) for a in AXES)
        return reduce(lambda p, q: p + q, (g * g for g in gaps)) <= F.col("r") * F.col("r")

    some = boxes_meeting(stored(balls), stored(whole)).where(meets("r_")).select("tgt_gnum", *AXES, "r", F.col("r_group").alias("group"))
    boxes = grouped.withColumnsRenamed({c: f"c_{c}" for c, _ in ends})
    if known.count() <= FEW:
        pairs = some.join(F.broadcast(boxes), "group")
    else:
        # a group that many balls meet goes to several tasks
        some = stored(some)
        tasks = tasks_for(some.count(), some.sparkSession)
        share = stored(some.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("shares")))
        left = some.join(dealt(share), "group").withColumn("share", F.pmod(F.xxhash64("tgt_gnum"), F.col("shares")).cast("int")).drop("shares")
        right = boxes.join(dealt(share), "group").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
        pairs = left.repartition(tasks, "group", "share").join(dealt(right.repartition(tasks, "group", "share")), ["group", "share"])
    return winners(evaluated(pairs.where(meets("c_"))), tasks_for(own.count(), own.sparkSession))
