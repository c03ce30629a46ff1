"""Overlaps of cells: the mapping of conservative exchanges."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshweave.functions import shapes
from meshweave.operators.candidates import AXES, boxes_meeting, inflated
from meshweave.operators.location import FLAT_TYPES, flat_columns, groups, rows_of

OVERLAP = "tgt_gnum long, src_gnum long, volume double"
CUT = "gnum long, sub int, corners array<double>"


def box_overlap(sources: DataFrame, targets: DataFrame, axes: tuple[str, ...] = AXES) -> DataFrame:
    """(tgt_gnum, src_gnum, volume) of axis-aligned boxes (gnum, xmin .. zmax), by arithmetic alone; only volume > 0."""
    pairs = boxes_meeting(targets, sources, axes=axes)
    sides = (F.greatest(F.lit(0.0), F.least(F.col(f"{a}max"), F.col(f"r_{a}max")) - F.greatest(F.col(f"{a}min"), F.col(f"r_{a}min"))) for a in axes)
    return pairs.select(F.col("gnum").alias("tgt_gnum"), F.col("r_gnum").alias("src_gnum"), reduce(lambda p, q: p * q, sides).alias("volume")).where("volume > 0")


def planes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two axes (n, 3) of the mean planes of polygons (n, m, 3), which run counter-clockwise in them."""
    normal = shapes.newell(v)
    normal /= np.maximum(np.sqrt(shapes.dot(normal, normal)), 1e-300)[:, None]
    first = v[:, 1] - v[:, 0]
    first = first - shapes.dot(first, normal)[:, None] * normal
    first /= np.maximum(np.sqrt(shapes.dot(first, first)), 1e-300)[:, None]
    return first, np.cross(normal, first)


def flattened(v: np.ndarray, origin: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    away = v - origin[:, None]
    return np.stack([np.einsum("nmk,nk->nm", away, first), np.einsum("nmk,nk->nm", away, second)], axis=2)


def ears(v: np.ndarray, delaunay: bool = False) -> list[list[tuple[int, int, int]]]:
    """The triangles (places) of each polygon (n, m, 3): itself, or ears cut off in its mean plane; quads that are convex
    take a diagonal. With `delaunay`, their inner edges are flipped until all are Delaunay in that plane."""
    m = v.shape[1]
    if m == 3:
        return [[(0, 1, 2)]] * len(v)
    flat = flattened(v, v.mean(axis=1), *planes(v))
    before, after = np.roll(flat, 1, axis=1), np.roll(flat, -1, axis=1)
    turn = (flat[..., 0] - before[..., 0]) * (after[..., 1] - flat[..., 1]) - (flat[..., 1] - before[..., 1]) * (after[..., 0] - flat[..., 0])
    plain = (turn > 0).all(axis=1) if m == 4 else np.zeros(len(v), bool)
    made = [[(0, 1, 2), (0, 2, 3)] if easy else shapes.ear_clip(x) for easy, x in zip(plain, flat, strict=True)]
    return [shapes.delaunay(x, t) for x, t in zip(flat, made, strict=True)] if delaunay else made


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Polygons as the coordinates of their triangles."""
    for batch in batches:
        gnums, subs, corners = [], [], [np.empty((0, 9))]
        gnum = batch.column("gnum").to_numpy()
        for _, rows in groups(batch, ()):
            v = rows_of(batch, "flat", rows).reshape(len(rows), -1, 3)
            for i, triangles in enumerate(ears(v)):
                corners.append(v[i][np.array(triangles)].reshape(-1, 9))
                gnums += [gnum[rows[i]]] * len(triangles)
                subs += range(len(triangles))
        flat = np.concatenate(corners)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * 9, pa.int32()), pa.array(flat.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(gnums, pa.int64()), pa.array(subs, pa.int32()), lists], ["gnum", "sub", "corners"])


def triangles_of(cells: DataFrame) -> DataFrame:
    """(gnum, sub, corners, xmin .. zmax): the triangles of surface cells; a cell is cut once, not once for each pair."""
    made = cells.select("gnum", *flat_columns()).mapInArrow(cut, CUT)
    ends = {f"{a}{e}": f(*(F.get("corners", F.lit(3 * i + k)) for i in range(3))) for k, a in enumerate(AXES) for e, f in (("min", F.least), ("max", F.greatest))}
    return made.withColumns(ends)


def triangle_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every = np.arange(batch.num_rows)
        t, s = (rows_of(batch, c, every).reshape(-1, 3, 3) for c in ("corners", "r_corners"))
        first, second = planes(t) if len(t) else (np.empty((0, 3)),) * 2
        window, subject = (flattened(x, t[:, 0], first, second) for x in (t, s))
        area = shapes.clipped_areas(subject, window)
        yield pa.RecordBatch.from_arrays([batch.column("gnum"), batch.column("r_gnum"), pa.array(area)], ["tgt_gnum", "src_gnum", "volume"])


def volume_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = np.zeros(batch.num_rows)
        for (kind, faces, other, r_faces), rows in groups(batch, ("elt_type", "faces", "r_elt_type", "r_faces"), ("flat", "r_flat")):
            t, s = (rows_of(batch, c, rows).reshape(len(rows), -1, 3) for c in ("flat", "r_flat"))
            made[rows] = shapes.overlap_volumes(s, shapes.faces_of(other, r_faces), t, shapes.faces_of(kind, faces))
        yield pa.RecordBatch.from_arrays([batch.column("gnum"), batch.column("r_gnum"), pa.array(made)], ["tgt_gnum", "src_gnum", "volume"])


def overlap(sources: DataFrame, targets: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """(tgt_gnum, src_gnum, volume): the common area or volume of each pair of cells that overlap, not normalised.

    Surface cells of any shape are cut into triangles, and each pair of triangles is compared in the target's plane;
    volume cells are star-shaped, convex or not. Cells of the other dimension take no part.
    """
    flat = F.col("elt_type").isin(*FLAT_TYPES)
    own, other = (inflated(triangles_of(x.where(flat)), tolerance, True) for x in (targets, sources))
    areas = boxes_meeting(own, other).select("gnum", "corners", "r_gnum", "r_corners").mapInArrow(triangle_pairs, OVERLAP).where("volume > 0")
    surfaces = areas.groupBy("tgt_gnum", "src_gnum").agg(F.sum("volume").alias("volume"))
    bounds = [f"{a}{e}" for a in AXES for e in ("min", "max")]
    solid = F.col("elt_type").isin("tetra4", "pyram5", "prism6", "hexa8", "poly3d")
    own, other = (x.where(solid).select("gnum", *flat_columns(), *bounds) for x in (targets, sources))
    pairs = boxes_meeting(own, other).select("gnum", "elt_type", "flat", "faces", "r_gnum", "r_elt_type", "r_flat", "r_faces")
    return surfaces.unionByName(pairs.mapInArrow(volume_pairs, OVERLAP).where("volume > 0"))
