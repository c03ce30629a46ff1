"""Values at targets from a mapping and source fields.

A mapping has tgt_gnum, src_gnum and the columns its method gives; a field has gnum and value (array of double). All
results are (gnum, value), for the targets that the mapping reaches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARRAYS = "gnum long, value array<double>"


def with_values(mapping: DataFrame, field: DataFrame) -> DataFrame:
    return mapping.join(field.select(F.col("gnum").alias("src_gnum"), "value"), "src_gnum")


def components(field: DataFrame) -> int:
    """How many components the values of a field have; 0 where it has no value."""
    first = field.select(F.size("value").alias("n")).where("n >= 0").first()
    return first["n"] if first else 0


def summed(rows: DataFrame, n: int, weight: Column, normalise: bool) -> DataFrame:
    """Component-wise sum of weight times value by target, over the sum of the weights if `normalise`: one aggregation,
    of as many sums as the field has components (n)."""
    part = rows.select("tgt_gnum", weight.alias("w"), *(F.get("value", F.lit(c)).alias(f"v{c}") for c in range(n)))
    total = [F.sum(F.col("w") * F.col(f"v{c}")) for c in range(n)]
    whole = F.sum("w")
    made = F.array(*(t / whole if normalise else t for t in total)) if n else F.array().cast("array<double>")
    return part.groupBy(F.col("tgt_gnum").alias("gnum")).agg(made.alias("value"))


#: The least and greatest number of the whole types.
WHOLE = {"int": (-(1 << 31), (1 << 31) - 1), "long": (-(1 << 63), (1 << 63) - 1)}


def converted(field: DataFrame, to: str) -> DataFrame:
    """Values as float, double, int or long; whole types cut the fraction off, and what they cannot hold is NULL."""
    if to in ("float", "double"):
        return field.withColumn("value", F.col("value").cast(f"array<{to}>"))
    low, high = WHOLE[to]
    return field.withColumn("value", F.transform("value", lambda x: F.when((x >= low) & (x <= high), x.try_cast(to))))


def of_parents(entities: DataFrame, field: DataFrame) -> DataFrame:
    """Values of entities that are given by their parents' numbers (gnum, parent): gathered by parent."""
    return entities.select("gnum", "parent").join(field.select(F.col("gnum").alias("parent"), "value"), "parent", "left").select("gnum", "value")


def copied(mapping: DataFrame, field: DataFrame) -> DataFrame:
    """The value of the one source of each target: cell-centred location, identity."""
    return with_values(mapping, field).select(F.col("tgt_gnum").alias("gnum"), "value")


def weighted_nodes(mapping: DataFrame, field: DataFrame) -> DataFrame:
    """Sum of the vertex weights times the vertex values; the mapping has nodes and weights (arrays)."""
    rows = mapping.select("tgt_gnum", F.inline(F.arrays_zip(F.col("nodes").alias("src_gnum"), F.col("weights").alias("w"))))
    return summed(with_values(rows.toDF("tgt_gnum", "src_gnum", "w"), field), components(field), F.col("w"), False)


def conservative(mapping: DataFrame, field: DataFrame) -> DataFrame:
    """Sum of overlap times value over the sum of the overlaps."""
    return summed(with_values(mapping, field), components(field), F.col("volume"), True)


def inverse_distance(mapping: DataFrame, field: DataFrame) -> DataFrame:
    return summed(with_values(mapping, field), components(field), 1 / F.greatest(F.lit(1e-30), F.col("dist2")), True)


def filled(targets: DataFrame, values: DataFrame, n_components: int = 1, zero: bool = False) -> DataFrame:
    """Every target; those without a value get NULL, or zeros."""
    made = targets.select("gnum").join(values, "gnum", "left")
    return made.withColumn("value", F.coalesce("value", F.array_repeat(F.lit(0.0), n_components))) if zero else made


def fits(points: np.ndarray, origin: np.ndarray, values: np.ndarray, dist2: np.ndarray, degree: int) -> np.ndarray:
    """Weighted least squares at `origin` for a batch: points (n, k, 3), values (n, k, c).

    Basis 1 and the powers of each coordinate difference up to `degree`, without cross terms; weight 1 / (d2 + 1e-12);
    the minimum-norm solution where the points do not determine one.
    """
    away = points - origin[:, None, :]
    basis = np.concatenate([np.ones((*away.shape[:2], 1)), *(away**p for p in range(1, degree + 1))], axis=2)
    root = np.sqrt(1 / (dist2 + 1e-12))[:, :, None]
    return np.einsum("nk,nkc->nc", np.linalg.pinv(basis * root, rcond=1e-10)[:, 0, :], values * root)


def least_squares(mapping: DataFrame, field: DataFrame, degree: int = 1) -> DataFrame:
    """Weighted least squares over the k nearest sources (arrays of bounded length, solved in batches).

    A source at the target (d2 < 1e-24) is copied. Targets with fewer than 1 + 3 * degree sources, and those for which
    the fit is not finite, take the inverse-distance mean. The mapping has dist2 and the coordinates of both ends:
    tx, ty, tz and sx, sy, sz.
    """
    near = F.sort_array(F.collect_list(F.struct("dist2", "src_gnum", "sx", "sy", "sz", "value")))
    rows = with_values(mapping, field).groupBy("tgt_gnum").agg(*(F.first(f"t{a}").cast("double").alias(f"t{a}") for a in "xyz"), near.alias("near"))
    # distance, place and components of one source after the other, as one array of numbers
    numbers = F.flatten(F.transform("near", lambda s: F.concat(F.array(*(s[c].cast("double") for c in ("dist2", "sx", "sy", "sz"))), s.value.cast("array<double>"))))
    rows = rows.select("tgt_gnum", "tx", "ty", "tz", F.size("near").alias("k"), numbers.alias("numbers"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.stack([batch.column("k").to_numpy(), np.asarray(pc.list_value_length(batch.column("numbers")))], axis=1) if batch.num_rows else np.empty((0, 2), int)
            for k, length in np.unique(sizes, axis=0):
                mine = pa.array(np.flatnonzero((sizes == (k, length)).all(axis=1)))
                near = batch.column("numbers").take(mine).flatten().to_numpy(zero_copy_only=False).reshape(len(mine), k, -1)
                d2, points, values = near[..., 0], near[..., 1:4], near[..., 4:]
                origin = np.stack([batch.column(f"t{a}").take(mine).to_numpy() for a in "xyz"], axis=1)
                w = 1 / np.maximum(1e-30, d2)
                made = np.einsum("nk,nkc->nc", w, values) / w.sum(axis=1)[:, None]
                if k >= 1 + 3 * degree:
                    fit = fits(points, origin, values, d2, degree)
                    good = np.isfinite(fit).all(axis=1)
                    made[good] = fit[good]
                at = d2[:, 0] < 1e-24
                made[at] = values[at, 0]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1) * made.shape[1], pa.int32()), pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("tgt_gnum").take(mine), lists], ["gnum", "value"])

    return rows.mapInArrow(solve, ARRAYS)


#: Targets are dealt to so many groups a shuffle partition, each one call of Python for all functions of its targets.
GROUPS = 4


def user_defined(mapping: DataFrame, field: DataFrame, function: Callable[[pd.DataFrame], list[float]]) -> DataFrame:
    """`function` takes the rows of the mapping of one target, with value, and gives the components there. Targets travel
    to Python in groups, not one by one."""
    rows = with_values(mapping, field)
    many = GROUPS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def some(group: pd.DataFrame) -> pd.DataFrame:
        made = [(target, list(function(part.drop(columns="_group").reset_index(drop=True)))) for target, part in group.groupby("tgt_gnum", sort=False)]
        return pd.DataFrame(made, columns=["gnum", "value"])

    return rows.withColumn("_group", F.pmod(F.xxhash64("tgt_gnum"), F.lit(many))).groupBy("_group").applyInPandas(some, ARRAYS)


def interleaved(field: DataFrame) -> DataFrame:
    """(component, gnum, value): x1..xn, y1..yn instead of x1, y1, x2, y2."""
    return field.select("gnum", F.posexplode("value").alias("component", "value")).select("component", "gnum", "value")


def interlaced(rows: DataFrame) -> DataFrame:
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("component", "value"))), lambda x: x.value)
    return rows.groupBy("gnum").agg(ordered.alias("value"))
