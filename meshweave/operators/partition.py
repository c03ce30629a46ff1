"""Parts of even weight along a space-filling curve, and the index that tells which part a place belongs to."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshweave.functions.geometry import morton
from meshweave.operators.candidates import AXES
from meshweave.plans.durable import removed, stored


def curve_codes(points: DataFrame, bits: int = 16) -> DataFrame:
    """`points` with their Morton code over their common box."""
    low_high = points.agg(*(f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))))
    scaled = [F.floor((F.col(a) - F.col(f"min_{a}")) / F.greatest(F.col(f"max_{a}") - F.col(f"min_{a}"), F.lit(1e-300)) * ((1 << bits) - 1)) for a in AXES]
    return points.join(F.broadcast(low_high)).withColumn("morton", morton(scaled, bits)).drop(*low_high.columns)


def even_splits(coded: DataFrame, parts: int, weight: Column | str = "weight", code: str = "morton") -> list[int]:
    """The first code of every part but the first, in order, for `parts` parts whose weights are as even as whole codes
    allow: no part is off by more than its heaviest codes.

    Weights of a code are added up first, so a place that many share is one row. Codes are sorted by ranges, each summed
    up as it streams by; the ranges' totals, as many as shuffle partitions, shift them. A part begins at the first
    code whose middle lies in its share of the weight. Null weights count as 0. What comes back is `parts` numbers.
    """
    if parts < 1:
        raise ValueError("there is at least one part")
    own = F.col(weight) if isinstance(weight, str) else weight
    sums = coded.groupBy(F.col(code).cast("long").alias("code")).agg(F.sum(F.coalesce(own.cast("double"), F.lit(0.0))).alias("w")).where("code is not null")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        before, part = 0.0, TaskContext.get().partitionId()
        for batch in batches:
            w = batch.column("w").to_numpy()
            upto = before + np.cumsum(w)
            yield pa.RecordBatch.from_arrays([batch.column("code"), batch.column("w"), pa.array(upto - w), pa.array(np.full(len(w), part, np.int32))], ["code", "w", "before", "range"])
            before = float(upto[-1]) if len(upto) else before

    running = stored(sums.repartitionByRange("code").sortWithinPartitions("code").mapInArrow(summed, "code long, w double, before double, range int"))
    totals = running.groupBy("range").agg(F.sum("w").alias("total"))
    shifts = totals.select("range", F.coalesce(F.sum("total").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("shift"))
    whole = running.agg(F.sum("w")).first()[0] or 0.0
    middle = F.col("shift") + F.col("before") + F.col("w") / 2
    number = F.least(F.floor(middle * parts / F.lit(whole)).cast("int"), F.lit(parts - 1)) if whole else F.lit(0)
    firsts = running.join(F.broadcast(shifts), "range").groupBy(number.alias("part")).agg(F.min("code").alias("first")).where("part > 0").collect()
    removed(running)
    known, splits, last = {r["part"]: r["first"] for r in firsts}, [], None
    for part in range(parts - 1, 0, -1):  # a part without a code begins where the next one does
        last = known.get(part, last)
        splits.append(last if last is not None else np.iinfo(np.int64).max)
    return splits[::-1]


def part_of(coded: DataFrame, splits: list[int], code: str = "morton", name: str = "part") -> DataFrame:
    """`coded` with the part that each code belongs to: how many splits are at or before it. NULL for a null code."""
    if not splits:
        return coded.withColumn(name, F.when(F.col(code).isNotNull(), 0))
    known, step = F.array(*(F.lit(int(x)).cast("long") for x in splits)), len(splits)
    # a binary search over the splits, in columns
    halvings = F.sequence(F.lit(1), F.lit(max(1, step.bit_length())))
    low_high = F.struct(F.lit(0).alias("low"), F.lit(step).alias("high"))

    def narrower(s: Column, _: Column) -> Column:
        middle = F.floor((s.low + s.high) / 2).cast("int")
        here = (s.low < s.high) & (F.get(known, middle) <= F.col(code))
        return F.struct(F.when(here, middle + 1).otherwise(s.low).alias("low"), F.when((s.low < s.high) & ~here, middle).otherwise(s.high).alias("high"))

    return coded.withColumn(name, F.when(F.col(code).isNotNull(), F.aggregate(halvings, low_high, narrower).low))


def dealt_evenly(points: DataFrame, parts: int, weight: Column | str = "weight", bits: int = 16) -> DataFrame:
    """`points` (x, y, z and more) with their Morton code and the part of even weight they belong to."""
    coded = curve_codes(points, bits)
    return part_of(coded, even_splits(coded, parts, weight))
