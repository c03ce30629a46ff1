"""Exact k nearest neighbours over a pyramid of grids."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshweave.operators.candidates import AXES
from meshweave.plans.durable import dealt, removed, stored

#: Buckets of more points than this (and than 4 k) are opened into their halves before their points are compared.
FULL = 512
#: Times that the finest step is halved at most, in search of one at which no bucket is full.
HALVINGS = 30
#: Queries of a cell that are compared by one task, and distances that it holds at once.
TOGETHER, MATRIX = 4096, 1 << 20


def bucket(x: Column, low: float, step: float) -> Column:
    return F.floor((x - F.lit(low)) / F.lit(step)).cast("long")


def nearest(queries: DataFrame, points: DataFrame, k: int, axes: tuple[str, ...] = AXES) -> DataFrame:
    """(q_gnum, qx.., p_gnum, px.., dist2, rank): the k of `points` nearest to each query, ties by smaller p_gnum.

    The points are counted in buckets of a pyramid of grids, each with the box of its points. Queries in one bucket of
    the finest grid are a cell, with a box of their own, and look for buckets together, so what is exchanged grows with
    the cells. A cell finds the finest level at which its own bucket holds k points; the farthest corners of both boxes
    bound the k-th distance of all its queries. It then takes the buckets that come so near, at a level at which these
    are few, and opens those that are full into the next finer ones. After each step buckets are dropped that are
    farther away than the nearest ones that hold k points together, so neither a dense cluster nor a far query meets
    more points than it has to. Points are compared only in the buckets that are left, by tasks of at most about
    TOGETHER queries of a cell. Of points at one place more than k are never needed; where buckets are full, the others
    are dropped first.
    """
    own = queries.select(F.col("gnum").alias("q_gnum"), *(F.col(a).cast("double").alias(f"q{a}") for a in axes))
    other = points.select(F.col("gnum").alias("p_gnum"), *(F.col(a).cast("double").alias(f"p{a}") for a in axes))
    row = other.agg(F.count("*").alias("n"), *(f(f"p{a}").alias(f"{n}{a}") for a in axes for n, f in (("low", F.min), ("high", F.max)))).first()
    if not row["n"]:
        return own.join(other, F.lit(False)).withColumn("dist2", F.lit(0.0)).withColumn("rank", F.lit(0))
    low, high = {a: row[f"low{a}"] for a in axes}, {a: row[f"high{a}"] for a in axes}
    wide = [high[a] - low[a] for a in axes if high[a] > low[a]]
    full, extent = max(FULL, 4 * k), max(wide, default=1.0)
    base = max((reduce(lambda p, q: p * q, wide, 1.0) * k / row["n"]) ** (1 / len(wide)), extent * 2.0**-30) if wide else 1.0
    keys, boxes = [f"b_{a}" for a in axes], [f"{e}{a}" for a in axes for e in ("low", "high")]
    copies = False
    while True:
        placed = other.withColumns({f"b_{a}": bucket(F.col(f"p{a}"), low[a], base) for a in axes})
        finest = stored(placed.groupBy(*keys).agg(F.count("*").alias("n"), *(f(f"p{a}").alias(f"{n}{a}") for a in axes for n, f in (("low", F.min), ("high", F.max)))))
        crowd = finest.agg(F.max("n")).first()[0]
        if crowd <= full or base <= extent * 2.0**-HALVINGS:
            break
        removed(finest)
        if not copies:
            copies = True
            place = Window.partitionBy(*(f"p{a}" for a in axes)).orderBy("p_gnum")
            other = stored(other.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).drop("rank"))
        else:
            base = max(base / 8, extent * 2.0**-HALVINGS)
    top = max(0, math.floor(math.log2(extent / base)) + 1)
    levels = F.array(*map(F.lit, range(top + 1)))
    at = lambda level: {f"b_{a}": F.expr(f"shiftright(b_{a}, {level})") for a in axes}
    merged = [f(F.col(b)).alias(b) for b in boxes for f in ((F.min,) if b.startswith("low") else (F.max,))]
    counts = stored(finest.withColumn("level", F.explode(levels)).withColumns(at("level")).groupBy("level", *keys).agg(F.sum("n").alias("n"), *merged))
    # queries of one bucket of the finest grid, which goes on beyond the points, are a cell
    own_cell = F.struct(*(bucket(F.col(f"q{a}"), low[a], base).alias(a) for a in axes)).alias("cell")
    ends = [f"{e}q{a}" for a in axes for e in ("l", "h")]
    known = reduce(lambda p, q: p & q, (F.col(f"q{a}").isNotNull() & ~F.isnan(f"q{a}") for a in axes))
    cells = own.where(known).groupBy(own_cell).agg(F.count(F.lit(1)).alias("queries"), *(f(f"q{a}").alias(f"{e}q{a}") for a in axes for e, f in (("l", F.min), ("h", F.max))))
    cells = stored(cells)

    def far(near: bool) -> Column:
        """Squared distance from any query of a cell to the nearest, or to the farthest, point of a bucket's box."""
        parts = []
        for a in axes:
            q0, q1, lo, hi = F.col(f"lq{a}"), F.col(f"hq{a}"), F.col(f"low{a}"), F.col(f"high{a}")
            gap = F.greatest(lo - q1, q0 - hi, F.lit(0.0)) if near else F.greatest(hi - q0, q1 - lo)
            parts.append(gap * gap)
        return reduce(lambda p, q: p + q, parts)

    def pruned(pairs: DataFrame) -> DataFrame:
        """Only the buckets that can hold one of the k nearest."""
        some = pairs.withColumns({"near2": far(True), "far2": far(False)})
        so_far = Window.partitionBy("cell").orderBy("far2").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        enough = some.withColumn("held", F.sum("n").over(so_far)).withColumn("bound", F.min(F.when(F.col("held") >= k, F.col("far2"))).over(Window.partitionBy("cell")))
        return enough.where(F.col("bound").isNull() | (F.col("near2") <= F.col("bound") * (1 + 1e-12))).drop("near2", "far2", "held", "bound")

    within = lambda c, a: F.least(F.greatest(F.col(c), F.lit(low[a])), F.lit(high[a]))
    asked = cells.withColumns({f"b_{a}": bucket(within(f"lq{a}", a), low[a], base) for a in axes}).withColumn("level", F.explode(levels)).withColumns(at("level"))
    chosen = asked.join(counts.where((F.col("n") >= k) | (F.col("level") == top)), ["level", *keys]).withColumn("far2", far(False))
    start = chosen.groupBy("cell", *ends).agg(F.min(F.struct("level", "far2")).alias("s"))
    radius = F.sqrt("s.far2") * (1 + 1e-12)
    start = start.withColumn("r", radius).withColumn("level", F.least(F.lit(top), F.greatest(F.col("s.level"), F.ceil(F.log2(F.greatest(F.col("r"), F.lit(1e-300)) / base)).cast("int")))).drop("s")
    step = F.pow(F.lit(2.0), F.col("level")) * base
    around = start
    for a in axes:
        last = F.floor(F.lit(high[a] - low[a]) / step)
        index = [F.least(F.greatest(F.floor((F.col(f"{e}q{a}") + s * F.col("r") - low[a]) / step), F.lit(0)), last).cast("long") for e, s in (("l", -1), ("h", 1))]
        around = around.withColumn(f"b_{a}", F.explode(F.sequence(*index)))
    pairs = stored(pruned(around.join(counts, ["level", *keys]).drop("r")))
    finer = counts.where(F.col("level") < top).withColumnsRenamed({b: f"c_{b}" for b in keys}).withColumn("level", F.col("level") + 1).withColumns({b: F.shiftright(f"c_{b}", 1) for b in keys})
    open_ = (F.col("n") > full) & (F.col("level") > 0)
    while True:
        used = {r["level"]: r["n"] for r in pairs.groupBy("level").agg(F.max("n").alias("n")).collect()}  # at most one row a level
        if not any(level > 0 and n > full for level, n in used.items()):
            break
        opened = pairs.where(open_).drop("n", *boxes).join(finer, ["level", *keys]).drop(*keys).withColumnsRenamed({f"c_{b}": b for b in keys}).withColumn("level", F.col("level") - 1)
        left = stored(pruned(pairs.where(~open_).unionByName(opened)))
        removed(pairs)
        pairs = left
    buckets = other.withColumns({f"b_{a}": bucket(F.col(f"p{a}"), low[a], base) for a in axes}).withColumn("level", F.explode(F.array(*map(F.lit, sorted(used) or [0])))).withColumns(at("level"))
    shares = F.ceil(F.col("queries") / TOGETHER).cast("int")
    shared = cells.select("cell", shares.alias("shares"))
    met = pairs.select("cell", "level", *keys).join(dealt(shared), "cell").join(dealt(buckets), ["level", *keys])
    met = met.select("cell", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "p_gnum", *(f"p{a}" for a in axes))
    ask = own.where(known).withColumn("cell", own_cell).join(dealt(shared), "cell").select("cell", F.pmod(F.xxhash64("q_gnum"), F.col("shares")).cast("int").alias("share"), "q_gnum", *(f"q{a}" for a in axes))
    names = ["q_gnum", *(f"q{a}" for a in axes), "p_gnum", *(f"p{a}" for a in axes), "dist2", "rank"]
    types = {f.name: f.dataType.simpleString() for x in (own, other) for f in x.schema} | {"dist2": "double", "rank": "int"}

    def best(asks: pa.Table, there: pa.Table) -> pa.Table:
        q, p, d2, rank = k_least(*(np.stack([t.column(f"{e}{a}").to_numpy() for a in axes], axis=1) for t, e in ((asks, "q"), (there, "p"))), pc.rank(there.column("p_gnum")).to_numpy() if there.num_rows else np.empty(0), k)
        left, right = asks.take(pa.array(q)), there.take(pa.array(p))
        columns = [*(left.column(n) for n in names if n[0] == "q"), *(right.column(n) for n in names if n[0] == "p"), pa.array(d2), pa.array(rank)]
        return pa.table(columns, names)

    return ask.groupBy("cell", "share").cogroup(met.groupBy("cell", "share")).applyInArrow(best, ", ".join(f"{n} {types[n]}" for n in names))


def k_least(q: np.ndarray, p: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(places in `q`, places in `p`, squared distances, ranks from 1): of each of `q` (n, axes) the k nearest of `p`
    (m, axes), ties by `order` (m)."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int32))]
    by = np.argsort(order, kind="stable")
    some, width = p[by], min(k, len(p))
    rows = max(1, MATRIX // max(1, len(p)))
    for at in range(0, len(q) if width else 0, rows):
        mine = q[at : at + rows]
        d2 = np.zeros((len(mine), len(some)))
        for a in range(q.shape[1]):
            d2 += (mine[:, a, None] - some[None, :, a]) ** 2
        limit = np.partition(d2, width - 1, axis=1)[:, width - 1]
        row, place = np.nonzero(d2 <= limit[:, None])  # of one row in the order of the ties
        near = d2[row, place]
        sort = np.lexsort([near, row])
        row, place, near = row[sort], place[sort], near[sort]
        rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
        kept = rank <= width
        found.append((row[kept] + at, by[place[kept]], near[kept], rank[kept].astype(np.int32)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def nearest_sources(targets: DataFrame, sources: DataFrame, k: int = 4, axes: tuple[str, ...] = AXES) -> DataFrame:
    """A mapping of every target to its k nearest sources."""
    made = nearest(targets, sources, k, axes)
    return made.select(F.col("q_gnum").alias("tgt_gnum"), F.col("p_gnum").alias("src_gnum"), "dist2", "rank", *(F.col(f"q{a}").alias(f"t{a}") for a in axes), *(F.col(f"p{a}").alias(f"s{a}") for a in axes))


def nearest_targets(targets: DataFrame, sources: DataFrame, k: int = 4, axes: tuple[str, ...] = AXES) -> DataFrame:
    """The reverse: every source picks its k nearest targets, so a target has any number of sources."""
    made = nearest(sources, targets, k, axes)
    return made.select(F.col("p_gnum").alias("tgt_gnum"), F.col("q_gnum").alias("src_gnum"), "dist2", "rank", *(F.col(f"p{a}").alias(f"t{a}") for a in axes), *(F.col(f"q{a}").alias(f"s{a}") for a in axes))
