"""Near-duplicate embeddings by PCA-ordered tiled comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from meshweave.llm.common import components, stored

#: The leading dimensions that each step adds to the partial dot products.
STEPS = (24, 40)
#: Allowance for the rounding of rotated partial sums; what lies within it is decided on the vectors themselves.
SLACK = 1e-9


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows in double precision over their length, scaled first so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotation(units: np.ndarray) -> np.ndarray:
    """Principal axes as columns, the largest variance first."""
    values, axes = np.linalg.eigh(units.T @ units)
    return axes[:, np.argsort(-values)]


def linked(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) at which the unit rows of a and b have a cosine of at least `threshold`; ra, rb: the same, rotated.

    Dot products are summed over the leading axes first. What the other axes can add is at most the product of the
    suffix norms (Cauchy-Schwarz), so pairs whose sum and bound stay below the threshold stop there.
    """
    at, dims = 0, ra.shape[1]
    i = j = None
    for stop in [s for s in STEPS if s < dims] + [dims]:
        sa, sb = (np.sqrt((r[:, stop:] ** 2).sum(axis=1)) for r in (ra, rb))
        if i is None:
            part = ra[:, :stop] @ rb[:, :stop].T
            i, j = np.nonzero(part + sa[:, None] * sb[None, :] >= threshold - SLACK)
            part = part[i, j]
        else:
            part = part + np.einsum("ij,ij->i", ra[i, at:stop], rb[j, at:stop])
            live = part + sa[i] * sb[j] >= threshold - SLACK
            i, j, part = i[live], j[live], part[live]
        at = stop
    sure = np.einsum("ij,ij->i", a[i], b[j]) >= threshold
    return i[sure], j[sure]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among n places."""
    parent, kept = list(range(n)), []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        a, b = x, y
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append((x, y))
    return kept


def near_vectors(rows: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label", tile: int = 1024, fit_rows: int = 4096) -> DataFrame:
    """(key, n_links, component_id, kept) of every row; rows link if labels are equal and not null and the cosine, in
    double precision, is at least `threshold`.

    Null, empty and zero vectors and those with null or non-finite components link with nothing. Equal vectors of a
    label are one class with a count from the start, so a group of copies adds no comparisons. The classes of a label
    are ordered along the leading principal axis and cut into tiles of `tile`; every pair of tiles is one task's work,
    unless the ranges along that axis alone rule a link out. The axes are fitted on the `fit_rows` rows of the smallest
    hashes (they change no result, only how soon comparisons stop). A pair of tiles yields the number of links of each
    class and a spanning forest, never all pairs. Vectors of unequal length do not link. Repeated keys count as rows
    of their own, and share what links them; rows of a null key link with nothing and have a null component.
    component_id is the smallest key reachable, kept tells whether it is the row's own. Keys of any type that has an
    order will do: those that are no integers are numbered in their order first.
    """
    if isinstance(rows.schema[key].dataType, IntegralType):
        return of_numbers(rows, threshold, key, vector, label, tile, fit_rows)
    names = rows.select(F.col(key).alias("name")).where("name is not null").distinct().repartitionByRange("name").sortWithinPartitions("name")
    names = stored(names.withColumn("number", F.monotonically_increasing_id()))
    plain = rows.select(F.col(key).alias("name"), F.col(vector).alias("v"), F.col(label).alias("label")).join(names, "name", "left").select("number", "v", "label")
    made = of_numbers(plain, threshold, "number", "v", "label", tile, fit_rows)
    made = made.join(names.withColumnRenamed("name", key), "number", "left").join(names.select(F.col("name"), F.col("number").alias("component_id")), "component_id", "left")
    return made.select(key, "n_links", F.col("name").alias("component_id"), "kept")


def of_numbers(rows: DataFrame, threshold: float, key: str, vector: str, label: str, tile: int, fit_rows: int) -> DataFrame:
    """near_vectors() for keys that are integers."""
    good = F.col("v").isNotNull() & (F.size("v") > 0) & F.col("label").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    base = stored(rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("label")).withColumn("good", F.coalesce(good, F.lit(False))).withColumn("v", F.when(F.col("good"), F.transform("v", lambda x: x + F.lit(0.0)))).withColumn("class", F.when(F.col("good"), F.sha2(F.to_json(F.struct("label", "v")), 256))))
    usable = base.where("good").where(F.col("key").isNotNull())
    classes = usable.groupBy("class").agg(F.min("key").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v")).withColumn("d", F.size("v"))
    sample = classes.select("v", "d").orderBy(F.xxhash64("class")).limit(fit_rows).toPandas()
    axes = {int(d): rotation(unit_rows(np.stack(g.v.to_list()))) for d, g in sample.groupby("d")}

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            if batch.num_rows:
                sizes = batch.column("d").to_numpy()
                for d in np.unique(sizes):
                    mine = np.flatnonzero(sizes == d)
                    x = np.stack([np.asarray(v) for v in batch.column("v").take(pa.array(mine)).to_numpy(zero_copy_only=False)])
                    if int(d) in axes:
                        out[mine] = unit_rows(x) @ axes[int(d)][:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "lead"])

    kind, by = base.schema["key"].dataType.simpleString(), base.schema["label"].dataType.simpleString()
    led = stored(classes.select("rep", "n", "label", "v", "d").mapInArrow(lead, f"rep {kind}, n long, label {by}, v array<double>, d int, lead double"))
    # tiles: places along the leading axis, by label, without a sort of a whole label in one task
    spans = led.groupBy("label", "d").agg(F.count("*").alias("all"), F.percentile_approx("lead", [i / 256 for i in range(1, 256)], 10_000).alias("cuts"))
    wanted = F.greatest(F.lit(1), F.ceil(F.col("all") / tile)).cast("int")
    place = F.size(F.filter("cuts", lambda c: c < F.col("lead")))
    coarse = led.join(F.broadcast(spans), ["label", "d"]).withColumn("tiles", F.when(F.col("all") <= tile, 1).otherwise(wanted))
    cell = F.when(F.col("tiles") == 1, 0).otherwise(F.call_function("div", place * F.least("tiles", F.lit(256)), F.lit(256)))
    sub = F.when(F.col("tiles") <= 256, 0).otherwise(F.pmod(F.xxhash64("rep"), F.ceil(F.col("tiles") / 256).cast("int")))
    tiled = stored(coarse.withColumn("tile", (cell * 1_000_000 + sub).cast("long")).drop("cuts", "all", "tiles"))
    ranges = tiled.groupBy("label", "d", "tile").agg(F.min("lead").alias("low"), F.max("lead").alias("high"))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    a, b = (ranges.select("label", "d", *(F.col(c).alias(f"{c}{s}") for c in ("tile", "low", "high"))) for s in "ab")
    pairs = stored(a.join(b, ["label", "d"]).where((F.col("tilea") <= F.col("tileb")) & (F.col("lowb") <= F.col("higha") + reach) & (F.col("lowa") <= F.col("highb") + reach)).select("label", "d", "tilea", "tileb"))
    left = pairs.withColumn("tile", F.col("tilea")).withColumn("side", F.lit(0))
    right = pairs.where("tilea < tileb").withColumn("tile", F.col("tileb")).withColumn("side", F.lit(1))
    work = left.unionByName(right).join(tiled, ["label", "d", "tile"]).select("label", "d", "tilea", "tileb", "side", "rep", "n", "v")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        own, other = group[group.side == 0], group[group.side == 1]
        same = other.empty and group.tilea.iat[0] == group.tileb.iat[0]
        if same:
            other = own
        found = []
        turn = axes.get(int(group.d.iat[0]), np.eye(int(group.d.iat[0])))
        step = 2 * tile
        for p in range(0, len(own), step):
            for q in range(p if same else 0, len(other), step):
                x, y = own.iloc[p : p + step], other.iloc[q : q + step]
                ux, uy = (unit_rows(np.stack(z.v.to_list())) for z in (x, y))
                i, j = linked(ux, uy, ux @ turn, uy @ turn, threshold)
                if same and p == q:
                    i, j = i[i < j], j[i < j]
                nx, ny = x.n.to_numpy(), y.n.to_numpy()
                kx, ky = x.rep.to_numpy(), y.rep.to_numpy()
                links = pd.concat([pd.DataFrame({"u": kx, "n": np.bincount(i, ny[j], len(x)).astype("int64")}), pd.DataFrame({"u": ky, "n": np.bincount(j, nx[i], len(y)).astype("int64")})])
                tree = forest(len(x) + len(y), i, j + (0 if same and p == q else len(x)))
                keys = kx if same and p == q else np.concatenate([kx, ky])
                found += [links[links.n > 0].assign(v=pd.NA), pd.DataFrame({"u": [keys[s] for s, _ in tree], "n": 0, "v": [keys[t] for _, t in tree]})]
        made = pd.concat(found) if found else pd.DataFrame({"u": [], "n": [], "v": []})
        return made.astype({"u": group.rep.dtype, "n": "int64", "v": "Int64"})[["u", "n", "v"]]

    made = stored(work.groupBy("label", "d", "tilea", "tileb").applyInPandas(compare, f"u {kind}, n long, v {kind}"))
    counts = made.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("links"))
    linked_to = components(made.where("v is not null").select("u", "v")).select(F.col("node").alias("rep"), "component")
    whole = stored(usable.groupBy("class").agg(F.min("key").alias("rep"), F.count("*").alias("n")).join(counts, "rep", "left").join(linked_to, "rep", "left").select("class", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component")))
    keyed = base.withColumn("class", F.when(F.col("key").isNotNull(), F.col("class")))
    return keyed.join(whole, "class", "left").select(F.col("key").alias(key), F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component", "key").alias("component_id"), F.coalesce(F.coalesce("component", "key") == F.col("key"), F.lit(True)).alias("kept"))
