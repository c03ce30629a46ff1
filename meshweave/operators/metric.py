"""Exact nearest neighbours among vectors of any number of dimensions, by pivots and the triangle inequality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshweave.plans.durable import removed, stored

#: Vectors that stand for cells, and rows of a tile at least.
PIVOTS, BLOCK = 64, 1024
#: Tiles that a table is cut into where their size allows it, and numbers that a tile holds at most (but BLOCK rows always).
TILES, NUMBERS = 24, 1 << 21
#: Products and distances that a task holds at once; candidates a query, as a multiple of those wanted, from which on the
#: products are searched for the best first.
MATRIX, VERIFIED, MANY = 1 << 22, 1 << 16, 16
#: Rounding of a distance, as a share of it, that bounds allow for.
SLACK = 1e-9


def distances(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((vectors - q) ** 2).sum(axis=1))


def vectors_of(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    column = table.column("v")
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)


def best_of(q: np.ndarray, reach: np.ndarray, v: np.ndarray, ids: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in `q`, places in `v`, distances): of each of `q` the `wanted` of `v` at the least distance, of at most its
    `reach`; of equal distances the smaller of `ids` comes first.

    |a - b| <= r where a.b - b.b / 2 >= (a.a - r r) / 2: products in single precision, about the first of `v`, leave out
    what their rounding (a bound by the lengths) cannot bring within reach. Distances in double precision decide.
    """
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    with np.errstate(over="ignore", invalid="ignore"):
        a, b = q - v[0], v - v[0]
        scale = np.sqrt(max((a * a).sum(axis=1).max(), (b * b).sum(axis=1).max()))
    plain = not np.isfinite(scale)  # too large for products
    if plain:
        a, b = np.zeros_like(a), np.zeros_like(b)
    scale = 1.0 if plain or scale == 0 else scale
    a, b, r = a / scale, b / scale, reach / scale
    a2, half = (a * a).sum(axis=1), (b * b).sum(axis=1) / 2
    slack = (q.shape[1] + 16) * 2.0**-24 * (np.sqrt(a2 * 2 * half.max()) + half.max()) + 1e-14
    least = (a2 - r * r) / 2 - slack
    left, right = (np.concatenate(x, axis=1).astype(np.float32) for x in ((a, np.ones((len(a), 1))), (b, -half[:, None])))
    rows = max(1, MATRIX // len(v))
    for at in range(0, len(q), rows):
        mine = slice(at, min(at + rows, len(q)))
        if plain:
            places = np.arange((mine.stop - at) * len(v))
        else:
            product = left[mine] @ right.T
            within = lambda low: np.flatnonzero(product >= np.nextafter(low.astype(np.float32), np.float32(-np.inf))[:, None])  # noqa: B023, E731
            places = within(least[mine])
            if len(places) > MANY * wanted * len(product) and len(v) > wanted:
                kth = np.partition(product, len(v) - wanted, axis=1)[:, len(v) - wanted]
                places = within(np.maximum(least[mine], kth - 2 * slack[mine]))
        row, place = np.divmod(places, len(v))
        row += at
        d = np.concatenate([distances(v[place[k : k + VERIFIED]], q[row[k : k + VERIFIED]]) for k in range(0, max(1, len(row)), VERIFIED)])
        near = d <= reach[row]
        row, place, d = row[near], place[near], d[near]
        sort = np.lexsort([ids[place], d, row])
        row, place, d = row[sort], place[sort], d[sort]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < wanted
        found.append((row[kept], place[kept], d[kept]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def knn(queries: DataFrame, data: DataFrame, k: int = 4, key: str = "gnum", vector: str = "v", others: bool = False, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(q_gnum, gnum, rank, dist): of each query (key, vector) the `k` rows of `data` (key, vector) at the least Euclidean
    distance, ranked from 1; of equal distances the smaller key comes first. With `others`, a row of the query's own
    key is no neighbour. Fewer than `k` where `data` has fewer. Rows without a vector, or with null or not finite
    numbers in it, take no part; vectors have one length, else ValueError. Keys are whole numbers, one row each.

    Of equal vectors of `data` only those that can be among the `k` are kept. At most `pivots` vectors, of the smallest
    hashes, are all that the driver sees. A vector belongs to the cell of its nearest pivot, and a cell is cut into rings
    by the distance to it: blocks of at least about `block` vectors, larger ones in larger tables. Queries are dealt to
    tiles by the block in which they lie and compared with it first, which bounds how far their neighbours are. By the
    triangle inequality, a tile does not meet a ring whose distances from the pivot all differ by more than that from
    its queries' own, nor a cell that lies as far beyond the plane between two pivots. What is left is compared block by
    block, by matrix products (best_of); each gives a query's `k` best. The pivots decide how much is compared, never the
    result. Where they exclude nothing, as among vectors that all lie equally far apart, all pairs are compared, and a row
    travels once for each of the other side's tiles.
    """
    wanted = k + int(others)
    single = all(dict(df.dtypes)[vector] == "array<float>" for df in (queries, data))
    kind = "array<float>" if single else "array<double>"
    good = lambda df: df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(F.col(vector).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))).select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("v"))
    same = Window.partitionBy(F.xxhash64("v"), "v").orderBy("id")
    rows = stored(good(data).withColumn("place", F.row_number().over(same)).where(F.col("place") <= wanted).drop("place"))
    asked = stored(good(queries))
    sizes = {r[0] for x in (rows, asked) for r in x.select(F.size("v")).distinct().limit(2).collect()}
    if len(sizes) > 1:
        raise ValueError("the vectors have different lengths")
    n = rows.count()
    if not n:
        return asked.select(F.col("id").alias("q_gnum"), F.lit(0).cast("long").alias("gnum"), F.lit(1).alias("rank"), F.lit(0.0).alias("dist")).limit(0)
    tile = max(block, min(max(BLOCK, NUMBERS // sizes.pop()), -(-n // TILES)))
    chosen = [r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(min(pivots, -(-n // tile))).select("v").collect()]
    known = rows.sparkSession.sparkContext.broadcast(np.array(chosen, np.float64))

    def to_pivots(batch: pa.RecordBatch) -> np.ndarray:
        v = vectors_of(batch) if batch.num_rows else None
        return np.stack([distances(v, p) for p in known.value], axis=1) if batch.num_rows else np.empty((0, len(known.value)))

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = to_pivots(batch)
            cell = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(far)), cell])], ["id", "v", "cell", "far"])

    held = stored(rows.mapInArrow(celled, f"id long, v {kind}, cell int, far double"))
    counts = held.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("far", [i / 256 for i in range(1, 256)], 10_000).alias("cuts"))
    # at most 256 rings by distance; more blocks of a ring are dealt by hash
    rings = F.least(F.lit(256), F.ceil(F.col("n") / tile)).cast("int")
    at = F.floor(F.size(F.filter("cuts", lambda c: c < F.col("far"))) * rings / 256).cast("int")
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / (tile * 256))).cast("long")
    number = ((F.col("cell") * 256 + at).cast("long") * (1 << 32) + F.pmod(F.xxhash64("id"), parts)).alias("block")
    placed = stored(held.join(F.broadcast(counts), "cell").select("id", "v", "cell", "far", number))
    blocks = stored(placed.groupBy("cell", "block").agg(F.min("far").alias("low"), F.max("far").alias("high")))

    # the block whose ring holds the query's own distance, or the one nearest to it
    gap = lambda b: F.greatest(b.low - F.col("far"), F.col("far") - b.high, F.lit(0.0))
    rings_of = blocks.groupBy("cell").agg(F.collect_list(F.struct("low", "high", "block")).alias("b"))
    nearest_ring = F.array_min(F.transform("b", lambda b: F.struct(gap(b).alias("gap"), b.block.alias("block"))))["block"]
    started = stored(asked.mapInArrow(celled, f"id long, v {kind}, cell int, far double").join(F.broadcast(rings_of), "cell").select("id", "v", nearest_ring.alias("start")))
    shares = started.groupBy("start").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("shares"))
    own = started.join(F.broadcast(shares), "start").select("id", "v", "start", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int").alias("share"))

    def compared(asks: DataFrame, pairs: DataFrame) -> DataFrame:
        """For each of `asks` (id, v, reach, start, share) the `wanted` best, not beyond reach, of each block that `pairs`
        (start, share, block) names for its tile."""
        by = ["start", "share", "block"]

        def best(some: pa.Table, there: pa.Table) -> pa.Table:
            q, place, d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
            if some.num_rows and there.num_rows:
                q, place, d = best_of(vectors_of(some), some.column("reach").to_numpy(), vectors_of(there), there.column("id").to_numpy(), wanted)
            return pa.table([some.column("id").take(pa.array(q)), there.column("id").take(pa.array(place)), pa.array(d)], ["q_gnum", "gnum", "dist"])

        left = asks.join(pairs, ["start", "share"]).select("id", "v", "reach", *by)
        right = placed.select("id", "v", "block").join(pairs, "block").select("id", "v", *(F.col(c).alias(f"r_{c}") for c in by))
        return left.groupBy(*by).cogroup(right.groupBy(*(f"r_{c}" for c in by))).applyInArrow(best, "q_gnum long, gnum long, dist double")

    first = own.withColumn("reach", F.lit(float("inf")))
    tried = stored(compared(first, own.select("start", "share").distinct().withColumn("block", F.col("start"))))
    reach = tried.groupBy("q_gnum").agg(F.max("dist").alias("reach"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= wanted).select(F.col("q_gnum").alias("id"), "reach")
    bounded = stored(own.join(reach, "id", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))) * (1 + SLACK)))

    def cells_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distances from a cell's pivot within reach of a query."""
        for batch in batches:
            far, limit = to_pivots(batch), batch.column("reach").to_numpy()
            beyond = (far - far.min(axis=1, keepdims=True, initial=np.inf)) / 2
            query, cell = np.nonzero(beyond * (1 - SLACK) <= limit[:, None]) if batch.num_rows else (np.empty(0, int), np.empty(0, int))
            at, more = far[query, cell], limit[query] + SLACK * far[query, cell]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(query)) for c in ("start", "share")), pa.array(cell.astype(np.int32)), pa.array(at - more), pa.array(at + more)], ["start", "share", "cell", "least", "most"])

    near = bounded.mapInArrow(cells_near, "start long, share int, cell int, least double, most double").groupBy("start", "share", "cell").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    rest = stored(near.join(blocks, "cell").where((F.col("low") <= F.col("most")) & (F.col("high") >= F.col("least")) & (F.col("block") != F.col("start"))).select("start", "share", "block"))
    made = tried.unionByName(compared(bounded, rest))
    if others:
        made = made.where("q_gnum <> gnum")
    ranked = made.withColumn("rank", F.row_number().over(Window.partitionBy("q_gnum").orderBy("dist", "gnum"))).where(F.col("rank") <= k)
    result = stored(ranked.select("q_gnum", "gnum", "rank", "dist"))
    for table in (rows, asked, held, placed, blocks, started, tried, bounded, rest):
        removed(table)
    return result
