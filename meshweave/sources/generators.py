"""Mesh generators on spark.range."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def grid_vertices(spark: SparkSession, nx: int, ny: int, low: tuple[float, float] = (0.0, 0.0), high: tuple[float, float] = (1.0, 1.0), jitter: float = 0.0, seed: int = 0) -> DataFrame:
    """(gnum, x, y, z): gnum = j * (nx + 1) + i; inner vertices move by up to `jitter` cell sizes, by a hash of their number."""
    i, j = F.col("id") % (nx + 1), F.expr(f"id div {nx + 1}")
    inner = (i > 0) & (i < nx) & (j > 0) & (j < ny)

    def at(k: Column, n: int, a: int) -> Column:
        size = (high[a] - low[a]) / n
        moved = (F.pmod(F.xxhash64(F.lit(seed), F.lit(a), "id"), F.lit(2_000_001)) / 1_000_000 - 1) * jitter * size
        plain = F.lit(low[a]) + k * F.lit(high[a] - low[a]) / n
        return F.when(inner, plain + moved).otherwise(plain) if jitter else plain

    return spark.range((nx + 1) * (ny + 1)).select(F.col("id").alias("gnum"), at(i, nx, 0).alias("x"), at(j, ny, 1).alias("y"), F.lit(0.0).alias("z"))


def grid_quads(spark: SparkSession, nx: int, ny: int) -> DataFrame:
    """(gnum, elt_type, connec): cell j * nx + i, counter-clockwise from its lower left corner."""
    i, j = F.col("id") % nx, F.expr(f"id div {nx}")
    corner = j * (nx + 1) + i
    return spark.range(nx * ny).select(F.col("id").alias("gnum"), F.lit("quad4").alias("elt_type"), F.array(corner, corner + 1, corner + nx + 2, corner + nx + 1).alias("connec"))


def grid_triangles(spark: SparkSession, nx: int, ny: int) -> DataFrame:
    """Each quad of the grid as triangles 2c (below the diagonal from lower right to upper left) and 2c + 1."""
    c = F.expr("id div 2")
    i, j = c % nx, F.expr(f"(id div 2) div {nx}")
    a = j * (nx + 1) + i
    below, above = F.array(a, a + 1, a + nx + 1), F.array(a + 1, a + nx + 2, a + nx + 1)
    return spark.range(2 * nx * ny).select(F.col("id").alias("gnum"), F.lit("tria3").alias("elt_type"), F.when(F.col("id") % 2 == 0, below).otherwise(above).alias("connec"))


def box_vertices(spark: SparkSession, n: int, size: float = 1.0) -> DataFrame:
    k = n + 1
    return spark.range(k**3).select(F.col("id").alias("gnum"), (F.col("id") % k * size / n).alias("x"), (F.expr(f"(id div {k}) % {k}") * size / n).alias("y"), (F.expr(f"id div {k * k}") * size / n).alias("z"))


def box_hexas(spark: SparkSession, n: int) -> DataFrame:
    k = n + 1
    a = F.expr(f"(id div {n * n}) * {k * k} + ((id div {n}) % {n}) * {k} + id % {n}")
    return spark.range(n**3).select(F.col("id").alias("gnum"), F.lit("hexa8").alias("elt_type"), F.array(*(a + d for d in (0, 1, k + 1, k, k * k, k * k + 1, k * k + k + 1, k * k + k))).alias("connec"))


def moved(vertices: DataFrame, amount: float, size: float = 1.0) -> DataFrame:
    """Vertices of the box of edge `size` moved within it by up to `amount` of the edge, smoothly; the border stays in place."""
    x, y, z = (F.col(a) / size for a in "xyz")
    bump = F.lit(64.0 * amount * size) * x * (1 - x) * y * (1 - y) * z * (1 - z)
    return vertices.withColumns({"x": F.col("x") + bump * F.sin(5 * y), "y": F.col("y") + bump * F.cos(4 * z), "z": F.col("z") + bump * F.sin(3 * x)})


def box_prisms(spark: SparkSession, n: int) -> DataFrame:
    """Two prisms for each hexahedron, cut along the diagonals of its lower and upper face."""
    return pieces_of_hexas(spark, n, "prism6", ((0, 1, 2, 4, 5, 6), (0, 2, 3, 4, 6, 7)))


def box_pyramids(spark: SparkSession, vertices: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(vertices with the centre of each hexahedron, six pyramids for each): bases are its faces, seen from the centre."""
    hexas, first = box_hexas(spark, n), (n + 1) ** 3
    corner = hexas.select("gnum", F.explode("connec").alias("v")).join(vertices.withColumnRenamed("gnum", "v"), "v")
    centres = corner.groupBy((F.col("gnum") + first).alias("gnum")).agg(*(F.avg(a).alias(a) for a in "xyz"))
    #: The faces of a hexahedron, turned to its inside.
    bases = ((0, 1, 2, 3), (7, 6, 5, 4), (4, 5, 1, 0), (5, 6, 2, 1), (6, 7, 3, 2), (7, 4, 0, 3))
    rows = F.posexplode(F.array(*(F.array(*(F.col("connec")[i] for i in b), F.col("gnum") + first) for b in bases)))
    made = hexas.select("gnum", rows.alias("k", "c")).select((F.col("gnum") * 6 + F.col("k")).alias("gnum"), F.lit("pyram5").alias("elt_type"), F.col("c").alias("connec"))
    return vertices.unionByName(centres), made


def pieces_of_hexas(spark: SparkSession, n: int, kind: str, parts: tuple[tuple[int, ...], ...]) -> DataFrame:
    rows = F.posexplode(F.array(*(F.array(*(F.col("connec")[i] for i in p)) for p in parts)))
    return box_hexas(spark, n).select("gnum", rows.alias("k", "c")).select((F.col("gnum") * len(parts) + F.col("k")).alias("gnum"), F.lit(kind).alias("elt_type"), F.col("c").alias("connec"))


def quadratic_triangles(spark: SparkSession, n: int) -> DataFrame:
    """Six-node triangles over grid_vertices(2 n, 2 n), two for each of n * n squares."""
    c, wide = F.expr("id div 2"), 2 * n + 1
    a = F.expr(f"(id div 2) div {n}") * (2 * wide) + (c % n) * 2
    below = F.array(*(a + d for d in (0, 1, 2, wide, wide + 1, 2 * wide)))
    above = F.array(*(a + 2 * wide + 2 - d for d in (0, 1, 2, wide, wide + 1, 2 * wide)))
    return spark.range(2 * n * n).select(F.col("id").alias("gnum"), F.lit("ho_tria").alias("elt_type"), F.lit(2).alias("order"), F.when(F.col("id") % 2 == 0, below).otherwise(above).alias("connec"))


def ball(spark: SparkSession, n: int, radius: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """A ball of hexahedra: the box [-1, 1]^3 whose shells become spheres."""
    box = box_vertices(spark, n, 2.0).withColumns({a: F.col(a) - 1 for a in "xyz"})
    r = F.greatest(*(F.abs(a) for a in "xyz"))
    length = F.sqrt(sum((F.col(a) * F.col(a) for a in "xyz"), F.lit(0.0)))
    scale = F.when(length > 0, r / length * radius).otherwise(0.0)
    return box.withColumns({a: F.col(a) * scale for a in "xyz"}), box_hexas(spark, n)


def n_gon(spark: SparkSession, sides: int, rings: int, radius: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """A regular polygon of `sides` corners in `rings` rings: triangles about the centre, quads outside."""
    ring, turn = F.expr(f"(id - 1) div {sides} + 1"), (F.col("id") - 1) % sides
    angle, r = turn * F.lit(2 * math.pi) / sides, F.when(F.col("id") == 0, 0.0).otherwise(ring * radius / rings)
    vertices = spark.range(sides * rings + 1).select(F.col("id").alias("gnum"), (r * F.cos(angle)).alias("x"), (r * F.sin(angle)).alias("y"), F.lit(0.0).alias("z"))
    i, j = F.expr(f"id div {sides}"), F.col("id") % sides
    at = lambda ring, k: 1 + (ring - 1) * sides + k
    right = (j + 1) % sides
    inner = F.array(F.lit(0).cast("long"), at(i + 1, j), at(i + 1, right))
    outer = F.array(at(i, j), at(i + 1, j), at(i + 1, right), at(i, right))
    return vertices, spark.range(sides * rings).select(F.col("id").alias("gnum"), F.when(i == 0, "tria3").otherwise("quad4").alias("elt_type"), F.when(i == 0, inner).otherwise(outer).alias("connec"))


def box_tetras(spark: SparkSession, n: int) -> DataFrame:
    """Six tetrahedra around the main diagonal of each hexahedron."""
    #: Places of a hexahedron's vertices.
    parts = ((0, 1, 2, 6), (0, 2, 3, 6), (0, 3, 7, 6), (0, 7, 4, 6), (0, 4, 5, 6), (0, 5, 1, 6))
    rows = F.posexplode(F.array(*(F.array(*(F.col("connec")[i] for i in p)) for p in parts)))
    return box_hexas(spark, n).select("gnum", rows.alias("k", "c")).select((F.col("gnum") * 6 + F.col("k")).alias("gnum"), F.lit("tetra4").alias("elt_type"), F.col("c").alias("connec"))


def disc(vertices: DataFrame) -> DataFrame:
    """The square [-1, 1]^2 onto the unit disc: each ring of the square becomes a circle."""
    r = F.greatest(F.abs("x"), F.abs("y"))
    length = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    scale = F.when(length > 0, r / length).otherwise(0.0)
    return vertices.withColumns({"x": F.col("x") * scale, "y": F.col("y") * scale})


def sphere_surface(spark: SparkSession, n: int, radius: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """n rings of 2n vertices between two poles; triangles at the poles, quads elsewhere."""
    around = 2 * n
    ring, turn = F.expr(f"(id - 1) div {around}"), (F.col("id") - 1) % around
    polar = (ring + 1) * F.lit(math.pi) / (n + 1)
    pole = (F.col("id") == 0) | (F.col("id") == n * around + 1)
    angle = turn * F.lit(2 * math.pi) / around
    vertices = spark.range(n * around + 2).select(
        F.col("id").alias("gnum"),
        F.when(pole, 0.0).otherwise(radius * F.sin(polar) * F.cos(angle)).alias("x"),
        F.when(pole, 0.0).otherwise(radius * F.sin(polar) * F.sin(angle)).alias("y"),
        F.when(F.col("id") == 0, radius).when(pole, -radius).otherwise(radius * F.cos(polar)).alias("z"),
    )
    i, j = F.expr(f"id div {around}"), F.col("id") % around
    right = (j + 1) % around
    at = lambda r, k: 1 + r * around + k
    top, bottom = F.array(F.lit(0).cast("long"), at(i, j), at(i, right)), F.array(at(i - 1, j), F.lit(n * around + 1).cast("long"), at(i - 1, right))
    body = F.array(at(i - 1, j), at(i, j), at(i, right), at(i - 1, right))
    connec = F.when(i == 0, top).when(i == n, bottom).otherwise(body)
    return vertices, spark.range((n + 1) * around).select(F.col("id").alias("gnum"), F.when((i == 0) | (i == n), "tria3").otherwise("quad4").alias("elt_type"), connec.alias("connec"))


def hexagons(spark: SparkSession, nx: int, ny: int, size: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """A sheet of regular hexagons; vertices are numbered by place, so neighbours share them."""
    cell = spark.range(nx * ny).select(F.col("id").alias("gnum"), (F.col("id") % nx).alias("i"), F.expr(f"id div {nx}").alias("j"))
    corner = F.explode(F.sequence(F.lit(0), F.lit(5)))
    # half columns and half rows, whole numbers, tell the corners apart: 30 degrees is one half column, one row
    dx, dy = F.array(*map(F.lit, (0, 1, 1, 0, -1, -1))), F.array(*map(F.lit, (-2, -1, 1, 2, 1, -1)))
    rows = cell.select("gnum", "i", "j", corner.alias("k")).select("gnum", "k", (2 * F.col("i") + F.col("j") % 2 + dx[F.col("k")]).alias("u"), (3 * F.col("j") + dy[F.col("k")]).alias("v"))
    wide = 4 * (nx + 2)
    rows = rows.withColumn("vertex", (F.col("v") + 2) * wide + F.col("u") + 1)
    vertices = rows.select(F.col("vertex").alias("gnum"), (F.col("u") * F.lit(size * math.sqrt(3) / 2)).alias("x"), (F.col("v") * F.lit(size / 2)).alias("y"), F.lit(0.0).alias("z")).distinct()
    elements = rows.groupBy("gnum").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "vertex"))), lambda s: s.vertex).alias("connec")).withColumn("elt_type", F.lit("poly2d"))
    return vertices, elements
