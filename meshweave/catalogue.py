"""The registered queries of the engine and their SQL, all over whole tables."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshweave.functions import geometry, periodicity, selector, shapes
from meshweave.operators import coincidence, exchange, interpolate, intersection, location, mesh, metric, nearest, partition
from meshweave.plans import coupling, durable
from meshweave.sources import generators
from meshweave.streaming import steps

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").selectExpr("p_partkey AS gnum", "(p_retailprice - 900.0D) / 100.0D AS x", "p_size / 51.0D AS y", "0.0D AS z")


PARTS = "(SELECT p_partkey AS gnum, (p_retailprice - 900.0) / 100.0 AS x, p_size / 51.0::DOUBLE AS y, 0.0::DOUBLE AS z FROM part)"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").selectExpr("c_custkey AS gnum", "c_acctbal / 1000.0D AS x", "CAST(c_custkey % 97 AS double) AS y", "CAST(c_nationkey AS double) AS z", "array(c_acctbal) AS value", "array(c_mktsegment) AS groups", "array(c_nationkey) AS attributes")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS gnum", "s_acctbal / 1000.0D AS x", "CAST(s_suppkey % 97 AS double) AS y", "CAST(s_nationkey AS double) AS z", "array(s_acctbal) AS value")


CUSTOMERS = "(SELECT c_custkey AS gnum, c_acctbal / 1000.0 AS x, (c_custkey % 97)::DOUBLE AS y, c_nationkey::DOUBLE AS z, c_acctbal AS value, c_mktsegment, c_nationkey FROM customer)"
SUPPLIERS = "(SELECT s_suppkey AS gnum, s_acctbal / 1000.0 AS x, (s_suppkey % 97)::DOUBLE AS y, s_nationkey::DOUBLE AS z, s_acctbal AS value FROM supplier)"


# ---- exchanges by global number


def revenue(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    return read(spark, sf_dir, "lineitem").where(where).groupBy(F.col("l_orderkey").alias("gnum")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"))


def orders(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    return read(spark, sf_dir, "orders").where(where).select(F.col("o_orderkey").alias("gnum"))


@query("SELECT o_orderkey AS gnum, round(value, 4) AS value FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS value FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def identity_exchange(spark, sf_dir):
    return exchange.delivered(orders(spark, sf_dir), revenue(spark, sf_dir)).select("gnum", F.round("value", 4).alias("value"))


RETURNED = "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R'"


def returned(spark, sf_dir, status="true"):
    return exchange.identity_mapping(revenue(spark, sf_dir, "l_returnflag = 'R'"), orders(spark, sf_dir, status))


@query(f"SELECT o_orderkey AS gnum FROM orders WHERE o_orderkey IN ({RETURNED})")
def computed_targets(spark, sf_dir):
    return exchange.computed(orders(spark, sf_dir), returned(spark, sf_dir))


@query(f"SELECT o_orderkey AS gnum FROM orders WHERE o_orderkey NOT IN ({RETURNED})")
def uncomputed_targets(spark, sf_dir):
    return exchange.uncomputed(orders(spark, sf_dir), returned(spark, sf_dir))


@query("SELECT l_orderkey AS gnum, round(sum(l_extendedprice * (1 - l_discount)), 4) AS value FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def involved_sources(spark, sf_dir):
    """Targets are the finished orders: returns of open ones stay unused."""
    return exchange.involved(revenue(spark, sf_dir, "l_returnflag = 'R'"), returned(spark, sf_dir, "o_orderstatus = 'F'")).select("gnum", F.round("value", 4).alias("value"))


@query("SELECT o_orderkey AS recv, c_acctbal AS acctbal, c_mktsegment AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def part_data_exchange(spark, sf_dir):
    receivers = read(spark, sf_dir, "orders").selectExpr("o_custkey AS gnum", "o_orderkey AS recv")
    senders = read(spark, sf_dir, "customer").selectExpr("c_custkey AS gnum", "c_nationkey AS part_id", "c_custkey AS lnum", "c_acctbal AS acctbal", "c_mktsegment AS segment")
    return exchange.part_data(receivers, senders).select("recv", "acctbal", "segment")


@query("SELECT o_orderkey AS gnum, l_partkey AS part, l_quantity AS quantity, l_extendedprice AS price FROM orders JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem) ON o_orderkey = l_orderkey AND rn = 1")
def part_data_first_wins(spark, sf_dir):
    place = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    senders = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("gnum"), *place)
    first = exchange.first_by_place(senders, place=place)
    reached = exchange.delivered(orders(spark, sf_dir), first.withColumn("value", F.struct("l_partkey", "l_quantity", "l_extendedprice")))
    return reached.where("value is not null").select("gnum", F.col("value.l_partkey").alias("part"), F.col("value.l_quantity").alias("quantity"), F.col("value.l_extendedprice").alias("price"))


@query("SELECT n_nationkey, n_name, g.n AS n_global, g.first_name FROM nation, (SELECT count(*)::INT AS n, arg_min(r_name, r_regionkey) AS first_name FROM region) g")
def global_data_broadcast(spark, sf_dir):
    made = exchange.global_data(read(spark, sf_dir, "nation"), read(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    return made.select("n_nationkey", "n_name", F.size("global").alias("n_global"), F.col("global")[0]["r_name"].alias("first_name"))


@query("SELECT tgt_gnum, count(*) AS n_sources, min(src) AS first_source FROM (SELECT o_custkey AS tgt_gnum, o_orderkey AS src FROM orders) GROUP BY 1")
def come_from_index(spark, sf_dir):
    listed = exchange.sources_of(read(spark, sf_dir, "orders").selectExpr("o_custkey AS tgt_gnum", "o_orderkey AS src_gnum"))
    return listed.select("tgt_gnum", F.size("sources").cast("long").alias("n_sources"), F.col("sources")[0].alias("first_source"))


@query("SELECT o_orderstatus AS part_id, count(DISTINCT o_orderkey) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1")
def located_distribution(spark, sf_dir):
    made = exchange.identity_mapping(revenue(spark, sf_dir), orders(spark, sf_dir))
    return exchange.distribution(made, read(spark, sf_dir, "orders").selectExpr("o_orderkey AS gnum", "o_orderstatus AS part_id"))


@query("SELECT 'balance' AS name, round(min(d), 4) AS min_value, round(max(d), 4) AS max_value, round(sum(d), 4) AS sum_value FROM (SELECT c_nationkey, max(c_acctbal) AS d FROM customer GROUP BY 1)")
def param_reduce_min_max_sum(spark, sf_dir):
    params = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("string").alias("code")).agg(F.max("c_acctbal").alias("d")).withColumn("name", F.lit("balance"))
    return coupling.reduced(params).select("name", *(F.round(c, 4).alias(c) for c in ("min_value", "max_value", "sum_value")))


# ---- numbering and order


@query("SELECT p_partkey, dense_rank() OVER (ORDER BY p_retailprice, p_size) AS gnum FROM part")
def gnum_from_coords(spark, sf_dir):
    points = read(spark, sf_dir, "part").selectExpr("p_partkey", "p_retailprice AS x", "CAST(p_size AS double) AS y", "0.0D AS z")
    return mesh.gnum_from_coordinates(points, merge=True).select("p_partkey", "gnum")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey) AS gnum FROM part")
def gnum_scan(spark, sf_dir):
    return mesh.gnum_by_scan(read(spark, sf_dir, "part").selectExpr("p_partkey", "p_size AS part_id", "p_partkey AS lnum")).select("p_partkey", "gnum")


@query("SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand, p_type) AS gnum FROM part")
def gnum_from_parents(spark, sf_dir):
    return mesh.gnum_from_parents(read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"]).select("p_partkey", "gnum")


@query(f"SELECT gnum, min(gnum) OVER (PARTITION BY x, y) AS same FROM {PARTS}")
def coincident_points(spark, sf_dir):
    return mesh.coincident(part_points(spark, sf_dir))


NEAR = 0.0105
CLASSES = f"""known AS (SELECT * FROM {PARTS}), linked AS (SELECT a.gnum AS u, b.gnum AS w FROM known a JOIN known b ON b.x BETWEEN a.x - {NEAR} AND a.x + {NEAR} AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= {NEAR}::DOUBLE ** 2),
reached(u, w) AS (SELECT gnum, gnum FROM known UNION SELECT r.u, l.w FROM reached r JOIN linked l ON r.w = l.u), classes AS (SELECT u AS gnum, min(w) AS same FROM reached GROUP BY 1)"""


@query(f"WITH RECURSIVE {CLASSES} SELECT * FROM classes")
def coincident_tolerance(spark, sf_dir):
    return mesh.coincident(part_points(spark, sf_dir), NEAR)


@query(f"WITH RECURSIVE {CLASSES}, first AS (SELECT same, min((x, y)) AS place FROM classes JOIN known USING (gnum) GROUP BY 1) SELECT c.gnum AS part, dense_rank() OVER (ORDER BY place) AS gnum FROM classes c JOIN first USING (same)")
def gnum_with_tolerance(spark, sf_dir):
    made = mesh.gnum_from_coordinates(part_points(spark, sf_dir).withColumnRenamed("gnum", "part"), merge=True, tolerance=NEAR)
    return made.select("part", "gnum")


@query(f"""WITH RECURSIVE {CLASSES}, moves AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7])::INT AS tr_id, unnest([1, -1, 0, 0, 1, -1, 1, -1]) AS dx, unnest([0, 0, 1, -1, 1, -1, -1, 1]) * (49 / 51.0::DOUBLE) AS dy)
SELECT DISTINCT c.same AS gnum, tr_id, d.same AS other FROM known a CROSS JOIN moves JOIN known b ON (a.x + dx - b.x) ** 2 + (a.y + dy - b.y) ** 2 <= {NEAR}::DOUBLE ** 2 JOIN classes c ON c.gnum = a.gnum JOIN classes d ON d.gnum = b.gnum""")
def periodic_coincidence(spark, sf_dir):
    """Classes of parts that a shift along x, along y or along both, and back, brings onto one another."""
    moves = periodicity.Periodicity()
    moves.add_translation((1, 0, 0), 1)
    moves.add_translation((0, 49 / 51, 0), 2)
    moves.combined()
    return coincidence.periodic_links(part_points(spark, sf_dir), moves, NEAR)


@query(f"SELECT gnum, list_sum(list_transform(range(16), lambda b: ((((floor(x * 65535)::BIGINT >> b) & 1) << (2 * b)) | (((floor(y * 65535)::BIGINT >> b) & 1) << (2 * b + 1)))))::BIGINT AS morton FROM {PARTS}")
def morton_codes(spark, sf_dir):
    return part_points(spark, sf_dir).select("gnum", geometry.morton([F.floor(F.col("x") * 65535), F.floor(F.col("y") * 65535)]).alias("morton"))


MORTON = f"(SELECT *, list_sum(list_transform(range(16), lambda b: ((((floor(u * 65535)::BIGINT >> b) & 1) << (3 * b)) | (((floor(v * 65535)::BIGINT >> b) & 1) << (3 * b + 1)))))::BIGINT AS morton FROM (SELECT *, (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) AS u, (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) AS v FROM {PARTS}))"


@query(f"SELECT gnum AS part, morton, row_number() OVER (ORDER BY morton, x, y, z, gnum) AS gnum FROM {MORTON}")
def morton_order(spark, sf_dir):
    return mesh.morton_ordered(part_points(spark, sf_dir).withColumnRenamed("gnum", "part")).select("part", "morton", "gnum")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, dense_rank() OVER (ORDER BY least(l_partkey, l_suppkey), greatest(l_partkey, l_suppkey)) AS gnum FROM lineitem")
def gnum_from_adjacency(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return mesh.gnum_from_adjacency(rows, ["l_partkey", "l_suppkey"])


@query("SELECT p_partkey, i::INT AS sub, (shift + i)::BIGINT AS sub_gnum FROM (SELECT p_partkey, p_size, sum(p_size) OVER (ORDER BY p_partkey) - p_size AS shift FROM part), range(1, 51) r(i) WHERE i <= p_size")
def gnum_of_subentities(spark, sf_dir):
    return mesh.gnum_of_subentities(read(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", "p_size")


@query(f"SELECT gnum, round(y, 9) AS x, round(-x, 9) AS y, round(z + 2, 9) AS z, 2 AS tr_id FROM {PARTS} UNION ALL SELECT gnum, round(x + 1, 9), round(y, 9), round(z, 9), 1 FROM {PARTS}")
def periodic_images(spark, sf_dir):
    made = mesh.periodic(part_points(spark, sf_dir), {1: [[1, 0, 0, 1], [0, 1, 0, 0], [0, 0, 1, 0]], 2: [[0, 1, 0, 0], [-1, 0, 0, 0], [0, 0, 1, 2]]})
    return made.select("tr_id", "gnum", *(F.round(a, 9).alias(a) for a in "xyz"))


@query(f"SELECT 0 AS component, gnum, x AS value FROM {PARTS} UNION ALL SELECT 1, gnum, y FROM {PARTS} UNION ALL SELECT 2, gnum, z FROM {PARTS}")
def interlaced_to_interleaved(spark, sf_dir):
    return interpolate.interleaved(part_points(spark, sf_dir).select("gnum", F.array("x", "y", "z").alias("value")))


@query(f"SELECT gnum, x AS v0, y AS v1 FROM {PARTS}")
def interleaved_to_interlaced(spark, sf_dir):
    rows = interpolate.interleaved(part_points(spark, sf_dir).select("gnum", F.array("x", "y").alias("value")))
    return interpolate.interlaced(rows).select("gnum", F.col("value")[0].alias("v0"), F.col("value")[1].alias("v1"))


# ---- location

GRID = 32


def grid_cells(spark, n, triangles=False):
    return mesh.cells(generators.grid_vertices(spark, n, n), (generators.grid_triangles if triangles else generators.grid_quads)(spark, n, n))


def linear(vertices):
    return vertices.select("gnum", F.array(1 + 2 * F.col("x") + 3 * F.col("y")).alias("value"))


@query(f"SELECT p.gnum AS tgt_gnum, min(c.g) AS src_gnum FROM {PARTS} p JOIN (SELECT j * {GRID} + i AS g, i / {GRID}.0::DOUBLE AS x0, (i + 1) / {GRID}.0::DOUBLE AS x1, j / {GRID}.0::DOUBLE AS y0, (j + 1) / {GRID}.0::DOUBLE AS y1 FROM range({GRID}) a(i), range({GRID}) b(j)) c ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1")
def locate_p0_quad(spark, sf_dir):
    return location.locate(part_points(spark, sf_dir), grid_cells(spark, GRID)).select("tgt_gnum", "src_gnum")


@query(f"SELECT gnum, round(1 + 2 * x + 3 * y, 6) AS value FROM {PARTS}")
def locate_p1_quad(spark, sf_dir):
    made = location.locate(part_points(spark, sf_dir), grid_cells(spark, GRID))
    return interpolate.weighted_nodes(made, linear(generators.grid_vertices(spark, GRID, GRID))).select("gnum", F.round(F.col("value")[0], 6).alias("value"))


@query(f"""WITH p AS (SELECT gnum, x * {GRID} AS u, y * {GRID} AS v FROM {PARTS}), c AS (SELECT *, least(floor(u), {GRID - 1})::BIGINT AS i, least(floor(v), {GRID - 1})::BIGINT AS j FROM p),
q AS (SELECT gnum, u - i AS a, v - j AS b, (j * {GRID + 1} + i) % 7 AS f00, (j * {GRID + 1} + i + 1) % 7 AS f10, ((j + 1) * {GRID + 1} + i) % 7 AS f01, ((j + 1) * {GRID + 1} + i + 1) % 7 AS f11 FROM c)
SELECT gnum, round(CASE WHEN a + b <= 1 THEN f00 + (f10 - f00) * a + (f01 - f00) * b ELSE f11 + (f01 - f11) * (1 - a) + (f10 - f11) * (1 - b) END, 6) AS value FROM q""")
def locate_p1_tria(spark, sf_dir):
    made = location.locate(part_points(spark, sf_dir), grid_cells(spark, GRID, True))
    field = generators.grid_vertices(spark, GRID, GRID).select("gnum", F.array((F.col("gnum") % 7).cast("double")).alias("value"))
    return interpolate.weighted_nodes(made, field).select("gnum", F.round(F.col("value")[0], 6).alias("value"))


@query(f"SELECT gnum, round(1 + 2 * (1 + 6 * x) + 3 * (1 + 6 * y), 6) AS value FROM {PARTS}")
def locate_polygon_mean_value(spark, sf_dir):
    vertices, elements = generators.hexagons(spark, 16, 16, 0.5)
    points = part_points(spark, sf_dir).select("gnum", (1 + 6 * F.col("x")).alias("x"), (1 + 6 * F.col("y")).alias("y"), "z")
    made = location.locate(points, mesh.cells(vertices, elements))
    return interpolate.weighted_nodes(made, linear(vertices)).select("gnum", F.round(F.col("value")[0], 6).alias("value"))


@query(f"SELECT gnum, round(1 + 2 * x + 3 * y, 6) AS value FROM {PARTS}")
def locate_p1_volume(spark, sf_dir):
    """Tetrahedra of a 6^3 box; points at a third of the depth."""
    vertices = generators.box_vertices(spark, 6)
    points = part_points(spark, sf_dir).withColumn("z", F.lit(1 / 3))
    made = location.locate(points, mesh.cells(vertices, generators.box_tetras(spark, 6)))
    return interpolate.weighted_nodes(made, linear(vertices)).select("gnum", F.round(F.col("value")[0], 6).alias("value"))


#: Edge of the small cells of the volume queries: no tolerance of the kernels may depend on the size of a cell.
TINY = 1e-5


def tiny_points(spark, sf_dir):
    """The parts spread through a box of edge 6 * TINY."""
    edge = 6 * TINY
    return part_points(spark, sf_dir).select("gnum", (F.col("x") * edge).alias("x"), (F.col("y") * edge).alias("y"), ((F.col("gnum") % 97) / 97 * edge).alias("z"))


def tiny_field(vertices):
    return vertices.select("gnum", F.array(1 + (2 * F.col("x") + 3 * F.col("y") + 4 * F.col("z")) / (6 * TINY)).alias("value"))


TINY_SQL = f"SELECT gnum, round(1 + 2 * x + 3 * y + 4 * (gnum % 97) / 97.0::DOUBLE, 6) AS value FROM {PARTS}"


def tiny_located(spark, sf_dir, vertices, elements):
    made = location.locate(tiny_points(spark, sf_dir), mesh.cells(vertices, elements))
    return interpolate.weighted_nodes(made, tiny_field(vertices)).select("gnum", F.round(F.col("value")[0], 6).alias("value"))


def tiny_vertices(spark):
    return generators.moved(generators.box_vertices(spark, 6, 6 * TINY), 0.02, 6 * TINY)


@query(TINY_SQL)
def locate_p1_hexa(spark, sf_dir):
    return tiny_located(spark, sf_dir, tiny_vertices(spark), generators.box_hexas(spark, 6))


@query(TINY_SQL)
def locate_p1_prism(spark, sf_dir):
    return tiny_located(spark, sf_dir, tiny_vertices(spark), generators.box_prisms(spark, 6))


@query(TINY_SQL)
def locate_p1_pyramid(spark, sf_dir):
    """Flat faces: pyramids that share a warped one would leave a gap between the two readings of its surface."""
    return tiny_located(spark, sf_dir, *generators.box_pyramids(spark, generators.box_vertices(spark, 6, 6 * TINY), 6))


@query(TINY_SQL)
def locate_polyhedra(spark, sf_dir):
    faces = F.array(*(F.array(*map(F.lit, f)) for f in shapes.FACES["hexa8"]))
    return tiny_located(spark, sf_dir, tiny_vertices(spark), generators.box_hexas(spark, 6).withColumns({"elt_type": F.lit("poly3d"), "faces": faces}))


@query(f"SELECT gnum, round(sqrt(pow(greatest(0, 3 * x - 2), 2) + pow(greatest(0, 3 * y - 2), 2) + 0.25), 6) AS dist FROM {PARTS}")
def closest_volume_cell(spark, sf_dir):
    """Targets over and beside a box of edge 2, half a unit above its lid: distances to the cells' faces."""
    points = part_points(spark, sf_dir).select("gnum", (3 * F.col("x")).alias("x"), (3 * F.col("y")).alias("y"), F.lit(2.5).alias("z"))
    made = location.closest(points, mesh.cells(generators.box_vertices(spark, 4, 2.0), generators.box_hexas(spark, 4)))
    return made.select(F.col("tgt_gnum").alias("gnum"), F.round(F.sqrt("dist2"), 6).alias("dist"))


@query(f"SELECT gnum, round(1 + x * x - x * y + 2 * y * y, 6) AS value FROM {PARTS}")
def locate_high_order(spark, sf_dir):
    """Six-node triangles reproduce a field of the second degree."""
    nodes = generators.grid_vertices(spark, 16, 16)
    made = location.locate(part_points(spark, sf_dir), mesh.cells(nodes, generators.quadratic_triangles(spark, 8)))
    field = nodes.select("gnum", F.array(1 + F.col("x") * F.col("x") - F.col("x") * F.col("y") + 2 * F.col("y") * F.col("y")).alias("value"))
    return interpolate.weighted_nodes(made, field).select("gnum", F.round(F.col("value")[0], 6).alias("value"))


BENT3 = "(x - 0.5) * (x - 0.5) * (x + 1) / 2 - y * y * y / 3"


@query(f"SELECT gnum, (floor(y * 7) * 7 + floor(x * 7))::BIGINT AS src_gnum, round(x, 3) AS px, round(y, 3) AS py, round(0.02::DOUBLE * (1 + gnum % 3), 6) AS dist FROM {PARTS}")
def locate_bent_order3(spark, sf_dir):
    """Sixteen-node quads on a surface of the third degree; targets stand off it along its normal, and come back to their foot."""
    n = 7
    at = lambda e: F.expr(f"({e}) / {3.0 * n}D")
    nodes = spark.range((3 * n + 1) ** 2).select(F.col("id").alias("gnum"), at(f"id % {3 * n + 1}").alias("x"), at(f"id div {3 * n + 1}").alias("y")).withColumn("z", F.expr(BENT3))
    corner = lambda i, j: (F.expr(f"id div {n}") * 3 + j) * (3 * n + 1) + F.expr(f"id % {n}") * 3 + i
    quads = spark.range(n * n).select(F.col("id").alias("gnum"), F.lit("ho_quad").alias("elt_type"), F.lit(3).alias("order"), F.array(*(corner(i, j) for i, j, _ in shapes.ho_nodes("ho_quad", 3))).alias("connec"))
    feet = part_points(spark, sf_dir).withColumn("z", F.expr(BENT3)).withColumns({"sx": F.expr("((2 * (x - 0.5)) * (x + 1) + (x - 0.5) * (x - 0.5)) / 2"), "sy": F.expr("- y * y")})
    off = 0.02 * (1 + F.col("gnum") % 3) / F.sqrt(1 + F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy"))
    targets = feet.select("gnum", (F.col("x") - off * F.col("sx")).alias("x"), (F.col("y") - off * F.col("sy")).alias("y"), (F.col("z") + off).alias("z"))
    made = location.locate(targets, mesh.cells(nodes, quads), 0.45)
    return made.select(F.col("tgt_gnum").alias("gnum"), "src_gnum", *(F.round(F.col("proj")[k], 3).alias(f"p{a}") for k, a in enumerate("xy")), F.round(F.sqrt("dist2"), 6).alias("dist"))


@query(f"SELECT gnum, round(greatest(0, x - 0.5), 6) AS dist FROM {PARTS}")
def locate_all_targets(spark, sf_dir):
    """A mesh over the left half: every target is mapped, those on the right to the closest cell."""
    vertices = generators.grid_vertices(spark, 8, 16, high=(0.5, 1.0))
    made = location.locate(part_points(spark, sf_dir), mesh.cells(vertices, generators.grid_quads(spark, 8, 16)), every=True)
    return made.select(F.col("tgt_gnum").alias("gnum"), F.round(F.sqrt("dist2"), 6).alias("dist"))


SEGMENTS = "(SELECT i AS g, i / 64.0::DOUBLE AS ax, 0.5 + 0.25 * ((i * 7) % 5 - 2) / 2.0::DOUBLE AS ay, (i + 1) / 64.0::DOUBLE AS bx, 0.5 + 0.25 * (((i + 1) * 7) % 5 - 2) / 2.0::DOUBLE AS ey FROM range(64) t(i))"


@query(f"SELECT gnum, round(min((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (ey - ay)) ** 2), 9) AS dist2 FROM (SELECT p.gnum, x, y, ax, ay, bx, ey, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (ey - ay)) / ((bx - ax) ** 2 + (ey - ay) ** 2))) AS t FROM {PARTS} p, {SEGMENTS} s) GROUP BY 1")
def closest_element(spark, sf_dir):
    vertices = spark.range(65).select(F.col("id").alias("gnum"), (F.col("id") / 64).alias("x"), (0.5 + 0.25 * (F.col("id") * 7 % 5 - 2) / 2).alias("y"), F.lit(0.0).alias("z"))
    elements = spark.range(64).select(F.col("id").alias("gnum"), F.lit("edge2").alias("elt_type"), F.array(F.col("id"), F.col("id") + 1).alias("connec"))
    made = location.closest(part_points(spark, sf_dir), mesh.cells(vertices, elements))
    return made.select(F.col("tgt_gnum").alias("gnum"), F.round("dist2", 9).alias("dist2"))


# ---- nearest neighbours


def neighbours_sql(targets: str, sources: str, own: str = "tgt", k: int = 4) -> str:
    return f"SELECT tgt_gnum, src_gnum, rank, d2 AS dist2, value, sx, sy, sz FROM (SELECT t.gnum AS tgt_gnum, s.gnum AS src_gnum, (t.x - s.x) * (t.x - s.x) + (t.y - s.y) * (t.y - s.y) + (t.z - s.z) * (t.z - s.z) AS d2, s.value, s.x AS sx, s.y AS sy, s.z AS sz, row_number() OVER (PARTITION BY {own}.gnum ORDER BY d2, {'s' if own == 't' else 't'}.gnum)::INT AS rank FROM {targets} t, {sources} s) WHERE rank <= {k}"


@query(f"SELECT tgt_gnum, src_gnum, rank, round(dist2, 6) AS dist2 FROM ({neighbours_sql(CUSTOMERS, SUPPLIERS, 't')})")
def knn_sources(spark, sf_dir):
    return nearest.nearest_sources(customers(spark, sf_dir), suppliers(spark, sf_dir)).select("tgt_gnum", "src_gnum", "rank", F.round("dist2", 6).alias("dist2"))


@query(f"SELECT tgt_gnum, src_gnum, rank, round(dist2, 6) AS dist2 FROM ({neighbours_sql(CUSTOMERS, SUPPLIERS, 's')})")
def knn_targets(spark, sf_dir):
    return nearest.nearest_targets(customers(spark, sf_dir), suppliers(spark, sf_dir)).select("tgt_gnum", "src_gnum", "rank", F.round("dist2", 6).alias("dist2"))


@query(f"SELECT tgt_gnum AS gnum, round(sum(value / greatest(1e-30, dist2)) / sum(1 / greatest(1e-30, dist2)), 5) AS value FROM ({neighbours_sql(CUSTOMERS, SUPPLIERS, 't')}) GROUP BY 1")
def interp_idw(spark, sf_dir):
    sources = suppliers(spark, sf_dir)
    made = nearest.nearest_sources(customers(spark, sf_dir), sources)
    return interpolate.inverse_distance(made, sources.select("gnum", "value")).select("gnum", F.round(F.col("value")[0], 5).alias("value"))


@query(f"SELECT gnum, round(1 + 2 * x + 3 * y, 5) AS value FROM {PARTS}")
def interp_wls_deg1(spark, sf_dir):
    nodes = generators.grid_vertices(spark, GRID, GRID)
    made = nearest.nearest_sources(part_points(spark, sf_dir), nodes, 8, ("x", "y")).withColumns({"tz": F.lit(0.0), "sz": F.lit(0.0)})
    return interpolate.least_squares(made, linear(nodes), 1).select("gnum", F.round(F.col("value")[0], 5).alias("value"))


@query(f"SELECT gnum, round(1 + x * x - 2 * y * y + y, 5) AS value FROM {PARTS}")
def interp_wls_deg2(spark, sf_dir):
    nodes = generators.grid_vertices(spark, GRID, GRID)
    field = nodes.select("gnum", F.array(1 + F.col("x") * F.col("x") - 2 * F.col("y") * F.col("y") + F.col("y")).alias("value"))
    made = nearest.nearest_sources(part_points(spark, sf_dir), nodes, 16, ("x", "y")).withColumns({"tz": F.lit(0.0), "sz": F.lit(0.0)})
    return interpolate.least_squares(made, field, 2).select("gnum", F.round(F.col("value")[0], 5).alias("value"))


@query(f"SELECT tgt_gnum AS gnum, max(value) AS value FROM ({neighbours_sql(CUSTOMERS, SUPPLIERS, 't')}) GROUP BY 1")
def user_interp_max(spark, sf_dir):
    sources = suppliers(spark, sf_dir)
    made = nearest.nearest_sources(customers(spark, sf_dir), sources)
    return interpolate.user_defined(made, sources.select("gnum", "value"), lambda g: [max(v[0] for v in g.value)]).select("gnum", F.col("value")[0].alias("value"))


# ---- overlaps


def part_boxes(spark, sf_dir):
    return part_points(spark, sf_dir).selectExpr("gnum", "x AS xmin", "x + 0.02D AS xmax", "y AS ymin", "y + 0.03D AS ymax", "gnum % 5 / 5.0D AS zmin", "gnum % 5 / 5.0D + 0.3D AS zmax")


def grid_boxes(spark, n):
    return spark.range(n**3).selectExpr("id AS gnum", f"id % {n} / {n}.0D AS xmin", f"(id % {n} + 1) / {n}.0D AS xmax", f"(id div {n}) % {n} / {n}.0D AS ymin", f"((id div {n}) % {n} + 1) / {n}.0D AS ymax", f"(id div {n * n}) / {n}.0D AS zmin", f"((id div {n * n}) + 1) / {n}.0D AS zmax")


def overlap_sql(n: int, axes: str) -> str:
    sides = {a: f"greatest(0, least(p.{a}1, g.{a}1) - greatest(p.{a}0, g.{a}0))" for a in axes}
    cells = ", ".join(f"({e} / {n}.0::DOUBLE) AS {a}0, (({e} + 1) / {n}.0::DOUBLE) AS {a}1" for a, e in (("x", f"(i % {n})"), ("y", f"((i // {n}) % {n})"), ("z", f"(i // {n * n})")))
    boxes = f"SELECT gnum, x AS x0, x + 0.02::DOUBLE AS x1, y AS y0, y + 0.03::DOUBLE AS y1, gnum % 5 / 5.0::DOUBLE AS z0, gnum % 5 / 5.0::DOUBLE + 0.3::DOUBLE AS z1 FROM {PARTS}"
    return f"SELECT p.gnum AS tgt_gnum, g.i AS src_gnum, round({' * '.join(sides.values())}, 12) AS volume FROM ({boxes}) p, (SELECT i, {cells} FROM range({n ** len(axes)}) t(i)) g WHERE {' AND '.join(f'{s} > 0' for s in sides.values())}"


def overlaps(spark, sf_dir, n, axes):
    made = intersection.box_overlap(grid_boxes(spark, n).where(F.col("gnum") < n ** len(axes)), part_boxes(spark, sf_dir), tuple(axes))
    return made.select("tgt_gnum", "src_gnum", F.round("volume", 12).alias("volume"))


@query(overlap_sql(64, "x"))
def intersect_1d(spark, sf_dir):
    return overlaps(spark, sf_dir, 64, "x")


@query(overlap_sql(16, "xy"))
def intersect_box2d(spark, sf_dir):
    return overlaps(spark, sf_dir, 16, "xy")


@query(overlap_sql(8, "xyz"))
def intersect_box3d(spark, sf_dir):
    return overlaps(spark, sf_dir, 8, "xyz")


def flat_boxes(spark, n):
    return grid_boxes(spark, n).where(F.col("gnum") < n * n)


def cell_field(spark, sf_dir, n):
    """Mean price of the parts in each cell of the grid (half open), 0 where there are none."""
    cell = F.least(F.floor(F.col("y") * n), F.lit(n - 1)) * n + F.least(F.floor(F.col("x") * n), F.lit(n - 1))
    means = part_points(spark, sf_dir).groupBy(cell.alias("gnum")).agg(F.avg("x").alias("v"))
    return spark.range(n * n).withColumnRenamed("id", "gnum").join(means, "gnum", "left").select("gnum", F.array(F.coalesce("v", F.lit(0.0))).alias("value"))


FIELD24 = f"(SELECT i AS gnum, coalesce(v, 0) AS v, (i % 24) / 24.0::DOUBLE AS x0, (i % 24 + 1) / 24.0::DOUBLE AS x1, (i // 24) / 24.0::DOUBLE AS y0, (i // 24 + 1) / 24.0::DOUBLE AS y1 FROM range(576) t(i) LEFT JOIN (SELECT (least(floor(y * 24), 23) * 24 + least(floor(x * 24), 23))::BIGINT AS c, avg(x) AS v FROM {PARTS} GROUP BY 1) ON i = c)"
TARGETS15 = "(SELECT i AS t, (i % 15) / 15.0::DOUBLE AS a0, (i % 15 + 1) / 15.0::DOUBLE AS a1, (i // 15) / 15.0::DOUBLE AS b0, (i // 15 + 1) / 15.0::DOUBLE AS b1 FROM range(225) u(i))"
CONSERVED = f"SELECT t AS gnum, sum(w * v) / sum(w) AS value FROM (SELECT t, v, greatest(0, least(x1, a1) - greatest(x0, a0)) * greatest(0, least(y1, b1) - greatest(y0, b0)) AS w FROM {FIELD24}, {TARGETS15}) WHERE w > 0 GROUP BY 1"


def conserved(spark, sf_dir):
    made = intersection.box_overlap(flat_boxes(spark, 24), flat_boxes(spark, 15), ("x", "y"))
    return interpolate.conservative(made, cell_field(spark, sf_dir, 24))


@query(f"SELECT gnum, round(value, 12) AS value FROM ({CONSERVED})")
def intersect_conservative(spark, sf_dir):
    return conserved(spark, sf_dir).select("gnum", F.round(F.col("value")[0], 12).alias("value"))


@query(f"SELECT round((SELECT sum(v) / 576 FROM {FIELD24}), 9) AS source_mass, round((SELECT sum(value) / 225 FROM ({CONSERVED})), 9) AS target_mass")
def mass_check(spark, sf_dir):
    source = cell_field(spark, sf_dir, 24).agg(F.round(F.sum(F.col("value")[0]) / 576, 9).alias("source_mass"))
    return source.join(F.broadcast(conserved(spark, sf_dir).agg(F.round(F.sum(F.col("value")[0]) / 225, 9).alias("target_mass"))))


def side_of(spark, sf_dir):
    """Cells along an edge of the meshes whose size follows the tables: the root of the number of suppliers."""
    return max(4, math.isqrt(read(spark, sf_dir, "supplier").count()))


SIDE = "(SELECT greatest(4, floor(sqrt(count(*))))::BIGINT FROM supplier)"


def part_sheet(spark, sf_dir):
    """(vertices, quads, width, number) of a sheet whose corners are all parts, in rows of the root of their number: part g
    stands in row g / width, moved by its price and its size. A quad has the number of its first corner."""
    parts = read(spark, sf_dir, "part")
    n = parts.count()
    w = max(1, math.isqrt(n))
    vertices = parts.selectExpr("p_partkey AS gnum", f"p_partkey % {w} + 0.3D * ((p_retailprice - 900.0D) / 100.0D) AS x", f"p_partkey div {w} + 0.3D * (p_size / 51.0D) AS y", "0.0D AS z", "p_size")
    quads = vertices.where(f"gnum % {w} < {w - 1} and gnum + {w + 1} < {n}").selectExpr("gnum", "'quad4' AS elt_type", f"array(gnum, gnum + 1, gnum + {w + 1}, gnum + {w}) AS connec", "p_size")
    return vertices.drop("p_size"), quads, w, n


SHEET = "(SELECT p_partkey AS g, w, n, p_size, p_partkey % w + 0.3::DOUBLE * ((p_retailprice - 900.0) / 100.0) AS x, p_partkey // w + 0.3::DOUBLE * (p_size / 51.0::DOUBLE) AS y FROM part, (SELECT count(*) AS n, floor(sqrt(count(*)))::BIGINT AS w FROM part))"
#: The quads of the sheet with their corners' coordinates.
QUADS = f"""(SELECT a.g AS gnum, a.w, a.n, a.p_size, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS ey, c.x AS cx, c.y AS cy, d.x AS dx, d.y AS dy
FROM {SHEET} a JOIN {SHEET} b ON b.g = a.g + 1 JOIN {SHEET} c ON c.g = a.g + a.w + 1 JOIN {SHEET} d ON d.g = a.g + a.w WHERE a.g % a.w < a.w - 1)"""
QUAD_AREA = "((cx - ax) * (dy - ey) - (dx - bx) * (cy - ay)) / 2"


@query(f"SELECT gnum AS tgt_gnum, round({QUAD_AREA}, 6) AS area FROM {QUADS}")
def intersect_polygons(spark, sf_dir):
    """The overlaps of a quad of the parts with all triangles of a sheet below them add up to its own area."""
    vertices, quads, w, n = part_sheet(spark, sf_dir)
    side = side_of(spark, sf_dir) + 3
    below = generators.grid_vertices(spark, side, side, (-0.5, -0.5), (w + 0.5, n / w + 0.5))
    made = intersection.overlap(mesh.cells(below, generators.grid_triangles(spark, side, side)), mesh.cells(vertices, quads.drop("p_size")))
    return made.groupBy("tgt_gnum").agg(F.round(F.sum("volume"), 6).alias("area"))


# ---- the selection language


def selected(spark, sf_dir, text):
    return selector.select(customers(spark, sf_dir), text).select("gnum")


def select_query(name: str, text: str, where: str) -> None:
    def run(spark, sf_dir):
        return selected(spark, sf_dir, text)

    run.__name__ = name
    query(f"SELECT gnum FROM {CUSTOMERS} WHERE {where}")(run)


select_query("select_box", "box[0, 10, 2, 5, 60.0, 20]", "x BETWEEN 0 AND 5 AND y BETWEEN 10 AND 60 AND z BETWEEN 2 AND 20")
select_query("select_sphere", "sphere[4, 50, 12, 20]", "(x - 4) ** 2 + (y - 50) ** 2 + (z - 12) ** 2 <= 400")
select_query("select_cylinder", "cylinder[0, 50, 12, 8, 50, 12, 15]", "x BETWEEN 0 AND 8 AND (y - 50) ** 2 + (z - 12) ** 2 <= 225")
select_query("select_plane", "plane[0, 1, 0, -50, inside]", "y - 50 <= 0")
select_query("select_plane_band", "plane[0, 0, 2, 5, 5, 12, epsilon = 0.5]", "abs(z - 12) < 0.5")
select_query("select_group", "BUILDING or MACHINERY", "c_mktsegment IN ('BUILDING', 'MACHINERY')")
select_query("select_range", "range[3, 9, attribute]", "c_nationkey BETWEEN 3 AND 9")
select_query("select_group_range", "range[BUILDING, HOUSEHOLD, group]", "c_mktsegment BETWEEN 'BUILDING' AND 'HOUSEHOLD'")
select_query("select_bool", "not (BUILDING, 7) and x >= 2.5 xor 20 < y", "(NOT (c_mktsegment = 'BUILDING' OR c_nationkey = 7) AND x >= 2.5) != (y > 20)")
select_query("select_all", "all[]", "true")
select_query("select_no_group", "no_group[]", "false")


@query(f"SELECT gnum FROM {QUADS} WHERE p_size % 3 = 0")
def select_normal(spark, sf_dir):
    """Quads whose first part's size is a multiple of three run counter-clockwise and so look up; the others are turned over."""
    vertices, quads, _, _ = part_sheet(spark, sf_dir)
    quads = quads.withColumn("connec", F.when(F.col("p_size") % 3 == 0, F.col("connec")).otherwise(F.reverse("connec"))).drop("p_size")
    return selector.select(mesh.measured(mesh.cells(vertices, quads)), "normal[0, 0, 1]").select("gnum")


# ---- meshes


@query(f"SELECT gnum, round((ax + bx + cx + dx) / 4, 9) AS cx, round((ay + ey + cy + dy) / 4, 9) AS cy, round({QUAD_AREA}, 9) AS area FROM {QUADS}")
def cell_centres(spark, sf_dir):
    vertices, quads, _, _ = part_sheet(spark, sf_dir)
    return mesh.measured(mesh.cells(vertices, quads.drop("p_size"))).select("gnum", F.round("cx", 9).alias("cx"), F.round("cy", 9).alias("cy"), F.round("volume", 9).alias("area"))


@query(f"SELECT 2 * gnum AS gnum, round(abs((bx - ax) * (cy - ay) - (cx - ax) * (ey - ay)) / 2, 9) AS area FROM {QUADS} UNION ALL SELECT 2 * gnum + 1, round(abs((cx - ax) * (dy - ay) - (dx - ax) * (cy - ay)) / 2, 9) FROM {QUADS}")
def tria_area(spark, sf_dir):
    vertices, quads, _, _ = part_sheet(spark, sf_dir)
    v = F.col("vtx")
    halves = mesh.triangulated(quads.drop("p_size")).select((2 * F.col("gnum") + F.col("sub")).alias("gnum"), F.lit("tria3").alias("elt_type"), "connec")
    return mesh.cells(vertices, halves).select("gnum", F.round(geometry.triangle_area(v[0], v[1], v[2]), 9).alias("area"))


FOURTHS = "(SELECT p_partkey // 4 AS gnum, p_partkey % 4 AS k, (p_retailprice - 900.0) / 100.0 AS x, p_size / 51.0::DOUBLE AS y, (p_partkey * 7 % 11) / 11.0::DOUBLE AS z FROM part)"


@query(f"""SELECT gnum, round(abs((bx - ax) * ((cy - ay) * (dz - az) - (cz - az) * (dy - ay)) - (ey - ay) * ((cx - ax) * (dz - az) - (cz - az) * (dx - ax)) + (bz - az) * ((cx - ax) * (dy - ay) - (cy - ay) * (dx - ax))) / 6, 9) AS volume FROM (
SELECT gnum, {", ".join(f"max({a}) FILTER (k = {k}) AS {n}{a if n + a != 'by' else 'y'}" if n != "b" or a != "y" else f"max(y) FILTER (k = {k}) AS ey" for k, n in enumerate("abcd") for a in "xyz")} FROM {FOURTHS} GROUP BY 1 HAVING count(*) = 4)""")
def tetra_volume(spark, sf_dir):
    """Four parts after one another are a tetrahedron."""
    points = read(spark, sf_dir, "part").selectExpr("p_partkey AS gnum", "(p_retailprice - 900.0D) / 100.0D AS x", "p_size / 51.0D AS y", "(p_partkey * 7 % 11) / 11.0D AS z")
    fours = points.groupBy(F.expr("gnum div 4").alias("cell")).agg(F.array_sort(F.collect_list("gnum")).alias("connec")).where("size(connec) = 4")
    v = F.col("vtx")
    made = mesh.cells(points, fours.select(F.col("cell").alias("gnum"), F.lit("tetra4").alias("elt_type"), "connec"))
    return made.select("gnum", F.round(F.abs(geometry.tetra_volume(v[0], v[1], v[2], v[3])), 9).alias("volume"))


@query(f"SELECT DISTINCT unnest([gnum, gnum + 1, gnum + w, gnum]) AS a, unnest([gnum + 1, gnum + w + 1, gnum + w + 1, gnum + w]) AS b FROM {QUADS}")
def mesh_edges(spark, sf_dir):
    return mesh.edges(part_sheet(spark, sf_dir)[1].drop("p_size"))


@query("SELECT l_partkey AS vertex, count(DISTINCT l_orderkey) AS n, min(l_orderkey) AS first_element FROM lineitem GROUP BY 1")
def vertex_to_elements(spark, sf_dir):
    """Orders are elements of the parts they hold."""
    elements = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("gnum")).agg(F.array_sort(F.collect_set("l_partkey")).alias("connec"))
    return mesh.elements_of_vertices(elements).select("vertex", F.size("elements").cast("long").alias("n"), F.col("elements")[0].alias("first_element"))


@query(f"SELECT 0 AS block_id, gnum, 4 AS n_vertices FROM {QUADS} WHERE p_size % 2 = 0 UNION ALL SELECT 1, 2 * gnum + s, 3 FROM {QUADS}, range(2) t(s) WHERE p_size % 2 = 1")
def block_union(spark, sf_dir):
    """A block of the quads of even size and one of the halves of the others."""
    quads = part_sheet(spark, sf_dir)[1]
    halves = mesh.triangulated(quads.where("p_size % 2 = 1").drop("p_size")).select((2 * F.col("gnum") + F.col("sub")).alias("gnum"), F.lit("tria3").alias("elt_type"), "connec")
    return mesh.blocks(quads.where("p_size % 2 = 0").drop("p_size"), halves).select("block_id", "gnum", F.size("connec").alias("n_vertices"))


MIXED = "array(named_struct('t', 4, 'q', 0, 'p', 0), named_struct('t', 4, 'q', 1, 'p', 0), named_struct('t', 2, 'q', 3, 'p', 0), named_struct('t', 0, 'q', 6, 'p', 0), named_struct('t', 1, 'q', 2, 'p', 3))"


@query("SELECT l_linenumber::BIGINT * 1000000000 + l_orderkey AS cell, ['tetra4', 'pyram5', 'prism6', 'hexa8', 'poly3d'][l_linenumber % 5 + 1] AS elt_type FROM (SELECT DISTINCT l_linenumber, l_orderkey FROM lineitem)")
def classify_cells_from_faces(spark, sf_dir):
    """A cell for each distinct (line, order); its kind follows the line number and so its faces."""
    cells = read(spark, sf_dir, "lineitem").selectExpr("l_linenumber * 1000000000L + l_orderkey AS cell", "l_linenumber % 5 AS kind").distinct()
    sides = cells.selectExpr("cell", f"{MIXED}[kind] AS m").selectExpr("cell", "explode(concat(array_repeat(1L, m.t), array_repeat(2L, m.q), array_repeat(3L, m.p))) AS n").selectExpr("cell", "n AS face")
    faces = spark.range(1, 4).selectExpr("id AS face", "sequence(1L, id + 2) AS connec")
    return mesh.classified(sides, faces).select("cell", "elt_type")


@query(f"SELECT gnum, s::INT AS sub, gnum AS v0, CASE s WHEN 0 THEN gnum + 1 ELSE gnum + w + 1 END AS v1, CASE s WHEN 0 THEN gnum + w + 1 ELSE gnum + w END AS v2 FROM {QUADS}, range(2) z(s)")
def triangulate_quads(spark, sf_dir):
    made = mesh.triangulated(part_sheet(spark, sf_dir)[1].drop("p_size"))
    return made.select("gnum", "sub", *(F.col("connec")[i].alias(f"v{i}") for i in range(3)))


IN_CIRCLE = """(ax - dx) * ((ey - dy) * ((cx - dx) ** 2 + (cy - dy) ** 2) - (cy - dy) * ((bx - dx) ** 2 + (ey - dy) ** 2)) - (ay - dy) * ((bx - dx) * ((cx - dx) ** 2 + (cy - dy) ** 2) - (cx - dx) * ((bx - dx) ** 2 + (ey - dy) ** 2))
+ ((ax - dx) ** 2 + (ay - dy) ** 2) * ((bx - dx) * (cy - dy) - (ey - dy) * (cx - dx))"""


@query(f"SELECT gnum, CASE WHEN {IN_CIRCLE} > 1e-9 THEN gnum + 1 ELSE gnum END AS v0, CASE WHEN {IN_CIRCLE} > 1e-9 THEN gnum + w ELSE gnum + w + 1 END AS v1 FROM {QUADS}")
def delaunay_quads(spark, sf_dir):
    """The diagonal by which each quad of the parts is cut, after flipping."""
    vertices, quads, _, _ = part_sheet(spark, sf_dir)
    made = mesh.cut_to_triangles(mesh.cells(vertices, quads.drop("p_size")), delaunay=True)
    both = made.groupBy("gnum").agg(F.collect_list("connec").alias("t")).withColumn("shared", F.array_sort(F.array_intersect(F.col("t")[0], F.col("t")[1])))
    return both.select("gnum", F.col("shared")[0].alias("v0"), F.col("shared")[1].alias("v1"))


@query(f"SELECT l * n + gnum AS gnum, 'hexa8' AS elt_type, round({QUAD_AREA} / 3, 9) AS volume FROM {QUADS}, range(3) c(l)")
def extrude_mesh(spark, sf_dir):
    vertices, quads, _, n = part_sheet(spark, sf_dir)
    vertices, solid = mesh.extruded(vertices, quads.drop("p_size"), 3, (0.0, 0.0, 1.0), n, n)
    return mesh.measured(mesh.cells(vertices, solid)).select("gnum", "elt_type", F.round("volume", 9).alias("volume"))


@query(f"SELECT gnum, NULL::DOUBLE AS value FROM {PARTS}")
def empty_interface(spark, sf_dir):
    """A source side that owns no mesh maps nothing; every target stays, without a value."""
    targets = part_points(spark, sf_dir)
    made = location.locate(targets, grid_cells(spark, 4).where("gnum < 0"))
    values = interpolate.weighted_nodes(made, linear(generators.grid_vertices(spark, 4, 4)))
    return interpolate.filled(targets, values).select("gnum", F.col("value")[0].alias("value"))


@query(f"SELECT gnum AS face, gnum AS v0, gnum + 1 AS v1, gnum + w + 1 AS v2, gnum + w AS v3 FROM {QUADS}")
def faces_from_edges(spark, sf_dir):
    """Quads given by their edges alone, each walked backwards where its number is negative."""
    quads = part_sheet(spark, sf_dir)[1].drop("p_size")
    ends = [F.struct(F.col("connec")[k].alias("p"), F.col("connec")[(k + 1) % 4].alias("q")) for k in range(4)]
    walks = quads.select(F.col("gnum").alias("face"), F.inline(F.array(*ends)))
    number = lambda p, q: F.least(p, q) * 1_000_000_000 + F.greatest(p, q) + 1
    face_edges = walks.select("face", (number(F.col("p"), F.col("q")) * F.when(F.col("p") < F.col("q"), 1).otherwise(-1)).alias("edge"))
    known = mesh.edges(quads).select(number(F.col("a"), F.col("b")).alias("edge"), "a", "b")
    return mesh.from_face_edges(face_edges, known).select("face", *(F.col("connec")[k].alias(f"v{k}") for k in range(4)))


@query(f"SELECT l * (SELECT count(*) FROM {QUADS}) + row_number() OVER (PARTITION BY l ORDER BY gnum) AS gnum, 'hexa8' AS elt_type, round({QUAD_AREA} / 2, 9) AS volume FROM {QUADS}, range(2) c(l)")
def solids_of_polygons(spark, sf_dir):
    """Two layers of cells over the sheet of the parts, made as faces that cells share, and put together from these."""
    vertices, quads, _, _ = part_sheet(spark, sf_dir)
    points, faces, cell_faces = mesh.solids(vertices, quads.drop("p_size"), 2, 1.0)
    made = mesh.measured(mesh.cells(points, mesh.from_cell_faces(cell_faces, faces)))
    return made.select("gnum", "elt_type", F.round("volume", 9).alias("volume"))


def part_bricks(spark, sf_dir, columns=()):
    """A brick for each part: (vertices, elements); its corner g * 8 + k is corner k of a hexahedron."""
    parts = part_points(spark, sf_dir).selectExpr("gnum", "x", "y", "gnum % 5 / 5.0D AS z", "0.02D + gnum % 3 / 50.0D AS wx", "0.03D AS wy", "0.1D + gnum % 7 / 10.0D AS wz")
    corner = [F.struct((F.col("gnum") * 8 + k).alias("gnum"), *((F.col(a) + F.lit(float(c[i])) * F.col(f"w{a}")).alias(a) for i, a in enumerate("xyz"))) for k, c in enumerate(shapes.CORNERS["hexa8"])]
    return parts.select(F.inline(F.array(*corner))), parts.select("gnum", F.lit("hexa8").alias("elt_type"), F.array(*(F.col("gnum") * 8 + k for k in range(8))).alias("connec"))


BRICKS = f"(SELECT gnum, x, y, gnum % 5 / 5.0::DOUBLE AS z, 0.02::DOUBLE + gnum % 3 / 50.0::DOUBLE AS wx, 0.03::DOUBLE AS wy, 0.1::DOUBLE + gnum % 7 / 10.0::DOUBLE AS wz FROM {PARTS})"


@query(f"SELECT gnum, 24 AS parts, round(wx * wy * wz, 9) AS volume, round(wx * wy * wz * (1 + 2 * (x + wx / 2)), 9) AS content FROM {BRICKS}")
def tessellate_cells(spark, sf_dir):
    """Tetrahedra of each brick fill it, and carry a linear field: its integral is that at the centre."""
    vertices, bricks = part_bricks(spark, sf_dir)
    field = vertices.select("gnum", F.array(1 + 2 * F.col("x")).alias("value"))
    made = mesh.tessellated(mesh.cells(vertices, bricks), field)
    corner = [F.struct(*(F.col("points")[k][a].alias(n) for a, n in enumerate("xyz"))) for k in range(4)]
    size = F.abs(geometry.tetra_volume(*corner))
    mean = sum((F.col("values")[k][0] for k in range(4)), F.lit(0.0)) / 4
    return made.groupBy("gnum").agg(F.count("*").cast("int").alias("parts"), F.round(F.sum(size), 9).alias("volume"), F.round(F.sum(size * mean), 9).alias("content"))


STANDARD = "['tetra4', 'pyram5', 'prism6', 'hexa8']"


@query(f"SELECT o_orderkey AS gnum, {STANDARD}[o_orderkey % 4 + 1] AS elt_type, round([1 / 6::DOUBLE, 1 / 3::DOUBLE, 0.5, 1][o_orderkey % 4 + 1] * (1 + o_custkey % 5) ** 3, 6) AS volume, [4, 5, 6, 8][o_orderkey % 4 + 1]::INT AS n_vertices FROM orders")
def cells_from_faces(spark, sf_dir):
    """Every order is a cell of one of four kinds and five sizes, known by its faces alone: faces are numbered by a hash,
    half of them look into the cell and are walked the other way. The lists of vertices that come back have the cell's
    positive volume."""
    orders = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS cell", "o_orderkey % 4 AS kind", "1.0D + o_custkey % 5 AS size")
    names = ("tetra4", "pyram5", "prism6", "hexa8")
    places = {"tetra4": [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)], "pyram5": [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0.5, 0.5, 1)]} | {k: shapes.CORNERS[k].tolist() for k in ("prism6", "hexa8")}
    of_kind = lambda made: F.element_at(F.array(*made), (F.col("kind") + 1).cast("int"))
    corners = of_kind([F.array(*(F.struct(F.lit(k).alias("k"), *(F.lit(float(v)).alias(a) for a, v in zip("xyz", p, strict=True))) for k, p in enumerate(places[n]))) for n in names])
    vertices = orders.select("cell", "size", F.inline(corners)).select((F.col("cell") * 8 + F.col("k")).alias("gnum"), *((F.col(a) * F.col("size")).alias(a) for a in "xyz"))
    walks = of_kind([F.array(*(F.array(*map(F.lit, f)) for f in shapes.FACES[n])) for n in names])
    faces = orders.select("cell", F.posexplode(walks).alias("k", "walk")).withColumn("own", F.transform("walk", lambda i: F.col("cell") * 8 + i))
    faces = faces.withColumns({"face": F.col("cell") * 8 + F.pmod(F.col("k") * 5 + F.col("cell"), F.lit(7)) + 1, "inward": F.pmod(F.xxhash64("cell", "k"), F.lit(2)) == 1})
    cell_faces = faces.select("cell", (F.col("face") * F.when(F.col("inward"), -1).otherwise(1)).alias("face"))
    face_vertices = faces.select("face", F.when(F.col("inward"), F.reverse("own")).otherwise(F.col("own")).alias("connec"))
    made = mesh.measured(mesh.cells(vertices, mesh.from_cell_faces(cell_faces, face_vertices)))
    return made.select("gnum", "elt_type", F.round("volume", 6).alias("volume"), F.size("connec").alias("n_vertices"))


@query(f"SELECT gnum, 2 * (floor(7 * y)::BIGINT * 7 + floor(7 * x)::BIGINT) + (u > 0.3137 AND u < 0.6871 AND v > 0.3137)::BIGINT AS src_gnum, round(1 + 2 * x + 3 * y, 6) AS value FROM (SELECT gnum, x, y, 7 * x - floor(7 * x) AS u, 7 * y - floor(7 * y) AS v FROM {PARTS})")
def locate_hollow_cells(spark, sf_dir):
    """Blocks of a cell of the shape of a U, which is not star-shaped, and of the cell that fills it; a linear field at
    their corners comes back at every part."""
    n, a, b = 7, 0.3137, 0.6871
    u = [(0, 0), (1, 0), (1, 1), (b, 1), (b, a), (a, a), (a, 1), (0, 1)]
    ring = lambda k, base: [[i, (i + 1) % k, (i + 1) % k + base, i + base] for i in range(k)]
    u_faces = [f[::-1] for f in ([0, 1, 4, 5], [1, 2, 3, 4], [0, 5, 6, 7])] + [[i + 8 for i in f] for f in ([0, 1, 4, 5], [1, 2, 3, 4], [0, 5, 6, 7])] + ring(8, 8)
    plug = [5, 4, 3, 6]
    at = F.array(*(F.struct(F.lit(k + 8 * z).alias("k"), F.lit(float(p)).alias("x"), F.lit(float(q)).alias("y"), F.lit(float(z)).alias("z")) for z in (0, 1) for k, (p, q) in enumerate(u)))
    blocks = spark.range(n * n)
    vertices = blocks.select("id", F.inline(at)).select((F.col("id") * 16 + F.col("k")).alias("gnum"), ((F.col("x") + F.col("id") % n) / n).alias("x"), ((F.col("y") + F.expr(f"id div {n}")) / n).alias("y"), "z")
    lists = [(0, "poly3d", list(range(16)), u_faces), (1, "poly3d", [*plug, *(i + 8 for i in plug)], [[3, 2, 1, 0], [4, 5, 6, 7], *ring(4, 4)])]
    cell = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(kind).alias("elt_type"), F.array(*map(F.lit, c)).alias("c"), F.array(*(F.array(*map(F.lit, f)) for f in faces)).alias("faces")) for k, kind, c, faces in lists))
    elements = blocks.select("id", F.inline(cell)).select((F.col("id") * 2 + F.col("k")).alias("gnum"), "elt_type", F.transform("c", lambda i: F.col("id") * 16 + i).alias("connec"), "faces")
    made = location.locate(part_points(spark, sf_dir).withColumn("z", F.lit(0.4)), mesh.cells(vertices, elements))
    value = interpolate.weighted_nodes(made, linear(vertices)).select("gnum", F.round(F.col("value")[0], 6).alias("value"))
    return value.join(made.select(F.col("tgt_gnum").alias("gnum"), "src_gnum"), "gnum")


WEIGHT = "CASE WHEN p_partkey % 97 = 0 THEN 1000 ELSE 1 + p_size % 7 END"


@query(f"""WITH coded AS (SELECT m.gnum AS part, m.morton, {WEIGHT}::DOUBLE AS w FROM {MORTON} m JOIN part ON p_partkey = m.gnum), sums AS (SELECT morton, sum(w) AS w FROM coded GROUP BY 1),
numbered AS (SELECT morton, least(floor((sum(w) OVER (ORDER BY morton) - w + w / 2) * 7 / (SELECT sum(w) FROM sums)), 6)::INT AS number FROM sums)
SELECT part, morton, number FROM coded JOIN numbered USING (morton)""")
def curve_parts(spark, sf_dir):
    """Parts dealt to seven ranges of the curve of even weight, under weights from 1 to 1000."""
    points = part_points(spark, sf_dir).join(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("gnum"), F.expr(WEIGHT).alias("weight")), "gnum")
    return partition.dealt_evenly(points, 7).select(F.col("gnum").alias("part"), "morton", F.col("part").alias("number"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), pairs AS (SELECT a.vec_id AS q_gnum, b.vec_id AS gnum, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id)
SELECT q_gnum, gnum, rank::INT AS rank, round(d, 9) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY q_gnum ORDER BY d, gnum) AS rank FROM pairs) WHERE rank <= 4""")
def knn_embeddings(spark, sf_dir):
    """The four vectors nearest to each, in all dimensions."""
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("gnum"), F.col("embedding").alias("v"))
    return metric.knn(vectors, vectors, 4, others=True).select("q_gnum", "gnum", "rank", F.round("dist", 9).alias("dist"))


# ---- couplings as declared and run


def coupled(spark, method, **options):
    session = coupling.Session(spark, ["left", "right"])
    made = session.couple(coupling.CouplingSpec("interface", "left", "right", method=method, options=tuple(options.items())))
    session.step_begin("left", 0.0)
    return made


@query(f"SELECT gnum, CASE WHEN x <= 0.5 + 1e-9 THEN round(1 + 2 * x + 3 * y, 6) END AS value FROM {PARTS}")
def coupling_location(spark, sf_dir):
    """A mesh over the left half: targets beyond it stay, without a value."""
    made, vertices = coupled(spark, "location"), generators.grid_vertices(spark, 16, 32, high=(0.5, 1.0))
    made.set_source(cells=mesh.cells(vertices, generators.grid_quads(spark, 16, 32)))
    made.set_targets(part_points(spark, sf_dir))
    made.field("t").data = linear(vertices)
    return made.exchange("t").select("gnum", F.round(F.col("value")[0], 6).alias("value"))


HALF = f"(SELECT i // s AS j, i % s AS i, s, (SELECT count(*) FROM {PARTS} WHERE x >= (i % s) / (2.0::DOUBLE * s) AND x < (i % s + 1) / (2.0::DOUBLE * s) AND y >= (i // s) / s::DOUBLE AND y < (i // s + 1) / s::DOUBLE)::DOUBLE AS v FROM (SELECT s, unnest(range(s * s)) AS i FROM (SELECT {SIDE} AS s)))"
OVER = "greatest(0, least((i + 1) / (2.0::DOUBLE * s), (p + 1) / m::DOUBLE) - greatest(i / (2.0::DOUBLE * s), p / m::DOUBLE)) * greatest(0, least((j + 1) / s::DOUBLE, (q + 1) / m::DOUBLE) - greatest(j / s::DOUBLE, q / m::DOUBLE))"


@query(f"SELECT gnum, round(CASE WHEN sum(o) > 1e-12 THEN sum(o * v) / sum(o) ELSE 0 END, 6) AS value FROM (SELECT q * m + p AS gnum, v, {OVER} AS o FROM {HALF}, (SELECT m, k % m AS p, k // m AS q FROM (SELECT m, unnest(range(m * m)) AS k FROM (SELECT {SIDE} + 3 AS m)))) GROUP BY 1")
def coupling_conservative(spark, sf_dir):
    """Cells over the left half carry the number of parts in them; targets that nothing covers get 0."""
    made, s = coupled(spark, "intersection"), side_of(spark, sf_dir)
    m = s + 3
    cells = mesh.cells(generators.grid_vertices(spark, s, s, high=(0.5, 1.0)), generators.grid_quads(spark, s, s))
    i, j = F.floor(F.col("x") * 2 * s), F.floor(F.col("y") * s)
    held = part_points(spark, sf_dir).where(i < s).groupBy((j * s + i).alias("gnum")).agg(F.count("*").cast("double").alias("n"))
    made.set_source(cells=cells)
    made.set_targets(grid_cells(spark, m))
    made.field("t", source_dof="cell", target_dof="cell").data = cells.join(held, "gnum", "left").select("gnum", F.array(F.coalesce("n", F.lit(0.0))).alias("value"))
    return made.exchange("t").select("gnum", F.round(F.col("value")[0], 6).alias("value"))


@query(f"SELECT component, gnum, round(CASE component WHEN 0 THEN 1 + 2 * x + 3 * y ELSE x - y END, 5) AS value FROM {PARTS}, (SELECT unnest([0, 1])::INT AS component)")
def coupling_nearest(spark, sf_dir):
    """A field of two components in interleaved storage, by least squares over eight neighbours."""
    made, nodes = coupled(spark, "nearest_sources", n_neighbors=8), generators.grid_vertices(spark, GRID, GRID)
    made.set_source(points=nodes)
    made.set_targets(part_points(spark, sf_dir))
    data = nodes.select("gnum", F.array(1 + 2 * F.col("x") + 3 * F.col("y"), F.col("x") - F.col("y")).alias("value"))
    made.field("t", n_components=2, storage="interleaved").data = interpolate.interleaved(data)
    return made.exchange("t").select("component", "gnum", F.round("value", 5).alias("value"))


@query("SELECT o_custkey AS gnum, min(o_orderkey) AS first_order, ((o_custkey - 1) // s)::INT AS block_id, (o_custkey - 1) % s AS place FROM orders, (SELECT (max(o_custkey) + 15) // 16 AS s FROM orders) GROUP BY ALL")
def part_to_block(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").selectExpr("o_custkey AS gnum", "0 AS part_id", "o_orderkey AS lnum", "o_orderkey AS first_order")
    return exchange.part_to_block(rows, 16).select("gnum", "first_order", "block_id", "place")


@query("SELECT o_orderkey AS lnum, o_custkey AS gnum, c_acctbal AS balance FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def block_to_part(spark, sf_dir):
    blocks = exchange.part_to_block(read(spark, sf_dir, "customer").selectExpr("c_custkey AS gnum", "0 AS part_id", "c_custkey AS lnum", "c_acctbal AS balance"), 16).drop("part_id", "lnum")
    return exchange.block_to_part(read(spark, sf_dir, "orders").selectExpr("o_custkey AS gnum", "o_orderkey AS lnum"), blocks).select("lnum", "gnum", "balance")


@query("SELECT c_custkey AS gnum, trunc(c_acctbal)::INT AS whole, c_acctbal::FLOAT AS short FROM customer")
def convert_field(spark, sf_dir):
    field = customers(spark, sf_dir).select("gnum", "value")
    whole = interpolate.converted(field, "int").select("gnum", F.col("value")[0].alias("whole"))
    return whole.join(interpolate.converted(field, "float").select("gnum", F.col("value")[0].alias("short")), "gnum")


# ---- steps


@query("SELECT step, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM (SELECT value, date_diff('hour', (SELECT date_trunc('hour', min(ts)) FROM events), date_trunc('hour', ts))::INT AS step FROM events) GROUP BY 1")
def step_loop_hours(spark, sf_dir):
    return steps.by_step(read(spark, sf_dir, "events"), "hour").select("step", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"))


@query("SELECT step, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM (SELECT value, date_diff('day', (SELECT date_trunc('day', min(ts)) FROM events), date_trunc('day', ts))::INT AS step FROM events) GROUP BY 1")
def step_loop(spark, sf_dir):
    return steps.by_step(read(spark, sf_dir, "events")).select("step", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"))


@query("SELECT week, c_custkey AS gnum, round(sum(value), 4) AS value FROM (SELECT DISTINCT date_diff('week', (SELECT date_trunc('week', min(ts)) FROM events), date_trunc('week', ts))::INT AS week FROM events) CROSS JOIN customer LEFT JOIN (SELECT user_id, value, date_diff('week', (SELECT date_trunc('week', min(ts)) FROM events), date_trunc('week', ts))::INT AS w FROM events) ON w = week AND user_id = c_custkey GROUP BY ALL")
def two_code_steps(spark, sf_dir):
    """Two codes step week by week: the users of a week's events are the changing source, all customers the targets."""
    weekly = durable.stored(steps.by_week(read(spark, sf_dir, "events")))
    session, made = coupling.Session(spark, ["users", "customers"], retain=None), []
    cpl = session.couple(coupling.CouplingSpec("use", "users", "customers", method="identity", displacement="variable"))
    cpl.field("value")
    for (week,) in sorted(weekly.select("step").distinct().collect()):  # steps follow time, not rows
        for code in session.codes:
            session.step_begin(code, 604_800.0 * week)
        own = weekly.where(F.col("step") == week)
        cpl.set_source(points=own.select("gnum"))
        cpl.set_targets(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("gnum")))
        cpl.fields["value"].data = own.select("gnum", F.array("value").alias("value"))
        made.append(cpl.exchange("value").select(F.lit(week).alias("week"), "gnum", F.round(F.col("value")[0], 4).alias("value")))
        for code in session.codes:
            session.step_end(code)
    return reduce(DataFrame.unionByName, made)
