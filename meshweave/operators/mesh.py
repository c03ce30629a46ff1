"""Meshes as tables: numbering, blocks, derived cells and reshaping.

vertices: gnum, x, y, z. elements: gnum, elt_type, order, connec (vertex numbers), faces (arrays of places in connec,
outward) and what else a caller carries along.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from meshweave.functions import shapes
from meshweave.functions.geometry import mean_of
from meshweave.operators.candidates import AXES
from meshweave.plans.durable import dealt, stored


def numbered(rows: DataFrame, order: list[str | Column], name: str = "gnum", parts: int | None = None) -> DataFrame:
    """Contiguous numbers from 1 in `order`, ties by the other plain columns.

    One exchange by ranges, sorted within each and stored with every row's place in its range; the numbers are the
    places shifted by the counts of the ranges before. Both are read from the stored rows, so they cannot disagree,
    and a key that many rows share is split by the columns that break its ties. `parts`: ranges, by default as many
    as the session's shuffle partitions.
    """
    sort = [c if isinstance(c, Column) else F.col(c) for c in order]
    named = {c for c in order if isinstance(c, str)}
    sort += [F.col(f.name) for f in rows.schema if f.name not in named and not isinstance(f.dataType, (ArrayType, MapType, StructType))]
    ranged = rows.repartitionByRange(parts, *sort) if parts else rows.repartitionByRange(*sort)
    placed = stored(ranged.sortWithinPartitions(*sort).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33).cast("int")
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    shifts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    within = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(F.broadcast(shifts), "_part").withColumn(name, (within + F.col("_shift") + 1).cast("long")).drop("_part", "_place", "_shift")


def gnum_from_coordinates(points: DataFrame, merge: bool = False, tolerance: float | None = None) -> DataFrame:
    """Numbers in the order of the coordinates; with `merge`, points at one place share one, as do those that steps of at
    most `tolerance` between points connect, in the order of the first of their places."""
    if not merge:
        rest = [c for c in ("part_id", "lnum") if c in points.columns]
        return numbered(points, [*AXES, *rest])
    places = numbered(points.select(*AXES).distinct(), list(AXES))
    if not tolerance:
        return points.join(dealt(places), list(AXES))
    from meshweave.operators.coincidence import coincident as classes

    near = classes(places, tolerance)
    first = numbered(near.select("same").distinct(), ["same"], "number")
    own = places.join(dealt(near), "gnum").join(dealt(first), "same").select(*AXES, F.col("number").alias("gnum"))
    return points.join(dealt(own), list(AXES))


def gnum_from_parents(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Equal keys get equal numbers, in the order of the keys."""
    return rows.join(dealt(numbered(rows.select(*keys).distinct(), list(keys))), keys)


def gnum_by_scan(rows: DataFrame) -> DataFrame:
    """Numbers by partition, then by place in it."""
    return numbered(rows, ["part_id", "lnum"])


def gnum_from_adjacency(rows: DataFrame, parents: list[str]) -> DataFrame:
    """Entities given by the numbers of what they join (edges by vertices, faces by cells): those with equal sets of
    `parents` columns, in any order, share one number, in the order of the sorted sets."""
    ends = F.sort_array(F.array(*(F.col(c).cast("long") for c in parents)))
    named = rows.withColumn("_ends", F.to_json(ends)).withColumns({f"_e{k}": F.get(ends, F.lit(k)) for k in range(len(parents))})
    keys = [f"_e{k}" for k in range(len(parents))]
    return named.join(dealt(numbered(named.select("_ends", *keys).distinct(), keys)), ["_ends", *keys]).drop("_ends", *keys)


def gnum_of_subentities(rows: DataFrame, parent: str = "gnum", count: str = "n_sub") -> DataFrame:
    """(parent, sub, sub_gnum): each entity's `count` parts numbered one after the other, in the order of the parents."""
    listed = rows.where(F.col(count) > 0).select(F.col(parent).alias("_p"), F.explode(F.sequence(F.lit(1), F.col(count))).alias("sub"))
    whole = numbered(listed, ["_p", "sub"], "sub_gnum")
    return whole.select(F.col("_p").alias(parent), "sub", "sub_gnum")


#: Centres of faces that are this share of the smallest face's extent apart, or less, are one.
SAME_FACE = 1e-6


def gnum_of_faces(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces (face, connec) numbered by their geometry: those with the same centre share a number, at any scale."""
    corners = faces.select("face", F.explode("connec").alias("v")).join(dealt(vertices.select(F.col("gnum").alias("v"), *AXES)), "v")
    extent = F.greatest(*(F.max(a) - F.min(a) for a in AXES)).alias("extent")
    centres = stored(corners.groupBy("face").agg(*(F.avg(a).alias(a) for a in AXES), extent))
    smallest = centres.where("extent > 0").agg(F.min("extent")).first()[0]
    return gnum_from_coordinates(centres.drop("extent"), merge=True, tolerance=smallest and smallest * SAME_FACE).select("face", "gnum")


def morton_ordered(points: DataFrame, bits: int = 16) -> DataFrame:
    """`points` with their Morton code over their common box, and gnum along the curve."""
    from meshweave.operators.partition import curve_codes

    coded = curve_codes(points, bits)
    return numbered(coded, ["morton", *AXES])


def type_by_vertices(volume: bool) -> Column:
    """The element type that a vertex count stands for on a surface or in a volume."""
    n = F.size("connec")
    if volume:
        return F.when(n == 4, "tetra4").when(n == 5, "pyram5").when(n == 6, "prism6").when(n == 8, "hexa8").otherwise("poly3d")
    return F.when(n == 3, "tria3").when(n == 4, "quad4").otherwise("poly2d")


def from_vertices(rows: DataFrame, volume: bool) -> DataFrame:
    """elements of (gnum, connec): face to vertex or cell to vertex lists."""
    return rows.withColumn("elt_type", type_by_vertices(volume))


def classified(cell_faces: DataFrame, face_vertices: DataFrame) -> DataFrame:
    """(cell, elt_type, n_tria, n_quad, n_poly) from cell to face (cell, face) and face to vertex (face, connec) tables."""
    sizes = face_vertices.select("face", F.size("connec").alias("n"))
    counted = cell_faces.select("cell", F.abs("face").alias("face")).join(dealt(sizes), "face").groupBy("cell").agg(*(F.count(F.when(c, 1)).alias(a) for a, c in (("n_tria", F.col("n") == 3), ("n_quad", F.col("n") == 4), ("n_poly", F.col("n") > 4))))
    is_ = lambda t, q: (F.col("n_tria") == t) & (F.col("n_quad") == q) & (F.col("n_poly") == 0)
    kind = F.when(is_(4, 0), "tetra4").when(is_(4, 1), "pyram5").when(is_(2, 3), "prism6").when(is_(0, 6), "hexa8").otherwise("poly3d")
    return counted.select("cell", kind.alias("elt_type"), "n_tria", "n_quad", "n_poly")


def ragged(lengths: np.ndarray, values: pa.Array, missing: np.ndarray | None = None) -> pa.ListArray:
    """Lists of the given lengths out of `values`, one after the other."""
    return pa.ListArray.from_arrays(pa.array(shapes.starts_of(lengths), pa.int32()), values, mask=None if missing is None else pa.array(missing))


#: The places of a standard cell's vertices with base and top walked the other way.
TURNED = {"tetra4": [0, 2, 1, 3], "pyram5": [0, 3, 2, 1, 4], "prism6": [0, 2, 1, 3, 5, 4], "hexa8": [0, 3, 2, 1, 4, 7, 6, 5]}


def from_cell_faces(cell_faces: DataFrame, face_vertices: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """elements (gnum, elt_type, connec, faces) from cell to face (cell, face) and face to vertex (face, connec) tables. A
    face that looks into its cell has a negative number there.

    The base is the quad of a pyramid, the triangle of the smallest number of a tetrahedron or prism, the face of the
    smallest number of a hexahedron; it is walked as seen from inside, from its smallest vertex. The edges of the
    other faces that leave the base lead from each of its vertices to the one opposite. Cells whose faces do not close
    to a standard cell that way (such as two triangles and three quads where the triangles touch) are polyhedra: their
    vertices in order of number, and every face by places of these, outward. With `vertices`, standard cells that turn
    out to have a negative volume, as their faces' signs were wrong, are turned over. One exchange by face and one by
    cell; the walk itself is in columns.
    """
    known = face_vertices.select("face", F.col("connec").alias("c"))
    sides = cell_faces.select("cell", F.abs("face").alias("face"), (F.col("face") < 0).alias("inward")).join(dealt(known), "face")
    corners = F.when(F.col("inward"), F.reverse("c")).otherwise(F.col("c")).cast("array<long>")
    sides = sides.select("cell", F.struct("face", corners.alias("c")).alias("side"))
    whole = sides.repartition("cell").groupBy("cell").agg(F.sort_array(F.collect_list("side")).alias("sides"))
    names = pa.array([*shapes.SIDES, "poly3d"])

    def run(batches):
        for batch in batches:
            sides = batch.column("sides")
            lists = sides.flatten().field("c")
            n_faces, sizes, corners = (np.asarray(x) for x in (pc.list_value_length(sides), pc.list_value_length(lists), lists.flatten()))
            kind, n_vertices, connec, places = shapes.from_faces(n_faces, sizes, corners)
            free = kind < 0
            own = np.repeat(free, n_faces)
            walks = ragged(sizes[own], pa.array(places[np.repeat(own, sizes)], pa.int32()))
            faces = ragged(np.where(free, n_faces, 0), walks, ~free)
            yield pa.RecordBatch.from_arrays([batch.column("cell"), names.take(pa.array(np.where(free, len(names) - 1, kind))), ragged(n_vertices, pa.array(connec)), faces], ["gnum", "elt_type", "connec", "faces"])

    number, numbers = (t[c].dataType.simpleString() for t, c in ((whole.schema, "cell"), (known.schema, "c")))
    made = whole.mapInArrow(run, f"gnum {number}, elt_type string, connec array<long>, faces array<array<int>>").withColumn("connec", F.col("connec").cast(numbers))
    if vertices is None:
        return made
    wrong = measured(cells(vertices, made)).where((F.col("volume") < 0) & (F.col("elt_type") != "poly3d")).select("gnum", F.lit(True).alias("wrong"))
    turned = F.col("connec")
    for name, order in TURNED.items():
        turned = F.when(F.col("elt_type") == name, F.array(*(F.get("connec", F.lit(i)) for i in order))).otherwise(turned)
    return made.join(dealt(wrong), "gnum", "left").withColumn("connec", F.when(F.col("wrong"), turned).otherwise(F.col("connec"))).drop("wrong")


def from_face_edges(face_edges: DataFrame, edges: DataFrame) -> DataFrame:
    """(face, connec): the closed walk along a face's signed edges (face, edge) over (edge, a, b), from its smallest vertex."""
    sign = F.col("edge") > 0
    steps = face_edges.select("face", F.abs("edge").alias("edge"), sign.alias("ahead")).join(dealt(edges), "edge").select("face", F.when(F.col("ahead"), F.col("a")).otherwise(F.col("b")).alias("p"), F.when(F.col("ahead"), F.col("b")).otherwise(F.col("a")).alias("q"))
    linked = steps.groupBy("face").agg(F.map_from_entries(F.collect_list(F.struct("p", "q"))).alias("next"), F.min("p").alias("first"))
    walk = F.aggregate(F.sequence(F.lit(2), F.size("next")), F.array("first"), lambda s, i: F.array_append(s, F.col("next")[F.element_at(s, -1)]))
    return linked.select("face", walk.alias("connec"))


def cells(vertices: DataFrame, elements: DataFrame) -> DataFrame:
    """Elements with their vertices' coordinates, centre and box: what the spatial operators take. Other columns travel with
    an element's first corner, so `elements` are made once and dealt once."""
    plain = elements
    for name, kind in (("order", F.lit(1)), ("faces", F.lit(None).cast("array<array<int>>"))):
        if name not in plain.columns:
            plain = plain.withColumn(name, kind)
    carried = [c for c in plain.columns if c != "gnum"]
    corner = plain.select("*", F.posexplode("connec").alias("_i", "_v")).select("gnum", "_i", "_v", *(F.when(F.col("_i") == 0, F.col(c)).alias(c) for c in carried))
    met = corner.join(dealt(vertices.select(F.col("gnum").alias("_v"), F.struct("x", "y", "z").alias("_at"))), "_v", "left")
    vertex = F.when(F.col("_at").isNotNull(), F.struct("_i", F.struct(F.col("_v").alias("gnum"), *(F.col("_at")[a].alias(a) for a in AXES)).alias("s")))
    placed = met.repartition("gnum").groupBy("gnum").agg(*(F.first(c, ignorenulls=True).alias(c) for c in carried), F.sort_array(F.collect_list(vertex)).alias("_ordered"))
    known = placed.where(F.size("_ordered") > 0).withColumn("vtx", F.transform("_ordered", lambda o: o.s)).drop("_ordered")
    bounds = {f"{a}{n}": f(F.col(f"vtx.{a}")) for a in AXES for n, f in (("min", F.array_min), ("max", F.array_max))}
    return known.withColumns({f"c{a}": mean_of(F.col("vtx"), a) for a in AXES} | bounds)


FLAT = ("tria3", "quad4", "poly2d")


def measures(elt_type: pa.Array, vtx: pa.Array, faces: pa.Array) -> pa.Array:
    """(volume, nx, ny, nz) of the cells of a batch, as in measured(); null where vertices or faces are missing."""
    kinds = np.asarray(elt_type.fill_null(""), object)
    count, corner = np.asarray(pc.list_value_length(vtx)).astype(np.int64), vtx.flatten()
    v = np.stack([np.asarray(corner.field(a), float) for a in AXES])
    first, n = shapes.starts_of(count), len(kinds)
    size, normal, known = np.zeros(n), np.full((3, n), np.nan), np.ones(n, bool)

    def out_of(lists, rows):
        """Places in lists laid end to end, of the lists `rows`."""
        begin, length = lists[rows], lists[rows + 1] - lists[rows]
        return np.repeat(begin - shapes.starts_of(length)[:-1], length) + np.arange(length.sum())

    rows = np.flatnonzero(np.isin(kinds, FLAT))
    area = shapes.polygon_areas(v[:, out_of(first, rows)], count[rows])
    x, y, z = area * area
    size[rows] = np.sqrt(x + y + z)
    normal[:, rows] = np.divide(area, size[rows], out=np.full_like(area, np.nan), where=size[rows] > 0)
    known[rows] = count[rows] >= 3
    rows = np.flatnonzero((kinds == "edge2") & (count >= 2))
    x, y, z = (v[:, first[rows] + 1] - v[:, first[rows]]) ** 2
    size[rows] = np.sqrt(x + y + z)
    known[(kinds == "edge2") & (count < 2)] = False

    def solid(rows, n_faces, sizes, places):
        """`places`: -1 where one is missing."""
        face, owner = np.repeat(np.arange(len(rows)), n_faces), rows.repeat(n_faces)
        cell = np.repeat(owner, sizes)
        wrong = (places < 0) | (places >= count[cell])
        size[rows] = shapes.cell_volumes(v, first[rows], n_faces, sizes, np.where(wrong, first[cell], first[cell] + places))
        known[cell[wrong]] = False
        known[rows[face[sizes < 3]]] = False

    for kind, walls in shapes.FACES.items():
        rows = np.flatnonzero(kinds == kind)
        solid(rows, np.full(len(rows), len(walls)), np.tile([len(f) for f in walls], len(rows)), np.tile(np.concatenate(walls), len(rows)))
    other = ~np.isin(kinds, [*FLAT, "edge2", "node", *shapes.FACES])
    known[other & np.asarray(pc.is_null(faces))] = False
    given = pc.if_else(pa.array(other), faces, pa.scalar(None, faces.type))
    walls = given.flatten()
    n_faces = np.asarray(pc.fill_null(pc.list_value_length(given), 0))[other]
    solid(np.flatnonzero(other), n_faces, np.asarray(pc.fill_null(pc.list_value_length(walls), 0)), np.asarray(pc.fill_null(walls.flatten(), -1)).astype(np.int64))
    for a in AXES:
        gone = np.flatnonzero(np.asarray(pc.is_null(corner.field(a))))
        known[np.repeat(np.arange(n), count)[gone]] = False
    known |= kinds == "node"
    flat = known & np.isin(kinds, FLAT) & (size > 0)
    return pa.StructArray.from_arrays([pa.array(size, mask=~known), *(pa.array(c, mask=~flat) for c in normal)], ["volume", *(f"n{a}" for a in AXES)])


def measured(cell_table: DataFrame) -> DataFrame:
    """`cell_table` with volume (length, area or volume by type) and, on surfaces, the unit normal nx, ny, nz."""

    def run(elt_type: pa.Array, vtx: pa.Array, faces: pa.Array) -> pa.Array:
        return measures(elt_type, vtx, faces)

    made = F.arrow_udf(run, "volume double, nx double, ny double, nz double")("elt_type", "vtx", "faces")
    return cell_table.withColumn("_made", made).withColumns({c: F.col("_made")[c] for c in ("volume", "nx", "ny", "nz")}).drop("_made")


def edges(elements: DataFrame) -> DataFrame:
    """(a, b), a < b: the distinct edges of surface elements."""
    n = F.size("connec")
    pair = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("connec", i).alias("p"), F.get("connec", (i + 1) % n).alias("q")))
    every = elements.select(F.inline(pair))
    return every.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def elements_of_vertices(elements: DataFrame) -> DataFrame:
    """(vertex, elements): the inverse of the connectivity."""
    return elements.select(F.explode("connec").alias("vertex"), "gnum").groupBy("vertex").agg(F.sort_array(F.collect_set("gnum")).alias("elements"))


def blocks(*tables: DataFrame) -> DataFrame:
    """Blocks one after the other, with block_id in the order given."""
    return reduce(lambda p, q: p.unionByName(q, allowMissingColumns=True), (t.withColumn("block_id", F.lit(i)) for i, t in enumerate(tables)))


def triangulated(elements: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """Surface elements as triangles (gnum, sub, connec): quads along the shorter diagonal if vertices are given, other convex polygons as fans."""
    n = F.size("connec")
    fan = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.array(F.get("connec", F.lit(0)), F.get("connec", i), F.get("connec", i + 1)))
    rows = elements
    if vertices is not None:
        known = cells(vertices, elements).select("gnum", "connec", "vtx")
        d = [sum(((F.col("vtx")[i][a] - F.col("vtx")[j][a]) ** 2 for a in AXES), F.lit(0.0)) for i, j in ((0, 2), (1, 3))]
        turned = F.concat(F.slice("connec", 2, n - 1), F.slice("connec", 1, 1))
        rows = known.withColumn("connec", F.when((n == 4) & (d[1] < d[0]), turned).otherwise(F.col("connec")))
    return rows.select("gnum", F.posexplode(fan).alias("sub", "connec"))


def cut_to_triangles(cell_table: DataFrame, delaunay: bool = False) -> DataFrame:
    """Polygons of any shape, with their vertices (cells()), as triangles (gnum, sub, connec), by ears in the mean plane;
    with `delaunay`, no inner edge has a corner of its neighbour in the circle of its triangle."""
    from meshweave.operators.intersection import ears
    from meshweave.operators.location import flat_columns, groups, rows_of

    def run(batches):
        for batch in batches:
            gnum = batch.column("gnum").to_numpy()
            for _, rows in groups(batch, ()):
                names = rows_of(batch, "nodes", rows)
                cut = ears(rows_of(batch, "flat", rows).reshape(len(rows), -1, 3), delaunay)
                out = [(gnum[r], k, list(names[i, list(t)])) for i, r in enumerate(rows) for k, t in enumerate(cut[i])]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.list_(pa.int64())), strict=True)], ["gnum", "sub", "connec"])

    return cell_table.select("gnum", *flat_columns()).mapInArrow(run, "gnum long, sub int, connec array<long>")


def tessellated(cell_table: DataFrame, field: DataFrame | None = None) -> DataFrame:
    """Volume cells as tetrahedra (gnum, sub, points: array of four corners), fans about the face centres and the cell's.

    With a field of the vertices (gnum, value), also values: an array of four values, those of new corners being the
    means of the vertices they stand for.
    """
    from meshweave.operators.location import flat_columns, groups, rows_of

    known = cell_table.select("gnum", *flat_columns())
    size = 0
    if field is not None:
        first = field.select(F.size("value")).first()
        size = first[0] if first else 0
        corner = known.select("gnum", F.posexplode("nodes").alias("i", "v")).join(dealt(field.select(F.col("gnum").alias("v"), "value")), "v")
        values = corner.groupBy("gnum").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("i", "value"))), lambda s: s.value)).alias("given"))
        known = known.join(dealt(values), "gnum")

    def nested(x: np.ndarray) -> pa.Array:
        """(n, parts, width) as lists of lists."""
        n, parts, width = x.shape
        inner = pa.ListArray.from_arrays(pa.array(np.arange(n * parts + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * parts, pa.int32()), inner)

    def run(batches):
        for batch in batches:
            gnum = batch.column("gnum").to_numpy()
            for (kind, faces), rows in groups(batch, ("elt_type", "faces")):
                v = rows_of(batch, "flat", rows).reshape(len(rows), -1, 3)
                if size:
                    v = np.concatenate([v, rows_of(batch, "given", rows).reshape(len(rows), v.shape[1], size)], axis=2)
                made = shapes.to_tetras(v, shapes.faces_of(kind, faces))
                n, parts = made.shape[:2]
                flat = made.reshape(n * parts, 4, -1)
                columns = [pa.array(np.repeat(gnum[rows], parts)), pa.array(np.tile(np.arange(parts, dtype=np.int32), n)), nested(flat[..., :3])]
                yield pa.RecordBatch.from_arrays([*columns, *([nested(flat[..., 3:])] if size else [])], ["gnum", "sub", "points", *(["values"] if size else [])])

    return known.mapInArrow(run, "gnum long, sub int, points array<array<double>>" + (", values array<array<double>>" if size else ""))


def extruded(vertices: DataFrame, elements: DataFrame, layers: int, along: tuple[float, float, float], n_vertices: int, n_elements: int) -> tuple[DataFrame, DataFrame]:
    """`layers` layers of prisms and hexahedra over triangles and quads; `along` is the whole displacement."""
    level = F.explode(F.sequence(F.lit(0), F.lit(layers))).alias("level")
    risen = vertices.select("*", level).select((F.col("gnum") + F.col("level") * n_vertices).alias("gnum"), *((F.col(a) + F.col("level") / layers * d).alias(a) for a, d in zip(AXES, along, strict=True)))
    step = F.explode(F.sequence(F.lit(0), F.lit(layers - 1))).alias("level")
    shifted = lambda k: F.transform("connec", lambda v: v + (F.col("level") + k) * n_vertices)
    kind = F.when(F.size("connec") == 3, "prism6").when(F.size("connec") == 4, "hexa8").otherwise("poly3d")
    solid = elements.select("gnum", "connec", step).select((F.col("gnum") + F.col("level") * n_elements).alias("gnum"), kind.alias("elt_type"), F.concat(shifted(0), shifted(1)).alias("connec"))
    return risen, solid


def solids(vertices: DataFrame, polygons: DataFrame, layers: int, height: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices, faces, cell_faces) of the cells between `layers` + 1 copies of a sheet of polygons of any number of
    corners (gnum, connec), counter-clockwise as seen from above: a mesh of polyhedra known by its faces.

    faces (face, connec) are shared by the cells on both sides; cell_faces (cell, face) has a negative face where it
    looks into the cell. Vertices, polygons and edges are numbered from 0 once; what they become in a layer is that
    number and a multiple of how many there are, so all layers are made without another exchange. Cells are numbered
    along the polygons, layer by layer.
    """
    if layers < 1:
        raise ValueError("there is at least one layer")
    nodes = numbered(vertices.select("gnum", *AXES), ["gnum"], "v").withColumn("v", F.col("v") - 1)
    sheet = numbered(polygons.select(F.col("gnum").alias("polygon")), ["polygon"], "f").withColumn("f", F.col("f") - 1)
    corners = polygons.select(F.col("gnum").alias("polygon"), F.posexplode("connec").alias("k", "gnum")).join(dealt(nodes.select("gnum", "v")), "gnum").join(dealt(sheet), "polygon")
    walks = corners.repartition("f").groupBy("f").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda x: x.v).alias("walk"))
    walks = stored(walks)
    n = F.size("walk")
    ends = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("walk", i).alias("p"), F.get("walk", (i + 1) % n).alias("q")))
    sides = walks.select("f", F.inline(ends)).select("f", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), (F.col("p") < F.col("q")).alias("ahead"))
    known = numbered(sides.select("a", "b").distinct(), ["a", "b"], "e")
    n_nodes, n_sheet, n_edges = nodes.count(), walks.count(), known.count()
    level, between = F.explode(F.sequence(F.lit(0), F.lit(layers))), F.explode(F.sequence(F.lit(0), F.lit(layers - 1)))
    up = lambda l: l.cast("long")
    points = nodes.withColumn("l", level).select((up(F.col("l")) * n_nodes + F.col("v")).alias("gnum"), "x", "y", (F.col("z") + F.col("l") * F.lit(height / layers)).alias("z"))
    flat = walks.withColumn("l", level).select((up(F.col("l")) * n_sheet + F.col("f") + 1).alias("face"), F.transform("walk", lambda v: up(F.col("l")) * n_nodes + v).alias("connec"))
    first = (layers + 1) * n_sheet
    low, high = (lambda v: up(F.col("l")) * n_nodes + v), (lambda v: (up(F.col("l")) + 1) * n_nodes + v)
    upright = known.withColumn("l", between).select((F.lit(first) + up(F.col("l")) * n_edges + F.col("e")).alias("face"), F.array(low(F.col("a")), low(F.col("b")), high(F.col("b")), high(F.col("a"))).alias("connec"))
    cell = up(F.col("l")) * n_sheet + F.col("f") + 1
    lids = walks.select("f").withColumn("l", between).select(cell.alias("cell"), F.explode(F.array(-cell, cell + n_sheet)).alias("face"))
    side = F.lit(first) + up(F.col("l")) * n_edges + F.col("e")
    around = sides.join(dealt(known), ["a", "b"]).withColumn("l", between).select(cell.alias("cell"), F.when(F.col("ahead"), side).otherwise(-side).alias("face"))
    return points, flat.unionByName(upright), lids.unionByName(around)


def projected(vertices: DataFrame, axis: str = "z") -> DataFrame:
    """Coordinates with one axis set to zero."""
    return vertices.withColumn(axis, F.lit(0.0))


def base_edges(elements: DataFrame, vertices: DataFrame, axis: str = "z") -> DataFrame:
    """An extruded surface back to its base: the edges of its faces at the least value of the axis, as (a, b)."""
    lowest = vertices.agg(F.min(axis).alias("low"))
    base = vertices.join(F.broadcast(lowest)).where(F.col(axis) == F.col("low")).select("gnum")
    found = edges(elements)
    return found.join(dealt(base.withColumnRenamed("gnum", "a")), "a", "left_semi").join(dealt(base.withColumnRenamed("gnum", "b")), "b", "left_semi").select("a", "b")


def reordered(elements: DataFrame, order: list[int]) -> DataFrame:
    """Connectivity in another node order: place k of the result is place order[k] of the input."""
    return elements.withColumn("connec", F.array(*(F.get("connec", F.lit(i)) for i in order)))


def ordering_from_ijk(elt_type: str, order: int, ijk: list[tuple[int, int, int]]) -> list[int]:
    """Where each node of the default ordering stands in the caller's, given by the caller's node indices."""
    place = {tuple(n): i for i, n in enumerate(ijk)}
    return [place[n] for n in shapes.ho_nodes(elt_type, order)]


def coincident(points: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(gnum, same) as in operators.coincidence: the smallest number of the points at one place, or connected by steps of
    at most `tolerance`."""
    from meshweave.operators.coincidence import coincident as classes

    return classes(points, tolerance)


def periodic(points: DataFrame, transforms: dict[int, list[list[float]]]) -> DataFrame:
    """Every point under each affine transform (id to three rows of four): (tr_id, gnum, x, y, z)."""
    from meshweave.functions.geometry import transformed

    images = F.array(*(F.struct(F.lit(i).alias("tr_id"), *(c.alias(a) for a, c in zip(AXES, transformed(*(F.col(a) for a in AXES), m), strict=True))) for i, m in transforms.items()))
    return points.select("gnum", F.inline(images)).select("tr_id", "gnum", *AXES)


def composed(a: list[list[float]], b: list[list[float]]) -> list[list[float]]:
    """The transform that does `a`, then `b`."""
    square = [*a, [0.0, 0.0, 0.0, 1.0]]
    return [[sum(r[k] * square[k][c] for k in range(4)) for c in range(4)] for r in b]
