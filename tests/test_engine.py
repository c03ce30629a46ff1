"""Couplings end to end, meshes, sources, sinks and steps."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meshweave.functions import shapes
from meshweave.operators import candidates, exchange, interpolate, intersection, location, mesh, nearest
from meshweave.plans.coupling import CouplingError, CouplingSpec, Params, Session, Timer
from meshweave.sources import generators, readers, writers
from meshweave.streaming import steps


def linear(v):
    return v.select("gnum", F.array(1 + 2 * F.col("x") - F.col("y") + 3 * F.col("z")).alias("value"))


def test_coupling_by_location(spark, tmp_path):
    session = Session(spark, ["fluid", "solid"])
    cpl = session.couple(CouplingSpec("heat", "fluid", "solid"))
    vertices = generators.grid_vertices(spark, 6, 6, jitter=0.2)
    cpl.set_source(cells=mesh.cells(vertices, generators.grid_quads(spark, 6, 6)))
    targets = spark.createDataFrame([(i, x, y, 0.0) for i, (x, y) in enumerate(np.random.default_rng(0).uniform(-0.1, 1, (80, 2)).tolist())], "gnum long, x double, y double, z double")
    cpl.set_targets(targets)
    cpl.field("t").data = linear(vertices)
    session.step_begin("fluid", 0.5)
    got = {r.gnum: r.value for r in cpl.exchange("t").collect()}
    with pytest.raises(CouplingError):
        cpl.exchange("t")
    session.step_end("fluid")
    rows = targets.collect()
    inside = [r for r in rows if min(r.x, r.y) >= 0]
    assert all(got[r.gnum][0] == pytest.approx(1 + 2 * r.x - r.y, abs=1e-6) for r in inside)
    out = {r.gnum for r in exchange.uncomputed(targets, cpl.mapping).collect()}
    assert {g for g, v in got.items() if v is None} == out and len(out) > 0
    assert len(got) == exchange.computed(targets, cpl.mapping).count() + len(out)
    cpl.save_mapping(str(tmp_path / "m"))
    before = sorted(cpl.mapping.select("tgt_gnum", "src_gnum").collect())
    cpl.use_slot("b")
    assert cpl.mapping is None
    cpl.use_slot(None)
    assert cpl.mapping is not None
    cpl.use_slot("c")
    cpl.load_mapping(spark, str(tmp_path / "m"))
    assert sorted(cpl.mapping.select("tgt_gnum", "src_gnum").collect()) == before
    cpl.set_option("tolerance", 0.5)
    assert cpl.mapping is None and cpl.compute_mapping().count() > len(before)


@pytest.mark.parametrize("method", ["nearest_sources", "nearest_targets", "identity"])
def test_coupling_by_points(spark, method):
    session = Session(spark, ["a", "b"])
    cpl = session.couple(CouplingSpec("c", "a", "b", method=method, options=(("n_neighbors", 6),)))
    points = generators.grid_vertices(spark, 5, 5, jitter=0.3)
    cpl.set_source(points=points)
    cpl.set_targets(points if method == "identity" else points.where("x > 0.2 and x < 0.8"))
    cpl.field("f").data = linear(points)
    got = {r.gnum: r.value for r in cpl.exchange("f").collect()}
    want = {r.gnum: r.value for r in linear(points).collect()}
    reached = {r.tgt_gnum for r in cpl.mapping.select("tgt_gnum").distinct().collect()}
    # as there: what neighbours do not reach is 0, what an identity does not reach has no value
    assert all(got[g][0] == pytest.approx(want[g][0], abs=1e-6) for g in reached) and reached
    assert all(v == (None if method == "identity" else [0.0]) for g, v in got.items() if g not in reached)


def test_specs_are_checked():
    for bad in ({"method": "location", "interface": "point"}, {"method": "intersection", "interface": "linear"}, {"coupled": "a"}, {"method": "guess"}, {"options": (("tolerance", 1),)}, {"options": (("speed", 1.0),)}):
        with pytest.raises(CouplingError):
            CouplingSpec(**({"name": "c", "local": "a", "coupled": "b"} | bad))
    spec = CouplingSpec("c", "a", "b", method="intersection")
    with pytest.raises(CouplingError):
        spec.check_field("node", "cell")
    with pytest.raises(CouplingError):
        spec.matches(CouplingSpec("c", "b", "a", method="location"))
    spec.matches(CouplingSpec("c", "b", "a", method="intersection"))


def test_parameters(spark):
    p = Params()
    p.add("a", "n", 5)
    p.add("b", "n", 7)
    p.add("a", "name", "x")
    p.set("a", "n", 6)
    assert p.reduce("sum", "n", "int", ["a", "b"]) == 13 and p.reduce("min", "n", "int", ["a", "b"]) == 6 and p.count("a", "int") == 1
    for wrong in (lambda: p.add("a", "n", 1), lambda: p.set("a", "m", 1), lambda: p.get("a", "n", "double"), lambda: p.reduce("max", "name", "string", ["a"])):
        with pytest.raises(CouplingError):
            wrong()
    with p.lock("a"), pytest.raises(CouplingError), p.lock("a"):
        pass
    with p.lock("a", by="b"):
        for wrong in (lambda: p.set("a", "n", 8), lambda: p.add("a", "m", 8), lambda: p.delete("a", "n", "int"), lambda: p.set("a", "n", 8, by="a")):
            with pytest.raises(CouplingError):
                wrong()
        p.set("a", "n", 9, by="b")
        p.set("b", "n", 8)
    p.set("a", "n", 6)
    p.set("b", "n", 7)
    other = Params({("c", "n", "int"): 1})
    p.synchronize(other)
    assert p.has("c", "n", "int") and p.frame(spark).count() == 4 and '"n"' in p.dump()
    p.delete("c", "n", "int")
    with pytest.raises(CouplingError):
        p.synchronize(Params({("a", "n", "int"): 99}))
    t = Timer()
    t.resume()
    t.hang_on()
    assert t.elapsed >= 0


def test_nearest_is_exact_with_clusters_and_ties(spark):
    rng = np.random.default_rng(1)
    pts = np.concatenate([rng.normal(0, 0.01, (150, 3)), rng.uniform(-50, 50, (30, 3)), [[1, 1, 1]] * 5]).round(4)
    qs = np.concatenate([rng.normal(0, 0.02, (40, 3)), rng.uniform(-60, 60, (20, 3)), [[1, 1, 1]]]).round(4)
    frame = lambda x: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "gnum long, x double, y double, z double")
    got = {(r.q_gnum, r["rank"]): r.p_gnum for r in nearest.nearest(frame(qs), frame(pts), 4).collect()}
    for i, q in enumerate(qs):
        d = ((pts - q) ** 2)
        order = np.lexsort((np.arange(len(pts)), d[:, 0] + d[:, 1] + d[:, 2]))[:4]
        assert [got[i, k + 1] for k in range(4)] == order.tolist()
    assert nearest.nearest(frame(qs[:3]), frame(pts[:2]), 4).count() == 6
    assert nearest.nearest(frame(qs).limit(0), frame(pts), 4).count() == 0 and nearest.nearest(frame(qs), frame(pts).limit(0), 4).count() == 0


def test_nearest_in_a_dense_cluster_and_far_away(spark):
    rng = np.random.default_rng(8)
    cluster = rng.normal(0, 1e-4, (100_000, 3))
    pts = np.concatenate([cluster, rng.uniform(-100, 100, (50, 3)), np.zeros((3000, 3))])
    qs = np.concatenate([rng.normal(0, 1e-4, (20, 3)), [[0, 0, 0], [1e-3, 0, 0], [5, 5, 5], [-1e5, 3, 2]], rng.uniform(-100, 100, (10, 3))])
    frame = lambda x: spark.createDataFrame(pd.DataFrame({"gnum": np.arange(len(x)), "x": x[:, 0], "y": x[:, 1], "z": x[:, 2]}))
    got = {(r.q_gnum, r["rank"]): r.p_gnum for r in nearest.nearest(frame(qs), frame(pts), 4).collect()}
    for i, q in enumerate(qs):
        d = (q - pts) ** 2
        order = np.lexsort((np.arange(len(pts)), d[:, 0] + d[:, 1] + d[:, 2]))[:4]
        assert [got[i, k + 1] for k in range(4)] == order.tolist()


def test_boxes_of_very_different_sizes(spark):
    rng = np.random.default_rng(9)
    size = 10.0 ** rng.uniform(-6, 0, (300, 1)) * np.ones(3)
    size[:3] = [[1e4, 1e4, 1e4], [0, 0, 0], [2e4, 0, 1e-9]]
    low = rng.uniform(-2, 2, (300, 3))
    names = [f"{a}{e}" for a in "xyz" for e in ("min", "max")]
    make = lambda k: spark.createDataFrame([(int(i), *(float(v) for a in range(3) for v in (low[i, a], low[i, a] + size[i, a]))) for i in k], "gnum long, " + ", ".join(f"{n} double" for n in names))
    left, right = make(range(0, 300, 2)), make([*range(1, 300, 2), 0])
    got = sorted((r.gnum, r.r_gnum) for r in candidates.boxes_meeting(left, right).collect())
    want = sorted((i, j) for i in range(0, 300, 2) for j in [*range(1, 300, 2), 0] if all(low[i, a] <= low[j, a] + size[j, a] and low[j, a] <= low[i, a] + size[i, a] for a in range(3)))
    assert got == want and len(want) > 20
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate([*low[:100] + size[:100] / 2, [1e9, 0, 0]])], "p long, x double, y double, z double")
    inside = sorted((r.p, r.gnum) for r in candidates.points_in_boxes(points, make(range(300))).collect())
    centres = low[:100] + size[:100] / 2
    assert inside == sorted((p, i) for p in range(100) for i in range(300) if all(low[i, a] <= centres[p, a] <= low[i, a] + size[i, a] for a in range(3)))
    assert candidates.boxes_meeting(left, right.limit(0)).count() == candidates.points_in_boxes(points, left.limit(0)).count() == 0


def test_closest_with_one_huge_cell_and_a_far_target(spark):
    vertices = generators.grid_vertices(spark, 20, 20).unionByName(spark.createDataFrame([(900, 0.0, 0.0, -5.0), (901, 1e4, 0.0, -5.0), (902, 0.0, 1e4, -5.0)], "gnum long, x double, y double, z double"))
    elements = generators.grid_quads(spark, 20, 20).unionByName(spark.createDataFrame([(999, "tria3", [900, 901, 902])], "gnum long, elt_type string, connec array<long>"))
    targets = spark.createDataFrame([(1, 0.51, 0.52, 0.1), (2, -3e4, 0.5, 0.0), (3, 100.0, 200.0, -4.0), (4, 0.999, 0.999, -4.9)], "gnum long, x double, y double, z double")
    got = {r.tgt_gnum: (r.src_gnum, r.dist2**0.5) for r in location.closest(targets, mesh.cells(vertices, elements)).collect()}
    assert got[1] == (210, pytest.approx(0.1)) and got[3] == (999, pytest.approx(1.0)) and got[4] == (999, pytest.approx(0.1))
    assert got[2] == (180, pytest.approx(3e4)) or got[2] == (200, pytest.approx(3e4))


def test_concave_cells_overlap_by_their_area(spark):
    v = spark.createDataFrame([(i, float(x), float(y), 0.0) for i, (x, y) in enumerate([(0, 0), (2, 0), (0.3, 0.3), (0, 2), (-1, -1), (3, -1), (3, 3), (-1, 3), (0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)])], "gnum long, x double, y double, z double")
    make = lambda rows: mesh.cells(v, spark.createDataFrame(rows, "gnum long, elt_type string, connec array<long>"))
    dart, square, ell = make([(1, "quad4", [0, 1, 2, 3])]), make([(2, "quad4", [4, 5, 6, 7])]), make([(3, "poly2d", [8, 9, 10, 11, 12, 13])])
    for a, b, want in ((dart, square, 0.6), (square, dart, 0.6), (ell, square, 3.0), (square, ell, 3.0), (dart, ell, 0.6)):
        assert [r.volume for r in intersection.overlap(a, b).collect()] == [pytest.approx(want, rel=1e-12)]


def test_numbers_are_gapless_over_many_files(spark, tmp_path):
    n = 500_000
    rows = spark.range(0, n, 1, 40).select("id", F.pmod(F.xxhash64("id"), F.lit(1000)).cast("int").alias("part_id"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(300)).cast("long").alias("lnum"), *((F.pmod(F.xxhash64("id", F.lit(a)), F.lit(5000)) / 7).alias(a) for a in "xyz"), F.array("id").alias("value"))
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    for made, keys in ((mesh.gnum_by_scan(rows), ("part_id", "lnum")), (mesh.gnum_from_coordinates(rows), ("x", "y", "z")), (mesh.morton_ordered(rows), ("morton", "x", "y", "z"))):
        made.write.mode("overwrite").parquet(str(tmp_path / "made"))
        back = spark.read.parquet(str(tmp_path / "made")).toPandas().sort_values("gnum")
        assert (back.gnum.to_numpy() == np.arange(1, n + 1)).all() and back.id.nunique() == n
        key = back[list(keys)].to_records(index=False)
        assert (key[1:] >= key[:-1]).all() if len(keys) == 1 else all(x == "ok" for x in {"ok" if tuple(a) <= tuple(b) else "bad" for a, b in zip(key[:-1:97], key[1::97], strict=False)})
    parents = mesh.gnum_from_parents(rows.select("id", "part_id", "lnum"), ["part_id", "lnum"])
    assert parents.agg(F.max("gnum")).first()[0] == rows.select("part_id", "lnum").distinct().count() == parents.select("gnum").distinct().count()


def test_numbers_of_edges_parts_and_faces(spark):
    rows = spark.createDataFrame([(1, 5, 3), (2, 3, 5), (3, 1, 9)], "e long, a long, b long")
    assert {r.e: r.gnum for r in mesh.gnum_from_adjacency(rows, ["a", "b"]).collect()} == {1: 2, 2: 2, 3: 1}
    parts = mesh.gnum_of_subentities(spark.createDataFrame([(4, 2), (2, 0), (1, 1)], "gnum long, n_sub int"))
    assert sorted((r.gnum, r["sub"], r.sub_gnum) for r in parts.collect()) == [(1, 1, 1), (4, 1, 2), (4, 2, 3)]
    v = generators.grid_vertices(spark, 2, 1)
    faces = spark.createDataFrame([(7, [0, 1, 4, 3]), (8, [3, 4, 1, 0]), (9, [1, 2, 5, 4])], "face long, connec array<long>")
    assert {r.face: r.gnum for r in mesh.gnum_of_faces(faces, v).collect()} == {7: 1, 8: 1, 9: 2}


def test_conservation_between_volume_meshes(spark):
    a = mesh.cells(generators.box_vertices(spark, 2), generators.box_tetras(spark, 2))
    b = mesh.cells(generators.box_vertices(spark, 3), generators.box_hexas(spark, 3))
    made = intersection.overlap(a, b)
    assert made.agg(F.sum("volume")).first()[0] == pytest.approx(1, rel=1e-12)
    field = a.select("gnum", F.array("cx").alias("value"))
    got = interpolate.conservative(made, field)
    assert sum(r.value[0] / 27 for r in got.collect()) == pytest.approx(sum(r.value[0] for r in field.collect()) / 48, rel=1e-9)


def test_meshes(spark):
    v, e = generators.sphere_surface(spark, 12, 2.0)
    cells = mesh.measured(mesh.cells(v, e))
    assert cells.agg(F.sum("volume")).first()[0] == pytest.approx(4 * np.pi * 4, rel=0.03)
    assert cells.where("cx * nx + cy * ny + cz * nz <= 0").count() == 0
    assert v.count() - mesh.edges(e).count() + e.count() == 2
    walk = mesh.from_face_edges(spark.createDataFrame([(1, 10), (1, -11), (1, 12)], "face long, edge long"), spark.createDataFrame([(10, 1, 2), (11, 3, 2), (12, 3, 1)], "edge long, a long, b long"))
    assert walk.first().connec == [1, 2, 3]
    assert mesh.ordering_from_ijk("ho_tria", 1, [(1, 0, 0), (0, 0, 0), (0, 1, 0)]) == [1, 0, 2]
    assert mesh.reordered(spark.createDataFrame([(1, [7, 8, 9])], "gnum long, connec array<long>"), [2, 0, 1]).first().connec == [9, 7, 8]
    shift = [[1, 0, 0, 1], [0, 1, 0, 0], [0, 0, 1, 0]]
    assert mesh.composed(shift, shift)[0][3] == 2
    hexa = mesh.from_vertices(spark.createDataFrame([(1, list(range(8))), (2, list(range(7)))], "gnum long, connec array<long>"), True)
    assert [r.elt_type for r in hexa.orderBy("gnum").collect()] == ["hexa8", "poly3d"]
    risen, solid = mesh.extruded(generators.grid_vertices(spark, 2, 2), generators.grid_triangles(spark, 2, 2), 3, (0, 0, 1.5), 9, 8)
    assert mesh.measured(mesh.cells(risen, solid)).agg(F.sum("volume")).first()[0] == pytest.approx(1.5)
    assert generators.disc(generators.grid_vertices(spark, 4, 4, (-1, -1), (1, 1))).agg(F.max(F.col("x") ** 2 + F.col("y") ** 2)).first()[0] == pytest.approx(1)


def test_user_elements_and_functions(spark):
    cells = mesh.cells(generators.grid_vertices(spark, 2, 2), generators.grid_quads(spark, 2, 2))
    targets = spark.createDataFrame([(1, 0.1, 0.1, 0.0), (2, 0.9, 0.6, 0.0)], "gnum long, x double, y double, z double")
    made = location.locate(targets, cells)
    field = cells.select("gnum", F.array(F.col("gnum").cast("double"), F.lit(1.0)).alias("value"))
    got = {r.gnum: r.value for r in interpolate.user_defined(made, field, lambda g: [2 * g.value.iat[0][0], 5.0]).collect()}
    assert got == {1: [0.0, 5.0], 2: [6.0, 5.0]}
    assert {r.gnum: r.value for r in interpolate.filled(targets.unionByName(targets.withColumn("gnum", F.lit(9))).distinct(), interpolate.copied(made, field), 2, True).collect()}[9] == [0.0, 0.0]
    assert exchange.status(interpolate.copied(made, field)) == "ok"
    nan = spark.createDataFrame([(1, [float("nan")])], "gnum long, value array<double>")
    assert exchange.status(nan) == "bad_receiving"


def test_files(spark, tmp_path):
    (tmp_path / "a.mesh").write_text("MeshVersionFormatted 2\nDimension 3\nVertices\n3\n0 0 0 1\n1 0 0 1\n0 1 0 1\nTriangles\n1\n1 2 3 5\nEnd\n")
    v, e = readers.read_mesh(spark, str(tmp_path / "a.mesh"))
    assert v.count() == 3 and e.first().connec == [1, 2, 3]
    (tmp_path / "a.vtk").write_text("# vtk DataFile Version 2.0\nx\nASCII\nDATASET UNSTRUCTURED_GRID\nPOINTS 3 float\n0 0 0 1 0 0 0 1 0\nCELLS 1 4\n3 0 1 2\nCELL_TYPES 1\n5\nPOINT_DATA 3\nSCALARS t double 1\nLOOKUP_TABLE default\n1 2 3\n")
    v, e, s = readers.read_vtk(spark, str(tmp_path / "a.vtk"))
    assert e.first().elt_type == "tria3" and s.count() == 3
    (tmp_path / "p").write_text("3 4 4 1 12 4\n0 0 0 1 0 0 0 1 0 0 0 1\n0 3 6 9 12\n1 3 2 1 2 4 1 4 3 2 3 4\n0 4\n1 2 3 4\n")
    _, faces, cells = readers.read_polyhedra(spark, str(tmp_path / "p"))
    assert mesh.classified(cells, faces).first().elt_type == "tetra4"
    out = writers.EnsightWriter(str(tmp_path / "out"), "case")
    v, e = generators.grid_vertices(spark, 2, 1), generators.grid_quads(spark, 2, 1)
    out.begin_step(0.5)
    out.write_mesh(v, e)
    out.write_field("f", linear(v))
    out.write_status("f", v, spark.createDataFrame([(1, 1)], "tgt_gnum long, src_gnum long"))
    assert out.due(0) and "f_status" in open(out.close()).read()
    geometry = (tmp_path / "out" / "case.geo").read_text().split("\n")
    assert "quad4" in geometry and len((tmp_path / "out" / "case.f.00000").read_text().strip().split("\n")) == 4 + 6
    writers.write_text(e, str(tmp_path / "t"), "gnum")
    writers.write_parquet(e, str(tmp_path / "q"))
    assert spark.read.text(str(tmp_path / "t")).count() == spark.read.parquet(str(tmp_path / "q")).count() == 2


def test_steps(spark, small, tmp_path):
    session, seen = Session(spark, ["a", "b"]), []
    events = spark.read.parquet(f"{small}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    steps.run_steps(stream, session, "a", lambda batch, step: seen.append((step, batch.count())), str(tmp_path / "state")).awaitTermination()
    assert [s for s, _ in seen] == [0, 1, 2] and sum(n for _, n in seen) == events.count() and session.step == 2 and not session.in_step
    session.set_state("a", "end")
    assert session.state("a") == "end"
    with pytest.raises(CouplingError):
        session.set_state("a", "asleep")


def test_tessellations(spark):
    v, e = generators.hexagons(spark, 2, 2)
    cells = mesh.measured(mesh.cells(v, e))
    triangles = mesh.cut_to_triangles(cells)
    parts = mesh.measured(mesh.cells(v, triangles.withColumn("gnum", F.col("gnum") * 10 + F.col("sub")).withColumn("elt_type", F.lit("tria3"))))
    assert triangles.count() == 16 and parts.agg(F.sum("volume")).first()[0] == pytest.approx(cells.agg(F.sum("volume")).first()[0])
    boxes = mesh.cells(generators.box_vertices(spark, 2), generators.box_hexas(spark, 2))
    got = [np.array(r.points) for r in mesh.tessellated(boxes).collect()]
    assert len(got) == 8 * 24 and sum(abs(np.linalg.det(t[1:] - t[0])) / 6 for t in got) == pytest.approx(1)
    made = location.locate(spark.createDataFrame([(1, 0.1, 0.1, 0.1)], "gnum long, x double, y double, z double"), boxes)
    values = exchange.field_of_elements(made, generators.box_vertices(spark, 2).select("gnum", F.array("x").alias("value"))).first().values
    assert [x[0] for x in values] == [0, 0.5, 0.5, 0, 0, 0.5, 0.5, 0]


def test_meshes_that_change_and_output(spark, tmp_path):
    session = Session(spark, ["a", "b"])
    points = generators.grid_vertices(spark, 3, 3)
    still, moving = (session.couple(CouplingSpec(n, "a", "b", method="identity", displacement=d)) for n, d in (("s", "static"), ("m", "deformable")))
    writer = writers.EnsightWriter(str(tmp_path / "out"), "case", frequency=2)
    for cpl in (still, moving):
        cpl.set_source(points=points)
        cpl.set_targets(points)
        cpl.field("f").data = linear(points)
    moving.enable_output(writer, points, generators.grid_quads(spark, 3, 3))
    for step in range(3):
        session.step_begin("a", 0.5 * step)
        assert moving.mapping is None
        moving.set_source(points=points.where(f"gnum <> {step}"))
        assert [r.gnum for r in moving.exchange("f").where("value is null").collect()] == [step]
        assert still.exchange("f").where("value is null").count() == 0 and still.mapping is not None
        with pytest.raises(CouplingError):
            still.set_targets(points)
        session.step_end("a")
    files = [f"case.{x}.0000{k}" for x in ("f", "f_status", "geo") for k in (0, 1)]
    assert writer.times == [0.0, 1.0] and sorted(p.name for p in (tmp_path / "out").iterdir()) == files
    writer.close()
    case = (tmp_path / "out" / "case.case").read_text()
    assert "model: 1 case.geo.*****" in case and "number of steps: 2" in case


def test_overlap_fills_with_zeros_and_storage_is_kept(spark):
    cpl = Session(spark, ["a", "b"]).couple(CouplingSpec("c", "a", "b", method="intersection"))
    cells = mesh.cells(generators.grid_vertices(spark, 2, 2), generators.grid_quads(spark, 2, 2))
    cpl.set_source(cells=cells.where("gnum < 2"))
    cpl.set_targets(cells)
    data = cells.select("gnum", F.array("cx", F.lit(1.0)).alias("value"))
    cpl.field("f", n_components=2, source_dof="cell", target_dof="cell", storage="interleaved").data = interpolate.interleaved(data)
    got = {(r.component, r.gnum): r.value for r in cpl.exchange("f").collect()}
    assert got == {(c, g): pytest.approx(0 if g > 1 else 1 if c else 0.25 + 0.5 * g) for c in (0, 1) for g in range(4)}
    numbers = spark.createDataFrame([(1, [1.9, -2.5, 1e12])], "gnum long, value array<double>")
    assert interpolate.converted(numbers, "int").first().value == [1, -2, None] and interpolate.converted(numbers, "long").first().value[2] == 10**12
    assert interpolate.of_parents(spark.createDataFrame([(5, 1), (6, 9)], "gnum long, parent long"), numbers).orderBy("gnum").collect()[1].value is None


def test_more_generators(spark):
    for (v, e), want in ((generators.ball(spark, 6), 4 / 3 * np.pi), (generators.box_pyramids(spark, generators.box_vertices(spark, 2), 2), 1.0), ((generators.box_vertices(spark, 2), generators.box_prisms(spark, 2)), 1.0)):
        made = mesh.measured(mesh.cells(v, e))
        assert made.agg(F.sum("volume")).first()[0] == pytest.approx(want, rel=0.1) and made.where("volume <= 0").count() == 0
    assert mesh.measured(mesh.cells(*generators.n_gon(spark, 6, 3))).agg(F.sum("volume")).first()[0] == pytest.approx(1.5 * 3**0.5)


def test_unknown_sections_are_refused(spark, tmp_path):
    (tmp_path / "q.mesh").write_text("MeshVersionFormatted 2\nDimension 2\nVertices 3\n0 0 0\n1 0 0\n2 0 0\nCorners 1\n1\nEdgesP2 1\n1 3 2 0\nEnd\n")
    assert readers.read_mesh(spark, str(tmp_path / "q.mesh"))[1].first().elt_type == "ho_edge"
    (tmp_path / "u.mesh").write_text("MeshVersionFormatted 2\nDimension 2\nWedges 1\n1 2 3\nEnd\n")
    with pytest.raises(ValueError):
        readers.read_mesh(spark, str(tmp_path / "u.mesh"))


def test_closest_cell_beside_cells_a_hundred_thousand_times_larger(spark):
    """9 cells of edge 100, and 90,000 of edge 0.0003 in the corner of one: targets in the large ones do not meet the small."""
    large = generators.grid_vertices(spark, 3, 3, high=(300.0, 300.0))
    small = generators.grid_vertices(spark, 300, 300, low=(0.0, 0.0), high=(0.09, 0.09)).withColumns({"gnum": F.col("gnum") + 1000, "z": F.lit(0.001)})
    vertices = large.unionByName(small)
    quads = generators.grid_quads(spark, 300, 300).withColumns({"gnum": F.col("gnum") + 1000, "connec": F.transform("connec", lambda v: v + 1000)})
    cells = mesh.cells(vertices, generators.grid_quads(spark, 3, 3).unionByName(quads))
    rng = np.random.default_rng(3)
    at = rng.uniform(0, 300, (1000, 2)).tolist()
    targets = spark.createDataFrame([(i, x, y, 0.0) for i, (x, y) in enumerate(at)], "gnum long, x double, y double, z double")
    got = {r.tgt_gnum: r for r in location.closest(targets, cells).collect()}
    assert len(got) == 1000 and all(r.dist2 < 1e-12 and r.src_gnum == int(at[g][1] // 100) * 3 + int(at[g][0] // 100) for g, r in got.items())


def test_inner_edges_are_flipped_until_delaunay():
    rng = np.random.default_rng(6)
    for m in (4, 5, 8, 14, 25):
        for _ in range(12):
            angle = np.sort(rng.uniform(0, 2 * np.pi, m))
            flat = np.c_[np.cos(angle), np.sin(angle)] * rng.uniform(0.3, 1, (m, 1)) * [1, 2]
            area = lambda t: float(np.cross(np.r_[flat[t[1]] - flat[t[0]], 0], np.r_[flat[t[2]] - flat[t[0]], 0])[2]) / 2
            if float((flat[:, 0] * np.roll(flat[:, 1], -1) - np.roll(flat[:, 0], -1) * flat[:, 1]).sum()) <= 0:
                continue
            before = shapes.ear_clip(flat)
            if min(map(area, before)) <= 1e-9:
                continue
            after = shapes.delaunay(flat, before)
            assert len(after) == m - 2 and min(map(area, after)) > 0 and sum(map(area, after)) == pytest.approx(sum(map(area, before)))
            owner = {(t[i], t[(i + 1) % 3]): t for t in after for i in range(3)}
            for (a, b), t in owner.items():
                if (b, a) in owner:
                    c, d = (next(v for v in x if v not in (a, b)) for x in (t, owner[b, a]))
                    convex = min(area((c, d, b)), area((d, c, a))) > 1e-12
                    assert not convex or shapes.in_circle(flat[a], flat[b], flat[c], flat[d]) <= 1e-9
