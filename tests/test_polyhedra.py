"""Polyhedra that are not star-shaped, and standard cells made from their faces."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshweave.functions import shapes
from meshweave.operators import location, mesh
from meshweave.sources import generators

RNG = np.random.default_rng(12)
U_PLAN = [(0, 0), (3, 0), (3, 3), (2, 3), (2, 1), (1, 1), (1, 3), (0, 3)]


def in_u(q):
    x, y, z = q.T
    whole = (x > 0) & (x < 3) & (y > 0) & (y < 3) & (z > 0) & (z < 1)
    return whole & ~((x > 1) & (x < 2) & (y > 1))


def u_cell():
    """A solid of the shape of a U; its concave ends are cut into convex faces."""
    n = len(U_PLAN)
    v = np.array([(*q, z) for z in (0, 1) for q in U_PLAN], float)
    plan = [[0, 1, 4, 5], [1, 2, 3, 4], [0, 5, 6, 7]]
    sides = [[i, (i + 1) % n, (i + 1) % n + n, i + n] for i in range(n)]
    return v, [f[::-1] for f in plan] + [[i + n for i in f] for f in plan] + sides


@pytest.mark.parametrize("scale", [1e-6, 1.0, 1e6])
def test_a_cell_that_is_not_star_shaped(scale):
    v, faces = u_cell()
    q = RNG.uniform(-0.5, 3.5, (600, 3)) * [1, 1, 0.5]
    p, cells = q * scale, np.repeat(v[None] * scale, len(q), axis=0)
    turns, _ = shapes.mean_values(q, np.repeat(v[None], len(q), axis=0), faces)
    assert np.allclose(turns, in_u(q), atol=1e-9)
    weights, near, d2, _ = shapes.polyhedron(p, cells, faces)
    inside = in_u(q)
    assert 100 < inside.sum() < 500 and (d2[inside] == 0).all() and (d2[~inside] > 0).all()
    assert np.allclose(weights.sum(axis=1), 1) and np.allclose(np.einsum("nm,nmk->nk", weights, cells) / scale, near / scale, atol=1e-9)
    assert np.allclose(near[inside], p[inside])
    field = 1 + 2 * v[:, 0] - v[:, 1] + 3 * v[:, 2]
    assert np.allclose(weights[inside] @ field, (1 + q @ [2, -1, 3])[inside], atol=1e-9)
    # of the outside points the distance to the U is that to the nearest of dense samples of its faces
    a, b = (x.ravel()[:, None] for x in np.meshgrid(np.linspace(0, 1, 60), np.linspace(0, 1, 60)))
    boundary = np.concatenate([(1 - a) * (1 - b) * v[f[0]] + a * (1 - b) * v[f[1]] + a * b * v[f[2]] + (1 - a) * b * v[f[3]] for f in faces])
    for x, d in zip(q[~inside][:60], np.sqrt(d2[~inside][:60]) / scale, strict=True):
        assert d == pytest.approx(np.sqrt(((boundary - x) ** 2).sum(axis=1).min()), abs=0.03)


def test_points_on_corners_edges_and_faces():
    v, faces = u_cell()
    on = np.concatenate([v, (v[[0, 1, 4]] + v[[1, 2, 5]]) / 2, [[0.5, 0.5, 0], [3, 1.7, 0.2], [1, 2, 0.5]]])
    weights, near, d2, _ = shapes.polyhedron(on, np.repeat(v[None], len(on), axis=0), faces)
    assert (d2 < 1e-20).all() and np.allclose(weights @ v, on, atol=1e-9) and np.allclose(weights[:16], np.eye(16), atol=1e-9)
    close = on + 1e-7 * (np.array([0.5, 0.5, 0.5]) - on)
    weights, near, d2, _ = shapes.polyhedron(close, np.repeat(v[None], len(on), axis=0), faces)
    assert np.allclose(weights @ v, near, atol=1e-8)


def test_convex_cells_agree_with_their_own_kernels():
    for kind in ("tetra4", "pyram5", "prism6", "hexa8"):
        v = {"tetra4": np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]], float), "pyram5": np.array([[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0], [0.5, 0.5, 1]]), "prism6": shapes.CORNERS["prism6"], "hexa8": shapes.CORNERS["hexa8"]}[kind]
        p = RNG.uniform(-0.3, 1.3, (200, 3))
        a, b = shapes.located(kind, p, np.repeat(v[None], 200, axis=0)), shapes.polyhedron(p, np.repeat(v[None], 200, axis=0), shapes.FACES[kind])
        assert np.allclose(a[2], b[2], atol=1e-9) and np.allclose(a[1], b[1], atol=1e-6)
        if kind == "tetra4":
            assert np.allclose(a[0], b[0], atol=1e-7)


def dissolved(spark, vertices, elements, seed=0, signs=True):
    """Cell to face and face to vertex tables of standard cells, faces shared, numbered and walked at random."""
    rng = np.random.default_rng(seed)
    known, cells = {}, []
    for r in elements.collect():
        for face in shapes.FACES[r.elt_type]:
            own = [r.connec[i] for i in face]
            key = tuple(sorted(own))
            if key not in known:
                turned = own if rng.random() < 0.5 else own[::-1]
                k = int(rng.integers(len(own)))
                known[key] = (len(known) + 1, turned[k:] + turned[:k])
            number, walk = known[key]
            i, j = own.index(walk[0]), own.index(walk[1])
            outward = (i + 1) % len(own) == j
            cells.append((r.gnum, number if outward or not signs else -number))
    order = rng.permutation(len(cells))
    return spark.createDataFrame([cells[i] for i in order], "cell long, face long"), spark.createDataFrame(list(known.values()), "face long, connec array<long>")


@pytest.mark.parametrize("kind", ["tetras", "pyramids", "prisms", "hexas"])
def test_cells_come_back_from_their_faces(spark, kind):
    if kind == "pyramids":
        vertices, elements = generators.box_pyramids(spark, generators.box_vertices(spark, 2), 2)
    else:
        vertices, elements = generators.box_vertices(spark, 2), getattr(generators, f"box_{kind}")(spark, 2)
    want = {r.gnum: (r.elt_type, sorted(r.connec), r.volume) for r in mesh.measured(mesh.cells(vertices, elements)).collect()}
    for signs in (True, False):
        made = mesh.from_cell_faces(*dissolved(spark, vertices, elements, 1, signs), None if signs else vertices)
        got = {r.gnum: (r.elt_type, sorted(r.connec), pytest.approx(r.volume)) for r in mesh.measured(mesh.cells(vertices, made)).collect()}
        assert got == {k: v for k, v in want.items()} and all(v[2] > 0 for v in want.values())
    # edges and faces of the lists are those of the cell
    first = elements.first()
    own = mesh.from_cell_faces(*dissolved(spark, vertices, elements.where(F.col("gnum") == first.gnum), 3)).first()
    faces_of = lambda c: {frozenset(c[i] for i in f) for f in shapes.FACES[first.elt_type]}
    assert faces_of(own.connec) == faces_of(first.connec)


def test_what_is_no_standard_cell_is_a_polyhedron(spark):
    v, faces = u_cell()
    # two triangles that touch, and three quads: no prism
    odd = [[1, 2, 3], [1, 4, 5], [2, 1, 5, 6], [3, 2, 6, 4], [1, 3, 4, 6]]
    tables = [(f"{k}", [x + 1 for x in f]) for k, f in enumerate(faces)]
    rows = [(i + 1, c) for i, (_, c) in enumerate(tables)] + [(100 + i, c) for i, c in enumerate(odd)]
    owned = [(7, i + 1) for i in range(len(faces))] + [(8, 100 + i) for i in range(5)]
    made = {r.gnum: r for r in mesh.from_cell_faces(spark.createDataFrame(owned, "cell long, face long"), spark.createDataFrame(rows, "face long, connec array<long>")).collect()}
    assert made[8].elt_type == made[7].elt_type == "poly3d" and made[7].connec == list(range(1, 17))
    assert [[made[7].connec[i] for i in f] for f in made[7].faces] == [c for _, c in tables]
    vertices = spark.createDataFrame([(i + 1, *map(float, x)) for i, x in enumerate(v)], "gnum long, x double, y double, z double")
    cell = mesh.cells(vertices, spark.createDataFrame([made[7]], "gnum long, elt_type string, connec array<long>, faces array<array<int>>"))
    assert mesh.measured(cell).first().volume == pytest.approx(7)
    targets = spark.createDataFrame([(1, 0.5, 2.5, 0.5), (2, 1.5, 2.0, 0.5), (3, 2.9, 2.9, 0.9)], "gnum long, x double, y double, z double")
    assert {r.tgt_gnum for r in location.locate(targets, cell).collect()} == {1, 3}


def test_cells_of_all_kinds_are_measured_in_one_batch(spark):
    v, faces = u_cell()
    places = [(i + 1, *map(float, x)) for i, x in enumerate(v)] + [(100 + i, *map(float, x)) for i, x in enumerate(shapes.CORNERS["hexa8"])]
    vertices = spark.createDataFrame([*places, (200, None, 0.0, 0.0)], "gnum long, x double, y double, z double")
    rows = [
        (1, "poly3d", list(range(1, 17)), faces), (2, "hexa8", list(range(100, 108)), None), (3, "tetra4", [100, 101, 103, 104], None),
        (4, "quad4", [100, 101, 102, 103], None), (5, "edge2", [100, 106], None), (6, "node", [100], None), (7, "tria3", [100, 103, 101], None),
        (8, "tetra4", [100, 101, 103, 999], None), (9, "tria3", [100, 101, 200], None), (10, "poly3d", [100, 101, 103, 104], None),
        (11, "poly3d", [100, 101, 103, 104], [[0, 2, 1], [0, 1]]), (12, "tria3", [100, 100, 100], None),
    ]
    elements = spark.createDataFrame(rows, "gnum long, elt_type string, connec array<long>, faces array<array<int>>").coalesce(1)
    got = {r.gnum: (r.volume, r.nz) for r in mesh.measured(mesh.cells(vertices, elements)).collect()}
    none = (None, None)
    want = {1: (7, None), 2: (1, None), 3: (1 / 6, None), 4: (1, 1), 5: (3**0.5, None), 6: (0, None), 7: (0.5, -1), 8: none, 9: none, 10: none, 11: none, 12: (0, None)}
    assert {k: tuple(x if x is None else pytest.approx(x) for x in v) for k, v in want.items()} == got


def test_layers_of_hexagons_share_their_faces(spark):
    vertices, hexagons = generators.hexagons(spark, 3, 2)
    area = mesh.measured(mesh.cells(vertices, hexagons)).agg(F.sum("volume")).first()[0]
    points, faces, cell_faces = mesh.solids(vertices, hexagons, 3, 1.5)
    n = hexagons.count()
    sides = cell_faces.groupBy(F.abs("face").alias("face")).agg(F.count("*").alias("n"), F.sum(F.signum("face")).alias("both"))
    assert {(r.n, r.both) for r in sides.collect()} <= {(2, 0.0), (1, 1.0), (1, -1.0)} and sides.count() == faces.count()
    # every lid between two layers has two cells, those at both ends have one
    lids = faces.where(F.size("connec") == 6).join(sides, "face").groupBy("n").count().collect()
    assert {r.n: r["count"] for r in lids} == {1: 2 * n, 2: 2 * n}
    cells = mesh.measured(mesh.cells(points, mesh.from_cell_faces(cell_faces, faces)))
    got = cells.agg(F.sum("volume"), F.min("volume"), F.count("*")).first()
    assert got[0] == pytest.approx(area * 1.5) and got[1] > 0 and got[2] == 3 * n and cells.where("elt_type <> 'poly3d'").count() == 0
    with pytest.raises(ValueError):
        mesh.solids(vertices, hexagons, 0, 1.0)
