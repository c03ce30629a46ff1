"""Mesh files against a plain parse of the same text, in files that are split and words that run over lines."""

import numpy as np
import pytest

from meshweave.operators import mesh
from meshweave.sources import generators, readers


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_split_mesh_file_in_any_layout(spark, tmp_path):
    rng = np.random.default_rng(0)
    points = rng.uniform(-1, 1, (3000, 3)).round(6)
    tria, quad = rng.integers(1, 3001, (4000, 3)), rng.integers(1, 3001, (900, 16))
    numbers = lambda a: "\n".join(" ".join(map(str, [*r, 0])) for r in a.tolist())
    text = f"MeshVersionFormatted 2\n\nDimension\n3\nVertices\n{len(points)}\n{numbers(points)}\nCorners 2\n1\n2\nTriangles {len(tria)}\n{numbers(tria)}\nQuadrilateralsQ3\n{len(quad)} {numbers(quad)}\nEnd\nNothing 1\n"
    want_v = [(i + 1, *p) for i, p in enumerate(points.tolist())]
    want_e = [(i + 1, "tria3", 1, c) for i, c in enumerate(tria.tolist())] + [(len(tria) + i + 1, "ho_quad", 3, c) for i, c in enumerate(quad.tolist())]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        for name, layout in (("a", text), ("b", text.replace("\n", " \n\n").replace(" 0 \n", "\n 0\n"))):
            (tmp_path / f"{name}.mesh").write_text(layout)
            assert spark.read.text(str(tmp_path / f"{name}.mesh")).rdd.getNumPartitions() > 4
            v, e = readers.read_mesh(spark, str(tmp_path / f"{name}.mesh"))
            assert rows(v) == want_v and rows(e) == want_e
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "short.mesh").write_text("MeshVersionFormatted 2\nDimension")
    with pytest.raises(ValueError):
        readers.read_mesh(spark, str(tmp_path / "short.mesh"))


def test_polyhedra_come_back_from_their_file(spark, tmp_path):
    vertices, hexas = generators.box_vertices(spark, 3), generators.box_hexas(spark, 3).orderBy("gnum").collect()
    number, faces, cells = {}, [], []
    for r in hexas:
        own = []
        for f in ([0, 3, 2, 1], [4, 5, 6, 7], [0, 1, 5, 4], [1, 2, 6, 5], [2, 3, 7, 6], [3, 0, 4, 7]):
            walk = [r.connec[i] + 1 for i in f]
            key = tuple(sorted(walk))
            if key in number:
                own.append(-number[key])
            else:
                number[key] = len(faces) + 1
                faces.append(walk)
                own.append(len(faces))
        cells.append(own)
    index = lambda lists, base: np.cumsum([base, *map(len, lists)]).tolist()
    at = [(r.x, r.y, r.z) for r in vertices.orderBy("gnum").collect()]
    flat = lambda lists: " ".join(str(x) for c in lists for x in c)
    for base in (0, 1):
        text = f"3 {len(at)} {len(faces)} {len(cells)} {sum(map(len, faces))} {sum(map(len, cells))}\n{flat(at)}\n{' '.join(map(str, index(faces, base)))}\n{flat(faces)}\n{' '.join(map(str, index(cells, base)))}\n{flat(cells)}\n"
        (tmp_path / f"p{base}").write_text(text)
        v, f, c = readers.read_polyhedra(spark, str(tmp_path / f"p{base}"))
        assert rows(v) == [(i + 1, *p) for i, p in enumerate(at)] and rows(f) == [(i + 1, x) for i, x in enumerate(faces)]
        assert rows(c) == sorted((i + 1, x) for i, own in enumerate(cells) for x in own)
    made = mesh.from_cell_faces(c, f)
    assert made.where("elt_type = 'hexa8'").count() == 27


def test_vtk_cells_of_several_kinds(spark, tmp_path):
    text = "# vtk DataFile Version 2.0\na title with 3 words\nASCII\nDATASET UNSTRUCTURED_GRID\nPOINTS 5 float\n0 0 0 1 0 0\n0 1 0 0 0 1 1 1 0\nCELLS 3 13\n3 0 1 2\n4 0 1 4 2\n3 0 1 3\nCELL_TYPES 3\n5\n9\n5\nPOINT_DATA 5\nSCALARS 7heat double 1\nLOOKUP_TABLE default\n1 2 3\n4 5e-1\n"
    (tmp_path / "a.vtk").write_text(text)
    v, e, s = readers.read_vtk(spark, str(tmp_path / "a.vtk"))
    assert rows(v)[4] == (5, 1.0, 1.0, 0.0) and rows(e) == [(1, "tria3", 1, [1, 2, 3]), (2, "quad4", 1, [1, 2, 5, 3]), (3, "tria3", 1, [1, 2, 4])]
    assert rows(s) == [(i + 1, "7heat", x) for i, x in enumerate([1.0, 2.0, 3.0, 4.0, 0.5])]
    (tmp_path / "b.vtk").write_text(text.replace("3 0 1 2\n4 0", "3 0 1 2 4 0"))
    with pytest.raises(ValueError, match="a line each"):
        readers.read_vtk(spark, str(tmp_path / "b.vtk"))
    (tmp_path / "c.vtk").write_text(text.replace("\n9\n", "\n99\n"))
    with pytest.raises(ValueError, match="99"):
        readers.read_vtk(spark, str(tmp_path / "c.vtk"))
