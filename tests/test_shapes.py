"""Kernels: partition of unity, linear reproduction, closest points, measures."""

import numpy as np
import pytest

from meshweave.functions import shapes

RNG = np.random.default_rng(3)
LINEAR = np.array([0.7, -1.3, 2.1])


def jittered(corners, n=50, by=0.08):
    return corners[None] + RNG.uniform(-by, by, (n, *corners.shape))


CELLS = {
    "tetra4": np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]], float),
    "pyram5": np.array([[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0], [0, 0, 1]], float),
    "prism6": shapes.CORNERS["prism6"],
    "hexa8": shapes.CORNERS["hexa8"],
}


@pytest.mark.parametrize("kind", CELLS)
def test_volume_cells_reproduce_linear_fields(kind):
    v = jittered(CELLS[kind])
    inside = RNG.dirichlet(np.ones(v.shape[1]), len(v))
    p = np.einsum("nm,nmk->nk", 0.5 * inside + 0.5 / v.shape[1], v)
    w, near, d2, _ = shapes.located(kind, p, v)
    assert np.allclose(w.sum(axis=1), 1) and (w > -1e-9).all() and np.allclose(near, p, atol=1e-8) and (d2 < 1e-14).all()
    assert np.allclose(np.einsum("nm,nm->n", w, v @ LINEAR), p @ LINEAR, atol=1e-8)
    far = p + np.array([4.0, 0, 0])
    assert (shapes.located(kind, far, v)[2] > 1).all()


@pytest.mark.parametrize("m", [3, 4, 5, 8])
def test_polygons_reproduce_linear_fields(m):
    a = np.linspace(0, 2 * np.pi, m, endpoint=False)
    flat = np.stack([np.cos(a), np.sin(a), 0 * a], axis=1)
    tilt = np.linalg.qr(RNG.normal(size=(3, 3)))[0]
    v = np.repeat((flat @ tilt)[None], 200, axis=0)
    uv = RNG.uniform(-1.4, 1.4, (200, 2))
    p = np.concatenate([uv, np.zeros((200, 1))], axis=1) @ tilt
    w, near, d2, _ = shapes.polygon(p, v)
    assert np.allclose(w.sum(axis=1), 1) and (w > -1e-9).all()
    assert np.allclose(np.einsum("nm,nmk->nk", w, v), near, atol=1e-9)
    inside = d2 < 1e-18
    assert 20 < inside.sum() < 180 and np.allclose(near[inside], p[inside], atol=1e-9)
    dense = np.array([np.einsum("m,mk->k", c, v[0]) for c in RNG.dirichlet(np.ones(m) * 0.3, 4000)])
    for i in np.flatnonzero(~inside)[:20]:
        assert d2[i] <= ((dense - p[i]) ** 2).sum(axis=1).min() + 1e-9
    corner = shapes.polygon(v[0][:1], v[:1])[0][0]
    assert corner.argmax() == 0 and corner[0] == pytest.approx(1)


def test_edges_and_polyhedra():
    v = np.array([[[0, 0, 0], [2, 0, 0]]], float)
    w, near, d2, _ = shapes.edge(np.array([[0.5, 1, 0]]), v)
    assert w[0].tolist() == [0.75, 0.25] and d2[0] == 1
    cube = CELLS["hexa8"][None]
    p = RNG.uniform(0.05, 0.95, (30, 3))
    for x in p:
        w, near, d2, _ = shapes.polyhedron(x[None], cube, shapes.FACES["hexa8"])
        assert w.sum() == pytest.approx(1) and np.allclose(w[0] @ cube[0], x) and d2[0] < 1e-18


@pytest.mark.parametrize("kind", ["ho_edge", "ho_tria", "ho_quad", "ho_tetra", "ho_hexa", "ho_prism", "ho_pyram"])
@pytest.mark.parametrize("order", [1, 2, 3])
def test_high_order_bases(kind, order):
    nodes = np.array(shapes.ho_nodes(kind, order), float) / order
    assert np.allclose(shapes.ho_basis(kind, order, nodes), np.eye(len(nodes)), atol=1e-8)
    u = RNG.dirichlet(np.ones(4), 20)[:, :3] * 0.9
    u[:, {"ho_edge": 1, "ho_tria": 2, "ho_quad": 2}.get(kind, 3) :] = 0
    basis = shapes.ho_basis(kind, order, u)
    assert np.allclose(basis.sum(axis=1), 1) and np.allclose(basis @ nodes, u, atol=1e-8)


def test_curved_triangle_is_located():
    nodes = np.array(shapes.ho_nodes("ho_tria", 2), float) / 2
    curved = nodes.copy()
    curved[:, 2] = 0.3 * nodes[:, 0] * (1 - nodes[:, 0]) + 0.2 * nodes[:, 1] ** 2
    u = RNG.dirichlet(np.ones(3), 40)[:, :3]
    u[:, 2] = 0
    v = np.repeat(curved[None], 40, axis=0)
    p = np.einsum("nm,nmk->nk", shapes.ho_basis("ho_tria", 2, u), v)
    w, near, d2, found = shapes.ho_located("ho_tria", 2, p, v)
    assert (d2 < 1e-12).all() and np.allclose(found[:, :2], u[:, :2], atol=1e-5)


def area(polygon):
    x, y = polygon.T
    return 0.5 * abs(float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()))


def test_overlaps():
    rng = np.random.default_rng(2)
    triangle = np.array([[[0, 0], [1, 0], [0, 1]]], float)
    assert shapes.clipped_areas(triangle + 0.25, triangle)[0] == pytest.approx(0.125)
    assert shapes.clipped_areas(triangle + 2, triangle)[0] == 0 and shapes.clipped_areas(triangle[:0], triangle[:0]).shape == (0,)
    assert shapes.clipped_areas(triangle[:, ::-1] * 3 - 0.5, triangle)[0] == pytest.approx(0.5)
    # a random triangle cut by the two halves of a square that holds it keeps its area
    some = rng.uniform(0, 1, (200, 3, 2))
    halves = [np.broadcast_to(np.array(h, float), (200, 3, 2)) for h in ([[0, 0], [1, 0], [1, 1]], [[0, 0], [1, 1], [0, 1]])]
    assert sum(shapes.clipped_areas(some, h) for h in halves) == pytest.approx([area(t) for t in some], rel=1e-12)
    cube, faces, flat = CELLS["hexa8"], shapes.FACES["hexa8"], shapes.FACES["tetra4"]
    volume = lambda a, fa, b, fb: shapes.overlap_volumes(a[None], fa, b[None], fb)[0]
    assert volume(cube, faces, cube + [0.5, 0.25, 0], faces) == pytest.approx(0.375)
    assert volume(cube, faces, cube + 3, faces) == 0
    tetra = CELLS["tetra4"]
    assert volume(cube, faces, tetra, flat) == volume(tetra, flat, cube, faces) == pytest.approx(1 / 6)
    # conservation: a cell cut by a partition of space keeps its volume
    parts = [volume(tetra, flat, cube * 0.5 + np.array([i, j, k]) * 0.5, faces) for i in range(2) for j in range(2) for k in range(2)]
    assert sum(parts) == pytest.approx(1 / 6, rel=1e-12)
    # a cell with a dent is not its hull: the target is taken apart, too
    dented = np.concatenate([cube, [[0.5, 0.5, 0.7]]])
    dent = [f for f in faces if f != [4, 5, 6, 7]] + [[4, 5, 8], [5, 6, 8], [6, 7, 8], [7, 4, 8]]
    assert volume(cube, faces, dented, dent) == volume(dented, dent, cube, faces) == pytest.approx(0.9)


def sampled(kind, v, n, rng):
    """Points of a cell, by random weights that its corners (or its parameters) allow."""
    u = rng.uniform(0, 1, (n, 3))
    if kind in ("tetra4", "prism6"):
        low = np.sort(u[:, :2], axis=1)
        u[:, :2] = np.stack([low[:, 0], low[:, 1] - low[:, 0]], axis=1)
        if kind == "tetra4":
            w = rng.dirichlet(np.ones(4), n)
            return w @ v
    if kind == "pyram5":
        u[:, :2] *= 1 - u[:, 2:]
    return shapes.shape(kind, u) @ v


@pytest.mark.parametrize("kind", ["tetra4", "pyram5", "prism6", "hexa8"])
@pytest.mark.parametrize("size", [1e-5, 1.0, 1e6])
def test_volume_cells_of_any_size(kind, size):
    rng = np.random.default_rng(4)
    skew = np.array([[1, 0.8, 0.3], [0, 1, -0.5], [0.2, 0, 0.6]])
    v = (CELLS[kind] @ skew) * size + 3 * size
    inside = sampled(kind, v, 200, rng)
    w, near, d2, _ = shapes.located(kind, inside, np.broadcast_to(v, (200, *v.shape)).copy())
    assert np.abs(w.sum(axis=1) - 1).max() < 1e-9 and np.abs(w @ v - inside).max() < 1e-9 * size and d2.max() <= (1e-9 * size) ** 2
    outside = v.mean(axis=0) + rng.normal(0, 1.5 * size, (60, 3))
    w, near, d2, _ = shapes.located(kind, outside, np.broadcast_to(v, (60, *v.shape)).copy())
    assert w.min() > -1e-9 and np.abs(w @ v - near).max() < 1e-7 * size
    cloud = sampled(kind, v, 20000, rng)
    closest = np.array([((cloud - p) ** 2).sum(axis=1).min() for p in outside])
    assert (d2 <= closest + 1e-9 * size**2).all() and (np.sqrt(closest) - np.sqrt(d2) < 0.15 * size).all()


def test_ears_cover_a_polygon_once():
    star = np.array([[np.cos(a) * r, np.sin(a) * r] for a, r in zip(np.linspace(0, 2 * np.pi, 10, endpoint=False), [2, 0.7] * 5, strict=True)])
    for flat in (star, star[::-1].copy(), np.array([[0, 0], [4, 0], [4, 1], [1, 1], [1, 3], [0, 3]], float), np.array([[0, 0], [1, 0], [2, 0], [2, 2], [0, 2]], float)):
        parts = shapes.ear_clip(flat)
        assert len(parts) == len(flat) - 2
        assert sum(area(flat[list(t)]) for t in parts) == pytest.approx(area(flat))
