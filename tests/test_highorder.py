"""Closest points of bent high-order elements against dense samples, and what encloses them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshweave.functions import highorder, shapes
from meshweave.operators import location, mesh

KINDS = list(highorder.DIMENSIONS)


def bent(kind, order, n, seed, by):
    rng = np.random.default_rng(seed)
    nodes = np.array(shapes.ho_nodes(kind, order), float) / order
    return nodes + rng.uniform(-by, by, (n, *nodes.shape)) / order


def samples(kind, per_axis):
    d = highorder.DIMENSIONS[kind]
    t = np.linspace(0, 1, per_axis)
    return highorder.collapsed(kind, np.stack(np.meshgrid(*[t] * d, indexing="ij"), axis=-1).reshape(-1, d))


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_control_points_give_the_element(kind, order):
    d, rng = highorder.DIMENSIONS[kind], np.random.default_rng(1)
    v = bent(kind, order, 1, 2, 0.4)[0]
    control = highorder.to_control(kind, order) @ v
    c = rng.uniform(0, 1, (50, d))
    basis = np.ones((50, 1))
    for a in range(d):
        basis = np.einsum("ni,nj->nij", basis, highorder.bernstein(order, c[:, a])).reshape(50, -1)
    assert np.allclose(basis @ control, shapes.ho_basis(kind, order, highorder.collapsed(kind, c)) @ v, atol=1e-9)
    for axis in range(d):
        for k, half in enumerate(highorder.halved(control[None], axis, order, d)[0]):
            inner = c.copy()
            inner[:, axis] = (inner[:, axis] + k) / 2
            assert np.allclose(basis @ half, shapes.ho_basis(kind, order, highorder.collapsed(kind, inner)) @ v, atol=1e-9)


@pytest.mark.parametrize(("kind", "order", "n", "per_axis"), [("ho_edge", 3, 300, 4000), ("ho_edge", 5, 200, 4000), ("ho_tria", 3, 800, 300), ("ho_quad", 3, 300, 300), ("ho_tria", 2, 300, 300), ("ho_tetra", 3, 120, 48), ("ho_hexa", 2, 60, 48), ("ho_prism", 2, 60, 48), ("ho_pyram", 2, 60, 48)])
def test_nothing_of_a_bent_element_is_closer(kind, order, n, per_axis):
    v = bent(kind, order, 8, 3, 0.9)[np.arange(n) % 8]
    p = np.random.default_rng(4).uniform(-0.6, 1.6, (n, 3))
    weights, near, d2, u = highorder.located(kind, order, p, v)
    assert np.allclose(np.einsum("nm,nmk->nk", weights, v), near) and np.allclose(((p - near) ** 2).sum(axis=1), d2) and np.allclose(weights.sum(axis=1), 1)
    assert np.allclose(shapes.ho_basis(kind, order, u), weights, atol=1e-9)
    inside = highorder.collapsed(kind, np.zeros((1, highorder.DIMENSIONS[kind])))
    assert (u >= inside.min() - 1e-12).all() and (u <= 1 + 1e-12).all()
    basis = shapes.ho_basis(kind, order, samples(kind, per_axis))
    for k in range(8):
        own = np.arange(n) % 8 == k
        at = basis @ v[k]
        dense = np.sqrt(np.array([((at - x) ** 2).sum(axis=1).min() for x in p[own]]))
        assert (np.sqrt(d2[own]) <= dense + 1e-6).all()


def test_points_beyond_reach_are_told_so():
    v = bent("ho_quad", 3, 8, 3, 0.9)[np.arange(400) % 8]
    p = np.random.default_rng(4).uniform(-0.9, 1.9, (400, 3))
    whole, some = (highorder.located("ho_quad", 3, p, v, x)[2] for x in (None, np.full(400, 0.3)))
    near = whole <= 0.3**2
    assert (some[~near] > 0.3**2).all() and np.allclose(np.sqrt(some[near]), np.sqrt(whole[near]), atol=1e-6) and 20 < near.sum() < 200


def test_the_descent_alone_misses_some():
    v = bent("ho_tria", 3, 8, 3, 0.9)[np.arange(800) % 8]
    p = np.random.default_rng(4).uniform(-0.6, 1.6, (800, 3))
    some = shapes.ho_located("ho_tria", 3, p, v, starts_from=1)[2]
    proven = highorder.located("ho_tria", 3, p, v)[2]
    assert (proven <= some + 1e-6).all() and (np.sqrt(proven) < np.sqrt(some) - 1e-3).any()


@pytest.mark.parametrize(("kind", "order"), [("ho_edge", 2), ("ho_tria", 3), ("ho_quad", 3), ("ho_tetra", 2), ("ho_hexa", 2), ("ho_pyram", 2)])
def test_boxes_hold_whole_elements(kind, order):
    u, v = samples(kind, 20), bent(kind, order, 40, 5, 1.5)
    at = np.einsum("sm,nmk->nsk", shapes.ho_basis(kind, order, u), v)
    low, high = v.min(axis=1), v.max(axis=1)
    far = (np.abs(at - ((low + high) / 2)[:, None]) / np.maximum((high - low) / 2, 1e-12)[:, None]).max()
    sizes = np.abs(shapes.ho_basis(kind, order, u)).sum(axis=1).max()
    assert far <= highorder.reach(kind, order) and sizes <= highorder.reach(kind, order) <= 1.5 * sizes


def test_a_bulge_beyond_the_nodes_is_found(spark):
    nodes = [(i, float(x), y, 0.0) for i, (x, y) in enumerate([(0, 0.0), (1, 1.0), (2, 1.0), (3, 0.0)], 1)]
    vertices = spark.createDataFrame(nodes, "gnum long, x double, y double, z double")
    edge = spark.createDataFrame([(1, "ho_edge", 3, [1, 2, 3, 4])], "gnum long, elt_type string, order int, connec array<long>")
    # the cubic through these nodes rises to 1.125 between the two in the middle
    target = spark.createDataFrame([(7, 1.5, 1.1249, 0.0)], "gnum long, x double, y double, z double")
    row = location.locate(target, mesh.cells(vertices, edge), 1e-3).first()
    assert row.proj == pytest.approx([1.5, 1.125, 0], abs=1e-6) and row.dist2 ** 0.5 == pytest.approx(1e-4, abs=1e-7)
    assert location.bulging(mesh.cells(vertices, edge)).where(F.col("ymax") > 1.125).count() == 1
