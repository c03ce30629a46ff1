"""Coincidence within a tolerance and across periodicity, against closures made point by point."""

from collections import defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshweave.functions.periodicity import Periodicity
from meshweave.operators import coincidence, components, mesh
from meshweave.sources import generators

POINTS = "gnum long, x double, y double, z double"


def closure(points, tolerance):
    """Smallest gnum by steps within the tolerance: every pair of points in neighbouring buckets."""
    root = {int(g): int(g) for g, *_ in points}

    def top(g):
        while root[g] != g:
            root[g] = g = root[root[g]]
        return g

    buckets = defaultdict(list)
    for g, *p in points:
        buckets[tuple(int(np.floor(v / tolerance)) for v in p)].append((int(g), np.array(p)))
    for cell, held in buckets.items():
        near = [x for d in product((-1, 0, 1), repeat=3) for x in buckets.get(tuple(a + b for a, b in zip(cell, d, strict=True)), ())]
        ids, at = np.array([g for g, _ in near]), np.array([p for _, p in near])
        for g, p in held:
            for h in ids[((at - p) ** 2).sum(axis=1) <= tolerance**2]:
                a, b = sorted((top(g), top(int(h))))
                root[b] = a
    return {g: top(g) for g in root}


def frame(spark, points):
    return spark.createDataFrame([(int(g), *map(float, p)) for g, *p in points], POINTS)


def of(made):
    return {r.gnum: r.same for r in made.collect()}


def test_components_of_paths_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(10, 300)] + [(1000, i) for i in range(1001, 1300)] + [(2000 + i, 2000 + (i + 7) % 50) for i in range(50)] + [(5, 5), (7, 8), (8, 7), (7, 8)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 10 for i in range(10, 301)} | {i: 1000 for i in range(1000, 1300)} | {2000 + i: 2000 for i in range(50)} | {7: 7, 8: 7}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_points_on_both_sides_of_a_rounding_edge(spark):
    made = frame(spark, [(1, 0.0149, 0, 0), (2, 0.0151, 0, 0), (3, 0.5, 0, 0)])
    assert of(mesh.coincident(made, 0.01)) == {1: 1, 2: 1, 3: 3}
    assert {r.gnum: r.x for r in mesh.gnum_from_coordinates(made.drop("gnum"), merge=True, tolerance=0.01).collect()}.keys() == {1, 2}
    with pytest.raises(ValueError):
        mesh.coincident(made, 1e-17)


def test_equals_the_closure_of_all_pairs(spark):
    rng = np.random.default_rng(0)
    groups = rng.uniform(0, 4, (900, 3))
    crowd = np.array([1.0, 1, 1]) + rng.uniform(-0.004, 0.004, (1700, 3))
    points = np.concatenate([groups, groups[:600] + rng.normal(0, 0.006, (600, 3)), crowd, rng.uniform(0, 1, (1500, 3)) * [3, 0.02, 0.02], groups[:300]])
    rows = [(g, *p) for g, p in zip(rng.permutation(len(points)).tolist(), points.tolist(), strict=True)]
    for tolerance in (0.001, 0.01, 0.05):
        got = of(mesh.coincident(frame(spark, rows), tolerance))
        assert got == closure(rows, tolerance)
    assert 50 < len(set(got.values())) < len(rows) - 1500


def test_two_crowds_that_touch_in_one_pair_or_do_not(spark):
    rng = np.random.default_rng(1)
    for gap, together in ((0.0099, 1), (0.0101, 2)):
        sheet = np.c_[np.zeros(400), rng.uniform(-0.002, 0.002, (400, 2))]
        left, right = sheet - [0.001, 0, 0] - np.c_[rng.uniform(0, 0.002, 400), np.zeros((400, 2))], sheet + [gap + 0.001, 0, 0] + np.c_[rng.uniform(0, 0.002, 400), np.zeros((400, 2))]
        left[7], right[9] = [0, 0.001, 0.001], [gap, 0.001, 0.001]
        rows = [(i, *p) for i, p in enumerate(np.concatenate([left, right]).tolist())]
        got = of(mesh.coincident(frame(spark, rows), 0.01))
        assert got == closure(rows, 0.01) and len(set(got.values())) == together


def test_a_hundred_thousand_jittered_points(spark):
    rng = np.random.default_rng(2)
    base = rng.uniform(0, 10, (25_000, 3))
    points = np.concatenate([base + rng.normal(0, 0.004, base.shape) for _ in range(4)])
    rows = [(i, *p) for i, p in enumerate(points.tolist())]
    assert of(mesh.coincident(spark.createDataFrame(rows, POINTS).repartition(8), 0.01)) == closure(rows, 0.01)


def test_missing_coordinates_and_empty_tables(spark):
    made = spark.createDataFrame([(1, None, 0.0, 0.0), (2, None, 0.0, 0.0), (3, 0.0, 0.0, 0.0), (4, -0.0, 0.0, 0.0), (5, float("nan"), 0.0, 0.0)], POINTS)
    for tolerance in (0.0, 0.1):
        assert of(mesh.coincident(made, tolerance)) == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5}
        assert mesh.coincident(made.limit(0), tolerance).count() == 0


def test_faces_of_tiny_and_of_large_meshes(spark):
    for scale in (1e-9, 1.0, 1e9):
        v = generators.box_vertices(spark, 2).withColumns({a: F.col(a) * scale + scale / 3 for a in "xyz"})
        faces = generators.box_hexas(spark, 2).select("gnum", F.posexplode(F.array(*(F.array(*(F.col("connec")[i] for i in f)) for f in ([0, 3, 2, 1], [4, 5, 6, 7], [0, 1, 5, 4], [1, 2, 6, 5], [2, 3, 7, 6], [3, 0, 4, 7])))).alias("side", "connec"))
        numbered = mesh.gnum_of_faces(faces.select((F.col("gnum") * 6 + F.col("side")).alias("face"), "connec"), v)
        assert numbered.count() == 48 and sorted(r["count"] for r in numbered.groupBy("gnum").count().collect()) == [1] * 24 + [2] * 12


def test_group_of_transforms():
    moves = Periodicity()
    a, b, c = moves.add_translation((1, 0, 0), 1), moves.add_translation((0, 2, 0), 2), moves.add_rotation(90, (0, 0, 1), (0, 0, 0), 3)
    assert (a, b, c) == (0, 2, 4) and [moves.reverse(i) for i in range(6)] == [1, 0, 3, 2, 5, 4]
    assert moves.known[5].external == -3 and moves.id_of(-2) == 3
    moves.combined()
    square = lambda i: np.vstack([moves.known[i].matrix, [0, 0, 0, 1]])
    for i, x in enumerate(moves.known):
        assert np.allclose(square(moves.reverse(i)) @ square(i), np.eye(4), atol=1e-9)
        parts = moves.components(i)
        made = np.eye(4)
        for k in parts:
            made = square(k) @ made
        assert np.allclose(made, square(i)) and len(parts) == x.level + 1 and len({k // 2 for k in parts}) == len(parts)
    # every way of doing two or three different ones is there once
    for n in (2, 3):
        for way in product(range(6), repeat=n):
            if len({k // 2 for k in way}) == n:
                made = np.eye(4)
                for k in way:
                    made = square(k) @ made
                assert sum(np.allclose(m, made[:3], atol=1e-8) for m in moves.transforms().values()) == 1
    with pytest.raises(ValueError):
        moves.combined()
    with pytest.raises(ValueError):
        Periodicity().add([[2, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0]], 1)
    twice = Periodicity()
    twice.add_translation((1, 0, 0), 1)
    again = twice.add_translation((1, 0, 0), 2)
    assert twice.known[again].same_as == 0 and len(twice.transforms()) == 2


def brute_links(points, near, moves, tolerance):
    out = set()
    at = np.array([p for _, *p in points])
    for tr, m in moves.transforms().items():
        image = at @ m[:, :3].T + m[:, 3]
        for (g, *_), p in zip(points, image, strict=True):
            for k in np.flatnonzero(((at - p) ** 2).sum(axis=1) <= tolerance**2):
                out.add((near[g], tr, near[points[k][0]]))
    return out


def test_a_periodic_box_and_a_turned_sector(spark):
    rng = np.random.default_rng(3)
    box = [(r.gnum, *(np.array([r.x, r.y, r.z]) + rng.uniform(-1e-3, 1e-3, 3)).tolist()) for r in generators.box_vertices(spark, 3).orderBy("gnum").collect()]
    moves = Periodicity()
    for k, shift in enumerate(np.eye(3).tolist(), 1):
        moves.add_translation(tuple(shift), k)
    moves.combined()
    assert len(moves.transforms()) == 26 and len(moves.transforms(0)) == 6
    made = frame(spark, box)
    got = {tuple(r) for r in coincidence.periodic_links(made, moves, 0.01).collect()}
    want = brute_links(box, closure(box, 0.01), moves, 0.01)
    assert got == want and {(o, moves.reverse(t), g) for g, t, o in got} == got
    corner = {g for g, *p in box if all(abs(v - round(v)) < 0.01 and round(v) in (0, 1) for v in p)}
    same = of(coincidence.periodic_classes(made, moves, 0.01))
    assert len(corner) == 8 and {same[g] for g in corner} == {min(corner)} and len(set(same.values())) == 27
    sector = [(i, r * np.cos(t), r * np.sin(t), 0.0) for i, (r, t) in enumerate(product((0.5, 1.0, 1.5), np.radians([0, 10, 20, 30])))]
    turn = Periodicity()
    turn.add_rotation(30, (0, 0, 1), (0, 0, 0), 1)
    got = {tuple(r) for r in coincidence.periodic_links(frame(spark, sector), turn, 1e-6).collect()}
    assert got == brute_links(sector, closure(sector, 1e-6), turn, 1e-6) and len([x for x in got if x[1] == 0]) == 3


def test_a_crowd_meets_the_image_of_a_crowd(spark):
    rng = np.random.default_rng(4)
    left = rng.uniform(-0.004, 0.004, (1500, 3))
    rows = [(i, *p) for i, p in enumerate(np.concatenate([left, rng.uniform(-0.004, 0.004, (1500, 3)) + [1, 0.012, 0]]).tolist())]
    moves = Periodicity()
    moves.add_translation((1, 0, 0), 1)
    got = {tuple(r) for r in coincidence.periodic_links(frame(spark, rows), moves, 0.01).collect()}
    assert got == brute_links(rows, closure(rows, 0.01), moves, 0.01) == {(0, 0, 1500), (1500, 1, 0)}
