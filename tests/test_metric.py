"""Nearest neighbours in many dimensions against all distances."""

import numpy as np
import pytest

from meshweave.operators import exchange, metric
from meshweave.plans import durable


def brute(queries, data, k, others=False):
    out = []
    for q, v in queries:
        d = sorted((float(np.sqrt(((np.array(x) - v) ** 2).sum())), g) for g, x in data if not (others and g == q))
        out += [(q, g, rank, x) for rank, (x, g) in enumerate(d[:k], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(int(g), [float(x) for x in v]) for g, v in rows], "gnum long, v array<double>")


def held(made, want):
    got = sorted(tuple(r) for r in made.collect())
    assert [r[:3] for r in got] == [r[:3] for r in want] and [r[3] for r in got] == pytest.approx([r[3] for r in want], rel=1e-9)


def test_equals_all_distances_in_many_dimensions(spark):
    rng = np.random.default_rng(0)
    middles = rng.normal(size=(12, 24)) * 4
    vectors = np.concatenate([middles[rng.integers(12, size=700)] + rng.normal(size=(700, 24)) * rng.choice([0.05, 1.0], (700, 1)), np.repeat(middles[:1], 80, axis=0)])
    data = list(enumerate(vectors))
    queries = [(10_000 + i, v) for i, v in enumerate(np.concatenate([middles[rng.integers(12, size=60)] + rng.normal(size=(60, 24)), rng.normal(size=(20, 24)) * 30]))]
    held(metric.knn(frame(spark, queries), frame(spark, data), 5, pivots=16, block=40), brute(queries, data, 5))
    held(metric.knn(frame(spark, data[:150]), frame(spark, data[:150]), 3, others=True, pivots=7, block=16), brute(data[:150], data[:150], 3, True))


def test_pairs_travel_as_tiles_not_one_by_one(spark, monkeypatch):
    """Vectors equally far apart, where no bound excludes anything: what is stored to be compared are pairs of tiles."""
    made = []
    monkeypatch.setattr(metric, "stored", lambda df: made.append(df.columns) or kept(df))
    kept, data = durable.stored, list(enumerate(np.random.default_rng(1).normal(size=(1200, 32))))
    held(metric.knn(frame(spark, data), frame(spark, data), 4, others=True, block=200), brute(data, data, 4, True))
    assert ["start", "share", "block"] in made


def test_products_leave_out_no_neighbour():
    """Far from zero, at any scale, among copies and nearly equal vectors; ties by id."""
    rng = np.random.default_rng(2)
    for size, at in ((1.0, 0.0), (1e-9, 1e3), (1e150, 0.0), (1e200, 0.0), (1e-200, 0.0)):
        v = np.concatenate([rng.normal(size=(300, 8)) * size + at, np.repeat(rng.normal(size=(1, 8)) * size + at, 50, axis=0)])
        v = np.concatenate([v, v[:20] * (1 + 1e-12)])
        q, ids = np.concatenate([v[::7], rng.normal(size=(9, 8)) * size * 100 + at]), rng.permutation(len(v))
        for reach in (np.full(len(q), np.inf), np.full(len(q), size)):
            with np.errstate(over="ignore"):
                row, place, d = metric.best_of(q, reach, v, ids, 6)
                for k in range(len(q)):
                    every = metric.distances(v, q[k])
                    want = [i for i in np.lexsort([ids, every]) if every[i] <= reach[k]][:6]
                    assert place[row == k].tolist() == want and d[row == k].tolist() == every[want].tolist()


def test_few_rows_one_pivot_and_rows_without_a_vector(spark):
    data = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0])]
    held(metric.knn(frame(spark, data), frame(spark, data), 9, pivots=1, block=1), brute(data, data, 9))
    bad = spark.createDataFrame([(4, None), (5, [float("nan"), 0.0]), (6, [])], "gnum long, v array<double>")
    held(metric.knn(frame(spark, data).union(bad), frame(spark, data).union(bad), 2), brute(data, data, 2))
    assert metric.knn(frame(spark, data), bad, 2).count() == 0 and metric.knn(bad, frame(spark, data), 2).count() == 0
    with pytest.raises(ValueError):
        metric.knn(frame(spark, [(1, [0.0])]), frame(spark, data), 2)


def test_blocks_do_not_take_a_callers_columns(spark):
    rows = spark.createDataFrame([(1, 0, 1, 7), (2, 0, 2, 8)], "gnum long, part_id int, lnum long, place int")
    with pytest.raises(ValueError, match="place"):
        exchange.part_to_block(rows, 2)
    made = exchange.part_to_block(rows, 2, names=("block_id", "at"))
    assert sorted((r.gnum, r.place, r.block_id, r.at) for r in made.collect()) == [(1, 7, 0, 0), (2, 8, 1, 0)]
