import numpy as np
import pytest

from meshweave.llm import queries, vectors


def brute(rows, threshold):
    """rows: (key, vector or None, label)."""
    n = len(rows)
    ok = [v is not None and len(v) > 0 and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    parent, links = list(range(n)), [0] * n

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i + 1, n):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.asarray(rows[k][1], np.float64) for k in (i, j))
                a, b = (x / np.abs(x).max() for x in (a, b))
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    parent[max(find(i), find(j), key=lambda k: rows[k][0])] = min(find(i), find(j), key=lambda k: rows[k][0])
    return sorted((rows[i][0], links[i], rows[find(i)][0], rows[find(i)][0] == rows[i][0]) for i in range(n))


def test_query(spark, small):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op9_embeddings(spark, small).collect()) == brute(rows, 0.93)


@pytest.mark.parametrize(("seed", "tile", "threshold"), [(0, 16, 0.93), (1, 7, 0.8), (2, 1000, 0.99)])
def test_matches_brute_force(spark, seed, tile, threshold):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 40))
    rows = [(int(k), [float(np.float32(x)) for x in centres[k % 12] + rng.normal(size=40) * rng.choice([0.0, 0.1, 0.3])], int(k % 3) if k % 29 else None) for k in range(240)]
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 40, 1), (1003, [float("nan")] * 40, 1), (1004, [float("inf")] * 40, 1), (1005, [None] * 40, 1), (1006, [1e-30] * 40, 1), (1007, [3e30] * 40, 1), (1008, [1.0] * 5, 1), (1009, [2.0] * 5, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as v", "2 as n", "3 as rep", "4 as key")
    rows = [(r.vec_id, r.embedding, r.label) for r in frame.collect()]
    assert sorted(tuple(r) for r in vectors.near_vectors(frame, threshold, tile=tile).collect()) == brute(rows, threshold)


def test_empty(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_keys_of_other_types_null_and_repeated_keys(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(6, 8))
    rows = [(f"k{9 - i % 10}{i:02d}", (base[i % 6] + rng.normal(0, 0.02, 8)).tolist(), i % 2) for i in range(30)]
    rows += [rows[3], (None, rows[4][1], 0), ("z", None, 0), ("null label", rows[0][1], None)]
    schema = "vec_id {}, embedding array<double>, label int"
    named = vectors.near_vectors(spark.createDataFrame(rows, schema.format("string")))
    order = {k: i for i, k in enumerate(sorted({r[0] for r in rows if r[0] is not None}))}
    numbers = vectors.near_vectors(spark.createDataFrame([(order.get(k), v, x) for k, v, x in rows], schema.format("long")))
    back = {i: k for k, i in order.items()} | {None: None}
    assert sorted((back[r.vec_id] or "", r.n_links, back[r.component_id] or "", r.kept) for r in numbers.collect()) == sorted((r.vec_id or "", r.n_links, r.component_id or "", r.kept) for r in named.collect())
    got = {r.vec_id: r for r in named.collect()}
    assert got[None].component_id is None and got["z"].n_links == 0 and got["null label"].n_links == 0 and got[rows[3][0]].n_links > 0
    assert vectors.near_vectors(spark.createDataFrame([], schema.format("string"))).count() == 0
