import hashlib

import numpy as np
import pytest

from meshweave.llm import queries, substrings
from tests.llm.texts import ODD, empty, odd


def brute(rows, length=50):
    """rows: (key, text)."""
    first = {}
    bodies = [(k, (t or "").encode()) for k, t in rows]
    for k, b in bodies:
        if k is not None:
            for i in range(len(b) - length + 1):
                w = b[i : i + length]
                if first.get(w, k) >= k:
                    first[w] = k
    out = []
    for k, b in bodies:
        gone = np.zeros(len(b), bool)
        if k is not None:
            for i in range(len(b) - length + 1):
                if first[b[i : i + length]] < k:
                    gone[i : i + length] = True
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((k, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def test_query(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op4_substrings(spark, small).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("seed", range(4))
def test_matches_brute_force(spark, seed, monkeypatch):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(substrings, "BATCH", 3000)
    letters = np.array(list("ab" if seed == 3 else "abcdefghij "))
    parts = ["".join(rng.choice(letters, rng.integers(20, 160))) for _ in range(30)]
    rows = []
    for k in range(80):
        pieces = [parts[rng.integers(30)] for _ in range(rng.integers(0, 5))]
        text = "".join(p[rng.integers(0, 10) :] for p in pieces)
        if text and k % 3 == 0:
            i = rng.integers(len(text))
            text = text[:i] + "é" + text[i + 1 :]
        rows.append((int(k * 7 % 80), text if k % 17 else None))
    rows += [(500, "x" * 300), (501, "x" * 200), (40, rows[5][1]), (None, parts[0] * 3), (None, parts[1] * 2)]
    got = substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string"), hot_bucket=2 if seed % 2 else 4096).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_long_texts_go_by_pieces():
    rng = np.random.default_rng(5)
    text = bytes(rng.integers(97, 123, 400_000, dtype=np.uint8))
    whole = substrings.Suffixes([text], 50)
    real, substrings.PIECE = substrings.PIECE, 1 << 20
    try:
        once = substrings.Suffixes([text], 50)
    finally:
        substrings.PIECE = real
    for name in ("doc", "at", "left", "right", "g", "around"):
        assert np.array_equal(getattr(whole, name), getattr(once, name))
    assert 0.05 < len(whole.at) / len(text) < 0.075


def test_odd_rows(spark):
    got = substrings.repeats(odd(spark, True)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([(r[0], r[1]) for r in ODD])
    assert substrings.repeats(empty(spark)).count() == 0
    keyless = [r for r in substrings.repeats(odd(spark, True, True)).collect() if r.doc_id is None]
    assert len(keyless) == 1 and keyless[0].n_removed == 0 and keyless[0].n_bytes > 50
    with pytest.raises(ValueError):
        substrings.repeats(spark.createDataFrame([("a", "x")], "doc_id string, text string"))
