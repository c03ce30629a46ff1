import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from meshweave.llm import queries, runs
from tests.llm.texts import ODD, empty, odd


def brute(w, least=24, power=3):
    """Every maximal run by comparing the words with themselves, one period after the other."""
    w, seen = np.asarray(w), {}
    for q in range(1, len(w) // power + 1):
        same = np.r_[False, w[q:] == w[:-q], False]
        begins, ends = np.flatnonzero(same[1:] & ~same[:-1]), np.flatnonzero(same[:-1] & ~same[1:])
        for s, e in zip(begins.tolist(), (ends + q).tolist(), strict=True):
            if e - s >= max(least, power * q):
                seen.setdefault((s, e), q)
    return sorted((s, e, q) for (s, e), q in seen.items())


def digest(doc, text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]
    n, h = len(w), None if doc is None else zlib.crc32(str(doc).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    codes = {x: i for i, x in enumerate(dict.fromkeys(w))}
    found = [(s, e - s, q) for s, e, q in brute([codes[x] for x in w])] if w else []
    found.sort(key=lambda x: (x[0], x[2]))
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in found)]
    best = None
    for x in found:
        if best is None or x[1] * best[2] > best[1] * x[2]:
            best = x
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(kept))


def rows(made):
    return sorted((tuple(r)[:8] for r in made.collect()), key=str)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 4), st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(1, 7)), max_size=12))
def test_runs_of_words_made_of_repeats(least, blocks):
    w = [x for part, n in blocks for x in part * n]
    for low, power in ((least * 3, 3), (1, 2), (2, 2)):
        assert runs.runs_of(w, low, power) == brute(w, low, power)


def test_runs_of_nested_and_random_words():
    rng = random.Random(3)
    fib = [0], [0, 1]
    while len(fib[-1]) < 400:
        fib = fib[-1], fib[-1] + fib[-2]
    for w in (fib[-1], [0] * 500, [0, 1] * 300, ([0] * 30 + [1]) * 9, ([0, 1] * 20 + [2]) * 7 + [0, 1] * 13, list(range(500)), *([rng.randrange(k) for _ in range(700)] for k in (2, 3, 5))):
        for least, power in ((24, 3), (4, 2), (6, 3)):
            assert runs.runs_of(w, least, power) == brute(w, least, power)


def test_factors_are_the_longest_that_begin_earlier():
    rng = random.Random(5)
    for k in (1, 2, 3, 9):
        w = [rng.randrange(k) for _ in range(120)]
        at = 0
        for b, e, source in runs.factors(w):
            assert b == at and e > b
            longest = max((next((n for n in range(len(w) - b) if w[s + n] != w[b + n]), len(w) - b) for s in range(b)), default=0)
            assert e - b == max(1, longest) and (source < 0) == (longest == 0) and w[source : source + e - b] == w[b:e] or source < 0
            at = e
        assert at == len(w)


def test_stretches_hold_every_run():
    rng = random.Random(11)
    for _ in range(200):
        docs = [[x for _ in range(rng.randrange(1, 9)) for x in [rng.randrange(rng.choice((3, 50))) for _ in range(rng.randrange(1, 30))] * rng.choice((1, 1, 2, 5))] for _ in range(4)]
        words, doc = np.array([x for d in docs for x in d]), np.repeat(np.arange(4), [len(d) for d in docs])
        start = np.r_[0, np.cumsum([len(d) for d in docs])]
        got = sorted((int(doc[b]), b + s - start[doc[b]], b + e - start[doc[b]], q) for b, t in runs.repeated_stretches(words, doc) for s, e, q in runs.runs_of(words[b:t].tolist()))
        assert got == sorted((i, s, e, q) for i, d in enumerate(docs) for s, e, q in brute(d))


def test_query_equals_brute_force(spark, small):
    documents = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = rows(queries.op13_runs(spark, small))
    assert got == sorted((digest(*x) for x in documents), key=str)
    assert sum(r[1] > 0 for r in got) > 10


def test_odd_rows_and_planted_texts(spark, tmp_path):
    hit = [d for d in range(400) if zlib.crc32(str(d).encode()) % 10 == 0]
    more = [(d, " ".join(f"w{i % 37}" for i in range(d * 3 + 1)) + ("\n\x0b a b " * (d % 30)), "en", "z", 0) for d in hit]
    docs = odd(spark, True, True).unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"), True)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = [digest(r.doc_id, r.text) for r in docs.collect() if r.doc_id != 6]
    assert [r for r in rows(queries.op13_runs(spark, str(tmp_path))) if r[0] != 6] == sorted(want, key=str)
    assert runs.found(empty(spark)).count() == 0
    long = next(r for r in runs.found(odd(spark)).collect() if r.doc_id == 6)
    # of LONG, 12,000 words, the periods 977 and 13 meet after 25,402 words only: no run
    assert long.n_words == len(ODD[6][1].split()) and not long.runs and long.collapsed == " ".join(ODD[6][1].split())
