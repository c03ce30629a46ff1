import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshweave.llm import queries, treeweight
from tests.llm.texts import ODD, empty, odd

D = treeweight.DEPTH


def brute(rows):
    """rows: (key, text, taught); gives {key: (n_tokens, n_known, train tokens, base, score)}, node by node."""
    counts = defaultdict(lambda: [0, 0])
    words = Counter()
    ends = 0
    for _, text, taught in rows:
        tokens = (text or "").encode().lower().split()
        if taught:
            words.update(tokens)
            ends += 1
            data = b"\n" * D + b" ".join(tokens) + b"\n"
            for i in range(D, len(data)):
                for d in range(D + 1):
                    for b in range(8):
                        counts[data[i - d : i], b, data[i] >> (8 - b)][data[i] >> (7 - b) & 1] += 1
    children = defaultdict(set)
    for c, b, path in counts:
        if c:
            children[c[1:], b, path].add(c)

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    weight = {}
    for d in range(D, -1, -1):
        for node in [n for n in counts if len(n[0]) == d]:
            own = kt(*counts[node])
            if d == D:
                weight[node] = own, None
            else:
                deep = sum(weight[c, node[1], node[2]][0] for c in children[node])
                both = np.logaddexp(own, deep)
                weight[node] = both - math.log(2), math.exp(own - both)
    total, types = sum(words.values()) + ends, len(words) + (ends > 0)
    out = {}
    for key, text, _ in rows:
        tokens = (text or "").encode().lower().split()
        data = b"\n" * D + b" ".join(tokens) + b"\n"
        score = 0.0
        for i in range(D, len(data)):
            for b in range(8):
                p, bit = None, data[i] >> (7 - b) & 1
                for d in range(D, -1, -1):
                    node = data[i - d : i], b, data[i] >> (8 - b)
                    if node in counts:
                        own = (counts[node][bit] + 0.5) / (sum(counts[node]) + 1)
                        share = weight[node][1]
                        p = own if p is None or share is None else share * own + (1 - share) * p
                score += math.log10(0.5 if p is None else p)
        base = sum(math.log10((words[w] + 1) / (total + types + 1)) for w in tokens) + math.log10((ends + 1) / (total + types + 1))
        out[key] = (len(tokens) + 1, sum(words[w] > 0 for w in tokens) + (ends > 0), total, base, score)
    return out


def same(got, want):
    assert {r.doc_id for r in got} == set(want)
    for r in got:
        n_tokens, n_known, train, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, n_known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-5)


@pytest.mark.parametrize("batch", [1 << 20, 600])
def test_matches_brute_force(spark, small, batch, monkeypatch):
    monkeypatch.setattr(treeweight, "BATCH", batch)
    monkeypatch.setattr(treeweight, "FAN_IN", 2)
    rows = [(r.doc_id, r.text[:400] if r.doc_id % 5 else None) for r in spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 20").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = treeweight.scored(docs, F.col("doc_id") % 3 > 0).collect()
    same(got, brute([(k, t, k % 3 > 0) for k, t in rows]))


def test_chances_sum_to_one():
    keys, _ = treeweight.keys_of([b"abracadabra abracadabra cadabra\n"] * 3)
    seen, counts = treeweight.merged(keys, np.ones(len(keys), np.int64))
    context = int(seen[len(seen) // 2]) >> 8 << 8
    every = np.array([context | b for b in range(256)], np.uint64)
    both, n = treeweight.merged(np.concatenate([seen, every]), np.concatenate([counts, np.zeros(256, np.int64)]))
    mix, top = treeweight.subtree(both, n)
    logs = treeweight.Top.of(top).log10(both, mix)
    assert sum(10 ** logs[np.isin(both, every)]) == pytest.approx(1)


def test_query_predicts_held_out_texts(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.op6_scores(spark, small).collect()
    assert {r.doc_id for r in got} == set(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    held = [r for r in got if r.held_out]
    counts = Counter(b for d, t in docs.items() if zlib.crc32(str(d).encode()) % 7 != 2 for b in treeweight.stream(t)[1])
    alone = sum(math.log10(max(1, counts[b]) / sum(counts.values())) for r in held for b in treeweight.stream(docs[r.doc_id])[1])
    assert sum(r.score for r in held) > 0.65 * alone


def test_odd_rows(spark):
    docs = odd(spark, True).where("doc_id not in (6, 9)")
    kept = [r for r in ODD if r[0] not in (6, 9)]
    got = treeweight.scored(docs, F.col("lang") == "en").collect()
    assert len(got) == 8
    same(got, brute([(r[0], r[1], r[2] == "en") for r in kept]))
    none = treeweight.scored(odd(spark), F.lit(False)).collect()
    assert len(none) == 10 and all(r.score == pytest.approx(-8 * r.n_bytes * math.log10(2)) for r in none)
    assert treeweight.scored(empty(spark), F.lit(True)).count() == 0
    named = spark.createDataFrame([("a", "one two"), ("b", None), (None, "two")], "doc_id string, text string")
    assert {r.doc_id: r.n_tokens for r in treeweight.scored(named, F.lit(True)).collect()} == {"a": 3, "b": 1, None: 2}
