import itertools
import math

import numpy as np
import regex
from meshweave.llm import contamination, queries
from tests.llm.texts import BODY, empty, odd


def words(text):
    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())


def brute(docs, items):
    """Every diagonal of every pair, without seeds."""
    found, numbers = set(), {}
    code = lambda text: np.array([numbers.setdefault(w, len(numbers)) for w in words(text)], np.int64)
    bodies = {i: code(t) for i, t in items}
    for doc, text in docs:
        d = code(text)
        for item, w in bodies.items():
            if not len(w) or not len(d):
                continue
            n, k = len(w), min(13, len(w))
            laid = np.zeros((n + len(d), n + 1), np.int32)  # row: begin + n; column: place in the item
            inside = np.zeros((n + len(d), n + 1), np.int32)
            for i, x in enumerate(w):
                laid[n - i : n - i + len(d), i + 1] = d == x
                inside[n - i : n - i + len(d), i + 1] = 1
            laid, inside = laid.cumsum(axis=1), inside.cumsum(axis=1)
            if (((laid[:, k:] - laid[:, :-k]) >= 0.8 * k) & ((inside[:, k:] - inside[:, :-k]) == k)).any():
                found.add((doc, item))
    return found


def test_finds_what_brute_force_finds(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert {(r.doc_id, r.item_id) for r in queries.op5_decontaminate(spark, small).collect()} == brute(docs, items)


def substitutions(n):
    """Every set of places of an item of n words that may differ at a share of 0.8."""
    for size in range(n - math.ceil(0.8 * n) + 1):
        yield from itertools.combinations(range(n), size)


def test_masks_miss_no_substitutions():
    for n in range(1, 14):
        for bad in substitutions(n):
            assert any(all(m[k] == "0" or at + k not in bad for k in range(len(m))) for m in contamination.masks_of(n) for at in range(n - len(m) + 1)), (n, bad)


def test_every_substitution_is_found(spark):
    docs, want, items = [], set(), []
    for n in range(1, 14):
        item = [f"w{n}x{i}" for i in range(n)]
        items.append((n, " ".join(item)))
        for bad in substitutions(n):
            doc = len(docs)
            docs.append((doc, f"a{doc} " + " ".join(f"s{doc}x{i}" if i in bad else w for i, w in enumerate(item)) + f" z{doc}"))
            want.add((doc, n))
        over = next(itertools.combinations(range(n), n - math.ceil(0.8 * n) + 1))  # one too many
        docs.append((len(docs), " ".join(f"s{i}" if i in over else w for i, w in enumerate(item))))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = contamination.contaminated(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want == brute(docs, items)


def test_items_that_share_a_seed_and_null_keys(spark):
    common = " ".join(f"c{i}" for i in range(9))
    items = [(i, f"{common} own{i}") for i in range(200)] + [(500, f"{common} own7")]
    docs = spark.createDataFrame([(1, f"x {common} own7 y"), (1, f"x {common} own7 y"), (None, f"{common} own9"), (2, None)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contamination.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, i) for i, _ in items}  # nine of ten words
    assert sorted(str(r.doc_id) for r in contamination.clean(docs, spark.createDataFrame(items, "item_id long, text string")).collect()) == ["2", "None"]


def test_substitutions_short_items_and_odd_rows(spark):
    many = BODY.split()
    many[3], many[9], many[15] = "X1", "X2", "X3"
    docs = odd(spark, True).unionByName(spark.createDataFrame([(20, "start " + " ".join(many) + " end"), (21, "say hello there world today"), (22, " ".join(BODY.split()[::-1]))], "doc_id long, text string"), allowMissingColumns=True)
    benchmark = spark.createDataFrame([(1, BODY), (2, "Hello there, world!"), (3, None), (4, ""), (1, BODY)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in contamination.contaminated(docs, benchmark).collect()}
    assert set(got) == {(3, 1), (4, 1), (5, 1), (20, 1), (21, 2)}
    assert got[20, 1].place == 1 and got[20, 1].n_equal == len(many) - 3 and got[3, 1].overlap == 1
    left = contamination.clean(docs, benchmark)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {1, 2, 6, 7, 8, 9, 22}
    assert contamination.contaminated(empty(spark), benchmark).count() == 0
    assert contamination.contaminated(docs, benchmark.limit(0)).count() == 0
