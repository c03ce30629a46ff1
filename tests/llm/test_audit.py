import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb

from meshweave.llm import audit, queries
from tests.llm.texts import CLASHING, ODD, empty, odd

LABELS = "doc_id long, quality int, toxic int"


def brute(documents, labels):
    """Every order applied document by document."""
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    first = {}
    for d, t, _ in documents:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    parts = defaultdict(list)
    for d, t, source in documents:
        t = t or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": d is not None and d > first[t],
        }
        parts[source or ""].append((d, {k for k, v in fails.items() if v}))
    out, shapley = {}, Counter()
    for part, docs in parts.items():
        for order in permutations("ABCDE"):
            left, gone = docs, []
            for step, f in enumerate(order, 1):
                removed = [x for x in left if f in x[1]]
                redundant = sum(f in x[1] for x in gone)
                left, gone = [x for x in left if f not in x[1]], gone + removed
                shapley[part, f] += len(removed)
                out[part, "".join(order), step] = [len(left), len(removed), redundant, sum(x[1] == {f} for x in docs), sum(x[0] in good for x in removed), sum(x[0] in toxic for x in removed)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def rows(made):
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in made.collect()}
    assert len(got) == made.count()
    return got


def test_query_equals_brute_force_and_its_sql(spark, small):
    documents, labels = ([tuple(r) for r in spark.read.parquet(f"{small}/{t}.parquet").select(*c).collect()] for t, c in (("documents", ("doc_id", "text", "source")), ("labels", ("doc_id", "quality", "toxic"))))
    made = queries.op12_audit(spark, small)
    got = rows(made)
    assert got == brute(documents, labels) and len(got) == 600 * len({s or "" for _, _, s in documents})
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    want = con.sql(queries.ORACLES["op12_audit"])
    at = {c: i for i, c in enumerate(want.columns)}
    assert set(at) == set(made.columns)
    assert {tuple(r[at[c]] for c in made.columns) for r in want.fetchall()} == {tuple(r) for r in made.collect()}


def test_odd_rows_ties_and_repeated_labels(spark):
    labels = [(1, 1, 0), (3, 1, 1), (4, 0, 1), (4, 1, None), (9, None, 1), (99, 1, 1)]
    plain = [(1, 1, 0), (3, 1, 1), (4, 1, 1), (9, None, 1), (99, 1, 1)]
    made = spark.createDataFrame(labels, LABELS)
    documents = [(r[0], r[1], r[3]) for r in ODD]
    assert rows(audit.audit(odd(spark, True), made)) == brute(documents, plain)
    keyless = [*documents, (None, documents[2][1], "a")]
    assert rows(audit.audit(odd(spark, True, True), made)) == brute(keyless, plain)
    assert audit.audit(empty(spark), made).count() == 0
    assert rows(audit.audit(odd(spark), spark.createDataFrame([], LABELS))) == brute(documents, [])
    assert CLASHING


def test_copies_of_one_text_over_parts(spark):
    docs = spark.range(1, 3001).selectExpr("id as doc_id", "if(id % 3 = 0, 'Same #text', concat('Text ', id % 700)) as text", "concat('s', id % 4) as source")
    want = brute([tuple(r) for r in docs.collect()], [])
    assert rows(audit.audit(docs, spark.createDataFrame([], LABELS))) == want
    assert want["s0", "EABCD", 1][1] > 500


def test_plan_reads_documents_once_without_python(spark, small):
    made = audit.flagged(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("documents.parquet") == 1 and "Python" not in plan
