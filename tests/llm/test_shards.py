import zlib
from collections import Counter, defaultdict

import pytest

from meshweave.llm import queries, shards
from tests.llm.texts import ODD, empty, odd


def holds(rows, documents, n, tolerance):
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in documents)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert set(by) <= set(range(n))
    for x in by.values():
        assert sorted(r.slot for r in x) == list(range(len(x)))
    load = [sum(r.size for r in by[s]) for s in range(n)]
    mean = sum(load) / n
    assert max(load) - min(load) <= tolerance * mean


def test_query(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = queries.op8_shards(spark, small).collect()
    holds(rows, docs, 24, 0.25)
    assert all(r.law == "bytes" and r.grown_shard is None and r.map_version == 2 for r in rows)


def test_hot_text_is_split_and_others_stay_together(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, repeat('hot ', 50), concat('text ', id div 6, repeat('z', 200))) as text")
    rows = shards.sharded(docs, 6).collect()
    holds(rows, [(r.doc_id, r.text) for r in docs.collect()], 6, 0.1)
    together = defaultdict(set)
    for r in rows:
        together[r.text_crc32].add(r.shard)
    assert sorted(map(len, together.values()))[-2:] == [1, 6]


def test_map_versions_and_rebalancing(spark, tmp_path):
    sizes = {v: (v * 37) % 101 + 1 for v in range(256)}
    first = shards.SlotMap.balanced(sizes, 5, 256)
    sizes |= {v: 900 for v in range(7)}
    second = first.rebalanced(sizes, 6)
    moved = {v for v in first.owner if first.owner[v] != second.owner[v]}
    load = Counter()
    for v, s in second.owner.items():
        load[s] += sizes[v]
    assert second.version == 2 and len(load) == 6 and len(moved) < 100 and max(load.values()) < 1.1 * min(load.values())
    for m in (first, second):
        m.save(spark, str(tmp_path / "map"))
    assert shards.SlotMap.load(spark, str(tmp_path / "map")) == second and shards.SlotMap.load(spark, str(tmp_path / "map"), 1) == first


def test_stored_map_is_edited_not_made_anew(spark, tmp_path):
    texts = lambda n: spark.range(n).selectExpr("id as doc_id", "concat('text ', id, repeat('z', cast(id % 300 as int)))  as text")
    path = str(tmp_path / "slots")
    first = {r.doc_id: r for r in shards.sharded(texts(4000), 6, slots=512, path=path).collect()}
    assert {r.version for r in first.values()} == {2}
    again = {r.doc_id: r for r in shards.sharded(texts(4000), 6, slots=512, path=path).collect()}
    assert {r.version for r in again.values()} == {2} and all(again[d].shard == r.shard for d, r in first.items())
    more = shards.sharded(texts(6000), 6, slots=512, path=path).collect()
    holds(more, [(r.doc_id, r.text) for r in texts(6000).collect()], 6, 0.01)
    assert {r.version for r in more} == {3} and sum(r.doc_id in first and first[r.doc_id].shard != r.shard for r in more) < 1000
    grown = shards.sharded(texts(6000), 8, slots=512, path=path).collect()
    holds(grown, [(r.doc_id, r.text) for r in texts(6000).collect()], 8, 0.01)
    shard = {r.doc_id: r.shard for r in more}
    assert sum(r.shard != shard[r.doc_id] for r in grown) < 2200 and sum(r.shard != shard[r.doc_id] and r.shard < 6 for r in grown) < 400
    assert shards.SlotMap.load(spark, path, 1) == shards.SlotMap.even(6, 512)


def test_equal_texts_stay_together_unless_split(spark):
    docs = spark.range(900).selectExpr("id as doc_id", "if(id % 3 = 0, repeat('hot ', 50), concat('text ', id)) as text")
    for split, n in ((None, 1), (0.25, 4)):
        rows = shards.sharded(docs, 4, split_over=split).collect()
        assert len({r.shard for r in rows if r.doc_id % 3 == 0}) == n


def test_odd_rows(spark):
    rows = shards.sharded(odd(spark, True, True), 3).collect()
    assert len(rows) == len(ODD) + 1
    rows = shards.sharded(odd(spark, True), 3).collect()
    holds(rows, [(r[0], r[1]) for r in ODD], 3, 2)
    assert shards.sharded(empty(spark), 3).count() == 0


def test_another_number_of_slots_is_refused_and_loses_no_rows(spark, tmp_path):
    docs, path = spark.range(1000).selectExpr("id as doc_id", "concat('text ', id) as text"), str(tmp_path / "slots")
    assert shards.sharded(docs, 6, slots=64, path=path).count() == 1000
    with pytest.raises(ValueError, match="has 64 slots, not 4096"):
        shards.sharded(docs, 6, slots=4096, path=path)
    again = shards.sharded(docs, 6, path=path)
    assert again.count() == 1000 and again.agg({"vslot": "max"}).first()[0] < 64
    rows = shards.slotted(docs, 6, slots=128)
    with pytest.raises(Exception, match="has no shard"):
        shards.placed(rows, shards.SlotMap.load(spark, path)).collect()


def test_a_version_is_written_once(spark, tmp_path):
    path = str(tmp_path / "slots")
    shards.SlotMap.even(4, 16).save(spark, path)
    with pytest.raises(Exception, match="(?i)exist"):
        shards.SlotMap.even(3, 16).save(spark, path)
    assert shards.SlotMap.load(spark, path).shards == 4


def test_shards_are_even_to_one_per_cent(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "if(id % 3 = 0, repeat('the same text ', 30), concat('text ', id, repeat('z', cast(id % 700 as int)))) as text")
    holds(shards.sharded(docs, 24).collect(), [(r.doc_id, r.text) for r in docs.collect()], 24, 0.01)
