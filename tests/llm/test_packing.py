import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from meshweave.llm import packing, queries
from tests.llm.texts import ODD, empty, odd

PATH = public_tokenizers.path("byte_bpe_50k.json")


def holds(rows, documents):
    tok = Tokenizer.from_file(PATH)
    ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for d, t in documents}
    by_doc, by_sequence = {}, {}
    for doc, start, length, crc, total, sequence, offset in rows:
        assert total == len(ids[doc]) and crc == zlib.crc32(np.array(ids[doc][start : start + length], "<u4").tobytes())
        by_doc.setdefault(doc, []).append((start, length))
        by_sequence.setdefault(sequence, []).append((offset, length))
    copies = Counter(d for d, _ in documents)
    for doc, parts in by_doc.items():
        at = Counter()
        for start, length in sorted(parts):
            at[start] += 1
        assert set(at.values()) == {copies[doc]}
        assert sum(x[1] for x in parts) == copies[doc] * len(ids[doc])
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(by_sequence) == list(range(len(by_sequence))) and set(by_doc) == set(ids)
    return sum(x[1] for p in by_sequence.values() for x in p) / max(1, 2048 * len(by_sequence))


def test_whole_documents_are_packed(spark, small):
    documents = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert holds([tuple(r) for r in queries.op10_packing(spark, small).collect()], documents) > 0.97


def test_ids_equal_the_library_on_odd_characters():
    tok = Tokenizer.from_file(PATH)
    for text in ["a\u0085b", "x᠎y   z", "a\x1cb\x1f c", "½ ² ª º ñ ß", "don't  stop\n\n 'LL we'll", "<|endoftext|>", "  a b", "日本 ٣٤", " \t\r\n x", "ſs 'ſ"]:
        assert packing.ids_of(PATH, text) == tok.encode(text, add_special_tokens=False).ids


def test_odd_rows(spark):
    cut = packing.pieces(odd(spark, True), PATH)
    got = packing.pack(cut.withColumn("ids_crc32", packing.crc_of("ids")))
    holds([tuple(r) for r in got.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()], [(r[0], r[1]) for r in ODD])
    assert packing.pack(packing.pieces(empty(spark), PATH)).count() == 0
    assert packing.pack(packing.pieces(odd(spark, True, True), PATH)).where("doc_id is null and offset >= 0").count() == 1


def test_plan_is_bounded_whatever_the_counts():
    rng = np.random.default_rng(1)
    for high in (2, 1000, 10**9):
        assert len(packing.plan({n: int(c) for n, c in zip(range(1, 2049), rng.integers(1, high + 1, 2048), strict=True)}, 2048)) <= 3 * 2048


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(0)
    histogram = {int(k): int(v) for k, v in zip(rng.choice(np.arange(1, 65), 40, replace=False), rng.integers(1, 500, 40), strict=True)}
    rows = packing.plan(histogram, 64)
    for length, count in histogram.items():
        spans = sorted((a, b) for n, a, b, _, _ in rows if n == length)
        assert spans[0][0] == 0 and spans[-1][1] == count and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_columns_of_a_caller_stay_and_blocks_follow_the_rows(spark):
    cut = packing.pieces(odd(spark), PATH).withColumn("ids_crc32", packing.crc_of("ids")).selectExpr("*", "'r' as _rank", "'b' as _block", "'f' as _first")
    made = packing.pack(cut, block=1)
    assert {"_rank", "_block", "_first"} <= set(made.columns) and {(r._rank, r._block, r._first) for r in made.collect()} == {("r", "b", "f")}
    holds([tuple(r) for r in made.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()], [(r[0], r[1]) for r in ODD])


def test_ids_pass_no_python_worker_when_they_are_placed(spark):
    cut = packing.pieces(odd(spark), PATH)
    kept = spark.createDataFrame(cut.collect(), cut.schema)
    assert "InArrow" not in packing.pack(kept)._jdf.queryExecution().executedPlan().toString()
