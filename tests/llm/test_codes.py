import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from meshweave.llm import codes, queries
from tests.llm.texts import ODD, empty, odd

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("widths", [(8, 8), (16,), (4, 4, 8), (1, 2, 3, 10), (3, 29), (32,)])
def test_any_id_and_any_stretch_come_back(widths):
    rng = np.random.default_rng(sum(widths))
    for n in (0, 1, 63, 64, 511, 512, 513, 5000):
        top = sum(widths)
        ids = (rng.integers(0, 1 << 32, n, np.uint64) & ((np.uint64(1) << rng.integers(0, top + 1, n).astype(np.uint64)) - np.uint64(1))).astype(np.uint32)
        made = codes.Segment(codes.encoded(ids, widths))
        assert len(made) == n and made.widths == widths
        places = rng.integers(0, max(n, 1), 200) if n else np.empty(0, int)
        assert (made.at(places) == ids[places]).all()
        for a, b in [(0, n), *(sorted(rng.integers(0, n + 1, 2)) for _ in range(20))]:
            assert (made.between(int(a), int(b)) == ids[a:b]).all()
        with pytest.raises(IndexError):
            made.at(np.array([n]))
    if sum(widths) < 32:
        with pytest.raises(ValueError):
            codes.encoded(np.array([1 << sum(widths)]), widths)


def test_widths_are_the_best_of_all():
    rng = np.random.default_rng(2)

    def cuts(top, levels):
        if levels == 1:
            yield (top,)
        for w in range(1, top):
            if levels > 1:
                yield from ((w, *x) for x in cuts(top - w, levels - 1))

    def bits(widths, histogram):
        total, at = 0, 0
        for k, w in enumerate(widths):
            n = sum(c for b, c in histogram.items() if b > at) if k else sum(histogram.values())
            total, at = total + n * (w + (0 if k == len(widths) - 1 else 1 + 32 / codes.BLOCK)), at + w
        return total

    for _ in range(20):
        histogram = {b: int(rng.integers(1, 1000)) for b in range(1, int(rng.integers(2, 10)))}
        every = [x for n in range(1, 5) for x in cuts(max(histogram), n)]
        assert bits(codes.widths_of(histogram), histogram) == min(bits(x, histogram) for x in every)
    assert codes.widths_of({}) == (1,)


def test_words_give_the_ids_of_the_library():
    tok = Tokenizer.from_file(PATH)
    texts = [r[1] or "" for r in ODD] + ["a\x1cb\x1d c\x1f", "É é ́x a ́b", "x\u0085y z    w", "<|ENDOFTEXT|> a<|startoftext|>b", "don't CAN'T 'S", "Σας ΟΔΟΣ İ", "﻿a ​b"]
    ids, counts = codes.ids_for(PATH)(pa.array(texts))
    ends = np.cumsum(counts)
    for text, a, b in zip(texts, ends - counts, ends, strict=True):
        assert ids[a:b].tolist() == tok.encode(text, add_special_tokens=False).ids


def test_words_beyond_memory_and_of_many_kinds(monkeypatch, spark, small):
    monkeypatch.setattr(codes, "MEMO_WORDS", 2000)
    tok = Tokenizer.from_file(PATH)
    known = codes.WordIds(PATH)
    texts = [r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rng = np.random.default_rng(6)
    letters = list("aAbBzZéÉßÿÖ.,;:!?'s0_-#$×÷ªµİſ ")
    texts += ["".join(rng.choice(letters, int(n))) for n in rng.integers(0, 60, 3000)]
    for part in (texts[:100], texts[100:], texts[:50]):
        ids, counts = known.of(pa.array(part))
        ends = np.cumsum(counts)
        for text, a, b in zip(part, ends - counts, ends, strict=True):
            assert ids[a:b].tolist() == tok.encode(text, add_special_tokens=False).ids
    assert len(known.words) <= 2000 and len(known.units) <= 2000


def expected(documents):
    """(key, start, n_tokens, crc) as one would write the ids of all texts one after the other."""
    tok, start, out = Tokenizer.from_file(PATH), 0, []
    for key, text in sorted(documents, key=lambda x: (x[0] is not None, x[0])):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_the_library(spark, small):
    documents = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op11_codes(spark, small).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == expected(documents)


def test_odd_rows_long_documents_and_single_tokens(spark, tmp_path):
    docs, folder = odd(spark, True, True).repartition(5), str(tmp_path / "ids")
    codes.write(docs, PATH, folder, segment=1000)
    got = sorted((tuple(r) for r in codes.digests(spark, folder).collect()), key=lambda r: r[1])
    assert got == expected([(None, ODD[2][1]), *((r[0], r[1]) for r in ODD)])
    segments = spark.read.parquet(folder).collect()
    assert len(segments) > 20 and max(r.n for r in segments) <= 1000
    pieces = codes.read(spark, folder).collect()
    whole = {r.start + r.at + i: x for r in pieces for i, x in enumerate(np.frombuffer(r.ids, "<u4").tolist())}
    total = sum(r[2] for r in got)
    assert sorted(whole) == list(range(total))
    rng = np.random.default_rng(4)
    asked = [int(x) for x in rng.integers(0, total, 300)] + [0, total - 1, total, -1]
    places = spark.createDataFrame([(x,) for x in [*asked, asked[0], None]], "place long")
    assert sorted(tuple(r) for r in codes.tokens_at(spark, folder, places).collect()) == sorted((x, whole[x]) for x in set(asked) if x in whole)


def test_empty_table_string_keys_and_equal_rows(spark, tmp_path):
    codes.write(empty(spark), PATH, str(tmp_path / "none"))
    assert codes.digests(spark, str(tmp_path / "none")).count() == 0 and codes.tokens_at(spark, str(tmp_path / "none"), spark.range(3), "id").count() == 0
    docs = spark.range(400).selectExpr("if(id % 2 = 0, 'same', concat('k', id)) as name", "if(id % 4 = 0, 'one text', 'two texts more') as body")
    codes.write(docs, PATH, str(tmp_path / "named"), text="body", key="name", segment=64)
    got = sorted((tuple(r) for r in codes.digests(spark, str(tmp_path / "named"), "name").collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted(r.name for r in docs.collect())
    assert [r[1] for r in got] == [sum(x[2] for x in got[:i]) for i in range(len(got))] and {r[2:] for r in got} == {r[2:] for r in expected([(1, "one text"), (2, "two texts more")])}
