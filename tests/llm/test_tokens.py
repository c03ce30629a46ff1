import public_tokenizers
import pytest
from tokenizers import Tokenizer

from meshweave.llm import queries, tokens
from tests.llm.texts import ODD, empty, odd

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def test_matches_the_library(spark, small):
    tok = Tokenizer.from_file(public_tokenizers.path(FILES[0]))
    want = {(r.doc_id, len(r.text.encode()), n := len(tok.encode(r.text, add_special_tokens=False)), n > 2048) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert {tuple(r) for r in queries.op3_tokens(spark, small).collect()} == want


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize(("chunk", "overlap"), [(60, 8), (200, 40), (1000, 100)])
def test_resynchronised_ids_equal_whole_ids(spark, small, name, chunk, overlap):
    path = public_tokenizers.path(name)
    tok = Tokenizer.from_file(path)
    texts = [r.text[:4000] for r in spark.read.parquet(f"{small}/documents.parquet").limit(25).collect()] + [(r[1] or "")[:3000] for r in ODD]
    for text in [*texts, "a b  c\n\n d" * 90, "'s 'tis <|endoftext|> " * 40, "你好 é   x " * 60]:
        assert tokens.encode_long(path, text, chunk, overlap) == tok.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_odd_rows(spark, name):
    path = public_tokenizers.path(name)
    tok = Tokenizer.from_file(path)
    got = sorted(tuple(r) for r in tokens.count_tokens(odd(spark, True), path).collect())
    assert got == sorted((d, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False)), n > 2048) for d, t, *_ in ODD)
    assert tokens.count_tokens(empty(spark), path).count() == 0
    assert tokens.count_tokens(odd(spark, True, True), path).where("doc_id is null and n_tokens > 5").count() == 1
