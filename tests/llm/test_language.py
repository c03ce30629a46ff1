import itertools
import re
import zlib

import numpy as np
import pytest

from meshweave.llm import language, queries
from tests.llm.texts import empty, odd


def test_posteriors_match_enumeration():
    rng = np.random.default_rng(0)
    lengths = [1, 5, 3, 4]
    emit, start, step = rng.normal(size=(sum(lengths), 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    begins, want, at = np.zeros(len(emit), bool), np.zeros_like(emit), 0
    for n in lengths:
        begins[at] = True
        for path in itertools.product(range(3), repeat=n):
            p = np.exp(start[path[0]] + sum(emit[at + i, s] for i, s in enumerate(path)) + sum(step[a, b] for a, b in itertools.pairwise(path)))
            for i, s in enumerate(path):
                want[at + i, s] += p
        at += n
    want /= want.sum(axis=1, keepdims=True)
    for width in (1, 2, 4, 128):
        assert np.allclose(language.forward_backward(emit, begins, start, step, width), want)


@pytest.fixture(scope="module")
def model(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("pmod(crc32(string(doc_id)), 4) <> 2")
    return language.learned(docs)


def test_held_out_accuracy(spark, small):
    truth = {r.doc_id: (r.text, r.lang) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op2_language(spark, small).collect()
    assert {r.doc_id for r in rows} == set(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out and re.search(r"[^\W\d_]", truth[r.doc_id][0] or "")]
    assert sum(r.lang_pred == truth[r.doc_id][1] for r in held) >= 0.97 * len(held)


def test_code_switched_words(spark, small, model):
    docs = {}
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        docs.setdefault(r.lang, []).append(language.words_of(r.text)[:40])
    mixed = [docs["en"][3], docs["de"][2], docs["fr"][1]]
    text = " ".join(w for x in mixed for w in x)
    row = language.labelled(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    said = [s["lang"] for s in row.spans for _ in range(s["n"])]
    want = [x for x, y in zip(("en", "de", "fr"), mixed, strict=True) for _ in y]
    assert sum(a == b for a, b in zip(said, want, strict=True)) > 0.9 * len(want)


def test_foreign_and_noise_texts_go(spark, small, model):
    rng = np.random.default_rng(3)
    docs: dict[str, list[str]] = {}
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        docs.setdefault(r.lang, []).append(r.text)
    noise = [" ".join("".join(map(chr, rng.integers(97, 123, rng.integers(3, 10)))) for _ in range(n)) for n in (5, 60, 600)]
    foreign = ["Привет мир, это простой текст на русском языке", "Ένα απλό κείμενο στα ελληνικά", "这是一个简单的中文文本", "W Szczebrzeszynie chrząszcz brzmi w trzcinie i Szczebrzeszyn z tego słynie"]
    switched = [" ".join(x) for x in zip(docs["en"], docs["de"], docs["fr"], docs["es"], strict=False)]
    good = [*(x for texts in docs.values() for x in texts), *switched]
    rows = spark.createDataFrame(list(enumerate([*good, *noise, *foreign])), "doc_id long, text string")
    assert {r.doc_id for r in language.accepted(rows, model).collect()} == set(range(len(good)))


def test_familiar_share_matches_plain_count(model):
    words = language.words_of("the chauge und höhklg xq a zzyzx")
    grams = [[f"\x02{w}\x03"[i : i + 3] for i in range(len(w))] for w in words]
    code = {g: model.shown[language.gram_features([g.strip("\x02\x03")], (3,))[1]] for x in grams for g in x if len(g.strip("\x02\x03")) == 1}
    made = model.familiar(words)
    assert made[:, 1].tolist() == [len(x) for x in grams] and made[words.index("a"), 0] == code["\x02a\x03"].sum()
    assert np.allclose(language.Reader(model).read([" ".join(words)], False)[3], made[:, 0].sum() / made[:, 1].sum())


def test_odd_rows(spark, model):
    rows = language.labelled(odd(spark, True), model).collect()
    by = {r.doc_id: r for r in rows}
    assert [r.lang_pred in model.langs for r in language.labelled(odd(spark, True, True), model).collect() if r.doc_id is None] == [True]
    assert language.accepted(odd(spark, True, True), model).where("doc_id is null").count() == 1
    assert len(rows) == 10 and all(by[d].lang_pred == "und" and by[d].score == 0 and by[d].spans == [] for d in (1, 2, 7))
    assert all(by[d].lang_pred in model.langs for d in (3, 4, 5, 6, 8, 9))
    assert language.labelled(empty(spark), model).count() == 0
    none = language.learned(empty(spark))
    assert {r.lang_pred for r in language.labelled(odd(spark), none).collect()} == {"und"}
    only = language.labelled(spark.createDataFrame([(1, "12 ² _ 3"), (2, "x² ...")], "doc_id long, text string"), model).collect()
    assert [r.lang_pred == "und" for r in only] == [True, False]
