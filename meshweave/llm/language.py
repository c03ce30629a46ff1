"""Language of words and documents by a linear-chain conditional random field."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshweave.llm.common import released

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 16
LENGTHS = (2, 3, 4)
UNKNOWN = "und"
#: A memo of at most so many words' emissions a worker; it changes no result.
MEMO_WORDS = 300_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def letters(word: str) -> str:
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def gram_features(words: list[str], lengths: tuple[int, ...] = LENGTHS) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every feature: the n-grams of each word between two marks, so that those with a mark are its affixes."""
    marked = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    begins = marked == 2
    owner = np.cumsum(begins) - 1
    numbers, buckets = [], []
    for n in lengths:
        m = len(marked) - n + 1
        if m <= 0:
            continue
        code = np.full(m, n, np.uint64)
        for k in range(n):
            code = (code ^ marked[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
        inside = owner[:m] == owner[n - 1 : n - 1 + m]
        numbers.append(owner[:m][inside])
        buckets.append((code[inside] % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(numbers), np.concatenate(buckets)


@dataclass
class Model:
    """Weights of a chain over `langs`: hashed n-gram and affix features, a lexicon, a start and transitions; and which
    buckets hold a trigram of the training words."""

    langs: list[str]
    grams: np.ndarray
    lexicon: dict[str, int]
    known: np.ndarray
    start: np.ndarray
    step: np.ndarray
    shown: np.ndarray

    def familiar(self, words: list[str]) -> np.ndarray:
        """For each word, how many of its trigrams training showed, and how many it has."""
        if not words:
            return np.zeros((0, 2))
        number, bucket = gram_features(words, (3,))
        return np.stack([np.bincount(number, self.shown[bucket], len(words)), np.bincount(number, minlength=len(words))], axis=1)

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.langs)))
        if words:
            number, bucket = gram_features(words)
            for k in range(len(self.langs)):
                out[:, k] = np.bincount(number, self.grams[bucket, k], len(words))
            out += self.known[[self.lexicon.get(w, 0) for w in words]]
        return out


def forward_backward(emit: np.ndarray, begins: np.ndarray, start: np.ndarray, step: np.ndarray, width: int = 128) -> np.ndarray:
    """Posteriors (n, labels) of sequences laid end to end; `begins` is true at the first place of each.

    The row of places is cut into runs of `width` that are worked on side by side: first each run's transfer matrix,
    then, with what enters it from both ends known, its forward and backward messages. Exact for any cut.
    """
    n, labels = emit.shape
    runs = -(-n // width)
    e = np.ones((runs * width, labels))
    e[:n] = np.exp(emit - emit.max(axis=1, keepdims=True))
    first = np.ones(runs * width, bool)  # what fills the last run up is apart
    first[:n] = begins
    e, first = e.reshape(runs, width, labels), first.reshape(runs, width)
    s, a = np.exp(start), np.exp(step)
    over = np.broadcast_to(np.eye(labels), (runs, labels, labels)).copy()
    for t in range(width):
        moved = over @ a
        new = first[:, t]
        if new.any():
            moved[new] = over[new].sum(axis=2, keepdims=True) * s
        over = moved * e[:, t, None, :]
        over /= over.sum(axis=(1, 2), keepdims=True)
    ahead, back = np.empty((runs, labels)), np.empty((runs, labels))
    x = np.full(labels, 1 / labels)
    for k in range(runs):
        ahead[k] = x
        x = x @ over[k]
        x /= x.sum()
    x = np.full(labels, 1 / labels)
    for k in reversed(range(runs)):
        back[k] = x
        x = over[k] @ x
        x /= x.sum()
    alpha = np.empty((runs, width, labels))
    x = ahead
    for t in range(width):
        moved = x @ a
        moved[first[:, t]] = s
        x = moved * e[:, t]
        x /= x.sum(axis=1, keepdims=True)
        alpha[:, t] = x
    x = back
    for t in reversed(range(width)):
        alpha[:, t] *= x
        x = x * e[:, t]
        stay = x @ a.T
        stay[first[:, t]] = 1
        x = stay / stay.sum(axis=1, keepdims=True)
    out = alpha.reshape(-1, labels)[:n]
    return out / out.sum(axis=1, keepdims=True)


def fitted(rows: list[tuple[str, str]], lexicon_words: int = 2000, length: int = 32, epochs: int = 4, rate: float = 0.3, seed: int = 7) -> Model:
    """A model of labelled texts (text, lang), by gradient ascent on the conditional likelihood (Adagrad).

    The training sequences are spliced from spans of different languages, 3 to 20 words each, so that the transitions
    learn to switch. The lexicon holds the words that are most frequent in each language.
    """
    langs = sorted({lang for _, lang in rows})
    size, rng = len(langs), np.random.default_rng(seed)
    pools: dict[str, list[list[str]]] = {x: [] for x in langs}
    counts: dict[str, Counter] = {x: Counter() for x in langs}
    for text, lang in sorted(rows):
        words = [w for w in map(letters, words_of(text)) if w]
        if words:
            pools[lang].append(words)
            counts[lang].update(words)
    lexicon: dict[str, int] = {}
    for lang in langs:
        for w, _ in sorted(counts[lang].items(), key=lambda x: (-x[1], x[0]))[:lexicon_words]:
            lexicon.setdefault(w, len(lexicon) + 1)
    model = Model(langs, np.zeros((BUCKETS, size)), lexicon, np.zeros((len(lexicon) + 1, size)), np.zeros(size), np.zeros((size, size)), np.zeros(BUCKETS, bool))
    streams = {x: [w for words in pools[x] for w in words] for x in langs if pools[x]}
    if not streams:
        return model
    model.shown[gram_features(list({w for words in streams.values() for w in words}), (3,))[1]] = True
    total = sum(map(len, streams.values()))
    used, names = dict.fromkeys(streams, 0), list(streams)
    words, truth = [], []
    while len(words) < total // length * length or not words:
        lang = names[rng.integers(len(names))]
        n = int(rng.integers(3, 21))
        for _ in range(n):
            words.append(streams[lang][used[lang] % len(streams[lang])])
            truth.append(langs.index(lang))
            used[lang] += 1
    many = max(1, len(words) // length)
    words, truth = words[: many * length], np.array(truth[: many * length])
    distinct = list(dict.fromkeys(words))
    place = {w: i for i, w in enumerate(distinct)}
    ids = np.array([place[w] for w in words])
    number, bucket = gram_features(distinct)
    order = np.argsort(number, kind="stable")
    bucket, bounds = bucket[order], np.searchsorted(number[order], np.arange(len(distinct) + 1))
    listed = np.array([lexicon.get(w, 0) for w in distinct])
    weights = (model.grams, model.known, model.start, model.step)
    squares = tuple(np.full_like(w, 1e-6) for w in weights)
    spread = lambda at: (np.repeat(at, bounds[at + 1] - bounds[at]), np.concatenate([bucket[bounds[i] : bounds[i + 1]] for i in at]))
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(many), -(-many // 64)):
            at = (part[:, None] * length + np.arange(length)).ravel()
            seen, inverse = np.unique(ids[at], return_inverse=True)
            owner, features = spread(seen)
            local = np.searchsorted(seen, owner)
            emit = np.stack([np.bincount(local, model.grams[features, k], len(seen)) for k in range(size)], axis=1) + model.known[listed[seen]]
            begins = np.arange(len(at)) % length == 0
            post = forward_backward(emit[inverse], begins, model.start, model.step, length)
            gap = -post
            gap[np.arange(len(at)), truth[at]] += 1
            by_word = np.stack([np.bincount(inverse, gap[:, k], len(seen)) for k in range(size)], axis=1)
            grads = [np.zeros_like(w) for w in weights]
            grads[0] = np.stack([np.bincount(features, by_word[local, k], BUCKETS) for k in range(size)], axis=1)
            np.add.at(grads[1], listed[seen], by_word)
            grads[1][0] = 0
            grads[2] = gap[begins].sum(axis=0)
            # expected transitions by the product of neighbouring posteriors' pairwise marginals
            e = np.exp(emit[inverse] - emit[inverse].max(axis=1, keepdims=True)).reshape(-1, length, size)
            grads[3] = pair_gap(e, truth[at].reshape(-1, length), model.start, model.step)
            for w, g, q in zip(weights, grads, squares, strict=True):
                g = g / len(part) - 1e-4 * w
                q += g * g
                w += rate * g / np.sqrt(q)
    return model


def pair_gap(e: np.ndarray, truth: np.ndarray, start: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Observed less expected transitions of sequences of equal length."""
    many, length, size = e.shape
    s, a = np.exp(start), np.exp(step)
    ahead, back = np.empty_like(e), np.empty_like(e)
    x = s * e[:, 0]
    for t in range(length):
        x = x if t == 0 else (x @ a) * e[:, t]
        x = x / x.sum(axis=1, keepdims=True)
        ahead[:, t] = x
    x = np.ones((many, size))
    for t in reversed(range(length)):
        back[:, t] = x
        x = (x * e[:, t]) @ a.T
        x = x / x.sum(axis=1, keepdims=True)
    pairs = ahead[:, :-1, :, None] * a * (e[:, 1:] * back[:, 1:])[:, :, None, :]
    pairs /= pairs.sum(axis=(2, 3), keepdims=True)
    seen = np.zeros((size, size))
    np.add.at(seen, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1)
    return seen - pairs.sum(axis=(0, 1))


def learned(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = 100, longest: int = 4000) -> Model:
    """A model of a bounded sample of whole texts: for each language the `per_lang` rows of the smallest hashes of the key,
    texts of more than `longest` characters only where there are not enough others. Rows without text or language
    teach nothing."""
    rank = Window.partitionBy("lang").orderBy("long", F.xxhash64("key"), "key", "text")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"), (F.length(text) > longest).alias("long")).where("text is not null and lang is not null")
    sample = rows.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= per_lang).select("text", "lang")
    return fitted([(r["text"], r["lang"]) for r in sample.collect()])


class Reader:
    """Reads texts with a model, remembering the emissions of the words seen first."""

    def __init__(self, model: Model):
        self.model, self.memo, self.table, self.grams = model, {}, np.zeros((0, len(model.langs))), np.zeros((0, 2))

    def read(self, texts: list[str | None], spans: bool) -> tuple[list[str], list[float], list[list[dict]], list[float]]:
        """Language, score, spans and the share of trigrams that training showed, of each text."""
        own = self.model
        split = [words_of(x) for x in texts]
        new = list({w for x in split for w in x}.difference(self.memo))
        lettered = [letters(w) for w in new]
        good = [i for i, w in enumerate(lettered) if w]
        places = dict.fromkeys(new, -1)
        places.update((new[i], len(self.table) + k) for k, i in enumerate(good))
        rows = np.concatenate([self.table, own.emissions([lettered[i] for i in good])])
        grams = np.concatenate([self.grams, own.familiar([lettered[i] for i in good])])
        found = self.memo | places
        if len(found) <= MEMO_WORDS:
            self.memo, self.table, self.grams = found, rows, grams
        ids = [[i for w in x if (i := found[w]) >= 0] for x in split]
        sizes = np.array([len(x) for x in ids], np.int64)
        langs, scores, runs, shares = [UNKNOWN] * len(ids), [0.0] * len(ids), [[] for _ in ids], [0.0] * len(ids)
        if not sizes.sum() or not own.langs:
            return langs, scores, runs, shares
        flat = np.fromiter((i for x in ids for i in x), np.int64, sizes.sum())
        full = np.flatnonzero(sizes)
        offsets = np.concatenate([[0], np.cumsum(sizes[full])])
        begins = np.zeros(len(flat), bool)
        begins[offsets[:-1]] = True
        post = forward_backward(rows[flat], begins, own.start, own.step)
        mean = np.add.reduceat(post, offsets[:-1], axis=0) / sizes[full][:, None]
        best = mean.argmax(axis=1)
        shown, every = np.add.reduceat(grams[flat], offsets[:-1], axis=0).T
        for k, (i, b) in enumerate(zip(full.tolist(), best.tolist(), strict=True)):
            langs[i], scores[i], shares[i] = own.langs[b], min(1.0, float(mean[k, b])), float(shown[k] / every[k])
        if spans:
            top = post.argmax(axis=1)
            cut = np.flatnonzero(begins | (np.diff(top, prepend=-1) != 0))
            chance = np.add.reduceat(post.max(axis=1), cut)
            lengths = np.diff(np.append(cut, len(flat)))
            owner = np.searchsorted(offsets, cut, "right") - 1
            for c, o, n, p in zip(cut.tolist(), owner.tolist(), lengths.tolist(), chance.tolist(), strict=True):
                runs[full[o]].append({"lang": own.langs[top[c]], "first": c - int(offsets[o]), "n": n, "p": min(1.0, p / n)})
        return langs, scores, runs, shares


def labelled(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", spans: bool = True) -> DataFrame:
    """(key, lang_pred, score, spans) of every whole text.

    Every run of letters is a word; forward-backward gives each word's label and the chance of it. lang_pred is the
    language of the largest mean chance, score that mean; spans (array of lang, first, n, p) are the longest runs of
    words with one most likely language, with their mean chance. Null texts and those without a letter are `und` with
    score 0 and no spans; so is every text if the model knows no language. Every row gives a row, also those of null or
    equal keys.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                langs, scores, runs, _ = reader.read(batch.column(1).to_pylist(), spans)
                kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("n", pa.int32()), ("p", pa.float64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(runs, kind)], [key, "lang_pred", "score", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, lang_pred string, score double, spans array<struct<lang:string,first:int,n:int,p:double>>")


def accepted(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of `docs` whose words are of the languages learned, with the columns of `docs`.

    The chain says which of its languages a word is, not whether it is of any. A text to which it gives a language
    therefore stays only if of its words' trigrams, with a mark at both ends of a word, at least the share `least` stood
    in the words that the model was fitted on. The number of languages plays no part, and texts of several of them stay;
    texts in other scripts, letter noise, null texts and texts without a letter go, and all do if the model knows none.
    """
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                langs, _, _, shares = reader.read(batch.column(place).to_pylist(), False)
                yield released(batch.filter(pa.array([x != UNKNOWN and p >= least for x, p in zip(langs, shares, strict=True)], pa.bool_())))

    return docs.mapInArrow(run, docs.schema)
