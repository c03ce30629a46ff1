"""Language-model scores by context-tree weighting over bytes."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshweave.llm.common import stored

#: Bytes of context; a key holds them, the nearest first, and the byte that follows.
DEPTH = 5
#: Depths from which on a context's subtree lies within one bucket.
ROOT = 2
BUCKETS = 256
BATCH, PIECE = 16 << 20, 2 << 20
#: So many batches' entries are merged by one task; a tree of such merges takes any number.
FAN_IN = 64
GAPS = 8
ODD = np.uint64(0x9E3779B97F4A7C15)
TABLE = 4096
HALVES = np.concatenate([[0.0], np.cumsum(np.log(np.arange(TABLE) + 0.5))])
WHOLES = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, TABLE + 1)))])


def log_gamma(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of a sequence of so many zeros and ones."""

    def half(n: np.ndarray) -> np.ndarray:
        return np.where(n <= TABLE, HALVES[np.minimum(n, TABLE)], log_gamma(np.maximum(n, 1) + 0.5) - math.lgamma(0.5))

    n = zeros + ones
    return half(zeros) + half(ones) - np.where(n <= TABLE, WHOLES[np.minimum(n, TABLE)], log_gamma(n + 1.0))


def stream(text: str | None) -> tuple[list[bytes], bytes]:
    """The words of a text, A-Z lower-cased, and the bytes that are scored: words, one space between two, one line end."""
    words = (text or "").encode().lower().split()
    return words, b" ".join(words) + b"\n"


def keys_of(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The key of every byte of every stream, and where each stream's keys begin. Before a stream stand line ends."""
    data = np.frombuffer(b"\n" * DEPTH + (b"\n" * DEPTH).join(streams), np.uint8)
    sizes = np.array([len(x) for x in streams])
    keys = data[DEPTH:].astype(np.uint64)
    for k in range(1, DEPTH + 1):
        keys |= data[DEPTH - k : len(data) - k].astype(np.uint64) << np.uint64(8 * (DEPTH + 1 - k))
    begins = np.concatenate([[0], np.cumsum(sizes + DEPTH)[:-1]]).astype(np.int64)
    inside = np.ones(len(keys), bool)
    for k in range(DEPTH):
        inside[(begins[1:] - 1 - k)] = False
    return keys[inside], np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)


def bucket_of(keys: np.ndarray) -> np.ndarray:
    return ((keys >> np.uint64(8 * (DEPTH + 1 - ROOT))) * ODD >> np.uint64(40)).astype(np.int64) % BUCKETS


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[starts], np.add.reduceat(counts[order], starts) if len(starts) else counts


def packed(keys: np.ndarray) -> bytes:
    return np.diff(keys, prepend=np.uint64(0)).tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, np.uint64))


def subtree(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """For sorted distinct keys of whole subtrees of depth ROOT: the chance of each key's bits given its context, mixed
    over the depths from ROOT on (NaN: node never seen), and for each nearest byte the sums of log weighted
    probabilities by node and the counts by byte."""
    size = len(keys)
    mix = np.full((size, GAPS), np.nan)
    rows, n, up = keys, counts, np.arange(size)
    below: list[tuple[np.ndarray, np.ndarray]] = []
    for depth in range(DEPTH, ROOT - 1, -1):
        if depth < DEPTH:
            cut = np.uint64(8 * (DEPTH - depth))
            shorter = ((rows >> (cut + np.uint64(8))) << np.uint64(8)) | (rows & np.uint64(255)) if depth == DEPTH - 1 else ((rows >> np.uint64(16)) << np.uint64(8)) | (rows & np.uint64(255))
            fresh, to = np.unique(shorter, return_inverse=True)
            total = np.bincount(to, n, len(fresh)).astype(np.int64)
            up, rows, n = to[up], fresh, total
        here = []
        for b in range(GAPS):
            node = rows >> np.uint64(8 - b)
            new = np.concatenate([[True], node[1:] != node[:-1]])
            own, starts = np.cumsum(new) - 1, np.flatnonzero(new)
            bit = ((rows >> np.uint64(7 - b)) & np.uint64(1)).astype(np.int64)
            all_, ones = np.add.reduceat(n, starts), np.add.reduceat(n * bit, starts)
            own_log = log_kt(all_ - ones, ones)
            likely = (np.where(bit == 1, ones[own], (all_ - ones)[own]) + 0.5) / (all_[own] + 1)
            if depth == DEPTH:
                log_w, p = own_log, likely
                mix[:, b] = np.where(all_[own] > 0, p, np.nan)[up]
            else:
                child_log, child_row = below[b]
                joint = np.bincount(own[to[child_row]], child_log, len(starts))
                either = np.logaddexp(own_log, joint)
                log_w = np.where(all_ > 0, either - math.log(2), 0.0)
                share = np.exp(own_log - either)[own][up]
                flat = likely[up]
                deep = np.where(np.isnan(mix[:, b]), flat, mix[:, b])
                mix[:, b] = np.where((all_[own] > 0)[up], share * flat + (1 - share) * deep, np.nan)
            here.append((log_w, starts))
        below = here
    top: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    nearest = (rows >> np.uint64(16)).astype(np.int64)
    symbol = (rows & np.uint64(255)).astype(np.int64)
    for c in np.unique(nearest).tolist():
        logs = np.zeros(255)
        for b in range(GAPS):
            log_w, starts = below[b]
            mine = nearest[starts] == c
            np.add.at(logs, (1 << b) - 1 + (symbol[starts[mine]] >> (8 - b)), log_w[mine])
        top[c] = logs, np.bincount(symbol[nearest == c], n[nearest == c], 256).astype(np.int64)
    return mix, top


@dataclass
class Top:
    """The nodes of depth 0 and 1: for each, the chance of a one and the share of its own estimate; NaN where unseen."""

    one: np.ndarray
    share: np.ndarray

    @staticmethod
    def of(sums: dict[int, tuple[np.ndarray, np.ndarray]]) -> Top:
        one, share = np.full((257, 255), np.nan), np.full((257, 255), np.nan)
        logs, counts = np.zeros(255), np.zeros(256, np.int64)
        for c, (below, n) in sums.items():
            one[c], share[c], own = Top.nodes(below, n)
            logs += own
            counts += n
        one[256], share[256], _ = Top.nodes(logs, counts)
        return Top(one, share)

    @staticmethod
    def nodes(below: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        all_, ones = (np.concatenate([counts.reshape(1 << b, 2, -1).sum(axis=2)[:, k] for b in range(GAPS)]) for k in (0, 1))
        all_ = all_ + ones
        own = log_kt(all_ - ones, ones)
        either = np.logaddexp(own, below)
        seen = all_ > 0
        return np.where(seen, (ones + 0.5) / (all_ + 1), np.nan), np.where(seen, np.exp(own - either), np.nan), np.where(seen, either - math.log(2), 0.0)

    def log10(self, keys: np.ndarray, mix: np.ndarray) -> np.ndarray:
        """The base-10 logarithm of the chance of each key's byte given its context."""
        out = np.zeros(len(keys))
        nearest, symbol = (keys >> np.uint64(8 * DEPTH)).astype(np.int64), (keys & np.uint64(255)).astype(np.int64)
        for b in range(GAPS):
            node, bit = (1 << b) - 1 + (symbol >> (8 - b)), (symbol >> (7 - b)) & 1
            p = mix[:, b]
            for at in (nearest, 256):
                one, share = self.one[at, node], self.share[at, node]
                own = np.where(bit == 1, one, 1 - one)
                p = np.where(np.isnan(one), np.nan, np.where(np.isnan(p), own, share * own + (1 - share) * p))
            out += np.log10(np.where(np.isnan(p), 0.5, p))
        return out


ENTRY = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("batch", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
ENTRIES = "kind int, bucket int, batch int, keys binary, counts binary"


def rows_table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def distinct_words(words: set[bytes], buckets: int) -> dict[int, list[bytes]]:
    """The words of each bucket, sorted."""
    out: dict[int, list[bytes]] = {}
    for w in sorted(words):
        out.setdefault(zlib.crc32(w) % buckets, []).append(w)
    return out


class Batch:
    """The words and keys of a batch of documents, piece by piece."""

    def __init__(self, texts: list[str | None], taught: list[bool]):
        self.texts, self.taught = texts, taught
        self.words, self.counts = set(), Counter()
        parts, held, size = [(np.empty(0, np.uint64), np.empty(0, np.int64))], [], 0
        for x, teaches in zip(texts, taught, strict=True):
            words, data = stream(x)
            self.words.update(words)
            if teaches:
                self.counts.update(words)
            held.append((data, teaches))
            size += len(data)
            if size > PIECE:
                parts.append(self.piece(held))
                held, size = [], 0
        parts.append(self.piece(held))
        self.keys, self.n = merged(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    @staticmethod
    def piece(held: list[tuple[bytes, bool]]) -> tuple[np.ndarray, np.ndarray]:
        if not held:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        keys, begins = keys_of([x for x, _ in held])
        teaches = np.repeat(np.array([t for _, t in held]), np.diff(np.append(begins, len(keys))))
        both = np.sort((keys << np.uint64(1)) | teaches)
        starts = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        counts = np.diff(np.append(starts, len(both)))
        return merged(both[starts] >> np.uint64(1), np.where(both[starts] & np.uint64(1), counts, 0))


class Lookup:
    """Values of sorted distinct keys, by a hash table of places and, where two keys meet there, by bisection."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.shift = np.uint64(64 - max(4, (2 * len(keys)).bit_length() + 1))
        self.places = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.places[(keys * ODD) >> self.shift] = np.arange(len(keys), dtype=np.int32)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        at = self.places[(wanted * ODD) >> self.shift]
        wrong = np.flatnonzero(self.keys[at] != wanted)
        at[wrong] = np.searchsorted(self.keys, wanted[wrong])
        return self.values[at]


def scored(docs: DataFrame, taught, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, taught, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row.

    `taught`: a boolean column of `docs`; the model learns from those rows' whole texts. Scored are the words (runs of
    bytes other than ASCII white space, A-Z lower-cased), a space between two, and an end. score: log10 of their
    probability by context-tree weighting; each byte is eight binary choices, each choice's Krichevsky-Trofimov
    estimates under the 0 to 5 bytes before it are weighted against each other as the training texts' own likelihood
    asks; contexts that training never showed take no part. base_score: the add-one unigram score of the tokens.
    n_known: tokens that occur in training. bits_per_byte: code length of the bytes scored.

    Counting and scoring go by batches of whole documents (a hash of the key; about 16 MB of text each): a batch sends
    each distinct key and word once with its count, counts of a bucket of contexts are merged in a tree of tasks, and
    the buckets answer the batches with one number for each entry. Nothing but the nodes of depths 0 and 1 (257 * 255)
    is broadcast. Keys are of any type. A null text counts as empty: its end is its only token. Rows with equal or null
    keys are scored one by one; if nothing is taught, all chances are 1/2 a bit.
    """
    spark = docs.sparkSession
    # the key and `taught` are read as given; the text alone goes through Python
    rows = docs.select(F.col(key).alias("doc"), F.coalesce(taught, F.lit(False)).alias("taught"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    total = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    batches = max(1, -(-total // BATCH))
    word_buckets = 4 * batches
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64("doc", F.octet_length("body")), F.lit(batches)).cast("int")).repartition("batch")
    kind = rows.schema["doc"].dataType.simpleString()

    def entries(group: pa.Table) -> pa.Table:
        batch = group.column("batch")[0].as_py()
        taught = group.column("taught").to_pylist()
        own = Batch(group.column("body").to_pylist(), taught)
        to, out = bucket_of(own.keys), []
        for b in np.unique(to).tolist():
            out.append((0, b, batch, packed(own.keys[to == b]), own.n[to == b].tobytes()))
        for b, words in distinct_words(own.words, word_buckets).items():
            out.append((1, b, batch, b" ".join(words), np.array([own.counts[w] for w in words], np.int64).tobytes()))
        out.append((2, 0, batch, b"", np.array([sum(taught)], np.int64).tobytes()))
        return rows_table(out, ENTRY)

    def merge(group: pa.Table) -> pa.Table:
        found = merged(np.concatenate([unpacked(x) for x in group.column("keys").to_pylist()]), np.concatenate([np.frombuffer(x, np.int64) for x in group.column("counts").to_pylist()]))
        return rows_table([(0, group.column("bucket")[0].as_py(), group.column("batch")[0].as_py() // FAN_IN, packed(found[0]), found[1].tobytes())], ENTRY)

    def count_words(group: pa.Table) -> pa.Table:
        counts: Counter = Counter()
        rows = [(r["batch"], r["keys"].split(b" "), np.frombuffer(r["counts"], np.int64).tolist()) for r in group.to_pylist()]
        for _, words, n in rows:
            for w, k in zip(words, n, strict=True):
                counts[w] += k
        bucket = group.column("bucket")[0].as_py()
        out = [(1, bucket, batch, None, np.array([counts[w] for w in words], np.int64).tobytes()) for batch, words, _ in rows]
        seen = [n for n in counts.values() if n]
        return rows_table([*out, (3, bucket, -1, None, np.array([sum(seen), len(seen)], np.int64).tobytes())], ENTRY)

    tree = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("mix", pa.binary()), ("nearest", pa.int32()), ("logs", pa.binary()), ("counts", pa.binary())])

    def grow(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        keys, counts = merged(np.concatenate([unpacked(x) for x in group.column("keys").to_pylist()]), np.concatenate([np.frombuffer(x, np.int64) for x in group.column("counts").to_pylist()]))
        mix, top = subtree(keys, counts)
        return rows_table([(bucket, packed(keys), mix.astype(np.float32).tobytes(), None, None, None), *((bucket, None, None, c, logs.tobytes(), n.tobytes()) for c, (logs, n) in top.items())], tree)

    def add_up(group: pa.Table) -> pa.Table:
        logs, counts = (np.sum([np.frombuffer(x, t) for x in group.column(c).to_pylist()], axis=0) for c, t in (("logs", np.float64), ("counts", np.int64)))
        return rows_table([(-1, None, None, group.column("nearest")[0].as_py(), logs.tobytes(), counts.tobytes())], tree)

    sent = stored(dealt.groupBy("batch").applyInArrow(entries, ENTRIES))
    grams, levels = sent.where("kind = 0"), 1
    while FAN_IN**levels < batches:
        grams, levels = grams.groupBy("bucket", F.expr(f"batch div {FAN_IN}")).applyInArrow(merge, ENTRIES), levels + 1
    trees = "bucket int, keys binary, mix binary, nearest int, logs binary, counts binary"
    grown = stored(grams.groupBy("bucket").applyInArrow(grow, trees))
    sums = grown.where("nearest is not null").groupBy("nearest").applyInArrow(add_up, trees).collect()  # at most 256 rows
    top = spark.sparkContext.broadcast(Top.of({r["nearest"]: (np.frombuffer(r["logs"], np.float64), np.frombuffer(r["counts"], np.int64)) for r in sums}))
    words = stored(sent.where("kind = 1").groupBy("bucket").applyInArrow(count_words, ENTRIES))
    ends = sum(int(np.frombuffer(r["counts"], np.int64)[0]) for r in sent.where("kind = 2").select("counts").toLocalIterator())
    tokens, types = ends, int(ends > 0)
    for r in words.where("kind = 3").select("counts").toLocalIterator():
        n, v = np.frombuffer(r["counts"], np.int64).tolist()
        tokens, types = tokens + n, types + v

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        model = right.to_pylist()[0]
        keys = unpacked(model["keys"])
        values = top.value.log10(keys, np.frombuffer(model["mix"], np.float32).reshape(-1, GAPS).astype(np.float64))
        out = [(0, r["bucket"], r["batch"], None, values[np.searchsorted(keys, unpacked(r["keys"]))].astype(np.float32).tobytes()) for r in left.to_pylist()]
        return rows_table(out, ENTRY)

    salts = -(-batches // FAN_IN)
    asked = sent.where("kind = 0").withColumn("salt", F.expr(f"int(batch div {FAN_IN})"))
    known = grown.where("keys is not null").select("bucket", "keys", "mix").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    replies = asked.groupBy("bucket", "salt").cogroup(known.groupBy("bucket", "salt")).applyInArrow(answer, ENTRIES).unionByName(words.where("kind = 1"))
    result = pa.schema([("doc", pa.int64()), ("taught", pa.bool_()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("own", pa.float64()), ("score", pa.float64())])

    def score(group: pa.Table, replies: pa.Table) -> pa.Table:
        own_result = result.set(0, group.schema.field("doc"))
        if not group.num_rows:
            return rows_table([], own_result)
        texts, taught = group.column("body").to_pylist(), group.column("taught").to_pylist()
        own = Batch(texts, taught)
        values, to = np.zeros(len(own.keys)), bucket_of(own.keys)
        by_bucket, counts = distinct_words(own.words, word_buckets), {}
        for r in replies.to_pylist():
            if r["kind"] == 0:
                values[to == r["bucket"]] = np.frombuffer(r["counts"], np.float32)
            else:
                counts.update(zip(by_bucket[r["bucket"]], np.frombuffer(r["counts"], np.int64).tolist(), strict=True))
        logs = {w: math.log10(n + 1) for w, n in counts.items()}
        find, out, held, size = Lookup(own.keys, values), [], [], 0

        def flush() -> None:
            keys, begins = keys_of([x for _, x in held])
            sums = np.add.reduceat(find(keys), begins)
            out.extend((*row, float(s)) for (row, _), s in zip(held, sums, strict=True))

        for doc, teaches, x in zip(group.column("doc").to_pylist(), taught, texts, strict=True):
            tokens_, data = stream(x)
            known = sum(1 for w in tokens_ if counts[w])
            held.append(((doc, teaches, len(data), len(tokens_) + 1, known + (ends > 0), math.log10(ends + 1) + sum(map(logs.__getitem__, tokens_))), data))
            size += len(data)
            if size > PIECE:
                flush()
                held, size = [], 0
        if held:
            flush()
        return rows_table(out, own_result)

    made = dealt.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(score, f"doc {kind}, taught boolean, n_bytes long, n_tokens long, n_known long, own double, score double")
    base = F.col("own") - F.col("n_tokens") * math.log10(tokens + types + 1)
    return made.select(F.col("doc").alias(key), "taught", "n_bytes", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score", (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"))
