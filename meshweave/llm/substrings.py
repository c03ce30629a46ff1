"""Repeated substrings by hashed surroundings of content-chosen anchors, in place of bucket-pointer refinement."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshweave.llm.common import released

#: A window holds its anchor at one of so many places.
PLACES = 31
#: More different surroundings than this behind one bucket: their windows are exchanged one by one.
HOT = 4096
#: Text bytes of a batch of documents, and of the pieces in which a batch is worked through.
BATCH, PIECE, MARGIN = 4 << 20, 1 << 17, 128
BUCKET_BITS = 40
BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * ODD
    x += b
    x ^= x >> np.uint64(32)
    return x


def gram_buckets(data: np.ndarray, gram: int) -> np.ndarray:
    """The bucket identifier of the `gram` bytes that begin at each place, by doubling: each level is made of pointers
    to the level below at the place and at a later offset, the last one overlapping."""
    ids, have = BYTES[data], 1
    while have < gram:
        step = min(have, gram - have)
        ids, have = mixed(ids[:-step], ids[step:]), have + step
    ids = ids * ODD
    return ids | np.uint64(1)


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over x[i : i + width] for every i at which it fits."""
    have = 1
    while have * 2 <= width:
        x = best(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return best(x[:-rest], x[rest:]) if rest else x


class Suffixes:
    """The chosen suffixes ("anchors") of a batch of texts and what identifies their surroundings.

    Of every window of `length` bytes the gram with the least identifier is an anchor, so two equal windows have equal
    anchors at the same place. `g` is the anchor's bucket; `around` refines it by the bucket pointers at the offsets
    that cover all windows which hold the anchor, that is the bytes from `left` to `right`.
    """

    def __init__(self, texts: list[bytes], length: int):
        self.length, self.texts = length, texts
        self.reach = PLACES - 1
        self.gram = length - self.reach
        parts = [self.piece(*p) for p in self.pieces()]
        whole = [np.concatenate(x) if parts else np.empty(0, np.int64) for x in zip(*parts, strict=True)] or [np.empty(0, np.uint64)] * 6
        self.doc, self.at, self.left, self.right, self.g, self.around = whole
        self.order = np.lexsort((self.around, self.g))
        g, around = self.g[self.order], self.around[self.order]
        self.fresh = np.ones(len(g), bool)
        self.fresh[1:] = (g[1:] != g[:-1]) | (around[1:] != around[:-1])
        self.entry = np.empty(len(g), np.int64)
        self.entry[self.order] = np.cumsum(self.fresh) - 1

    def pieces(self) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
        """Runs of whole short texts, and stretches of long ones with a margin: [(text, first byte kept, last)], and bounds."""
        held, size = [], 0
        for i, text in enumerate(self.texts):
            n = len(text)
            if n < self.length:
                continue
            for a in range(0, n, PIECE):
                b = min(n, a + PIECE)
                if size and size + b - a > PIECE:
                    yield (held,)
                    held, size = [], 0
                held.append((i, a, b))
                size += b - a
        if held:
            yield (held,)

    def piece(self, held: list[tuple[int, int, int]]) -> tuple[np.ndarray, ...]:
        lows = [max(0, a - MARGIN) for _, a, _ in held]
        highs = [min(len(self.texts[i]), b + MARGIN) for i, _, b in held]
        data = np.frombuffer(b"".join(self.texts[i][lo:hi] for (i, _, _), lo, hi in zip(held, lows, highs, strict=True)), np.uint8)
        sizes = np.array([hi - lo for lo, hi in zip(lows, highs, strict=True)])
        ends = np.cumsum(sizes)
        ids = gram_buckets(data, self.gram)
        least = sliding(ids, self.reach + 1, np.minimum)  # of the window that begins there
        for e in ends[:-1]:
            least[max(0, e - self.length + 1) : e] = 0  # windows across two texts
        padded = np.zeros(len(least) + 2 * self.reach, np.uint64)
        padded[self.reach : self.reach + len(least)] = least
        chosen = np.flatnonzero(sliding(padded, self.reach + 1, np.maximum)[: len(ids)] == ids)
        which = np.searchsorted(ends, chosen, "right")
        shift = np.array(lows) - (ends - sizes)
        place = chosen + shift[which]
        first, last = (np.array([x[k] for x in held]) for k in (1, 2))
        own = (place >= first[which]) & (place < last[which])
        chosen, which, place = chosen[own], which[own], place[own]
        doc = np.array([x[0] for x in held])[which]
        total = np.array([len(self.texts[x[0]]) for x in held])[which]
        left, right = np.maximum(place - self.reach, 0), np.minimum(place + self.length, total)
        off = chosen - place
        around = mixed(left.astype(np.uint64) - place.astype(np.uint64), (right - place).astype(np.uint64))
        for step in range(-self.reach, self.length, self.gram):
            around = mixed(around, ids[np.clip(place + step, left, right - self.gram) + off])
        around = mixed(around, ids[right - self.gram + off])
        return doc, place, left, right, ids[chosen] >> np.uint64(64 - BUCKET_BITS), around

    def surroundings(self, which: np.ndarray) -> bytes:
        """The bytes around the anchors `which`, end to end."""
        return b"".join(self.texts[d][a:b] for d, a, b in zip(self.doc[which].tolist(), self.left[which].tolist(), self.right[which].tolist(), strict=True))


def windows(data: bytes, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, offset in it, bucket, name) of every window of stretches of `sizes` bytes laid end to end."""
    out, gram, ends, at = [], length - PLACES + 1, np.cumsum(sizes), 0
    for k in np.array_split(np.arange(len(sizes)), -(-len(sizes) // 4096)) if len(sizes) else []:
        stop = int(ends[k[-1]])
        ids = gram_buckets(np.frombuffer(data, np.uint8, stop - at, at), gram)
        begins, counts = ends[k] - sizes[k] - at, sizes[k] - length + 1
        owner = np.repeat(np.arange(len(k)), counts)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        p = begins[owner] + step
        name = np.full(len(p), length, np.uint64)
        for s in range(0, length - gram, gram):
            name = mixed(name, ids[p + s])
        name = mixed(name, ids[p + length - gram])
        out.append((k[owner], step, (mixed(name, ids[p]) * ODD) >> np.uint64(64 - BUCKET_BITS), name))
        at = stop
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))


ENTRIES = "bucket int, batch int, n int, g binary, name binary, least binary, many binary"


def sent(batch: int, buckets: int, g: np.ndarray, name: np.ndarray, least: np.ndarray, many: np.ndarray) -> list[tuple]:
    """A batch's distinct entries, sorted by g and name, as a row for each bucket; the g of a row are differences."""
    if not len(g):
        return []
    to = (g * np.uint64(buckets)) >> np.uint64(BUCKET_BITS)
    cut = np.flatnonzero(np.diff(to, prepend=np.uint64(buckets + 1)))
    rows = []
    for a, b in zip(cut, [*cut[1:], len(g)], strict=True):
        steps = np.diff(g[a:b], prepend=np.uint64(0))
        rows.append((int(to[a]), batch, b - a, steps.tobytes(), name[a:b].tobytes(), least[a:b].tobytes(), np.packbits(many[a:b]).tobytes()))
    return rows


def gathered(group: pa.Table, hot: int = HOT) -> pa.Table:
    """The replies to one bucket's entries: (batch, bucket, n, at, least, split).

    at: which of the batch's entries; least: the smallest document with an equal entry; split: whether other entries
    share its g, so that its windows must be told apart (2: more than `hot` others). Entries that learn nothing new get no reply.
    """
    column = lambda name: group.column(name).to_pylist()
    sizes, batches = np.array(column("n")), np.array(column("batch"))
    g = np.concatenate([np.cumsum(np.frombuffer(x, np.uint64)) for x in column("g")])
    name = np.concatenate([np.frombuffer(x, np.uint64) for x in column("name")])
    least = np.concatenate([np.frombuffer(x, np.int64) for x in column("least")])
    many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(column("many"), sizes, strict=True)])
    order = np.lexsort((name, g))
    g, name = g[order], name[order]
    new_g = np.concatenate([[True], g[1:] != g[:-1]])
    new = new_g | np.concatenate([[True], name[1:] != name[:-1]])
    by, by_g = np.cumsum(new) - 1, np.cumsum(new_g) - 1
    starts, starts_g = np.flatnonzero(new), np.flatnonzero(new_g)
    smallest = np.minimum.reduceat(least[order], starts)
    low, high = np.minimum.reduceat(least[order], starts_g), np.maximum.reduceat(least[order], starts_g)
    several = (low < high) | np.logical_or.reduceat(many[order] > 0, starts_g)
    kinds = np.add.reduceat(new.astype(np.int64), starts_g)
    split = np.where((kinds > 1) & several, 1 + (kinds > hot), 0).astype(np.uint8)
    told = (smallest[by] < least[order]) | (split[by_g] > 0)
    row, answer, parts = order[told], smallest[by][told], split[by_g][told]
    sort = np.argsort(row)
    row, answer, parts = row[sort], answer[sort], parts[sort]
    bounds = np.cumsum(sizes)
    owner = np.searchsorted(bounds, row, "right")
    cut = np.searchsorted(owner, np.arange(len(sizes) + 1))
    out = [(int(batches[k]), int(group.column("bucket")[0].as_py()), cut[k + 1] - cut[k], (row[cut[k] : cut[k + 1]] - (bounds[k] - sizes[k])).astype(np.uint32).tobytes(), answer[cut[k] : cut[k + 1]].tobytes(), parts[cut[k] : cut[k + 1]].tobytes()) for k in range(len(sizes)) if cut[k] < cut[k + 1]]
    return pa.Table.from_pylist([dict(zip(REPLY.names, x, strict=True)) for x in out], schema=REPLY)


REPLY = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("at", pa.binary()), ("least", pa.binary()), ("split", pa.binary())])
REPLIES = "batch int, bucket int, n int, at binary, least binary, split binary"


def answered(replies: pa.Table | list[dict], g: np.ndarray, least: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For a batch's distinct entries: the smallest document of each, and how it is split."""
    least, split = least.copy(), np.zeros(len(g), np.uint8)
    to = ((g * np.uint64(buckets)) >> np.uint64(BUCKET_BITS)).astype(np.int64)
    for x in replies if isinstance(replies, list) else replies.to_pylist():
        at = np.searchsorted(to, x["bucket"]) + np.frombuffer(x["at"], np.uint32).astype(np.int64)
        least[at] = np.frombuffer(x["least"], np.int64)
        split[at] = np.frombuffer(x["split"], np.uint8)
    return least, split


def left_over(text: bytes, begins: np.ndarray, ends: np.ndarray) -> tuple[int, int, str]:
    """(removed bytes, removed runs, SHA-256 of the rest) of `text` without the bytes from each begin to its end."""
    if not len(begins):
        return 0, 0, hashlib.sha256(text).hexdigest()
    depth = np.bincount(begins, minlength=len(text) + 1) - np.bincount(ends, minlength=len(text) + 1)
    gone = np.cumsum(depth)[: len(text)] > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    rest = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()


MESSAGE = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), *((x, pa.binary()) for x in "abcd")])
MESSAGES = "bucket int, batch int, kind int, n int, a binary, b binary, c binary, d binary"
#: Kinds of messages: surroundings to compare, windows to compare, and what a batch tells its own last round.
SURROUNDINGS, WINDOWS, KEPT = 0, 1, 2


def compared(group: pa.Table, length: int) -> pa.Table:
    """The answers to one bucket: for surroundings, which of their windows also lie in a smaller document (bits)."""
    rows = group.to_pylist()
    out = [r for r in rows if r["kind"] == KEPT]
    asked = [r for r in rows if r["kind"] == SURROUNDINGS]
    if asked:
        sizes = np.concatenate([np.frombuffer(r["a"], np.uint8) for r in asked]).astype(np.int64)
        ids = np.concatenate([np.frombuffer(r["c"], np.int64) for r in asked])
        owner, step, check, name = windows(b"".join(r["b"] for r in asked), sizes, length)
        order = np.lexsort((check, name))
        fresh = np.concatenate([[True], (name[order][1:] != name[order][:-1]) | (check[order][1:] != check[order][:-1])])
        smallest = np.minimum.reduceat(ids[owner[order]], np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
        hit = order[smallest < ids[owner[order]]]
        bits = np.bincount(owner[hit], 2.0 ** step[hit], len(sizes)).astype(np.uint32)
        at = 0
        for r in asked:
            mine = bits[at : at + r["n"]]
            at += r["n"]
            if mine.any():
                out.append(r | {"a": mine.tobytes(), "b": None, "c": None})
    entries = [r for r in rows if r["kind"] == WINDOWS]
    if entries:
        table = pa.Table.from_pylist([{"bucket": r["bucket"], "batch": r["batch"], "n": r["n"], "g": r["a"], "name": r["b"], "least": r["c"], "many": r["d"]} for r in entries])
        out += [{"bucket": r["bucket"], "batch": r["batch"], "kind": WINDOWS, "n": r["n"], "a": r["at"], "b": r["least"]} for r in gathered(table).to_pylist()]
    return pa.Table.from_pylist(out, schema=MESSAGE)


def repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = 50, hot_bucket: int = HOT) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every row: its text without each byte that is covered by a
    string of `length` bytes which also starts in a document with a smaller key.

    Of every window of `length` bytes one gram is an anchor (about 6 % of all places), and only anchors are compared:
    they are put into buckets by a hash of their gram and told apart by a hash of what stands around them, made by
    doubling (Suffixes). No bucket is refined by the ranks of later offsets. Anchors with equal surroundings are equal
    in all their windows. Where one bucket holds different surroundings, these few meet and their windows are compared
    by hashes that cover them; behind a bucket with more than `hot_bucket` of them (a passage that a large share
    of all documents holds) the windows are exchanged one by one instead, each once a batch.

    All rounds go by batches of documents, about 4 MB of text each: a batch sends its distinct entries with their
    smallest document, and each bucket answers the batches that have something to learn. Batches and buckets grow in
    number with the text, not in size. The three rounds read one shuffle of the texts. Equality is
    that of identifiers of 104 bits, which are not checked on the bytes.

    Null texts count as empty. Keys are integers, others raise ValueError; rows with equal keys are one document for
    "smaller" and each gets its own row; rows with a null key lose nothing and take nothing.
    """
    if not PLACES < length < 256 - PLACES:
        raise ValueError(f"lengths from {PLACES + 1} to {255 - PLACES} are told apart")
    if docs.schema[key].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{key} is {docs.schema[key].dataType.simpleString()}: whose document comes first is told by integer keys")
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    total = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    batches = max(1, -(-total // BATCH))
    buckets = 2 * batches
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64("doc", F.octet_length("body")), F.lit(batches)).cast("int")).repartition("batch")

    def read(group: pa.Table) -> tuple[list, list[bytes], np.ndarray]:
        """Keys, bodies and numbers, in an order that each round finds again."""
        rows = sorted(zip(group.column("doc").to_pylist(), group.column("body").to_pylist(), strict=True), key=lambda r: (r[0] is None, r[0], r[1]))
        keys = [k for k, _ in rows]
        return keys, [body for _, body in rows], np.array([np.iinfo(np.int64).max if k is None else k for k in keys], np.int64)

    def entries_of(found: Suffixes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        by = ids[found.doc[found.order]]
        starts = np.flatnonzero(found.fresh)
        least = np.minimum.reduceat(by, starts) if len(starts) else by
        most = np.maximum.reduceat(by, starts) if len(starts) else by
        return found.g[found.order][starts], found.around[found.order][starts], least, most > least

    def table(rows: list[tuple], names: list[str], schema: pa.Schema) -> pa.Table:
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(len(names))], schema=schema)

    entry_schema = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("n", pa.int32()), ("g", pa.binary()), ("name", pa.binary()), ("least", pa.binary()), ("many", pa.binary())])
    def first_round(group: pa.Table) -> pa.Table:
        _, bodies, ids = read(group)
        made = entries_of(Suffixes(bodies, length), ids)
        return table(sent(group.column("batch")[0].as_py(), buckets, *made), entry_schema.names, entry_schema)

    def second_round(group: pa.Table, replies: pa.Table) -> pa.Table:
        if not group.num_rows:
            return table([], MESSAGE.names, MESSAGE)
        _, bodies, ids = read(group)
        batch = group.column("batch")[0].as_py()
        found = Suffixes(bodies, length)
        g, _, least, _ = entries_of(found, ids)
        least, split = answered(replies, g, least, buckets)
        mine, kind = ids[found.doc], split[found.entry]
        real = mine < np.iinfo(np.int64).max
        covered = (least[found.entry] < mine) & real
        asks, hot = (np.flatnonzero((kind == k) & ~covered & real) for k in (1, 2))
        to = ((found.g[asks] * np.uint64(buckets)) >> np.uint64(BUCKET_BITS)).astype(np.int64)
        asks, to = asks[np.argsort(to, kind="stable")], np.sort(to)
        out = []
        for b in np.unique(to).tolist():
            k = asks[to == b]
            out.append((b, batch, SURROUNDINGS, len(k), (found.right[k] - found.left[k]).astype(np.uint8).tobytes(), found.surroundings(k), mine[k].tobytes(), None))
        owner, step, wg, name = windows(found.surroundings(hot), found.right[hot] - found.left[hot], length)
        order = np.lexsort((name, wg))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (wg[order][1:] != wg[order][:-1]) | (name[order][1:] != name[order][:-1])
        starts = np.flatnonzero(fresh)
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(fresh) - 1
        by = mine[hot][owner][order]
        wleast = np.minimum.reduceat(by, starts) if len(starts) else by
        wg = wg[order][starts]
        out += [(r[0], batch, WINDOWS, *r[2:]) for r in sent(batch, buckets, wg, name[order][starts], wleast, np.zeros(len(starts), bool))]
        c = np.flatnonzero(covered)
        at = found.left[hot][owner] + step
        kept = [np.stack([found.doc[c], found.left[c], found.right[c]]), np.stack([found.doc[asks], found.left[asks], to]), np.stack([found.doc[hot][owner], at, entry]), np.stack([wg.astype(np.int64), wleast])]
        out.append((batch % buckets, batch, KEPT, 0, *(x.astype(np.int64).tobytes() for x in kept)))
        return table(out, MESSAGE.names, MESSAGE)

    def last_round(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows:
            return table([], result.names, result)
        keys, bodies, ids = read(group)
        rows = answers.to_pylist()
        own = next(r for r in rows if r["kind"] == KEPT)
        spans, asks, hot, entries = (np.frombuffer(own[x], np.int64).reshape(n, -1) for x, n in zip("abcd", (3, 3, 3, 2), strict=True))
        bits = np.zeros(asks.shape[1], np.uint32)
        for r in rows:
            if r["kind"] == SURROUNDINGS:
                bits[asks[2] == r["bucket"]] = np.frombuffer(r["a"], np.uint32)
        least, _ = answered([r | {"at": r["a"], "least": r["b"], "split": bytes(r["n"])} for r in rows if r["kind"] == WINDOWS], entries[0].astype(np.uint64), entries[1], buckets)
        which, step = np.nonzero((bits[:, None] >> np.arange(PLACES, dtype=np.uint32)) & 1)
        late = hot[:2, least[hot[2]] < ids[hot[0]]]
        doc = np.concatenate([spans[0], asks[0][which], late[0]])
        begin = np.concatenate([spans[1], asks[1][which] + step, late[1]])
        end = np.concatenate([spans[2], asks[1][which] + step + length, late[1] + length])
        order = np.argsort(doc, kind="stable")
        cut = np.searchsorted(doc[order], np.arange(len(keys) + 1))
        out = [(k, len(body), *left_over(body, begin[order[cut[i] : cut[i + 1]]], end[order[cut[i] : cut[i + 1]]])) for i, (k, body) in enumerate(zip(keys, bodies, strict=True))]
        return table(out, result.names, result)

    result = pa.schema([("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    replies = dealt.groupBy("batch").applyInArrow(lambda group: released(first_round(group)), ENTRIES).groupBy("bucket").applyInArrow(lambda group: released(gathered(group, hot_bucket)), REPLIES)
    messages = dealt.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(lambda group, answers: released(second_round(group, answers)), MESSAGES)
    answers = messages.groupBy("bucket").applyInArrow(lambda group: released(compared(group, length)), MESSAGES)
    made = dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(lambda group, told: released(last_round(group, told)), "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return made.withColumnRenamed("doc", key)
