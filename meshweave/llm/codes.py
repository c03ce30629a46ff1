"""Token ids on disk as directly addressable codes: any id is read without decoding its neighbours.

The files are Parquet. A row is a segment: consecutive ids of consecutive documents in order of their key, as one
binary value in the format below, beside the list of the pieces of documents in it. Columns of a segment:

    part, segment   where the segment stands: ranges of keys, and its number within the range
    first, n        how many ids of its range stand before it, and how many it holds
    codes           the ids
    pieces          (row, key, start, at, n, doc_tokens): the row's number in its range, how many ids of the range
                    stand before the document, and n of its ids from `at` on; long documents go over several segments

The format of `codes`, all numbers little-endian and unsigned:

    magic           4 bytes, DAC1
    n_levels        1 byte; then the width in bits of each level's chunks, 1 byte each
    counts          8 bytes for each level: its number of chunks, padding included in none
    for each level  chunks: width bits each, from the lowest bit on, filled up with zeros to 8 bytes and 8 bytes more;
                    and, but for the last level,
                    bitmap: one bit a chunk, set where the id goes on in the next level, filled up to 64 bytes; and
                    ranks: 4 bytes for each 512 bits of the bitmap, how many bits are set before them

An id is cut from its lowest bits on: level k holds the chunks of all ids that have bits there. The chunk of id i in the
next level is the one at the rank of i among the bits set.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshweave.llm.common import broadcast_under, released, stored
from meshweave.llm.tokens import drops_space, tokenizer

MAGIC = b"DAC1"
#: Bits of a bitmap for which one number of the rank directory stands.
BLOCK = 512
#: Ids of a segment at most, and bytes of text that are encoded at a time.
SEGMENT, SLICE = 1 << 18, 8 << 20
#: Words that a worker remembers at most; others are encoded again, with the same result.
MEMO_WORDS = 400_000


def widths_of(histogram: dict[int, int], levels: int = 4) -> tuple[int, ...]:
    """The widths of the levels, lowest bits first, that make the codes of ids of these bit lengths smallest, by dynamic
    programming over the places where one level ends. A level but the last takes a bit more for the bitmap and its ranks
    (32 bits for every BLOCK) for each chunk."""
    top = max([1, *histogram])
    over = [sum(n for b, n in histogram.items() if b > at) for at in range(top + 1)]
    over[0] = sum(histogram.values())  # every id has a chunk in the first level
    cost = lambda a, b: over[a] * (b - a + (0 if b == top else 1 + 32 / BLOCK))
    best = {(top, 0): (0.0, ())}
    for used in range(1, levels + 1):
        for a in range(top):
            found = [(cost(a, b) + best[b, used - 1][0], (b - a, *best[b, used - 1][1])) for b in range(a + 1, top + 1) if (b, used - 1) in best]
            if found:
                best[a, used] = min(found)
    return min(best[0, used] for used in range(1, levels + 1) if (0, used) in best)[1]


def lengths(ids: np.ndarray) -> dict[int, int]:
    """How many ids have so many bits, at least 1."""
    counts = np.bincount(np.frexp(ids.astype(np.float64))[1], minlength=2)
    counts[1] += counts[0]
    return {b: int(n) for b, n in enumerate(counts) if n and b}


def packed(values: np.ndarray, width: int) -> bytes:
    """`values` at `width` bits each, filled up to whole words of 8 bytes and one more, so that every read stays inside."""
    size = 1 if width <= 8 else 2 if width <= 16 else 4
    octets = values.astype(f"<u{size}").view(np.uint8)
    if width < 8 * size:
        octets = np.packbits(np.unpackbits(octets.reshape(-1, size), axis=1, bitorder="little")[:, :width], bitorder="little")
    made = octets.tobytes()
    return made + bytes(-len(made) % 8 + 8)


def encoded(ids: np.ndarray, widths: tuple[int, ...]) -> bytes:
    """`ids` (unsigned, 32 bits) in the format of the module."""
    levels, left = [], ids.astype(np.uint32)
    for k, width in enumerate(widths):
        last = k == len(widths) - 1
        chunks = packed(left & np.uint32((1 << width) - 1), width)
        count, left = len(left), left >> np.uint32(width) if width < 32 else np.zeros_like(left)
        if last:
            if left.any():
                raise ValueError("an id has more bits than the levels")
            levels.append((count, chunks))
        else:
            more = left > 0
            bitmap = np.packbits(np.r_[more, np.zeros(-len(more) % BLOCK, bool)], bitorder="little")
            ones = np.bitwise_count(bitmap.view("<u8")).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
            ranks = np.r_[np.uint32(0), np.cumsum(ones, dtype=np.uint32)[:-1]].astype("<u4") if len(ones) else ones.astype("<u4")
            levels.append((count, chunks + bitmap.tobytes() + ranks.tobytes()))
            left = left[more]
    return MAGIC + bytes([len(widths), *widths]) + b"".join(n.to_bytes(8, "little") for n, _ in levels) + b"".join(x for _, x in levels)


class Segment:
    """Reads ids of a segment by their places. Opening it decodes nothing."""

    def __init__(self, codes: bytes | memoryview):
        view = memoryview(codes)
        if bytes(view[:4]) != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        self.widths = tuple(view[5 : 5 + view[4]])
        at = 5 + len(self.widths)
        counts = [int.from_bytes(view[at + 8 * k : at + 8 * k + 8], "little") for k in range(len(self.widths))]
        at += 8 * len(counts)
        self.n, self.levels = counts[0], []
        for k, (n, width) in enumerate(zip(counts, self.widths, strict=True)):
            size = (n * width + 7) // 8
            size += -size % 8 + 8
            chunks, at = np.frombuffer(view[at : at + size], np.uint8), at + size
            bitmap = ranks = None
            if k < len(counts) - 1:
                blocks = -(-n // BLOCK)
                bitmap, at = np.frombuffer(view[at : at + blocks * BLOCK // 8], "<u8" if blocks else np.uint64), at + blocks * BLOCK // 8
                ranks, at = np.frombuffer(view[at : at + 4 * blocks], "<u4"), at + 4 * blocks
            self.levels.append((n, width, chunks, bitmap, ranks))

    def __len__(self) -> int:
        return self.n

    def at(self, places: np.ndarray) -> np.ndarray:
        """The ids at `places`, in any order, through the chunk, bit and rank of each level alone."""
        places = np.asarray(places, np.int64)
        if len(places) and not (0 <= places.min() and places.max() < self.n):
            raise IndexError("place outside the segment")
        out, shift, rows = np.zeros(len(places), np.uint32), 0, np.arange(len(places))
        for _, width, chunks, bitmap, ranks in self.levels:
            bit = places * width
            begin = bit >> 3
            wide = np.zeros(len(places), np.uint64)
            for k in range(5):  # 32 bits from any bit of a byte
                wide |= chunks[begin + k].astype(np.uint64) << np.uint64(8 * k)
            value = (wide >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)
            out[rows] |= (value << np.uint64(shift)).astype(np.uint32)
            shift += width
            if bitmap is None:
                break
            word, within = places >> 6, (places & 63).astype(np.uint64)
            more = (bitmap[word] >> within) & np.uint64(1) > 0
            places, word, within, rows = places[more], word[more], within[more], rows[more]
            rank = ranks[places // BLOCK].astype(np.int64)
            for k in range(BLOCK // 64 - 1):  # whole words of the block before the place's own
                spot = places // BLOCK * (BLOCK // 64) + k
                rank += np.where(spot < word, np.bitwise_count(bitmap[spot]).astype(np.int64), 0)
            places = rank + np.bitwise_count(bitmap[word] & ((np.uint64(1) << within) - np.uint64(1)))
        return out

    @staticmethod
    def unpacked(chunks: np.ndarray, begin: int, end: int, width: int) -> np.ndarray:
        """Chunks `begin` to `end`: eight of them fill `width` whole bytes, so each of eight columns is shifted at once."""
        first, rows = begin // 8, -(-end // 8) - begin // 8
        octets = np.zeros((rows + 1) * width + 8, np.uint8)
        held = chunks[first * width : (first + rows + 1) * width + 8]
        octets[: len(held)] = held
        out = np.empty((rows, 8), np.uint32)
        for k in range(8):
            byte, shift = divmod(k * width, 8)
            wide = np.zeros(rows, np.uint64)
            for j in range((shift + width + 7) // 8):
                wide |= octets[byte + j :][: rows * width : width].astype(np.uint64) << np.uint64(8 * j)
            out[:, k] = (wide >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        return out.ravel()[begin - 8 * first : end - 8 * first]

    def between(self, begin: int, end: int) -> np.ndarray:
        """The ids from `begin` up to `end`: the stretch of each level in one go, which starts at the first one's rank."""
        if not 0 <= begin <= end <= self.n:
            raise IndexError("place outside the segment")
        out, shift, rows = np.zeros(end - begin, np.uint32), 0, slice(None)
        for _, width, chunks, bitmap, ranks in self.levels:
            if begin == end:
                break
            byte = begin * width // 8
            fill = 8 if width <= 8 else 16 if width <= 16 else 32
            if width == fill:
                value = chunks[byte : end * width // 8].view(f"<u{fill // 8}").astype(np.uint32)
            else:
                value = self.unpacked(chunks, begin, end, width)
            out[rows] |= value << np.uint32(shift)
            shift += width
            if bitmap is None:
                break
            more = np.unpackbits(bitmap[begin >> 6 : (end + 63) >> 6].view(np.uint8), bitorder="little")[begin & 63 :][: end - begin] > 0
            rows = np.flatnonzero(more) if isinstance(rows, slice) else rows[more]
            block = begin // BLOCK
            ahead = bitmap[block * (BLOCK // 64) : begin >> 6]
            rank = int(ranks[block]) + int(np.bitwise_count(ahead).sum()) + int(bitmap[begin >> 6] & np.uint64((1 << (begin & 63)) - 1)).bit_count()
            begin, end = rank, rank + int(more.sum())
        return out


#: A word of letters, of which the tokenizer's pattern makes one piece, and at most one mark after it, which makes another.
LETTERS, MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", ".,;:!?"


class WordIds:
    """The ids of whole texts for a tokenizer that drops white space and lower-cases: no token reaches across white
    space, so the library encodes each distinct word once, without its capitals and its last mark where it is plain.
    The first MEMO_WORDS words and units (words without those) are remembered; others are encoded again for each slice."""

    def __init__(self, path: str):
        self.tok = tokenizer(path)
        suffix = self.tok.model.end_of_word_suffix or None
        vocabulary = self.tok.get_vocab(with_added_tokens=False)
        #: Whether an id ends a piece of the pattern; None where the tokenizer does not mark that.
        self.final = None
        if suffix:
            self.final = np.zeros(max(vocabulary.values()) + 1, bool)
            self.final[[i for x, i in vocabulary.items() if x.endswith(suffix)]] = True
        # what is remembered: words with eight times their unit plus their mark, and units with their ids
        self.words, self.places = pa.array([], pa.string()), np.empty(0, np.int64)
        self.units, self.ends, self.pool = pa.array([], pa.string()), np.zeros(1, np.int64), np.empty(0, np.uint32)
        self.marks = np.zeros(1 + len(MARKS), np.int64)
        self.remember(pa.array(["", *MARKS]), *self.encoded(["", *MARKS], 0))
        self.marks[1:] = range(1, 1 + len(MARKS))

    def encoded(self, units: list[str], plain: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units, one after the other, and how many each has: many go to the library as one text. The
        first `plain` are one piece of the tokenizer's pattern each, so that one id of each ends a piece; of the others
        the places of the tokens tell which unit they are of."""
        if self.final is None:
            plain = 0
        joined = [" ".join(units[at : min(at + 512, plain)]) for at in range(0, plain, 512)]
        ids = [np.array(x.ids, np.uint32) for x in self.tok.encode_batch_fast(joined, add_special_tokens=False)]
        first = np.concatenate([np.empty(0, np.uint32), *ids])
        ids, sizes = [first], [np.diff(np.flatnonzero(self.final[first]) + 1, prepend=0) if plain else np.empty(0, np.int64)]
        for at in range(plain, len(units), 512):
            part = units[at : at + 512]
            made = self.tok.encode(" ".join(part), add_special_tokens=False)
            begins = np.array([a for a, _ in made.offsets], np.int64)
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
            ids.append(np.array(made.ids, np.uint32))
            sizes.append(np.diff(np.searchsorted(begins, np.r_[0, ends])))
        return np.concatenate(ids), np.concatenate(sizes)

    def remember(self, units: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.units = pa.concat_arrays([self.units, units])
        self.ends, self.pool = np.r_[self.ends, self.ends[-1] + np.cumsum(sizes)], np.r_[self.pool, ids]

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Eight times the unit plus the mark of each of distinct words, and the ends of all units in all ids, and these."""
        found = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy()
        at = np.full(len(words), -1, np.int64)
        at[found >= 0] = self.places[found[found >= 0]]
        new = words.filter(pa.array(found < 0))
        plain = pc.match_substring_regex(new, f"^{LETTERS}[{MARKS}]?$")
        bases = pc.if_else(plain, pc.utf8_lower(pc.utf8_rtrim(new, MARKS)), new)
        last = pc.index_in(pc.utf8_slice_codeunits(new, -1), value_set=pa.array(list(MARKS)))
        mark = np.where(plain.to_numpy(zero_copy_only=False), pc.fill_null(last, -1).to_numpy() + 1, 0)
        coded = bases.dictionary_encode()
        unit = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.units), -1).to_numpy().astype(np.int64)
        fresh = coded.dictionary.filter(pa.array(unit < 0))
        simple = pc.match_substring_regex(fresh, f"^{LETTERS}$").to_numpy(zero_copy_only=False)
        order = np.argsort(~simple, kind="stable")
        fresh = fresh.take(pa.array(order))
        numbers = np.empty(len(fresh), np.int64)
        numbers[order] = len(self.units) + np.arange(len(fresh))
        unit[unit < 0] = numbers
        ids, sizes = self.encoded(fresh.to_pylist(), int(simple.sum()))
        ends, pool = np.r_[self.ends, self.ends[-1] + np.cumsum(sizes)], np.r_[self.pool, ids]
        own = unit[coded.indices.to_numpy()]
        at[found < 0] = 8 * own + mark
        spare = min(len(fresh), MEMO_WORDS - len(self.units))
        if spare > 0:
            self.remember(fresh[:spare], ids[: int(sizes[:spare].sum())], sizes[:spare])
        lasting = np.flatnonzero(own < len(self.units))[: max(0, MEMO_WORDS - len(self.words))]
        if len(lasting):
            self.words = pa.concat_arrays([self.words, new.take(pa.array(lasting))])
            self.places = np.r_[self.places, (8 * own + mark)[lasting]]
        return at, ends, pool

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of `texts` (no nulls), one after the other, and how many each text has."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        at, ends, pool = self.of_words(coded.dictionary)
        units = np.stack([at >> 3, self.marks[at & 7]], axis=1)[coded.indices.to_numpy()].ravel()
        begins, sizes = ends[units], ends[units + 1] - ends[units]
        upto = np.cumsum(sizes)
        ids = pool[np.repeat(begins - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)]
        before = np.r_[0, upto][2 * (split.offsets.to_numpy() - split.offsets[0].as_py()).astype(np.int64)]
        return ids, np.diff(before)


@cache
def ids_for(path: str):
    """A function from texts to all their ids and how many each has, as the tokenizers library gives them."""
    if drops_space(path):
        return WordIds(path).of

    def of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        made = [x.ids for x in tokenizer(path).encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        return np.array([i for x in made for i in x], np.uint32), np.array(list(map(len, made)), np.int64)

    return of


def slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """`batch` in slices of about `size` bytes of a column each, at least a row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, stop - at)
        at = stop


PIECES = "array<struct<row: long, key: {kind}, start: long, at: long, n: long, doc_tokens: long>>"
FIELDS = ("row", "key", "start", "at", "n", "doc_tokens")


def write(docs: DataFrame, path: str, folder: str, text: str = "text", key: str = "doc_id", end_id: int = 2, segment: int = SEGMENT) -> None:
    """Write the ids of every text of `docs` to the new `folder`, a path of Spark's file systems, in order of the key.

    `path`: a tokenizer's .json, readable on every executor. Sampled keys deal the rows out in ranges, which are
    sorted; a task encodes its texts as they stream by, ends each document by `end_id` and cuts them into segments of at
    most `segment` ids, so that it holds a slice of texts, a segment and a document. A lost task is made again from the
    exchanged texts. Every segment has the widths of levels that are smallest for its own ids. Null texts count as
    empty and give the end alone. Rows of equal keys stand in the order of a hash of their texts, those of a null key
    first. An empty table gives a folder without segments.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # the hash stands for the text among the sampled keys; the number deals out rows that are equal in all else
    marked = rows.withColumns({"hash": F.xxhash64("text"), "number": F.monotonically_increasing_id()})
    dealt = marked.repartitionByRange("key", "hash", "number").sortWithinPartitions("key", "hash", "number")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        of = ids_for(path)
        for whole in batches:
            for batch in slices(whole, 1, SLICE):
                ids, counts = of(batch.column(1))
                ends = np.cumsum(counts)
                made = np.insert(ids, ends, end_id)
                for k, a, b in zip(batch.column(0).to_pylist(), (ends - counts + np.arange(len(ends))).tolist(), (ends + np.arange(1, len(ends) + 1)).tolist(), strict=True):
                    yield k, made[a:b]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, pieces, size, number, first, row, start = [], [], 0, 0, 0, 0, 0

        def out() -> pa.RecordBatch:
            nonlocal held, pieces, size, number, first
            arrays = [pa.array(v, key_type if k == "key" else pa.int64()) for k, v in zip(FIELDS, zip(*pieces, strict=True), strict=True)]
            listed = pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pa.StructArray.from_arrays(arrays, list(FIELDS)))
            ids = np.concatenate(held)
            made = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([first]), pa.array([size]), pa.array([encoded(ids, widths_of(lengths(ids)))], pa.binary()), listed], ["part", "segment", "first", "n", "codes", "pieces"])
            first, number = first + size, number + 1
            held, pieces, size = [], [], 0
            return released(made)

        batches = iter(batches)
        head = next(batches, None)
        if head is None:
            return
        key_type = head.schema.field("key").type
        for k, whole in documents(chain([head], batches)):
            n = len(whole)
            for at in range(0, n, segment):
                piece = whole[at : at + segment]
                # a document starts a new segment rather than go over its end
                if size and size + min(n, segment) > segment:
                    yield out()
                held.append(piece)
                pieces.append((row, k, start, at, len(piece), n))
                size += len(piece)
            row, start = row + 1, start + n
        if size:
            yield out()

    dealt.select("key", "text").mapInArrow(cut, f"part int, segment int, first long, n long, codes binary, pieces {PIECES.format(kind=kind)}").write.parquet(folder)


def ranges(spark: SparkSession, folder: str) -> DataFrame:
    """(part, before, n): how many ids stand before each range and in it; one row for each range that was written."""
    from pyspark.sql import Window

    sizes = spark.read.parquet(folder).groupBy("part").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"), "n")


def begun(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """`rows` of ranges with `first`, counted within the range, as `start`, counted over all files."""
    # a row of 20 bytes for each range, of which there are as many as shuffle partitions
    return rows.join(broadcast_under(ranges(spark, folder).drop("n"), 20), "part").withColumn("start", F.col("before") + F.col("first")).drop("before", "first")


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.StructArray, list[memoryview]]]:
    """For each segment its range, its pieces and the ids of each piece, as little-endian numbers of 4 bytes."""
    for batch in batches:
        for part, codes, pieces in zip(*(batch.column(x) for x in ("part", "codes", "pieces")), strict=True):
            segment, listed = Segment(codes.as_buffer()), pieces.values
            sizes = listed.field("n").to_numpy()
            ids = memoryview(np.ascontiguousarray(segment.between(0, len(segment)), "<u4")).cast("B")
            ends = 4 * np.cumsum(sizes)
            yield part.as_py(), listed, [ids[a:b] for a, b in zip((ends - 4 * sizes).tolist(), ends.tolist(), strict=True)]


def read(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """(part, row, key, start, n_tokens, at, ids) for every piece of a document in `folder`: how many ids stand before the
    document in all files, how many it has, and its ids from `at` on, as little-endian numbers of 4 bytes. Most
    documents are one piece."""
    files = spark.read.parquet(folder)
    kind = files.schema["pieces"].dataType.elementType["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, listed, blobs in opened(batches):
            columns = [listed.field(x) for x in ("key", "start", "doc_tokens", "at", "row")]
            yield released(pa.RecordBatch.from_arrays([pa.array([part] * len(blobs), pa.int32()), *columns, pa.array(blobs, pa.binary())], ["part", key, "first", "n_tokens", "at", "row", "ids"]))

    made = files.select("part", "codes", "pieces").mapInArrow(run, f"part int, {key} {kind}, first long, n_tokens long, at long, row long, ids binary")
    return begun(spark, folder, made).select("part", "row", key, "start", "n_tokens", "at", "ids")


def tokens_at(spark: SparkSession, folder: str, places: DataFrame, place: str = "place") -> DataFrame:
    """`places` (place: long, the number of an id in all files) with its id, each read by itself from its segment.

    Places are dealt to the segments that hold them; no segment is decoded. Each place that is asked for gives one row,
    so that a segment gets no more places than it has; a null place or one outside the files gives none.
    """
    heads = spark.read.parquet(folder).select("part", "segment", "first", "n")
    spans = heads.join(broadcast_under(ranges(spark, folder).drop("n"), 20), "part").select("part", "segment", (F.col("before") + F.col("first")).alias("begin"), F.col("n").alias("size"))
    # a segment covers few stretches of SEGMENT places, and a place lies in one
    covered = spans.withColumn("stretch", F.explode(F.sequence(F.expr(f"begin div {SEGMENT}"), F.expr(f"(begin + size - 1) div {SEGMENT}"))))
    asked = places.select(F.col(place).cast("long").alias("place")).distinct().withColumn("stretch", F.expr(f"place div {SEGMENT}"))
    met = asked.join(covered, "stretch").where("place >= begin and place < begin + size")
    wanted = met.groupBy("part", "segment").agg(F.collect_list(F.struct("place", (F.col("place") - F.col("begin")).alias("at"))).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, want in zip(batch.column("codes"), batch.column("asked"), strict=True):
                at = want.values.field("at").to_numpy()
                yield pa.RecordBatch.from_arrays([want.values.field("place"), pa.array(Segment(codes.as_buffer()).at(at).astype(np.int64))], [place, "id"])

    return wanted.join(spark.read.parquet(folder).select("part", "segment", "codes"), ["part", "segment"]).select("codes", "asked").mapInArrow(run, f"{place} long, id long")


def digests(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document in `folder`: unsigned crc32 of all its ids as read back.

    Sums of the pieces of a long document are joined in their order; only such documents are grouped.
    """
    files = spark.read.parquet(folder)
    kind = files.schema["pieces"].dataType.elementType["key"].dataType.simpleString()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, listed, blobs in opened(batches):
            crcs = [zlib.crc32(x) for x in blobs]
            columns = [listed.field(x) for x in ("key", "start", "doc_tokens", "at", "row", "n")]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(crcs), pa.int32()), *columns, pa.array(crcs, pa.int64())], ["part", key, "first", "n_tokens", "at", "row", "n", "crc"])

    pieces = files.select("part", "codes", "pieces").mapInArrow(sums, f"part int, {key} {kind}, first long, n_tokens long, at long, row long, n long, crc long")
    pieces = stored(begun(spark, folder, pieces).withColumn("size", 4 * F.col("n")))
    whole = pieces.where("n = n_tokens").select(key, "start", "n_tokens", F.col("crc").alias("ids_crc32"))
    split = pieces.where("n < n_tokens").groupBy("part", "row").agg(*(F.first(x).alias(x) for x in (key, "start", "n_tokens")), F.sort_array(F.collect_list(F.struct("at", "crc", "size"))).alias("sums"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for sums in batch.column("sums").to_pylist():
                crc = 0
                for x in sums:
                    zeros = bytes(x["size"])
                    crc = zlib.crc32(zeros, crc) ^ zlib.crc32(zeros) ^ x["crc"]
                made.append(crc)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in (key, "start", "n_tokens")), pa.array(made, pa.int64())], [key, "start", "n_tokens", "ids_crc32"])

    joined = split.select(key, "start", "n_tokens", "sums").mapInArrow(run, f"{key} {kind}, start long, n_tokens long, ids_crc32 long")
    return whole.unionByName(joined)
