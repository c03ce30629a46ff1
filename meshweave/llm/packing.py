"""Packing of documents into training sequences: shortest pack first over the length histogram."""

from __future__ import annotations

import base64
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshweave.llm.common import broadcast_under, free_name, inlined, released, stored
from meshweave.llm.tokens import tokenizer

#: Characters for which both libraries' patterns are known to agree; other texts go to the slower library.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-ɏ]*")


@cache
def ranked(path: str):
    """An encoder of the same vocabulary as ranks, or None where there is no such file beside the .json."""
    import public_tokenizers
    import tiktoken

    try:
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    except FileNotFoundError:
        return None
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(path: str, text: str) -> list[int]:
    """The ids that the tokenizers library gives for `text`, without added special tokens."""
    fast = ranked(path)
    if fast is not None and "<|" not in text and PLAIN.fullmatch(text):
        return fast.encode_ordinary(text)
    return tokenizer(path).encode(text, add_special_tokens=False).ids


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Where the pieces of each length go: (length, first rank, rank after the last, first sequence, offset).

    Lengths are placed longest first. Those that fit go onto the shortest pack (of the most room), else a pack opens;
    packs of equal contents are one pattern with a count. The result has a row for each pattern and place in it: at most
    about three for each length, whatever the counts.
    """
    open_packs: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r, x in open_packs.items() if x and r >= length), default=0)
            count, held = open_packs[room].pop() if room else (left, ())
            used = min(left, count)
            if used < count:
                open_packs[room].append((count - used, held))
            open_packs[(room or size) - length].append((used, (*held, length)))
            left -= used
    rows, ranks, sequence = [], defaultdict(int), 0
    for count, held in (x for room in sorted(open_packs) for x in open_packs[room]):
        for length, offset in zip(held, accumulate(held, initial=0), strict=False):
            rows.append((length, ranks[length], ranks[length] + count, sequence, offset))
            ranks[length] += count
        sequence += count
    return rows


def pieces(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", size: int = 2048, end_id: int = 1) -> DataFrame:
    """(key, start, length, ids, doc_tokens): every document's ids and `end_id`, cut at each multiple of `size`.

    Null texts count as empty and give the end alone. Rows with equal keys keep their own pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out: tuple[list, ...] = ([], [], [], [], [])
                for row, x in enumerate(batch.column(1).to_pylist()):
                    ids = np.array([*ids_of(path, x or ""), end_id], "<u4")
                    for start in range(0, len(ids), size):
                        part = ids[start : start + size]
                        for column, value in zip(out, (row, start, len(part), part.tobytes(), len(ids)), strict=True):
                            column.append(value)
                names = [batch.column(0).take(pa.array(out[0], pa.int32())), *(pa.array(c, t) for c, t in zip(out[1:], (pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True))]
                yield released(pa.RecordBatch.from_arrays(names, [key, "start", "length", "ids", "doc_tokens"]))

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, start long, length long, ids binary, doc_tokens long")


def pack(cut: DataFrame, key: str = "doc_id", size: int = 2048, block: int = 1 << 17) -> DataFrame:
    """`cut` (key, start, length and any other columns) with sequence_id and offset.

    Pieces of a length are ranked by block (hash of key and start) and within it, so that a length which a third of
    the rows have is ranked by many tasks; there are as many blocks as leave about `block` rows of all lengths to each.
    The histogram has at most `size` rows and is all that the driver sees; the plan made of it has a row for each place
    of each pattern. Columns of any name stay. An empty input gives no rows.
    """
    spark = cut.sparkSession
    own_block, rank, before_it = (free_name(cut, x) for x in ("_block", "_rank", "_first"))
    blocks = max(64, -(-cut.count() // block))
    blocked = cut.withColumn(own_block, F.pmod(F.xxhash64(key, "start"), F.lit(blocks)))
    counts = stored(blocked.groupBy("length", own_block).agg(F.count("*").alias("n")))
    before = Window.partitionBy("length").orderBy(own_block).rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn(before_it, F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    own_length, low, high, first = (free_name(cut, x) for x in ("_length", "_low", "_high", "_sequence"))
    places = [dict(zip(("l", "a", "b", "s", "o"), map(int, row), strict=True)) for row in plan(histogram, size)]
    placed = inlined(spark, places, "l: bigint, a: bigint, b: bigint, s: bigint, o: bigint").toDF(own_length, low, high, first, "offset")
    own = Window.partitionBy("length", own_block).orderBy(key, "start")
    firsts = broadcast_under(firsts, 24)  # at most a row for each length and block
    ranked_cut = blocked.join(firsts, ["length", own_block]).withColumn(rank, F.col(before_it) + F.row_number().over(own) - 1).drop(before_it, own_block)

    # the plan goes to the pieces, so their ids stay where they are and pass no Python worker
    here = (F.col("length") == F.col(own_length)) & (F.col(rank) >= F.col(low)) & (F.col(rank) < F.col(high))
    return ranked_cut.join(F.broadcast(placed), here).select(*(F.col(f"`{c}`") for c in cut.columns), (F.col(first) + F.col(rank) - F.col(low)).alias("sequence_id"), "offset")


def crc_of(column: str):
    return F.crc32(column).cast("long")
