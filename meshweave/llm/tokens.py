"""Token counts of whole texts, with overlap resynchronisation for huge documents."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where no token can reach across, whatever stands left of it. A tokenizer that drops white space starts anew after
#: it; one that keeps it gives a lone space to the word that follows.
DROPS, KEEPS = re.compile(r"(?<=[\t-\r ])(?=[^\W_])"), re.compile(r"(?<=[^\W_])(?= [^\W_])")
SPACES = re.compile(r"[\t-\r ]+")
MEMO_WORDS = 200_000


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def drops_space(path: str) -> bool:
    """Whether the tokenizer's file says that runs of white space become one space, which no token then holds."""
    with open(path) as f:
        made = json.load(f)
    return any(x.get("type") == "Replace" and x["pattern"] == {"Regex": r"\s+"} for x in (made["normalizer"] or {}).get("normalizers", [])) and any(x.get("invert") and r"[^\s" in x["pattern"]["Regex"] for x in made["pre_tokenizer"].get("pretokenizers", []))


def encode_long(path: str, text: str, chunk: int, overlap: int) -> list[int]:
    """The ids of `text`, from overlapping chunks of `chunk` characters.

    Two neighbours are spliced at a place that both have as a token boundary, that is proven stable (DROPS, KEEPS),
    and from which on both give equal ids at equal offsets for the rest of the overlap's stable part. Where there is
    none, the overlap doubles and, if need be, swallows the whole chunk.
    """
    tok, places = tokenizer(path), DROPS if drops_space(path) else KEEPS

    def encode(a: int, b: int) -> list[tuple[int, int, int]]:
        made = tok.encode(text[a:b], add_special_tokens=False)
        return [(i, x + a, y + a) for i, (x, y) in zip(made.ids, made.offsets, strict=True)]

    begin, end = 0, min(chunk, len(text))
    left, ids = encode(begin, end), []
    while end < len(text):
        wide = overlap
        while True:
            start = max(begin, end - wide)
            stop = min(len(text), end + chunk)
            right = encode(start, stop)
            spliced = splice(left, right, [m.start() + start for m in places.finditer(text[start:end])][1:]) if start > begin else None
            if spliced is not None or start == begin:
                break
            wide *= 2
        if spliced is not None:
            ids += [x[0] for x in left[: spliced[0]]]
            right = right[spliced[1] :]
            begin = right[0][1] if right else start
        left, end = right, stop
    return ids + [x[0] for x in left]


def splice(left: list, right: list, stable: list[int]) -> tuple[int, int] | None:
    """How many tokens of left to keep and of right to skip, at the first stable place at which both agree up to the last one."""
    if len(stable) < 2:
        return None
    first, last = stable[0], stable[-1]
    a, b = ([x for x in side if first <= x[1] and x[2] <= last] for side in (left, right))
    if a != b or any(x[1] < p < x[2] for p in (first, last) for side in (left, right) for x in side):
        return None
    return sum(x[2] <= first for x in left), sum(x[2] <= first for x in right)


def count_tokens(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", limit: int = 2048, chunk: int = 32_768, overlap: int = 512) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row: the tokens of the whole text as the library gives them.

    `path`: a tokenizer's .json, readable on every executor. Texts of more than `chunk` characters are encoded in
    overlapping chunks (encode_long), so that no encoding holds a huge document. Shorter ones are encoded whole; where
    the tokenizer drops white space, each distinct word once, as its tokens never reach across it. A memo of at most
    MEMO_WORDS words serves that; it changes no result. Null texts count as empty: 0 bytes, 0 tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, memo = tokenizer(path), {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                texts = [x or "" for x in batch.column(1).to_pylist()]
                counts, short = [0] * len(texts), []
                for i, x in enumerate(texts):
                    if len(x) > chunk:
                        counts[i] = len(encode_long(path, x, chunk, overlap))
                    else:
                        short.append(i)
                if drops_space(path):
                    words = {i: SPACES.split(texts[i]) for i in short}
                    new = list({w for x in words.values() for w in x}.difference(memo))
                    found = dict(zip(new, map(len, tok.encode_batch_fast(new, add_special_tokens=False)), strict=True))
                    known = memo | found
                    for i, x in words.items():
                        counts[i] = sum(map(known.__getitem__, x))
                    if len(memo) < MEMO_WORDS:
                        memo = known
                else:
                    for i, e in zip(short, tok.encode_batch_fast([texts[i] for i in short], add_special_tokens=False), strict=True):
                        counts[i] = len(e)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(counts, pa.int64())], [key, "n_bytes", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    counted = docs.select(key, text).mapInArrow(run, f"{key} {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
