"""Periodic runs of words by the algorithm of Kolpakov and Kucherov, a document at a time."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Rows of a batch are taken in slices of about so many bytes of text.
SLICE = 8 << 20


def factors(w: list[int]) -> list[tuple[int, int, int]]:
    """The Lempel-Ziv factors of `w`: (begin, end, earlier begin). A factor is the longest stretch that also begins at
    an earlier place, which may overlap it, or else one new letter (earlier begin -1).

    The suffix automaton of `w` keeps for each state where its strings end for the first time. A factor follows the
    automaton from its root as long as that first end lies before the current letter.
    """
    follow: list[dict[int, int]] = [{}]
    longest, link, ends = [0], [-1], [-1]
    last = 0
    for i, c in enumerate(w):
        new = len(follow)
        follow.append({})
        longest.append(i + 1)
        link.append(0)
        ends.append(i)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                copy = len(follow)
                follow.append(follow[q].copy())
                longest.append(longest[p] + 1)
                link.append(link[q])
                ends.append(ends[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    out, at, n = [], 0, len(w)
    while at < n:
        state, j = 0, at
        while j < n:
            state_next = follow[state].get(w[j])
            if state_next is None or ends[state_next] >= j:
                break
            state, j = state_next, j + 1
        if j == at:
            out.append((at, at + 1, -1))
            at += 1
        else:
            out.append((at, j, ends[state] - (j - at) + 1))
            at = j
    return out


def prefix_lengths(s: list[int]) -> list[int]:
    """For each place of `s`, how far what stands there equals the beginning of `s`."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def touching(w: list[int], lo: int, b: int, hi: int, least: int, power: int) -> Iterator[tuple[int, int, int]]:
    """Main's search: (begin, end, period) of repetitions within w[lo:hi] that touch the boundary `b`, are at least
    `least` and `power` periods long, and that stop inside the window or where `w` ends.

    One has a period's length on the right of the boundary or on the left of it. With that period, it reaches as far as
    the letters on both sides of two places a period apart agree; four arrays of common prefixes hold this for all
    periods, in time linear in the window.
    """
    left, right = w[lo:b], w[b:hi]
    a, c, n = len(left), len(right), len(w)
    mark = [-1]
    back = left[::-1]
    ahead = prefix_lengths(right)  # right against itself
    behind = prefix_lengths(back)  # left against itself, from the boundary
    over = prefix_lengths(right + mark + left)[c + 1 :]  # right against each place on the left
    under = prefix_lengths(back + mark + right[::-1])[a + 1 :]  # left, from the boundary, against each prefix of right
    for q in range(1, c + 1):
        fore = ahead[q] if q < c else 0
        aft = under[c - q]
        if aft == q < a:  # the whole period agrees, and the left side goes on by itself
            aft += behind[q]
        begin, end = b - aft, b + q + fore
        if end - begin >= least and end - begin >= power * q and (aft < a or lo == 0) and (end < hi or hi == n):
            yield begin, end, q
    for q in range(1, a + 1):
        fore = over[a - q]
        if fore == q < c:
            fore += ahead[q]
        aft = behind[q] if q < a else 0
        begin, end = b - q - aft, b + fore
        if end - begin >= least and end - begin >= power * q and (begin > lo or lo == 0) and (end < hi or hi == n):
            yield begin, end, q


def runs_of(w: list[int], least: int = 24, power: int = 3) -> list[tuple[int, int, int]]:
    """(begin, end, smallest period) of every maximal run of `w` of at least `least` letters and `power` periods
    (`power` 2 or more), in order.

    A run that touches the beginning of a factor or the end of `w` is found there by touching(). With the factors f before and g after the
    boundary, one that ends within g has less than |f| + |g| letters after its first period, as f would else go on;
    these are power - 1 periods or more, so it begins less than |f| + (|f| + |g|) / (power - 1) letters before the
    boundary, which bounds the window. All others lie with their neighbours inside one factor. They are copied from
    its earlier occurrence, where they are known already.
    """
    if not w:
        return []
    n, parts = len(w), factors(w)
    starts: dict[int, dict[int, int]] = {}  # begin: {end: period}

    def keep(begin: int, end: int, q: int) -> None:
        held = starts.setdefault(begin, {})
        held[end] = min(q, held.get(end, q))

    for (f, b, _), (_, e, _) in zip(parts, [*parts[1:], (n, n, -1)], strict=True):
        lo, hi = max(0, f - (e - f) // (power - 1) - 2), min(n, e + 1)
        if hi - lo >= least:
            for x in touching(w, lo, b, hi, least, power):
                keep(*x)
    for b, e, source in parts:
        if e - b - 2 < least or source < 0:
            continue
        shift = b - source
        # in the order of their beginnings, so that runs copied into this factor are copied on from an overlap
        for s in range(source + 1, e - shift):
            for end, q in list(starts.get(s, {}).items()):
                if end + shift < e:
                    keep(s + shift, end + shift, q)
    return sorted((s, end, q) for s, held in starts.items() for end, q in held.items())


def repeated_stretches(words: np.ndarray, doc: np.ndarray, least: int = 24, power: int = 3) -> list[tuple[int, int]]:
    """Stretches [begin, end) of `words` outside of which no run lies, within documents (`doc`: one number a word).

    Let g be floor(least / power). A run of period q has max(least, power q) words or more, so for power 3 and any of
    its stretches of g words, the equal one a period before or after it lies in the run too: with q <= g,
    least - 2q >= g, else power q - 2q >= g. Words where no stretch of g words that repeats in the document covers them
    are in no run, and a run's words are covered without a gap. Equal stretches are told by 64-bit hashes; unequal ones
    of equal hash only make a stretch longer.
    """
    g, n = least // power, len(words)
    if n < least or power < 3:
        return [(int(a), int(b)) for a, b in spans_of(doc)]
    table = np.random.default_rng(7).integers(1, 1 << 63, int(words.max()) + 1, np.uint64)
    value, factor = table[words], np.uint64(0x9E3779B97F4A7C15)
    h = np.zeros(n - g + 1, np.uint64)
    for k in range(g):
        h = h * factor + value[k : n - g + 1 + k]
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xBF58476D1CE4E5B9) + doc[: n - g + 1].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    whole = doc[: n - g + 1] == doc[g - 1 :]
    order = np.sort(h[whole])
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return []
    at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    begins = np.flatnonzero((twice[at] == h) & whole)
    # stretches that follow one another without a gap are one
    cut = np.flatnonzero((np.diff(begins) > 1) | (doc[begins[1:]] != doc[begins[:-1]])) + 1
    first, last = begins[np.r_[0, cut]], begins[np.r_[cut - 1, len(begins) - 1]] + g
    wide = last - first >= least
    return list(zip(first[wide].tolist(), last[wide].tolist(), strict=True))


def spans_of(doc: np.ndarray) -> np.ndarray:
    """[begin, end) of each document in the sorted array of document numbers."""
    cut = np.flatnonzero(np.diff(doc)) + 1
    return np.stack([np.r_[0, cut], np.r_[cut, len(doc)]], axis=1) if len(doc) else np.empty((0, 2), np.int64)


def planted(n: int, h: int) -> tuple[int, int] | None:
    """(a, p) where the `n` words of a document of hash `h` become periodic: word i >= a becomes word a + (i - a) % p."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def word_batches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of (key, text) of about SLICE bytes of text each, at least a row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + SLICE, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def found(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = 24, power: int = 3, plant: bool = False) -> DataFrame:
    """(key, n_words, runs, collapsed) of every row: its runs (start, length, period, in words), by start, then period,
    and its words without those that a run covers after its first period, joined by one space.

    Words are what stands between ASCII white space. A null or empty text has no words, no runs and an empty collapsed
    text. Rows of a null key and repeated keys are rows as others. `plant` first makes documents periodic as planted()
    says, by crc32 of the decimal key; a null key leaves its text as it is.

    Documents are independent, so nothing is shuffled; a slice of SLICE bytes of text is in a task's memory at a time,
    and work is linear in the words. Only stretches that can hold a run (repeated_stretches()) are factorised.
    """
    kind = docs.schema[key].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, texts = batch.column(0), pc.fill_null(batch.column(1), "")
        split = pc.ascii_split_whitespace(texts)
        flat = split.flatten()
        counts = np.diff(split.offsets.to_numpy())
        doc = np.repeat(np.arange(len(texts)), counts)
        full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        if not full.all():
            flat, doc = flat.filter(pa.array(full)), doc[full]
        sizes = np.bincount(doc, minlength=len(texts))
        offsets = np.r_[0, np.cumsum(sizes)]
        coded = flat.dictionary_encode()
        words = coded.indices.to_numpy().astype(np.int64)
        if plant:
            for row, k in enumerate(keys.to_pylist()):
                made = None if k is None else planted(int(sizes[row]), zlib.crc32(str(k).encode()))
                if made is not None:
                    a, p = made
                    own = words[offsets[row] : offsets[row + 1]]
                    own[a:] = own[a : a + p][np.arange(len(own) - a) % p]
        runs: list[list[dict]] = [[] for _ in range(len(texts))]
        dropped = np.zeros(len(words) + 1, np.int32)
        for begin, end in repeated_stretches(words, doc, least, power):
            row = int(doc[begin])
            for s, e, q in runs_of(words[begin:end].tolist(), least, power):
                runs[row].append({"start": begin + s - int(offsets[row]), "length": e - s, "period": q})
                dropped[begin + s + q] += 1
                dropped[begin + e] -= 1
        for x in runs:
            x.sort(key=lambda r: (r["start"], r["period"]))
        kept = np.cumsum(dropped[:-1]) == 0
        offsets_kept = np.r_[0, np.cumsum(np.bincount(doc[kept], minlength=len(texts)))].astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets_kept), coded.dictionary.take(pa.array(words[kept]))), " ")
        return pa.RecordBatch.from_arrays([keys, pa.array(sizes, pa.int64()), pa.array(runs, run_type), joined], [key, "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in word_batches(whole):
                yield one(batch)

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")

