"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshweave.llm.common import broadcast_under, stored

#: Fixed masks: the words at 1 must be equal, those at 0 may differ. Whatever substitutions the share below allows in
#: an item of eight words or more (or in a window of it), one of the first three finds a place between them; in an item
#: of five to seven words one of the two short ones does. tests/llm/test_contamination.py goes through all of them.
MASKS, SHORT_MASKS = ("111101", "1100111", "11010011"), ("1101", "1011")
LONG, SHORT = 8, 5
#: A hit is verified over the best window of so many words, of which this share must be equal.
WINDOW, SHARE = 13, 0.8
#: So many places of benchmark items are held in one row of a seed; a seed of more places has several rows.
LISTED = 64


def masks_of(n: int) -> tuple[str, ...]:
    """The masks for items of n words; below five words the share allows no substitution."""
    return MASKS if n >= LONG else SHORT_MASKS if n >= SHORT else ("1" * n,)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def hashed(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def masked(h: Column, i: Column, mask: str) -> Column:
    return F.xxhash64(F.lit(mask), *(F.get(h, i + k) for k, c in enumerate(mask) if c == "1"))


def seeds(h: Column, masks: tuple[str, ...], own: bool = False) -> Column:
    """Array of (seed, place) of every place of the word hashes `h` and every mask that fits there; with `own`, of the
    masks for items of that many words alone."""

    def at(mask: str):
        return lambda i: F.struct(masked(h, i, mask).alias("seed"), i.alias("place"))

    def wanted(mask: str) -> Column:
        fits = F.size(h) >= len(mask)
        if not own:
            return fits
        return fits & F.when(F.size(h) >= LONG, mask in MASKS).when(F.size(h) >= SHORT, mask in SHORT_MASKS).otherwise(F.size(h) == (len(mask) if mask == "1" * len(mask) else 0))

    made = [F.when(wanted(m), F.transform(F.sequence(F.lit(0), F.size(h) - len(m)), at(m))) for m in masks]
    none = F.array().cast("array<struct<seed:bigint,place:int>>")
    return F.concat(none, *(F.coalesce(x, none) for x in made))


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, place, n_words, n_equal, overlap): the best overlap of each document with each benchmark item it holds.

    Words are runs of letters and digits, lower-cased. The masks for the lengths that items have are hashed at every
    place of both sides and joined. Around each hit the two texts are laid side by side and the equal words counted in
    every window of 13 words (of the item's length, if that is less); the pair counts if some window has 80 % equal
    words. No set of substitutions within that share is missed, whatever the item's length. place is where the item
    would begin in the document (from 0, below 0 if its start is cut off), n_words the item's words that lie inside
    the document, n_equal those that are equal, overlap their share of the item. Items of equal words are compared as
    one. Null and empty texts and items match nothing, rows with a null key neither; rows with equal keys count as one
    document each time they occur, and give one row a pair.
    """
    named = stored(benchmark.select(F.col(item).alias("item"), hashed(F.col(item_text)).alias("hi")).where(F.size("hi") > 0).withColumn("same", F.sha2(F.array_join(F.transform("hi", lambda x: x.cast("string")), ","), 256)))
    items = stored(named.groupBy("same").agg(F.first("hi").alias("hi")))
    lengths = sorted(r[0] for r in items.select(F.least(F.size("hi"), F.lit(LONG))).distinct().collect())  # at most eight
    masks = tuple(dict.fromkeys(m for n in lengths for m in masks_of(n))) or MASKS
    own = items.select("same", F.inline(seeds(F.col("hi"), masks, own=True)))
    part = F.pmod(F.xxhash64("same", "place"), F.ceil(F.col("n") / LISTED))
    often = own.groupBy("seed").agg(F.count("*").alias("n"))
    known = own.join(often, "seed").groupBy("seed", part.alias("part")).agg(F.collect_set(F.struct("same", F.col("place").alias("at"))).alias("where")).drop("part")
    found = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), hashed(F.col(text)).alias("hd")).select("key", F.inline(seeds(F.col("hd"), masks)))
    hits = found.join(broadcast_under(known, 32 + 96 * F.size("where")), "seed").select("key", "place", F.inline("where"))
    lined = stored(hits.select("key", "same", (F.col("place") - F.col("at")).alias("begin")).distinct())
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(broadcast_under(lined.select("key").distinct(), 64), "key", "left_semi")
    bodies = texts.select("key", hashed(F.col("text")).alias("hd"))
    both = bodies.join(lined, "key").join(broadcast_under(items, 96 + 8 * F.size("hi")), "same")
    least, most = F.greatest(F.lit(0), -F.col("begin")), F.least(F.size("hi"), F.size("hd") - F.col("begin"))
    equal = F.transform(F.sequence(least, most - 1), lambda i: (F.get("hi", i) == F.get("hd", i + F.col("begin"))).cast("int"))
    width = F.least(F.lit(WINDOW), F.size("hi"))
    compared = both.where(most - least >= width).select("key", "same", "begin", equal.alias("equal"), width.alias("width"), F.size("hi").alias("n"))
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, e: s + e)
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("equal") - F.col("width") + 1), lambda i: total(F.slice("equal", i, F.col("width")))))
    good = compared.where(best >= F.ceil(F.col("width") * SHARE))
    rows = good.select("key", "same", F.struct(total(F.col("equal")).alias("n_equal"), (-F.col("begin")).alias("early"), F.size("equal").alias("n_words"), "n").alias("x"))
    top = rows.groupBy("key", "same").agg(F.max("x").alias("x")).join(named.select("item", "same").distinct(), "same")
    return top.select(F.col("key").alias(key), F.col("item").alias(item), (-F.col("x.early")).alias("place"), "x.n_words", "x.n_equal", (F.col("x.n_equal") / F.col("x.n")).alias("overlap"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of `docs` that hold no benchmark item, with the columns of `docs`; rows with a null key stay."""
    gone = contaminated(docs, benchmark, text, key).select(key).distinct()
    return docs.join(broadcast_under(gone, 64), key, "left_anti").select(docs.columns)
