"""Filter interaction audit: what five filters remove in every order, from one CUBE over their failure flags."""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshweave.llm.common import stored

#: The filters, by letter; a flag of the same name, in lower case, is true where a document fails.
FILTERS = "ABCDE"
COUNTS = ("n", "good", "toxic")


def text_flags(text: Column, words: int = 200, variety: int = 50, capitals: int = 2) -> dict[str, Column]:
    """Failure conditions A to D of a text that is not null."""
    parts = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    return {
        "a": F.size(parts) < words,
        "b": F.size(F.array_distinct(parts)) * 100 < F.size(parts) * variety,
        "c": F.length(F.regexp_replace(text, "[^A-Z]+", "")) * 100 > F.length(text) * capitals,
        "d": text.rlike(r"[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """(part, a, b, c, d, e, n, good, toxic): how many documents of a part share the failure flags, and how many of them
    the labels call good (quality 1) and toxic.

    Flags A to D are made from the whole text once. For E, equal texts (by SHA-256 and length; a null text is empty)
    are counted by text, part and key, so that a text which a third of all rows have is added up before anything is
    compared; the smallest key of a text is then the minimum over its parts. Rows that repeat the smallest key do not
    fail E. A row without a key has none smaller and is none, and has no label. Of several labels of a key the largest
    counts.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(part), F.lit("")).alias("part"), body.alias("body"))
    rows = rows.select("key", "part", F.sha2("body", 256).alias("same"), F.octet_length("body").alias("size"), *(x.alias(k) for k, x in text_flags(F.col("body")).items()))
    marks = labels.groupBy(F.col(key).alias("key")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("poison"))
    rows = rows.join(marks, "key", "left")
    counts = [F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("poison") == 1).alias("toxic")]
    flags = [F.first(x).alias(x) for x in "abcd"]
    by_key = rows.groupBy("same", "size", "part", "key").agg(*flags, *counts)
    whole = F.struct("key", *COUNTS)
    keyed = F.col("key").isNotNull()
    by_text = by_key.groupBy("same", "size", "part").agg(
        *flags, *(F.sum(x).alias(x) for x in COUNTS), F.min(F.when(keyed, whole)).alias("first"), *(F.sum(F.when(~keyed, F.col(x)).otherwise(0)).alias(f"{x}_keyless") for x in COUNTS)
    )
    smallest = F.min("first.key").over(Window.partitionBy("same", "size"))
    by_text = by_text.withColumn("kept", F.coalesce(F.col("first.key") == smallest, F.lit(False)))
    passing = {x: F.col(f"{x}_keyless") + F.when(F.col("kept"), F.col(f"first.{x}")).otherwise(0) for x in COUNTS}
    both = F.array(
        F.struct(F.lit(False).alias("e"), *(passing[x].alias(x) for x in COUNTS)),
        F.struct(F.lit(True).alias("e"), *((F.col(x) - passing[x]).alias(x) for x in COUNTS)),
    )
    made = by_text.select("part", *"abcd", F.inline(both)).where("n > 0")
    return made.groupBy("part", *"abcde").agg(*(F.sum(x).alias(x) for x in COUNTS))


def survivors(flags: DataFrame) -> DataFrame:
    """(part, subset, n, good, toxic) of flagged(): the documents that pass every filter of a subset (bit i: filter i).

    The CUBE groups by every subset of flags; in a grouping set, the row whose flags are all false is what its filters
    leave. Where none survive there is no row. The input has at most 32 rows a part, whatever the number of documents.
    """
    cube = flags.cube("part", *"abcde").agg(*(F.sum(x).alias(x) for x in COUNTS), *(F.grouping(x).alias(f"g_{x}") for x in ("part", *"abcde")))
    subset = sum((F.lit(1 << i) * (1 - F.col(f"g_{x}")) for i, x in enumerate("abcde")), F.lit(0))
    clean = [(F.col(f"g_{x}") == 1) | ~F.col(x) for x in "abcde"]
    kept = cube.where(F.col("g_part") == 0)
    for x in clean:
        kept = kept.where(x)
    return kept.select("part", subset.cast("int").alias("subset"), *COUNTS)


def steps() -> Column:
    """Each step of each of the 120 orders: its filter and the subsets of filters before and after it."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            after = before | 1 << FILTERS.index(letter)
            rows.append({"filter_order": "".join(order), "step": step, "letter": letter, "before": before, "after": after})
            before = after
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order string, step int, letter string, before int, after int>>")


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): one row for
    every part, order and step, zeros included.

    Every step joins the survivors() of the subsets before and after it; what it removes is their difference. A filter's
    failures are what it removes as the first step, those that fail it alone what it removes as the last one, and
    shapley is what it removes in a part summed over all orders. Documents are read once, and from there on a part has
    600 rows whatever its size. An empty table has no parts and gives no rows.
    """
    kept = stored(survivors(flagged(docs, labels, text, key, part)))
    of = lambda at: kept.select("part", F.col("subset").alias(at), *(F.col(x).alias(f"{at}_{x}") for x in COUNTS))
    # every part passes the empty subset, so it is here even if no document survives any filter
    grid = kept.where("subset = 0").select("part", F.inline(steps()))
    both = grid.join(of("before"), ["part", "before"], "left").join(of("after"), ["part", "after"], "left").na.fill(0)
    lost = both.select("part", "filter_order", "step", "letter", F.col("after_n").alias("kept"), *((F.col(f"before_{x}") - F.col(f"after_{x}")).alias(x) for x in COUNTS))
    own = Window.partitionBy("part", "letter")
    at = lambda step: F.max(F.when(F.col("step") == step, F.col("n"))).over(own)
    return lost.select(
        "part", "filter_order", "step", "kept", F.col("n").alias("removed"), (at(1) - F.col("n")).alias("redundant"), at(len(FILTERS)).alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), F.sum("n").over(own).alias("shapley"),
    )
