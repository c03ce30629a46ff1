"""Connected components of links between numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshweave.plans.durable import removed, stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (u, v: long), stored: root is the smallest number reachable.

    In a round every node points to the smallest of itself and its neighbours; pointers are followed until they stand
    on roots, and the links are moved onto these. A root that is left has a neighbour that is none, so at least half of
    the nodes go in a round. Minima are combined before the exchange, and the tables of a round go when the next one
    has been stored. Repeated links and links of a node to itself are allowed.
    """
    left = stored(links.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct())
    found = left.select(F.col("u").alias("node"), F.col("v").alias("root")).limit(0)
    first = True
    while not left.isEmpty():
        each = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        points = stored(each.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("root")))
        still = False
        while not still:
            ahead = points.select(F.col("node").alias("root"), F.col("root").alias("next"))
            further = stored(points.join(ahead, "root").select("node", F.col("next").alias("root"), (F.col("next") < F.col("root")).alias("moved")))
            removed(points)
            still = further.where("moved").isEmpty()
            points = further.drop("moved")
        if first:
            merged = stored(points)
        else:
            onto = points.select(F.col("node").alias("root"), F.col("root").alias("next"))
            merged = stored(found.join(onto, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
            removed(found)
        at = [points.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "uv"]
        moved = stored(left.join(at[0], "u").join(at[1], "v").where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct())
        removed(left)
        removed(points)
        found, left, first = merged, moved, False
    return found
