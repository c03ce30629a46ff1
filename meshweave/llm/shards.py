"""Sharding by fixed virtual slots."""

from __future__ import annotations

import heapq
import uuid
from bisect import bisect_left, insort
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshweave.llm.common import inlined, own_folder, shared_dir, stored

SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """Which shard each virtual slot belongs to; every edit gives the next version."""

    shards: int
    owner: dict[int, int] = field(default_factory=dict)
    version: int = 0

    @staticmethod
    def balanced(sizes: dict[int, int], shards: int, slots: int = SLOTS) -> SlotMap:
        """Version 1: slots by falling size, each to the lightest shard."""
        heap = [(0, s) for s in range(shards)]
        owner = {}
        for slot in sorted(range(slots), key=lambda v: (-sizes.get(v, 0), v)):
            load, shard = heapq.heappop(heap)
            owner[slot] = shard
            heapq.heappush(heap, (load + sizes.get(slot, 0), shard))
        return SlotMap(shards, owner, 1)

    @staticmethod
    def even(shards: int, slots: int = SLOTS) -> SlotMap:
        """Version 1 where no sizes are known yet: slots dealt in turn."""
        return SlotMap(shards, {v: v % shards for v in range(slots)}, 1)

    def rebalanced(self, sizes: dict[int, int], shards: int | None = None) -> SlotMap:
        """The next version: slots of the heaviest shard move to the lightest, or change places with one of its slots,
        while that evens the two out. The map itself if nothing has to move.

        With more shards the new ones start empty; only slots that must move change owner.
        """
        shards, owner, held = shards or self.shards, dict(self.owner), defaultdict(list)
        load = dict.fromkeys(range(shards), 0)
        for slot, shard in owner.items():
            if shard >= shards:
                raise ValueError("shards are not taken away by rebalancing")
            insort(held[shard], (sizes.get(slot, 0), slot))
            load[shard] += sizes.get(slot, 0)

        def move(slot: int, a: int, b: int) -> None:
            size = sizes.get(slot, 0)
            held[a].remove((size, slot))
            insort(held[b], (size, slot))
            load[a] -= size
            load[b] += size
            owner[slot] = b

        while True:
            high, low = max(load, key=lambda s: (load[s], -s)), min(load, key=lambda s: (load[s], s))
            gap = load[high] - load[low]
            # what would move: a slot alone, or the difference to a slot that comes back; half the gap is best
            best = None
            for size, slot in held[high]:
                wanted = size - gap / 2
                at = bisect_left(held[low], (wanted, -1))
                for back, other in [(0, None), *held[low][max(0, at - 1) : at + 1]]:
                    if 0 < size - back < gap and (best is None or abs(2 * (size - back) - gap) < best[0]):
                        best = abs(2 * (size - back) - gap), slot, other
            if best is None:
                changed = owner != self.owner or shards != self.shards
                return SlotMap(shards, owner, self.version + 1) if changed else self
            move(best[1], high, low)
            if best[2] is not None:
                move(best[2], low, high)

    def frame(self, spark: SparkSession) -> DataFrame:
        return inlined(spark, [{"version": self.version, "vslot": v, "shard": s} for v, s in sorted(self.owner.items())], "version int, vslot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Put this version into the table at `path`. A version is written once: a second writer of the same number gets
        an error and is to load and edit the newer map."""
        self.frame(spark).drop("version").withColumn("shards", F.lit(self.shards)).coalesce(1).write.mode("error").parquet(f"{path}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The last version at `path`, or the one asked for."""
        saved = spark.read.parquet(path)
        version = version or saved.agg(F.max("version")).first()[0]
        rows = saved.where(F.col("version") == version).collect()  # one row per virtual slot
        if sorted(r["vslot"] for r in rows) != list(range(len(rows))):
            raise ValueError(f"version {version} at {path} does not name every slot once")
        return SlotMap(rows[0]["shards"], {r["vslot"]: r["shard"] for r in rows}, version)

    @staticmethod
    def exists(spark: SparkSession, path: str) -> bool:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def slotted(docs: DataFrame, shards: int, text: str = "text", key: str = "doc_id", slots: int = SLOTS, split_over: float | None = 0.25) -> DataFrame:
    """(key, size, text_crc32, vslot), stored: every row's size in bytes and its virtual slot.

    The slot is a hash of the text, so equal texts share one. A text whose copies weigh over `split_over` of a mean
    shard is split by a hash of the key into pieces of that weight: at most shards / split_over texts can be so heavy,
    which bounds what is broadcast. With None, equal texts always stay together, and a shard can be heavier than the
    mean by the weight of the heaviest text. A null text has no bytes and goes with the empty texts; rows of a null
    key are sharded as others.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = stored(docs.select(F.col(key).alias("key"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64(body).alias("same")))
    piece = F.lit(0).cast("long")
    if split_over is not None:
        part = max(1, int((rows.agg(F.sum("size")).first()[0] or 0) * split_over / shards))
        heavy = rows.groupBy("same").agg(F.sum("size").alias("w"), F.count("*").alias("n")).where(f"w > {part} and n > 1").select("same", F.ceil(F.col("w") / part).cast("int").alias("pieces"))
        rows = rows.join(F.broadcast(heavy), "same", "left")
        piece = F.pmod(F.xxhash64(F.lit("piece"), F.coalesce(F.col("key").cast("string"), F.lit(""))), F.coalesce("pieces", F.lit(1)))
    made = rows.withColumn("vslot", F.pmod(F.xxhash64("same", piece), F.lit(slots)).cast("int"))
    return stored(made.select(F.col("key").alias(key), "size", "text_crc32", "vslot"))


def slot_sizes(rows: DataFrame) -> dict[int, int]:
    """Bytes of each virtual slot: at most as many rows as there are slots."""
    return {r["vslot"]: r["w"] for r in rows.groupBy("vslot").agg(F.sum("size").alias("w")).collect()}


def placed(rows: DataFrame, owners: SlotMap, key: str = "doc_id", blocks: int = 64) -> DataFrame:
    """`rows` with shard and slot: the row's place in its shard, gapless from 0.

    Places are counted by virtual slot and block (hash of the key), then summed over a shard's slots, so that no task
    ranks a whole shard. Rows with equal keys keep their own places.
    """
    spark = rows.sparkSession
    dealt = rows.join(F.broadcast(owners.frame(spark).drop("version")), "vslot", "left")
    dealt = dealt.withColumn("shard", F.coalesce("shard", F.raise_error(F.lit("a row's slot has no shard")).cast("int"))).withColumn("block", F.pmod(F.xxhash64(F.lit("block"), key), F.lit(blocks)))
    counts = dealt.groupBy("shard", "vslot", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("vslot", "block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("vslot", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("vslot", "block").orderBy(key, "text_crc32", "size")
    return dealt.withColumn("at", F.row_number().over(own) - 1).join(firsts, ["vslot", "block"]).withColumn("slot", F.col("first") + F.col("at")).drop("at", "first", "block")


def sharded(docs: DataFrame, shards: int = 24, text: str = "text", key: str = "doc_id", slots: int | None = None, path: str | None = None, split_over: float | None = 0.25) -> DataFrame:
    """(vslot, key, size, text_crc32, shard, slot, version) of every row, over shards of nearly equal bytes.

    `path`: the table of the slot maps, one version after the other; by default a new one in the shared folder, which
    goes with the application. Where it holds no map yet, version 1 deals the slots in turn, as one would before any
    sizes are known. The bytes of each slot are then counted, the last version is edited until the shards are even,
    and, if that moved anything, the edited map is stored as the next version; a later call with the same path and
    other sizes or more shards edits that one. `slots`: how many virtual slots a new map has (SLOTS if not given); a
    stored map keeps the number it has, and another one is refused, as rows would change their slots. Rows are placed
    by the map as read back. No rows give no rows.
    """
    spark = docs.sparkSession
    own = path is None
    path = path or f"{shared_dir(spark)}/meshweave/slots-{uuid.uuid4().hex}"
    if not SlotMap.exists(spark, path):
        SlotMap.even(shards, slots or SLOTS).save(spark, path)
    if own:
        own_folder(spark, path)
    last = SlotMap.load(spark, path)
    if slots is not None and slots != len(last.owner):
        raise ValueError(f"the map at {path} has {len(last.owner)} slots, not {slots}")
    rows = slotted(docs, shards, text, key, len(last.owner), split_over)
    edited = last.rebalanced(slot_sizes(rows), shards)
    if edited.version > last.version:
        edited.save(spark, path)
    owners = SlotMap.load(spark, path)
    return placed(rows, owners, key).withColumn("version", F.lit(owners.version))
