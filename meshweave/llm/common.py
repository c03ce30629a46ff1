"""Helpers shared by the training-data operators: table access, durable intermediates, components."""

from __future__ import annotations

import ctypes
import json
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one on a local
    master (tests); on a cluster, whose executors would each write to a disk of their own, an error."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="meshweave-checkpoint-"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


def own_folder(spark: SparkSession, path: str) -> str:
    """`path`, which exists, marked to go when the application ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def stored(df: DataFrame) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back: a cut of the lineage that outlives executors.

    The files go with removed(), or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/meshweave/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(own_folder(spark, path))


def removed(df: DataFrame) -> None:
    """Delete what stored() wrote for `df`, once no later plan reads it."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (u, v: long): component is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows the pointers to their roots and contracts the
    edges onto the roots, so the number of edges falls geometrically. Minima are pre-aggregated before each shuffle;
    every round's tables are stored. Self-loops and repeated edges are allowed; no edges give no rows.
    """
    edges = stored(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct())
    known: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("root")))
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = stored(hooks.join(up, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
            removed(hooks)
            hooks = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        a, b = (hooks.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "uv")
        inner = stored(edges.join(a, "u").join(b, "v").where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct())
        if known is None:
            merged = stored(hooks)
        else:
            step = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            merged = stored(known.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
            removed(known)
        removed(edges)
        removed(hooks)
        known, edges = merged, inner
    if known is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return known.select("node", F.col("root").alias("component"))


def released(made: pa.Table) -> pa.Table:
    """`made`, after giving memory that a worker no longer uses back to the machine it shares with its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
    return made


def inlined(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of known bound as a literal of the plan: no Python data source."""
    made = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1).select(F.inline(made))


def broadcast_within(df: DataFrame, rows: int) -> DataFrame:
    """`df` stored, with a broadcast hint only if it has at most `rows` rows; beyond that joins shuffle."""
    kept = stored(df)
    return F.broadcast(kept) if kept.limit(rows + 1).count() <= rows else kept


def broadcast_under(df: DataFrame, size: Column | int, limit: int = 64 << 20) -> DataFrame:
    """`df` stored, with a broadcast hint only if its rows come to at most `limit` bytes by `size`, bytes of a row;
    beyond that joins shuffle."""
    kept = stored(df)
    total = kept.agg(F.sum(size if isinstance(size, Column) else F.lit(size))).first()[0] or 0
    return F.broadcast(kept) if total <= limit else kept


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores added until no column of `df` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
