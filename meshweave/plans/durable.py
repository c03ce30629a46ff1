"""Intermediate tables that outlive executors, and small files in any store that Spark reaches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one on a local master; on a cluster, whose
    executors would each write to a disk of their own, an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="meshweave-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """`df` written as Parquet in the shared folder and read back; the files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/meshweave-tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Delete what stored() wrote for `df`, once no later plan reads it."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def dealt(df: DataFrame) -> DataFrame:
    """`df` as a side of a join that deals both sides by their keys. Spark takes exploded rows, and columns cut out of
    well compressed files, for far fewer bytes than they are, and would send such a side whole through the driver."""
    return df.hint("merge")


def on_store(spark: SparkSession, path: str):
    """The file system of `path`, which leaves no checksum files of its own beside ours, and the path as it knows it."""
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = made.getFileSystem(spark._jsc.hadoopConfiguration())
    store.setWriteChecksum(False)
    return store, made


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file in one move: readers see the old one or the new one."""
    store, final = on_store(spark, path)
    _, draft = on_store(spark, f"{path}.draft")
    out = store.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    store.delete(final, False)
    store.rename(draft, final)


def get_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, None where there is none."""
    store, there = on_store(spark, path)
    if not store.exists(there):
        return None
    source = store.open(there)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def names_in(spark: SparkSession, folder: str) -> list[str]:
    store, there = on_store(spark, folder)
    return sorted(x.getPath().getName() for x in store.listStatus(there)) if store.exists(there) else []


def merged_text(lines: DataFrame, path: str, *order: str) -> None:
    """The column `value` of `lines` as one text file, in `order`.

    Spark sorts by ranges and formats in its tasks; the sorted parts, already text, are then appended to the file one
    after the other by the file system's own copy, as its format wants a single file.
    """
    spark = lines.sparkSession
    folder = f"{shared_folder(spark)}/meshweave-tables/{uuid.uuid4().hex}"
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.text(folder)
    store, parts = on_store(spark, folder)
    target, final = on_store(spark, path)
    out = target.create(final, True)
    try:
        for name in names_in(spark, folder):
            if name.startswith("part-"):
                source = store.open(on_store(spark, f"{folder}/{name}")[1])
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
                source.close()
    finally:
        out.close()
    store.delete(parts, True)
