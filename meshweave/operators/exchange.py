"""Exchanges by global number: identity mapping, partitioned data, global data, and who was reached."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_by_place(rows: DataFrame, key: str = "gnum", place: tuple[str, ...] = ("part_id", "lnum")) -> DataFrame:
    """One row for each key: the one of the smallest place."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*place)).alias("first")).select(key, "first.*")


def identity_mapping(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(tgt_gnum, src_gnum, weight) of the global numbers that both sides have."""
    mine = targets.select(F.col("gnum").alias("tgt_gnum")).distinct()
    return mine.join(sources.select(F.col("gnum").alias("tgt_gnum")).distinct(), "tgt_gnum").select("tgt_gnum", F.col("tgt_gnum").alias("src_gnum"), F.lit(1.0).alias("weight"))


def delivered(targets: DataFrame, sources: DataFrame, value: str = "value") -> DataFrame:
    """Every target with the value of its global number, NULL where no source has it."""
    return targets.join(sources.select("gnum", value), "gnum", "left")


def part_data(receivers: DataFrame, senders: DataFrame, place: tuple[str, ...] = ("part_id", "lnum")) -> DataFrame:
    """`receivers` with the senders' columns by gnum; of several senders of one gnum the first by place wins."""
    data = [c for c in senders.columns if c not in ("gnum", *place)]
    return receivers.join(first_by_place(senders, place=place).select("gnum", *data), "gnum", "left")


def part_to_block(rows: DataFrame, n_blocks: int, place: tuple[str, ...] = ("part_id", "lnum"), names: tuple[str, str] = ("block_id", "place")) -> DataFrame:
    """Partitioned data by blocks of consecutive global numbers: one row for each gnum, the first by place, with the block
    (from 0) and the place in it (from 0) under `names`, which `rows` must not have; the blocks are equal but for the
    last. No rows give no rows."""
    taken = sorted({c.lower() for c in rows.columns} & {n.lower() for n in names})
    if taken:
        raise ValueError(f"the rows have columns {taken} of their own: pass other names")
    last = rows.agg(F.max("gnum")).first()[0] or 1
    size = -(-last // n_blocks)
    first = first_by_place(rows, place=place)
    return first.withColumns({names[0]: F.expr(f"int((gnum - 1) div {size})"), names[1]: (F.col("gnum") - 1) % size})


def block_to_part(parts: DataFrame, blocks: DataFrame, names: tuple[str, str] = ("block_id", "place")) -> DataFrame:
    """Every row of `parts` (gnum and its place) with the data that the blocks hold for its number, NULL where they hold none."""
    data = [c for c in blocks.columns if c not in ("gnum", *names) and c not in parts.columns]
    return parts.join(blocks.select("gnum", *data), "gnum", "left")


def n_parts(frame: DataFrame) -> int:
    return frame.agg(F.countDistinct("part_id")).first()[0]


def global_data(frame: DataFrame, data: DataFrame, rows: int = 10_000) -> DataFrame:
    """`frame` beside an unpartitioned array, which is one row and so is broadcast."""
    if data.limit(rows + 1).count() > rows:
        raise ValueError(f"global data has more than {rows} rows")
    packed = data.agg(F.sort_array(F.collect_list(F.struct(*data.columns))).alias("global"))
    return frame.join(F.broadcast(packed))


def computed(targets: DataFrame, mapping: DataFrame) -> DataFrame:
    """Targets with at least one source."""
    return targets.join(mapping.select(F.col("tgt_gnum").alias("gnum")), "gnum", "left_semi")


def uncomputed(targets: DataFrame, mapping: DataFrame) -> DataFrame:
    """Targets that no source reaches."""
    return targets.join(mapping.select(F.col("tgt_gnum").alias("gnum")), "gnum", "left_anti")


def involved(sources: DataFrame, mapping: DataFrame) -> DataFrame:
    """Sources that are used at least once."""
    return sources.join(mapping.select(F.col("src_gnum").alias("gnum")), "gnum", "left_semi")


def sources_of(mapping: DataFrame) -> DataFrame:
    """For each target its sources in order: the rows of a compressed index."""
    return mapping.groupBy("tgt_gnum").agg(F.sort_array(F.collect_list("src_gnum")).alias("sources"))


def targets_of(mapping: DataFrame) -> DataFrame:
    return mapping.groupBy("src_gnum").agg(F.sort_array(F.collect_list("tgt_gnum")).alias("targets"))


def field_of_elements(mapping: DataFrame, field: DataFrame) -> DataFrame:
    """(gnum, values): for each located target the vertex values of the element that holds it, in the element's order."""
    corners = mapping.select(F.col("tgt_gnum").alias("gnum"), F.posexplode("nodes").alias("i", "node"))
    known = corners.join(field.select(F.col("gnum").alias("node"), "value"), "node", "left")
    return known.groupBy("gnum").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "value"))), lambda s: s.value).alias("values"))


def distribution(mapping: DataFrame, parts: DataFrame, side: str = "tgt") -> DataFrame:
    """(part_id, n): how many of the mapped points each partition holds."""
    return mapping.select(F.col(f"{side}_gnum").alias("gnum")).distinct().join(parts.select("gnum", "part_id"), "gnum").groupBy("part_id").agg(F.count("*").alias("n"))


def status(received: DataFrame, order: str = "gnum", value: str = "value") -> str:
    """'ok', or 'bad_receiving' if the first received value is not a number."""
    row = received.orderBy(order).select(F.coalesce(F.isnan(F.element_at(value, 1)), F.lit(False))).first()
    return "bad_receiving" if row is not None and row[0] else "ok"
