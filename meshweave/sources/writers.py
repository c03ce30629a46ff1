"""Sinks: Parquet tables, text, and EnSight Gold in ASCII.

The lines of an EnSight file are made and sorted by Spark; vertices get their places by the numbering of the engine, and
connectivity by a join on them. What the driver knows of a mesh are the counts of its blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshweave.operators.mesh import numbered
from meshweave.plans.durable import merged_text, put_text, removed

#: Element names of the format.
ENSIGHT = {"node": "point", "edge2": "bar2", "tria3": "tria3", "quad4": "quad4", "poly2d": "nsided", "tetra4": "tetra4", "pyram5": "pyramid5", "prism6": "penta6", "hexa8": "hexa8"}
#: What stands for a number that is not known, and the status of computed, uncomputed and not exchanged values.
UNSET, COMPUTED, UNCOMPUTED, UNEXCHANGED = 123456789.0, 0.0, 1.0, -1.0


def fixed_lines(spark: SparkSession, section: int, *text: str) -> DataFrame:
    """Lines that do not depend on rows."""
    made = F.array(*(F.struct(F.lit(section).alias("section"), F.lit(k).cast("long").alias("at"), F.lit(x).alias("value")) for k, x in enumerate(text)))
    return spark.range(1).select(F.inline(made))


def row_lines(rows: DataFrame, section: int | Column, value: Column) -> DataFrame:
    """A line for each row, in the order of gnum."""
    return rows.select((F.lit(section) if isinstance(section, int) else section).alias("section"), F.col("gnum").alias("at"), value.alias("value"))


def number(value: Column | str) -> Column:
    return F.format_string("%12.5e", value)


class EnsightWriter:
    """A case with a fixed or a changing geometry. Files are numbered by the steps that were written, from 0; a step
    written again takes the place of its files. `discard` leaves element types out. Polyhedra are not written.
    """

    def __init__(self, folder: str, name: str, frequency: int = 1, discard: tuple[str, ...] = ("poly3d",), spark: SparkSession | None = None):
        self.folder, self.name, self.frequency, self.discard = str(folder), name, frequency, discard
        self.spark = spark or SparkSession.getActiveSession()
        self.steps: dict[int, float] = {}
        self.at, self.moving = 0, False
        self.fields: dict[str, tuple[str, int]] = {}

    @property
    def times(self) -> list[float]:
        return [self.steps[k] for k in sorted(self.steps)]

    def saved(self) -> dict:
        """What a writer of the same folder needs to go on."""
        return {"steps": sorted(self.steps.items()), "moving": self.moving, "fields": {k: list(v) for k, v in self.fields.items()}}

    def restored(self, state: dict) -> None:
        self.steps, self.moving = {int(k): t for k, t in state["steps"]}, state["moving"]
        self.at, self.fields = max(0, len(self.steps) - 1), {k: (w, n) for k, (w, n) in state["fields"].items()}

    def due(self, step: int) -> bool:
        return step % self.frequency == 0

    def begin_step(self, time: float, step: int | None = None) -> bool:
        """Files from here on belong to `step`, by default the one after the last. Whether it is the first of all."""
        step = max(self.steps, default=-1) + 1 if step is None else step
        first = not self.steps
        self.steps[step] = float(time)
        self.at = sorted(self.steps).index(step)
        return first

    def blocks(self, elements: DataFrame | None) -> list[tuple[str, str, int]]:
        """(type, label, count) of the blocks that are written, in the order of the format."""
        if elements is None:
            return []
        counts = {r["elt_type"]: r["n"] for r in elements.groupBy("elt_type").agg(F.count("*").alias("n")).collect()}
        return [(kind, label, counts[kind]) for kind, label in ENSIGHT.items() if kind in counts and kind not in self.discard]

    def write_mesh(self, vertices: DataFrame, elements: DataFrame | None, moving: bool = False) -> None:
        """The geometry, of this step alone if it is `moving`."""
        spark, self.moving = vertices.sparkSession, moving
        places = numbered(vertices.select("gnum", *"xyz"), ["gnum"], "place")
        parts = [
            fixed_lines(spark, 0, self.name, "ASCII", "node id given", "element id given", "part", f"{1:10d}", self.name, "coordinates", f"{vertices.count():10d}"),
            row_lines(places, 1, F.format_string("%10d", "gnum")),
            places.select("gnum", F.posexplode(F.array(*"xyz"))).select((F.col("pos") + 2).alias("section"), F.col("gnum").alias("at"), number("col").alias("value")),
        ]
        for k, (kind, label, n) in enumerate(self.blocks(elements)):
            own, section = elements.where(F.col("elt_type") == kind).select("gnum", "connec"), 10 + 4 * k
            corners = own.select("gnum", F.posexplode("connec").alias("corner", "vertex")).join(places.select(F.col("gnum").alias("vertex"), "place"), "vertex")
            listed = corners.groupBy("gnum").agg(F.sort_array(F.collect_list(F.struct("corner", "place"))).alias("c"))
            parts += [fixed_lines(spark, section, label, f"{n:10d}"), row_lines(own, section + 1, F.format_string("%10d", "gnum"))]
            if kind == "poly2d":
                parts.append(row_lines(own, section + 2, F.format_string("%10d", F.size("connec"))))
            parts.append(row_lines(listed, section + 3, F.array_join(F.transform("c", lambda x: F.format_string("%10d", x.place)), "")))
        file = f"{self.name}.geo.{self.at:05d}" if moving else f"{self.name}.geo"
        merged_text(reduce(DataFrame.unionByName, parts), f"{self.folder}/{file}", "section", "at")
        removed(places)

    def write_field(self, name: str, field: DataFrame, where: str = "node", elements: DataFrame | None = None) -> None:
        """field: gnum, value (array of equal sizes); what is not known is written as UNSET. With `where` element, in the
        order of the blocks."""
        spark = field.sparkSession
        size = field.agg(F.max(F.size("value"))).first()[0] or 1
        size = max(size, 1)
        self.fields[name] = (where, size)
        value = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda c: F.coalesce(F.get("value", c), F.lit(UNSET)))
        lines = lambda rows, section: rows.select("gnum", F.posexplode(value)).select((F.lit(section + 1) + F.col("pos")).alias("section"), F.col("gnum").alias("at"), number("col").alias("value"))
        parts = [fixed_lines(spark, 0, name, "part", f"{1:10d}")]
        if where == "node":
            parts += [fixed_lines(spark, 1, "coordinates"), lines(field, 1)]
        else:
            for k, (kind, label, _) in enumerate(self.blocks(elements)):
                section = 1 + k * (size + 1)
                own = field.join(elements.where(F.col("elt_type") == kind).select("gnum"), "gnum", "left_semi")
                parts += [fixed_lines(spark, section, label), lines(own, section)]
        merged_text(reduce(DataFrame.unionByName, parts), f"{self.folder}/{self.name}.{name}.{self.at:05d}", "section", "at")

    def write_status(self, name: str, targets: DataFrame, mapping: DataFrame | None, where: str = "node", elements: DataFrame | None = None) -> None:
        """0 for targets that a source reaches, 1 for others, -1 for all where there was no exchange (no mapping)."""
        if mapping is None:
            status = targets.select("gnum", F.array(F.lit(UNEXCHANGED)).alias("value"))
        else:
            hit = mapping.select(F.col("tgt_gnum").alias("gnum"), F.lit(COMPUTED).alias("s")).distinct()
            status = targets.join(hit, "gnum", "left").select("gnum", F.array(F.coalesce("s", F.lit(UNCOMPUTED))).alias("value"))
        self.write_field(f"{name}_status", status, where, elements)

    def close(self) -> str:
        """Write the case file, which names all others; a case can be closed after every step."""
        kinds = {1: "scalar", 3: "vector", 6: "tensor symm"}
        model = f"1 {self.name}.geo.*****" if self.moving else f"{self.name}.geo"
        lines = ["FORMAT", "type: ensight gold", "", "GEOMETRY", f"model: {model}", "", "VARIABLE"]
        lines += [f"{kinds.get(n, 'scalar')} per {w}: 1 {name} {self.name}.{name}.*****" for name, (w, n) in self.fields.items()]
        times = self.times or [0.0]
        lines += ["", "TIME", "time set: 1", f"number of steps: {len(times)}", "filename start number: 0", "filename increment: 1", "time values:", *(f"{t:12.5e}" for t in times)]
        path = f"{self.folder}/{self.name}.case"
        put_text(self.spark, path, "\n".join(lines) + "\n")
        return path


def write_text(df: DataFrame, path: str, *keys: str) -> None:
    """A readable dump: a line of JSON for each row, in order."""
    df.orderBy(*keys).select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


#: Sinks by name. MED and CGNS need libraries of their own and are not offered.
FORMATS: dict[str, Callable] = {"parquet": write_parquet, "text": write_text, "ensight": EnsightWriter}
