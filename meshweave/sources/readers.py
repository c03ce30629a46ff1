"""Readers of mesh files of any size and in any store, through Spark's text source.

A file becomes a table of its words, numbered in order across its splits. What the driver sees are the words that are no
numbers, of which a file has as many as sections, and their counts; entries are cut out of the table by their places.
A word that is no number where one belongs becomes NULL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshweave.operators.mesh import numbered

VERTICES, ELEMENTS = "gnum long, x double, y double, z double", "gnum long, elt_type string, order int, connec array<long>"
#: Sections of .mesh files, their element type, order and number of nodes.
SECTIONS = {
    "Edges": ("edge2", 1, 2), "EdgesP2": ("ho_edge", 2, 3), "EdgesP3": ("ho_edge", 3, 4), "EdgesP4": ("ho_edge", 4, 5),
    "Triangles": ("tria3", 1, 3), "TrianglesP2": ("ho_tria", 2, 6), "TrianglesP3": ("ho_tria", 3, 10), "TrianglesP4": ("ho_tria", 4, 15),
    "Quadrilaterals": ("quad4", 1, 4), "QuadrilateralsQ2": ("ho_quad", 2, 9), "QuadrilateralsQ3": ("ho_quad", 3, 16), "QuadrilateralsQ4": ("ho_quad", 4, 25),
    "Tetrahedra": ("tetra4", 1, 4), "TetrahedraP2": ("ho_tetra", 2, 10), "TetrahedraP3": ("ho_tetra", 3, 20), "TetrahedraP4": ("ho_tetra", 4, 35),
    "Hexahedra": ("hexa8", 1, 8), "HexahedraQ2": ("ho_hexa", 2, 27), "Prisms": ("prism6", 1, 6), "Pyramids": ("pyram5", 1, 5),
}
#: Sections without elements, and how many numbers each of their entries has.
MARKS = {"Corners": 1, "RequiredVertices": 1, "Ridges": 1, "RequiredEdges": 1, "RequiredTriangles": 1}
#: Cell type numbers of legacy VTK files.
VTK_TYPES = {1: "node", 3: "edge2", 5: "tria3", 7: "poly2d", 9: "quad4", 10: "tetra4", 12: "hexa8", 13: "prism6", 14: "pyram5"}


#: A file of more words than this that are no numbers is none of these formats.
NAMES = 10_000


@dataclass
class Words:
    """The words of a file: `table` has at (from 1), word, line (two numbers that order lines) and pos in the line."""

    path: str
    table: DataFrame
    names: list[tuple[int, str]]

    @staticmethod
    def of(spark: SparkSession, path: str) -> Words:
        lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
        each = lines.select("block", "row", F.posexplode(F.filter(F.split("value", r"\s+"), lambda w: w != "")).alias("pos", "word"))
        table = numbered(each, ["block", "row", "pos"], "at")
        found = table.where(~F.col("word").rlike(r"^[-+]?\.?[0-9]")).select("at", "word").limit(NAMES + 1).collect()
        if len(found) > NAMES:
            raise ValueError(f"{path}: not a mesh file of numbers")
        return Words(path, table, sorted((r["at"], r["word"]) for r in found))

    def whole(self, *places: int) -> list[int]:
        """A few whole numbers by their places."""
        got = {r["at"]: int(r["word"]) for r in self.table.where(F.col("at").isin(list(places))).collect()} if places else {}
        if len(got) < len(set(places)):
            raise ValueError(f"{self.path}: ends before it should")
        return [got[x] for x in places]

    def span(self, start: int, count: int, stride: int = 1) -> DataFrame:
        """(entry, pos, word) of `count` entries of `stride` words each, from the place `start`; entries from 0."""
        own = self.table.where((F.col("at") >= start) & (F.col("at") < start + count * stride))
        return own.select(F.floor((F.col("at") - start) / stride).alias("entry"), ((F.col("at") - start) % stride).cast("int").alias("pos"), "word")

    def entries(self, start: int, count: int, stride: int) -> DataFrame:
        """(entry, words): whole entries."""
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x.word)
        return self.span(start, count, stride).groupBy("entry").agg(ordered.alias("words"))


def points_of(rows: DataFrame, dim: int) -> DataFrame:
    at = [F.get("words", F.lit(k)).try_cast("double") if k < dim else F.lit(0.0) for k in range(3)]
    return rows.select((F.col("entry") + 1).alias("gnum"), *(c.alias(a) for c, a in zip(at, "xyz", strict=True)))


def none_of(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """An ASCII .mesh file of version 1 or 2, also with high-order sections, whose nodes keep the file's order. Elements are
    numbered from 1 over all sections. Sections that are not known raise ValueError."""
    words = Words.of(spark, path)
    names = []
    for at, word in words.names:
        if word == "End":
            break
        if word not in SECTIONS and word not in MARKS and word not in ("Dimension", "Vertices", "MeshVersionFormatted"):
            raise ValueError(f"{path}: section {word!r} is not known")
        names.append((at, word))
    counts = dict(zip(names, words.whole(*(at + 1 for at, _ in names)), strict=True))
    dim = next((n for (_, word), n in counts.items() if word == "Dimension"), 3)
    vertices, elements, before = none_of(spark, VERTICES), none_of(spark, ELEMENTS), 0
    for (at, word), n in counts.items():
        if word == "Vertices":
            vertices = points_of(words.entries(at + 2, n, dim + 1), dim)
        elif word in SECTIONS:
            kind, order, size = SECTIONS[word]
            made = words.entries(at + 2, n, size + 1).select((F.col("entry") + before + 1).alias("gnum"), F.lit(kind).alias("elt_type"), F.lit(order).alias("order"), F.transform(F.slice("words", 1, size), lambda w: w.try_cast("long")).alias("connec"))
            elements, before = elements.unionByName(made), before + n
    return vertices, elements


def read_vtk(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A legacy ASCII VTK file: vertices, elements and its point scalars (gnum, name, value). Cells have a line each."""
    words = Words.of(spark, path)
    vertices, cells, kinds, scalars, n_points = none_of(spark, VERTICES), None, None, none_of(spark, "gnum long, name string, value double"), 0
    names = [(at, w.upper(), w) for at, w in words.names]
    for k, (at, word, _) in enumerate(names):
        if word == "POINTS":
            (n_points,) = words.whole(at + 1)
            vertices = points_of(words.entries(at + 3, n_points, 3), 3)
        elif word in ("CELLS", "POLYGONS"):
            n, size = words.whole(at + 1, at + 2)
            own = words.table.where((F.col("at") > at + 2) & (F.col("at") <= at + 2 + size))
            lines = own.groupBy("block", "row").agg(F.min("at").alias("at"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x.word.try_cast("long")).alias("w"))
            ill = lines.agg(F.count(F.lit(1)), F.count_if(F.get("w", F.lit(0)) != F.size("w") - 1)).first()
            if ill[0] != n or ill[1]:
                raise ValueError(f"{path}: {n} cells are to have a line each")
            cells = numbered(lines.select("at", F.transform(F.slice("w", 2, F.size("w")), lambda v: v + 1).alias("connec")), ["at"]).drop("at")
        elif word == "CELL_TYPES":
            (n,) = words.whole(at + 1)
            kinds = words.entries(at + 2, n, 1).select((F.col("entry") + 1).alias("gnum"), F.get("words", F.lit(0)).try_cast("int").alias("kind"))
        elif word == "SCALARS":
            table = next(x for x, w, _ in names[k:] if w == "LOOKUP_TABLE")
            name = names[k + 1][2] if names[k + 1][0] == at + 1 else str(words.table.where(F.col("at") == at + 1).first()["word"])
            made = words.entries(table + 2, n_points, 1).select((F.col("entry") + 1).alias("gnum"), F.lit(name).alias("name"), F.get("words", F.lit(0)).try_cast("double").alias("value"))
            scalars = scalars.unionByName(made)
    if cells is None:
        return vertices, none_of(spark, ELEMENTS), scalars
    of_size = F.when(F.size("connec") == 3, "tria3").when(F.size("connec") == 4, "quad4").otherwise("poly2d")
    kind = of_size
    if kinds is not None:
        known = F.create_map(*(F.lit(x) for pair in VTK_TYPES.items() for x in pair))
        cells = cells.join(kinds, "gnum")
        unknown = cells.where(known[F.col("kind")].isNull()).select("kind").first()
        if unknown is not None:
            raise ValueError(f"{path}: cell type {unknown['kind']} is not known")
        kind = known[F.col("kind")]
    return vertices, cells.select("gnum", kind.alias("elt_type"), F.lit(1).alias("order"), "connec"), scalars


def listed_by(words: Words, index: int, count: int, start: int) -> DataFrame:
    """(entry, slot, value): the lists of `count` entries, of which the index begins at the place `index` and the values at
    `start`. An entry of the index says where its list begins."""
    begins = words.span(index, count + 1).select("entry", F.col("word").try_cast("long").alias("begin"))
    first = begins.where("entry = 0").select(F.col("begin").alias("base"))
    ends = begins.select((F.col("entry") - 1).alias("entry"), F.col("begin").alias("end"))
    spans = begins.join(ends, "entry").join(F.broadcast(first)).where("end > begin")  # base is one number
    slots = spans.select("entry", F.posexplode(F.sequence(F.col("begin") - F.col("base"), F.col("end") - F.col("base") - 1)).alias("slot", "place"))
    last = begins.where(F.col("entry") == count).select(F.col("begin")).first()["begin"] - first.first()["base"]
    values = words.span(start, last).select(F.col("entry").alias("place"), F.col("word").try_cast("long").alias("value"))
    return slots.join(values, "place").select("entry", "slot", "value")


def read_polyhedra(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A polyhedra text file: header (dim, vertices, faces, cells, face list, cell list), coordinates, face to vertex and
    cell to face indexes and lists. Gives vertices, (face, connec) and (cell, face) with signed faces."""
    words = Words.of(spark, path)
    dim, nv, nf, nc, lf, _ = words.whole(*range(1, 7))
    at = 7
    vertices = points_of(words.entries(at, nv, dim), dim)
    at += dim * nv
    faces = listed_by(words, at, nf, at + nf + 1)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("slot", "value"))), lambda x: x.value)
    faces = faces.groupBy((F.col("entry") + 1).alias("face")).agg(ordered.alias("connec"))
    at += nf + 1 + lf
    cells = listed_by(words, at, nc, at + nc + 1).select((F.col("entry") + 1).alias("cell"), F.col("value").alias("face"))
    return vertices, faces, cells
