"""What decides whether the engine's queries hold at size, seen on small tables."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshweave import catalogue
from meshweave.functions import selector
from meshweave.operators import candidates, location, mesh, nearest
from meshweave.plans import durable
from meshweave.sources import generators


def initial_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["extrude_mesh", "cells_from_faces", "tessellate_cells", "tria_area"])
def test_no_side_of_a_mesh_join_goes_through_the_driver(spark, small, name):
    """Vertices and elements grow with the tables, however small Spark takes their exploded rows for."""
    plan = initial_plan(catalogue.QUERIES[name](spark, small))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_cells_are_put_together_once_and_measured_in_batches(spark, small):
    plan = initial_plan(catalogue.QUERIES["solids_of_polygons"](spark, small))
    assert plan.count("MapInArrow") == plan.count("ArrowEvalPython") == 1 and "lambdafunction((lambda" not in plan
    # corners and faces are dealt before they are listed: lists of one would be packed, sent and unpacked
    for made in re.findall(r"collect_list.*?partial_collect_list", plan.replace("merge_collect_list", ""), re.DOTALL):
        assert "Exchange" not in made


def test_elements_are_made_once_for_their_cells(spark):
    vertices, quads = generators.grid_vertices(spark, 4, 4), generators.grid_quads(spark, 4, 4)
    made = quads.withColumn("p", F.when(F.col("gnum") % 2 == 0, F.col("gnum"))).repartition(3)
    marked = made.mapInArrow(lambda batches: batches, made.schema)
    cells = mesh.cells(vertices, marked)
    assert initial_plan(cells).count("MapInArrow") == 1
    assert {(r.gnum, r.elt_type, tuple(r.connec), r.p) for r in cells.collect()} == {(r.gnum, r.elt_type, tuple(r.connec), r.p) for r in made.collect()}
    assert all([v.gnum for v in r.vtx] == r.connec for r in cells.collect())


def test_points_on_a_cylinder_are_in_it(spark):
    """59 - 50 and 24 - 12 are 9 and 12, 15 from the axis exactly, wherever x is."""
    rows = spark.range(2000).selectExpr("id AS gnum", "id * 0.00397D AS x", "59.0D AS y", "24.0D AS z")
    assert selector.select(rows, "cylinder[0, 50, 12, 8, 50, 12, 15]").count() == 2000


def test_points_of_one_split_meet_few_boxes_in_many_tasks(spark):
    points = spark.range(1000).coalesce(1).selectExpr("id AS tgt_gnum", "id / 1000D AS x", "0.5D AS y", "0.0D AS z")
    boxes = spark.range(4).selectExpr("id AS src_gnum", "id / 4D AS xmin", "(id + 1) / 4D AS xmax", "0.0D AS ymin", "1.0D AS ymax", "0.0D AS zmin", "0.0D AS zmax")
    met = candidates.points_in_boxes(points, boxes)
    used = met.select(F.spark_partition_id().alias("task")).distinct().count()
    assert used == int(spark.conf.get("spark.sql.shuffle.partitions")) and met.count() == 1003


def test_neighbours_are_found_by_cells_of_queries(spark, monkeypatch):
    """Queries of one bucket look for buckets together: rows follow the cells, not the queries."""
    made = []
    monkeypatch.setattr(nearest, "stored", lambda df: made.append(durable.stored(df)) or made[-1])
    queries = spark.range(20_000).selectExpr("id AS gnum", "(id * 7919 % 20011) / 20011D AS x", "(id * 104729 % 20021) / 20021D AS y", "0.0D AS z")
    points = spark.range(200).selectExpr("id AS gnum", "(id * 37 % 211) / 211D AS x", "(id * 91 % 223) / 223D AS y", "0.0D AS z")
    got = nearest.nearest(queries, points, 4)
    assert got.count() == 80_000 and max(df.count() for df in made) < 10_000


def test_least_distances_and_ties():
    q, p = np.array([[0.0, 0.0], [5.0, 0.0]]), np.array([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [4.0, 0.0]])
    query, point, d2, rank = nearest.k_least(q, p, np.array([4, 2, 3, 1]), 2)
    assert query.tolist() == [0, 0, 1, 1] and point.tolist() == [1, 2, 3, 0] and d2.tolist() == [1, 1, 1, 16] and rank.tolist() == [1, 2, 1, 2]


@pytest.mark.parametrize("few", [candidates.FEW, 0])
def test_balls_that_meet_one_group_of_cells_go_to_several_tasks(spark, monkeypatch, few):
    """Targets above a small box, all of whose cells are one group: no task compares half of the pairs."""
    shares = []
    whole = location.evaluated

    def seen(pairs):
        shares.extend(r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect())
        return whole(pairs)

    monkeypatch.setattr(location, "evaluated", seen)
    for module in (location, candidates):
        monkeypatch.setattr(module, "FEW", few)
    monkeypatch.setattr(location, "TOGETHER", 50)
    targets = spark.range(1200).selectExpr("id AS gnum", "id * 37 % 1201 / 400D AS x", "id * 91 % 1203 / 401D AS y", "2.5D AS z")
    cells = mesh.cells(generators.box_vertices(spark, 4, 2.0), generators.box_hexas(spark, 4))
    got = {r.tgt_gnum: r.dist2 for r in location.closest(targets, cells).collect()}
    assert got == pytest.approx({r.gnum: max(0, r.x - 2) ** 2 + max(0, r.y - 2) ** 2 + 0.25 for r in targets.collect()}, abs=1e-9)
    assert max(shares) < sum(shares) / 2


def test_located_targets_are_chosen_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(candidates, "POINTS", 100)
    targets = spark.range(2000).selectExpr("id AS gnum", "id * 37 % 2003 / 2003D AS x", "id * 91 % 2011 / 2011D AS y", "0.0D AS z")
    made = location.locate(targets, mesh.cells(generators.grid_vertices(spark, 4, 4), generators.grid_quads(spark, 4, 4)))
    sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2000 and max(sizes) < 200


def test_a_batch_sends_back_the_pairs_that_can_win(spark):
    """Points of an edge, a corner and the inside of four cells: ties stay, others go."""
    points = spark.createDataFrame([(1, 0.5, 0.25, 0.0), (2, 0.5, 0.5, 0.0), (3, 0.4999, 0.2, 0.0)], "gnum long, x double, y double, z double")
    cells = mesh.cells(generators.grid_vertices(spark, 2, 2), generators.grid_quads(spark, 2, 2))
    pairs = location.placed(points).crossJoin(location.boxed(cells)).coalesce(1)
    got = sorted((r.tgt_gnum, r.src_gnum) for r in location.evaluated(pairs).collect())
    assert got == [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (2, 3), (3, 0)]
