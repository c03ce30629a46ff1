"""Steps of several codes, their output, and streams that are killed and started again."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from meshweave.plans.coupling import CouplingError, CouplingSpec, Session
from meshweave.sources import generators, writers
from meshweave.streaming import steps


def linear(v):
    return v.select("gnum", F.array(1 + 2 * F.col("x") - F.col("y")).alias("value"))


def coupled(spark, displacement="static", codes=("a", "b"), name="c"):
    session = Session(spark, codes)
    points = generators.grid_vertices(spark, 3, 3)
    cpl = session.couple(CouplingSpec(name, codes[0], codes[1], method="identity", displacement=displacement))
    cpl.set_source(points=points)
    cpl.set_targets(points)
    cpl.field("f").data = linear(points)
    return session, cpl, points


def test_every_code_has_its_own_steps(spark):
    session, cpl, _ = coupled(spark, "deformable")
    session.step_begin("a", 0.0)
    first = cpl.compute_mapping()
    cpl.exchange("f")
    session.step_begin("b", 0.0)
    # the other code's begin is the same step: the mapping stays and the field is not exchanged twice
    assert cpl.mapping is first and cpl.step == 0
    with pytest.raises(CouplingError, match="was exchanged"):
        cpl.exchange("f")
    session.step_end("a")
    assert session.clocks["b"].open and cpl.in_step
    with pytest.raises(CouplingError, match="was exchanged"):
        cpl.exchange("f")
    session.step_end("b")
    assert not session.in_step
    with pytest.raises(CouplingError, match="no step open"):
        session.step_end("b")
    session.step_begin("b", 1.0)
    assert cpl.mapping is None and (session.clocks["a"].step, session.clocks["b"].step) == (0, 1)
    cpl.exchange("f")
    with pytest.raises(CouplingError, match="is in step 1"):
        session.step_begin("b", 2.0)
    with pytest.raises(CouplingError, match="unknown code"):
        session.step_begin("nobody", 0.0)


def test_codes_of_other_couplings_do_not_touch_a_step(spark):
    session, cpl, points = coupled(spark, codes=("a", "b", "c"))
    session.step_begin("a", 0.0)
    cpl.exchange("f")
    session.step_begin("c", 0.0)
    session.step_end("c")
    assert cpl.in_step
    with pytest.raises(CouplingError):
        cpl.exchange("f")


def test_an_exchange_that_failed_can_be_made_again(spark):
    session, cpl, points = coupled(spark)
    cpl.fields["f"].data = None
    session.step_begin("a", 0.0)
    with pytest.raises(CouplingError, match="no data"):
        cpl.exchange("f")
    cpl.fields["f"].data = points.select("gnum")
    with pytest.raises(AnalysisException):
        cpl.exchange("f")
    cpl.fields["f"].data = linear(points)
    assert cpl.exchange("f").where("value is null").count() == 0


def test_mappings_of_changing_meshes_do_not_pile_up(spark):
    session, cpl, points = coupled(spark, "deformable")
    seen = []
    for step in range(4):
        session.step_begin("a", float(step))
        seen.append((cpl.compute_mapping(), cpl.exchange("f")))
        session.step_end("a")
    assert seen[-1][1].count() == seen[-2][1].count() == 16
    with pytest.raises(Exception):
        seen[0][0].count()


def files(folder):
    return sorted(p.name for p in folder.iterdir())


def numbers(path):
    return [float(x) for x in path.read_text().split("\n")[4:] if x.strip()]


def test_output_without_a_step_has_a_geometry(spark, tmp_path):
    _, cpl, points = coupled(spark)
    writer = writers.EnsightWriter(tmp_path / "out", "k")
    cpl.enable_output(writer, points, generators.grid_quads(spark, 3, 3))
    cpl.exchange("f")
    writer.close()
    assert files(tmp_path / "out") == ["k.case", "k.f.00000", "k.f_status.00000", "k.geo"]
    geometry = (tmp_path / "out" / "k.geo").read_text().split("\n")
    assert geometry[:9] == ["k", "ASCII", "node id given", "element id given", "part", "         1", "k", "coordinates", "        16"]
    ids = [int(x) for x in geometry[9:25]]
    assert ids == sorted(r.gnum for r in points.collect())
    at = {r.gnum: r for r in points.collect()}
    for k, axis in enumerate("xyz"):
        assert [float(x) for x in geometry[25 + 16 * k : 41 + 16 * k]] == pytest.approx([at[g][axis] for g in ids], abs=1e-5)
    assert geometry[73:75] == ["quad4", "         9"]
    corners = [[ids[int(x) - 1] for x in line.split()] for line in geometry[84:93]]
    assert corners == [r.connec for r in generators.grid_quads(spark, 3, 3).orderBy("gnum").collect()]
    assert numbers(tmp_path / "out" / "k.f.00000") == pytest.approx([1 + 2 * at[g].x - at[g].y for g in ids], abs=1e-5)


def test_geometry_follows_a_changing_mesh(spark, tmp_path):
    session, cpl, points = coupled(spark, "variable")
    writer = writers.EnsightWriter(tmp_path / "out", "k")
    for step in range(2):
        for code in ("a", "b"):
            session.step_begin(code, 0.5 * step)
        cpl.enable_output(writer, points.withColumn("x", F.col("x") + step), generators.grid_quads(spark, 3, 3))
        cpl.exchange("f")
        for code in ("a", "b"):
            session.step_end(code)
    writer.close()
    x = [[float(v) for v in (tmp_path / "out" / f"k.geo.0000{k}").read_text().split("\n")[25:41]] for k in (0, 1)]
    assert [b - a for a, b in zip(*x, strict=True)] == pytest.approx([1] * 16, abs=1e-4)
    assert "model: 1 k.geo.*****" in (tmp_path / "out" / "k.case").read_text() and "number of steps: 2" in (tmp_path / "out" / "k.case").read_text()


def test_fields_that_a_step_did_not_exchange_are_marked(spark, tmp_path):
    session, cpl, points = coupled(spark)
    cpl.set_source(points=points.where("gnum <> 1"))
    cpl.field("g").data = linear(points)
    cpl.field("cells", target_dof="cell", source_dof="cell").data = linear(points)
    cpl.field("hidden", visible=False).data = linear(points)
    writer = writers.EnsightWriter(tmp_path / "out", "k")
    cpl.enable_output(writer, points, generators.grid_quads(spark, 3, 3))
    for code in ("a", "b"):
        session.step_begin(code, 0.0)
    cpl.exchange("f")
    session.step_end("a")
    assert "k.g.00000" not in files(tmp_path / "out")
    session.step_end("b")
    assert files(tmp_path / "out") == [f"k.{x}.00000" for x in ("cells", "cells_status", "f", "f_status", "g", "g_status")] + ["k.geo"]
    assert sorted(numbers(tmp_path / "out" / "k.f_status.00000")) == [0.0] * 15 + [1.0]
    assert max(numbers(tmp_path / "out" / "k.f.00000")) == pytest.approx(writers.UNSET, rel=1e-5)
    assert set(numbers(tmp_path / "out" / "k.g_status.00000")) == {-1.0} and numbers(tmp_path / "out" / "k.g.00000") == pytest.approx([writers.UNSET] * 16, rel=1e-5)
    assert set(numbers(tmp_path / "out" / "k.cells_status.00000")) == {-1.0} and len(numbers(tmp_path / "out" / "k.cells_status.00000")) == 9
    session.step_begin("a", 1.0)
    cpl.exchange("g")
    assert set(numbers(tmp_path / "out" / "k.g_status.00001")) == {0.0, 1.0}


def run(spark, folder, tmp_path, name, fail_at=()):
    """A stream of events into two codes until it is through; every failure kills it, and a new session starts again."""
    rows, failures = tmp_path / f"{name}-rows", set(fail_at)
    schema = spark.read.parquet(folder).schema
    numbers_of = []
    for _ in range(10):
        session, cpl, points = coupled(spark, "deformable")
        cpl.enable_output(writers.EnsightWriter(tmp_path / f"{name}-out", "k"), points, generators.grid_quads(spark, 3, 3))

        def exchange(batch, step, session=session, cpl=cpl, points=points):
            assert session.clocks["a"].step == session.clocks["b"].step == cpl.step == step
            numbers_of.append(step)
            total = batch.groupBy((F.col("user_id") % 16).alias("gnum")).agg(F.sum("value").alias("v"))
            cpl.set_source(points=points.join(total.select("gnum"), "gnum", "left_semi"))
            cpl.fields["f"].data = total.select("gnum", F.array("v").alias("value"))
            made = cpl.exchange("f").select(F.lit(step).alias("step"), "gnum", F.round(F.col("value")[0], 6).alias("value"))
            made.write.mode("overwrite").parquet(f"{rows}/step={step}")
            if step in failures:
                failures.discard(step)
                raise RuntimeError("killed")
            session.params.set("a", "time", session.clocks["a"].now)

        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        query = steps.run_steps(stream, session, ["a", "b"], exchange, str(tmp_path / f"{name}-state"))
        try:
            query.awaitTermination()
        except Exception:
            continue
        cpl.output[0].close()
        made = sorted(tuple(r) for r in spark.read.parquet(*(str(p) for p in rows.glob("step=*"))).select("step", "gnum", F.coalesce("value", F.lit(-1.0))).collect())
        return made, numbers_of, session, tmp_path / f"{name}-out"
    raise AssertionError("the stream did not end")


def test_a_killed_stream_goes_on_at_its_step(spark, small, tmp_path):
    events, folder = spark.read.parquet(f"{small}/events.parquet"), str(tmp_path / "in")
    for k in range(4):  # one file for each step, in the order of their times
        events.where(F.col("event_id") % 4 == k).coalesce(1).write.mode("append").parquet(folder)
    want, once, session, out = run(spark, folder, tmp_path, "once")
    got, tries, other, out2 = run(spark, folder, tmp_path, "killed", fail_at=(0, 2, 3))
    assert once == [0, 1, 2, 3] and tries == [0, 0, 1, 2, 2, 3, 3]
    assert got == want and len(want) == 64
    assert session.saved() == other.saved() and session.clocks["b"].step == 3
    assert files(out) == files(out2) and len(files(out)) == 13
    assert all((out / x).read_text() == (out2 / x).read_text() for x in files(out))
    # what was put beside the checkpoint does not grow with the steps
    assert len(list((tmp_path / "once-state" / steps.STATE).iterdir())) == steps.KEPT


def test_a_batch_that_ended_but_was_not_committed_comes_again(spark):
    session, cpl, _ = coupled(spark)
    session.step_begin("a", 0.0, 5)
    before = cpl.exchange("f").collect()
    session.step_end("a")
    fresh, other, _ = coupled(spark)
    fresh.restored(session.saved())
    fresh.step_begin("a", 0.0, 5)
    assert sorted(other.exchange("f").collect()) == sorted(before)
    fresh.step_end("a")
    with pytest.raises(CouplingError, match="past step 3"):
        fresh.step_begin("a", 0.0, 3)
    fresh.step_begin("a", 1.0)
    assert fresh.clocks["a"].step == 6 and other.step == 6
