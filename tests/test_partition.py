"""Parts of even weight along the curve."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshweave.operators import partition


def frame(spark, n, seed=0, heavy=1000.0):
    rng = np.random.default_rng(seed)
    at = np.concatenate([rng.uniform(0, 1, (n // 2, 3)), rng.normal(0.3, 0.01, (n - n // 2, 3))])
    w = np.where(rng.random(n) < 0.02, heavy, rng.uniform(1, 3, n))
    return spark.createDataFrame([(i, *map(float, p), float(x)) for i, (p, x) in enumerate(zip(at, w, strict=True))], "gnum long, x double, y double, z double, weight double")


def test_parts_are_even_to_one_per_cent_under_weights_that_differ_a_thousandfold(spark):
    points = frame(spark, 60_000)
    dealt = partition.dealt_evenly(points, 6)
    load = [r.w for r in dealt.groupBy("part").agg(F.sum("weight").alias("w")).orderBy("part").collect()]
    assert len(load) == 6 and max(load) - min(load) <= 0.01 * sum(load) / 6
    # the parts are ranges of the curve
    ends = [(r.a, r.b) for r in dealt.groupBy("part").agg(F.min("morton").alias("a"), F.max("morton").alias("b")).orderBy("part").collect()]
    assert all(x[1] < y[0] for x, y in zip(ends, ends[1:], strict=False))


@pytest.mark.parametrize("parts", [1, 2, 7, 40])
def test_splits_and_index_equal_a_plain_version(spark, parts):
    rng = np.random.default_rng(parts)
    codes, weights = rng.integers(0, 300, 2000), rng.integers(0, 50, 2000).astype(float)
    rows = spark.createDataFrame([(int(c), float(w)) for c, w in zip(codes, weights, strict=True)], "morton long, weight double")
    splits = partition.even_splits(rows.repartition(5), parts)
    known = np.unique(codes)
    own = np.array([weights[codes == c].sum() for c in known])
    number = np.minimum(np.floor((np.cumsum(own) - own / 2) * parts / own.sum()), parts - 1).astype(int)
    assert len(splits) == parts - 1 and splits == sorted(splits)
    got = {r.morton: r.part for r in partition.part_of(rows, splits).distinct().select("morton", "part").distinct().collect()}
    assert got == dict(zip(known.tolist(), number.tolist(), strict=True))
    assert partition.part_of(spark.createDataFrame([(None,), (-5,), (10**12,)], "morton long"), splits).orderBy("morton").collect()[0].part is None


def test_heavy_places_empty_tables_and_missing_weights(spark):
    crowd = spark.range(3000).selectExpr("cast(5 as long) as morton", "1.0D as weight").union(spark.range(10).selectExpr("id * 10 as morton", "cast(null as double) as weight"))
    splits = partition.even_splits(crowd, 4)
    assert len(splits) == 3 and partition.part_of(crowd, splits).where("morton = 5").select("part").distinct().count() == 1
    none = crowd.limit(0)
    assert partition.part_of(none, partition.even_splits(none, 4)).count() == 0
    with pytest.raises(ValueError):
        partition.even_splits(crowd, 0)
