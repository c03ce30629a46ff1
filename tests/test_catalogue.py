"""Every registered query of the engine against its SQL."""

import math

import duckdb
import pytest

from meshweave import catalogue


@pytest.fixture(scope="module")
def sql(small):
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v + 0.0 if isinstance(v, float) else v
    return sorted(columns), sorted((tuple(clean(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, small, sql, name):
    made = catalogue.QUERIES[name](spark, small)
    want = sql.sql(catalogue.ORACLES[name])
    assert rows(made.columns, [tuple(r) for r in made.collect()]) == rows(want.columns, want.fetchall())


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
