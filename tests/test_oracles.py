"""Every query of the spatial engine against its DuckDB oracle."""

import os

import duckdb
import pytest

from cellframe import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return connection


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted([repr([tuple(v[i]) if isinstance(v[i], list) else v[i] for i in order]) for v in values])


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())
