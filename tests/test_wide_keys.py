"""Bit queries on keys beyond 16 and 20 bits."""

import duckdb
import pytest

from cellframe import catalog


@pytest.mark.parametrize("name", ["bit_moves", "zorder_first", "zorder_rank"])
def test_large_keys(spark, tmp_path, name):
    path = str(tmp_path / "part.parquet")
    duckdb.execute(f"COPY (SELECT p_partkey * 997 AS p_partkey, p_size FROM '/root/testdata/sf0.01/part.parquet') TO '{path}' (FORMAT parquet)")
    wanted = duckdb.execute(catalog.ORACLES[name].replace("FROM part", f"FROM '{path}'")).fetchall()
    got = list(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect()))
    assert max(r[0] for r in wanted) > 1 << 16 or name == "zorder_first"
    assert sorted(got) == sorted(wanted)
