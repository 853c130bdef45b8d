"""Hard negatives against brute force over all pairs."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cellframe.llm import hard_negatives, registry

SCHEMA = "vec_id long, label int, embedding array<double>, id int, score int, slot int"


def brute(rows, anchors, positives=5, negatives=3, low=50, high=95):
    rows = [(i, g, v) for i, g, v in rows if i is not None and g is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, g, v in rows:
        if i % anchors:
            continue
        scored = [(-sum(int(a) * int(b) for a, b in zip(v, w, strict=False)), j, h == g) for j, h, w in rows if j != i]
        for s, p, _ in sorted(x for x in scored if x[2])[:positives]:
            fit = sorted(x for x in scored if not x[2] and low * -s <= 100 * -x[0] <= high * -s)
            out += [(i, p, k, n, -s, -m) for k, (m, n, _) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def found(spark, rows, every=5, **more):
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, hard_negatives.mine(table, F.col("vec_id") % every == 0, **more).collect()))


@pytest.mark.parametrize("spread", [1, 4, 200])
def test_against_brute_force(spark, spread, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "ROUND", 1)
    rng = random.Random(spread)
    rows = [(i, rng.randint(0, 2), [float(rng.randint(-spread, 2 * spread)) for _ in range(4)]) for i in range(120)]
    assert found(spark, rows) == brute(rows, 5)
    assert found(spark, rows, positives=3, negatives=2, low=10, high=100) == brute(rows, 5, 3, 2, 10, 100)


def test_hot_vector_and_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i, 1 + (i % 3 > 0), [3.0, 1.0]) if i < 60 else (i, i % 4, [float(rng.randint(0, 5)), float(rng.randint(0, 5))]) for i in range(180)]
    rows += [(None, 1, [1.0, 1.0]), (500, None, [1.0, 1.0]), (505, 1, None), (510, 1, [None, 1.0]), (515, 1, [float("inf"), 1.0]), (520, 1, [float("nan"), 1.0])]
    rows += [(525, 1, []), (530, 2, [4.0]), (535, 2, [2.0, 2.0, 9.0]), (-5, 3, [2.0, 2.0]), (-6, 1, [2.0, 2.0])]
    assert found(spark, rows) == brute(rows, 5)
    assert found(spark, rows[:0]) == [] and found(spark, [(1, 1, [1.0])]) == [] and found(spark, [(5, 1, [1.0]), (6, 2, [1.0])]) == []
    far = [(0, 1, [2.0**31, 1.0]), (1, 1, [2.0**31, 3.0]), (2, 2, [2.0**30, 7.0]), (3, 2, [2.0**30, 8.0]), (5, 2, [2.0**30 + 1, -8.0])]
    assert found(spark, far) == brute(far, 5)


def test_repeated_rows(spark):
    rows = [(5, 1, [2.0, 2.0]), (5, 1, [2.0, 2.0]), (6, 1, [3.0, 3.0]), (6, 1, [3.0, 3.0]), (7, 2, [2.0, 2.0]), (7, 2, [2.0, 2.0])]
    assert found(spark, rows) == brute(rows, 5) != []


def test_slots():
    assert hard_negatives.slots_of([100, 60, -5, 100, 1, 0], 50, 95) == [(58, 95), (30, 57), (0, 0)]
    assert hard_negatives.limits(-1, 50, 95) is None and hard_negatives.limits(3, 50, 95) == (2, 2)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    wanted = duckdb.sql(registry.ORACLES["op12_hard_negatives"])
    got = registry.op12_hard_negatives(spark, sf).select(*wanted.columns)
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(wanted.fetchall()) and len(rows) > 100


def test_no_side_is_broadcast(spark, monkeypatch):
    plans = []

    def watched(frame, what):
        plans.append((what, frame._jdf.queryExecution().executedPlan().toString()))
        return kept(frame, what)

    kept = hard_negatives.written
    monkeypatch.setattr(hard_negatives, "written", watched)
    rows = [(i, i % 3, [float(i % 7), float(i % 5)]) for i in range(40)]
    assert found(spark, rows) == brute(rows, 5)
    met = [plan for what, plan in plans if what == "best"]
    assert len(met) == 2 and not any("BroadcastHashJoin" in plan for plan in met)
