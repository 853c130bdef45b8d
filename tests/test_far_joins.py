"""Distances between boxes, and between array keys by pivots, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellframe.operators import joins
from cellframe.operators.pivots import PivotTable, choose_pivots
from tests.test_skew import _joins
from tests.test_stored import scanned


def some_boxes(spark, n, seed, names, extra=()):
    rng = np.random.default_rng(seed)
    low = rng.uniform(0, 1000, (n, 2))
    low[: n // 3] = 300.0
    high = low + rng.exponential(8, (n, 2))
    high[: n // 6] = low[: n // 6]
    rows = [(*map(float, a), *map(float, b), i) for i, (a, b) in enumerate(zip(low, high, strict=True))]
    return spark.createDataFrame([*rows, *extra], ", ".join(f"{x} {'long' if k == 4 else 'double'}" for k, x in enumerate(names))), low, high


def distances(metric, low, high, q_low, q_high):
    if metric == "edge":
        return np.sqrt((np.maximum(np.maximum(q_low - high, low - q_high), 0) ** 2).sum(axis=1))
    return np.sqrt(((((low - q_low) + (high - q_high)) / 2) ** 2).sum(axis=1))


@pytest.mark.parametrize("metric", ["edge", "center"])
def test_boxes(spark, metric):
    odd = [(None, 1.0, 2.0, 3.0, 900), (5.0, 5.0, 4.0, 9.0, 901)]
    left, low, high = some_boxes(spark, 240, 1, ["a0", "a1", "b0", "b1", "id"], odd)
    right, q_low, q_high = some_boxes(spark, 60, 2, ["u0", "u1", "v0", "v1", "q"], [(1.0, None, 2.0, 3.0, 902)])
    sides = (["a0", "a1"], ["b0", "b1"], ["u0", "u1"], ["v0", "v1"])
    for radius in (0.0, 25.0):
        got = sorted((r.id, r.q) for r in joins.box_distance_join(left, right, *sides, radius, metric).collect())
        assert got == sorted((int(i), j) for j in range(60) for i in np.flatnonzero(distances(metric, low, high, q_low[j], q_high[j]) <= radius))
    for n in (1, 5, 300):
        near = {}
        for r in joins.box_nearest_join(left, right, *sides, "q", ["id"], n, metric).collect():
            near.setdefault(r.q, []).append((r["rank"], r.id))
        assert set(near) == set(range(60))
        for j, found in near.items():
            order = np.lexsort((np.arange(240), distances(metric, low, high, q_low[j], q_high[j])))[:n]
            assert [i for _, i in sorted(found)] == order.tolist()
    assert joins.box_nearest_join(left.limit(0), right, *sides, "q", ["id"], 2, metric).count() == 0
    assert joins.box_nearest_join(left, right, *sides, "q", ["id"], 0, metric).count() == 0


def clustered_keys(width, n, seed):
    rng = np.random.default_rng(seed)
    return np.round(rng.normal(0, 10, (8, width))[rng.integers(0, 8, n)] + rng.normal(0, 0.3, (n, width)), 4)


@pytest.mark.parametrize("width", [3, 65, 257])
def test_pivots(spark, tmp_path, width):
    keys = clustered_keys(width, 600, width)
    rows = [(list(map(float, k)), i) for i, k in enumerate(keys)] + [(None, 900), ([None] * width, 901), ([float("nan")] * width, 902), (list(map(float, keys[3])), 903)]
    frame = spark.createDataFrame(rows, "key array<double>, id long")
    table = PivotTable.of(frame, "key", ("id",), 4, str(tmp_path / "p"))
    every = np.vstack([keys, keys[3]])
    ids = np.array([*range(600), 903])
    for center in (keys[0], keys[3], keys.mean(axis=0)):
        dist = np.linalg.norm(every - center, axis=1)
        radius = float(np.sort(dist)[30])
        near = table.within(list(map(float, center)), radius * 1.0001)
        assert sorted(r.id for r in near.collect()) == sorted(ids[dist <= radius * 1.0001].tolist())
        got = [r.id for r in table.nearest(7, list(map(float, center))).collect()]
        assert got == ids[np.lexsort((ids, dist))[:7]].tolist()
    passed = table.df.filter(table.reach(list(map(float, keys[0])), 8.0)).count()
    assert passed < 0.5 * 600
    queries = spark.createDataFrame([(list(map(float, keys[i])), i) for i in range(0, 600, 20)] + [(None, 7777)], "at array<double>, q long")
    joined = table.nearest_join(queries, "at", "q", 3)
    found = {}
    for r in joined.collect():
        found.setdefault(r.q, []).append((r["rank"], r.id))
    assert set(found) == set(range(0, 600, 20))
    for q, got in found.items():
        dist = np.linalg.norm(every - keys[q], axis=1)
        assert [i for _, i in sorted(got)] == ids[np.lexsort((ids, dist))[:3]].tolist()
    made = sum(j.metrics().apply("numOutputRows").value() for j in _plan_joins(joined))
    assert made < 0.6 * 30 * 601  # distances taken, of all pairs


def _plan_joins(frame):
    plan = frame._jdf.queryExecution().executedPlan()
    return list(_joins(plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan))


def test_pivot_edges(spark):
    frame = spark.createDataFrame([([1.0, 2.0], 1), ([1.0, 2.0], 2)], "key array<double>, id long")
    assert choose_pivots(frame.limit(0), "key", 3) == [] and len(choose_pivots(frame, "key", 5)) == 2
    empty = PivotTable.of(frame.limit(0), "key", ("id",))
    assert empty.within([1.0, 2.0], 5.0).count() == 0 and empty.nearest(2, [1.0, 2.0]).count() == 0
    table = PivotTable.of(frame.withColumn("pivot0", F.lit(1)), "key", ("id", "pivot0"))
    assert table.nearest(5, [0.0, 0.0]).count() == 2 and table.nearest(0, [0.0, 0.0]).count() == 0
    assert scanned(table.within([9.0, 9.0], 1.0)) == 0 or table.within([9.0, 9.0], 1.0).count() == 0


def test_pivot_join_of_keys_far_from_all(spark):
    """Random directions: no pivot rules out a pair, and yet pairs do not become rows."""
    rng = np.random.default_rng(5)
    keys = rng.normal(size=(1500, 32))
    keys /= np.linalg.norm(keys, axis=1)[:, None]
    frame = spark.createDataFrame([(list(map(float, k)), i) for i, k in enumerate(keys)], "key array<double>, id long")
    queries = frame.filter("id % 10 = 3").select(F.col("key").alias("at"), F.col("id").alias("q"))
    joined = PivotTable.of(frame, "key", ("id",)).nearest_join(queries, "at", "q", 3)
    got = {(r.q, r["rank"]): (r.id, r.dist) for r in joined.collect()}
    assert len(got) == 3 * 150
    for q in range(3, 1500, 10):
        dist = np.linalg.norm(keys - keys[q], axis=1)
        assert [got[q, k][0] for k in (1, 2, 3)] == np.argsort(dist, kind="stable")[:3].tolist()
    assert sum(j.metrics().apply("numOutputRows").value() for j in _plan_joins(joined)) < 0.05 * 150 * 1500


@pytest.mark.parametrize(("decimals", "n"), [(None, 4), (0, 5), (1, 3), (6, 2)])
def test_pivot_join_ties(spark, monkeypatch, decimals, n):
    """Copies, keys on a grid and distances that are rounded alike: ties go by value, nulls first, over tasks as well."""
    monkeypatch.setattr("cellframe.operators.pivots.SHARE", 64)
    rng = np.random.default_rng(11)
    keys = np.vstack([rng.integers(0, 4, (150, 3)), np.full((60, 3), 2), rng.integers(0, 40, (90, 3)) / 10, np.full((2, 3), np.inf)])
    rows = [(list(map(float, k)), None if i == 7 else f"v{(i * 37) % 302:03d}") for i, k in enumerate(keys)]
    frame = spark.createDataFrame(rows, "key array<double>, v string")
    queries = spark.createDataFrame([(rows[i][0], i) for i in range(0, 300, 3)], "at array<double>, q int")
    dist = F.sqrt(F.aggregate(F.zip_with("key", "at", lambda p, c: (p - c) * (p - c)), F.lit(0.0), lambda s, x: s + x))
    every = queries.crossJoin(frame).withColumn("dist", F.round(dist, decimals) if decimals is not None else dist)
    want = every.withColumn("rank", F.expr("row_number() OVER (PARTITION BY q ORDER BY dist, v)")).filter(F.col("rank") <= n)
    got = PivotTable.of(frame, "key", ("v",), 3).nearest_join(queries, "at", "q", n, decimals)
    said = lambda df: sorted((r.q, r["rank"], r.v or "", r.dist, *r.key) for r in df.collect())
    assert said(got) == said(want)
    assert PivotTable.of(frame, "key", ("v",), 3).nearest_join(queries, "at", "q", 0).count() == 0
