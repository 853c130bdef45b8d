"""Joins of tables with a third of their rows at one place, with broadcast joins off."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellframe.functions.metrics import L1
from cellframe.functions.names import free
from cellframe.operators import joins
from cellframe.plans import skew
from tests.helpers import evenness, shuffle_reads

HOT = {"spark.sql.shuffle.partitions": "24", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}


@pytest.fixture(scope="module")
def plain(spark):
    """Sort-merge joins alone, and no help from adaptive plans."""
    before = {k: spark.conf.get(k) for k in HOT}
    for k, v in HOT.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def tables(spark, n, hot, seed=3, spread=0.0):
    """Points of which a third are around one place, and their coordinates."""
    rng = np.random.default_rng(seed)
    xy = rng.uniform(0, 1000, (n, 2))
    xy[: n // 3] = np.array(hot) + rng.uniform(-spread, spread, (n // 3, 2))
    return spark.createDataFrame([(*map(float, p), i) for i, p in enumerate(xy)], "x double, y double, p long").repartition(6), xy


def inside(points, boxes):
    return sorted((i, j) for j, (a, b, c, d) in enumerate(boxes) for i in np.flatnonzero((points[:, 0] >= a) & (points[:, 0] <= b) & (points[:, 1] >= c) & (points[:, 1] <= d)).tolist())


def boxes_of(spark, boxes):
    return spark.createDataFrame([(*map(float, b), j) for j, b in enumerate(boxes)], "a double, b double, c double, d double, q long")


@pytest.mark.parametrize("spread", [0.0, 1e-4])
def test_window_join_of_a_hot_place(plain, spread):
    points, xy = tables(plain, 30_000, (500.0, 500.0), spread=spread)
    rng = np.random.default_rng(1)
    lows = rng.uniform(0, 1000, (400, 2))
    boxes = np.column_stack([lows[:, 0], lows[:, 0] + 2, lows[:, 1], lows[:, 1] + 2])
    boxes[:3] = [[499, 501, 499, 501], [500, 500, 500, 500], [0, 1000, 0, 1000]]
    found = joins.window_join(points, boxes_of(plain, boxes), ["x", "y"], ["a", "c"], ["b", "d"])
    rows = []
    reads = shuffle_reads(plain, lambda: rows.extend(found.select("p", "q").collect()))
    assert sorted(map(tuple, rows)) == inside(xy, boxes)
    joined = max(reads, key=sum)
    assert sum(joined) > 30_000 and evenness(joined) <= 5


def test_many_boxes_at_a_hot_place(plain):
    """A third of the boxes as well: both sides are dealt, as a grid."""
    points, xy = tables(plain, 6000, (500.0, 500.0))
    rng = np.random.default_rng(1)
    lows = rng.uniform(0, 1000, (4500, 2))
    lows[:1500] = 500.0
    boxes = np.column_stack([lows[:, 0], lows[:, 0], lows[:, 1], lows[:, 1]])
    found = joins.window_join(points, boxes_of(plain, boxes), ["x", "y"], ["a", "c"], ["b", "d"])
    tasks = found.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r[1] for r in tasks) == 2000 * 1500 and max(r[1] for r in tasks) <= 5 * 2000 * 1500 / len(tasks) and len(tasks) > 3


def test_box_join_of_a_hot_place(plain):
    points, xy = tables(plain, 12_000, (500.0, 500.0))
    rng = np.random.default_rng(1)
    lows = rng.uniform(0, 1000, (300, 2))
    boxes = np.column_stack([lows[:, 0], lows[:, 0] + 9, lows[:, 1], lows[:, 1] + 9])
    boxes[:2] = [[499, 501, 499, 501], [500, 500, 500, 500]]
    found = joins.box_join(points, boxes_of(plain, boxes), ["x", "y"], ["x", "y"], ["a", "c"], ["b", "d"])
    rows = []
    reads = shuffle_reads(plain, lambda: rows.extend(found.select("p", "q").collect()))
    assert sorted(map(tuple, rows)) == inside(xy, boxes)
    assert evenness(max(reads, key=sum)) <= 5


def test_cells_are_split_where_points_differ(plain):
    """A crowd of different points is cut finer, one of equal points is not."""
    for spread, deeper in ((1e-3, True), (0.0, False)):
        points, xy = tables(plain, 20_000, (500.0, 500.0), spread=spread)
        finest, count = joins.finest_level(points, ["x", "y"], [1.0, 1.0])
        split = joins.split_cells(points, ["x", "y"], [1.0, 1.0], finest, count)
        assert bool(split) == deeper and all(level <= finest for level in split)
    points, xy = tables(plain, 20_000, (500.0, 500.0), spread=1e-3)
    rng = np.random.default_rng(4)
    lows = rng.uniform(499.999, 500.001, (300, 2))
    boxes = np.column_stack([lows[:, 0], lows[:, 0] + 2e-5, lows[:, 1], lows[:, 1] + 2e-5])
    found = joins.window_join(points, boxes_of(plain, boxes), ["x", "y"], ["a", "c"], ["b", "d"])
    assert sorted((r.p, r.q) for r in found.select("p", "q").collect()) == inside(xy, boxes)
    plan = found._jdf.queryExecution().executedPlan()
    nodes = plan.collectLeaves()
    assert nodes.size() == 2
    made = [j for j in _joins(plan)]
    assert sum(j.metrics().apply("numOutputRows").value() for j in made) < 300 * 200  # not 300 boxes times the crowd


def _joins(plan):
    if "Join" in plan.nodeName():
        yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _joins(children.apply(i))


@pytest.mark.parametrize(("spread", "n"), [(0.0, 1), (0.0, 4), (1e-6, 3)])
def test_neighbours_around_a_hot_place(plain, spread, n):
    points, xy = tables(plain, 4000, (500.0, 500.0), spread=spread)
    rng = np.random.default_rng(8)
    asked = np.concatenate([rng.uniform(0, 1000, (150, 2)), np.full((80, 2), 500.0), 500 + rng.normal(0, 1e-6, (40, 2)), [[-1e5, 3.0]]])
    queries = plain.createDataFrame([(*map(float, q), j) for j, q in enumerate(asked)] + [(None, 1.0, 9999)], "u double, v double, q long")
    found = joins.nearest_join(points, queries, ["x", "y"], ["u", "v"], "q", ["p"], n, L1())
    got = {}
    for r in found.collect():
        got.setdefault(r.q, []).append((r["rank"], r.dist, r.p))
    made = sum(j.metrics().apply("numOutputRows").value() for j in _joins(found._jdf.queryExecution().executedPlan()))
    assert made <= 120 * n * len(asked)
    for j, q in enumerate(asked):
        dist = np.abs(xy[:, 0] - q[0]) + np.abs(xy[:, 1] - q[1])
        assert [p for *_, p in sorted(got[j])] == np.lexsort((np.arange(len(xy)), dist))[:n].tolist()


def test_parts_and_names(plain):
    assert skew.parts(10, 10, 1000) == (1, 1) and skew.parts(8000, 10, 1000) == (8, 1)
    assert skew.parts(3000, 3000, 1000) == (4, 4) and skew.parts(900, 9000, 1e6) == (1, 8)
    frame = plain.createDataFrame([(1, 2)], "_a long, _B long")
    assert free(frame, "_a", "_b", "_a", "c") == ["_a_", "_b_", "_a__", "c"]


def test_clashing_names(plain):
    points, xy = tables(plain, 200, (500.0, 500.0))
    boxes = boxes_of(plain, [[400, 600, 400, 600], [0, 10, 0, 1000]])
    for c in ("_level", "_cell", "_part", "_other", "_key", "_radius", "_la", "_lb", "_lo0", "_q0", "_number", "_salt"):
        points = points.withColumn(c, F.lit(1))
    for c in ("_level_", "_radius_", "_q1", "_hi0"):
        boxes = boxes.withColumn(c, F.lit(2))
    found = joins.window_join(points, boxes, ["x", "y"], ["a", "c"], ["b", "d"])
    assert sorted((r.p, r.q) for r in found.collect()) == inside(xy, [[400, 600, 400, 600], [0, 10, 0, 1000]])
    assert found.columns == points.columns + boxes.columns
    assert joins.box_join(points, boxes, ["x", "y"], ["x", "y"], ["a", "c"], ["b", "d"]).count() == found.count()
    near = joins.nearest_join(points, boxes, ["x", "y"], ["a", "c"], "q", ["p"], 2)
    assert near.count() == 4 and near.columns == points.columns + boxes.columns + ["dist", "rank"]


def test_levels_of_split_cells_are_one_branch_each(spark):
    split = {-joins.STEP * k: [k] for k in range(joins.DEEPER)}
    column = joins._deeper(F.col("l"), [F.col("a")], [F.col("b")], [1.0], 0, split)
    shorter = joins._deeper(F.col("l"), [F.col("a")], [F.col("b")], [1.0], 0, {-joins.STEP * k: [k] for k in range(joins.DEEPER // 2)})
    assert len(str(column)) < 3 * len(str(shorter))


def test_joins_send_no_side_through_the_driver_and_use_all_partitions(spark):
    some = spark.range(6000).selectExpr("id AS a", "CAST(id % 7 AS DOUBLE) AS x")
    other = spark.range(50).selectExpr("id AS b", "CAST(id % 7 AS DOUBLE) AS u", "CAST(id % 7 AS DOUBLE) + 1 AS v")
    boxes = some.selectExpr("a", "x", "x + 1 AS y")
    for met in (joins.window_join(some, other, ["x"], ["u"], ["v"]), joins.box_join(boxes, other, ["x"], ["y"], ["u"], ["v"])):
        rows = met.count()
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan and "REPARTITION_BY_NUM" in plan
        near = some.join(other, (F.col("u") <= F.col("x") + (1 if "y" in met.columns else 0)) & (F.col("x") <= F.col("v")))
        assert rows == near.count()


def test_pairs_of_heavy_keys_are_made_from_blocks(plain):
    """A join of rows would make every pair in its buffer; columns keep their order, their types and their nulls."""
    left = plain.range(9000).selectExpr("IF(id % 3 = 0, CAST(NULL AS STRING), CAST(id AS STRING)) AS `a.b`", "IF(id < 6000, 7L, IF(id = 6000, NULL, id)) AS k", "id AS p", "map('x', id) AS m")
    right = plain.range(4000).selectExpr("id AS q", "IF(id < 1500, 7L, IF(id < 1600, NULL, id + 5000)) AS k")
    found = skew.dealt_join(left, right, ["k"], 13_000)
    assert found.dtypes == skew.spread_join(left, right, ["k"]).dtypes
    rows = [(r.k, r["a.b"], r.p, r.m, r.q) for r in found.filter("p % 500 < 2 OR k <> 7").collect()]
    told = lambda p: None if p % 3 == 0 else str(p)
    hot = [(7, told(p), p, {"x": p}, q) for p in range(6000) if p % 500 < 2 for q in range(1500)]
    assert sorted(rows, key=lambda r: (r[2], r[4])) == hot + [(k, told(k), k, {"x": k}, k - 5000) for k in range(6600, 9000)]
    kept = found.filter("p % 500 < 2")
    assert len(kept.collect()) == len(hot) + sum(p % 500 < 2 for p in range(6600, 9000))
    made = sum(j.metrics().apply("numOutputRows").value() for j in _joins(kept._jdf.queryExecution().executedPlan()))
    assert 0 < made < 24 * 1500  # not 24 * 1500 pairs, though the filter is known to the join
    assert found.count() == 6000 * 1500 + 2400


def test_no_radius_is_equality(plain):
    """A third of the points at one place: its pairs are made from blocks, without a grid."""
    points, xy = tables(plain, 9000, (500.0, 500.0))
    odd = plain.createDataFrame([(0.0, -0.0, 20_000), (float("nan"), 1.0, 20_001), (float("inf"), 1.0, 20_002), (None, 1.0, 20_003), (1.0, 1.0 + 2**-52, 20_004)], "x double, y double, p long")
    asked = [(500, 500.0, j) for j in range(1200)] + [(0, 0.0, 2000), (1, 1.0, 2001), (1, None, 2002)]
    queries = plain.createDataFrame(asked, "u int, v double, q long").unionByName(odd.selectExpr("CAST(NULL AS INT) AS u", "y AS v", "p AS q"))
    found = joins.distance_join(points.unionByName(odd), queries, ["x", "y"], ["u", "v"], 0.0)
    assert found.columns == ["x", "y", "p", "u", "v", "q", "dist"]
    kept = found.filter("p % 100 = 0 OR p >= 9000").select("p", "q", "dist")
    assert sorted(map(tuple, kept.collect())) == [(p, q, 0.0) for p in range(0, 3000, 100) for q in range(1200)] + [(20_000, 2000, 0.0)]
    assert sum(j.metrics().apply("numOutputRows").value() for j in _joins(kept._jdf.queryExecution().executedPlan())) < 30 * 1200
    ends = plain.createDataFrame([(float("nan"), 1.0, 1), (float("inf"), 1.0, 2)], "u double, v double, q long")
    assert joins.distance_join(odd, ends, ["x", "y"], ["u", "v"], 0.0).isEmpty()
