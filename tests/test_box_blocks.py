"""Nearest boxes by blocks, against all pairs."""

import numpy as np
import pytest

from cellframe.operators import box_blocks, joins
from tests.test_skew import _joins


def frame(spark, low, high, prefix, number):
    d = low.shape[1]
    names = [f"{prefix}{end}{i}" for end in ("lo", "hi") for i in range(d)]
    rows = [(*map(float, a), *map(float, b), k) for k, (a, b) in enumerate(zip(low, high, strict=True))]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names) + f", {number} long"), names[:d], names[d:]


def nearest(low, high, q_low, q_high, n, metric):
    """(query, rank) -> (box, distance), from all pairs."""
    out = {}
    for q, (a, b) in enumerate(zip(q_low, q_high, strict=True)):
        gaps = np.maximum(np.maximum(a - high, low - b), 0.0) if metric == "edge" else ((low - a) + (high - b)) / 2
        total = gaps[:, 0] * gaps[:, 0]
        for i in range(1, gaps.shape[1]):
            total = total + gaps[:, i] * gaps[:, i]
        dist = np.sqrt(total)
        for rank, k in enumerate(np.lexsort((np.arange(len(low)), dist))[:n]):
            out[q, rank + 1] = (int(k), float(dist[k]))
    return out


def random_boxes(rng, many, d, in_order=False):
    low = rng.integers(0, 60, (many, d)).astype(float)
    if in_order:  # places and ties go the same way
        low = low[np.argsort(low[:, 0])[::-1]]
    size = rng.choice([0.0, 1.0, 3.0, 40.0], (many, d), p=[0.3, 0.4, 0.2, 0.1])
    return low, low + size


@pytest.mark.parametrize(("d", "n", "metric", "in_order"), [(1, 3, "edge", False), (2, 4, "edge", True), (2, 5, "center", True), (3, 2, "edge", False), (2, 400, "center", False)])
def test_all_pairs(spark, monkeypatch, d, n, metric, in_order):
    for name, value in {"FIRST": 16, "BOXES": 8, "QUERIES": 8, "HELD": 2}.items():
        monkeypatch.setattr(box_blocks, name, value)
    rng = np.random.default_rng(d * 10 + n)
    low, high = random_boxes(rng, 300, d, in_order)
    q_low, q_high = random_boxes(rng, 90, d)
    q_low[:10] -= 200.0
    q_high[10:15] += 500.0
    boxes, *box_ends = frame(spark, low, high, "b", "id")
    queries, *query_ends = frame(spark, q_low, q_high, "q", "q")
    found = joins.box_nearest_join(boxes, queries, *box_ends, *query_ends, "q", ["id"], n, metric)
    assert found.columns == [*boxes.columns, *queries.columns, "dist", "rank"]
    got = {(r.q, r["rank"]): (r.id, r.dist) for r in found.collect()}
    assert got == nearest(low, high, q_low, q_high, n, metric)


def test_odd_boxes(spark, monkeypatch):
    """Boxes without an end, of no number, upside down or null; integers and names that are in use."""
    monkeypatch.setattr(box_blocks, "FIRST", 1)
    inf, nan = float("inf"), float("nan")
    boxes = spark.createDataFrame([(0, -inf, inf), (1, 5.0, 6.0), (2, nan, nan), (3, 9.0, 8.0), (4, None, 1.0), (5, -0.0, 0.0), (6, 7.0, inf)], "id int, `_place` double, rank0 double")
    queries = spark.createDataFrame([(1, 0, 0), (2, 8, 8), (3, None, 1), (4, 2, 1)], "_row int, u int, v long")
    found = joins.box_nearest_join(boxes, queries, ["_place"], ["rank0"], ["u"], ["v"], "_row", ["id"], 3)
    got = sorted((r["_row"], r["rank"], r.id, r.dist) for r in found.collect())
    assert got == [(1, 1, 0, 0.0), (1, 2, 5, 0.0), (1, 3, 1, 5.0), (2, 1, 0, 0.0), (2, 2, 6, 0.0), (2, 3, 1, 2.0)]
    assert joins.box_nearest_join(boxes.filter("id = 3"), queries, ["_place"], ["rank0"], ["u"], ["v"], "_row", ["id"], 3).count() == 0
    assert joins.box_nearest_join(boxes, queries, ["_place"], ["rank0"], ["u"], ["v"], "_row", ["id"], 0).columns == found.columns


def test_ties_that_many_boxes_share_are_no_pairs(spark):
    rng = np.random.default_rng(5)
    low = np.column_stack([rng.uniform(0, 100, 2000), np.zeros(2000)])
    boxes, *box_ends = frame(spark, low, low + 100.0, "b", "id")
    q_low = np.column_stack([rng.uniform(0, 300, 1500), np.zeros(1500)])
    queries, *query_ends = frame(spark, q_low, q_low + 1.0, "q", "q")
    found = joins.box_nearest_join(boxes, queries, *box_ends, *query_ends, "q", ["id"], 3)
    got = {(r.q, r["rank"]): (r.id, r.dist) for r in found.collect()}
    assert got == nearest(low, low + 100.0, q_low, q_low + 1.0, 3, "edge")
    assert sum(j.metrics().apply("numOutputRows").value() for j in _joins(found._jdf.queryExecution().executedPlan())) < 20 * 1500
