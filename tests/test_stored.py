"""Stored tables: which files a change writes, what readers see, and what a change that breaks off leaves."""

import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellframe.functions.metrics import L1, L2
from cellframe.operators import mutate
from cellframe.sources import stored
from cellframe.sources.clustered import z_column, z_numbers
from cellframe.sources.stored import Folder, StoredTable, VersionConflict

SCHEMA = "x double, y double, id long, lo0 long"


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(stored, "BLOCK", 64)


def points(spark, n=2000, seed=1):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(*map(float, p), i, 1) for i, p in enumerate(np.round(rng.uniform(0, 1000, (n, 2)), 3))], SCHEMA)


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def scanned(frame) -> int:
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    leaves = (plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan).collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def files(table):
    return {r[0] for r in table.blocks.select("file").collect()}


def test_put_rewrites_only_what_it_meets(spark, tmp_path, small):
    base = points(spark)
    table = StoredTable.create(base, str(tmp_path / "t"), ["x", "y"], files=12)
    assert rows(table.read()) == rows(base) and table.version == 0
    near = base.filter("x < 120 AND y < 120").select("x", "y", (F.col("id") + 10_000).alias("id"), "lo0")
    changes = near.unionByName(spark.createDataFrame([(5.0, 5.0, 77, 2), (None, 1.0, 78, 2)], SCHEMA))
    after = table.put(changes)
    assert rows(after.read()) == rows(mutate.put(base, changes, ["x", "y"])) and after.version == 1
    kept, old = files(after) & files(table), files(table)
    met = {r["file"] for r in table.blocks.collect() for c in changes.collect() if c.x is not None and r.lo0 <= c.x <= r.hi0 and r.lo1 <= c.y <= r.hi1}
    assert old - kept == met and 0 < len(met) < 6
    assert rows(table.read()) == rows(base)  # the version before
    outside = after.put(spark.createDataFrame([(5000.0, 5000.0, 1, 1)], SCHEMA))
    assert files(after) < files(outside) and outside.read().count() == after.read().count() + 1
    gone = outside.remove(base.filter("id % 100 = 3").select("x", "y"))
    assert rows(gone.read()) == rows(outside.read().join(base.filter("id % 100 = 3").select("x", "y"), ["x", "y"], "left_anti").select("x", "y", "id", "lo0"))


def test_move(spark, tmp_path, small):
    base = points(spark, 600)
    table = StoredTable.create(base, str(tmp_path / "t"), ["x", "y"], files=8)
    some = base.filter("id < 40").select("x", "y", (F.col("x") + 0.5).alias("u"), F.col("y").alias("v"))
    taken = base.filter("id = 50").select(F.col("x").alias("u"), F.col("y").alias("v")).crossJoin(base.filter("id = 45").select("x", "y")).select("x", "y", "u", "v")
    moves = some.unionByName(taken)
    for conflict in ("reject", "overwrite"):
        after = table.move(moves, ["u", "v"], conflict)
        assert rows(after.read()) == rows(mutate.move(base, moves, ["x", "y"], ["u", "v"], conflict))
        Folder(spark, table.path).delete("versions/000000000001")


@pytest.mark.parametrize("step", ["write_clustered", "_bounds", "publish"])
def test_broken_off(spark, tmp_path, monkeypatch, step):
    """Whatever step is the last one, the version before is whole, and the change can be made again."""
    base = points(spark, 300)
    table = StoredTable.create(base, str(tmp_path / "t"), ["x", "y"], files=4)
    changes = base.filter("id < 30").select("x", "y", (F.col("id") * 2).alias("id"), "lo0")

    def stop(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(Folder, "publish", stop) if step == "publish" else broken.setattr(stored, step, stop)
        with pytest.raises(RuntimeError):
            table.put(changes)
    assert StoredTable.versions(spark, table.path) == [0] and rows(StoredTable.open(spark, table.path).read()) == rows(base)
    after = StoredTable.open(spark, table.path).put(changes)
    assert rows(StoredTable.open(spark, table.path).read()) == rows(mutate.put(base, changes, ["x", "y"])) == rows(after.read())
    with pytest.raises(VersionConflict):
        table.put(changes)
    assert rows(StoredTable.open(spark, table.path, 0).read()) == rows(base)
    named = lambda: {str(p.relative_to(table.path)) for p in Path(table.path).rglob("data/*/*.parquet")}
    assert named() > files(after)
    after.vacuum()
    assert named() == files(after) and StoredTable.versions(spark, table.path) == [1] and rows(after.read()) == rows(mutate.put(base, changes, ["x", "y"]))
    with pytest.raises(FileNotFoundError):
        StoredTable.open(spark, table.path, 0)


def test_empty_and_null_keys(spark, tmp_path):
    empty = StoredTable.create(points(spark).limit(0), str(tmp_path / "e"), ["x", "y"])
    assert empty.read().count() == 0 and empty.nearest(3, (0.0, 0.0)).count() == 0
    held = empty.put(spark.createDataFrame([(1.0, 2.0, 3, 4), (math.nan, 2.0, 5, 6), (None, None, 9, 9)], SCHEMA))
    assert held.read().count() == 2 and [r.id for r in held.nearest(5, (0.0, 0.0)).collect()] == [3, 5]
    odd = StoredTable.create(spark.createDataFrame([(1.0, 2.0, 3, 4), (None, None, 9, 9)], SCHEMA), str(tmp_path / "n"), ["x", "y"])
    assert odd.put(spark.createDataFrame([(1.0, 2.0, 4, 4)], SCHEMA)).read().count() == 2


@pytest.mark.parametrize(("metric", "kept"), [(L2(), 10_000), (L1(), 10_000), (L2(), 5)])
def test_best_first(spark, tmp_path, small, monkeypatch, metric, kept):
    monkeypatch.setattr(stored, "KEPT", kept)
    base = points(spark, 4000)
    table = StoredTable.create(base, str(tmp_path / "t"), ["x", "y"], files=16)
    for n, center in ((1, (500.0, 500.0)), (37, (10.0, 990.0)), (5, (-1e6, 3.0)), (4000, (1.0, 1.0)), (5000, (1.0, 1.0))):
        want = table.table().nearest(n, center, metric)
        near = table.nearest(n, center, metric)
        assert [tuple(r) for r in near.collect()] == [tuple(r) for r in want.collect()]
        if n < 40 and kept > 5:
            assert scanned(near) < 0.6 * scanned(want)


def test_regions(spark, tmp_path, small):
    """A ring reads fewer rows than its bounding box."""
    base = points(spark, 4000)
    table = StoredTable.create(base, str(tmp_path / "t"), ["x", "y"], files=32)

    def far(low, high):
        return F.sqrt(sum((F.greatest(F.abs(lo - 500), F.abs(hi - 500)) ** 2 for lo, hi in zip(low, high, strict=True)), F.lit(0.0)))

    def close(low, high):
        return F.sqrt(sum((F.greatest(lo - 500, F.lit(500.0) - hi, F.lit(0.0)) ** 2 for lo, hi in zip(low, high, strict=True)), F.lit(0.0)))

    dist = F.sqrt((F.col("x") - 500) ** 2 + (F.col("y") - 500) ** 2)
    ring = table.region(lambda lo, hi: (close(lo, hi) <= 450) & (far(lo, hi) >= 400), lambda k: dist.between(400, 450))
    box = table.window((50.0, 50.0), (950.0, 950.0))
    assert rows(ring) == rows(base.filter(dist.between(400, 450)))
    assert rows(box) == rows(base.filter("x BETWEEN 50 AND 950 AND y BETWEEN 50 AND 950"))
    assert scanned(ring) < 0.8 * scanned(box)
    assert table.region(lambda lo, hi: F.lit(False), lambda k: F.lit(True)).count() == 0


def test_z_numbers():
    """As ``bits.interleave`` of cells told one by one; nulls, NaNs and what lies above all knots are in the last cell."""
    rng = np.random.default_rng(3)
    knots = [np.sort(rng.integers(0, 30, 9)).astype(float), np.array([2.0, 2.0, 2.0]), np.sort(rng.normal(size=9)), np.array([])]
    columns = [np.concatenate([rng.uniform(-5, 40, 200), k[:2], [np.nan, np.inf, -np.inf, 0.0][: 4 - len(k[:2])]]) for k in knots]

    def cell(x, k):
        if len(k) < 2 or k[0] == k[-1] or x < k[0]:
            return 0
        share = next(((i + (x - a) / (b - a)) / (len(k) - 1) for i, (a, b) in enumerate(zip(k, k[1:], strict=False)) if b > a and x < b), 1.0)
        return min(int(share * 32), 31)

    want = []
    for row in zip(*columns, strict=True):
        cells = [cell(x, k) for x, k in zip(row, knots, strict=True)]
        want.append(int("".join(str(c >> level & 1) for level in range(4, -1, -1) for c in cells), 2))
    assert z_numbers(columns, knots, 5).tolist() == want


def test_clustered_write_has_a_short_plan(spark, tmp_path):
    """Cells are no expressions of a branch for each knot, which are too long to be compiled and cost 30 us a row."""
    frame = spark.range(1000).select(*[(F.col("id") * k % 997).cast("double").alias(f"k{k}") for k in (1, 3, 5, 7)])
    placed = frame.withColumn("z", z_column(frame, frame.columns, 15))
    assert len(placed._jdf.queryExecution().optimizedPlan().toString()) < 2000 and placed.select("z").distinct().count() > 900


def test_bounds_cut_names_once_a_block(spark, tmp_path):
    StoredTable.create(points(spark, 50), str(tmp_path / "t"), ("x", "y"), 2)
    frame = spark.read.parquet(*map(str, (tmp_path / "t" / "data").iterdir()))
    plan = stored._bounds(frame, ("x", "y"))._jdf.queryExecution().optimizedPlan().toString()
    of_blocks, below = plan.split("\n", 1)
    assert of_blocks.startswith("Aggregate") and "regexp_extract" in of_blocks and "regexp_extract" not in below
