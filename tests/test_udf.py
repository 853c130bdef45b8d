from pyspark.sql import functions as F

from cellframe.functions import udf
from cellframe.operators.tables import ArrayTable, SpatialTable


def test_callers_functions(spark):
    frame = spark.createDataFrame([(float(x), float(x * x % 7), x) for x in range(20)], "x double, y double, id long")
    table = SpatialTable(frame, ("x", "y"), ("id",))
    odd = udf.predicate(lambda i: i % 2 == 1)
    assert {r.id for r in table.window((3.0, 0.0), (9.0, 6.0), where=odd(F.col("id"))).collect()} == {3, 5, 7, 9}
    largest = udf.metric(lambda p, c: (p[0] - c[0]).abs().combine((p[1] - c[1]).abs(), max), 2)
    want = sorted(range(20), key=lambda x: (max(abs(x - 10), abs(x * x % 7 - 3)), x))[:5]
    assert [r.id for r in table.nearest(5, (10.0, 3.0), largest).collect()] == want
    doubled = udf.mapped(table.extent(), lambda batch: batch.assign(twice=batch.id * 2)[["twice"]], "twice long")
    assert {r.twice for r in doubled.collect()} == {2 * x for x in range(20)}


def test_array_keys(spark):
    frame = spark.createDataFrame([([float(i + j) for j in range(65)], i) for i in range(10)], "k array<double>, id long")
    table = ArrayTable(frame, "k", ("id",))
    assert [r.id for r in table.nearest(2, [3.2 + j for j in range(65)]).collect()] == [3, 4]
    assert {r.id for r in table.within([3.0 + j for j in range(65)], 8.1).collect()} == {2, 3, 4}
    assert {r.id for r in table.window([2.0 + j for j in range(65)], [4.0 + j for j in range(65)]).collect()} == {2, 3, 4}
