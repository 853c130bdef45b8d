"""Two-pass nearest neighbours: a radius first, then an exact search of its ball.

The n-th distance among a few rows can only be too far. Balls of a fraction of that radius
are tried first: one that holds ``n`` entries holds the nearest, and its bounding box
reaches the scan, so that of a Z-clustered table few row groups are read. No pass scans
the whole table unless the ball covers it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.functions.metrics import L2, Metric
from cellframe.operators.tables import SpatialTable

#: Parts of the first radius that are tried, one after the other.
FRACTIONS = (1 / 256, 1 / 64, 1 / 16, 1 / 4)


def nearest(table: SpatialTable, n: int, center: Sequence, metric: Metric | None = None, probe: int = 1000) -> DataFrame:
    """As ``SpatialTable.nearest``; falls back to it where the first ``probe`` rows have fewer than ``n`` distances."""
    metric = metric or L2()
    if n <= 0 or metric.box(center, 1.0) is None:
        return table.nearest(n, center, metric)
    some = SpatialTable(table.df.select(*table.keys).limit(max(probe, n)), table.keys)
    bound = some.nearest(n, center, metric).agg(F.max("dist"), F.count("*")).first()
    if bound[1] < n or bound[0] != bound[0]:
        return table.nearest(n, center, metric)
    order = ["dist", *table.keys, *table.values]
    for part in FRACTIONS:
        ball = table.within(center, bound[0] * part, metric)
        if ball.limit(n).count() == n:
            return ball.orderBy(*order).limit(n)
    return table.within(center, bound[0], metric).orderBy(*order).limit(n)
