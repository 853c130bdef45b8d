"""Nearest boxes of many boxes: blocks of both sides meet, and pairs are never rows.

Boxes have places in the order of their ties. The first ``FIRST`` of them meet every query, so that a query has
a limit that later boxes have to be below: one at the same distance comes later. The others are cut into
blocks of near boxes of like width; a block of queries meets the blocks whose bounds are below its limit. Bounds are
told by the distance's own formula, whose roundings keep the order, so they rule out no box that counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellframe.operators.order import places
from cellframe.plans.skew import facts_of
from cellframe.sources.shared import written

#: Boxes that every query meets, boxes and queries of a block, blocks that a task holds at once, and queries that it compares at once.
FIRST, BOXES, QUERIES, HELD, SLICE = 1 << 12, 1 << 9, 1 << 10, 1 << 6, 1 << 8
#: Parts into which the first axis is cut at most.
SLABS = 1 << 7


def bound_names(d: int) -> tuple[list[str], list[str]]:
    return [f"lo{i}" for i in range(d)], [f"hi{i}" for i in range(d)]


def nearest_boxes(boxes: DataFrame, queries: DataFrame, d: int, n: int, metric: str) -> DataFrame:
    """(row, place, dist, rank): the ``n`` nearest boxes (place, lo0.., hi0..) of each query (row, lo0.., hi0..), ties by place.

    Bounds are doubles without NaN; places count from 1, rows are unique.
    """
    lows, highs = bound_names(d)
    ends, count = [*lows, *highs], int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = boxes.filter(F.col("place") <= FIRST).select("place", *ends).toArrow()  # FIRST rows at most
    start = [_arrays(first.slice(at, BOXES), "place", d) for at in range(0, first.num_rows, BOXES)]

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                some = batch.slice(at, QUERIES)
                rows, q_low, q_high = _arrays(some, "row", d)
                i, place, dist = nearest_of(q_low, q_high, np.full(len(rows), np.inf), start, n, metric)
                cuts = np.searchsorted(i, np.arange(len(rows) + 1))
                limit = np.full(len(rows), np.inf)
                whole = np.diff(cuts) == n
                limit[whole] = dist[cuts[1:][whole] - 1]
                lists = [pa.ListArray.from_arrays(pa.array(cuts.astype("i4")), pa.array(x)) for x in (place, dist)]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(limit), *lists], [*some.schema.names, "limit", "places", "dists"])

    shape = f"row long, {', '.join(f'{c} double' for c in ends)}, limit double, places array<long>, dists array<double>"
    tried = written(queries.select("row", *ends).repartition(count, "row").mapInArrow(begin, shape), "tried")
    found = tried.select("row", F.explode(F.arrays_zip("places", "dists")).alias("f")).select("row", F.col("f.places").alias("place"), F.col("f.dists").alias("dist"))
    rest = boxes.filter(F.col("place") > FIRST).select("place", *ends)
    if not rest.isEmpty():
        found = found.unionByName(_later(rest, tried.filter(F.col("limit") > 0).select("row", *ends, "limit"), d, n, metric, count))
    order = Window.partitionBy("row").orderBy("dist", "place")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def _blocks(frame: DataFrame, d: int, size: int, name: str) -> DataFrame:
    """The frame with the number of a block of about ``size`` rows: of like width, cut on the first axis, then on the second."""
    lows, highs = bound_names(d)
    middles = [F.col(lo) / 2 + F.col(h) / 2 for lo, h in zip(lows, highs, strict=True)]
    widths = [F.col(h) - F.col(lo) for lo, h in zip(lows, highs, strict=True)]
    widest = F.greatest(*widths) if d > 1 else widths[0]
    slabs = max(1, min(SLABS, ceil(sqrt(frame.count() / size)))) if d > 1 else 1
    cuts = frame.agg(F.percentile_approx(middles[0], [k / slabs for k in range(1, slabs)], 10_000)).first()[0] if slabs > 1 else None
    kind = F.when(widest > 0, F.floor(F.least(F.log2(widest) / 2, F.lit(10_000.0)))).otherwise(F.lit(-10_000)).cast("int")
    slab = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda x: x < middles[0])) if cuts else F.lit(0)
    placed = places(frame.withColumns({"kind": kind, "slab": slab, "along": middles[min(d, 2) - 1]}), ["kind", "slab", "along"], "pos")
    return placed.withColumn(name, F.xxhash64("kind", "slab", F.floor(F.col("pos") / size))).drop("kind", "slab", "along", "pos")


def _ends_of(d: int, prefix: str) -> list[Column]:
    """The least and largest of each bound, as ``prefix`` + least/most + bound."""
    return [f(c).alias(f"{prefix}{how}_{c}") for c in sum(bound_names(d), []) for how, f in (("least", F.min), ("most", F.max))]


def _later(boxes: DataFrame, queries: DataFrame, d: int, n: int, metric: str, count: int) -> DataFrame:
    """(row, place, dist): boxes that can be among the ``n`` nearest of a query and lie below its limit."""
    ends = sum(bound_names(d), [])
    held = _blocks(boxes, d, BOXES, "b")
    held = written(held.groupBy("b").agg(F.count("*").alias("many"), *_ends_of(d, "b"), F.collect_list(F.struct("place", *ends)).alias("rows")), "boxes")
    asked = written(_blocks(queries, d, QUERIES, "g"), "asked")
    groups = asked.groupBy("g").agg(F.max("limit").alias("limit"), *_ends_of(d, "q")).repartition(count, "g")
    near, far = block_distances(d, metric)
    pairs = groups.crossJoin(held.drop("rows")).select("g", "b", "limit", near.alias("near"), F.when(F.col("many") >= n, far).alias("far"))
    of_group = Window.partitionBy("g")
    # a whole block within a distance has n boxes within it; another box may be as far and come first
    sure = pairs.withColumn("sure", F.coalesce(F.min("far").over(of_group), F.lit(float("inf"))))
    met = sure.filter((F.col("near") < F.col("limit")) & (F.col("near") <= F.col("sure")))
    turn = F.floor((F.row_number().over(of_group.orderBy("near", "b")) - 1) / HELD).cast("int")
    met = written(met.select("g", "b", turn.alias("turn"), "sure"), "pairs")
    sides = [
        asked.join(met.groupBy("g", "turn").agg(F.max("sure").alias("sure")), "g").select("g", "turn", "row", *ends, "limit", "sure"),
        facts_of(met.select("g", "b", "turn"), held.select("b", "rows"), ["b"]).select(F.col("g").alias("of"), F.col("turn").alias("at"), "rows"),
    ]
    a, b = (side.repartition(count, *keys).groupBy(*keys) for side, keys in zip(sides, (("g", "turn"), ("of", "at")), strict=True))
    return a.cogroup(b).applyInArrow(lambda q, r: _met(q, r, d, n, metric), "row long, place long, dist double")


def _met(queries: pa.Table, rows: pa.Table, d: int, n: int, metric: str) -> pa.Table:
    numbers, q_low, q_high = _arrays(queries, "row", d)
    limit, sure = queries["limit"].to_numpy(), queries["sure"].to_numpy()
    blocks = []
    for lists in rows["rows"].chunks:
        for k in range(len(lists)):
            blocks.append(_arrays(pa.RecordBatch.from_struct_array(lists[k].values), "place", d))
    i, place, dist = nearest_of(q_low, q_high, np.minimum(limit, np.nextafter(sure, np.inf)), blocks, n, metric)
    return pa.table({"row": numbers[i], "place": place, "dist": dist})


def _arrays(table: pa.Table | pa.RecordBatch, number: str, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers and the bounds, an axis a row."""
    lows, highs = ([np.asarray(table[c].to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table[c].to_numpy(), "f8") for c in names] for names in bound_names(d))
    numbers = table[number].to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table[number].to_numpy()
    return np.asarray(numbers, "i8"), np.array(lows), np.array(highs)


def block_distances(d: int, metric: str) -> tuple[Column, Column]:
    """What any box and query of two blocks are apart at least, and at most, from the blocks' least and largest bounds."""
    c, zero = F.col, F.lit(0.0)
    near, far = [], []
    for i in range(d):
        least = {s: (c(f"{s}least_lo{i}"), c(f"{s}least_hi{i}")) for s in "bq"}
        most = {s: (c(f"{s}most_lo{i}"), c(f"{s}most_hi{i}")) for s in "bq"}
        if metric == "edge":
            near.append(F.greatest(least["q"][0] - most["b"][1], least["b"][0] - most["q"][1], zero))
            far.append(F.greatest(most["q"][0] - least["b"][1], most["b"][0] - least["q"][1], zero))
        else:
            low = ((least["b"][0] - most["q"][0]) + (least["b"][1] - most["q"][1])) / 2
            high = ((most["b"][0] - least["q"][0]) + (most["b"][1] - least["q"][1])) / 2
            near.append(F.greatest(low, -high, zero))
            far.append(F.greatest(-low, high))
    # an infinite bound can make a gap NaN: nothing is ruled out then
    squares = [[F.nanvl(g, F.lit(other)) for g in gaps] for gaps, other in ((near, 0.0), (far, float("inf")))]
    return tuple(F.sqrt(reduce(Column.__add__, [g * g for g in gaps])) for gaps in squares)


def distances(low: np.ndarray, high: np.ndarray, q_low: np.ndarray, q_high: np.ndarray, metric: str) -> np.ndarray:
    """Of every query (a row) to every box, to the same bits as ``metrics.BOX_METRICS``."""
    total = None
    for lo, h, ql, qh in zip(low, high, q_low[:, :, None], q_high[:, :, None], strict=True):
        if metric == "edge":
            gap = np.maximum(np.maximum(ql - h, lo - qh), 0.0)
        else:
            gap = ((lo - ql) + (h - qh)) / 2
        gap *= gap
        total = gap if total is None else total + gap
    return np.sqrt(total)


def least_distances(low: np.ndarray, high: np.ndarray, q_low: np.ndarray, q_high: np.ndarray, metric: str) -> np.ndarray:
    """What every query is apart at least from any of the boxes."""
    total = np.zeros(q_low.shape[1])
    for lo, h, ql, qh in zip(low, high, q_low, q_high, strict=True):
        if metric == "edge":
            gap = np.maximum(np.maximum(ql - h.max(), lo.min() - qh), 0.0)
        else:
            gap = np.maximum(np.maximum(((lo.min() - ql) + (h.min() - qh)) / 2, -(((lo.max() - ql) + (h.max() - qh)) / 2)), 0.0)
        gap = np.where(np.isnan(gap), 0.0, gap)
        total = total + gap * gap
    return np.sqrt(total)


def nearest_of(q_low: np.ndarray, q_high: np.ndarray, limit: np.ndarray, blocks: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place, distance) of the first ``n`` boxes by distance and place that are nearer than each query's limit, in this order."""
    held = np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0)
    most = np.full(len(limit), np.inf)  # the n-th of what is held
    with np.errstate(all="ignore"):
        bounds = [least_distances(low, high, q_low, q_high, metric) for _, low, high in blocks]
        for at in sorted(range(len(blocks)), key=lambda k: bounds[k].min(initial=np.inf)):
            place, low, high = blocks[at]
            open_ = np.flatnonzero((bounds[at] < limit) & (bounds[at] <= most))
            new = []
            for start in range(0, len(open_), SLICE):
                some = open_[start : start + SLICE]
                x = distances(low, high, q_low[:, some], q_high[:, some], metric)
                reach = most[some]
                if n < len(place):
                    reach = np.fmin(reach, np.partition(x, n - 1, axis=1)[:, n - 1])
                i, j = np.nonzero((x < limit[some, None]) & (x <= reach[:, None]))
                new.append((some[i], place[j], x[i, j]))
            if any(len(i) for i, _, _ in new):
                i, places_, x = (np.concatenate(parts) for parts in zip(held, *new, strict=True))
                order = np.lexsort((places_, x, i))
                i, places_, x = i[order], places_[order], x[order]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                last = rank == n - 1
                most[i[last]] = x[last]
                held = tuple(v[rank < n] for v in (i, places_, x))
    return held
