"""Batched queries: one lookup, window, ball or neighbour search for each row of a table.

The spatial joins put both sides on a hierarchy of grids whose cell widths are powers of
two. The finest grid follows the data: about ``PER_CELL`` points to a cell over the middle
of their distribution, so boxes without a width (points, balls of radius 0) meet cells of a
few points and far outliers do not make it coarse. A box is listed on a level whose cells
are no narrower than the box, where it meets at most two cells on each axis, or is cut into
more cells of a finer level where that is cheaper than copying all points to one more level.
The join is then an equi-join on level and cell with the exact predicate behind it, and no
side needs to be broadcast. Extents and levels are found by jobs of their own; a few numbers
reach the driver.

The grids are a partition tree that follows the data: cells in which too many different points
lie are split, level by level, and narrow boxes go to the split cells' level. Cells that cannot
be split, or that wide boxes need whole, are dealt to several tasks (``plans.skew``). Both are
decided by counts in samples, and change who does the work alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil, floor, log2, prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellframe.functions.encoding import sortable_long
from cellframe.functions.metrics import BOX_METRICS, L2, Metric
from cellframe.functions.names import free
from cellframe.operators.box_blocks import bound_names, nearest_boxes
from cellframe.operators.order import places
from cellframe.operators.tables import conjunction
from cellframe.plans.skew import SEEN, dealt_join, facts_of
from cellframe.sources.shared import written

#: Axes that go into the cell; more would only multiply the cells of a box.
AXES = 3
#: Points that the finest cells hold on average, levels between two grids, and cells that a box is cut into at most.
PER_CELL, STEP, MOST_CELLS = 8, 2, 1024
#: Points of a cell that are not split, cells of a level that are split at most, and levels below the finest grid.
UNSPLIT, MOST_SPLIT, DEEPER = 64 * PER_CELL, 1 << 9, 12
#: What one more row of a side costs, in pairs that are looked at.
ROW_COST = 16


def lookup(queries: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Point lookups: ``inner`` gets, ``left_semi`` contains, ``left_anti`` lacks, ``left`` gets or null."""
    return queries.join(table, list(keys), how)


def lookup_or_default(queries: DataFrame, table: DataFrame, keys: Sequence[str], value: str, default) -> DataFrame:
    """The value of each key, the default where it is absent or null."""
    found = queries.join(table.select(*keys, value), list(keys), "left")
    return found.withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def _cell(x: Column, level: Column, unit: float) -> Column:
    return F.floor(x / (F.lit(unit) * F.pow(F.lit(2.0), level))).cast("long")


def finest_level(frame: DataFrame, columns: Sequence[str], units: Sequence[float]) -> tuple[int, int]:
    """(the level of the finest grid for these coordinates, number of rows), by one pass over them.

    Widths come from the middle 98 % of each axis; cell numbers of the farthest rows stay exact.
    """
    ends = [e for c in columns for x in [F.col(c).cast("double")] for e in (F.percentile_approx(x, F.array(F.lit(0.01), F.lit(0.99)), F.lit(1000)), F.max(F.abs(x)))]
    got = frame.agg(F.count("*"), *ends).first()
    spans, far = [], 0.0
    for i, u in enumerate(units):
        middle, most = got[1 + 2 * i], got[2 + 2 * i]
        if middle is not None:
            spans.append((middle[1] - middle[0]) / u)
            far = max(far, abs(most) / u if most == most else 0.0)
    spread = [x for x in spans if 0 < x < float("inf")]
    level = floor(log2(prod(x / max(spread) for x in spread) * PER_CELL / max(got[0], 1)) / len(spread) + log2(max(spread))) if spread else -40
    return max(level, ceil(log2(far)) - 50 if 0 < far < float("inf") else -1000), got[0]


def _level(lows: Sequence[Column], highs: Sequence[Column], units: Sequence[float], finest: int) -> Column:
    """The lowest of the levels, ``STEP`` apart from the finest on, whose cells are no narrower than the box."""
    widths = [(h - lo) / F.lit(u) for lo, h, u in zip(lows, highs, units, strict=True)]
    widest = reduce(F.greatest, widths) if len(widths) > 1 else widths[0]
    steps = F.least(F.ceil((F.log2(widest) - F.lit(float(finest))) / STEP), F.lit(1100).cast("long"))
    return F.when(widest > 2.0**finest, steps * STEP + finest).otherwise(F.lit(finest)).cast("int")


def _cells(lows: Sequence[Column], highs: Sequence[Column], level: Column, units: Sequence[float]) -> Column:
    """All cells of a level that a box meets, as an array of structs."""
    spans = [F.sequence(_cell(lo, level, u), _cell(h, level, u)) for lo, h, u in zip(lows, highs, units, strict=True)]
    out = F.transform(spans[0], lambda x: F.array(x))
    for span in spans[1:]:
        out = _longer(out, span)
    return out


def _longer(cells: Column, span: Column) -> Column:
    return F.flatten(F.transform(cells, lambda cell: F.transform(span, lambda x: F.array_append(cell, x))))


def listing_levels(boxes: dict[int, int], points: int, axes: int, finest: int | None = None, lowest: int | None = None) -> dict[int, int]:
    """The level on which the boxes of each level are listed, from how many there are; none below ``lowest``.

    On a finer level a box is more rows, but meets fewer points that are outside of it; one more
    level costs a copy of all points. The cheapest is taken, from the finest level up.
    """
    finest = min(boxes, default=0) if finest is None else finest
    listed: dict[int, int] = {}
    for level in sorted(boxes):
        costs = {}
        for to in range(level, (finest if lowest is None else lowest) - 1, -STEP):
            cells = (2 ** min(level - to, 64) + 1) ** axes
            if cells > MOST_CELLS:
                break
            held = min(float(points), PER_CELL * 2.0 ** min((to - finest) * axes, 1000))
            costs[to] = boxes[level] * cells * (ROW_COST + held) + (0 if to in listed.values() else ROW_COST * points)
        listed[level] = min(costs, key=costs.get, default=level)
    return listed


def _doubles(columns: Sequence[str]) -> list[Column]:
    return [F.col(c).cast("double") for c in columns]


def _codes(cell: Column, level: int) -> Column:
    return F.xxhash64(F.lit(level), cell)


def _at(xs: Sequence[Column], level: int, units: Sequence[float]) -> Column:
    """The cell of a place, as an array."""
    return F.array(*[_cell(x, F.lit(float(level)), u) for x, u in zip(xs, units, strict=True)])


def split_cells(points: DataFrame, columns: Sequence[str], units: Sequence[float], finest: int, count: int) -> dict[int, list[int]]:
    """Level -> hashes of the cells that are split: the inner nodes of the partition tree, from the finest grid down.

    A cell is split if it holds more than ``UNSPLIT`` points (or a ``MOST_SPLIT``-th of all) besides
    those of its most common place, which no grid can part. If a cell is split, so are those
    around it. Counts are estimates from a sample.
    """
    most = max(UNSPLIT, count / MOST_SPLIT)
    if count <= 8 * most:  # one task's work, whatever its form
        return {}
    share = min(1.0, SEEN / most)
    some = points.sample(share, seed=23) if share < 1 else points
    whole = some.select(*[x.alias(f"x{i}") for i, x in enumerate(_doubles(columns))]).filter(conjunction([F.col(f"x{i}").isNotNull() for i in range(len(columns))]))
    places = whole.groupBy(*whole.columns).agg(F.count("*").alias("n"))
    xs = [F.col(c) for c in whole.columns]
    ladder = [finest - STEP * k for k in range(DEEPER)]
    cells = F.array(*[F.struct(F.lit(level).alias("level"), _codes(_at(xs, level, units), level).alias("code")) for level in ladder])
    counted = places.select(F.explode(cells).alias("c"), "n").groupBy("c").agg(F.sum("n").alias("all"), F.max("n").alias("one"))
    out: dict[int, list[int]] = {}
    for row in counted.filter(F.col("all") - F.col("one") > most * share).select("c.level", "c.code").collect():
        out.setdefault(row[0], []).append(row[1])
    return out


def _deeper(level: Column, lows: Sequence[Column], highs: Sequence[Column], units: Sequence[float], finest: int, split: dict[int, list[int]]) -> Column:
    """The level of a box: below the finest grid, as far as its lower corner's cell is split and its width allows."""
    widths = [(h - lo) / F.lit(u) for lo, h, u in zip(lows, highs, units, strict=True)]
    widest = reduce(F.greatest, widths) if len(widths) > 1 else widths[0]
    # one branch a level, and the level named in the first alone: an expression that holds itself twice a level doubles with each
    out, to = F.when(level != finest, level), finest
    while to in split:
        fits = widest * 1.000001 <= 2.0 ** (to - STEP)
        out = out.when(~F.coalesce(fits & _codes(_at(lows, to, units), to).isin(split[to]), F.lit(False)), F.lit(to))
        to -= STEP
    return out.otherwise(F.lit(to)).cast("int")


def _near_split(xs: Sequence[Column], level: int, units: Sequence[float], codes: list[int]) -> Column:
    """Whether a box of this level can reach a place: its lower corner lies in the place's cell or the one before, on each axis, and that cell's parent is split."""
    cells = [_cell(x, F.lit(float(level)), u) for x, u in zip(xs, units, strict=True)]
    corners = [[]]
    for c in cells:
        corners = [[*done, F.shiftright(c - back, STEP)] for done in corners for back in (0, 1)]
    return reduce(Column.__or__, [_codes(F.array(*c), level + STEP).isin(codes) for c in corners])


def window_join(points: DataFrame, boxes: DataFrame, keys: Sequence[str], lows: Sequence[str], highs: Sequence[str], units: Sequence[float] | None = None) -> DataFrame:
    """Every (point, box) with the point inside the box, bounds included; all columns of both sides.

    ``units`` scale the axes against each other; they affect cost only. Points and boxes with
    a null coordinate, and boxes with a bound above the other, meet nothing.
    """
    n = min(AXES, len(keys))
    units = list(units or [1.0] * n)[:n]
    on_level, on_cell = free([points, boxes], "_level", "_cell")
    finest, count = finest_level(points, keys[:n], units)
    split = split_cells(points, keys[:n], units, finest, count)
    well = conjunction([F.col(lo) <= F.col(h) for lo, h in zip(lows, highs, strict=True)])
    low, high, xs = _doubles(lows[:n]), _doubles(highs[:n]), _doubles(keys[:n])
    sized = boxes.filter(well).withColumn(on_level, _level(low, high, units, finest))
    if split:
        sized = sized.withColumn(on_level, _deeper(F.col(on_level), low, high, units, finest, split))
    found = {r[0]: r[1] for r in sized.groupBy(on_level).count().collect() if r[0] is not None}
    listed = {level: level for level in found if level < finest} | listing_levels({k: v for k, v in found.items() if k >= finest}, count, n, finest)
    place = F.create_map(*[F.lit(x) for pair in listed.items() for x in pair])[F.col(on_level)] if listed else F.col(on_level)
    sized = sized.withColumn(on_level, place)
    sized = sized.withColumn(on_cell, F.explode(_cells(low, high, F.col(on_level).cast("double"), units)))
    levels = [F.lit(x) if x >= finest else F.when(_near_split(xs, x, units, split[x + STEP]), F.lit(x)) for x in sorted(set(listed.values()))]
    placed = points.withColumn(on_level, F.explode(F.array_compact(F.array(*levels)).cast("array<int>") if levels else F.array().cast("array<int>")))
    placed = placed.withColumn(on_cell, F.array(*[_cell(x, F.col(on_level).cast("double"), u) for x, u in zip(xs, units, strict=True)]))
    met = dealt_join(placed, sized, [on_level, on_cell], count * max(1, len(levels)) + sum(found.values()))
    return met.filter(conjunction([F.col(k).between(F.col(lo), F.col(h)) for k, lo, h in zip(keys, lows, highs, strict=True)])).drop(on_level, on_cell)


def box_join(left: DataFrame, right: DataFrame, left_low: Sequence[str], left_high: Sequence[str], right_low: Sequence[str], right_high: Sequence[str], units: Sequence[float] | None = None, include: bool = False) -> DataFrame:
    """Every pair of boxes that meet, touching included; with ``include``, that has the left box within the right.

    A pair is made on the coarser of its two levels, in the cell of the corner where the
    two boxes' overlap starts, so it comes out once. Boxes of split cells go to deeper levels. Boxes
    that are wider than all of the other side are cut into cells of a finer level where that is cheaper.
    """
    n = min(AXES, len(left_low))
    units = list(units or [1.0] * n)[:n]
    own_left, own_right, on_level, on_turn, on_cell, *corners = free([left, right], "_la", "_lb", "_level", "_turn", "_cell", *[f"_{side}{i}" for side in ("left", "right") for i in range(n)])
    cells_left, cells_right = corners[:n], corners[n:]
    first, second = finest_level(left, left_low[:n], units), finest_level(right, right_low[:n], units)
    finest, count = min(first[0], second[0]), first[1] + second[1]
    split: dict[int, list[int]] = {}
    for frame, low, many in ((left, left_low, first[1]), (right, right_low, second[1])):
        for level, codes in split_cells(frame, low[:n], units, finest, many).items():
            split.setdefault(level, []).extend(codes)

    def placed(frame: DataFrame, low: Sequence[str], high: Sequence[str], own: str) -> DataFrame:
        well = conjunction([F.col(a) <= F.col(b) for a, b in zip(low, high, strict=True)])
        level = _level(_doubles(low[:n]), _doubles(high[:n]), units, finest)
        return frame.filter(well).withColumn(own, _deeper(level, _doubles(low[:n]), _doubles(high[:n]), units, finest, split))

    a, b = placed(left, left_low, left_high, own_left), placed(right, right_low, right_high, own_right)
    found = [{r[0]: r[1] for r in frame.groupBy(c).count().collect() if r[0] is not None} for frame, c in ((a, own_left), (b, own_right))]
    listed = []
    for mine, other in (found, found[::-1]):
        lowest = max(finest, max(other, default=finest))
        listed.append({k: k for k in mine} | listing_levels({k: v for k, v in mine.items() if k > lowest}, sum(other.values()), n, finest, lowest))
    on = lambda c, pairs: F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])[F.col(c)] if pairs else F.col(c)
    a, b = a.withColumn(own_left, on(own_left, listed[0])), b.withColumn(own_right, on(own_right, listed[1]))
    levels = sorted({*listed[0].values(), *listed[1].values()})
    ladder = F.array(*[F.lit(x) for x in levels]).cast("array<int>")

    def spread(frame: DataFrame, low: Sequence[str], high: Sequence[str], own: str, first: Sequence[str], is_left: bool) -> DataFrame:
        up = frame.withColumn(on_level, F.explode(F.filter(ladder, lambda x: x >= F.col(own))))
        # a pair's level is the left box's own one (turn 0), or the right one's alone (turn 1)
        at_home = F.col(on_level) == F.col(own)
        turns = F.array(F.when(at_home, 0).otherwise(1)) if is_left else F.when(at_home, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        up = up.withColumn(on_turn, F.explode(turns))
        level = F.col(on_level).cast("double")
        up = up.withColumns({c: _cell(x, level, u) for c, x, u in zip(first, _doubles(low[:n]), units, strict=True)})
        return up.withColumn(on_cell, F.explode(_cells(_doubles(low[:n]), _doubles(high[:n]), level, units)))

    met = dealt_join(spread(a, left_low, left_high, own_left, cells_left, True), spread(b, right_low, right_high, own_right, cells_right, False), [on_level, on_turn, on_cell], count * max(1, len(levels)))
    overlap = conjunction([(F.col(al) <= F.col(bh)) & (F.col(ah) >= F.col(bl)) for al, ah, bl, bh in zip(left_low, left_high, right_low, right_high, strict=True)])
    if include:
        overlap = conjunction([(F.col(al) >= F.col(bl)) & (F.col(ah) <= F.col(bh)) for al, ah, bl, bh in zip(left_low, left_high, right_low, right_high, strict=True)])
    once = conjunction([F.greatest(x, y) == F.get(on_cell, F.lit(i)) for i, (x, y) in enumerate(zip(cells_left, cells_right, strict=True))])
    return met.filter(overlap & once).drop(on_level, on_turn, on_cell, own_left, own_right, *cells_left, *cells_right)


def _ball_join(points: DataFrame, queries: DataFrame, keys: Sequence[str], centers: Sequence[str], radius: Column, metric: Metric) -> DataFrame:
    """Every (point, query) at most the query's radius apart, with ``dist``."""
    slack = [radius + radius * 1e-9 + F.abs(F.col(c)) * 1e-15 for c in centers]
    names = free([points, queries], *[f"_{end}{i}" for end in ("lo", "hi") for i in range(len(centers))])
    lows, highs = names[: len(centers)], names[len(centers) :]
    reach = queries.withColumns({lo: F.col(c) - s for lo, c, s in zip(lows, centers, slack, strict=True)} | {h: F.col(c) + s for h, c, s in zip(highs, centers, slack, strict=True)})
    near = window_join(points, reach, keys, lows, highs).drop(*lows, *highs)
    return near.withColumn("dist", metric.distance([F.col(k) for k in keys], [F.col(c) for c in centers])).filter(F.col("dist") <= radius)


def _needs_gaps(metric: Metric | None) -> Metric:
    metric = metric or L2()
    if not metric.by_gaps:
        raise ValueError("only metrics of the gaps on the axes (L1, L2) can be joined")
    return metric


def distance_join(points: DataFrame, queries: DataFrame, keys: Sequence[str], centers: Sequence[str], radius: float, metric: Metric | None = None) -> DataFrame:
    """Every (point, query) at most ``radius`` apart, with ``dist``; columns of both sides, whose names must differ.

    Without a radius these are the equal ones, which need no grid and no distance; keys that differ are apart, however little.
    """
    metric = _needs_gaps(metric)
    if radius == 0:
        return _same_places(points, queries, keys, centers)
    return _ball_join(points, queries, keys, centers, F.lit(float(radius)), metric)


def _same_places(points: DataFrame, queries: DataFrame, keys: Sequence[str], centers: Sequence[str]) -> DataFrame:
    """Every (point, query) of equal finite coordinates, with ``dist`` 0."""
    names = free([points, queries], *[f"_x{i}" for i in range(len(keys))])

    def at(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
        finite = conjunction([F.abs(F.col(c).cast("double")) < float("inf") for c in columns])
        # as numbers of their bits: Spark would shuffle doubles again, to make zeros alike
        return frame.filter(finite).withColumns({n: sortable_long(F.col(c).cast("double") + 0.0) for n, c in zip(names, columns, strict=True)})

    a, b = at(points, keys), at(queries, centers)
    return dealt_join(a, b, names, points.count() + queries.count()).drop(*names).withColumn("dist", F.lit(0.0))


#: Levels that cells of a neighbour join can have, how many are added at a time, and points for each neighbour beyond which a cell is looked into.
DEEPEST, MORE, CROWD = 36, 6, 32


def places_of(points: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(the keys as doubles under ``names``, held): how many points each place has; points without a whole key have none."""
    whole = conjunction([F.col(k).isNotNull() & ~F.isnan(F.col(k).cast("double")) for k in keys])
    return points.filter(whole).groupBy(*[(F.col(k).cast("double") + 0.0).alias(c) for k, c in zip(keys, names, strict=True)]).agg(F.count("*").alias("held"))


def neighbour_radii(places: DataFrame, queries: DataFrame, names: Sequence[str], centers: Sequence[str], n: int, metric: Metric, radius: str) -> DataFrame | None:
    """The queries with a ``radius`` within which lie ``n`` points, or all if there are fewer; None without points.

    A query at a place that has ``n`` points needs no radius. For the others, points are counted by
    cells of a grid over their extent, ``n`` of a place at most, finest cells first and coarser
    ones from those; cells that hold many more than ``n`` are cut finer, again and again. A
    query, moved to the nearest place of the extent, takes the finest of its cells that holds
    ``n`` points; none of them is farther than that cell's far corner.
    """
    d = len(names)
    ends = places.agg(F.count("*"), F.sum("held"), *[F.min(c) for c in names], *[F.max(c) for c in names]).first()
    if not ends[0]:
        return None
    lows, highs = list(ends[2 : d + 2]), list(ends[d + 2 :])
    spans = [(h - lo) or 1.0 for lo, h in zip(lows, highs, strict=True)]
    depth = max(0, min(20, ceil(log2(max(ends[1] / max(n, 1), 1)) / d) + 2))
    cells = [f"c{i}" for i in range(d)]

    def cell(x: Column, i: int) -> Column:
        """The finest cell of an axis, the extent being cut into 2^DEEPEST."""
        return F.least(F.floor((x - F.lit(lows[i])) / F.lit(spans[i]) * F.lit(float(1 << DEEPEST))), F.lit((1 << DEEPEST) - 1)).cast("long")

    def at(frame: DataFrame, low: int, high: int) -> DataFrame:
        """The frame's finest cells on levels ``low`` to ``high``."""
        up = frame.withColumn("deep", F.explode(F.sequence(F.lit(low), F.lit(high))))
        return up.withColumns({c: F.expr(f"shiftright({c}, {DEEPEST} - deep)") for c in cells})

    capped = places.select(*[cell(F.col(c), i).alias(k) for i, (c, k) in enumerate(zip(names, cells, strict=True))], F.least("held", F.lit(n)).alias("held"))
    low, crowded, held = 0, capped, None
    while True:
        leaves = at(crowded, depth, depth).groupBy(*cells).agg(F.sum("held").alias("held"))
        fine = leaves.withColumns({c: F.expr(f"shiftleft({c}, {DEEPEST - depth})") for c in cells})
        counted = written(at(fine, low, depth).groupBy("deep", *cells).agg(F.sum("held").alias("held")).filter(F.col("held") >= n), "cells")
        held = counted if held is None else held.unionByName(counted)
        full = counted.filter((F.col("deep") == depth) & (F.col("held") > CROWD * n)).select(*cells)
        if depth == DEEPEST or full.isEmpty():
            break
        shifted = crowded.withColumns({f"f{c}": F.col(c) for c in cells}).withColumns({c: F.expr(f"shiftright({c}, {DEEPEST - depth})") for c in cells})
        crowded = facts_of(shifted, full, cells).select(*[F.col(f"f{c}").alias(c) for c in cells], "held")
        low, depth = depth + 1, min(depth + MORE, DEEPEST)

    spots = free([queries, places], *[f"_q{i}" for i in range(d)])
    asked = queries.withColumns({q: F.col(c).cast("double") + 0.0 for q, c in zip(spots, centers, strict=True)})
    distinct = asked.select(*spots).filter(conjunction([F.col(q).isNotNull() & ~F.isnan(q) for q in spots])).distinct()
    inside = distinct.withColumns({k: cell(F.least(F.greatest(F.col(q), F.lit(lows[i])), F.lit(highs[i])), i) for i, (q, k) in enumerate(zip(spots, cells, strict=True))})
    reached = facts_of(at(inside, 0, depth), held.select("deep", *cells), ["deep", *cells])
    levels = reached.groupBy(*spots).agg(F.max("deep").alias("deep"))
    found = inside.join(levels, list(spots), "left").withColumn("deep", F.coalesce("deep", F.lit(0)))
    gaps = []
    for i, (q, k) in enumerate(zip(spots, cells, strict=True)):
        width = F.pow(F.lit(2.0), -F.col("deep").cast("double")) * F.lit(spans[i])
        start = F.expr(f"shiftright({k}, {DEEPEST} - deep)").cast("double") * width + F.lit(lows[i])
        gaps.append(F.greatest(F.abs(F.col(q) - start), F.abs(F.col(q) - start - width)) + F.lit((abs(lows[i]) + abs(highs[i])) * 1e-12))
    reach = metric.distance(gaps, [F.lit(0.0)] * d) * F.lit(1 + 1e-9)
    full = places.filter(F.col("held") >= n).select(*[F.col(c).alias(q) for c, q in zip(names, spots, strict=True)], F.lit(True).alias("full"))
    sized = found.join(full, list(spots), "left").select(*spots, F.when(F.col("full"), F.lit(0.0)).otherwise(reach).alias(radius))
    return facts_of(asked, sized, spots).drop(*spots)


def first_of_places(points: DataFrame, keys: Sequence[str], tie: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` points of each place: no search can need more. Every task keeps ``n`` of a place before anything is shuffled."""
    (number,) = free(points, "_number")
    at = Window.partitionBy(*[F.col(k).cast("double") + 0.0 for k in keys]).orderBy(*tie)
    return points.withColumn(number, F.row_number().over(at)).filter(F.col(number) <= n).drop(number)


def nearest_join(points: DataFrame, queries: DataFrame, keys: Sequence[str], centers: Sequence[str], query_id: str, tie: Sequence[str], n: int, metric: Metric | None = None) -> DataFrame:
    """The ``n`` nearest points of each query, with ``dist`` and ``rank``; ties by ``tie``.

    Every query gets a radius of its own that is sure to hold ``n`` points (written to the
    shared folder beside the query), and one window join runs over those balls. Where a place has more
    than ``n`` points, its first ``n`` stand for it. Queries with a null centre and points with a null key have no
    neighbours. ``query_id`` must be unique.
    """
    metric = _needs_gaps(metric)
    (radius,) = free([points, queries], "_radius")
    names = [f"x{i}" for i in range(len(keys))]
    sized = None
    if n > 0:
        places = written(places_of(points, keys, names), "places")
        sized = neighbour_radii(places, queries, names, centers, n, metric, radius)
    if sized is None:
        return distance_join(points, queries, keys, centers, 0.0, metric).limit(0).withColumn("rank", F.lit(0))
    crowded = not places.filter(F.col("held") > n).isEmpty()
    some = first_of_places(points, keys, tie, n) if crowded else points
    near = _ball_join(some, written(sized, "radii"), keys, centers, F.col(radius), metric).drop(radius)
    order = Window.partitionBy(query_id).orderBy("dist", *tie)
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


# --- distances between boxes ---


def _box_pairs(left: DataFrame, right: DataFrame, left_low: Sequence[str], left_high: Sequence[str], right_low: Sequence[str], right_high: Sequence[str], radius: Column, metric: str) -> DataFrame:
    """Every (left, right) at most the right box's radius apart, with ``dist``.

    Boxes that near have boxes that meet once the right one is widened by the radius; so have
    their centres, which lie inside.
    """
    d = len(left_low)
    names = free([left, right], *[f"_{end}{i}" for end in ("from", "to") for i in range(d)])
    sure = radius + radius * 1e-9
    reach = [sure + (F.abs(F.col(a).cast("double")) + F.abs(F.col(b).cast("double"))) * 1e-15 for a, b in zip(right_low, right_high, strict=True)]
    wide = right.withColumns({n: F.col(a) - r for n, a, r in zip(names[:d], right_low, reach, strict=True)} | {n: F.col(b) + r for n, b, r in zip(names[d:], right_high, reach, strict=True)})
    doubles = lambda columns: [F.col(c).cast("double") for c in columns]
    met = box_join(left, wide, left_low, left_high, names[:d], names[d:]).drop(*names)
    return met.withColumn("dist", BOX_METRICS[metric](*map(doubles, (left_low, left_high, right_low, right_high)))).filter(F.col("dist") <= radius)


def box_distance_join(left: DataFrame, right: DataFrame, left_low: Sequence[str], left_high: Sequence[str], right_low: Sequence[str], right_high: Sequence[str], radius: float, metric: str = "edge") -> DataFrame:
    """Every pair of boxes at most ``radius`` apart by ``edge`` or ``center`` distance, with ``dist``; columns of both sides, whose names must differ.

    Boxes with a null bound, or with a lower one above the upper, are near nothing.
    """
    return _box_pairs(left, right, left_low, left_high, right_low, right_high, F.lit(float(radius)), metric)


def box_nearest_join(boxes: DataFrame, queries: DataFrame, low: Sequence[str], high: Sequence[str], query_low: Sequence[str], query_high: Sequence[str], query_id: str, tie: Sequence[str], n: int, metric: str = "edge") -> DataFrame:
    """The ``n`` nearest boxes of each query box, with ``dist`` and ``rank``; ties by ``tie``.

    Of equal boxes the first ``n`` stand for all, and equal queries are asked once; the rest is done by blocks
    (``box_blocks``), so ties that many boxes share are no pairs. Boxes as in ``box_distance_join``, those with NaN
    are near nothing either; ``query_id`` must be unique.
    """
    if metric not in BOX_METRICS:
        raise ValueError(f"metric must be one of {sorted(BOX_METRICS)}")
    if n <= 0:
        return box_distance_join(boxes, queries, low, high, query_low, query_high, 0.0, metric).limit(0).withColumn("rank", F.lit(0))
    d = len(low)
    lows, highs = bound_names(d)
    names = free([boxes, queries], "_place", "_row", "_near", *[f"_{c}" for c in (*lows, *highs)])
    place, row, near, ends = *names[:3], names[3:]
    exact = lambda columns: [(F.col(c).cast("double") + 0.0).alias(e) for c, e in zip(columns, ends, strict=True)]
    well = lambda frame, a, b: frame.filter(conjunction([(F.col(x) <= F.col(y)) & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")) for x, y in zip(a, b, strict=True)]))
    plain = [F.col(e).alias(c) for e, c in zip(ends, (*lows, *highs), strict=True)]
    held = places(first_of_places(well(boxes, low, high), [*low, *high], tie, n), tie, place)
    asked = well(queries, query_low, query_high).select("*", *exact([*query_low, *query_high]))
    sought = written(asked.select(*ends).distinct().withColumn(row, F.monotonically_increasing_id()), "sought")
    best = nearest_boxes(held.select(F.col(place).alias("place"), *exact([*low, *high])).select("place", *plain), sought.select(F.col(row).alias("row"), *plain), d, n, metric)
    best = written(best.select(F.col("row").alias(row), F.col("place").alias(place), F.struct("dist", "rank").alias(near)), "nearest")
    told = facts_of(best, held, [place]).groupBy(row).agg(F.collect_list(F.struct(near, *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(boxes.columns)])).alias(near))
    answers = facts_of(asked, sought.join(told, row).drop(row), ends).withColumn(near, F.explode(near))
    return answers.select(*[F.col(f"{near}.c{i}").alias(c) for i, c in enumerate(boxes.columns)], *[F.col(f"`{c}`") for c in queries.columns], F.col(f"{near}.{near}.dist").alias("dist"), F.col(f"{near}.{near}.rank").alias("rank"))
