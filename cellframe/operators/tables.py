"""Table wrappers: points, boxes, multimaps and points with array keys.

A table is a DataFrame with key columns and value columns. Queries return lazy DataFrames,
but for those that answer with a Python value (``contains``, ``unique_keys``) or as an
iterator (``neighbours``). An entry exists if its row does, whatever its value; a row whose
key holds a null has no distance and is no neighbour of anything, one at a NaN distance comes
last. Asking again with other bounds is calling again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from cellframe.functions import bits
from cellframe.functions.encoding import Encoding, Ieee
from cellframe.functions.metrics import BOX_METRICS, L2, Metric, array_l2, box_reach
from cellframe.functions.names import free
from cellframe.operators.order import places
from cellframe.plans.skew import facts_of

Filter = Callable[[DataFrame], Column] | Column | None


def conjunction(parts: Sequence[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def _where(frame: DataFrame, condition: Filter) -> DataFrame:
    if condition is None:
        return frame
    return frame.filter(condition if isinstance(condition, Column) else condition(frame))


def in_window(keys: Sequence[str], low: Sequence, high: Sequence) -> Column:
    """A filter for any query: inside an inclusive window."""
    return conjunction([F.col(k).between(F.lit(a), F.lit(b)) for k, a, b in zip(keys, low, high, strict=True)])


def in_ball(keys: Sequence[str], center: Sequence, radius: float, metric: Metric | None = None) -> Column:
    """A filter for any query: at most a radius away, with the ball's box so that scans can skip."""
    metric = metric or L2()
    exact = metric.distance([F.col(k) for k in keys], [F.lit(c) for c in center]) <= radius
    box = metric.box(center, radius)
    return exact if box is None else in_window(keys, [a for a, _ in box], [b for _, b in box]) & exact


def same_prefix(keys: Sequence[str], other: Sequence[int], ignored_bits: int) -> Column:
    """A filter for any query: keys agree with a point in all but the lowest bits."""
    return conjunction([F.shiftright(F.col(k), ignored_bits) == F.lit(o >> ignored_bits) for k, o in zip(keys, other, strict=True)])


def found(frame: DataFrame, condition: Column) -> DataFrame:
    """(found): whether any row meets the condition; the scan stops at the first."""
    return frame.filter(condition).limit(1).agg((F.count("*") > 0).alias("found"))


def ranked(frame: DataFrame, distance: Column, order: Sequence[str]) -> DataFrame:
    """The rows that have a distance, nearest first, ties by ``order``."""
    return frame.withColumn("dist", distance).filter(F.col("dist").isNotNull()).orderBy("dist", *order)


def _behind(row: Row, order: Sequence[str]) -> Column:
    """Rows after the given one, or equal to it, in ascending order with nulls first."""
    out = F.lit(True)
    for c in reversed(order):
        later = F.col(c).isNotNull() if row[c] is None else F.col(c) > F.lit(row[c])
        out = later | (F.col(c).eqNullSafe(F.lit(row[c])) & out)
    return out


def _checked(values: Sequence, n: int) -> Sequence:
    if len(values) != n:
        raise ValueError(f"{n} dimensions are asked for, {len(values)} given")
    return values


@dataclass(frozen=True)
class SpatialTable:
    """Points: one row for each key (not checked unless ``unique_keys`` is called)."""

    df: DataFrame
    keys: tuple[str, ...]
    values: tuple[str, ...] = ()
    encoding: Encoding = field(default_factory=Ieee)

    bit_depth = 64

    @property
    def dim(self) -> int:
        return len(self.keys)

    def _columns(self) -> list[Column]:
        return [F.col(k) for k in self.keys]

    # --- scans ---

    def extent(self) -> DataFrame:
        return self.df.select(*self.keys, *self.values)

    def key_set(self) -> DataFrame:
        return self.df.select(*self.keys)

    def count(self) -> DataFrame:
        return self.df.agg(F.count("*").alias("n"))

    def clear(self) -> SpatialTable:
        return replace(self, df=self.df.limit(0))

    def unique_keys(self) -> bool:
        return self.df.groupBy(*self.keys).count().filter("count > 1").isEmpty()

    def encoded(self, suffix: str = "_enc") -> DataFrame:
        """The rows with bit-exact BIGINT keys beside the raw ones."""
        return self.df.withColumns({k + suffix: self.encoding.pre(F.col(k), d) for d, k in enumerate(self.keys)})

    def dump(self) -> DataFrame:
        """(line): binary keys and the values, in key order within no particular order of rows."""
        shown = F.concat_ws(",", *[bits.binary_text(self.encoding.pre(F.col(k), d) if dict(self.df.dtypes)[k] in ("double", "float") else F.col(k).cast("long")) for d, k in enumerate(self.keys)])
        value = F.concat_ws(",", *[F.coalesce(F.col(v).cast("string"), F.lit("null")) for v in self.values])
        return self.df.select(F.concat(shown, F.lit("  v="), value).alias("line"))

    def as_boxes(self) -> BoxTable:
        """A table of 2k dimensions seen as boxes of k: the lower corner first."""
        if self.dim % 2:
            raise ValueError("boxes need an even number of dimensions")
        return BoxTable(self.df, self.keys[: self.dim // 2], self.keys[self.dim // 2 :], self.values)

    # --- lookups ---

    def _at(self, key: Sequence) -> Column:
        _checked(key, self.dim)
        return conjunction([c == F.lit(v) for c, v in zip(self._columns(), key, strict=True)])

    def get(self, key: Sequence) -> DataFrame:
        return self.df.filter(self._at(key)).select(*self.values)

    def contains(self, key: Sequence) -> bool:
        return not self.df.filter(self._at(key)).isEmpty()

    def holds(self, key: Sequence) -> DataFrame:
        """(found): ``contains`` as a table."""
        return found(self.df, self._at(key))

    # --- masks: each key has all bits of one number and none outside another ---

    def _masked(self, low: Sequence[int], high: Sequence[int]) -> Column:
        _checked(low, self.dim), _checked(high, self.dim)
        return conjunction([bits.in_mask(c, a, b) for c, a, b in zip(self._columns(), low, high, strict=True)])

    def masked(self, low: Sequence[int], high: Sequence[int], where: Filter = None) -> DataFrame:
        return _where(self.df.filter(self._masked(low, high)), where).select(*self.keys, *self.values)

    def any_masked(self, low: Sequence[int], high: Sequence[int]) -> DataFrame:
        """(found): whether any key is under the mask."""
        return found(self.df, self._masked(low, high))

    # --- windows ---

    def inside(self, low: Sequence, high: Sequence) -> Column:
        """Inclusive in every dimension."""
        _checked(low, self.dim), _checked(high, self.dim)
        return conjunction([c.between(F.lit(a), F.lit(b)) for c, a, b in zip(self._columns(), low, high, strict=True)])

    def window(self, low: Sequence, high: Sequence, where: Filter = None) -> DataFrame:
        """Entries in [low, high]; a bound above the other makes it empty without a scan."""
        _checked(low, self.dim), _checked(high, self.dim)
        if any(a > b for a, b in zip(low, high, strict=True)):
            return self.extent().limit(0)
        return _where(self.df.filter(self.inside(low, high)), where).select(*self.keys, *self.values)

    def query_all(self, low: Sequence, high: Sequence, limit: int | None = None, where: Filter = None, select: Sequence | None = None, ordered: bool = True) -> DataFrame:
        """A window with filter, limit and projection; ``ordered`` makes the limit take the first by key and value."""
        found = self.window(low, high, where)
        if limit is not None:
            found = (found.orderBy(*self.keys, *self.values) if ordered else found).limit(max(limit, 0))
        return found.select(*select) if select else found

    # --- balls and neighbours ---

    def _center(self, center: Sequence) -> list[Column]:
        return [F.lit(c) for c in _checked(center, self.dim)]

    def within(self, center: Sequence, radius: float, metric: Metric | None = None, where: Filter = None) -> DataFrame:
        """Entries at most ``radius`` away, with ``dist``; the ball's bounding box is pushed to the scan."""
        metric = metric or L2()
        frame = self.df
        if (box := metric.box(center, radius)) is not None:
            frame = frame.filter(self.inside([a for a, _ in box], [b for _, b in box]))
        near = _where(frame, where).withColumn("dist", metric.distance(self._columns(), self._center(center)))
        return near.filter(F.col("dist") <= radius).select(*self.keys, *self.values, "dist")

    def nearest(self, n: int, center: Sequence, metric: Metric | None = None, where: Filter = None) -> DataFrame:
        """The ``n`` nearest entries with ``dist``, ties by key and value; none for n <= 0."""
        return self._ranked(center, metric, where).limit(max(n, 0))

    def _ranked(self, center: Sequence, metric: Metric | None, where: Filter) -> DataFrame:
        distance = (metric or L2()).distance(self._columns(), self._center(center))
        return ranked(_where(self.df, where), distance, [*self.keys, *self.values]).select(*self.keys, *self.values, "dist")

    def neighbours(self, center: Sequence, metric: Metric | None = None, where: Filter = None, batch: int = 256) -> Iterator[Row]:
        """Entries with ``dist``, nearest first, for as long as the caller asks.

        Each batch is a bounded top-n of what lies behind the last row given out; equal rows
        of a bag are counted, so none is lost between batches.
        """
        order = ["dist", *self.keys, *self.values]
        every, last, same = self._ranked(center, metric, where), None, 0
        while True:
            rest = every if last is None else every.filter(_behind(last, order))
            rows = rest.orderBy(*order).limit(batch + same).collect()
            yield from rows[same:]
            if len(rows) < batch + same:
                return
            before, last = last, rows[-1]
            same = (same if last == before else 0) + sum(r == last for r in rows[same:])


@dataclass(frozen=True)
class MultiTable(SpatialTable):
    """A bag: any number of rows for a key, equal ones too. Values count, not positions, unless said otherwise."""

    def grouped(self, key: Sequence) -> DataFrame:
        """(values): all values at a key as one sorted array."""
        return self.df.filter(self._at(key)).agg(F.sort_array(F.collect_list(F.struct(*self.values))).alias("values"))

    def listed(self, most: int = 10_000, keys: Sequence | None = None) -> DataFrame:
        """(keys, ordinal, values): each key's values, sorted, as arrays of ``most`` at most, one row for each, from ordinal 0 on.

        All keys, or one of them. Rows are placed in the order of keys and values over all tasks,
        so a key with a third of all values is cut like any other, and no task holds all of its values.
        """
        one, place, first, number, packed = free(self.df, "_one", "_place", "_first", "ordinal", "values")
        rows = (self.df if keys is None else self.df.filter(self._at(keys))).select(*self.keys, *self.values)
        held = conjunction([F.col(k).isNotNull() for k in self.keys])
        placed = places(rows.filter(held), [*self.keys, *self.values], place)
        starts = placed.groupBy(*self.keys).agg(F.min(place).alias(first))
        chunk = F.floor((F.col(place) - F.col(first)) / most).cast("long").alias(number)
        values = F.struct(place, F.struct(*self.values).alias(one)).alias(one)
        parts = facts_of(placed, starts, self.keys).select(*self.keys, chunk, values).groupBy(*self.keys, number).agg(F.sort_array(F.collect_list(one)).alias(packed))
        return parts.withColumn(packed, F.transform(packed, lambda x: x[one]))

    def _pair(self, key: Sequence, value) -> Column:
        return self._at(key) & F.col(self.values[0]).eqNullSafe(F.lit(value))

    def contains_pair(self, key: Sequence, value) -> bool:
        return not self.df.filter(self._pair(key, value)).isEmpty()

    def holds_pair(self, key: Sequence, value) -> DataFrame:
        """(found): ``contains_pair`` as a table."""
        return found(self.df, self._pair(key, value))

    def nearest_positions(self, n: int, center: Sequence, metric: Metric | None = None) -> DataFrame:
        """All values at the ``n`` nearest distinct positions, with ``dist``.

        Every task keeps its ``n`` nearest positions, so that no more than those are shuffled,
        however often a position repeats; the built-in top-n would count its rows.
        """
        metric, order, kinds = metric or L2(), ["dist", *self.keys], dict(self.df.dtypes)
        # 0.0 and -0.0 are one position
        keys = [(F.col(k) + F.lit(0.0)).cast(kinds[k]).alias(k) if kinds[k] in ("float", "double") else F.col(k) for k in self.keys]
        far = self.df.select(metric.distance(self._columns(), self._center(center)).alias("dist"), *keys).filter(F.col("dist").isNotNull())

        def nearest_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for batch in batches:
                table = pa.Table.from_batches([*held, batch])
                held = table.group_by(order).aggregate([]).select(order).sort_by([(c, "ascending") for c in order]).slice(0, n).to_batches()
            yield from held

        best = far.mapInArrow(nearest_of_task, far.schema).distinct() if n > 0 else far
        return self.df.join(best.orderBy(*order).limit(max(n, 0)), list(self.keys)).select(*self.keys, *self.values, "dist")


@dataclass(frozen=True)
class BoxTable:
    """Axis-aligned boxes: a lower and an upper corner."""

    df: DataFrame
    low: tuple[str, ...]
    high: tuple[str, ...]
    values: tuple[str, ...] = ()

    @property
    def dim(self) -> int:
        return len(self.low)

    @property
    def keys(self) -> tuple[str, ...]:
        return (*self.low, *self.high)

    def extent(self) -> DataFrame:
        return self.df.select(*self.keys, *self.values)

    def as_points(self) -> SpatialTable:
        return SpatialTable(self.df, self.keys, self.values)

    def _tail(self, found: DataFrame, where: Filter, limit: int | None, select: Sequence | None) -> DataFrame:
        found = _where(found, where).select(*self.keys, *self.values)
        if limit is not None:
            found = found.orderBy(*self.keys, *self.values).limit(max(limit, 0))
        return found.select(*select) if select else found

    # --- lookups: a box is found by its own bounds ---

    def get(self, low: Sequence | Mapping | Row, high: Sequence | None = None) -> DataFrame:
        return self.as_points().get(self._corners(low, high))

    def contains(self, low: Sequence | Mapping | Row, high: Sequence | None = None) -> bool:
        return self.as_points().contains(self._corners(low, high))

    def _corners(self, low: Sequence | Mapping | Row, high: Sequence | None) -> list:
        """The bounds of a box given by two corners, or by an entry: a row or mapping with the corner columns."""
        if high is not None:
            return [*_checked(low, self.dim), *_checked(high, self.dim)]
        return [low[c] for c in self.keys] if isinstance(low, Mapping | Row) else [*_checked(low, self.dim)] * 2

    # --- queries: two corners, one (a point), or an entry ---

    def include(self, low: Sequence | Mapping | Row, high: Sequence | None = None, where: Filter = None, limit: int | None = None, select: Sequence | None = None) -> DataFrame:
        """Boxes wholly inside the query box: both corners of each are."""
        low, high = self._query(low, high)
        inside = [F.col(c).between(F.lit(a), F.lit(b)) for own in (self.low, self.high) for c, a, b in zip(own, low, high, strict=True)]
        return self._tail(self.df.filter(conjunction(inside)), where, limit, select)

    def intersect(self, low: Sequence | Mapping | Row, high: Sequence | None = None, where: Filter = None, limit: int | None = None, select: Sequence | None = None) -> DataFrame:
        """Boxes that meet the query box; touching counts."""
        low, high = self._query(low, high)
        meets = [(F.col(lo) <= F.lit(b)) & (F.col(hi) >= F.lit(a)) for lo, hi, a, b in zip(self.low, self.high, low, high, strict=True)]
        return self._tail(self.df.filter(conjunction(meets)), where, limit, select)

    def _query(self, low: Sequence | Mapping | Row, high: Sequence | None) -> tuple[list, list]:
        corners = self._corners(low, high)
        return corners[: self.dim], corners[self.dim :]

    def _distance(self, low: Sequence, high: Sequence, metric: str) -> Column:
        return BOX_METRICS[metric]([F.col(c) for c in self.low], [F.col(c) for c in self.high], [F.lit(float(v)) for v in low], [F.lit(float(v)) for v in high])

    def within(self, radius: float, low: Sequence | Mapping | Row, high: Sequence | None = None, metric: str = "edge", where: Filter = None) -> DataFrame:
        """Boxes at most ``radius`` from a point or box, with ``dist``; what they must meet is pushed to the scan."""
        low, high = self._query(low, high)
        reach = box_reach([F.col(c) for c in self.low], [F.col(c) for c in self.high], [float(v) for v in low], [float(v) for v in high], radius)
        near = _where(self.df.filter(conjunction(reach)), where).withColumn("dist", self._distance(low, high, metric))
        return near.filter(F.col("dist") <= radius).select(*self.keys, *self.values, "dist")

    def nearest(self, n: int, low: Sequence | Mapping | Row, high: Sequence | None = None, metric: str = "edge", where: Filter = None) -> DataFrame:
        """The ``n`` boxes nearest to a point or box by ``edge`` or ``center`` distance."""
        distance = self._distance(*self._query(low, high), metric)
        return ranked(_where(self.df, where), distance, [*self.keys, *self.values]).select(*self.keys, *self.values, "dist").limit(max(n, 0))


@dataclass(frozen=True)
class ArrayTable:
    """Points of any number of dimensions in one array column."""

    df: DataFrame
    key: str
    values: tuple[str, ...] = ()

    def _at(self, key: Sequence) -> Column:
        return F.col(self.key) == F.array(*map(F.lit, key))

    def get(self, key: Sequence) -> DataFrame:
        return self.df.filter(self._at(key)).select(*self.values)

    def contains(self, key: Sequence) -> bool:
        return not self.df.filter(self._at(key)).isEmpty()

    def window(self, low: Sequence, high: Sequence, where: Filter = None) -> DataFrame:
        bounds = F.arrays_zip(F.col(self.key).alias("k"), F.array(*map(F.lit, low)).alias("a"), F.array(*map(F.lit, high)).alias("b"))
        return _where(self.df.filter(F.forall(bounds, lambda x: x["k"].between(x["a"], x["b"]))), where).select(self.key, *self.values)

    def within(self, center: Sequence, radius: float, decimals: int | None = None, where: Filter = None) -> DataFrame:
        near = _where(self.df, where).withColumn("dist", self._distance(center, decimals))
        return near.filter(F.col("dist") <= radius).select(self.key, *self.values, "dist")

    def nearest(self, n: int, center: Sequence, decimals: int | None = None, where: Filter = None) -> DataFrame:
        """The ``n`` nearest entries with ``dist``, ties by value and key."""
        rows = ranked(_where(self.df, where), self._distance(center, decimals), [*self.values, self.key])
        return rows.select(self.key, *self.values, "dist").limit(max(n, 0))

    def _distance(self, center: Sequence, decimals: int | None) -> Column:
        dist = array_l2(F.col(self.key), F.array(*[F.lit(float(c)) for c in center]))
        return F.round(dist, decimals) if decimals is not None else dist
