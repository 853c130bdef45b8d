"""Array keys of any width by their distances to a few pivots.

The distances of a key to ``k`` pivots are ``k`` plain columns. By the triangle inequality two keys
are at least as far apart as any two of those distances, so a ball is a window on these columns: it
is pushed to the scan, and only what it lets through needs the arrays.

Where keys have many dimensions all distances are much the same, and no bound rules out a single pair.
So joins of two array tables meet block by block: a task has a share of the rows and one of the queries,
in blocks ordered by the first pivot, passes over blocks that the pivots rule out, takes the distances
of the others as matrix products and those near the best again exactly. What is moved is a copy of the rows for
each ``SHARE`` queries and one of the queries for each share of the rows; pairs are never rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellframe.functions.metrics import array_l2
from cellframe.functions.names import free
from cellframe.operators.order import places
from cellframe.operators.tables import conjunction
from cellframe.plans.skew import facts_of, row_hash
from cellframe.sources.shared import written

#: Rows from which pivots are chosen, and what rounding may take from a bound, in shares of the distances.
SAMPLE, SLACK = 512, 1e-9
#: Rows of a block, rows (or queries) of a task at most, pairs worth a task of their own, and pairs told exactly at a time.
BLOCK, SHARE, PAIRS, EXACT = 1024, 1 << 14, 1 << 26, 1 << 18
PACKED = "share int, ids binary, keys binary, kind string, lows array<double>, highs array<double>"


def choose_pivots(df: DataFrame, key: str, k: int) -> list[list[float]]:
    """``k`` keys far from each other, from ``SAMPLE`` rows picked by a hash; they affect cost only."""
    rows = [r[0] for r in df.filter(_whole(key)).select(key).orderBy(F.xxhash64(key), key).limit(SAMPLE).collect()]
    if not rows:
        return []
    width = max(map(len, rows))
    points = np.array([[*r, *[0.0] * (width - len(r))] for r in rows], float)
    far = np.linalg.norm(points - points.mean(axis=0), axis=1)
    chosen: list[int] = []
    while len(chosen) < min(k, len(points)):
        chosen.append(int(far.argmax()))
        gaps = np.linalg.norm(points - points[chosen[-1]], axis=1)
        far = gaps if len(chosen) == 1 else np.minimum(far, gaps)
    return [list(map(float, rows[i])) for i in chosen]


def _whole(key: str | Column) -> Column:
    """An array without nulls and NaNs."""
    column = F.col(key) if isinstance(key, str) else key
    return column.isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")))


def _distance(a: Column, b: Column, decimals: int | None) -> Column:
    dist = array_l2(a, b)
    return F.round(dist, decimals) if decimals is not None else dist


@dataclass(frozen=True)
class PivotTable:
    """Rows with an array key of one width, and the columns of its distances to the pivots.

    Keys with a null or NaN have no distances and are near nothing.
    """

    df: DataFrame
    key: str
    values: tuple[str, ...]
    pivots: tuple[tuple[float, ...], ...]
    columns: tuple[str, ...]

    @classmethod
    def of(cls, df: DataFrame, key: str, values: Sequence[str], k: int = 8, path: str | None = None) -> PivotTable:
        """The table with its pivot columns, written to ``path`` in the order of the first of them, or to the shared folder."""
        pivots = choose_pivots(df, key, k)
        names = free(df, *[f"pivot{i}" for i in range(len(pivots))])
        table = cls(df, key, tuple(values), tuple(map(tuple, pivots)), tuple(names))
        rows = table.placed(df.select(key, *values), names, key)
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        tidy = rows.repartitionByRange(parts, names[0], row_hash(rows)).sortWithinPartitions(names[0]) if names else rows
        if path is None:
            return cls(written(tidy, "pivots"), key, tuple(values), table.pivots, table.columns)
        tidy.write.parquet(path)
        return cls(df.sparkSession.read.schema(tidy.schema).parquet(path), key, tuple(values), table.pivots, table.columns)

    def placed(self, frame: DataFrame, names: Sequence[str], key: str) -> DataFrame:
        """The rows that have whole keys, with the distances to the pivots under these names."""
        return frame.filter(_whole(key)).withColumns({n: array_l2(F.col(key), F.array(*map(F.lit, p))) for n, p in zip(names, self.pivots, strict=True)})

    def _gaps(self, center: Sequence[float]) -> list[float]:
        point = np.array(center, float)
        return [float(np.linalg.norm(point - np.array(p))) for p in self.pivots]

    def reach(self, center: Sequence[float], radius: float) -> Column:
        """What the pivot columns of a key within the radius must be."""
        bounds = [(g - radius - SLACK * (g + abs(radius)), g + radius + SLACK * (g + abs(radius))) for g in self._gaps(center)]
        return conjunction([F.col(c).between(a, b) for c, (a, b) in zip(self.columns, bounds, strict=True)])

    def within(self, center: Sequence[float], radius: float, decimals: int | None = None) -> DataFrame:
        """Entries at most ``radius`` away, with ``dist``; rows that a pivot rules out are dropped by the scan."""
        wide = radius + (10.0**-decimals if decimals is not None else 0.0)
        near = self.df.filter(self.reach(center, wide)).withColumn("dist", _distance(F.col(self.key), F.array(*map(F.lit, map(float, center))), decimals))
        return near.filter(F.col("dist") <= radius).select(self.key, *self.values, "dist")

    def nearest(self, n: int, center: Sequence[float], decimals: int | None = None) -> DataFrame:
        """The ``n`` nearest entries with ``dist``, ties by value and key.

        The ``n`` rows with the least lower bounds give a radius that is sure; the bounds are told
        from the pivot columns alone.
        """
        order = ["dist", *self.values, self.key]
        point = F.array(*map(F.lit, map(float, center)))
        if n <= 0 or not self.pivots:
            return self.df.withColumn("dist", _distance(F.col(self.key), point, decimals)).select(self.key, *self.values, "dist").orderBy(*order).limit(max(n, 0))
        low = F.greatest(*[F.abs(F.col(c) - g) for c, g in zip(self.columns, self._gaps(center), strict=True)]) if len(self.columns) > 1 else F.abs(F.col(self.columns[0]) - self._gaps(center)[0])
        first = self.df.select(self.key, low.alias("low")).orderBy("low").limit(n)
        radius = first.select(F.max(array_l2(F.col(self.key), point))).first()[0]
        if radius is None:
            return self.within(center, 0.0, decimals).limit(0)
        return self.within(center, radius if decimals is None else round(radius, decimals) + 10.0**-decimals, decimals).orderBy(*order).limit(n)

    def nearest_join(self, queries: DataFrame, query_key: str, query_id: str, n: int, decimals: int | None = None) -> DataFrame:
        """The ``n`` nearest entries of each query, with ``dist`` and ``rank``; ties by value.

        Every query meets every row but those in blocks that the pivots rule out. Of equal keys the first
        ``n`` stand for all. Rows are told by their place in the order of values, so ties are decided where they
        meet. ``query_id`` must be unique.
        """
        spark = self.df.sparkSession
        place, row, dist = free([self.df, queries], "_place", "_row", "dist")
        near = conjunction([F.col(c).isNotNull() for c in self.columns])
        held = places(first_of_keys(self.df.filter(near), self.key, self.values, n), self.values, place)
        centers = free(queries, *[f"_q{i}" for i in range(len(self.pivots))])
        asked = written(self.placed(queries.select(query_id, query_key), centers, query_key).filter(conjunction([F.col(c).isNotNull() for c in centers])).withColumn(row, F.monotonically_increasing_id()), "asked")
        many, few = held.count(), asked.count()
        if not (n > 0 and self.pivots and many and few):
            return asked.limit(0).crossJoin(held.limit(0)).select(query_id, self.key, *self.values, F.lit(0.0).alias("dist"), F.lit(0).alias("rank"))
        groups, parts = -(-few // SHARE), int(spark.conf.get("spark.sql.shuffle.partitions"))
        shares = max(-(-many // SHARE), -(-min(parts, many * few // PAIRS) // groups), 1)
        rows = packed(held, place, self.key, self.columns, shares).withColumnRenamed("share", "s").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        sought = packed(asked, row, query_key, centers, groups).withColumnRenamed("share", "g").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        tasks = max(parts, groups * shares)
        sides = [side.repartition(tasks, "g", "s").groupBy("g", "s") for side in (sought, rows)]
        met = sides[0].cogroup(sides[1]).applyInArrow(lambda a, b: nearest_of_blocks(a, b, n, decimals, (row, place, dist)), f"`{row}` long, `{place}` long, `{dist}` double")
        if decimals is not None:
            met = met.withColumn(dist, F.round(dist, decimals))
        order = Window.partitionBy(row).orderBy(dist, place)
        best = written(met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n), "nearest")
        told = facts_of(best, held.select(place, self.key, *self.values), [place]).join(asked.select(row, query_id), row)
        return told.select(query_id, self.key, *self.values, F.col(dist).alias("dist"), "rank")


def first_of_keys(rows: DataFrame, key: str, tie: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of each array key: no search can need more. Every task keeps ``n`` of a key before anything is shuffled."""
    (number,) = free(rows, "_number")
    at = Window.partitionBy(key).orderBy(*tie)
    return rows.withColumn(number, F.row_number().over(at)).filter(F.col(number) <= max(n, 0)).drop(number)


# --- blocks of keys, and what a task does with them ---


def packed(frame: DataFrame, number: str, key: str, columns: Sequence[str], shares: int) -> DataFrame:
    """The rows in ``shares`` ranges of the first pivot column, as blocks of keys with the bounds of their pivot columns; written."""
    ranged = frame.select(F.col(number).alias("id"), F.col(key).cast("array<double>").alias("key"), F.array(*columns).alias("at"), F.col(columns[0]).alias("first"))
    ranged = ranged.repartitionByRange(shares, "first", F.xxhash64("id")).sortWithinPartitions("first", "id").drop("first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, schema = TaskContext.get().partitionId(), pa.schema([("share", pa.int32()), ("ids", pa.binary()), ("keys", pa.binary()), ("kind", pa.string()), ("lows", pa.list_(pa.float64())), ("highs", pa.list_(pa.float64()))])
        left: list[pa.RecordBatch] = []
        for batch in _with_end(batches):
            left += [batch] if batch is not None else []
            while (have := sum(b.num_rows for b in left)) >= BLOCK or (batch is None and have):
                table = pa.Table.from_batches(left)
                some, left = table.slice(0, BLOCK), table.slice(BLOCK).to_batches()
                keys, at = (_matrix(some[c].combine_chunks(), some.num_rows) for c in ("key", "at"))
                with np.errstate(over="ignore"):
                    small = keys.astype("<f4")
                kind = "<f4" if np.array_equal(small, keys, equal_nan=True) else "<f8"
                ids = some["id"].to_numpy().astype("<i8")
                yield pa.RecordBatch.from_pylist([{"share": share, "ids": ids.tobytes(), "keys": keys.astype(kind).tobytes(), "kind": kind, "lows": at.min(axis=0).tolist(), "highs": at.max(axis=0).tolist()}], schema)

    return written(ranged.mapInArrow(run, PACKED), "blocks")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _matrix(lists: pa.ListArray, rows: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


class Block:
    """Keys, their numbers and the bounds of their pivot columns."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.keys = np.frombuffer(row["keys"], row["kind"]).astype("f8").reshape(len(self.ids), -1)
        self.lows, self.highs = np.array(row["lows"], "f8"), np.array(row["highs"], "f8")
        with np.errstate(all="ignore"):
            self.squares = (self.keys * self.keys).sum(axis=1)

    def gap(self, other: Block) -> float:
        """What any two keys of the blocks are apart at least."""
        with np.errstate(all="ignore"):
            gaps = np.maximum(self.lows - other.highs, other.lows - self.highs)
            slack = SLACK * np.maximum(np.abs(self.highs), np.abs(other.highs))
        return float(np.nan_to_num(gaps - slack, nan=0.0, posinf=0.0, neginf=0.0).max(initial=0.0))


def exact_distances(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The distances of the pairs (i, j), summed from the left as ``array_l2`` does, to the same bits."""
    out = np.empty(len(i))
    for at in range(0, len(i), EXACT):
        some = slice(at, at + EXACT)
        total = np.zeros(len(i[some]))
        for c in range(a.shape[1]):
            gap = b[j[some], c] - a[i[some], c]
            total += gap * gap
        out[some] = np.sqrt(total)
    return out


def _trimmed(i: np.ndarray, ids: np.ndarray, x: np.ndarray, limit: np.ndarray, n: int, decimals: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What can be among the first ``n`` of a query by rounded distance and id; sets the queries' limits.

    Distances that are sure to be rounded alike (those between two half steps) are one group, of which the first ``n`` ids do.
    """
    group = x
    if decimals is not None:
        halves = x * (2 * 10.0**decimals)
        group = np.where((halves < 2.0**40) & (np.abs(halves - np.rint(halves)) > 1e-3), -1 - np.floor(halves), x)
    order = np.lexsort((ids, group, i))
    i, ids, x, group = i[order], ids[order], x[order], group[order]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | ~((group[1:] == group[:-1]) | (np.isnan(group[1:]) & np.isnan(group[:-1])))
    starts = np.flatnonzero(new)
    keep = np.arange(len(i)) - starts[np.cumsum(new) - 1] < n
    i, ids, x = i[keep], ids[keep], x[keep]
    order = np.lexsort((x, i))
    rank = np.arange(len(i)) - np.searchsorted(i, i)  # i is in order, and so it is by distance
    last = order[rank == n - 1]
    limit[i[last]] = x[last]
    keep = ~(x > reach(limit[i], decimals))
    return i[keep], ids[keep], x[keep]


def reach(limit: np.ndarray, decimals: int | None) -> np.ndarray:
    """Beyond this, a distance is also rounded to more than the limit."""
    return limit * (1 + 1e-12) + (1.001 * 10.0**-decimals if decimals is not None else 0.0)


def nearest_of_blocks(queries: pa.Table, rows: pa.Table, n: int, decimals: int | None, names: Sequence[str]) -> pa.Table:
    """(query, row, distance) under these names: what of these rows can be among the ``n`` nearest of these queries, and little besides."""
    blocks, out = [Block(r) for r in rows.to_pylist()], []
    for asked in map(Block, queries.to_pylist()):
        limit = np.full(len(asked.ids), np.inf)
        held = np.zeros(0, int), np.zeros(0, "i8"), np.zeros(0)
        left = np.column_stack([-2 * asked.keys, asked.squares, np.ones(len(asked.ids))])
        for gap, at in sorted((asked.gap(b), k) for k, b in enumerate(blocks)):
            block = blocks[at]
            if gap > reach(limit, decimals).max():
                break
            with np.errstate(all="ignore"):
                near = left @ np.column_stack([block.keys, np.ones(len(block.ids)), block.squares]).T
                # what the products may be wrong by
                error = (asked.keys.shape[1] + 16) * 2.0**-51 * (np.sqrt(asked.squares) + np.sqrt(block.squares.max())) ** 2
                most = reach(limit, decimals) ** 2 * (1 + 1e-12) + error
                if n <= len(block.ids) and not np.isfinite(limit).all():
                    first = np.partition(near, n - 1, axis=1)[:, n - 1]
                    most = np.minimum(most, reach(np.sqrt(np.maximum(first + error, 0)), decimals) ** 2 * (1 + 1e-12) + error)
                i, j = np.nonzero(~(near > most[:, None]))
                if len(i):
                    x = exact_distances(asked.keys, block.keys, i, j)
                    held = _trimmed(*(np.concatenate(both) for both in zip(held, (i, block.ids[j], x), strict=True)), limit, n, decimals)
        out.append((asked.ids[held[0]], held[1], held[2]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0)]
    return pa.table(dict(zip(names, columns, strict=True)))
