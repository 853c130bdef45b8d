"""Hard negatives by slots: one pass over all rows answers every positive's window of an anchor.

A negative of a positive scores at most a part (``high`` percent) of the positive's score and
at least another (``low`` percent). The upper limits of an anchor's positives cut its scores
into disjoint slots. Each task keeps the best few rows of each slot, whatever it has read;
merged from the lowest slot upwards, slots give the best rows below every upper limit, and a
lower limit only takes rows from the end of those.

Rows and anchors are packed into blocks of numbers. Every block of rows meets every block of
anchors by a merge join on a salt, which rows have one of and anchors are copied for, so no side
passes the driver, and scores are matrix products of whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellframe.llm.common import written

#: Rows and anchors to a block, scores held at a time, and blocks of anchors to a round.
BLOCK, CELLS, ROUND = 4096, 1 << 21, 16
LEAST, MOST = -(2**63) + 1, 2**63 - 1


def taking_part(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, vector): rows with an id, a label, and a vector of finite numbers alone."""
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    named = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vector.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return named.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """The vectors as rows, shorter ones filled up with zeros."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    width, flat = int(sizes.max(initial=0)), vectors.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _packed(matrix: np.ndarray) -> tuple[bytes, str]:
    kind = "<i2" if np.abs(matrix).max(initial=0) < 1 << 15 else "<f8"
    return matrix.astype(kind).tobytes(), kind


def _unpacked(data: bytes, kind: str, rows: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(rows, -1).astype("f8") if rows else np.zeros((0, 0))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole numbers, exact; ``LEAST`` and ``MOST`` beyond 64 bits."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if width * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(a) @ whole(b).T
    return np.vectorize(lambda x: min(max(x, LEAST), MOST), otypes=[np.int64])(exact)


class Top:
    """The ``k`` best (score, id) of each of many groups: higher scores first, smaller ids among equals."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.scores = np.full((groups, k), LEAST - 1, np.int64)
        self.ids = np.full((groups, k), MOST, np.int64)

    def offer(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        worst, behind = self.scores[group, -1], self.ids[group, -1]
        keep = (score > worst) | ((score == worst) & (ids < behind))
        group, score, ids = group[keep], score[keep], ids[keep]
        if not len(group):
            return
        touched = np.unique(group)
        group = np.concatenate([group, np.repeat(touched, self.k)])
        score = np.concatenate([score, self.scores[touched].ravel()])
        ids = np.concatenate([ids, self.ids[touched].ravel()])
        order = np.lexsort((ids, ~score, group))  # ~ turns the order of whole numbers round
        group, score, ids = group[order], score[order], ids[order]
        rank = np.arange(len(group)) - np.searchsorted(group, group)
        best = rank < self.k
        self.scores[group[best], rank[best]] = score[best]
        self.ids[group[best], rank[best]] = ids[best]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, score, id) of all that is held."""
        group, at = np.nonzero(self.scores >= LEAST)
        return group, self.scores[group, at], self.ids[group, at]


class Block:
    """A block of anchors or rows; ``windows`` are an anchor's (lower, upper) limits of each slot."""

    def __init__(self, row: dict):
        self.ids, self.labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
        self.matrix = _unpacked(row["vectors"], row["kind"], len(self.ids))
        self.keys = np.frombuffer(row["keys"], "<i8") if row.get("keys") else None
        self.windows = np.frombuffer(row["windows"], "<i8").reshape(len(self.ids), -1, 2) if row.get("windows") else None


def parts(anchors: int, rows: int, first: bool) -> Iterator[tuple[slice, slice]]:
    """Ranges of anchors and rows with ``CELLS`` pairs at most; the first rows come few at a time, while nothing is held against which to drop them."""
    bounds = [0, *(b for b in (64, 512) if first and b < rows), rows]
    for low, high in zip(bounds, bounds[1:], strict=False):
        step = max(1, CELLS // max(high - low, 1))
        for a in range(0, anchors, step):
            yield slice(a, min(a + step, anchors)), slice(low, high)


def keep_positives(top: Top, anchors: Block, rows: Block, first: bool) -> None:
    """The best other rows of an anchor's label."""
    for label in np.intersect1d(anchors.labels, rows.labels):
        mine, theirs = np.flatnonzero(anchors.labels == label), np.flatnonzero(rows.labels == label)
        for some, those in parts(len(mine), len(theirs), first):
            at, to = mine[some], theirs[those]
            scores = products(anchors.matrix[at], rows.matrix[to])
            i, j = np.nonzero(scores >= top.scores[at, -1][:, None])
            other = anchors.ids[at[i]] != rows.ids[to[j]]
            i, j = i[other], j[other]
            top.offer(at[i], scores[i, j], rows.ids[to[j]])


def keep_negatives(top: Top, anchors: Block, rows: Block, first: bool) -> None:
    """The best rows of another label in each slot of an anchor; ``top`` has a group for each anchor and slot."""
    slots = anchors.windows.shape[1]
    for some, those in parts(len(anchors.ids), len(rows.ids), first):
        scores = products(anchors.matrix[some], rows.matrix[those])
        for slot in range(slots):
            low, high = anchors.windows[some, slot, 0], anchors.windows[some, slot, 1]
            group = np.arange(some.start, some.stop) * slots + slot
            i, j = np.nonzero((scores <= high[:, None]) & (scores >= np.maximum(low, top.scores[group, -1])[:, None]))
            other = anchors.labels[some][i] != rows.labels[those][j]
            i, j = i[other], j[other]
            top.offer(group[i], scores[i, j], rows.ids[those][j])


def limits(score: int, low: int, high: int) -> tuple[int, int] | None:
    """The least and the greatest score between ``low`` and ``high`` percent of a positive's; None if there is none."""
    least, most = -(-score * low // 100), score * high // 100
    return (least, most) if least <= most else None


def slots_of(scores: Sequence[int], low: int, high: int) -> list[tuple[int, int]]:
    """Disjoint (lower, upper) ranges, the highest first, that the positives' upper limits cut their windows into."""
    windows = [w for s in scores if (w := limits(s, low, high))]
    uppers = sorted({u for _, u in windows}, reverse=True)
    lowest = {u: min(least for least, most in windows if most == u) for u in uppers}
    return [(max(lowest[u], below + 1), u) for u, below in zip(uppers, [*uppers[1:], LEAST - 1], strict=False)]


ROWS = "number long, ids binary, labels binary, vectors binary, kind string"


def row_blocks(rows: DataFrame) -> DataFrame:
    """(number, ids, labels, vectors, kind): all rows in blocks, as tasks read them; written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                vectors, kind = _packed(_matrix(some.column(2)))
                ids, labels = (some.column(k).to_numpy(zero_copy_only=False).astype("<i8").tobytes() for k in (0, 1))
                yield pa.RecordBatch.from_pydict({"number": [number], "ids": [ids], "labels": [labels], "vectors": [vectors], "kind": [kind]})
                number += 1

    return written(rows.select("id", "label", "vector").mapInArrow(run, ROWS), "rows")


def anchor_blocks(anchors: DataFrame, blocks: int, low: int, high: int) -> DataFrame:
    """(block, keys, ids, labels, vectors, kind, windows): about ``BLOCK`` anchors each; windows are empty without ``positives``."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        column = lambda c: group[c].to_numpy().astype("<i8").tobytes()
        vectors, kind = _packed(_matrix(group["vector"].combine_chunks()))
        windows = b""
        if "positives" in group.column_names:
            slots = [slots_of(scores, low, high) for scores in group["positives"].to_pylist()]
            most = max(1, *map(len, slots))
            windows = np.array([s + [(0, -1)] * (most - len(s)) for s in slots], "<i8").tobytes()
        return pa.table({"block": group["block"][:1], "keys": [column("key")], "ids": [column("id")], "labels": [column("label")], "vectors": [vectors], "kind": [kind], "windows": [windows]})

    dealt = anchors.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInArrow(run, "block int, keys binary, ids binary, labels binary, vectors binary, kind string, windows binary")


def meet(rows: DataFrame, anchors: DataFrame, blocks: int, salts: int, keep: Callable[[Top, Block, Block, bool], None], k: int) -> DataFrame:
    """(key, slot, score, id): the ``k`` best that each task found for each anchor and slot, in rounds of ``ROUND`` blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[Block, Top, int]] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                first = row["block"] not in held
                if first:
                    block = Block({c.removeprefix("a_"): row[c] for c in row if c.startswith("a_")})
                    slots = block.windows.shape[1] if block.windows is not None else 1
                    held[row["block"]] = block, Top(len(block.ids) * slots, k), slots
                block, top, _ = held[row["block"]]
                keep(top, block, Block(row), first)
        for block, top, slots in held.values():
            group, score, ids = top.rows()
            yield pa.RecordBatch.from_arrays([pa.array(block.keys[group // slots]), pa.array((group % slots).astype(np.int32)), pa.array(score), pa.array(ids)], ["key", "slot", "score", "id"])

    names = ("keys", "ids", "labels", "vectors", "kind", "windows")
    anchors = written(anchors, "anchors")
    out = []
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("number"), F.lit(salts)).cast("int"))
    for low in range(0, blocks, ROUND):
        copies = anchors.select("block", *[F.col(c).alias(f"a_{c}") for c in names]).filter(F.col("block").between(low, low + ROUND - 1))
        copies = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        # the copies are many times what Spark takes them for: a join that broadcasts would bring them all to the driver
        met = dealt.join(copies.hint("merge"), "salt").select("block", "ids", "labels", "vectors", "kind", *[f"a_{c}" for c in names])
        out.append(written(met.mapInArrow(run, "key long, slot int, score long, id long"), "best"))
    return reduce(DataFrame.unionByName, out)


def best(found: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """The ``k`` best of each group, with ``place`` from 1; a group has ``k`` rows for each task at most."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors, rows for which ``anchors`` holds.

    Scores are inner products; vectors must hold whole numbers. Higher scores come first, equal
    ones by the smaller id. An anchor's positives are its ``positives`` best rows of the same
    label, its negatives for each of them the ``negatives`` best rows of another label that
    score ``low`` to ``high`` percent of the positive's. Rows with a null id, label, vector or
    component, or a component that is not finite, take no part. Shorter vectors count as filled
    up with zeros. Rows that repeat are rows of their own, but an anchor is never its own
    positive, nor is a row with its id. Scores beyond 64 bits count as the farthest number. An
    empty table gives no rows; columns of other names are left out.
    """
    if positives < 1 or negatives < 1 or not 0 <= low <= high:
        raise ValueError("at least one positive and negative, and percents in order, are needed")
    spark = rows.sparkSession
    chosen = rows.filter(anchors)
    own = written(taking_part(chosen, id_col, vector_col, label_col).withColumn("key", F.monotonically_increasing_id()), "own")
    packed = row_blocks(taking_part(rows, id_col, vector_col, label_col))
    blocks = -(-own.count() // BLOCK) or 1
    salts = max(1, min(packed.count(), 2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // min(blocks, ROUND)))

    near = best(meet(packed, anchor_blocks(own, blocks, low, high), blocks, salts, keep_positives, positives), ["key"], positives)
    near = written(near.select("key", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    listed = near.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("listed"))
    sized = own.join(listed.select("key", F.col("listed.positive_score").alias("positives")), "key")
    far = best(meet(packed, anchor_blocks(sized, blocks, low, high), blocks, salts, keep_negatives, negatives), ["key", "slot"], negatives)
    kept = far.groupBy("key").agg(F.collect_list(F.struct("slot", "score", "id")).alias("kept"))
    return merged(own.select("key", F.col("id").alias("anchor_id")).join(listed, "key").join(kept, "key"), negatives, low, high)


def merged(anchors: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """The answers of each anchor from its slots: a row has a few positives and ``k`` rows a slot."""

    def answers(listed: list[dict], kept: list[dict]) -> Iterator[tuple[dict, int, int, int]]:
        slots = slots_of([p["positive_score"] for p in listed], low, high)
        below, best_below = [], {}
        for slot in range(len(slots) - 1, -1, -1):
            below = sorted(below + [(-x["score"], x["id"]) for x in kept if x["slot"] == slot])[:k]
            best_below[slots[slot][1]] = below
        for p in listed:
            if window := limits(p["positive_score"], low, high):
                for rank, (score, row) in enumerate([x for x in best_below[window[1]] if -x[0] >= window[0]], 1):
                    yield p, rank, row, -score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(r["anchor_id"], p["positive_id"], rank, row, p["positive_score"], score) for r in batch.to_pylist() for p, rank, row, score in answers(r["listed"], r["kept"])]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names)

    return anchors.select("anchor_id", "listed", "kept").mapInArrow(run, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
