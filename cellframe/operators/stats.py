"""Structure of the prefix trie that a set of keys implies.

The trie splits all dimensions at one bit level at a time, and its shape depends on the
keys alone: in Z-order, two neighbours part at the level of their highest differing bit.
A node is a (level, common prefix) at which at least two keys part; the root, at the top
level, is always there. Nothing is built: keys are put in Z-order once, and each gap between
neighbours belongs to one node, so there are no more gaps than keys, at whatever level they lie.
A node reaches from the last gap of a higher level before its own gaps to the first one behind them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellframe.functions import bits
from cellframe.operators.order import places
from cellframe.operators.tables import conjunction
from cellframe.sources.shared import written

DEPTH = 64
#: Neighbours in Z-order that one task looks at together.
CHUNK = 1 << 16


def _words(keys: Sequence[Column], levels: Sequence[int]) -> list[Column]:
    """The bits of the keys on these levels as numbers whose order, one after the other, keeps all that share a prefix together."""
    each = max(1, 62 // len(keys))
    down = sorted(levels, reverse=True)
    out = []
    for at in range(0, len(down), each):
        word = F.lit(0).cast("long")
        for level in down[at : at + each]:
            word = F.shiftleft(word, len(keys)).bitwiseOR(bits.address(keys, level))
        out.append(word)
    return out


def neighbours(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[int], int, bool]:
    """(place, chunk, k0 ..., before, after) of each key in Z-order, the levels that vary, the number of keys, and whether they part at the top level.

    ``before`` and ``after`` are the levels at which a key parts from its neighbours, -1 from an
    equal one and null at the ends. A chunk is ``CHUNK`` places; its two neighbours are lent to it.
    """
    names = [f"k{i}" for i in range(len(keys))]
    whole = df.filter(conjunction([F.col(k).isNotNull() for k in keys])).select(*[F.col(k).cast("long").alias(n) for k, n in zip(keys, names, strict=True)])
    own = written(whole, "keys")
    levels, count, top = _varying(own, names)
    words = [f"w{i}" for i in range(len(_words([F.col(n) for n in names], levels)))]
    placed = places(own.withColumns(dict(zip(words, _words([F.col(n) for n in names], levels), strict=True))), words).drop(*words)
    home = F.floor((F.col("place") - 1) / CHUNK).cast("long")
    within = F.pmod("place", F.lit(CHUNK))
    lent = F.when(within == 0, F.array(home, home + 1)).when(within == 1, F.array(home, home - 1)).otherwise(F.array(home))
    dealt = placed.withColumn("home", home).withColumn("chunk", F.explode(lent))
    by = Window.partitionBy("chunk").orderBy("place")
    differing = lambda other: reduce(Column.bitwiseOR, [F.col(n).bitwiseXOR(other(n).over(by)) for n in names])
    seen = _by_chunk(dealt).withColumns({"before": differing(F.lag), "after": differing(F.lead)}).filter("home = chunk").drop("home")
    highest = lambda c: F.when(F.col(c) == 0, -1).otherwise(F.length(F.bin(c)) - 1)
    return seen.withColumns({c: highest(c) for c in ("before", "after")}), levels, count, top


def _by_chunk(frame: DataFrame) -> DataFrame:
    return frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chunk")


def trie_nodes(df: DataFrame, keys: Sequence[str], levels: Sequence[int] | None = None) -> DataFrame:
    """(level, p0 ..., children, entries, up) of each node; ``up`` is the level of its parent, null for the root.

    For every gap the nearest gaps of higher levels on both sides are looked up, by the last
    place of each level: within a chunk by windows, across chunks from a row of numbers a chunk.
    """
    seen, varying, count, top = neighbours(df, keys)
    gaps = written(seen.filter("before >= 0").drop("after"), "gaps")
    mark = lambda level: F.when(F.col("before") == level, F.shiftleft("place", 6).bitwiseOR(F.lit(level).cast("long")))
    order = {"last": (F.max, F.col("chunk"), F.col("place")), "next": (F.min, F.col("chunk").desc(), F.col("place").desc())}
    ends = gaps.groupBy("chunk").agg(*[f(mark(level)).alias(f"{side}{level}") for side, (f, _, _) in order.items() for level in varying])
    carried = ends.select("chunk", *[f(f"{side}{level}").over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)).alias(f"{side}{level}") for side, (f, by, _) in order.items() for level in varying])
    held = _by_chunk(gaps)
    for side, (f, _, by) in order.items():
        window = Window.partitionBy("chunk").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        held = held.withColumns({f"own_{side}{level}": f(mark(level)).over(window) for level in varying})
    both = held.join(carried, "chunk")
    above = F.array_position(F.array(*map(F.lit, varying)), F.col("before")).cast("int") + 1

    def nearest(side: str, pick) -> Column:
        return pick(F.slice(F.array(*[F.coalesce(f"own_{side}{level}", f"{side}{level}") for level in varying]), above, len(varying)))

    found = both.select(F.col("before").alias("level"), *[F.col(f"k{i}") for i in range(len(keys))], nearest("last", F.array_max).alias("last"), nearest("next", F.array_min).alias("next"))
    start, end = F.coalesce(F.shiftright("last", 6), F.lit(1).cast("long")), F.coalesce(F.shiftright("next", 6), F.lit(count + 1).cast("long"))
    up = F.least(F.coalesce(F.col("last").bitwiseAND(F.lit(63).cast("long")), F.lit(DEPTH - 1)), F.coalesce(F.col("next").bitwiseAND(F.lit(63).cast("long")), F.lit(DEPTH - 1))).cast("int")
    # a node's gaps lie between the same two gaps of higher levels
    by_node = found.groupBy("level", start.alias("start"), end.alias("end"), up.alias("up")).agg((F.count("*") + 1).alias("children"), *[F.min(f"k{i}").alias(f"k{i}") for i in range(len(keys))])
    prefix = [F.when(F.col("level") < DEPTH - 1, F.expr(f"shiftrightunsigned(k{i}, level + 1)")).otherwise(F.lit(0).cast("long")).alias(f"p{i}") for i in range(len(keys))]
    nodes = by_node.select("level", *prefix, "children", (F.col("end") - F.col("start")).alias("entries"), F.when(F.col("level") < DEPTH - 1, F.col("up")).alias("up"))
    if count and not top:
        root = df.sparkSession.createDataFrame([(DEPTH - 1, *[0] * len(keys), 1, count, None)], nodes.schema)
        nodes = nodes.unionByName(root)
    return nodes if levels is None else nodes.filter(F.col("level").isin(list(levels)))


def split_levels(df: DataFrame, keys: Sequence[str], levels: Sequence[int] | None = None) -> DataFrame:
    """(level, p0 ..., children, entries) of each node: prefixes above a level with more than one child."""
    return trie_nodes(df, keys, levels).drop("up")


def _varying(df: DataFrame, keys: Sequence[str]) -> tuple[list[int], int, bool]:
    """The bit levels at which some dimension's keys differ and the top one, the number of rows, and whether they differ at the top."""
    got = df.agg(*[F.bit_or(F.col(k).cast("long")) for k in keys], *[F.bit_and(F.col(k).cast("long")) for k in keys], F.count("*")).first()
    changing = 0
    for any_set, all_set in zip(got[: len(keys)], got[len(keys) : -1], strict=True):
        changing |= (any_set or 0) & ~(all_set or 0)
    return [level for level in range(DEPTH) if changing >> level & 1 or level == DEPTH - 1], got[-1], bool(changing >> (DEPTH - 1) & 1)


def varying_levels(df: DataFrame, keys: Sequence[str]) -> list[int]:
    """The bit levels at which some dimension's keys differ, by one pass; the top level always is one."""
    return _varying(df, keys)[0]


def tree_stats(df: DataFrame, keys: Sequence[str], levels: Sequence[int] | None = None) -> DataFrame:
    """(level, n_nodes, n_children, max_children): the trie's nodes on each bit level that has any.

    Nodes of levels that are not among ``levels`` are left out, if any are given.
    """
    nodes = split_levels(df, keys, levels)
    return nodes.groupBy("level").agg(F.count("*").alias("n_nodes"), F.sum("children").alias("n_children"), F.max("children").alias("max_children"))


def tree_dump(df: DataFrame, keys: Sequence[str], levels: Sequence[int] | None = None) -> DataFrame:
    """(line): the trie as text, a line for each node: bit level, binary prefix of each key, children, entries."""
    nodes = split_levels(df, keys, levels)
    depth = F.lit(DEPTH - 1) - F.col("level")
    prefix = F.concat_ws(",", *[F.substring(bits.binary_text(F.col(f"p{i}")), F.lit(DEPTH + 1) - depth, depth) for i in range(len(keys))])
    return nodes.select(F.concat_ws(" ", F.col("level"), prefix, F.concat(F.lit("children="), "children"), F.concat(F.lit("entries="), "entries")).alias("line"))


def node_sizes(df: DataFrame, keys: Sequence[str], levels: Sequence[int] | None = None) -> DataFrame:
    """(size_log, n_nodes): nodes by the number of binary digits of their number of children."""
    nodes = split_levels(df, keys, levels)
    return nodes.groupBy(F.length(F.bin("children")).alias("size_log")).agg(F.count("*").alias("n_nodes"))


def nodes_below(df: DataFrame, keys: Sequence[str], levels: Sequence[int] | None = None) -> DataFrame:
    """(level, infix_len) of each node: the number of bit levels between it and its parent; 0 for the root."""
    return trie_nodes(df, keys, levels).select("level", F.coalesce(F.col("up") - F.col("level") - 1, F.lit(0)).alias("infix_len"))


def infix_lengths(df: DataFrame, keys: Sequence[str], levels: Sequence[int] | None = None) -> DataFrame:
    """(infix_len, n_nodes): nodes by the length of their infix."""
    return nodes_below(df, keys, levels).groupBy("infix_len").agg(F.count("*").alias("n_nodes"))


def node_depths(df: DataFrame, keys: Sequence[str], levels: Sequence[int] | None = None) -> DataFrame:
    """(depth, n_nodes): nodes by the number of bit levels above their infix; 0 for the root."""
    depth = F.lit(DEPTH - 1) - F.col("level") - F.col("infix_len")
    return nodes_below(df, keys, levels).groupBy(depth.alias("depth")).agg(F.count("*").alias("n_nodes"))


def entry_depths(df: DataFrame, keys: Sequence[str], levels: Sequence[int] | None = None) -> DataFrame:
    """(level, n_entries): how many keys hang on a node of each level, that is, first stand alone below it.

    That is the lower one of the levels at which a key parts from its neighbours; equal keys never stand alone.
    """
    seen = neighbours(df, keys)[0]
    at = F.least(F.coalesce("before", F.lit(DEPTH - 1)), F.coalesce("after", F.lit(DEPTH - 1)))
    found = seen.select(at.alias("level")).filter("level >= 0").groupBy("level").agg(F.count("*").alias("n_entries"))
    return found if levels is None else found.filter(F.col("level").isin(list(levels)))


def average_depth(depths: DataFrame) -> DataFrame:
    """(avg_post_len, avg_depth): mean bits below the node of an entry, and above."""
    total = F.sum("n_entries")
    return depths.agg((F.sum(F.col("level") * F.col("n_entries")) / total).alias("avg_post_len"), (F.lit(DEPTH) - F.sum(F.col("level") * F.col("n_entries")) / total).alias("avg_depth"))


def dimension_ranges(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.agg(*[F.min(k).alias(f"min_{k}") for k in keys], *[F.max(k).alias(f"max_{k}") for k in keys])


def order_by_z(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """All rows in Z-order, by a range-partitioned sort."""
    return df.orderBy(bits.signed_path(keys))
