"""The trie of conversations by truncation peeling.

From the greatest depth down, conversations that end at a depth are merged with the nodes
that are left there, each node is counted, its last turn is stripped, and what agrees then is
one node of the depth above: nodes are found and their subtrees summed in one pass. Turns are
chained hashes, so that a node is told by its last one and stripped by cutting bytes off.

Below the depth at which a prefix of several sequences still has more turns under it than a
task should take, all that shares a prefix is peeled by one task, however deep it goes. The
few levels above are one aggregation each, combined before it is shuffled, so a first turn that a
third of all conversations share is no hot group; each level is written to the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.llm.common import map_batches, to_many, written

#: Bytes of a chained hash and of a number; ids to a run of text; turns that a task peels together, at least and at most.
HASH, WORD, RUN, LEAST, MOST = 16, 8, 50_000, 256, 1 << 16
NOTHING = hashlib.sha256(b"").hexdigest()


def turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (digest of role and text, words).

    A null turn comes first, turns of one number in the order of role and digest; null roles and
    texts are empty. Rows without a conversation are left out. Texts are not shuffled.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, HASH)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    placed = rows.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), digest.alias("digest"), words.alias("words")).alias("one"))
    listed = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("all"))
    return listed.select("conv_id", F.transform("all", lambda x: F.struct(x["digest"].alias("digest"), x["words"].alias("words"))).alias("turns"))


def _chains(lines: DataFrame) -> DataFrame:
    """(conv_id, length, chain, words, key): a hash of each prefix, one behind the other, and each turn's words."""

    def build():
        def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for all_turns in batch.column(1).to_pylist():
                last, chain, words = b"", [], []
                for one in all_turns:
                    last = hashlib.blake2b(last + one["digest"], digest_size=HASH).digest()
                    chain.append(last)
                    words.append(one["words"].to_bytes(WORD, "big"))
                out.append((len(chain), b"".join(chain), b"".join(words), last))
            columns = zip(*out, strict=True) if out else [[]] * 4
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["conv_id", "length", "chain", "words", "key"])

        return convert

    return map_batches(lines.select("conv_id", "turns"), build, "conv_id long, length int, chain binary, words binary, key binary")


def _ends(chains: DataFrame) -> DataFrame:
    """(key, n, ends): how many conversations are one sequence, and the hash of their ids in order.

    Ids are sorted over all tasks and joined to runs of text there; only runs, in order, meet in
    the task that hashes a sequence's, which keeps none of them.
    """
    parts = int(chains.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            out = []
            for key, same in groupby(rows, lambda r: r[0]):
                ids = [i for _, i in same]
                out += [(key, some[0], len(some), ",".join(map(str, some))) for at in range(0, len(ids), RUN) for some in [ids[at : at + RUN]]]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.string()))], ["key", "first", "n", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, state = None, 0, hashlib.sha256()
        for batch in batches:
            done = []
            for key, many, ids in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "ids")), strict=True):
                if key != last:
                    if n:
                        done.append((last, n, state.hexdigest()))
                    last, n, state = key, 0, hashlib.sha256()
                state.update((("," if n else "") + ids).encode())
                n += many
            yield _ended(done)
        yield _ended([(last, n, state.hexdigest())] if n else [])

    joined = chains.select("key", "conv_id").repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(runs, "key binary, first long, n long, ids string")
    return joined.repartition(parts, "key").sortWithinPartitions("key", "first").mapInArrow(hashed, "key binary, n long, ends string")


def _ended(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in enumerate((pa.binary(), pa.int64(), pa.string()))], ["key", "n", "ends"])


def _sequences(chains: DataFrame) -> DataFrame:
    """(conv_id, n, length, chain, words, ends): each distinct sequence once, with its smallest conversation."""
    first = chains.groupBy("key").agg(F.min(F.struct("conv_id", "length", "chain", "words")).alias("first"))
    return first.join(_ends(chains), "key").select("first.*", "n", "ends")


def _hash_at(depth: Column | int) -> Column:
    """The hash of the prefix of a depth; of depth 0, nothing."""
    return F.substring(F.col("chain"), max(0, depth - 1) * HASH + 1, HASH if depth else 0) if isinstance(depth, int) else F.col("chain").substr((depth - 1) * HASH + 1, F.lit(HASH))


def shared_depth(sequences: DataFrame, most: int) -> int:
    """The greatest depth at which a prefix of several sequences has more than ``most`` turns from there on; one number."""
    at = sequences.filter("length > 0").select(F.explode(F.sequence(F.lit(1), F.col("length"))).alias("depth"), "length", "chain")
    under = at.groupBy("depth", _hash_at(F.col("depth")).alias("key")).agg(F.count("*").alias("n"), F.sum(F.col("length") - F.col("depth") + 1).alias("turns"))
    return under.filter((F.col("n") > 1) & (F.col("turns") > most)).agg(F.max("depth")).first()[0] or 0


class Node:
    __slots__ = ("conv", "n", "children", "leaves", "saved", "ends", "chain", "words", "below")

    def __init__(self, conv: int, chain: bytes, words: bytes):
        self.conv, self.n, self.children, self.leaves, self.saved = conv, 0, 0, 0, 0
        self.ends, self.chain, self.words, self.below = NOTHING, chain, words, []

    def row(self, depth: int) -> tuple:
        return self.conv, depth, self.n, self.children, self.leaves, self.saved, self.ends


def peeled(sequences: list[dict], top: int) -> Iterator[tuple]:
    """The nodes from the greatest depth up to ``top``: (row, parent's conversation, chain, words), the last two at ``top`` alone, where the parent is not known."""
    ended: dict[int, list[dict]] = {}
    for s in sequences:
        ended.setdefault(s["length"], []).append(s)
    level: dict[bytes, Node] = {}
    for depth in range(max(ended), top - 1, -1):
        low = (depth - 1) * HASH
        for s in ended.get(depth, ()):
            node = level.setdefault(s["chain"][low : low + HASH], Node(s["conv_id"], s["chain"], s["words"]))
            node.conv, node.n, node.ends = min(node.conv, s["conv_id"]), node.n + s["n"], s["ends"]
        above: dict[bytes, Node] = {}
        for node in level.values():
            node.leaves = node.leaves or 1
            node.saved += (node.n - 1) * int.from_bytes(node.words[(depth - 1) * WORD : depth * WORD], "big")
            yield from ((row, node.conv, None, None) for row in node.below)
            if depth == top:
                yield node.row(depth), None, node.chain[: top * HASH], node.words[: top * WORD]
                continue
            key = node.chain[low - HASH : low]
            if key not in above:
                above[key] = Node(node.conv, node.chain, node.words)
            up = above[key]
            up.conv, up.n, up.children = min(up.conv, node.conv), up.n + node.n, up.children + 1
            up.leaves, up.saved = up.leaves + node.leaves, up.saved + node.saved
            up.below.append(node.row(depth))
        level = above


NODE = "conv_id long, depth int, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _deep(sequences: DataFrame, depth: int) -> DataFrame:
    """The nodes below ``depth``, peeled by the tasks that have all sequences of a prefix one turn longer."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.string()]
        columns = [pa.array([r[0][k] for r in rows], kind) for k, kind in enumerate(kinds)]
        columns += [pa.array([r[k] for r in rows], kind) for k, kind in ((1, pa.int64()), (2, pa.binary()), (3, pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "parent_conv_id", "chain", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in batch.to_pylist())
        held: list[tuple] = []
        for _, same in groupby(rows, lambda r: r["chain"][depth * HASH : (depth + 1) * HASH]):
            for node in peeled(list(same), depth + 1):
                held.append(node)
                if len(held) >= 10_000:
                    yield batch_of(held)
                    held = []
        yield batch_of(held)

    parts = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sequences.filter(F.col("length") > depth).withColumn("deal", _hash_at(depth + 1))
    dealt = dealt.repartition(parts, "deal").sortWithinPartitions("deal").select("conv_id", "n", "length", "chain", "words", "ends")
    return dealt.mapInArrow(run, f"{NODE}, parent_conv_id long, chain binary, words binary")


def _level(left: DataFrame, sequences: DataFrame, depth: int) -> DataFrame:
    """The nodes of a depth: the nodes below with their last turn stripped, and the sequences that end there."""
    stripped = left.select(
        "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends"),
        F.substring("chain", 1, depth * HASH).alias("chain"), F.substring("words", 1, depth * WORD).alias("words"),
    )
    none = F.lit(0).cast("long")
    ended = sequences.filter(F.col("length") == depth).select("conv_id", F.col("n").alias("n_convs"), none.alias("n_children"), none.alias("n_leaves"), none.alias("saved_tokens"), "ends", "chain", "words")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    joined = stripped.unionByName(ended).groupBy(_hash_at(depth).alias("key")).agg(F.min("conv_id").alias("conv_id"), *sums, F.max("ends").alias("ends"), F.first("chain").alias("chain"), F.first("words").alias("words"))
    last = F.conv(F.hex(F.substring("words", (depth - 1) * WORD + 1, WORD)), 16, 10).cast("long") if depth else F.lit(0)
    return written(
        joined.select(
            "conv_id", F.lit(depth).alias("depth"), "n_convs", "n_children", F.greatest("n_leaves", F.lit(1)).alias("n_leaves"),
            (F.col("saved_tokens") + (F.col("n_convs") - 1) * last).alias("saved_tokens"), F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"), "chain", "words",
        ),
        "level",
    )


def trie(lines: DataFrame, most: int | None = None) -> DataFrame:
    """One row for each distinct prefix of the conversations' turns, the empty one included.

    ``lines`` has each conv_id once, with its turns as ``turns`` gives them; they may be none. Rows: conv_id
    (the smallest member), depth, parent_conv_id (the parent's conv_id; null for the root), n_convs
    (members), n_children, n_leaves (nodes without children in its subtree), saved_tokens (summed over its
    subtree, (n_convs - 1) times the words of a node's last text) and ends_sha256 (of the ids that
    end there, in order, comma-joined). A node is told by its depth and conv_id. Without
    conversations there are no nodes. ``most`` is how many turns a task may peel together; it
    follows the number of turns and affects cost only. A single conversation is one row of a
    task, whatever its length: 24 bytes a turn.
    """
    spark = lines.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sequences = written(_sequences(written(_chains(lines), "chains")), "sequences")
    total = sequences.agg(F.sum("length")).first()[0] or 0
    depth = shared_depth(sequences, most or min(max(total // (2 * parts), LEAST), MOST))

    deep = written(_deep(sequences, depth), "deep")
    levels = [deep.filter(F.col("depth") == depth + 1).drop("parent_conv_id")]
    for k in range(depth, -1, -1):
        levels.append(_level(levels[-1], sequences, k))
    out = [c.split(" ")[0] for c in NODE.split(", ")]
    below = reduce(DataFrame.unionByName, levels[:-1])
    short = F.octet_length("chain") - HASH
    child = below.select(*out, F.when(short > 0, F.col("chain").substr(short - HASH + 1, F.lit(HASH))).otherwise(F.lit(b"")).alias("up"), F.col("chain").alias("own"))
    parents = reduce(DataFrame.unionByName, [x.select(F.col("conv_id").alias("parent_conv_id"), _hash_at(k).alias("up")) for k, x in zip(range(depth, -1, -1), levels[1:], strict=True)])
    nodes = to_many(child, parents, "up", "own", max(64, parts)).select(*out, "parent_conv_id")
    nodes = nodes.unionByName(deep.filter(F.col("depth") > depth + 1).select(*out, "parent_conv_id"))
    nodes = nodes.unionByName(levels[-1].select(*out, F.lit(None).cast("long").alias("parent_conv_id")))
    return nodes.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
