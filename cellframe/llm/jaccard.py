"""Exact n-gram Jaccard join by a size-aware heavy-light plan.

Two texts link when the sets of their five-word shingles have a Jaccard similarity of
at least 0.8. Equal sets are one class from the start. Then

1. every chunk of documents asks the hash buckets which of its shingles other sets hold
   as well, and in about how many chunks. A set of which under 80 % of the shingles
   occur elsewhere links with nothing; this leaves the near duplicates;
2. light: for sets up to the boundary, all subsets of the fixed size that a pair of given
   sizes must share (ceil(4 (n + m) / 9)) are enumerated. Sets meeting in a subset are
   linked for sure, so a group gives a star of edges, never all its pairs;
3. heavy: larger sets scan inverted lists of the prefix in which linked sets must meet,
   rarest shingles first. Each list is first compared with one pivot; what the verified
   edges leave in one component is done, and only lists that still hold several
   components compare their remaining pairs across them;
4. the boundary minimises the summed cost of enumerating and of scanning and verifying,
   from the counts of set sizes and the measured length of the inverted lists.

Components of the verified edges are taken on the executors.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import combinations, islice
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.llm import chunks as ck
from cellframe.llm import shingles
from cellframe.llm.common import to_many, written
from cellframe.llm.graph import components

#: The largest light set that is ever considered; subsets grow steeply with size.
MOST_LIGHT = 24
#: Subsets that a task holds at a time, and entries of a block of a long inverted list.
SUBSETS, BLOCK = 100_000, 512
#: Parts that the entries of an inverted list are dealt to.
SALTS = 16
_A, _B = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


def needed(n: int, m: int) -> int:
    """The least overlap of linked sets of sizes n and m."""
    return -(-4 * (n + m) // 9)


def partners(n: int) -> range:
    """The sizes that a set of size n can link with."""
    return range(-(-4 * n // 5), 5 * n // 4 + 1)


# --- which shingles are shared ---


class Parsed:
    """The sets of a chunk, its distinct shingles and its distinct sets, in a fixed order."""

    def __init__(self, table: pa.Table, n: int):
        self.ids = table.column("doc_id").to_pylist()
        self.sets = list(shingles.shingle_sets(table.column("text").to_pylist()))
        self.row_key: list[tuple[int, int] | None] = []
        least: dict[tuple[int, int], int] = {}
        members = {}
        with np.errstate(over="ignore"):
            for doc_id, own in zip(self.ids, self.sets, strict=True):
                if doc_id is None or not len(own):
                    self.row_key.append(None)
                    continue
                key = (int(shingles.mixed(own ^ _A).sum()), int(shingles.mixed(own ^ _B).sum()))
                self.row_key.append(key)
                least[key] = min(least.get(key, doc_id), doc_id)
                members[key] = own
        held = list(members.values())
        self.tokens, self.copies = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.order, self.starts = ck.by_bucket(self.tokens, n)
        self.keys = sorted(least, key=lambda k: ((k[0] >> 40) % n, k))
        self.least = [least[k] for k in self.keys]
        self.key_starts = np.searchsorted([(k[0] >> 40) % n for k in self.keys], np.arange(n + 1)) if self.keys else np.zeros(n + 1, int)

    def lists(self, n: int) -> Iterator[tuple[int, bytes]]:
        ordered = self.tokens[self.order]
        for b in range(n):
            tokens, lo, hi = ordered[self.starts[b] : self.starts[b + 1]], self.key_starts[b], self.key_starts[b + 1]
            if len(tokens) or hi > lo:
                sets = np.array([(*k, i % (1 << 64)) for k, i in zip(self.keys[lo:hi], self.least[lo:hi], strict=True)], np.uint64)
                yield b, struct.pack("<II", len(tokens), hi - lo) + ck.pack40(tokens) + sets.tobytes()

    def spread(self, n: int, replies: dict[int, bytes]) -> tuple[np.ndarray, dict[tuple[int, int], int]]:
        """(class of each token: 0, or the binary logarithm of its number of chunks; least id of each set)."""
        classes = np.zeros(len(self.tokens), np.uint8)
        least = {}
        for b, reply in replies.items():
            size = self.starts[b + 1] - self.starts[b]
            classes[self.order[self.starts[b] : self.starts[b + 1]]] = np.frombuffer(reply, np.uint8, size)
            least |= zip(self.keys[self.key_starts[b] : self.key_starts[b + 1]], np.frombuffer(reply, "<i8", offset=size).tolist(), strict=True)
        return classes, least


def answer(payloads: list[bytes]) -> list[bytes]:
    """For each chunk's list: a byte for each token, the global least document id of each set."""
    tokens, sets = [], []
    for p in payloads:
        n, m = struct.unpack_from("<II", p)
        tokens.append(ck.unpack40(p[8 : 8 + 5 * n]))
        sets.append(np.frombuffer(p, np.uint64, 3 * m, 8 + 5 * n).reshape(m, 3))
    values, counts = np.unique(np.concatenate(tokens), return_counts=True)
    values, counts = values[counts > 1], counts[counts > 1]
    classes = np.minimum(np.log2(counts), 255).astype(np.uint8)
    least: dict[tuple[int, int], int] = {}
    for rows in sets:
        for a, b, i in zip(rows[:, 0].tolist(), rows[:, 1].tolist(), rows[:, 2].astype(np.int64).tolist(), strict=True):
            least[a, b] = min(least.get((a, b), i), i)
    out = []
    for own, rows in zip(tokens, sets, strict=True):
        got = np.zeros(len(own), np.uint8)
        if len(values):
            at = np.minimum(np.searchsorted(values, own), len(values) - 1)
            got = np.where(values[at] == own, classes[at], got)
        mins = np.array([least[a, b] for a, b in zip(rows[:, 0].tolist(), rows[:, 1].tolist(), strict=True)], np.int64)
        out.append(got.astype(np.uint8).tobytes() + mins.tobytes())
    return out


def classes_of_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, rep, tokens): the least id with an equal set, and for sets that
    may link with others, on the row of that id, their shared shingles, rarest first."""
    docs = docs.withColumn(id_col, F.col(id_col).cast("long"))
    n = ck.buckets(docs, text_col)
    table = ck.chunk_table(docs, n, id_col, text_col)
    replies = ck.resolve(ck.ask(table, lambda t: Parsed(t, n).lists(n)), answer, "shared-shingles")

    def finish(rows: pa.Table, replied: dict[int, bytes]) -> pa.Table:
        parsed = Parsed(rows, n)
        classes, least = parsed.spread(n, replied)
        shared = (classes > 0) | (parsed.copies > 1)
        reps, packed = [], []
        done = set()
        for doc_id, own, key in zip(parsed.ids, parsed.sets, parsed.row_key, strict=True):
            rep = least[key] if key else None
            reps.append(rep)
            packed.append(None)
            if rep is not None and rep == doc_id and key not in done:
                done.add(key)
                at = np.searchsorted(parsed.tokens, own)
                at = at[shared[at]]
                if 5 * len(at) >= 4 * len(own):
                    ranked = at[np.lexsort((parsed.tokens[at], classes[at]))]
                    packed[-1] = parsed.tokens[ranked].tobytes()
        sizes = pa.array([len(s) for s in parsed.sets], pa.int64())
        return pa.table({"doc_id": rows.column("doc_id"), "n_shingles": sizes, "rep": pa.array(reps, pa.int64()), "tokens": pa.array(packed, pa.binary())})

    done = ck.conclude(table, [replies], finish, "doc_id long, n_shingles long, rep long, tokens binary")
    return written(done, "shingle-sets")


# --- light and heavy ---


def light_cost(n: int, most: int) -> int:
    """Subsets that a set of size ``n`` enumerates if sets up to ``most`` are light."""
    return sum(comb(n, needed(n, m)) for m in partners(n) if m <= most and needed(n, m) <= min(n, m)) if n <= most else 0


def heavy_cost(n: int, most: int, listed: float) -> float:
    """Work of a set of size ``n`` that can link with one above ``most``: its prefix entries and what they meet."""
    return (n - ceil(4 * n / 5) + 1) * (1 + n * listed) if 5 * n // 4 > most else 0


def boundary(counts: dict[int, int], listed: float = 1.0) -> int:
    """The largest light size: that of the least summed cost, the smallest such.

    ``counts`` holds how many sets have each size, ``listed`` how many others an entry of an
    inverted list meets on average. Enumerating costs one unit for each subset; scanning
    costs, for each prefix entry, the entry and the verification of what it meets, by size.
    """
    sizes = [n for n in counts if n <= 5 * MOST_LIGHT // 4]
    cost = [sum(counts[n] * (light_cost(n, most) + heavy_cost(n, most, listed)) for n in sizes) for most in range(MOST_LIGHT + 1)]
    return cost.index(min(cost))


def light_edges(sets: DataFrame, most: int) -> DataFrame:
    """Edges (a, b) between sets of up to ``most`` shingles, as stars."""

    def flushed(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["key", "side", "rep"])

    def enumerate_subsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int]] = []
        for batch in batches:
            for rep, n, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = [int(x) for x in shingles.mixed(np.frombuffer(packed, np.uint64))]
                for m in partners(n):
                    size, lo, hi = needed(n, m), min(n, m), max(n, m)
                    if m > most or size > len(tokens):
                        continue
                    side = (n > m) - (n < m)
                    salt = (lo << 8 | hi) * 0x9E3779B97F4A7C15
                    subsets = combinations(tokens, size)
                    while part := list(islice(subsets, SUBSETS - len(rows))):
                        rows += [((sum(c) * 0xD6E8FEB86659FD93 + salt) % (1 << 64) - (1 << 63), side, rep) for c in part]
                        if len(rows) == SUBSETS:
                            yield flushed(rows)
                            rows = []
        yield flushed(rows)

    keys = sets.filter(F.col("n") <= most).select("rep", "n", "tokens").mapInArrow(enumerate_subsets, "key long, side long, rep long")
    ends = keys.groupBy("key").agg(F.min(F.when(F.col("side") <= 0, F.col("rep"))).alias("low"), F.min(F.when(F.col("side") >= 0, F.col("rep"))).alias("high"))
    # many sets may have one subset, and one pivot many partners: such keys are salted
    met = to_many(keys, ends.filter("low IS NOT NULL AND high IS NOT NULL"), "key", "rep", SALTS)
    other = F.when(F.col("side") < 0, F.col("high")).otherwise(F.col("low"))
    return met.select(F.col("rep").alias("a"), other.alias("b")).filter("a <> b").distinct()


def prefix_entries(sets: DataFrame, most: int) -> DataFrame:
    """(token, rep, n, rest): the prefix of each set that can link with one above ``most``; rest shared shingles follow."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, reps, sizes, rests = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for rep, n, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(packed, np.int64)
                length = len(own) - -(-4 * n // 5) + 1
                tokens.append(own[:length])
                reps.append(np.full(length, rep))
                sizes.append(np.full(length, n))
                rests.append(len(own) - 1 - np.arange(length))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, reps, sizes, rests)], ["token", "rep", "n", "rest"])

    wide = sets.filter(F.floor(F.col("n") * 5 / 4) > most).select("rep", "n", "tokens")
    return wide.mapInArrow(prefixes, "token long, rep long, n long, rest long")


def list_length(sets: DataFrame) -> float:
    """How many others an entry of these sets' inverted lists meets on average."""
    lists = prefix_entries(sets, 0).groupBy("token").agg(F.count("*").cast("double").alias("many"))
    return lists.agg(F.sum(F.col("many") * (F.col("many") - 1)) / F.sum("many")).first()[0] or 0.0


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link."""
    own = sets.select("rep", "n", "tokens")
    left = to_many(pairs, own.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a")), "a", "b", SALTS)
    full = to_many(left, own.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b")), "b", "a", SALTS)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for _, _, n_a, t_a, n_b, t_b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                both = np.concatenate([np.frombuffer(t_a, np.uint64), np.frombuffer(t_b, np.uint64)])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= 80 * (n_a + n_b - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return full.select("a", "b", "n_a", "t_a", "n_b", "t_b").mapInArrow(links, "a long, b long")


def fits(n: str, m: str) -> Column:
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def heavy_edges(sets: DataFrame, most: int, light: DataFrame) -> DataFrame:
    """Edges (a, b) of pairs with a set above ``most``; enough of them to connect what is linked."""
    # the sets' shingles bound their prefix entries, and those the stars and what is unsettled
    bound = sets.agg(F.sum("n")).first()[0] or 0
    every = written(prefix_entries(sets, most), "prefixes", bound)
    # lists may be long, so what is known of a list is joined to its entries by salted tokens
    # an entry whose remaining shared shingles do not reach even the list's smallest set links with none there
    sizes = every.groupBy("token").agg(F.count("*").alias("many"), F.min("n").alias("least")).filter("many > 1")
    useful = to_many(every, sizes.select("token", "least"), "token", "rep", SALTS).filter((F.col("rest") + 1) * 9 >= 4 * (F.col("n") + F.col("least")))
    entries = written(useful.select("token", "rep", "n", "rest"), "useful-prefixes", bound)
    # the set that shares most of its shingles, as the original of a group of edited copies does
    ratio = (F.col("rest") + 1) / F.col("n")
    lists = entries.groupBy("token").agg(F.count("*").alias("many"), F.max(F.struct(ratio.alias("share"), (-F.col("rep")).alias("least"), "n")).alias("top")).filter("many > 1")
    starred = to_many(entries, lists.select("token", (-F.col("top.least")).alias("pivot"), F.col("top.n").alias("m")), "token", "rep", SALTS)
    stars = starred.filter((F.col("rep") != F.col("pivot")) & fits("n", "m")).select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
    tried = written(stars, "stars", bound)
    edges = written(verified(tried, sets), "star-edges", bound)

    known = components(edges.unionByName(light))
    labelled = entries.join(known.withColumnRenamed("node", "rep"), "rep", "left").select("token", "rep", "n", "rest", F.coalesce("comp", "rep").alias("comp"))
    open_lists = labelled.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("many")).filter("low <> high")
    unsettled = written(to_many(labelled, open_lists.select("token", F.ceil(F.col("many") / BLOCK).alias("blocks")), "token", "rep", SALTS), "unsettled", bound)
    # a long list is cut into blocks, and its pairs of blocks are dealt to as many tasks
    own, every_block = F.pmod(F.xxhash64("rep"), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    x = unsettled.select("token", own.alias("i"), every_block.alias("j"), F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("rest").alias("rest_a"), F.col("comp").alias("comp_a"))
    y = unsettled.select("token", every_block.alias("i"), own.alias("j"), F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("rest").alias("rest_b"), F.col("comp").alias("comp_b"))
    # no shared shingle comes before the first one in either prefix, so at most 1 + rest are common
    reach = (F.least("rest_a", "rest_b") + 1) * 9 >= 4 * (F.col("n_a") + F.col("n_b"))
    cross = x.join(y, ["token", "i", "j"]).filter((F.col("a") < F.col("b")) & (F.col("comp_a") != F.col("comp_b")) & fits("n_a", "n_b") & reach)
    late = written(cross.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "late-pairs")
    return edges.unionByName(verified(late, sets))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row.

    ``component_id`` is the smallest id reachable over links, the row's own included. A
    null or blank text has no shingles and links with nothing. Rows with equal ids are one
    document in the graph; a row whose id is null links with nothing and has a null
    component. Repeated rows stay; other columns are left out. Links are exact but for
    collisions of 64-bit shingle hashes.
    """
    rows = classes_of_sets(docs, id_col, text_col)
    sets = rows.filter("tokens IS NOT NULL").select("rep", F.col("n_shingles").alias("n"), "tokens")
    small = sets.filter(F.col("n") <= 5 * MOST_LIGHT // 4)
    counts = {r[0]: r[1] for r in small.groupBy("n").count().collect()}
    most = boundary(counts, list_length(small)) if counts else 0
    light = written(light_edges(sets, most), "light-edges", sum(many * light_cost(n, most) for n, many in counts.items()))
    twice = rows.filter("rep IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low <> high").select(F.col("low").alias("a"), F.col("high").alias("b"))
    edges = heavy_edges(sets, most, light).unionByName(light)
    comps = components(written(edges.unionByName(twice).distinct(), "links"))
    labelled = rows.join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    return labelled.select("doc_id", "n_shingles", F.coalesce("comp", "rep", "doc_id").alias("component_id"))
