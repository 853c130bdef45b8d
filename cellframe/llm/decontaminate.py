"""Benchmark decontamination: short test items found inside long documents.

Items are partitioned by the size of their shingle set (powers of two). An item's sketch
is a bottom-k MinHash: its k shingles of least hash, with k the partition's: one more than
a contained item of its largest size can lack, so a document that contains the item holds
one of them at least and nothing is missed. A partition is searched with a document's
MinHash below the partition's largest sketch hash; a minimum over the whole of a long
document would hide a short item. Candidates are verified by exact shingle containment.

Up to ``BLOCK_CHARS`` characters of items are broadcast as an index. More are not: then
documents and sketches meet in a join on the hashes.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.llm import shingles
from cellframe.llm.common import keyed_text, map_batches, pieces, to_many, written

#: The most characters of item text that are broadcast.
BLOCK_CHARS = 16_000_000
_SALT = np.uint64(0x2545F4914F6CDD1D)


def sketch_size(partition: int, threshold: float) -> int:
    """k for sets of 2^(partition - 1) to 2^partition - 1 shingles: one of them is in every text that contains the item."""
    return int((1 - threshold) * ((1 << partition) - 1) + 1e-9) + 1


def sketch(own: np.ndarray, threshold: float) -> np.ndarray:
    """The MinHash of an item's shingles."""
    return np.sort(shingles.mixed(own ^ _SALT))[: sketch_size(len(own).bit_length(), threshold)]


def enough(common: int, size: int, threshold: float) -> bool:
    return common >= threshold * size - 1e-9


def in_common(held: np.ndarray, own: np.ndarray) -> int:
    """How many of ``own`` are in the sorted ``held``."""
    return int((held[np.minimum(np.searchsorted(held, own), len(held) - 1)] == own).sum()) if len(held) else 0


@dataclass
class Partition:
    """The sketches of items of about one size: sorted hashes and the items that have each."""

    keys: np.ndarray
    owners: list[list[int]]

    def candidates(self, minhash: np.ndarray) -> set[int]:
        near = minhash[minhash <= self.keys[-1]]
        at = np.searchsorted(self.keys, near)
        return {row for k in np.unique(at[self.keys[at] == near]).tolist() for row in self.owners[k]}


@dataclass
class Index:
    """Sketches by size partition, and whole sets, of all items."""

    threshold: float
    ids: list[int] = field(default_factory=list)
    sets: list[np.ndarray] = field(default_factory=list)
    lengths: set[int] = field(default_factory=set)
    partitions: dict[int, Partition] = field(default_factory=dict)

    def add(self, item_id: int, text: str | None) -> None:
        words = next(shingles.per_text([text]))
        own = shingles.shingle_set(words)
        if len(own):
            self.ids.append(item_id)
            self.sets.append(own)
            self.lengths.add(min(shingles.WORDS, len(words)))

    def close(self) -> Index:
        held: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for row, own in enumerate(self.sets):
            for key in sketch(own, self.threshold).tolist():
                held[len(own).bit_length()][key].append(row)
        for size, by_key in held.items():
            keys = sorted(by_key)
            self.partitions[size] = Partition(np.array(keys, np.uint64), [by_key[k] for k in keys])
        every = np.concatenate([p.keys for p in self.partitions.values()]) if held else np.zeros(0, np.uint64)
        bits = max(16, int(len(every) * 16).bit_length())
        #: Whether any sketch has a hash of these leading bits.
        self.shift = np.uint64(64 - bits)
        self.filter = np.zeros(1 << bits, bool)
        self.filter[(every >> self.shift).astype(np.int64)] = True
        return self

    def search(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """(item id, shingles of the item, how many of them the text holds) of contained items."""
        runs = [shingles.of_words(words, n) for n in sorted(self.lengths) if len(words) >= n]
        if not runs:
            return []
        whole = np.concatenate(runs)
        minhash = shingles.mixed(whole ^ _SALT)
        minhash = minhash[self.filter[(minhash >> self.shift).astype(np.int64)]]
        rows = sorted(set().union(*(p.candidates(minhash) for p in self.partitions.values()))) if len(minhash) else []
        if not rows:
            return []
        held, found = np.unique(whole), []
        for row in rows:
            own = self.sets[row]
            common = in_common(held, own)
            if enough(common, len(own), self.threshold):
                found.append((self.ids[row], len(own), common))
        return found


def index_of(items: DataFrame, threshold: float, id_col: str, text_col: str) -> Index | None:
    """The closed index of all items with an id, or None if their text is more than is broadcast."""
    named = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
    if (named.agg(F.sum(F.length("text"))).first()[0] or 0) > BLOCK_CHARS:
        return None
    index = Index(threshold)
    for row in named.toLocalIterator():
        index.add(row[0], row[1])
    return index.close()


# --- more items than are broadcast ---


def item_sets(items: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, words, keys, own): the sketch and the packed shingle set of every item with an id and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                rows = []
                for key, words in zip(part.column(0).to_pylist(), shingles.per_text(part.column(1).to_pylist()), strict=True):
                    own = shingles.shingle_set(words)
                    if len(own):
                        rows.append((key, min(shingles.WORDS, len(words)), sketch(own, threshold).view(np.int64).tolist(), own.tobytes()))
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["item_id", "words", "keys", "own"])

    named = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).filter("item_id IS NOT NULL")
    return named.mapInArrow(run, "item_id long, words long, keys array<long>, own binary").withColumn("item", F.monotonically_increasing_id())


def joined(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """(row, item_id, n_item, n_common) of contained items, for docs (row, text) and items of ``item_sets``.

    A document meets the sketches through its distinct MinHash values; what meets is
    verified with the texts and sets of the candidates alone. Hashes and items that many
    documents hold, and documents that hold many items, are salted keys.
    """
    lengths = sorted(r[0] for r in items.select("words").distinct().collect())

    def hashes(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        for words in shingles.per_text(texts):
            runs = [shingles.of_words(words, n) for n in lengths if len(words) >= n]
            yield np.unique(np.concatenate(runs)) if runs else np.zeros(0, np.uint64)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                for row, held in zip(part.column(0).to_pylist(), hashes(part.column(1).to_pylist()), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array(shingles.mixed(held ^ _SALT).view(np.int64)), pa.array(np.full(len(held), row))], ["key", "row"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                rows, last, held = [], None, None
                for row, text, item_id, own in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if row != last:
                        last, held = row, next(hashes([text]))
                    own = np.frombuffer(own, np.uint64)
                    common = in_common(held, own)
                    if enough(common, len(own), threshold):
                        rows.append((row, item_id, len(own), common))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["row", "item_id", "n_item", "n_common"])

    sketches = items.select("item", F.explode("keys").alias("key"))
    met = written(to_many(docs.mapInArrow(keys, "key long, row long"), sketches, "key", "row").select("row", "item").distinct(), "item-candidates")
    # texts last: what comes of one text and salt is sorted together
    full = to_many(to_many(met, items.select("item", "item_id", "own"), "item", "row"), docs, "row", "item")
    return full.select("row", "text", "item_id", "own").mapInArrow(verify, "row long, item_id long, n_item long, n_common long")


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """The rows with a number that stays: they are written once more."""
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")


# --- tables ---


def contained(docs: DataFrame, items: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_item, n_common): items with at least ``threshold`` of their shingles in a document.

    Items without words, and null items or ids of items, match nothing; an item of fewer
    than five words is one shingle of that many. Null and empty texts hold nothing; a
    repeated row gives its pairs again, an item id that repeats one pair for each item.
    Null document ids stay. Other columns are left out.
    """
    keyed = keyed_text(docs, id_col, text_col)
    index = index_of(items, threshold, item_col, item_text_col)
    if index is None:
        rows = numbered(keyed, "row")
        found = joined(rows.select("row", "text"), written(item_sets(items, threshold, item_col, item_text_col), "item-sets"), threshold)
        return found.join(rows.select("row", "doc_id"), "row").select("doc_id", "item_id", "n_item", "n_common")
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(index))

    def build():
        own: Index = pickle.loads(shared.value)

        def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, rows = batch.column(0).to_pylist(), []
            for key, words in zip(ids, shingles.per_text(batch.column(1).to_pylist()), strict=True):
                rows += [(key, *found) for found in own.search(words)]
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "item_id", "n_item", "n_common"])

        return convert

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(keyed, build, f"doc_id {kind}, item_id long, n_item long, n_common long")


def clean(docs: DataFrame, items: DataFrame, threshold: float = 0.8, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text contains no item; null and empty texts contain none and stay."""
    index = index_of(items, threshold, item_col, item_text_col)
    if index is None:
        name = next(n for n in ("row" + "_" * k for k in range(len(docs.columns) + 1)) if n not in docs.columns)
        rows = numbered(docs, name)
        found = joined(rows.select(F.col(name).alias("row"), F.col(text_col).alias("text")), written(item_sets(items, threshold, item_col, item_text_col), "item-sets"), threshold)
        return rows.join(found.select(F.col("row").alias(name)).distinct(), name, "left_anti").select(*docs.columns)
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(index))

    def build():
        own: Index = pickle.loads(shared.value)

        def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array([not own.search(w) for w in shingles.per_text(batch.column(at).to_pylist())], pa.bool_()))

        return convert

    return map_batches(docs, build, docs.schema)


ORACLE = r"""
WITH upper_lower AS (
  SELECT doc_id AS id, 'd' AS kind, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL
  SELECT item_id, 'i', regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark),
items AS (
  SELECT DISTINCT id, least(5, len(w)) AS n, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda k: array_to_string(w[k:k+4], ' '))) AS s
  FROM upper_lower WHERE kind = 'i' AND len(w) > 0),
sizes AS (SELECT id, count(*) AS n_item FROM items GROUP BY id),
docs AS (
  SELECT DISTINCT id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k+n-1], ' '))) AS s
  FROM upper_lower, (SELECT DISTINCT n FROM items) WHERE kind = 'd' AND len(w) >= n),
common AS (SELECT docs.id AS doc_id, items.id AS item_id, count(*) AS n_common FROM docs JOIN items USING (n, s) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_common FROM common JOIN sizes ON item_id = id WHERE 5 * n_common >= 4 * n_item"""
