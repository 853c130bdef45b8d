"""Concatenate and cut: all documents as one stream of ids, cut into sequences of one length.

Tokenising tasks write each document's ids with the number of the task and the ids before
it there. Sums of the tasks' totals, in the order of their numbers, then place every
document in the stream, so that the second pass cuts each one where it lies: no shuffle, no
sort, and no order of documents but that in which they were read. Sequences that lie within
one task's ids are put together there; only the boundary records, pieces of sequences that
several tasks share, are shuffled. What is left behind the last whole sequence is cut at
powers of two, which need no padding.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, pairwise
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.llm.common import keyed_text, pieces, shared_path
from cellframe.llm.pretokens import MARKS, mapped, without_gc

LENGTH = 4096
#: Lines of lower-case letters below U+0530 with ASCII marks behind, in two groups that are empty for all others. An
#: apostrophe can begin a pre-token of letters, a bar a special token.
PLAIN = re.compile(
    f"^(?:([{''.join(c for c in map(chr, range(0x530)) if c.isalpha() and c.islower())}]{{0,40}})([{re.escape(''.join(c for c in MARKS if c not in "'|"))}]{{0,20}})|.*)$",
    re.MULTILINE,
)


class WordIds:
    """A tokenizer file's ids of whole texts, without added tokens, by a bounded cache of words.

    For files that drop white space between their pre-tokens, as ``word_bpe_49k.json`` does: no
    token, and no composition of characters, reaches over a space, so the parts between spaces
    are tokenised by themselves. Texts that stay the same under NFC are lower-cased first,
    which the file would do later; a part of letters with ASCII marks behind is two pre-tokens
    that go to the merges directly. All other parts go through the library whole.
    """

    def __init__(self, spec: str, max_chars: int = 14_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_str(spec)
        self.tokenizer.no_truncation(), self.tokenizer.no_padding()
        pre, norm = self.tokenizer.pre_tokenizer.__getstate__(), self.tokenizer.normalizer.__getstate__()
        if b"'s|'t|'re|'ve|'m|'ll|'d|[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+" not in pre or b"Lowercase" not in norm or b"NFC" not in norm:
            raise ValueError("only files of lower-cased words without white space are read here")
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.code = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.max_chars, self.held = max_chars, 0
        self.known: dict[str, bytes] = {"": b""}
        self.plain: dict[str, bytes] = {"": b""}

    def _lower(self, text: str) -> str:
        """The text as the file's normaliser lower-cases it, where that can be said of the text alone."""
        low = text.lower()
        if not text.isascii() and ("Σ" in text or not unicodedata.is_normalized("NFC", text) or not unicodedata.is_normalized("NFC", low)):
            return text
        return text if any(s in low for s in self.special) else low

    def _learn(self, words: Iterable[str]) -> None:
        """Ids of words that are not known yet."""
        words, known, plain = list(words), self.known, self.plain
        if not words:
            return
        found = PLAIN.findall("\n".join(words))
        bare, marks = zip(*found, strict=True)
        new = list(set(bare).union(marks).difference(plain))
        tokens = list(map(self.model.tokenize, mapped(new)))
        plain.update(zip(new, self._cut(list(map(len, tokens)), [t.id for own in tokens for t in own]), strict=True))
        known.update(zip(words, map(add, map(plain.__getitem__, bare), map(plain.__getitem__, marks)), strict=True))
        whole = [word for word, parts in zip(words, found, strict=True) if parts == ("", "")]
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)]
        known.update(zip(whole, self._cut(list(map(len, encoded)), [i for ids in encoded for i in ids]), strict=True))
        self.held += sum(map(len, words)) + 20 * len(words) + 2 * sum(map(len, whole))

    def _cut(self, sizes: list[int], ids: list[int]) -> Iterator[bytes]:
        """The packed ids, so many to each."""
        data, width = np.array(ids, self.code).tobytes(), self.code.itemsize
        return (data[width * start : width * end] for start, end in pairwise(accumulate(sizes, initial=0)))

    def packed(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text in little-endian numbers of ``code``; a null text has none."""
        if self.held > self.max_chars:
            self.known, self.plain, self.held = {"": b""}, {"": b""}, 0
        known = self.known
        cut = [self._lower(t).replace("\n", " ").replace("\t", " ").split(" ") if t else [] for t in texts]
        got = [list(map(known.get, words)) for words in cut]
        late = [[k for k, ids in enumerate(own) if ids is None] for own in got]
        self._learn({words[k] for words, places in zip(cut, late, strict=True) for k in places})
        for words, own, places in zip(cut, got, late, strict=True):
            for k in places:
                own[k] = known[words[k]]
        return list(map(b"".join, got))


@lru_cache(maxsize=2)
def _words(spec: str) -> WordIds:
    return WordIds(spec)


def encoded(docs: DataFrame, path: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """((doc_id, part, before, n_ids, ids), bytes of an id), written to the shared folder.

    ``ids`` are a document's ids and ``end``; ``part`` is the task that made them and ``before``
    the ids that it made earlier. What a task says is settled once its file is committed.
    """
    with open(path, encoding="utf-8") as lines:
        spec = lines.read()
    spark = docs.sparkSession
    code = WordIds(spec).code
    # bounded by the vocabulary file, a few megabytes whatever the input
    shared = spark.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last, before, part = _words(shared.value), np.array([end], code).tobytes(), 0, TaskContext.get().partitionId()
        for batch in batches:
            for some in pieces(batch):
                ids = [x + last for x in without_gc(lambda some=some: words.packed(some.column(1).to_pylist()))]
                sizes = np.array([len(x) for x in ids], np.int64) // code.itemsize
                ends = before + np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([part] * len(ids), pa.int32()), pa.array(ends - sizes), pa.array(sizes), pa.array(ids, pa.binary())], ["doc_id", "part", "before", "n_ids", "ids"])
                before = int(ends[-1]) if len(ids) else before

    kind = docs.schema[id_col].dataType.simpleString()
    made = keyed_text(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, part int, before long, n_ids long, ids binary")
    where = shared_path(spark, "ids")
    made.write.option("compression", "zstd").parquet(where)
    return spark.read.schema(made.schema).parquet(where), code.itemsize


def part_starts(ids: DataFrame) -> tuple[np.ndarray, int]:
    """(the place in the stream where each task's ids begin, all ids): one number a task reaches the driver."""
    totals = {r[0]: r[1] for r in ids.groupBy("part").agg(F.sum("n_ids")).collect()}
    sizes = np.array([totals.get(p, 0) for p in range(max(totals, default=-1) + 1)], np.int64)
    return np.concatenate([[0], np.cumsum(sizes)])[: len(sizes)], int(sizes.sum())


def cuts(total: int, length: int) -> np.ndarray:
    """Where the sequences behind the last whole one begin, and the end: the rest is cut at powers of two."""
    at = total - total % length
    out = [at]
    for k in range(length.bit_length(), -1, -1):
        if (total - at) >> k & 1:
            at += 1 << k
            out.append(at)
    return np.array(out, np.int64)


class Cutter:
    """Places and pieces of the stream, for one table of ids."""

    def __init__(self, starts: np.ndarray, total: int, length: int):
        self.starts, self.length, self.tail = starts, length, cuts(total, length)
        self.whole = total // length

    def pieces(self, begin: int, size: int) -> Iterator[tuple[int, int, int, int]]:
        """(sequence, offset in it, first id, ids) of what lies from ``begin`` on."""
        at, end = begin, begin + size
        while at < end:
            number = at // self.length
            low = number * self.length
            high = low + self.length
            if number >= self.whole:
                k = int(np.searchsorted(self.tail, at, side="right"))
                number, low, high = self.whole + k - 1, int(self.tail[k - 1]), int(self.tail[k])
            yield number, at - low, at - begin, min(end, high) - at
            at = min(end, high)

    def size(self, number: int) -> int:
        return self.length if number < self.whole else int(self.tail[number - self.whole + 1] - self.tail[number - self.whole])


class Packed:
    """Documents packed into sequences of at most ``length`` ids.

    A null or empty text is its end id alone; rows that repeat and null ids stay, each a
    document; other columns are left out. An empty table has no pieces.
    """

    def __init__(self, docs: DataFrame, path: str, end: int, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text"):
        self.ids, self.width = encoded(docs, path, end, id_col, text_col)
        starts, total = part_starts(self.ids)
        self.total, self.length = total, length
        # one number for each task of the first pass
        self.cutter = docs.sparkSession.sparkContext.broadcast(Cutter(starts, total, length))

    def pieces(self) -> DataFrame:
        """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row a piece."""
        cutter, code = self.cutter, f"<u{self.width}"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cut = cutter.value
            for batch in batches:
                for some in pieces(batch):
                    rows, start, size, crc, number, offset = [], [], [], [], [], []
                    for row, (part, before, n, ids) in enumerate(zip(*(some.column(i).to_pylist() for i in range(1, 5)), strict=True)):
                        flat = np.frombuffer(ids, code).astype("<u4")
                        for sequence, place, first, many in cut.pieces(int(cut.starts[part]) + before, n):
                            rows.append(row), start.append(first), size.append(many), number.append(sequence), offset.append(place)
                            crc.append(zlib.crc32(flat[first : first + many]))
                    picked = pa.array(rows, pa.int64())
                    longs = [pa.array(x, pa.int64()) for x in (start, size, crc, number, offset)]
                    yield pa.RecordBatch.from_arrays([some.column(0).take(picked), *longs[:3], some.column(3).take(picked), *longs[3:]], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        kind = self.ids.schema["doc_id"].dataType.simpleString()
        return self.ids.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")

    def sequences(self) -> DataFrame:
        """(sequence_id, n_ids, ids): every sequence's ids as little-endian unsigned 32-bit numbers, none padded.

        A task puts together the sequences that lie in what it reads as far as they go; only
        fragments of sequences that others share too meet in a shuffle, at most ``length`` ids each.
        """
        cutter, code = self.cutter, f"<u{self.width}"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cut, held, filled = cutter.value, {}, {}

            def out(numbers: list[int]) -> pa.RecordBatch:
                rows = [(k, at, b) for k in numbers for at, b in held.pop(k)]
                return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([cut.size(r[0]) for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["sequence_id", "offset", "n_ids", "ids"])

            for batch in batches:
                for some in pieces(batch):
                    done = []
                    for part, before, n, ids in zip(*(some.column(i).to_pylist() for i in range(1, 5)), strict=True):
                        flat = np.frombuffer(ids, code).astype("<u4")
                        for sequence, place, first, many in cut.pieces(int(cut.starts[part]) + before, n):
                            held.setdefault(sequence, []).append((place, flat[first : first + many].tobytes()))
                            filled[sequence] = filled.get(sequence, 0) + many
                            if filled[sequence] == cut.size(sequence):
                                held[sequence] = [(0, b"".join(b for _, b in sorted(held[sequence])))]
                                done.append(sequence)
                                del filled[sequence]
                    if done:
                        yield out(done)
            yield out(list(held))

        made = self.ids.mapInArrow(run, "sequence_id long, offset long, n_ids long, ids binary")
        alone = F.octet_length("ids") == F.col("n_ids") * 4
        shared = made.filter(~alone).groupBy("sequence_id", "n_ids").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
        joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
        return made.filter(alone).select("sequence_id", "n_ids", "ids").unionByName(shared.select("sequence_id", "n_ids", joined.alias("ids")))


def pack(docs: DataFrame, path: str, end: int, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> Packed:
    """The documents' ids as one stream, cut into sequences; see ``Packed``."""
    return Packed(docs, path, end, length, id_col, text_col)
