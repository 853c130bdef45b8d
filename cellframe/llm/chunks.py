"""Questions from chunks of documents to hash buckets and answers back.

Corpus-wide questions about very many small things (does this shingle, this 24-byte
string, occur elsewhere?) are asked by chunks of a few megabytes of text: a chunk sends
each bucket one packed, duplicate-free list and gets one packed answer. A thing that a
third of all documents hold costs one entry for each chunk, not for each document, and
bucket tasks see bounded lists.

The chunks are written once as a table bucketed by chunk in the shared folder: it keeps
their make-up fixed for all passes (a lost task that runs again sees the same chunk), and
passes over it need no shuffle of the text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.llm.common import keyed_text, written
from cellframe.sources.shared import shared_path

CHUNK_BYTES = 4_000_000
CHUNK_ROWS = 4096
BUCKET_BYTES = 64_000_000
#: From so many buckets on, chunks are dealt to their buckets before they are written.
COMPACT_FROM = 2000
REQUESTS = "bucket int, chunk long, payload binary"
REPLIES = "bucket int, chunk long, reply binary"


def buckets(docs: DataFrame, text_col: str = "text") -> int:
    """As many as shuffle partitions, and at least one for each ``BUCKET_BYTES`` of text.

    A bucket's task holds about as many bytes as its share of the text, so the number
    follows the measured size of the input where the setting does not.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


def chunk_table(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(chunk, doc_id, text) in ``n`` buckets: neighbouring rows of a partition, up to 4 MB or 4096 rows to a chunk.

    A task writes a file for each of its chunks. On inputs with thousands of buckets that
    would be millions of small files; there the text is shuffled once, to one file a bucket.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, rows = TaskContext.get().partitionId() << 33, 0, 0
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                chunks = []
                for n in pa.compute.binary_length(part.column(1)).to_pylist():
                    if rows and (size + (n or 0) > CHUNK_BYTES or rows >= CHUNK_ROWS):
                        number, size, rows = number + 1, 0, 0
                    size, rows = size + (n or 0), rows + 1
                    chunks.append(number)
                yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), *part.columns], ["chunk", "doc_id", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    name = f"chunks_{uuid.uuid4().hex}"
    numbered = keyed_text(docs, id_col, text_col).mapInArrow(run, f"chunk long, doc_id {kind}, text string")
    if n >= COMPACT_FROM:
        numbered = numbered.repartition(n, "chunk")
    numbered.write.bucketBy(n, "chunk").option("compression", "zstd").option("path", shared_path(spark, "chunks")).saveAsTable(name)
    return forgotten(spark, name)


def forgotten(spark: SparkSession, name: str) -> DataFrame:
    """The external table as a frame that keeps its buckets, with its name taken off the catalogue; its files stay."""
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def ask(chunks: DataFrame, question: Callable[[pa.Table], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """The packed lists (bucket, payload) of every chunk."""

    def run(table: pa.Table) -> pa.Table:
        return _packed(table.column("chunk")[0].as_py(), question(table), "payload")

    return chunks.groupBy("chunk").applyInArrow(run, REQUESTS)


def ask_again(chunks: DataFrame, replies: DataFrame, question: Callable[[pa.Table, dict[int, bytes]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """Packed lists made with the answers to an earlier question."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py() if table.num_rows else 0
        return _packed(chunk, question(table, _answers(answers)) if table.num_rows else iter(()), "payload")

    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, REQUESTS)


def resolve(requests: DataFrame, answer: Callable[[list[bytes]], list[bytes]], what: str) -> DataFrame:
    """The answers to all lists of a bucket, written to the shared folder."""

    def run(table: pa.Table) -> pa.Table:
        replies = answer(table.column("payload").to_pylist())
        return pa.table({"bucket": table.column("bucket"), "chunk": table.column("chunk"), "reply": pa.array(replies, pa.binary())})

    return written(requests.groupBy("bucket").applyInArrow(run, REPLIES), what)


def conclude(chunks: DataFrame, replies: list[DataFrame], finish: Callable[..., pa.Table], schema: str) -> DataFrame:
    """A table from each chunk and the answers it got to each question."""
    tagged = replies[0].selectExpr("0 AS round", "bucket", "chunk", "reply")
    for k, more in enumerate(replies[1:], 1):
        tagged = tagged.unionByName(more.selectExpr(f"{k} AS round", "bucket", "chunk", "reply"))
    rounds = range(len(replies))

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        number = answers.column("round").to_numpy()
        return finish(table, *[_answers(answers.filter(pa.array(number == k))) for k in rounds])

    return chunks.groupBy("chunk").cogroup(tagged.groupBy("chunk")).applyInArrow(run, schema)


def _packed(chunk: int, lists: Iterator[tuple[int, bytes]], name: str) -> pa.Table:
    got = list(lists)
    return pa.table({"bucket": pa.array([b for b, _ in got], pa.int32()), "chunk": pa.array([chunk] * len(got), pa.int64()), name: pa.array([p for _, p in got], pa.binary())})


def _answers(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table.column("bucket").to_pylist(), table.column("reply").to_pylist(), strict=True))


# --- packing ---


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """The bucket of 64-bit keys, from their upper 24 bits; the lower 40 name the key in it."""
    return ((keys >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def by_bucket(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(the order by bucket and then key, where each bucket starts in it)."""
    bucket = bucket_of(keys, n)
    order = np.lexsort((keys & np.uint64((1 << 40) - 1), bucket))
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def pack40(keys: np.ndarray) -> bytes:
    """The lower 40 bits of each key."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpack40(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()
