"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.sources.shared import shared_path, written  # noqa: F401  (for the text operators)

SLICE = 500
SLICE_BYTES = 4_000_000


def to_many(rows: DataFrame, facts: DataFrame, key: str, by: str, salts: int = 64) -> DataFrame:
    """``rows`` with the facts of their key, which is unique in ``facts`` and may be hot in ``rows``.

    Rows are salted by a hash of ``by``; facts are copied for the salts that their key has, so
    no task gets more than a share of a hot key's rows, whatever join Spark picks. Rows
    without facts are left out.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    copies = salted.select(key, "_salt").distinct().join(facts, key)
    return salted.join(copies, [key, "_salt"]).drop("_salt")


def pieces(batch: pa.RecordBatch, rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in slices of up to ``rows`` rows and ``SLICE_BYTES`` bytes of strings, one row at least."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        reach = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE_BYTES, side="right"))
        end = max(start + 1, min(start + rows, reach))
        yield batch.slice(start, end - start)
        start = end


def map_batches(frame: DataFrame, build: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, rows: int = SLICE) -> DataFrame:
    """``mapInArrow`` of a batch function made once for each task by ``build``.

    Batches are cut by rows and bytes, so that a worker converts few texts at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convert = build()
        for batch in batches:
            yield from map(convert, pieces(batch, rows))

    return frame.mapInArrow(run, schema)


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names; other columns cannot clash from here on."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
