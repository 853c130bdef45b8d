"""Reading and writing tables; Parquet clustered by Z-order for data skipping."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.functions.names import free
from cellframe.operators.tables import SpatialTable
from cellframe.plans.skew import row_hash

#: Knots of the distribution function of each key, and the relative error of their ranks.
KNOTS, RANK_ERROR = 64, 0.002


def _cells(x: np.ndarray, knots: np.ndarray, n_bits: int) -> np.ndarray:
    """The numbers of the cells, of 2^n_bits: shares of rows below, straight lines between the knots (quantiles in even steps); nulls and NaNs lie in the last."""
    last = len(knots) - 1
    if last < 1 or knots[0] == knots[-1]:
        return np.zeros(len(x), np.int64)
    at = np.clip(np.searchsorted(knots, x, side="right") - 1, 0, last - 1)
    low, high = knots[at], knots[at + 1]
    with np.errstate(all="ignore"):
        share = (at + np.nan_to_num((x - low) / (high - low), nan=0.0, posinf=0.0, neginf=0.0)) / last
    share = np.where(x < knots[0], 0.0, np.where(x < knots[-1], share, 1.0))
    return np.clip((share * (1 << n_bits)).astype(np.int64), 0, (1 << n_bits) - 1)


def z_numbers(columns: Sequence[np.ndarray], knots: Sequence[np.ndarray], n_bits: int) -> np.ndarray:
    """The Z-order numbers of the rows' cells, as ``bits.interleave`` joins them."""
    cells = [_cells(x, k, n_bits) for x, k in zip(columns, knots, strict=True)]
    out = np.zeros(len(cells[0]), np.int64)
    for level in range(n_bits - 1, -1, -1):
        for cell in cells:
            out <<= 1
            out |= (cell >> level) & 1
    return out


def z_column(df: DataFrame, keys: Sequence[str], n_bits: int) -> Column:
    """The Z-order number of a row's cell in a grid that the quantiles of each key cut.

    Cells hold about as many rows each, so a few far values do not crowd the rest together. Numbers are
    made a batch at a time: as expressions they are thousands of calls, too long a method to be compiled.
    """
    doubles = df.select(*[F.col(k).cast("double").alias(f"k{i}") for i, k in enumerate(keys)])
    quantiles = doubles.approxQuantile([f"k{i}" for i in range(len(keys))], [i / KNOTS for i in range(KNOTS + 1)], RANK_ERROR)
    knots = [np.array(q, float) for q in quantiles]

    @F.pandas_udf("long")
    def z(*columns: pd.Series) -> pd.Series:
        return pd.Series(z_numbers([c.to_numpy(float) for c in columns], knots, n_bits))

    return z(*[F.col(k).cast("double") for k in keys])


def write_clustered(df: DataFrame, path: str, keys: Sequence[str], files: int | None = None, n_bits: int | None = None, mode: str = "errorifexists", row_group_bytes: int | None = None) -> None:
    """Parquet whose files and row groups are ranges of Z-order: their statistics are tight in all keys.

    Rows are ordered by the Z-order number of their cell. Rows of one cell are told apart by a hash
    of the whole row, so a cell that holds a third of all rows is spread over files as well.
    Smaller row groups skip more and read in smaller pieces.
    """
    count = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits_each = min(n_bits or 16, 62 // len(keys))
    z, tie = free(df, "_z", "_tie")
    ordered = df.withColumns({z: z_column(df, keys, bits_each), tie: row_hash(df)})
    sorted_rows = ordered.repartitionByRange(count, z, tie).sortWithinPartitions(z, tie).drop(z, tie)
    sorted_rows.write.mode(mode).options(**({"parquet.block.size": row_group_bytes} if row_group_bytes else {})).parquet(path)


def read_points(spark: SparkSession, path: str, keys: Sequence[str], values: Sequence[str] = ()) -> SpatialTable:
    return SpatialTable(spark.read.parquet(path), tuple(keys), tuple(values))


def read_tokens(spark: SparkSession, path: str, names: Sequence[str], separator: str = r"\s+") -> DataFrame:
    """Text lines cut at a separator into double columns; lines with too few tokens give nulls."""
    tokens = F.split(F.trim("value"), separator)
    return spark.read.text(path).select(*[F.get(tokens, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(names)])
