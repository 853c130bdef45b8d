"""Adapters for callers' Python functions: Arrow-batched, for what no Column expression can say.

Column builders come first everywhere (filters, projections, metrics, encodings); these
stop the optimiser and cost a copy of the columns they are given.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.functions.metrics import Custom


def predicate(test: Callable[..., pd.Series]) -> Callable[..., Column]:
    """A filter from a function of key and value series to booleans; null counts as false."""

    @F.pandas_udf("boolean")
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series(test(*columns)).astype("boolean")

    return lambda *columns: F.coalesce(run(*columns), F.lit(False))


def metric(distance: Callable[[Sequence[pd.Series], Sequence[pd.Series]], pd.Series], dims: int) -> Custom:
    """A metric from a function of (point series, centre series); it has no bounding box."""

    @F.pandas_udf("double")
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series(distance(columns[:dims], columns[dims:])).astype("float64")

    return Custom(lambda point, center: run(*[c.cast("double") for c in (*point, *center)]))


def mapped(entries: DataFrame, convert: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A result mapper: entries to rows of ``schema``, batch by batch; a batch may shrink or grow."""

    def run(batches):
        for batch in batches:
            yield convert(batch)

    return entries.mapInPandas(run, schema)
