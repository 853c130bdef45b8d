"""Places of rows in a total order, without a single task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.functions.names import free
from cellframe.plans.skew import row_hash
from cellframe.sources.shared import written

#: Bits of ``monotonically_increasing_id`` that number the rows of a partition.
ROW_BITS = 33


def places(df: DataFrame, order: Sequence[str], name: str = "place", parts: int | None = None) -> DataFrame:
    """The rows with their place, from 1 on, in ascending order of the columns ``order``.

    Rows are range-partitioned and sorted, and written once to the shared folder with the number
    of their part and their number in it; a place is that number and the sizes of the parts
    before, of which one number a part reaches the driver. Ties take places in any order, and are
    told apart by a hash of the row, so that a value that a third of all rows have is cut into
    parts too unless the rows are equal altogether.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie, number = free(df, "_tie", "_number")
    ranged = df.withColumn(tie, row_hash(df)).repartitionByRange(parts, *order, tie).sortWithinPartitions(*order, tie).drop(tie)
    cut = written(ranged.withColumn(number, F.monotonically_increasing_id()), "ranged")
    part = F.shiftright(number, ROW_BITS).cast("int")
    sizes = {r[0]: r[1] for r in cut.groupBy(part.alias("part")).count().collect()}
    before, offsets = 0, []
    for k in range(max(sizes, default=-1) + 1):
        offsets.append(before)
        before += sizes.get(k, 0)
    offset = F.get(F.array(*[F.lit(o).cast("long") for o in offsets]), part) if offsets else F.lit(0)
    return cut.withColumn(name, F.col(number).bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + 1 + offset).select(*df.columns, name)
