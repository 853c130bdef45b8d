"""Moving objects: a stream of positions kept as a table of the latest one of each object."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cellframe.functions.names import free
from cellframe.operators.mutate import put
from cellframe.sources.stored import StoredTable


def latest(events: DataFrame, key: str, time: str) -> DataFrame:
    """The newest row of each key, as one map-side combined aggregation."""
    rest = [c for c in events.columns if c != key]
    newest = events.groupBy(key).agg(F.max(F.struct(time, *[c for c in rest if c != time])).alias("_r"))
    return newest.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*events.columns)


def maintain(events: DataFrame, key: str, time: str, load: Callable[[], DataFrame | None], store: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Upserts each micro-batch into the table that ``load`` gives and ``store`` keeps.

    A batch may be given twice after a failure; upserts of the newest rows make no
    difference then. A late row never replaces a newer one.
    """

    def apply(batch: DataFrame, number: int) -> None:
        table = load()
        new = latest(batch, key, time)
        if table is not None:
            held = table.select(F.col(key), F.col(time).alias("_held"))
            fresh = new.join(held, key, "left").filter(F.col("_held").isNull() | (F.col(time) >= F.col("_held"))).drop("_held")
            new = put(table, fresh, [key])
        store(new, number)

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def maintain_buckets(events: DataFrame, key: str, time: str, path: str, buckets: int, checkpoint: str, keep: int = 2) -> StreamingQuery:
    """As ``maintain``, on a stored table in ``buckets`` by the key's hash.

    A micro-batch reads and rewrites the files of the buckets that its keys fall in and no others,
    and is published as one version that names its number. A driver lost at any step leaves the
    version before, and the batch is given again to that; one that is given again after it was
    published changes nothing. The last ``keep`` versions stay.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        (bucket,) = free(batch, "bucket")
        new = latest(batch, key, time).withColumn(bucket, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        if not StoredTable.versions(spark, path):
            StoredTable.create(new, path, [bucket], files=buckets, note={"batch": number}, whole_keys=True)
            return
        table = StoredTable.open(spark, path)
        if table.note["batch"] >= number:
            return
        table.rewrite(new, lambda held: latest(held.unionByName(new), key, time), {"batch": number})
        StoredTable.vacuum(table, keep)

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_buckets(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that ``maintain_buckets`` keeps, its bucket column included; None before the first batch."""
    return StoredTable.open(spark, path).read() if StoredTable.versions(spark, path) else None


def windowed_counts(events: DataFrame, time: str, late: str, width: str, *groups: str) -> DataFrame:
    """Counts of a stream in event-time windows, with a watermark; for ``keep_updates``, or append mode."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *groups).agg(F.count("*").alias("n"))


def keep_updates(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's changed rows below ``path``, so that state behind the watermark goes and no batch writes the rest again.

    A batch that is given twice writes over its own folder.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return counts.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_updates(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Each key's row of the last batch that changed it; tasks keep one row a key before anything is shuffled."""
    every = spark.read.parquet(path)
    rest = [c for c in every.columns if c not in keys and c != "batch"]
    last = every.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])
