"""Stored tables that change: immutable Parquet files, and a manifest of their bounds for every version.

A table is a folder of ``data`` (Parquet files clustered by the keys, never changed), ``manifests``
(for each version a table of blocks: file, rows, bounds of the keys) and ``versions``: one small
file for each version, which names its manifest. A change finds the files whose bounds its
keys meet, writes what becomes of their rows to new files, then a manifest, and last, by one
atomic rename, the version. So readers of a version never see anything else, whatever happens
meanwhile, and a change that breaks off leaves files that nothing names. One writer at a time is
meant; of two that start from the same version, the second one to publish fails.

A block is up to ``BLOCK`` consecutive rows of a file. Queries ask the manifest first: files
without a block that can matter are not opened, and in the others the blocks' bounds are pushed to
the scan, where row group statistics rule out the rest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cellframe.functions.metrics import L2, Metric
from cellframe.operators import mutate
from cellframe.operators.joins import window_join
from cellframe.operators.tables import SpatialTable, conjunction
from cellframe.sources.clustered import write_clustered
from cellframe.sources.shared import written

#: Rows of a block, blocks of a manifest that the driver keeps, and boxes that are pushed to a scan, at most.
BLOCK, KEPT, BOXES = 1 << 16, 10_000, 24


class VersionConflict(Exception):
    """Another writer has published the version."""


class Folder:
    """The few calls to the file system that hold a version together; any that Spark can write to."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def names(self, name: str) -> list[str]:
        return [x.getPath().getName() for x in self._fs.listStatus(self._at(name))] if self._fs.exists(self._at(name)) else []

    def text(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """A file that is there whole or not at all, and never replaces one."""
        hidden = f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        stream = self._fs.create(self._at(hidden), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        kind = self._jvm.org.apache.hadoop.fs.Options.Rename
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(self._at("")).toUri(), self._conf)
        try:
            context.rename(self._fs.makeQualified(self._at(hidden)), self._fs.makeQualified(self._at(name)), self._gateway.new_array(kind, 0))
        except Exception as e:
            self._fs.delete(self._at(hidden), False)
            if "FileAlreadyExists" in str(e):
                raise VersionConflict(name) from e
            raise

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


def _bounds(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(file, block, n_rows, lo0 ..., hi0 ...) of files below ``data``."""
    by = frame.groupBy(F.col("_metadata.file_path").alias("file"), F.floor(F.col("_metadata.row_index") / BLOCK).cast("int").alias("block"))
    ends = [f(k).alias(f"{c}{i}") for c, f in (("lo", F.min), ("hi", F.max)) for i, k in enumerate(keys)]
    # the name is cut out once a block, not once a row
    return by.agg(F.count("*").alias("n_rows"), *ends).withColumn("file", F.regexp_extract("file", r"(data/[0-9a-f]+/[^/]+)$", 1))


@dataclass(frozen=True)
class StoredTable:
    """One version of a stored table; changes give the next one."""

    spark: SparkSession
    path: str
    version: int
    keys: tuple[str, ...]
    schema: StructType
    manifest: str
    note: dict = field(default_factory=dict)
    n_blocks: int = 0
    row_group_bytes: int | None = None
    whole_keys: bool = False

    # --- versions ---

    @classmethod
    def create(cls, df: DataFrame, path: str, keys: Sequence[str], files: int | None = None, row_group_bytes: int | None = None, note: dict | None = None, whole_keys: bool = False) -> StoredTable:
        """Version 0 of a new table; with ``whole_keys``, files are ranges of whole key values in place of Z-order."""
        empty = cls(df.sparkSession, path.rstrip("/"), -1, tuple(keys), df.schema, "", row_group_bytes=row_group_bytes, whole_keys=whole_keys)
        return empty._next(None, df, files, note)

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None) -> StoredTable:
        """A version, the latest unless one is named; raises ``FileNotFoundError`` if there is none."""
        folder = Folder(spark, path)
        there = cls.versions(spark, path)
        if not there or (version is not None and version not in there):
            raise FileNotFoundError(f"{path}, version {version}")
        number = there[-1] if version is None else version
        said = json.loads(folder.text(f"versions/{number:012d}"))
        schema = StructType.fromJson(said["schema"])
        return cls(spark, path.rstrip("/"), number, tuple(said["keys"]), schema, said["manifest"], said["note"], said["n_blocks"], said["row_group_bytes"], said["whole_keys"])

    @staticmethod
    def versions(spark: SparkSession, path: str) -> list[int]:
        return sorted(int(n) for n in Folder(spark, path).names("versions") if n.isdigit())

    @cached_property
    def blocks(self) -> DataFrame:
        """(file, block, n_rows, lo0 ..., hi0 ...); small manifests are kept by the driver, so that asking them starts no job."""
        if not self.manifest:
            keyed = [f"{c}{i} {self.schema[k].dataType.simpleString()}" for c in ("lo", "hi") for i, k in enumerate(self.keys)]
            return self.spark.createDataFrame([], ", ".join(["file string, block int, n_rows long", *keyed]))
        table = self.spark.read.parquet(f"{self.path}/{self.manifest}")
        return self.spark.createDataFrame(table.toArrow()) if self.n_blocks <= KEPT else table

    def vacuum(self, keep: int = 1) -> None:
        """Deletes what none of the last ``keep`` versions names; the writer's call."""
        folder, there = Folder(self.spark, self.path), self.versions(self.spark, self.path)
        for number in there[:-keep]:
            folder.delete(f"versions/{number:012d}")
        held = [StoredTable.open(self.spark, self.path, number) for number in there[-keep:]]
        files = reduce(DataFrame.unionByName, [t.blocks.select("file") for t in held]).distinct()
        named = {r[0] for r in files.collect()}
        folders = {f.rpartition("/")[0] for f in named}
        for one in folder.names("data"):
            if f"data/{one}" not in folders:
                folder.delete(f"data/{one}")
            else:
                for f in folder.names(f"data/{one}"):
                    if f.endswith(".parquet") and f"data/{one}/{f}" not in named:
                        folder.delete(f"data/{one}/{f}")
        for one in folder.names("manifests"):
            if f"manifests/{one}" not in {t.manifest for t in held}:
                folder.delete(f"manifests/{one}")

    # --- changes ---

    def _next(self, gone: list[str] | None, rows: DataFrame, files: int | None, note: dict | None) -> StoredTable:
        """Writes new files, then the manifest, then the version: ``gone`` files are no part of it."""
        folder, name = Folder(self.spark, self.path), uuid.uuid4().hex
        if self.whole_keys:
            # more parts than keys to a file, so that few keys share one
            parts = 4 * (files or int(self.spark.conf.get("spark.sql.shuffle.partitions")))
            rows.repartitionByRange(parts, *self.keys).sortWithinPartitions(*self.keys).write.parquet(f"{self.path}/data/{name}")
        else:
            write_clustered(rows, f"{self.path}/data/{name}", self.keys, files, row_group_bytes=self.row_group_bytes)
        new = self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{name}")
        blocks = _bounds(new, self.keys)
        if gone is not None:
            out = self.spark.createDataFrame([(f,) for f in gone], "file string")
            blocks = self.blocks.join(out, "file", "left_anti").unionByName(blocks)
        blocks.coalesce(1).write.parquet(f"{self.path}/manifests/{name}")
        count = self.spark.read.parquet(f"{self.path}/manifests/{name}").count()
        said = {"manifest": f"manifests/{name}", "schema": self.schema.jsonValue(), "keys": list(self.keys), "note": note or {}, "n_blocks": count, "row_group_bytes": self.row_group_bytes, "whole_keys": self.whole_keys}
        folder.publish(f"versions/{self.version + 1:012d}", json.dumps(said))
        return StoredTable(self.spark, self.path, self.version + 1, self.keys, self.schema, said["manifest"], said["note"], count, self.row_group_bytes, self.whole_keys)

    def touched(self, keys: DataFrame) -> list[str]:
        """The files whose bounds meet any of these keys; names of files alone reach the driver."""
        lows, highs = ([f"{c}{i}" for i in range(len(self.keys))] for c in ("lo", "hi"))
        points = keys.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(self.keys)])
        met = window_join(points, self.blocks.select("file", *lows, *highs), [f"k{i}" for i in range(len(self.keys))], lows, highs)
        return sorted(r[0] for r in met.select("file").distinct().collect())

    def rewrite(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame], note: dict | None = None) -> StoredTable:
        """The next version, in which the rows of all files that ``keys`` meet are what ``change`` makes of them."""
        gone = self.touched(keys)
        rows = written(change(self._read(gone)).select(*self.schema.names), "changed")
        blocks = self.blocks.agg(F.sum("n_rows"), F.count_distinct("file")).first()
        each = max(1, (blocks[0] or 0) // max(1, blocks[1]))
        return self._next(gone, rows, max(1, -(-rows.count() // each)) if blocks[1] else None, note)

    def put(self, changes: DataFrame, sequence: str | None = None, note: dict | None = None) -> StoredTable:
        """Upsert; as ``mutate.put``."""
        return self.rewrite(mutate.keyed(changes, self.keys), lambda held: mutate.put(held, changes, self.keys, sequence), note)

    def remove(self, gone: DataFrame, note: dict | None = None) -> StoredTable:
        """Without the keys of ``gone``; as ``mutate.remove``."""
        return self.rewrite(mutate.keyed(gone, self.keys), lambda held: mutate.remove(held, gone.select(*self.keys), self.keys), note)

    def move(self, moves: DataFrame, new_keys: Sequence[str], on_conflict: str = "reject", note: dict | None = None) -> StoredTable:
        """Entries at new keys; as ``mutate.move``. Files that hold an old key or may hold a new one are looked at."""
        both = moves.select(*self.keys).unionByName(moves.select(*[F.col(n).alias(k) for k, n in zip(self.keys, new_keys, strict=True)]))
        return self.rewrite(mutate.keyed(both, self.keys), lambda held: mutate.move(held, moves, self.keys, new_keys, on_conflict), note)

    # --- queries ---

    def _read(self, files: Sequence[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in files])

    def read(self) -> DataFrame:
        """All rows of this version."""
        return self._read(sorted(r[0] for r in self.blocks.select("file").distinct().collect()))

    def table(self) -> SpatialTable:
        return SpatialTable(self.read(), self.keys, tuple(c for c in self.schema.names if c not in self.keys))

    def _among(self, blocks: Sequence[Row]) -> DataFrame:
        """The rows of these blocks, with some of those around them: their files alone, filtered by boxes that cover the blocks.

        A box covers blocks that follow each other, so it is about as tight as theirs. Rows with a null key are left out.
        """
        if not blocks:
            return self._read([])
        seen, d = sorted(blocks, key=lambda r: (r["file"], r["block"])), len(self.keys)
        step = -(-len(seen) // BOXES)
        boxes = []
        for at in range(0, len(seen), step):
            some = seen[at : at + step]
            spans = [(min(r[f"lo{i}"] for r in some), max(r[f"hi{i}"] for r in some)) for i in range(d)]
            boxes.append(" AND ".join(f"`{k}` BETWEEN {self._sql(k, a)} AND {self._sql(k, b)}" for k, (a, b) in zip(self.keys, spans, strict=True)))
        return self._read(sorted({r["file"] for r in seen})).filter(" OR ".join(f"({box})" for box in boxes))

    def _sql(self, key: str, value) -> str:
        """A bound as SQL text: hundreds of them are one call, not hundreds."""
        return f"CAST({json.dumps(str(value))} AS {self.schema[key].dataType.simpleString()})"

    def _picked(self, meets: Column) -> list[Row]:
        """The blocks that a condition on their bounds leaves; of very many, one for each file."""
        blocks = self.blocks.filter(meets)
        if self.n_blocks > KEPT:
            ends = [(F.min if c == "lo" else F.max)(f"{c}{i}").alias(f"{c}{i}") for c in ("lo", "hi") for i in range(len(self.keys))]
            if blocks.limit(KEPT + 1).count() > KEPT:
                blocks = blocks.groupBy("file").agg(F.min("block").alias("block"), *ends)
        return blocks.collect()

    def region(self, meets: Callable[[list[Column], list[Column]], Column], inside: Callable[[list[Column]], Column]) -> DataFrame:
        """Rows in a region of any form.

        ``meets`` says of a box, given by the columns of its lower and upper bounds, whether the region
        can reach into it; blocks for which it is false are not read. ``inside`` decides about a row.
        """
        lows, highs = ([F.col(f"{c}{i}") for i in range(len(self.keys))] for c in ("lo", "hi"))
        return self._among(self._picked(meets(lows, highs))).filter(inside([F.col(k) for k in self.keys]))

    def window(self, low: Sequence, high: Sequence) -> DataFrame:
        """Rows in [low, high], from the files whose bounds meet it."""
        meets = lambda lows, highs: conjunction([(a <= F.lit(h)) & (b >= F.lit(lo)) for a, b, lo, h in zip(lows, highs, low, high, strict=True)])
        return self.region(meets, lambda keys: conjunction([k.between(F.lit(lo), F.lit(h)) for k, lo, h in zip(keys, low, high, strict=True)]))

    def nearest(self, n: int, center: Sequence, metric: Metric | None = None) -> DataFrame:
        """The ``n`` nearest entries with ``dist``, as ``SpatialTable.nearest``, best blocks first.

        Blocks are taken in the order of their distance, twice as many each time, until those hold
        ``n`` entries. The n-th distance among them is the radius of a ball whose blocks are read.
        Entries without a distance, or at a NaN one, need the whole table where others are too few.
        """
        metric = metric or L2()
        if n <= 0 or not metric.by_gaps:
            return self.table().nearest(n, center, metric)
        gaps = []
        for i, c in enumerate(center):
            low, high = (F.col(f"{e}{i}").cast("double") for e in ("lo", "hi"))
            gaps.append(F.greatest(low - F.lit(float(c)), F.when(~F.isnan(high), F.lit(float(c)) - high).otherwise(0.0), F.lit(0.0)))
        far = metric.distance(gaps, [F.lit(0.0)] * len(gaps)).alias("gap")
        ordered = self.blocks.select("*", far).filter(F.col("gap").isNotNull()).orderBy("gap", "file", "block")
        first = ordered.limit(KEPT).collect()
        take, radius = 1, None
        while radius is None:
            while take < len(first) and sum(r["n_rows"] for r in first[:take]) < n:
                take *= 2
            found = SpatialTable(self._among(first[:take]), self.keys).nearest(n, center, metric).agg(F.count("*"), F.max("dist")).first()
            if found[0] == n and found[1] == found[1]:
                radius = found[1]
            elif take >= len(first):
                return self.table().nearest(n, center, metric)
            take *= 2
        # bounds of gaps are rounded as distances are: a little more than the radius is sure
        sure = radius * (1 + 1e-9)
        whole = len(first) < KEPT or first[-1]["gap"] > sure
        blocks = [r for r in first if r["gap"] <= sure] if whole else self._picked(metric.distance(gaps, [F.lit(0.0)] * len(gaps)) <= sure)
        own = tuple(c for c in self.schema.names if c not in self.keys)
        return SpatialTable(self._among(blocks), self.keys, own).within(center, radius, metric).orderBy("dist", *self.keys, *own).limit(n)
