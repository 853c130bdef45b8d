"""A corpus pipeline of five operators, each on what the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``. Stages written as tables in between behave alike.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.functions.names import free
from cellframe.llm import bpe, decontaminate, jaccard, langid, secrets
from cellframe.llm.common import read, written

TOKENS = "byte_bpe_multi_50k.tiktoken"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language (no text, or no letter in it) go."""
    return langid.identified(docs, langid.fit(langid.training_rows(docs)))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays: that with the smallest doc_id.

    A document without an id cannot be grouped and stays. Where a doc_id repeats, rows are
    grouped instead: of each group of rows with linked texts one stays, so a doc_id keeps
    as many rows as it leads groups, and of its rows without a word one stays. For that the
    documents are written once more, with row numbers.
    """
    repeats = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1")
    if not repeats.isEmpty():
        return one_row_a_group(docs)
    gone = jaccard.near_duplicates(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def one_row_a_group(docs: DataFrame) -> DataFrame:
    """The row with the smallest doc_id, then content, of each group of linked rows; rows without an id stay."""
    (row,) = free(docs, "row")
    rows = written(docs.filter("doc_id IS NOT NULL").withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = jaccard.near_duplicates(rows, row).select(F.col("doc_id").alias("at"), "n_shingles", "component_id")
    content = F.sha2(F.to_json(F.struct(*docs.columns)), 256)
    placed = rows.select(F.col(row).alias("at"), "doc_id", content.alias("content")).join(groups, "at")
    worded = F.col("n_shingles") > 0
    keys = [F.when(worded, F.col("component_id")).alias("component"), F.when(~worded, F.col("doc_id")).alias("blank")]
    kept = placed.groupBy(*keys).agg(F.min(F.struct("doc_id", "content", "at")).alias("first")).select(F.col("first.at").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; null and empty texts contain none and stay."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay; their secrets are replaced and n_chars is brought up to date. Null and empty texts stay as they are."""
    return secrets.redact(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, packed): the encoded corpus; a null or empty text has no ids."""
    path = public_tokenizers.path(TOKENS)
    coded = bpe.roundtrip(docs, path, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        (F.octet_length("packed") / 4).cast("long").alias("n_tokens"),
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "packed",
    )


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("byte_bpe", byte_bpe),
]

#: The first stage is a trained classifier and the second a transitive closure over hashed sets; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage before it returns is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
