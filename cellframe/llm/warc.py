"""Content-addressed web archive.

Payload bytes are stored once for each strong digest (SHA-256, checked again when they
are read), exact record headers are stored apart, and records are put together again by
joining the two. A header states the digests of its payload and of its whole block, both
taken before anything is stored; a record that comes back with another one raises.
Everything is DataFrame expressions.

Payloads are a table bucketed by digest and response, so putting records together moves
heads to the payloads and not the other way. A payload that a third of all pages have is no
hot key: its copies are left out by keys that differ (digest and page), and joins from
its many heads are salted (``to_many``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.llm.chunks import forgotten
from cellframe.llm.common import to_many, written
from cellframe.sources.shared import shared_path

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
#: Stands for a null page_id in the columns that records are joined on.
NO_PAGE = -(1 << 63)
#: Payloads have a bucket for each shuffle partition, and at least one for so many bytes.
BUCKET_BYTES = 128_000_000


def base32(digits: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hexadecimal: eight characters from each ten digits.

    Give it a column, not an expression: it is used many times over.
    """
    parts = []
    for start in range(1, 41, 10):
        number = F.conv(F.substring(digits, start, 10), 16, 10).cast("long")
        parts += [F.substring(F.lit(BASE32), F.shiftright(number, shift).bitwiseAND(31).cast("int") + 1, 1) for shift in range(35, -1, -5)]
    return F.concat(*parts)


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def _plain(url: Column) -> Column:
    """The URL as a header line can hold it: white space and control characters as one sign each."""
    return F.regexp_replace(F.coalesce(url, F.lit("about:blank")), r"[\x00-\x20\x7f]", "%20")


def _http(payload_bytes: Column) -> Column:
    return F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), payload_bytes.cast("string"), F.lit(CRLF * 2))


def _head(record: Column, date: str) -> Column:
    http, url = _http(record["payload_bytes"]), record["url"]
    is_revisit = record["record_type"] == "revisit"
    block = F.octet_length(http) + F.when(is_revisit, F.lit(0)).otherwise(record["payload_bytes"])
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), record["record_type"]),
        F.concat(F.lit("WARC-Record-ID: "), _urn(record["page_id"])),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), _plain(url)),
        F.when(_plain(url) != url, F.concat(F.lit("X-Exact-URI: "), F.base64(url.cast("binary")))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(record["payload_sha1"])),
        F.concat(F.lit("WARC-Block-Digest: sha1:"), base32(F.when(is_revisit, record["http_sha1"]).otherwise(record["block_sha1"]))),
        F.when(is_revisit, F.concat(F.lit("WARC-Refers-To: "), _urn(record["keep"]))),
        F.when(is_revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), block.cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), http)  # concat_ws leaves nulls out


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes ``path``/headers (one exact head for each row), ``path``/payloads (each payload once) and ``path``/layout.

    Among rows with equal payloads of at least ``min_revisit_bytes`` bytes the largest
    page_id is the response and the others revisit it; below that size all are responses.
    A null html is an empty payload, a null url ``about:blank``; a url that a header line
    cannot hold is kept exactly beside its plain form. A null page_id never is
    the response of a group that has other ids. Repeated rows of the largest page_id all
    are responses; their payload still is stored once. Other columns are left out.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    size = F.octet_length("payload").cast("long")
    http = _http(size).cast("binary")
    digests = F.sha2("payload", 256).alias("digest"), F.sha1("payload").alias("payload_sha1"), F.sha1(F.concat(http, F.col("payload"))).alias("block_sha1"), F.sha1(http).alias("http_sha1")
    digested = written(page.select("page_id", "url", *digests, size.alias("payload_bytes")), "warc-digests")
    each = digested.groupBy("digest", "page_id").agg(F.count("*").alias("copies"))
    kept = each.groupBy("digest").agg(F.max(F.struct("page_id", "copies")).alias("top")).select("digest", F.col("top.page_id").alias("keep"), F.col("top.copies").alias("copies"))

    is_response = F.col("page_id").eqNullSafe(F.col("keep")) | (F.col("payload_bytes") < min_revisit_bytes)
    records = to_many(digested, kept.drop("copies"), "digest", "page_id").withColumn("record_type", F.when(is_response, "response").otherwise("revisit"))
    row = F.struct("page_id", "url", "payload_sha1", "block_sha1", "http_sha1", "payload_bytes", "record_type", "keep")
    records.withColumn("row", row).select("digest", F.coalesce("keep", F.lit(NO_PAGE)).alias("keep"), _head(F.col("row"), date).alias("head")).write.parquet(f"{path}/headers")

    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chosen = page.select(F.sha2("payload", 256).alias("digest"), F.coalesce("page_id", F.lit(NO_PAGE)).alias("keep"), "payload")
    wanted = -(-(digested.agg(F.sum("payload_bytes")).first()[0] or 0) // BUCKET_BYTES)
    if wanted > buckets:
        buckets, chosen = wanted, chosen.repartition(wanted, "digest", "keep")
    stored = chosen.join(kept.select("digest", F.coalesce("keep", F.lit(NO_PAGE)).alias("keep")), ["digest", "keep"], "left_semi")
    if not kept.filter("copies > 1").isEmpty():
        stored = stored.dropDuplicates(["digest", "keep"])
    name = f"payloads_{uuid.uuid4().hex}"
    stored.write.bucketBy(buckets, "digest", "keep").option("path", f"{path}/payloads").saveAsTable(name)
    forgotten(spark, name)
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{path}/layout")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """(digest, keep, payload): the stored payloads, in their buckets."""
    buckets = spark.read.parquet(f"{path}/layout").first()[0]
    name = f"payloads_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (digest STRING, keep BIGINT, payload BINARY) USING parquet CLUSTERED BY (digest, keep) INTO {buckets} BUCKETS LOCATION '{path}/payloads'")
    return forgotten(spark, name)


def _checked(stated: Column, found: Column, what: str) -> Column:
    return F.when(stated == found, found).otherwise(F.raise_error(F.concat(F.lit(f"{what} does not match digest "), stated)))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The archive's records: parsed fields, and ``record``, the bytes of the original record.

    A payload or block whose bytes no longer give their digests raises. Only the columns
    that are asked for are moved: without ``record`` and ``payload`` the join is of digests.
    """
    # digest and keep stay as they are stored: the join needs no other placing of payloads than their buckets
    stored = payloads(spark, path).withColumns({"sha2": F.sha2("payload", 256), "sha1": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    sound = F.when(F.col("sha2") == F.col("digest"), base32(F.col("sha1"))).otherwise(F.raise_error(F.concat(F.lit("payload does not match digest "), F.col("digest"))))
    stored = stored.select("digest", "keep", "payload", "payload_bytes", sound.alias("payload_digest"))
    heads = spark.read.schema("digest string, keep long, head string").parquet(f"{path}/headers")
    field = lambda name, form: F.regexp_extract("head", rf"\r\n{name}: {form}\r\n", 1)
    exact = field("X-Exact-URI", "([A-Za-z0-9+/=]*)")
    page = heads.select(
        "digest",
        "keep",
        "head",
        F.expr("try_cast(regexp_extract(head, 'WARC-Record-ID: <urn:page:([^>]*)>', 1) AS BIGINT)").alias("page_id"),
        field("WARC-Type", "([a-z]+)").alias("record_type"),
        F.when(exact != "", F.unbase64(exact).cast("string")).otherwise(field("WARC-Target-URI", r"(\S*)")).alias("url"),
        F.expr("try_cast(regexp_extract(head, 'WARC-Refers-To: <urn:page:([^>]*)>', 1) AS BIGINT)").alias("refers_to"),
        field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)").alias("stated_digest"),
        field("WARC-Block-Digest", "sha1:([A-Z2-7]+)").alias("block_digest"),
    )
    http = F.regexp_extract("head", r"(?s)\r\n\r\n(.*)$", 1).cast("binary")
    responses = page.filter("record_type = 'response'").join(stored, ["digest", "keep"])
    responses = responses.withColumn("block", F.concat(http, F.col("payload")))
    revisits = to_many(page.filter("record_type = 'revisit'"), stored.drop("keep"), "digest", "page_id").withColumn("block", http)
    joined = responses.unionByName(revisits).withColumn("block_sha1", F.sha1("block"))
    before = F.regexp_extract("head", r"(?s)^(.*?\r\n\r\n)", 1).cast("binary")
    block = F.when(base32(F.col("block_sha1")) == F.col("block_digest"), F.col("block")).otherwise(F.raise_error(F.concat(F.lit("block does not match digest "), F.col("block_digest"))))
    return joined.select("page_id", "url", "record_type", "refers_to", "payload_bytes", _checked(F.col("stated_digest"), F.col("payload_digest"), "payload").alias("payload_digest"), "payload", F.concat(before, block, F.lit(CRLF * 2).cast("binary")).alias("record"))


def archive(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes the pages to an archive in the shared folder and reads its records back."""
    path = shared_path(pages.sparkSession, "warc")
    write_archive(pages, path, min_revisit_bytes)
    return read_records(pages.sparkSession, path)
