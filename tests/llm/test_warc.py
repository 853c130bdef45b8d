import base64
import hashlib

import duckdb
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cellframe.llm import warc
from cellframe.llm.common import to_many
from cellframe.llm.registry import ORACLES, QUERIES
from cellframe.sources.shared import shared_path


def wanted(rows, least=0):
    keep = {}
    for page_id, _, html in rows:
        if page_id is not None:
            keep[html or ""] = max(keep.get(html or "", page_id), page_id)
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        top = keep.get(html or "")
        response = page_id == top or len(raw) < least
        out.append((page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if response else "revisit", None if response else top))
    return sorted(out, key=repr)


ROWS = [(1, "http://a/", "<p>é</p>"), (2, "http://b/ x\r\ny", "<p>é</p>"), (3, None, None), (4, "u", ""), (None, "u", "<p>é</p>"), (5, "u", "x" * 100_000), (5, "u", "x" * 100_000), (6, "u", "own"), (7, "u", "\r\n\r\nWARC-Type: revisit\r\n")]
COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize("least", [0, 9])
def test_rows(spark, least):
    pages = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, digest int")
    got = warc.archive(pages, least).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == wanted(ROWS, least)
    assert warc.archive(pages.limit(0)).count() == 0


def test_records_and_storage(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    path = shared_path(spark, "test")
    warc.write_archive(pages, path)
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == stored.select("digest").distinct().count() == 5
    records = {r.page_id: r for r in warc.read_records(spark, path).collect() if r.page_id != 5}
    head, body, end = records[2].record.split(b"\r\n\r\n", 2)
    assert b"WARC-Type: response" in head and b"WARC-Target-URI: http://b/%20x%20%20y" in head
    assert records[2].url == "http://b/ x\r\ny" and records[1].url == "http://a/" and records[3].url == "about:blank"
    block = base64.b32encode(hashlib.sha1(body + b"\r\n\r\n" + "<p>é</p>".encode()).digest())
    assert b"WARC-Block-Digest: sha1:" + block + b"\r\n" in head
    assert end == "<p>é</p>".encode() + b"\r\n\r\n"
    length = int(head.split(b"\r\nContent-Length: ")[1])
    assert len(body) + 4 + len("<p>é</p>".encode()) == length
    assert records[1].record.endswith(b"\r\n\r\n\r\n\r\n") and b"WARC-Refers-To: <urn:page:2>" in records[1].record
    assert records[1].payload == "<p>é</p>".encode()


def test_damage_is_noticed(spark):
    path = shared_path(spark, "test")
    warc.write_archive(spark.createDataFrame([(1, "u", "a")], "page_id long, url string, html string"), path)
    heads = spark.read.parquet(f"{path}/headers").collect()
    spark.createDataFrame(heads, "digest string, keep long, head string").withColumn("head", F.regexp_replace("head", "200 OK", "200 Ok")).write.mode("overwrite").parquet(f"{path}/headers")
    with pytest.raises((PySparkException, Py4JJavaError), match="block does not match"):
        warc.read_records(spark, path).collect()
    spark.createDataFrame([(hashlib.sha256(b"a").hexdigest(), 1, b"b")], "digest string, keep long, payload binary").write.mode("overwrite").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "digest", "keep").option("path", f"{path}/payloads").saveAsTable("damaged")
    spark.sql("DROP TABLE damaged")
    with pytest.raises((PySparkException, Py4JJavaError), match="payload does not match"):
        warc.read_records(spark, path).collect()


def test_buckets_follow_the_size(spark, monkeypatch):
    monkeypatch.setattr(warc, "BUCKET_BYTES", 300)
    rows = [(k if k else None, f"u{k}", f"page {k % 25} " * 9) for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = shared_path(spark, "test")
    warc.write_archive(pages, path)
    assert spark.read.parquet(f"{path}/layout").first()[0] == -(-sum(len(html) for _, _, html in rows) // 300)
    assert sorted(map(tuple, warc.read_records(spark, path).select(*COLUMNS).collect()), key=repr) == wanted(rows)


def test_hot_payload(spark):
    """Copies of one payload are many keys, and joins from their heads are salted; nothing moves payloads when reading."""
    rows = [(k, f"u{k}", None if k % 3 else f"own {k}") for k in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    records = warc.archive(pages)
    assert sorted(map(tuple, records.select(*COLUMNS).collect()), key=repr) == wanted(rows)
    assert records.select("record").distinct().count() == 600
    salts = to_many(pages.withColumn("digest", F.lit("x")), spark.createDataFrame([("x", 1)], "digest string, fact int"), "digest", "page_id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = records.select("page_id", "record")._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum("payload#" in line and "Exchange" in line for line in plan.splitlines()) == 0 and "Bucketed: true" in plan
    assert salts.count() == 600 and spark.catalog.listTables() == []


def test_query(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    got = QUERIES["op8_warc"](spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.select(*COLUMNS).collect()), key=repr) == wanted(rows)
    duck = duckdb.connect()
    duck.sql("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.001/pages.parquet'")
    want = duck.sql(ORACLES["op8_warc"])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
