"""The queries of the text operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.llm import bpe, decontaminate, gif, hard_negatives, jaccard, langid, licenses, packing, prefix_trie, secrets, suffix_dedup, token_counts, warc
from cellframe.llm.common import read


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(bpe.roundtrip(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(langid.training_rows(docs))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.deduplicate(read(spark, sf_dir, "documents")))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read(spark, sf_dir, "documents"))


JACCARD_ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda k: array_to_string(w[k:k+4], ' '))) AS s
  FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM words UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT words.doc_id, CAST(coalesce(max(n), 0) AS BIGINT) AS n_shingles, min(reach.b) AS component_id
FROM words LEFT JOIN sizes ON sizes.doc_id = words.doc_id JOIN reach ON reach.a = words.doc_id
GROUP BY words.doc_id"""


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.recognise(read(spark, sf_dir, "documents"))


#: Written from the licence lines that the tables hold, apart from the operator's own tables of
#: sentences and rules; ``licenses.oracle`` restates those, for the tests.
LICENSE_ORACLE = r"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
said AS (
  SELECT doc_id, line_no, CASE
    WHEN regexp_matches(line, '\bLicensed under the Apache License, Version 2\.0\b') THEN 'ApacheGrant2'
    WHEN regexp_matches(line, '\bReleased under the MIT License\b') THEN 'MitReleased'
    WHEN regexp_matches(line, '\blicensed under the GNU General Public License, version 3\b') THEN 'GplVersion3'
    WHEN regexp_matches(line, '\bLicensed under CC BY-NC 4\.0') THEN 'CcByNc4'
    WHEN regexp_matches(line, '(^|[.!?:;] )All rights reserved\.( |$)') THEN 'AllRights' END AS id FROM lines),
names(id, place, name) AS (VALUES ('ApacheGrant2', 1, 'Apache-2.0'), ('GplVersion3', 2, 'GPL-3.0'), ('MitReleased', 3, 'MIT'), ('CcByNc4', 4, 'CC-BY-NC-4.0')),
per_text AS (SELECT doc_id, string_agg(id, ',' ORDER BY line_no) AS ids, count(*) FILTER (WHERE id = 'AllRights') AS n_left FROM said WHERE id IS NOT NULL GROUP BY doc_id),
licensed AS (SELECT doc_id, string_agg(name, ',' ORDER BY place) AS names FROM (SELECT DISTINCT doc_id, place, name FROM said JOIN names USING (id)) GROUP BY doc_id)
SELECT documents.doc_id, coalesce(ids, '') AS sentence_ids, coalesce(names, '') AS licenses, CAST(coalesce(n_left, 0) AS BIGINT) AS n_left
FROM documents LEFT JOIN per_text USING (doc_id) LEFT JOIN licensed USING (doc_id)"""


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and length and digest of each record as it is put together again."""
    records = warc.archive(read(spark, sf_dir, "pages"), min_revisit_bytes=0)
    rebuilt = F.octet_length("record").cast("long").alias("record_bytes"), F.sha2("record", 256).alias("record_sha256")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *rebuilt)


def _base32(hexadecimal: str) -> str:
    return f"array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(((('0x' || substr({hexadecimal}, 1 + 10 * (k // 8), 10))::BIGINT) >> (35 - 5 * (k % 8))) & 31 AS INTEGER), 1) for k in range(32)], '')"


WARC_ORACLE = rf"""
WITH sized AS (SELECT page_id, coalesce(url, 'about:blank') AS url, coalesce(html, '') AS html FROM pages),
kept AS (SELECT html, max(page_id) AS keep FROM sized GROUP BY html),
typed AS (
  SELECT page_id, keep, html, octet_length(encode(html)) AS payload_bytes, page_id IS NOT DISTINCT FROM keep AS own,
    regexp_replace(url, '[\x00-\x20\x7f]', '%20', 'g') AS plain, url, chr(13) || chr(10) AS nl
  FROM sized JOIN kept USING (html)),
http AS (SELECT *, 'HTTP/1.1 200 OK' || nl || 'Content-Type: text/html; charset=utf-8' || nl || 'Content-Length: ' || payload_bytes || nl || nl AS http FROM typed),
block AS (SELECT *, http || CASE WHEN own THEN html ELSE '' END AS block, sha1(html) AS h1, sha1(http || CASE WHEN own THEN html ELSE '' END) AS h2 FROM http),
record AS (
  SELECT *, {_base32("h1")} AS payload_digest,
    'WARC/1.1' || nl || 'WARC-Type: ' || CASE WHEN own THEN 'response' ELSE 'revisit' END || nl || 'WARC-Record-ID: <urn:page:' || page_id || '>' || nl || 'WARC-Date: 2024-01-01T00:00:00Z' || nl
    || 'WARC-Target-URI: ' || plain || nl || CASE WHEN plain <> url THEN 'X-Exact-URI: ' || base64(encode(url)) || nl ELSE '' END
    || 'WARC-Payload-Digest: sha1:' || {_base32("h1")} || nl || 'WARC-Block-Digest: sha1:' || {_base32("h2")} || nl
    || CASE WHEN own THEN '' ELSE 'WARC-Refers-To: <urn:page:' || keep || '>' || nl || 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' || nl END
    || 'Content-Type: application/http; msgtype=response' || nl || 'Content-Length: ' || octet_length(encode(block)) || nl || nl || block || nl || nl AS record
  FROM block)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN own THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN NOT own THEN keep END AS refers_to, CAST(octet_length(encode(record)) AS BIGINT) AS record_bytes, sha256(record) AS record_sha256
FROM record"""


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_table(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")


def op10_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.read_media(gif.store_texts(read(spark, sf_dir, "documents")))


def rebuilt(lines: DataFrame) -> DataFrame:
    """Conversation c with the first crc32(c) % 4 turns of conversation c - c % 20 in the place of its own."""
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    heads = lines.select(F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("head"))
    own = lines.withColumn("base", F.col("conv_id") - F.col("conv_id") % 20)
    head = F.coalesce(F.slice("head", F.lit(1), h), F.slice("turns", 1, 0))
    return own.join(heads, "base", "left").select("conv_id", F.concat(head, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(rebuilt(prefix_trie.turns(read(spark, sf_dir, "conversations"))))


TRIE_ORACLE = r"""
WITH own AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
crc AS (
  SELECT conv_id, xor(list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), CAST(4294967295 AS BIGINT)) % 4 AS h
  FROM own),
built AS (
  SELECT o.conv_id AS c, list_concat(coalesce(b.t[1:h], []), o.t[h + 1:]) AS p
  FROM own o JOIN crc USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
nodes AS (
  SELECT depth, p[1:depth] AS k, min(c) AS conv_id, count(*) AS n_convs, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE len(p) = depth) AS ends
  FROM (SELECT c, p, unnest(range(0, len(p) + 1)) AS depth FROM built) GROUP BY 1, 2),
tree AS (
  SELECT n.*, q.conv_id AS parent_conv_id,
    (n.n_convs - 1) * CASE WHEN n.depth = 0 THEN 0 ELSE len(regexp_extract_all(n.k[n.depth].t, '[^ 	-
]+')) END AS saved
  FROM nodes n LEFT JOIN nodes q ON q.depth = n.depth - 1 AND q.k = n.k[1:n.depth - 1]),
kids AS (SELECT depth - 1 AS depth, parent_conv_id AS conv_id, count(*) AS n_children FROM tree WHERE depth > 0 GROUP BY 1, 2),
counted AS (SELECT t.*, coalesce(n_children, 0) AS n_children FROM tree t LEFT JOIN kids USING (depth, conv_id)),
above AS (SELECT a AS depth, k[1:a] AS k, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM counted) GROUP BY 1, 2)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM counted JOIN above USING (depth, k)"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "embeddings")
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table.select("vec_id", whole.alias("embedding"), label.alias("label")), F.col("vec_id") % 50 == 0)


HARD_NEGATIVES_ORACLE = """
WITH part AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM part a JOIN part b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
found AS (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 3"""


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2).pieces()


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_language_id": op2_language_id,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_license_scan": op6_license_scan,
    "op7_token_counts": op7_token_counts,
    "op8_warc": op8_warc,
    "op9_secret_scan": op9_secret_scan,
    "op10_gif_media": op10_gif_media,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_packing": op13_packing,
}

ORACLES: dict[str, str] = {
    "op3_suffix_dedup": suffix_dedup.ORACLE,
    "op4_decontaminate": decontaminate.ORACLE,
    "op5_jaccard_join": JACCARD_ORACLE,
    "op6_license_scan": LICENSE_ORACLE,
    "op8_warc": WARC_ORACLE,
    "op11_prefix_trie": TRIE_ORACLE,
    "op12_hard_negatives": HARD_NEGATIVES_ORACLE,
}
