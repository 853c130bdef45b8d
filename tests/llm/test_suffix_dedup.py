import hashlib
import random

import numpy as np

from cellframe.llm import chunks, suffix_dedup
from cellframe.llm.registry import QUERIES


def brute(rows):
    """(bytes, removed flags) of each row, straight from the definition."""
    least = {}
    for i, text in rows:
        raw = (text or "").encode()
        for a in range(len(raw) - 49) if i is not None else ():
            key = raw[a : a + 50]
            least[key] = min(least.get(key, i), i)
    out = []
    for i, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for a in range(len(raw) - 49) if i is not None else ():
            if least[raw[a : a + 50]] < i:
                gone[a : a + 50] = True
        out.append((raw, gone))
    return out


def wanted(rows):
    out = []
    for (i, _), (raw, gone) in zip(rows, brute(rows), strict=True):
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((i, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(spark, frame):
    return sorted(map(tuple, suffix_dedup.digests(suffix_dedup.deduplicate(frame)).collect()), key=repr)


def test_awkward_rows(spark):
    rng = random.Random(1)
    words = ["alpha", "béta", "gamma", "δέλτα", "the", "of", "a"]
    base = [" ".join(rng.choices(words, k=80)) for _ in range(6)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(100 + k, base[k % 6][rng.randrange(200) :][:150] + "x" + base[(k + 1) % 6][: rng.randrange(40, 120)]) for k in range(40)]
    rows += [(None, base[0]), (500, None), (501, ""), (502, "a" * 400), (503, "a" * 60), (504, "ab" * 90), (504, "ab" * 90), (505, "a" * 49), (-3, base[2])]
    rows += [(600 + k, base[3]) for k in range(30)] + [(700, "x" * 30_000 + base[4])]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, chunk string")
    assert got(spark, frame.repartition(5)) == wanted(rows)
    assert got(spark, frame.limit(0)) == []


def test_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(chunks, "COMPACT_FROM", 1)
    monkeypatch.setattr(chunks, "CHUNK_ROWS", 3)
    rows = [(k, "the same passage of words in many documents, over and over again " * (1 + k % 3) + str(k % 4)) for k in range(30)]
    assert got(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == wanted(rows)


def test_names_that_agree_in_part_are_told_apart(spark, monkeypatch):
    """Phrases of one trigger whose hashes agree in their upper halves are compared as what they are."""
    plain = suffix_dedup.Parse.__init__

    def halved(self, table, buckets):
        plain(self, table, buckets)
        self.phrase = self.phrase & np.uint64((1 << 32) - 1)

    monkeypatch.setattr(suffix_dedup.Parse, "__init__", halved)
    passage = "one and the same passage that is long enough to hold several strings of fifty bytes"
    rows = [(k, f"{'abc'[k % 3] * k} {passage} {'xyz'[k % 3] * (k // 2)}") for k in range(24)]
    assert got(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == wanted(rows)


def test_rolling_hash_depends_on_the_window_alone():
    data = np.random.default_rng(1).integers(0, 256, 500, np.uint8)
    assert (suffix_dedup.rolling(data, 24)[123:] == suffix_dedup.rolling(data[123:], 24)).all()
    assert len(suffix_dedup.rolling(data[:10], 24)) == 0


def test_dictionary_and_parse_give_the_corpus_order():
    rng = random.Random(5)
    for kind in range(40):
        letters = [b"ab", b"a", bytes(range(256)), b"the cat sat on a mat \0"][kind % 4]
        many = np.array([rng.randrange(1, 28) for _ in range(rng.randrange(1, 60))])
        base = bytes(rng.choices(letters, k=200))
        texts = [(base[rng.randrange(100) :] if rng.random() < 0.6 else bytes(rng.choices(letters, k=90)))[: m + 49] for m in many]
        sizes = np.array(list(map(len, texts)))
        text = np.frombuffer(b"".join(texts), np.uint8)
        begins = np.cumsum(sizes) - sizes
        asked = np.concatenate([np.arange(b, b + m) for b, m in zip(begins, many, strict=True)])
        ordered = [text[a : a + 50].tobytes() for a in asked[suffix_dedup.corpus_order(text, sizes, asked)]]
        assert ordered == sorted(ordered)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op3_suffix_dedup"](spark, "/root/testdata/sf0.001").collect()), key=repr) == wanted(rows)


def hot_rows(n, rng):
    """A third of the documents hold one string of 24 bytes, which triggers, among random text."""
    tried = ["".join(rng.choices("abcdefgh ", k=24)) for _ in range(3000)]
    lowest = min(tried, key=lambda t: int(suffix_dedup.rolling(np.frombuffer(t.encode(), np.uint8), 24)[0]))
    text = lambda k: "".join(rng.choices("abcdefghijklmnop ", k=k))
    rows = [(i, text(60) + lowest + text(60)) if i % 3 == 0 else (i, text(144)) for i in range(n)]
    shared = text(20) + lowest + text(20)
    return rows + [(n, shared), (n + 1, text(9) + shared), (n + 2, shared + text(9)), (n + 3, rows[3][1]), (-1, rows[6][1][20:100]), (None, rows[0][1])]


def test_hot_trigger(spark, monkeypatch):
    rows = hot_rows(900, random.Random(4))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = wanted(rows)
    for crowd in (10**9, 256, 1):
        monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
        monkeypatch.setattr(suffix_dedup, "SHARE", 0.0 if crowd == 1 else 1 / 16)
        assert got(spark, frame) == want
    assert any(r[2] for r in want if r[0] and r[0] > 900)


def test_hot_trigger_is_dealt_out():
    """No bucket gets more than five times the bytes of the median one."""
    import pyarrow as pa

    rows, buckets = hot_rows(6000, random.Random(5)), 16
    for crowd in (10**9, suffix_dedup.CROWD):
        parses = [suffix_dedup.Parse(pa.table({"doc_id": [r[0] for r in part], "text": [r[1] for r in part]}), buckets) for part in (rows[:3000], rows[3000:])]
        asked = {}
        for p in parses:
            for b, body in p.names():
                asked.setdefault(b, []).append((p, body))
        replies = {id(p): {} for p in parses}
        kept, suffix_dedup.CROWD = suffix_dedup.CROWD, crowd
        for b, lists in asked.items():
            for (p, _), reply in zip(lists, suffix_dedup.name_answer([x for _, x in lists]), strict=True):
                replies[id(p)][b] = reply
        suffix_dedup.CROWD = kept
        sizes = np.zeros(buckets)
        for p in parses:
            for b, body in p.details(replies[id(p)]):
                sizes[b] += len(body)
        assert (sizes.max() <= 5 * np.median(sizes)) == (crowd == suffix_dedup.CROWD)
