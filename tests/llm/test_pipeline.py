import hashlib
import re
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from cellframe.llm import bpe, secrets
from tests.llm.test_near_duplicates import brute, shingle_set

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    extra = spark.createDataFrame([(90001, "12 !?", "en", "s", 5), (90002, None, None, None, None), (90003, "password=abcdefgh1 " + " ".join(f"z{k}" for k in range(40)), "en", "s", 1)], docs.schema)
    docs = docs.unionByName(extra)
    steps = []
    frame = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SF)
        assert frame.columns == docs.columns
        steps.append(sorted([tuple(r) for r in frame.collect()], key=repr))
        frame = spark.createDataFrame(frame.collect(), docs.schema)
    rows = sorted([tuple(r) for r in docs.collect()], key=repr)
    known = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
    assert steps[0] == known
    keep = {i for i, _, c in brute([r[:2] for r in known]) if i == c}
    single = [r for r in known if r[0] in keep]
    assert steps[1] == single
    sets = [shingle_set(t) for t in items]
    clean = [r for r in single if not any(5 * len(s & shingle_set(r[1])) >= 4 * len(s) for s in sets)]
    assert steps[2] == clean and len(clean) < len(single)
    told = []
    tried = Counter((s, k) for r in clean for s, k, _, _ in secrets.candidates(r[1], secrets.base_spans(r[1])))
    limits = secrets.thresholds(((s, k, n) for (s, k), n in tried.items()), secrets.RATE)
    for r in clean:
        spans = secrets.scan(r[1], limits)[1]
        text = secrets.redacted(r[1], spans)
        told.append((r[0], text, r[2], r[3], len(text) if spans else r[4]))
    assert steps[3] == sorted(told, key=repr)
    ranks = bpe.load_ranks(public_tokenizers.path(corpus_pipeline.TOKENS))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    last = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, frame, SF).collect()}
    assert len(last) == len(told)
    for r in told:
        assert bpe.unpack(last[r[0]].packed) == library.encode_ordinary(r[1])
        assert last[r[0]].decoded_sha256 == hashlib.sha256(r[1].encode()).hexdigest()


def test_rows_that_share_an_id(spark):
    a, b, c, d = (" ".join(f"{w}{k}" for k in range(30)) for w in "abcd")
    rows = [(1, a), (1, b), (1, a), (2, a + " end"), (3, b), (4, None), (4, " "), (5, c), (5, c), (6, a), (6, d), (7, None), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 5, "at") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row int, at string").repartition(3)
    got = corpus_pipeline.jaccard_join(spark, docs, SF)
    assert got.columns == docs.columns and {(r["row"], r["at"]) for r in got.collect()} == {(5, "at")}
    kept = sorted(((r.doc_id, (r.text or "").strip()) for r in got.collect()), key=repr)
    assert kept == sorted([(1, a), (1, b), (4, ""), (5, c), (6, d), (7, ""), (None, a), (None, a)], key=repr)


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert 100 < len(rows) < 200 and len({r.doc_id for r in rows}) == len(rows)
