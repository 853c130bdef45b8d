import hashlib

import public_tokenizers
import tiktoken
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from cellframe.llm import bpe, token_counts
from cellframe.llm.registry import QUERIES

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.load_ranks(PATH)
CODEC = bpe.Codec(bpe.serialise_model(RANKS), public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
JSON = public_tokenizers.path("byte_bpe_50k.json")
COUNTER = token_counts.Counter(open(JSON, encoding="utf-8").read(), public_tokenizers.PATTERN)
TOKENIZER = tokenizers.Tokenizer.from_file(JSON)
AWKWARD = ["", " ", "  ", "a", " a", "a  b   c\n\n  d \n e's 'll foo's", "日本語 ½ ²³", "\r\n\t a\0b \0", "x" * 3000, "<|endoftext|> a<|endoftext|><|endoftext|>b", "🎉 🎉🎉", "a!b ,, .'s 's", "　 a \x1c b\x85"]
ALPHABET = st.text(alphabet=st.sampled_from("ab é1½ \n\t'.,s日🎉<|>\0"), max_size=40)


def test_awkward_texts():
    for text in AWKWARD:
        packed = CODEC.encode(text)
        assert bpe.unpack(packed) == LIBRARY.encode_ordinary(text)
        assert CODEC.decode(packed) == text.encode()
        assert COUNTER.count(text) == len(TOKENIZER.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(ALPHABET)
def test_any_text(text):
    assert bpe.unpack(CODEC.encode(text)) == LIBRARY.encode_ordinary(text)
    assert COUNTER.count(text) == len(TOKENIZER.encode(text, add_special_tokens=False).ids)


def test_cache_is_bounded():
    small = bpe.Codec(bpe.serialise_model(RANKS), public_tokenizers.PATTERN)
    small.segments.max_chars = 50
    texts = [f"word{i} other{i % 7} x" for i in range(200)]
    assert [bpe.unpack(small.encode(t)) for t in texts] == [LIBRARY.encode_ordinary(t) for t in texts]


def test_tables(spark):
    rows = [(1, "the cat", "x"), (2, None, "y"), (2, None, "y"), (None, "", "z"), (3, "word " * 50_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, packed string")
    for frame in (docs, docs.limit(0)):
        coded = bpe.decode(bpe.encode(frame, PATH, public_tokenizers.PATTERN), PATH)
        got = sorted(map(tuple, bpe.digests(coded).collect()), key=repr)
        want = []
        for i, text, _ in rows if frame is docs else []:
            ids = LIBRARY.encode_ordinary(text or "")
            want.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
        assert got == sorted(want, key=repr)
        counted = sorted(map(tuple, token_counts.count_tokens(frame, JSON, public_tokenizers.PATTERN).collect()), key=repr)
        lengths = [(i, len((t or "").encode()), len(TOKENIZER.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in (rows if frame is docs else [])]
        assert counted == sorted([(*x, x[2] > 512) for x in lengths], key=repr)


def test_queries(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    coded = {r.doc_id: r for r in QUERIES["op1_byte_bpe"](spark, "/root/testdata/sf0.001").collect()}
    counts = {r.doc_id: r for r in QUERIES["op7_token_counts"](spark, "/root/testdata/sf0.001").collect()}
    assert len(coded) == len(counts) == len(docs)
    for doc_id, text in docs:
        ids = LIBRARY.encode_ordinary(text or "")
        assert coded[doc_id].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert counts[doc_id].n_tokens == len(TOKENIZER.encode(text or "", add_special_tokens=False).ids)


def test_roundtrip_is_one_pass(spark):
    """Encoding and decoding in one worker gives the rows of the two functions, and a task of the query has one worker."""
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(AWKWARD)] + [(None, "a b"), (3, None)], "doc_id int, text string")
    apart = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH)
    whole = bpe.roundtrip(docs, PATH, public_tokenizers.PATTERN)
    assert whole.schema == apart.schema
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted(map(tuple, apart.collect()), key=repr)
    plan = QUERIES["op1_byte_bpe"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
