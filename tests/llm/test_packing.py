"""Packing against the library itself, text by text."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from cellframe.llm import packing
from cellframe.llm.registry import op13_packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string"
ODD = [
    None, "", " ", "\n\n", "a", "It's John's; they'LL don't, WE'RE I'M 'S", "x.. y… z.,!", "Ångström Ångström ẖ H̱ ẹ́",
    "ΟΔΟΣ Σ ΑΣ.", "İstanbul İ", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b <|EndOfText|>.", "12 345 ½ ² Ⅷ", "日本語 テスト 한국어 ไทย", "a b c　d\x1ce\x85f",
    "\x00 \x00a", "don''t '' 's's", "word' 'word ’s it’s", "tab\tsep\r\nline\x0bvt\x0cff", "emoji 😀😀 👩‍👩‍👧 a😀.", "ǅ ß ẞ ﬁ Straße", "a" * 300, ".,;:!?" * 30,
]


@pytest.fixture(scope="module")
def library():
    made = tokenizers.Tokenizer.from_file(PATH)
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


def test_ids(library):
    with open(PATH, encoding="utf-8") as lines:
        words = packing.WordIds(lines.read())
    rng = random.Random(3)
    signs = ["a", "B", "s", "'", "'s", ".", " ", "  ", "\n", "\t", "é", "É", "́", "Σ", "ς", "İ", "<|endoftext|>", "<|", "|>", "9", "½", "中", " ", "\x1c", "😀", "-", "T"]
    texts = ODD + ["".join(rng.choices(signs, k=rng.randint(1, 25))) for _ in range(1500)]
    for text, packed in zip(texts, words.packed(texts), strict=True):
        assert np.frombuffer(packed, words.code).tolist() == library(text), repr(text)


def check(found, wanted, length):
    """Every id once, documents whole, sequences gapless, no padding but behind the last sequence."""
    docs, sequences = {}, {}
    for r in found:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert sorted(docs) == sorted(wanted)
    for key, rows in docs.items():
        ids, at = wanted[key], 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    sizes = []
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        sizes.append(at)
        assert at <= length and (at == length or at & (at - 1) == 0)
    assert sorted(sequences) == list(range(len(sequences)))
    return sizes


def test_packing(spark, library):
    rng = random.Random(5)
    texts = ODD + [" ".join(rng.choices(["one", "Two,", "thrée.", "4", "fiver"], k=rng.randint(0, 400))) for _ in range(60)] + ["long " * 9000]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    wanted = {k: [*library(t), 2] for k, t in rows}
    made = packing.pack(docs, PATH, 2, 512)
    found = made.pieces().collect()
    sizes = check(found, wanted, 512)
    assert sum(sizes) == sum(map(len, wanted.values())) == made.total
    stream = {s: sorted((r for r in found if r.sequence_id == s), key=lambda r: r.offset) for s in {r.sequence_id for r in found}}
    for r in made.sequences().collect():
        ids = [x for p in stream[r.sequence_id] for x in wanted[p.doc_id][p.start : p.start + p.length]]
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_ids == len(ids)
        del stream[r.sequence_id]
    assert not stream


def test_edges(spark, library):
    docs = spark.createDataFrame([(None, "a b", 1), (None, None, 2), (7, "same", 3), (7, "same", 3)], "doc_id long, text string, part int")
    found = sorted(map(tuple, packing.pack(docs, PATH, 2).pieces().select("doc_id", "start", "length", "doc_tokens").collect()), key=str)
    assert len({x[1:] for x in found if x[0] == 7}) == 1 and [x[3] for x in found] == [2, 2, 1, 3]
    assert packing.pack(docs.limit(0), PATH, 2).pieces().count() == 0
    assert packing.pack(docs.limit(0), PATH, 2).sequences().count() == 0
    exact = spark.createDataFrame([(i, None) for i in range(64)], SCHEMA)
    assert {r.sequence_id for r in packing.pack(exact, PATH, 2, 16).pieces().collect()} == {0, 1, 2, 3}


def test_query(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    check(op13_packing(spark, "/root/testdata/sf0.001").collect(), {r.doc_id: [*library(r.text), 2] for r in docs}, 4096)


def test_words_are_learnt_once(monkeypatch, library):
    with open(PATH, encoding="utf-8") as lines:
        words = packing.WordIds(lines.read())
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choices("abcdeéñß", k=9)) + rng.choice(["", ",", ".\r", "'s", "|>", "²"]) for _ in range(500)) for _ in range(500)]
    first = words.packed(texts)
    assert words.held > 6_000_000  # what the cache held at most before
    asked = []
    learn = words._learn
    monkeypatch.setattr(words, "_learn", lambda some: (asked.extend(some), learn(asked))[1])
    assert words.packed(texts) == first and not asked
    for text, packed in zip(texts[:5], first[:5], strict=True):
        assert np.frombuffer(packed, words.code).tolist() == library(text)


def test_plain_words():
    words = ["abc", "abc,.", "é-", "...", "don't", "a|", "a1", "²", "A", "ƻa", "a" * 41, "a" + "." * 21, "a\r", "-a", "日本"]
    assert packing.PLAIN.findall("\n".join(words)) == [("abc", ""), ("abc", ",."), ("é", "-"), ("", "..."), *[("", "")] * 11]
