"""Token counts by a whole-token shortcut.

Offline, every vocabulary string is put through the merges by itself; those that come
out as the one token they are need no merging in a text either, since merges never
cross pre-tokens. Counting then looks a pre-token up in that table and merges only the
rest, each distinct segment once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.llm.common import keyed_text, map_batches
from cellframe.llm.pretokens import CHAR_TO_BYTE, SegmentCache, mapped, without_gc


class Counter:
    """Counts a text's tokens as the tokenizer file's library does without special tokens added."""

    def __init__(self, spec: str, pattern: str, proven: frozenset[str] | None = None):
        parts = json.loads(spec)
        pre = parts["pre_tokenizer"]
        if parts["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or parts["normalizer"]:
            raise ValueError("only plain byte-level BPE files are counted here")
        if any(t[k] for t in parts["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take neighbouring text are not counted here")
        self.model = tokenizers.Tokenizer.from_str(spec).model
        added = sorted((t["content"] for t in parts["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.proven = prove(parts["model"]["vocab"], self.model) if proven is None else proven
        self.segments = SegmentCache(pattern, self._compute, sum)

    def _compute(self, pieces: list[str]) -> list[int]:
        proven, merge = self.proven, self.model.tokenize
        rest = [p for p in pieces if p not in proven]
        merged = {p: len(merge(m)) for p, m in zip(rest, mapped(rest), strict=True)}
        return [merged.get(p, 1) for p in pieces]

    def count_all(self, texts: Iterable[str | None]) -> list[int]:
        parts, owners, special = [], [], self.special
        counts = []
        for row, text in enumerate(texts):
            cut = special.split(text) if text and special and special.search(text) else [text or ""]
            counts.append(len(cut) - 1)
            parts += cut
            owners += [row] * len(cut)
        for row, values in zip(owners, self.segments.values(parts), strict=True):
            counts[row] += sum(values)
        return counts

    def count(self, text: str | None) -> int:
        return self.count_all([text])[0]


def prove(vocab: dict[str, int], model) -> frozenset[str]:
    """The vocabulary strings, as text, that the merges alone turn into their own single token."""
    alone = set()
    for piece, number in vocab.items():
        got = model.tokenize(piece)
        if len(got) == 1 and got[0].id == number:
            try:
                alone.add(bytes(CHAR_TO_BYTE[c] for c in piece).decode("utf-8"))
            except (UnicodeDecodeError, KeyError):
                pass
    return frozenset(alone)


@lru_cache(maxsize=2)
def _counter(spec: str, pattern: str, proven: frozenset[str]) -> Counter:
    return Counter(spec, pattern, proven)


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row.

    A null text counts as empty: no bytes, no tokens, not over the limit. Repeated rows
    and null ids stay; other columns are left out. Special strings inside a text are
    one token each, the library's default.
    """
    with open(path, encoding="utf-8") as lines:
        spec = lines.read()
    # bounded by the vocabulary file, a few megabytes whatever the input
    shared = docs.sparkSession.sparkContext.broadcast((spec, Counter(spec, pattern).proven))

    def build():
        counter = _counter(shared.value[0], pattern, shared.value[1])

        def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts = without_gc(lambda: counter.count_all(batch.column(2).to_pylist()))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

        return convert

    kind = docs.schema[id_col].dataType.simpleString()
    frame = keyed_text(docs, id_col, text_col).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = map_batches(frame, build, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
