"""Byte-level BPE encoding and decoding through a serialised sentencepiece model.

The rank file becomes a sentencepiece BPE model without any training: each token's
bytes are mapped to printable characters, its score is its negative rank, and the
normaliser is the identity. Pre-tokens are encoded one by one and decoded by the
inverse byte mapping. Sentencepiece merges the best-scored neighbouring pair, the
leftmost first, which is the order of the ranks; tokens that merging alone cannot
reach (found once, when the model is built) are kept in a table, because the rank
encoders emit a pre-token that is itself in the vocabulary as that one token.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.llm.common import keyed_text, map_batches
from cellframe.llm.pretokens import CHAR_TO_BYTE, SegmentCache, byte_alphabet, mapped, without_gc


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from lines of a base64 token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protobuf field: an int as varint, a float as fixed32, bytes as length-delimited."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


NORMAL, UNKNOWN = 1, 2


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto; a piece's index is its rank, the unknown piece comes last."""
    alphabet = byte_alphabet()
    by_rank = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0, 1, 2 ...")
    pieces = [_field(1, "".join(alphabet[b] for b in t).encode()) + _field(2, -float(r)) + _field(3, NORMAL) for r, t in enumerate(by_rank)]
    pieces.append(_field(1, b"<unk>") + _field(2, -float(len(pieces))) + _field(3, UNKNOWN))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(pieces) - 1) + b"".join(_field(k, -1) for k in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes texts to packed little-endian unsigned 32-bit ids, and back to bytes."""

    def __init__(self, model: bytes, pattern: str, alone: dict[str, int] | None = None):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.model.get_piece_size() - 1
        pieces = [self.model.id_to_piece(i) for i in range(size)]
        self.decode = Decoder(pieces).decode
        if alone is None:
            alone = {p: i for i, (p, got) in enumerate(zip(pieces, self.model.encode(pieces, out_type=int, num_threads=1), strict=True)) if got != [i]}
        self.alone = alone
        self.segments = SegmentCache(pattern, self._compute, b"".join)

    def _compute(self, pieces: list[str]) -> list[bytes]:
        shown = mapped(pieces)
        ids = self.model.encode(shown, out_type=int, num_threads=1) if shown else []
        if self.alone:
            ids = [[self.alone[p]] if p in self.alone else x for p, x in zip(shown, ids, strict=True)]
        flat = np.fromiter((i for x in ids for i in x), "<u4").tobytes()
        out, at = [], 0
        for x in ids:
            out.append(flat[at : at + 4 * len(x)])
            at += 4 * len(x)
        return out

    def encode_all(self, texts: Iterable[str | None]) -> list[bytes]:
        return without_gc(lambda: [b"".join(values) for values in self.segments.values(t or "" for t in texts)])

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


class Decoder:
    """The inverse byte mapping of the pieces, by id."""

    def __init__(self, pieces: list[str]):
        self.table = [bytes(CHAR_TO_BYTE[c] for c in p) for p in pieces]

    def decode(self, packed: bytes | None) -> bytes:
        """Ids outside the vocabulary raise."""
        table = self.table
        return b"".join([table[i] for i in np.frombuffer(packed, "<u4").tolist()]) if packed else b""


@lru_cache(maxsize=1)
def _decoder(model: bytes) -> Decoder:
    pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
    return Decoder([pieces.id_to_piece(i) for i in range(pieces.get_piece_size() - 1)])


@lru_cache(maxsize=1)
def _codec(model: bytes, pattern: str) -> Codec:
    return Codec(model, pattern)


def _model(frame: DataFrame, path: str):
    """The serialised vocabulary, about a megabyte whatever the input, for all tasks."""
    return frame.sparkSession.sparkContext.broadcast(serialise_model(load_ranks(path)))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, packed): each row's text as packed little-endian unsigned 32-bit token ids.

    A null or empty text gives no ids. Repeated rows stay, nulls in ``id_col`` stay,
    other columns are left out. Texts are encoded whole, whatever their length.
    """
    model = _model(docs, path)

    def build():
        codec = _codec(model.value, pattern)

        def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
            packed = codec.encode_all(batch.column(1).to_pylist())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["doc_id", "packed"])

        return convert

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(keyed_text(docs, id_col, text_col), build, f"doc_id {kind}, packed binary")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", packed_col: str = "packed") -> DataFrame:
    """(doc_id, packed, decoded): the bytes that the ids stand for; null ids give no bytes."""
    model = _model(encoded, path)

    def build():
        decoder = _decoder(model.value)

        def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
            decoded = [decoder.decode(p) for p in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], ["doc_id", "packed", "decoded"])

        return convert

    kind = encoded.schema[id_col].dataType.simpleString()
    frame = encoded.select(F.col(id_col).alias("doc_id"), F.col(packed_col).alias("packed"))
    return map_batches(frame, build, f"doc_id {kind}, packed binary, decoded binary")


def roundtrip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, packed, decoded): ``decode`` of ``encode``, in one Python worker a task in place of two that hold a vocabulary each."""
    model = _model(docs, path)

    def build():
        codec = _codec(model.value, pattern)

        def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
            packed = codec.encode_all(batch.column(1).to_pylist())
            decoded = [codec.decode(p) for p in packed]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), pa.array(decoded, pa.binary())], ["doc_id", "packed", "decoded"])

        return convert

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(keyed_text(docs, id_col, text_col), build, f"doc_id {kind}, packed binary, decoded binary")


def unpack(packed: bytes | None) -> list[int]:
    """Ids as a list, for callers that want numbers."""
    return np.frombuffer(packed or b"", "<u4").tolist()


def digests(coded: DataFrame) -> DataFrame:
    """Counts and digests of an encoded and decoded table."""
    return coded.select(
        "doc_id",
        (F.octet_length("packed") / 4).cast("long").alias("n_tokens"),
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
