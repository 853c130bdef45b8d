"""Reversible, order-preserving encodings of floating-point keys as BIGINT columns.

Encoded keys are what bit-exact equality and order need: -0.0 and 0.0 are different keys
and NaN is an ordinary one above infinity. Everything is a Column expression.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL_BUT_SIGN = 0x7FFF_FFFF_FFFF_FFFF
LONG_MIN = -0x8000_0000_0000_0000


def _call(kind: str, method: str, *args: Column) -> Column:
    return F.call_function("java_method", F.lit(f"java.lang.{kind}"), F.lit(method), *args)


def sortable_long(x: Column) -> Column:
    """Raw IEEE bits with all but the sign flipped for negative numbers: ordered as the doubles are."""
    bits = _call("Double", "doubleToRawLongBits", x.cast("double")).cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(ALL_BUT_SIGN)))


def from_sortable_long(k: Column) -> Column:
    """The double that ``sortable_long`` encoded."""
    bits = F.when(k >= 0, k).otherwise(k.bitwiseXOR(F.lit(ALL_BUT_SIGN)))
    return _call("Double", "longBitsToDouble", bits).cast("double")


def sortable_int(x: Column) -> Column:
    """The 32-bit form of ``sortable_long``, for FLOAT columns, widened to BIGINT."""
    bits = _call("Float", "floatToRawIntBits", x.cast("float")).cast("int")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(0x7FFFFFFF))).cast("long")


def from_sortable_int(k: Column) -> Column:
    narrow = k.cast("int")
    bits = F.when(narrow >= 0, narrow).otherwise(narrow.bitwiseXOR(F.lit(0x7FFFFFFF)))
    return _call("Float", "intBitsToFloat", bits).cast("float")


def string_key(s: Column) -> Column:
    """The low bytes of a string's first six characters, then the low 16 bits of its 31-polynomial hash; lossy."""
    points = F.transform(F.split(s, ""), lambda c: F.ascii(c).cast("long"))
    code = lambda i: F.coalesce(F.get(points, F.lit(i)), F.lit(0).cast("long"))
    # a byte is signed: 128 and above set all bits over it
    byte = lambda c: F.when(c.bitwiseAND(128) != 0, c.bitwiseAND(255) - 256).otherwise(c.bitwiseAND(255))
    head = F.lit(0).cast("long")
    for i in range(6):
        head = F.shiftleft(head.bitwiseOR(byte(code(i))), 8)
    wrap = 1 << 32
    hashed = F.aggregate(points, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(wrap)))
    return F.shiftleft(head, 8).bitwiseOR(hashed.bitwiseAND(0xFFFF))


def saturating_long(x: Column) -> Column:
    """Truncation towards zero that saturates; NaN becomes 0."""
    return F.when(F.isnan(x), F.lit(0).cast("long")).when(x >= 9.223372036854775807e18, F.lit(ALL_BUT_SIGN)).when(x <= -9.223372036854775808e18, F.lit(LONG_MIN)).otherwise(x.cast("long"))


def double_key(x: float) -> int:
    """``sortable_long`` of a number at hand."""
    bits = struct.unpack("<q", struct.pack("<d", x))[0]
    return bits if bits >= 0 else bits ^ ALL_BUT_SIGN


class Encoding:
    """A pair of Column builders for each dimension: ``pre`` encodes, ``post`` decodes; ``key`` encodes a number at hand."""

    def key(self, x: float, dim: int) -> int:
        raise NotImplementedError

    def pre(self, x: Column, dim: int) -> Column:
        raise NotImplementedError

    def post(self, k: Column, dim: int) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class Plain(Encoding):
    """Integers, kept as they are."""

    def key(self, x: float, dim: int) -> int:
        return max(LONG_MIN, min(ALL_BUT_SIGN, math.floor(x)))

    def pre(self, x: Column, dim: int) -> Column:
        return x.cast("long")

    def post(self, k: Column, dim: int) -> Column:
        return k


@dataclass(frozen=True)
class Ieee(Encoding):
    """Sortable IEEE bits after adding a shift, one for all dimensions or one for each."""

    shift: float | tuple[float, ...] = 0.0

    def _of(self, dim: int) -> float:
        return self.shift[dim] if isinstance(self.shift, tuple) else self.shift

    def key(self, x: float, dim: int) -> int:
        return double_key(x + self._of(dim))

    def pre(self, x: Column, dim: int) -> Column:
        return sortable_long(x + F.lit(self._of(dim))) if self._of(dim) else sortable_long(x)

    def post(self, k: Column, dim: int) -> Column:
        return from_sortable_long(k) - F.lit(self._of(dim)) if self._of(dim) else from_sortable_long(k)


@dataclass(frozen=True)
class Multiply(Encoding):
    """Fixed-point: (x + shift) times a multiplier, truncated; lossy."""

    factor: float
    shift: float = 0.0

    def key(self, x: float, dim: int) -> int:
        return max(LONG_MIN, min(ALL_BUT_SIGN, math.trunc((x + self.shift) * self.factor)))

    def pre(self, x: Column, dim: int) -> Column:
        return saturating_long((x + F.lit(self.shift)) * F.lit(self.factor) if self.shift else x * F.lit(self.factor))

    def post(self, k: Column, dim: int) -> Column:
        return k / F.lit(self.factor) - F.lit(self.shift) if self.shift else k * F.lit(1 / self.factor)


def displacement(low: float, high: float, margin: float = 1.0001) -> float:
    """A shift that brings [low, high] under one binary exponent, on the side of zero it reaches."""
    low = low / margin if low > 0 else low * margin
    high = high * margin if high > 0 else high / margin
    reach = max(high - low, low, -high)
    if reach == 0:
        return 0.0
    power = 2.0 ** math.ceil(math.log2(reach))
    return power - low if high > 0 else -power - high


def analyse(frame: DataFrame, keys: Sequence[str]) -> Ieee:
    """The encoding whose shifts put each dimension's values under one exponent; one pass of min and max.

    NaN counts in neither; a dimension without values is not shifted.
    """
    plain = [F.when(~F.isnan(k), F.col(k)) for k in keys]
    got = frame.agg(*[F.min(c).alias(f"low{i}") for i, c in enumerate(plain)], *[F.max(c).alias(f"high{i}") for i, c in enumerate(plain)]).first()
    pairs = [(got[f"low{i}"], got[f"high{i}"]) for i in range(len(keys))]
    return Ieee(tuple(displacement(float(a), float(b)) if a is not None else 0.0 for a, b in pairs))
