"""Bit and Z-order functions on BIGINT columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellframe.functions.encoding import _call


def bit(x: Column, level: Column | int) -> Column:
    """The bit at a level, 0 the lowest, as 0 or 1."""
    return F.call_function("getbit", x, level if isinstance(level, Column) else F.lit(level)).cast("long")


def with_bit(x: Column, level: int, on: bool) -> Column:
    mask = 1 << level if level < 63 else -(1 << 63)
    return x.bitwiseOR(F.lit(mask).cast("long")) if on else x.bitwiseAND(F.lit(~mask).cast("long"))


def binary_text(x: Column, depth: int = 64) -> Column:
    """The lowest ``depth`` bits as text, the highest first."""
    return F.substring(F.lpad(F.bin(x), 64, "0"), 65 - depth, depth)


def reverse(x: Column, used: int = 64) -> Column:
    """The lowest ``used`` bits in reverse."""
    return F.shiftrightunsigned(_call("Long", "reverse", x).cast("long"), 64 - used)


def address(keys: Sequence[Column], level: Column | int) -> Column:
    """Hypercube address at a bit level: one bit of each key, the first key's the highest."""
    out = F.lit(0).cast("long")
    for k in keys:
        out = F.shiftleft(out, 1).bitwiseOR(bit(k, level))
    return out


def path(keys: Sequence[Column], depth: int = 64) -> Column:
    """The addresses at all levels, the highest level first: sorting by this array is Z-order."""
    return F.transform(F.sequence(F.lit(depth - 1), F.lit(0), F.lit(-1)), lambda level: address(keys, level))


def signed_path(keys: Sequence[Column], depth: int = 64) -> Column:
    """``path`` with the sign bit flipped, so that negative numbers come first."""
    return path([k.bitwiseXOR(F.lit(-(1 << 63))) for k in keys], depth)


def apply_address(key: Column, hypercube: Column | int, level: int, dim: int, dims: int) -> Column:
    """``key`` of dimension ``dim`` with the bit at ``level`` taken from a hypercube address."""
    hypercube = hypercube if isinstance(hypercube, Column) else F.lit(hypercube).cast("long")
    mask = F.lit(1 << level if level < 63 else -(1 << 63)).cast("long")
    return F.when(bit(hypercube, dims - 1 - dim) == 1, key.bitwiseOR(mask)).otherwise(key.bitwiseAND(mask.bitwiseXOR(F.lit(-1))))


def from_path(addresses: Column, dim: int, dims: int) -> Column:
    """The key of a dimension, put together from a path of 64 addresses."""
    return F.aggregate(addresses, F.lit(0).cast("long"), lambda k, a: F.shiftleft(k, 1).bitwiseOR(bit(a, dims - 1 - dim)))


def interleave(keys: Sequence[Column], n_bits: int) -> Column:
    """One number from the lowest ``n_bits`` of each key, the first key's bits the highest of each group."""
    out = F.lit(0).cast("long")
    for level in range(n_bits - 1, -1, -1):
        out = F.shiftleft(out, len(keys)).bitwiseOR(address(keys, level))
    return out


def deinterleave(z: Column, dims: int, n_bits: int) -> list[Column]:
    """The keys that ``interleave`` joined."""
    out = []
    for d in range(dims):
        key = F.lit(0).cast("long")
        for level in range(n_bits - 1, -1, -1):
            key = F.shiftleft(key, 1).bitwiseOR(bit(z, level * dims + dims - 1 - d))
        out.append(key)
    return out


def conflicting_bits(a: Sequence[Column], b: Sequence[Column], mask: int = -1) -> Column:
    """Position of the highest bit in which any dimension differs, counted from the right; 0 for none."""
    seen = F.lit(0).cast("long")
    for x, y in zip(a, b, strict=True):
        seen = seen.bitwiseOR(x.bitwiseXOR(y))
    masked = seen if mask == -1 else seen.bitwiseAND(F.lit(mask).cast("long"))
    return 64 - _call("Long", "numberOfLeadingZeros", masked).cast("int")


def dominates(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Whether no dimension of path ``b`` first differs from ``a`` by a set bit: ``a`` is at least ``b`` throughout.

    ``a`` and ``b`` are addresses from the highest level down; a dimension counts by the
    first level at which it differs.
    """
    decided, beaten = F.lit(0).cast("long"), F.lit(False)
    for x, y in zip(a, b, strict=True):
        differs = x.bitwiseXOR(y)
        beaten = beaten | (y.bitwiseAND(differs).bitwiseAND(decided.bitwiseXOR(F.lit(-1))) != 0)
        decided = decided.bitwiseOR(differs)
    return ~beaten


def next_address(v: Column, low: int, high: int) -> Column:
    """The next number that has all bits of ``low`` and none outside ``high``; after the last it is ``low``.

    One is added where only the free bits count, so carries run over the fixed ones.
    """
    fixed_ones = v.bitwiseOR(F.lit(~high).cast("long"))
    largest = F.lit((1 << 63) - 1)
    following = F.when(fixed_ones == largest, F.lit(-(1 << 63))).otherwise(F.try_add(fixed_ones, F.lit(1).cast("long")))
    return following.bitwiseAND(F.lit(high).cast("long")).bitwiseOR(F.lit(low).cast("long"))


def in_mask(key: Column, low: int, high: int) -> Column:
    """Whether the key has all bits of ``low`` and none outside ``high``."""
    return (key.bitwiseOR(F.lit(low).cast("long")) == key) & (key.bitwiseAND(F.lit(high).cast("long")) == key)


def free_bits(low: Column, high: Column) -> Column:
    """How many bits two masks leave open."""
    return F.bit_count(low.bitwiseXOR(high))


# --- addresses of any number of bits, as arrays of 64-bit words, the highest word first ---


def _unsigned(word: Column) -> Column:
    return word.bitwiseXOR(F.lit(-(1 << 63)))


def long_less(a: Column, b: Column) -> Column:
    """Whether address ``a`` comes before ``b``, words being unsigned."""
    return F.transform(a, _unsigned) < F.transform(b, _unsigned)


def long_xor_count(a: Column, b: Column) -> Column:
    """How many bits differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)


def long_in_mask(key: Column, low: Column, high: Column) -> Column:
    """Whether the address has all bits of ``low`` and none outside ``high``."""
    bounds = F.arrays_zip(key.alias("k"), low.alias("a"), high.alias("b"))
    return F.forall(bounds, lambda x: (x["k"].bitwiseOR(x["a"]) == x["k"]) & (x["k"].bitwiseAND(x["b"]) == x["k"]))


def _carried(words: Column, step: int) -> Column:
    """``words`` plus or minus one, wrapping round."""
    word = F.lit(-1 if step > 0 else 0).cast("long")  # the word that passes the carry on
    start = F.struct(F.lit(True).alias("carry"), F.array().cast("array<bigint>").alias("out"))

    def step_one(state: Column, w: Column) -> Column:
        turned = F.when(w == word, F.lit(0 if step > 0 else -1).cast("long")).when(w == F.lit((1 << 63) - 1 if step > 0 else -(1 << 63)), F.lit(-(1 << 63) if step > 0 else (1 << 63) - 1).cast("long")).otherwise(F.try_add(w, F.lit(step).cast("long")))
        out = F.when(state["carry"], turned).otherwise(w)
        return F.struct((state["carry"] & (w == word)).alias("carry"), F.concat(F.array(out), state["out"]).alias("out"))

    return F.aggregate(F.reverse(words), start, step_one, lambda state: state["out"])


def long_increment(words: Column) -> Column:
    return _carried(words, 1)


def long_decrement(words: Column) -> Column:
    return _carried(words, -1)


def long_next_address(v: Column, low: Column, high: Column) -> Column:
    """``next_address`` of addresses of any number of bits; after the last it is ``low``."""
    fixed_ones = F.zip_with(v, high, lambda x, h: x.bitwiseOR(h.bitwiseXOR(F.lit(-1).cast("long"))))
    return F.zip_with(F.zip_with(long_increment(fixed_ones), high, lambda x, h: x.bitwiseAND(h)), low, lambda x, lo: x.bitwiseOR(lo))
