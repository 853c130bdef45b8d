"""Ranges of packed keys against brute force."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellframe.functions import bits
from cellframe.functions.zranges import in_ranges, inside, z_ranges
from tests.test_stored import scanned


def packed(key, n_bits):
    out = 0
    for level in range(n_bits - 1, -1, -1):
        for x in key:
            out = out << 1 | (x >> level & 1)
    return out


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 3), st.integers(1, 3), st.integers(1, 40), st.data())
def test_cover(dims, n_bits, most, data):
    bound = st.integers(-1, (1 << n_bits) + 1)
    low, high = data.draw(st.tuples(*[bound] * dims)), data.draw(st.tuples(*[bound] * dims))
    ranges = z_ranges(low, high, n_bits, most)
    places = [[]]
    for _ in range(dims):
        places = [[*p, x] for p in places for x in range(1 << n_bits)]
    numbers = {packed(p, n_bits) for p in places if all(a <= x <= b for x, a, b in zip(p, low, high, strict=True))}
    held = [x for a, b in ranges for x in range(a, b + 1)]
    assert len(ranges) <= most and held == sorted(set(held)) and numbers <= set(held)
    if not numbers:
        assert not ranges
    if most == 40 and dims * n_bits <= 5:
        assert numbers == set(held)


def test_few_ranges_are_tight():
    low, high = (1000, 5000), (1999, 5999)
    sizes = [sum(b - a + 1 for a, b in z_ranges(low, high, 16, most)) for most in (1, 4, 16, 64)]
    assert sizes == sorted(sizes, reverse=True) and sizes[2] < 4 * 10**6 and sizes[3] < 2 * 10**6
    with pytest.raises(ValueError):
        z_ranges(low, high, 16, 0)


def test_scan(spark, tmp_path):
    frame = spark.range(40_000).select((F.col("id") * 7919 % 4096).alias("a"), (F.col("id") * 104_729 % 4096).alias("b"), "id")
    table = frame.withColumn("z", bits.interleave([F.col("a"), F.col("b")], 12))
    path = str(tmp_path / "z")
    table.repartitionByRange(16, "z").sortWithinPartitions("z").write.option("parquet.block.size", 1 << 14).parquet(path)
    low, high = (1000, 2040), (1200, 2300)
    stored = spark.read.parquet(path)
    found = stored.filter(in_ranges(F.col("z"), z_ranges(low, high, 12))).filter(inside(F.col("z"), low, high, 12))
    want = stored.filter(F.col("a").between(1000, 1200) & F.col("b").between(2040, 2300))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count()
    assert scanned(found) < 0.35 * 40_000
    assert stored.filter(in_ranges(F.col("z"), [])).count() == 0
