"""What keeps a key that many rows have from being one task's work.

Rows of a heavy key are dealt to several parts by a hash of the row, and the other side's rows of
that key are copied for each part; if both sides are heavy the parts form a grid. Which keys
are heavy is estimated from a sample, so it decides who does the work and never what comes
out. At most a few keys for each partition (or one for each ``MOST_LIGHT`` rows) can be heavy, and those alone
reach the driver.

The left rows of a heavy key's part are one array, which a right row meets whole: a join of rows copies all
matches of a row before it gives out the first, so its time a pair grows with them.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.functions.names import free

#: Rows of one key that are never dealt out, pairs of one part, and rows of a heavy key that a sample should see.
LIGHT, PAIRS, SEEN = 1000, 1 << 20, 50
#: Rows of one key that are always dealt out, left rows of a part, and parts of all heavy keys that a partition needs at most.
MOST_LIGHT, BLOCK, SHARES = 1 << 16, 1 << 9, 32


def row_hash(frame: DataFrame) -> Column:
    """A hash of all columns that have one."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in frame.dtypes if "map<" not in kind and "variant" not in kind])


def facts_of(rows: DataFrame, facts: DataFrame, keys: Sequence[str], how: str = "inner", salts: int = 64) -> DataFrame:
    """``rows`` joined (``inner`` or ``left``) to facts whose keys are unique, with no task getting all rows of a hot key.

    Rows are salted by their own hash, and a fact is copied for the salts that its key's rows have.
    """
    (salt,) = free([rows, facts], "_salt")
    salted = rows.withColumn(salt, F.pmod(row_hash(rows), F.lit(salts)))
    copies = salted.select(*keys, salt).distinct().join(facts, list(keys))
    return salted.join(copies, [*keys, salt], how).drop(salt)


def parts(rows: float, other: float, light: float, block: float | None = None, pairs: float = PAIRS) -> tuple[int, int]:
    """Into how many parts, powers of two, the rows of a key are dealt on each side: of at most ``light`` rows (``block`` on the first side) and ``pairs``."""
    a = b = 1
    while rows / a > (light if block is None else min(light, block)):
        a *= 2
    while other / b > light:
        b *= 2
    while (rows / a) * (other / b) > pairs:
        if rows / a >= other / b and (block is None or other / b <= block):
            a *= 2
        else:
            b *= 2
    return a, b


def heavy_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], light: float) -> dict[int, tuple[int, int]]:
    """Parts of each side for the hashes of keys that have more than ``light`` rows on one, from samples."""
    share = min(1.0, SEEN / light)
    (key,) = free([left, right], "_key")
    seen = []
    for side, frame in enumerate((left, right)):
        some = frame.sample(share, seed=17) if share < 1 else frame
        seen.append(some.select(F.xxhash64(*keys).alias(key), F.lit(1 - side).alias("a"), F.lit(side).alias("b")))
    counts = seen[0].unionByName(seen[1]).groupBy(key).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    found = counts.filter(F.greatest("a", "b") > light * share).collect()
    count = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(PAIRS, sum(r[1] * r[2] for r in found) / share**2 / (SHARES * count))
    return {r[0]: parts(r[1] / share, r[2] / share, light, BLOCK, most) for r in found}


def _of_key(code: Column, by_key: dict[int, int]) -> Column:
    """The number of a key's hash, 1 where none is given; sets of literals are looked up by hash."""
    out = F.lit(1)
    for n in sorted(set(by_key.values()) - {1}):
        out = F.when(code.isin([k for k, v in by_key.items() if v == n]), F.lit(n)).otherwise(out)
    return out


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The inner join on ``keys`` over all shuffle partitions, whatever the sizes of the sides.

    A small side can make very many pairs: left to itself, Spark would send one that it takes for
    small through the driver, or join in as few tasks as the sides' bytes are worth.
    """
    count = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = (frame.repartition(count, *[F.col(k) for k in keys]) for frame in (left, right))
    return a.join(b.hint("merge"), list(keys))


def dealt_join(left: DataFrame, right: DataFrame, keys: Sequence[str], rows: int | None = None) -> DataFrame:
    """The inner join on ``keys``, heavy keys dealt out; ``rows`` is about how many both sides have."""
    keys = list(keys)
    spark = left.sparkSession
    if rows is not None and rows <= 4 * LIGHT:  # no key of so few can be worth dealing out
        return left.join(right, keys)
    light = max(LIGHT, min(MOST_LIGHT, (rows or 0) / (2 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    heavy = heavy_keys(left, right, keys, light)
    if not heavy:
        return spread_join(left, right, keys)
    return block_join(left, right, keys, heavy, ceil(light / BLOCK))


def block_join(left: DataFrame, right: DataFrame, keys: Sequence[str], heavy: dict[int, tuple[int, int]], blocks: int) -> DataFrame:
    """The inner join on ``keys``, where those of these hashes are dealt to so many parts of each side.

    The left rows of a part are one array, those of any other key at most so many ``blocks``: a right row has few matches,
    and its pairs are gone before the next row's are made.
    """
    rest = [[c for c in frame.columns if c not in keys] for frame in (left, right)]
    mine, theirs, unit, block, *fields = free([left, right], "_part", "_other", "_unit", "_block", *[f"_c{i}" for i in range(max(1, len(rest[0])))])
    code, on = F.xxhash64(*keys), [*keys, mine, theirs]
    a, b = (_of_key(code, {k: v[i] for k, v in heavy.items()}) for i in (0, 1))
    count = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def spread(frame: DataFrame, own: Column, other: Column, own_name: str, other_name: str) -> DataFrame:
        dealt = frame.withColumn(own_name, F.pmod(row_hash(frame), own).cast("int"))
        return dealt.withColumn(other_name, F.explode(F.sequence(F.lit(0), other - 1)))

    cut = spread(left, a, b, mine, theirs).withColumn(unit, F.when(code.isin(list(heavy)), F.lit(0)).otherwise(F.pmod(F.xxhash64(row_hash(left)), F.lit(blocks)).cast("int")))
    held_columns = [F.col(f"`{c}`").alias(f) for c, f in zip(rest[0], fields)] or [F.lit(0).alias(fields[0])]
    held = cut.repartition(count, *[F.col(k) for k in on]).groupBy(*on, unit).agg(F.collect_list(F.struct(*held_columns)).alias(block))
    asked = spread(right, b, a, theirs, mine).repartition(count, *[F.col(k) for k in on])
    # inline, not explode: the optimizer would copy each array to take a single field out of it
    met = asked.join(held.hint("merge"), on).select(*keys, *[F.col(f"`{c}`") for c in rest[1]], F.inline(block).alias(*fields))
    return met.select(*keys, *[F.col(f).alias(c) for f, c in zip(fields, rest[0])], *[F.col(f"`{c}`") for c in rest[1]])
