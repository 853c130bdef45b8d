"""Map-style mutations as functions from tables to tables.

A batch of changes is applied as a whole, one change for each key: that with the greatest
``sequence``, where a column is named for it, and among equals the greatest by the other
columns in their order. A change whose key holds a null is none. ``keys`` are the key
columns; all others are values. Row presence, not a non-null value, is existence. Keys may
be arrays (points of any number of dimensions); columns of changes must be orderable.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellframe.functions.names import free


def keyed(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose key is whole."""
    for k in keys:
        frame = frame.filter(F.col(k).isNotNull())
    return frame


def last_writes(changes: DataFrame, keys: Sequence[str], sequence: str | None = None) -> DataFrame:
    """One change for each key, by one map-side combined aggregation: a key that changes often is no hot group."""
    rest = [c for c in changes.columns if c not in keys and c != sequence]
    whole = keyed(changes, keys)
    if not rest and sequence is None:
        return whole.select(*keys).distinct()
    order = F.struct(*([sequence] if sequence else []), *rest)
    last = whole.groupBy(*keys).agg(F.max(order).alias("_last"))
    return last.select(*keys, *[F.col("_last")[c].alias(c) for c in rest])


def put(table: DataFrame, changes: DataFrame, keys: Sequence[str], sequence: str | None = None) -> DataFrame:
    """Upsert."""
    new = last_writes(changes.select(*table.columns, *([sequence] if sequence else [])), keys, sequence).select(*table.columns)
    return table.join(new, list(keys), "left_anti").select(*table.columns).unionByName(new)


def previous(table: DataFrame, changes: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, previous, found): what a put, remove or replace of those keys would return."""
    asked = changes.select(*keys).distinct()
    held = table.select(*keys, F.col(value).alias("previous"), F.lit(True).alias("found"))
    return asked.join(held, list(keys), "left").withColumn("found", F.coalesce("found", F.lit(False)))


def put_if_absent(table: DataFrame, changes: DataFrame, keys: Sequence[str], sequence: str | None = None) -> DataFrame:
    new = last_writes(changes.select(*table.columns, *([sequence] if sequence else [])), keys, sequence)
    return table.unionByName(new.join(table, list(keys), "left_anti").select(*table.columns))


def remove(table: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Without the keys of ``gone``; of a bag, all values at them go."""
    return table.join(gone, list(keys), "left_anti")


def remove_pairs(table: DataFrame, gone: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Removes keys whose value equals the given one, null-safe."""
    names = free([table, gone], *[f"_{k}" for k in keys], "_value")
    right = gone.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=False)], F.col(value).alias(names[-1]))
    same = F.col(value).eqNullSafe(F.col(names[-1]))
    for k, n in zip(keys, names, strict=False):
        same = same & (F.col(k) == F.col(n))
    return table.join(right, same, "left_anti")


def replace(table: DataFrame, changes: DataFrame, keys: Sequence[str], value: str, sequence: str | None = None) -> DataFrame:
    """New values for keys that exist."""
    last = last_writes(changes.select(*keys, value, *([sequence] if sequence else [])), keys, sequence)
    given, hit = free(table, "_new", "_hit")
    new = last.select(*keys, F.col(value).alias(given), F.lit(True).alias(hit))
    joined = table.join(new, list(keys), "left")
    return joined.withColumn(value, F.when(F.col(hit), F.col(given)).otherwise(F.col(value))).select(*table.columns)


def compare_and_set(table: DataFrame, changes: DataFrame, keys: Sequence[str], value: str, old: str, new: str) -> DataFrame:
    """``new`` where the stored value equals ``old``, null-safe."""
    before, after, hit = free(table, "_old", "_new", "_hit")
    given = last_writes(changes.select(*keys, old, new), keys).select(*keys, F.col(old).alias(before), F.col(new).alias(after), F.lit(True).alias(hit))
    joined = table.join(given, list(keys), "left")
    swap = F.coalesce(F.col(hit), F.lit(False)) & F.col(value).eqNullSafe(F.col(before))
    return joined.withColumn(value, F.when(swap, F.col(after)).otherwise(F.col(value))).select(*table.columns)


def move(table: DataFrame, moves: DataFrame, keys: Sequence[str], new_keys: Sequence[str], on_conflict: str = "reject") -> DataFrame:
    """Moves entries to new keys; ``moves`` holds ``keys`` and ``new_keys``.

    A key that does not exist is not moved. A move onto a key that an entry holds is
    rejected, or with ``overwrite`` takes its place. All moves read the table as it was;
    of several onto one new key, the one with the smallest old key counts, and of several
    moves of one entry that to the greatest new key.
    """
    keys, new_keys = list(keys), list(new_keys)
    values = [c for c in table.columns if c not in keys]
    asked = keyed(last_writes(moves.select(*keys, *new_keys), keys), new_keys).join(keyed(table, keys).select(*keys), keys, "left_semi")
    first = asked.groupBy(*new_keys).agg(F.min(F.struct(*keys)).alias("_first"))
    wanted = first.select(*new_keys, *[F.col("_first")[k].alias(k) for k in keys]).join(table, keys)
    stay = F.lit(True)
    for k, new in zip(keys, new_keys, strict=True):
        stay = stay & (F.col(k) == F.col(new))
    wanted = wanted.filter(~stay)
    held = table.select(*[F.col(k).alias(new) for k, new in zip(keys, new_keys, strict=True)])
    if on_conflict == "reject":
        wanted = wanted.join(held, new_keys, "left_anti")
    elif on_conflict != "overwrite":
        raise ValueError("on_conflict is reject or overwrite")
    moved = wanted.select(*[F.col(new).alias(k) for k, new in zip(keys, new_keys, strict=True)], *values)
    rest = table.join(wanted.select(*keys), keys, "left_anti")
    if on_conflict == "overwrite":
        rest = rest.join(moved.select(*keys), keys, "left_anti")
    return rest.select(*table.columns).unionByName(moved.select(*table.columns))


def compute(table: DataFrame, asked: DataFrame, keys: Sequence[str], value: str, result: Callable[[Column, Column], Column], when: str = "always") -> DataFrame:
    """``result(stored value, whether stored)`` for each asked key; a null result deletes.

    ``when`` is ``always``, ``absent`` (only keys that do not exist) or ``present``. Columns
    of ``asked`` beyond the keys can be used in ``result``. ``table`` holds keys and value.
    """
    columns = table.columns
    args = [c for c in asked.columns if c not in keys]
    asked = last_writes(asked, keys)
    here, there, made = free([table, asked], "_held", "_asked", "_result")
    held = table.withColumn(here, F.lit(True))
    both = held.join(asked.withColumn(there, F.lit(True)), list(keys), "full_outer")
    stored, wanted = F.coalesce(here, F.lit(False)), F.coalesce(there, F.lit(False))
    applies = {"always": wanted, "absent": wanted & ~stored, "present": wanted & stored}[when]
    after = both.withColumn(made, result(F.col(value), stored))
    kept = (~applies & stored) | (applies & F.col(made).isNotNull())
    return after.filter(kept).withColumn(value, F.when(applies, F.col(made)).otherwise(F.col(value))).drop(here, there, made, *args).select(*columns)


# --- bags: (keys, value) pairs that may repeat, changed as pairs with a number of copies ---

#: Copies of a pair that one task writes out.
COPIES = 1000


def counted(bag: DataFrame, copies: str) -> DataFrame:
    """Each distinct pair once, with how many copies there are; nulls are equal. Tasks count before anything is shuffled."""
    return bag.groupBy(*bag.columns).agg(F.count("*").alias(copies))


def expanded(pairs: DataFrame, copies: str) -> DataFrame:
    """Every pair as often as ``copies`` says; those of one pair are dealt to many tasks, ``COPIES`` at a time."""
    (chunk,) = free(pairs, "_chunk")
    rest = [c for c in pairs.columns if c != copies]
    cut = pairs.filter(F.col(copies) > 0).withColumn(chunk, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / COPIES).cast("long"))))
    sized = cut.withColumn(copies, F.least(F.lit(COPIES).cast("long"), F.col(copies) - F.col(chunk) * COPIES))
    dealt = sized.repartition(*[F.col(c) for c in rest], F.col(chunk))
    return dealt.withColumn(chunk, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*rest)


def _held_and_asked(bag: DataFrame, asked: DataFrame, copies: str, times: str) -> DataFrame:
    """Each pair that the bag holds or that is asked for: copies, times asked, and the greatest of each further column of ``asked``.

    One aggregation of both, so that no pair is a hot group, however often it is there or asked for.
    """
    columns, more = bag.columns, [c for c in asked.columns if c not in bag.columns]
    kinds = dict(asked.dtypes)
    held = bag.select("*", F.lit(1).alias(copies), F.lit(0).alias(times), *[F.lit(None).cast(kinds[c]).alias(c) for c in more])
    wanted = asked.select(*columns, F.lit(0).alias(copies), F.lit(1).alias(times), *more)
    return held.unionByName(wanted).groupBy(*columns).agg(F.sum(copies).alias(copies), F.sum(times).alias(times), *[F.max(c).alias(c) for c in more])


def bag_put(bag: DataFrame, pairs: DataFrame) -> DataFrame:
    return bag.unionByName(pairs.select(*bag.columns))


def bag_remove(bag: DataFrame, pairs: DataFrame) -> DataFrame:
    """Removes one copy for each given pair."""
    copies, times = free(bag, "_copies", "_times")
    both = _held_and_asked(bag, pairs.select(*bag.columns), copies, times)
    return expanded(both.withColumn(copies, F.col(copies) - F.col(times)).drop(times), copies)


def bag_move(bag: DataFrame, moves: DataFrame, keys: Sequence[str], new_keys: Sequence[str]) -> DataFrame:
    """Moves one copy of each (keys, value) to its new keys, if there is one; of too many moves, those to the smallest new keys count.

    What is numbered for a pair are its distinct new keys, not its copies or moves.
    """
    copies, times, before, row = free([bag, moves], "_copies", "_times", "_before", "_row")
    kinds = dict(moves.dtypes)
    held = counted(bag, copies).select("*", F.lit(0).cast("long").alias(times), *[F.lit(None).cast(kinds[n]).alias(n) for n in new_keys])
    wanted = moves.groupBy(*bag.columns, *new_keys).agg(F.count("*").alias(times)).withColumn(copies, F.lit(0).cast("long"))
    pair = Window.partitionBy(*bag.columns)
    up_to = pair.orderBy(F.col(times) > 0, *new_keys).rowsBetween(Window.unboundedPreceding, -1)
    both = held.unionByName(wanted).withColumns({row: F.max(copies).over(pair), before: F.coalesce(F.sum(times).over(up_to), F.lit(0))})
    moved = F.greatest(F.lit(0), F.least(F.col(times), F.col(row) - F.col(before)))
    asked = F.sum(times).over(pair)
    left = F.greatest(F.lit(0), F.col(copies) - asked)
    here = F.col(times) > 0
    out = both.select(*[F.when(here, F.col(new)).otherwise(F.col(k)).alias(k) for k, new in zip(keys, new_keys, strict=True)], *[c for c in bag.columns if c not in keys], F.when(here, moved).otherwise(left).alias(copies))
    return expanded(out, copies).select(*bag.columns)


def bag_put_if_absent(bag: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds each given pair once unless the bag holds an equal one."""
    copies, times = free(bag, "_copies", "_times")
    both = _held_and_asked(bag, pairs.select(*bag.columns), copies, times)
    return expanded(both.withColumn(copies, F.greatest(F.col(copies), F.lit(1))).drop(times), copies)


def bag_replace(bag: DataFrame, changes: DataFrame, keys: Sequence[str], value: str, old: str, new: str) -> DataFrame:
    """One copy of each (keys, ``old``) gets the value ``new``, if there is one; a null ``new`` removes it."""
    (after,) = free([bag, changes], "_after")
    asked = changes.select(*keys, F.col(old).alias(value), F.col(new).alias(after))
    return bag_compute(bag, asked, keys, value, lambda v: F.col(after))


def bag_compute_if_absent(bag: DataFrame, asked: DataFrame, keys: Sequence[str], value: str, result: Callable[[Column], Column]) -> DataFrame:
    """For each asked (keys, value) without an equal pair, ``result(value)`` is added at the keys, unless null."""
    return bag_compute(bag, keyed(asked, [value]), keys, value, None, result)


def bag_compute(bag: DataFrame, asked: DataFrame, keys: Sequence[str], value: str, result: Callable[[Column], Column] | None, absent: Callable[[Column], Column] | None = None) -> DataFrame:
    """For each asked (keys, value) that the bag holds, one copy gets a new value; a null result removes it.

    Columns of ``asked`` beyond these can be used in ``result``. With ``absent``, pairs that
    are not held are added as in ``bag_compute_if_absent``; without ``result``, held ones stay.
    The bag has no columns but these.
    """
    if sorted(bag.columns) != sorted([*keys, value]):
        raise ValueError("a bag holds keys and one value")
    copies, times, change, made = free([bag, asked], "_copies", "_times", "_change", "_made")
    both = _held_and_asked(bag, keyed(asked, keys), copies, times)
    wanted, held = F.col(times) > 0, F.col(copies) > 0
    nothing = F.lit(None).cast(bag.schema[value].dataType)
    new = F.when(wanted & held, result(F.col(value)) if result else nothing).when(wanted & ~held, absent(F.col(value)) if absent else nothing)
    gone = F.when(wanted & held, F.lit(1)).otherwise(F.lit(0)) if result else F.lit(0)
    told = both.withColumn(made, new.cast(bag.schema[value].dataType))
    kept = F.struct(F.col(value).alias(value), (F.col(copies) - gone).alias(copies))
    added = F.struct(F.col(made).alias(value), F.when(F.col(made).isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("long").alias(copies))
    after = told.select(*keys, F.explode(F.array(kept, added)).alias(change))
    return expanded(after.select(*keys, F.col(change)[value].alias(value), F.col(change)[copies].alias(copies)), copies).select(*bag.columns)


# --- sets ---


def set_insert(keys: DataFrame, new: DataFrame) -> DataFrame:
    return keys.unionByName(new).distinct()


def set_delete(keys: DataFrame, gone: DataFrame) -> DataFrame:
    return keys.join(gone, keys.columns, "left_anti")
