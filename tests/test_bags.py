"""Bags as counted pairs: hot pairs, long lists, names that clash."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from cellframe.operators import mutate
from cellframe.operators.tables import MultiTable
from tests.helpers import shuffle_reads
from tests.test_skew import plain  # noqa: F401

SCHEMA = "k string, v long"


def bagged(frame):
    return Counter(map(tuple, frame.collect()))


def test_hot_pair(plain):  # noqa: F811
    """A third of all rows are one pair: no task reads or writes them all."""
    bag = plain.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 5000)).alias("k"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11).alias("v"))
    held = bagged(bag)
    asked = plain.createDataFrame([("hot", 7), ("k1", 5), ("new", 1)], SCHEMA)
    calls = {
        "remove": (mutate.bag_remove(bag, asked), held - Counter({("hot", 7): 1, ("k1", 5): 1})),
        "absent": (mutate.bag_put_if_absent(bag, asked), held + Counter(set(map(tuple, asked.collect())) - set(held))),
        "compute": (mutate.bag_compute(bag, asked, ["k"], "v", lambda v: v + 100), held - Counter({("hot", 7): 1} | ({("k1", 5): 1} if held["k1", 5] else {})) + Counter([("hot", 107)] + [("k1", 105)] * bool(held["k1", 5]))),
        "move": (mutate.bag_move(bag, asked.filter("k = 'hot'").withColumn("to", F.lit("moved")), ["k"], ["to"]), held - Counter({("hot", 7): 1}) + Counter({("moved", 7): 1})),
    }
    for frame, want in calls.values():
        found = Counter()
        reads = shuffle_reads(plain, lambda frame=frame, found=found: found.update(bagged(frame)))
        assert found == want
        assert max(max(r) for r in reads) < 8000  # the hot pair has 20 000 rows
        tasks = frame.groupBy(F.spark_partition_id()).count().collect()
        assert max(r[1] for r in tasks) < 8000


def test_moves_against_brute_force(plain):  # noqa: F811
    bag = plain.createDataFrame([("a", 1)] * 3 + [("b", 2), ("c", None), ("d", 4)], SCHEMA)
    moves = plain.createDataFrame([("a", 1, "z"), ("a", 1, "x"), ("a", 1, "x"), ("a", 1, "y"), ("b", 2, "b"), ("c", None, "n"), ("e", 5, "q")], f"{SCHEMA}, _row string")
    assert bagged(mutate.bag_move(bag, moves, ["k"], ["_row"])) == Counter({("x", 1): 2, ("y", 1): 1, ("b", 2): 1, ("n", None): 1, ("d", 4): 1})
    more = plain.createDataFrame([("a", 1, "z")], f"{SCHEMA}, _row string")
    assert bagged(mutate.bag_move(bag, more, ["k"], ["_row"])) == Counter({("a", 1): 2, ("z", 1): 1, ("b", 2): 1, ("c", None): 1, ("d", 4): 1})
    assert bagged(mutate.bag_move(bag.limit(0), moves, ["k"], ["_row"])) == Counter()


def test_clashing_names(plain):  # noqa: F811
    table = plain.createDataFrame([(1, 2, 3), (2, 3, 4)], "_hit long, _new long, _held long")
    changes = plain.createDataFrame([(1, 9, 3, 8)], "_hit long, _new long, _old long, _result long")
    rows = lambda frame: sorted(map(tuple, frame.collect()))
    assert rows(mutate.replace(table, changes, ["_hit"], "_new")) == [(1, 9, 3), (2, 3, 4)]
    assert rows(mutate.compare_and_set(table, changes.withColumn("_old", F.lit(2)), ["_hit"], "_new", "_old", "_result")) == [(1, 8, 3), (2, 3, 4)]
    small = table.select("_hit", "_new")
    assert rows(mutate.compute(small, changes.select("_hit", "_result"), ["_hit"], "_new", lambda v, held: v + F.col("_result"))) == [(1, 10), (2, 3)]
    assert rows(mutate.remove_pairs(table, table.filter("_hit = 1").select("_hit", "_new"), ["_hit"], "_new")) == [(2, 3, 4)]
    bag = plain.createDataFrame([(1, 2), (1, 2)], "_copies long, _times long")
    assert rows(mutate.bag_remove(bag, bag.limit(1))) == [(1, 2)]
    assert rows(mutate.bag_compute(bag, bag.limit(1), ["_copies"], "_times", lambda v: v * 5)) == [(1, 2), (1, 10)]
    with pytest.raises(ValueError):
        mutate.bag_compute(table, table, ["_hit"], "_new", lambda v: v)


def test_long_lists(plain):  # noqa: F811
    rows = [("hot", i * 7 % 900) for i in range(3000)] + [(f"k{i % 40}", i) for i in range(400)] + [(None, 1), ("n", None), ("n", 3)]
    table = MultiTable(plain.createDataFrame(rows, SCHEMA).repartition(5), ("k",), ("v",))
    found = {}
    for r in table.listed(100).collect():
        assert len(r["values"]) <= 100
        found.setdefault(r.k, {})[r.ordinal] = [x.v for x in r["values"]]
    want = {}
    for k, v in rows:
        want.setdefault(k, []).append(v)
    del want[None]
    assert set(found) == set(want)
    for k, parts in found.items():
        assert sorted(parts) == list(range(len(parts))) and all(len(parts[i]) == 100 for i in range(len(parts) - 1))
        assert [v for i in sorted(parts) for v in parts[i]] == sorted(want[k], key=lambda v: (v is not None, v))
    assert sum(len(r["values"]) for r in table.listed(100, ("hot",)).collect()) == 3000
    assert table.listed(5, ("none",)).count() == 0
