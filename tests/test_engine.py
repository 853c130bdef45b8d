"""Literal fixtures and seeded comparisons with brute force."""

import math
import random
import struct
from collections import Counter, defaultdict
from itertools import islice

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from cellframe.functions import bits, encoding
from cellframe.functions.metrics import L1, L2, Custom, Decoded
from cellframe.operators import joins, mutate, order, stats
from cellframe.operators.tables import ArrayTable, BoxTable, MultiTable, SpatialTable
from cellframe.plans import bounded
from cellframe.sources.clustered import read_points, read_tokens, write_clustered
from cellframe.sources.shared import dropping, shared_path
from cellframe.sources.stored import StoredTable
from cellframe.streaming.moving import keep_updates, latest, maintain, maintain_buckets, read_buckets, read_updates, windowed_counts


@pytest.fixture(scope="module")
def grid5(spark):
    return SpatialTable(spark.createDataFrame([(3, 3), (2, 2), (4, 4), (2, 4), (4, 2)], "k0 long, k1 long"), ("k0", "k1"))


def test_ball_and_neighbours(grid5):
    assert grid5.within((3, 3), 1.5).count() == 5
    near = grid5.nearest(4, (3, 3)).collect()
    assert (near[0].k0, near[0].k1, near[0].dist) == (3, 3, 0.0)
    assert [r.dist for r in near[1:]] == [math.sqrt(2)] * 3
    assert grid5.nearest(0, (3, 3)).collect() == []
    assert grid5.nearest(9, (3, 3)).count() == 5
    with pytest.raises(ValueError):
        grid5.window((1,), (2,))


def test_box_truth_table(spark):
    rows = [(2.0, 3.0, 7.0, 8.0, "e1"), (-1.0, -2.0, 1.0, 2.0, "e2"), (-7.0, -8.0, -2.0, -3.0, "e3")]
    table = BoxTable(spark.createDataFrame(rows, "a double, b double, c double, d double, v string"), ("a", "b"), ("c", "d"), ("v",))
    names = lambda frame: sorted(r.v for r in frame.collect())
    for low, high, include, meet in [
        ((-1, -1), (1, 1), [], ["e2"]),
        ((-5, -5), (-4, -4), [], ["e3"]),
        ((4, 4), (5, 5), [], ["e1"]),
        ((-5, -5), (5, 5), ["e2"], ["e1", "e2", "e3"]),
        ((-15, -15), (15, 15), ["e1", "e2", "e3"], ["e1", "e2", "e3"]),
    ]:
        assert names(table.include(low, high)) == include
        assert names(table.intersect(low, high)) == meet
    assert table.as_points().dim == 4
    assert table.as_points().as_boxes().keys == table.keys


@pytest.mark.parametrize("dim", [1, 3, 5])
def test_against_brute_force(spark, dim):
    rng = np.random.default_rng(dim)
    points = rng.uniform(0, 1000, (400, dim))
    keys = tuple(f"k{i}" for i in range(dim))
    frame = spark.createDataFrame([(*map(float, p), i) for i, p in enumerate(points)], ", ".join(f"{k} double" for k in keys) + ", id long")
    table = SpatialTable(frame, keys, ("id",))
    center = tuple(map(float, rng.uniform(0, 1000, dim)))
    for metric, norm in ((L2(), 2), (L1(), 1)):
        dist = np.linalg.norm(points - center, ord=norm, axis=1)
        radius = float(np.sort(dist)[60])
        assert {r.id for r in table.within(center, radius * (1 + 1e-12), metric).collect()} == set(np.flatnonzero(dist <= radius * (1 + 1e-12)).tolist())
        assert [r.id for r in table.nearest(20, center, metric).collect()] == np.argsort(dist, kind="stable")[:20].tolist()
        assert [r.id for r in bounded.nearest(table, 20, center, metric).collect()] == np.argsort(dist, kind="stable")[:20].tolist()
    low, high = points.min(axis=0) + 200, points.max(axis=0) - 200
    inside = ((points >= low) & (points <= high)).all(axis=1)
    assert {r.id for r in table.window(low.tolist(), high.tolist()).collect()} == set(np.flatnonzero(inside).tolist())
    own = Custom(lambda p, c: F.abs(p[0] - c[0]))
    assert table.nearest(1, center, own).first().id == int(np.abs(points[:, 0] - center[0]).argmin())


def test_spatial_joins_against_brute_force(spark):
    rng = np.random.default_rng(7)
    points = rng.normal(0, 50, (300, 2))
    lows = rng.normal(0, 50, (60, 2))
    highs = lows + rng.exponential([5, 40], (60, 2))
    highs[:5] = lows[:5]
    frame = spark.createDataFrame([(*map(float, p), i) for i, p in enumerate(points)], "x double, y double, p long")
    boxes = spark.createDataFrame([(*map(float, a), *map(float, b), i) for i, (a, b) in enumerate(zip(lows, highs, strict=True))], "a0 double, a1 double, b0 double, b1 double, q long")
    got = {(r.p, r.q) for r in joins.window_join(frame, boxes, ["x", "y"], ["a0", "a1"], ["b0", "b1"]).collect()}
    assert got == {(i, j) for i, p in enumerate(points) for j in range(60) if (p >= lows[j]).all() and (p <= highs[j]).all()}
    other = boxes.select(*[F.col(c).alias(f"o_{c}") for c in boxes.columns])
    pairs = joins.box_join(boxes, other, ["a0", "a1"], ["b0", "b1"], ["o_a0", "o_a1"], ["o_b0", "o_b1"]).collect()
    want = [(i, j) for i in range(60) for j in range(60) if (lows[i] <= highs[j]).all() and (highs[i] >= lows[j]).all()]
    assert sorted((r.q, r.o_q) for r in pairs) == want
    queries = spark.createDataFrame([(*map(float, p), i) for i, p in enumerate(lows[:10])], "u double, v double, q long")
    near = joins.nearest_join(frame, queries, ["x", "y"], ["u", "v"], "q", ["p"], 4).collect()
    for j in range(10):
        dist = np.linalg.norm(points - lows[j], axis=1)
        assert [r.p for r in sorted(near, key=lambda r: r["rank"]) if r.q == j] == np.argsort(dist, kind="stable")[:4].tolist()


def test_encodings(spark):
    values = [0.0, -0.0, 1.5, -1.5, math.inf, -math.inf, math.nan, 5e-324, -5e-324, 1.7e308]
    frame = spark.createDataFrame([(v,) for v in values], "x double").select("x", encoding.sortable_long(F.col("x")).alias("k"))
    got = {struct.pack(">d", r.x): r.k for r in frame.select("x", "k").collect()}
    key = lambda v: got[struct.pack(">d", v)]
    order = [-math.inf, -1.5, -5e-324, -0.0, 0.0, 5e-324, 1.5, 1.7e308, math.inf]
    assert [key(v) for v in order] == sorted(key(v) for v in order) and key(-0.0) == -1 and key(0.0) == 0
    back = frame.select("x", encoding.from_sortable_long(F.col("k")).alias("y")).collect()
    assert all(struct.pack(">d", r.x) == struct.pack(">d", r.y) for r in back)
    narrow = frame.select(F.col("x").cast("float").alias("x")).select("x", encoding.from_sortable_int(encoding.sortable_int(F.col("x"))).alias("y")).collect()
    assert all(struct.pack(">f", r.x) == struct.pack(">f", r.y) for r in narrow)
    saturated = spark.createDataFrame([(1e300,), (-1e300,), (math.nan,), (-2.9,)], "x double").select(encoding.saturating_long(F.col("x")).alias("k"))
    assert [r.k for r in saturated.collect()] == [2**63 - 1, -(2**63), 0, -2]


def test_string_keys(spark):
    texts = ["", "a", "abcdefgh", "zebra", "Zebra"]

    def want(s):
        n = 0
        for i in range(6):
            n = (n | (ord(s[i]) if i < len(s) else 0)) << 8
        h = 0
        for c in s:
            h = (31 * h + ord(c)) % 2**32
        return n << 8 | h & 0xFFFF

    got = spark.createDataFrame([(t,) for t in texts], "s string").select("s", encoding.string_key(F.col("s")).alias("k")).collect()
    assert {r.s: r.k for r in got} == {t: want(t) for t in texts}


def test_exponent_shift(spark):
    frame = spark.createDataFrame([(0.4, -700.0), (0.6, 3.0), (None, math.nan)], "k0 double, k1 double")
    shifted = encoding.analyse(frame, ["k0", "k1"])
    keys = frame.limit(2).select(*[shifted.pre(F.col(k), d).alias(k) for d, k in enumerate(("k0", "k1"))]).collect()
    assert all(keys[0][k] >> 52 == keys[1][k] >> 52 for k in ("k0", "k1"))


def test_bits(spark):
    rng = np.random.default_rng(3)
    rows = [tuple(map(int, rng.integers(-(2**63), 2**63 - 1, 2))) for _ in range(40)] + [(0, 0), (-1, 0), (2**63 - 1, -(2**63))]
    a, b = F.col("a"), F.col("b")
    z = bits.path([a, b])
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", bits.from_path(z, 0, 2).alias("x"), bits.from_path(z, 1, 2).alias("y"), bits.conflicting_bits([a], [b]).alias("c"), bits.reverse(a, 20).alias("r"), bits.next_address(a, 5, 0xFF5).alias("n"), bits.binary_text(a, 64).alias("t"), bits.apply_address(a, 2, 63, 0, 2).alias("s"), bits.interleave([a, b], 16).alias("i"), *[k.alias(f"d{j}") for j, k in enumerate(bits.deinterleave(bits.interleave([a, b], 16), 2, 16))]).collect()
    for r in got:
        u = r.a % 2**64
        assert (r.x, r.y) == (r.a, r.b)
        assert r.c == ((r.a ^ r.b) % 2**64).bit_length()
        assert r.r == int(f"{u % 2**20:020b}"[::-1], 2)
        assert r.n % 2**64 == ((((u | (2**64 - 1 - 0xFF5)) + 1) % 2**64) & 0xFF5 | 5)
        assert r.t == f"{u:064b}"
        assert r.s < 0
        assert (r.d0, r.d1) == (r.a % 2**16, r.b % 2**16)
    dominated = spark.range(1).select(bits.dominates([F.lit(3), F.lit(0)], [F.lit(1), F.lit(2)]).alias("yes"), bits.dominates([F.lit(1), F.lit(0)], [F.lit(1), F.lit(2)]).alias("no")).first()
    assert dominated.yes and not dominated.no


def test_mutations_with_nulls(spark):
    table = spark.createDataFrame([(1, 10), (2, None), (3, 30)], "k long, v long")
    as_set = lambda frame: {tuple(r) for r in frame.collect()}
    assert as_set(mutate.put_if_absent(table, spark.createDataFrame([(2, 5), (4, 6)], "k long, v long"), ["k"])) == {(1, 10), (2, None), (3, 30), (4, 6)}
    swap = spark.createDataFrame([(2, None, 7), (3, 31, 8)], "k long, old long, new long")
    assert as_set(mutate.compare_and_set(table, swap, ["k"], "v", "old", "new")) == {(1, 10), (2, 7), (3, 30)}
    assert as_set(mutate.remove_pairs(table, spark.createDataFrame([(2, None), (3, 0)], "k long, v long"), ["k"], "v")) == {(1, 10), (3, 30)}
    moves = spark.createDataFrame([(1, 2), (3, 9), (8, 10)], "k long, to long")
    assert as_set(mutate.move(table, moves, ["k"], ["to"])) == {(1, 10), (2, None), (9, 30)}
    assert as_set(mutate.move(table, moves, ["k"], ["to"], "overwrite")) == {(2, 10), (9, 30)}


def test_multimap(spark):
    table = MultiTable(spark.createDataFrame([(1.0, 1.0, 5), (1.0, 1.0, 5), (1.0, 1.0, 6), (4.0, 4.0, 7)], "x double, y double, v long"), ("x", "y"), ("v",))
    assert [r.v for r in table.grouped((1.0, 1.0)).first()["values"]] == [5, 5, 6]
    assert table.grouped((9.0, 9.0)).first()["values"] == []
    assert table.contains_pair((1.0, 1.0), 6) and not table.contains_pair((1.0, 1.0), 7)
    assert table.nearest_positions(1, (0.0, 0.0)).count() == 3
    assert table.nearest(1, (0.0, 0.0)).count() == 1
    assert not table.unique_keys()


def test_clustered_files_and_tokens(spark, tmp_path):
    frame = spark.range(2000).select((F.col("id") * 7919 % 1000).alias("a"), (F.col("id") * 104729 % 777).alias("b"))
    write_clustered(frame, str(tmp_path / "z"), ["a", "b"], files=4)
    table = read_points(spark, str(tmp_path / "z"), ("a", "b"))
    assert table.window((100, 100), (300, 300)).count() == frame.filter("a BETWEEN 100 AND 300 AND b BETWEEN 100 AND 300").count()
    plan = table.window((100, 100), (300, 300))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(a,100)" in plan and "LessThanOrEqual(a,300)" in plan
    (tmp_path / "t.txt").write_text("1.5 2\n 3 x\n4\n")
    assert [tuple(r) for r in read_tokens(spark, str(tmp_path / "t.txt"), ["x", "y"]).collect()] == [(1.5, 2.0), (3.0, None), (4.0, None)]


def test_moving_objects(spark, tmp_path):
    source = tmp_path / "in"
    rows = [(1, 5, 0.5), (2, 4, 0.1), (1, 7, 0.7), (2, 3, 9.0)]
    spark.createDataFrame(rows, "id long, t long, x double").coalesce(1).write.parquet(str(source))
    assert {tuple(r) for r in latest(spark.read.parquet(str(source)), "id", "t").collect()} == {(1, 7, 0.7), (2, 4, 0.1)}
    state = {}
    stream = spark.readStream.schema("id long, t long, x double").parquet(str(source))

    def store(frame, number):
        path = str(tmp_path / f"state{number}")
        frame.write.mode("overwrite").parquet(path)
        state["path"] = path

    load = lambda: spark.read.parquet(state["path"]) if state else None
    for extra in ([], [(2, 9, 2.5), (1, 6, 6.6)]):
        if extra:
            spark.createDataFrame(extra, "id long, t long, x double").coalesce(1).write.mode("append").parquet(str(source))
        maintain(stream, "id", "t", load, store, str(tmp_path / "ck")).awaitTermination(60)
    assert {tuple(r) for r in load().collect()} == {(1, 7, 0.7), (2, 9, 2.5)}


def test_trie_histograms_and_include_join(spark):
    rng = random.Random(31)
    keys = {(rng.choice([-1, 1]) * rng.randrange(1 << rng.choice([3, 20, 62])), rng.randrange(1 << 12)) for _ in range(300)}
    sizes, infixes = Counter(), Counter()

    def walk(group, parent):
        first, level = group[0], 63
        if parent is not None:
            level = max(((x ^ y) & (1 << 64) - 1).bit_length() - 1 for k in group for x, y in zip(k, first, strict=True))
        children = defaultdict(list)
        for k in group:
            children[tuple(x >> level & 1 for x in k)].append(k)
        sizes[len(children).bit_length()] += 1
        infixes[0 if parent is None else parent - level - 1] += 1
        for child in children.values():
            if len(child) > 1:
                walk(child, level)

    walk(sorted(keys), None)
    frame = spark.createDataFrame(sorted(keys), "x long, y long")
    assert {r.size_log: r.n_nodes for r in stats.node_sizes(frame, ["x", "y"]).collect()} == sizes
    assert {r.infix_len: r.n_nodes for r in stats.infix_lengths(frame, ["x", "y"]).collect()} == infixes

    def boxes(n, most):
        return [(i, x, y, x + rng.random() * most, y + rng.random() * most) for i in range(n) for x, y in [(rng.random() * 9, rng.random() * 9)]]

    small, big = [*boxes(150, 1), (900, 2.0, 2.0, 3.0, 3.0)], [*boxes(80, 6), (901, 2.0, 2.0, 3.0, 3.0)]
    left, right = (spark.createDataFrame(b, f"{s}i int, {s}x double, {s}y double, {s}u double, {s}v double") for b, s in ((small, "l"), (big, "r")))
    got = joins.box_join(left, right, ["lx", "ly"], ["lu", "lv"], ["rx", "ry"], ["ru", "rv"], include=True).collect()
    want = sorted((a[0], b[0]) for a in small for b in big if a[1] >= b[1] and a[2] >= b[2] and a[3] <= b[3] and a[4] <= b[4])
    assert sorted((r.li, r.ri) for r in got) == want and (900, 901) in want and len(want) > 20


def test_nulls_and_nan_among_neighbours(spark):
    rows = [(1.0, 0), (None, 1), (math.nan, 2), (4.0, 3), (2.0, 4), (2.0, 4)]
    frame = spark.createDataFrame(rows, "k double, v long")
    for table in (SpatialTable(frame, ("k",), ("v",)), MultiTable(frame, ("k",), ("v",))):
        assert [r.v for r in table.nearest(9, (0.0,)).collect()] == [0, 4, 4, 3, 2]
        assert [r.v for r in bounded.nearest(table, 3, (0.0,)).collect()] == [0, 4, 4]
        assert sorted(r.v for r in table.within((0.0,), 3.0).collect()) == [0, 4, 4]
    assert sorted(r.v for r in MultiTable(frame, ("k",), ("v",)).nearest_positions(2, (0.0,)).collect()) == [0, 4, 4]
    assert bounded.nearest(SpatialTable(frame.filter("k IS NULL"), ("k",), ("v",)), 2, (0.0,)).collect() == []
    boxes = BoxTable(spark.createDataFrame([(1.0, 2.0, 1), (None, 2.0, 2), (5.0, 6.0, 3)], "a double, b double, v long"), ("a",), ("b",), ("v",))
    assert [r.v for r in boxes.nearest(5, (0.0,)).collect()] == [1, 3]
    arrays = ArrayTable(spark.createDataFrame([([1.0, 2.0], 1), (None, 2), ([1.0, None], 3), ([9.0, 9.0], 4)], "k array<double>, v long"), "k", ("v",))
    assert [r.v for r in arrays.nearest(5, (0.0, 0.0)).collect()] == [1, 4]


def test_neighbours_one_by_one(spark):
    rng = random.Random(4)
    rows = [(float(rng.randrange(6)), float(rng.randrange(6)), rng.choice([None, 1, 2])) for _ in range(120)] + [(3.0, 3.0, 7)] * 25 + [(None, 1.0, 1)]
    table = MultiTable(spark.createDataFrame(rows, "x double, y double, v long"), ("x", "y"), ("v",))
    every = [tuple(r) for r in table.nearest(500, (3.0, 3.0)).collect()]
    assert len(every) == 145 and [tuple(r) for r in table.neighbours((3.0, 3.0), batch=7)] == every
    assert [tuple(r) for r in islice(table.neighbours((3.0, 3.0), batch=3), 11)] == every[:11]


def test_positions_shuffle_no_more_than_the_nearest(spark):
    frame = spark.range(5000).select((F.col("id") % 40).cast("double").alias("x"), F.lit(1.0).alias("y"), "id")
    table = MultiTable(frame, ("x", "y"), ("id",))
    assert table.nearest_positions(2, (7.2, 1.0)).select("x").distinct().count() == 2
    places = [line for line in table.nearest_positions(2, (7.2, 1.0))._jdf.queryExecution().optimizedPlan().toString().splitlines() if "MapInArrow" in line or "Aggregate" in line]
    assert "Aggregate" in places[0] and "MapInArrow" in places[1]


def test_lookups_of_boxes_and_arrays(spark):
    boxes = BoxTable(spark.createDataFrame([(1.0, 2.0, "a"), (1.0, 3.0, "b")], "lo double, hi double, v string"), ("lo",), ("hi",), ("v",))
    assert boxes.get((1.0,), (3.0,)).first().v == "b" and boxes.contains({"lo": 1.0, "hi": 2.0}) and not boxes.contains((1.0,), (9.0,))
    entry = boxes.extent().filter("v = 'b'").first()
    assert [r.v for r in boxes.include(entry).orderBy("v").collect()] == ["a", "b"] and boxes.intersect((2.5,)).first().v == "b"
    assert [r.v for r in boxes.within(0.5, (3.4,)).collect()] == ["b"] and boxes.within(0.7, (2.1,), metric="center").count() == 2
    arrays = ArrayTable(spark.createDataFrame([([1.0, 2.0], 1), ([3.0, 4.0], 2)], "k array<double>, v long"), "k", ("v",))
    assert arrays.get([3.0, 4.0]).first().v == 2 and arrays.contains([1.0, 2.0]) and not arrays.contains([1.0])
    assert [tuple(r) for r in arrays.window([0, 0], [9, 9], where=F.col("v") > 1).collect()] == [([3.0, 4.0], 2)]


def test_batches_with_repeated_and_null_keys(spark):
    table = spark.createDataFrame([(1, 10), (2, 20), (None, 5)], "k long, v long")
    changes = spark.createDataFrame([(1, 11), (1, 12), (3, None), (3, 30), (None, 6)], "k long, v long")
    as_list = lambda frame: sorted((tuple(r) for r in frame.collect()), key=repr)
    assert as_list(mutate.put(table, changes, ["k"])) == [(1, 12), (2, 20), (3, 30), (None, 5)]
    assert as_list(mutate.put_if_absent(table, changes, ["k"])) == [(1, 10), (2, 20), (3, 30), (None, 5)]
    assert as_list(mutate.replace(table, changes, ["k"], "v")) == [(1, 12), (2, 20), (None, 5)]
    sequenced = spark.createDataFrame([(1, 12, 1), (1, 11, 2)], "k long, v long, s long")
    assert as_list(mutate.put(table, sequenced, ["k"], "s")) == [(1, 11), (2, 20), (None, 5)]
    assert as_list(mutate.replace(table, sequenced, ["k"], "v", "s")) == [(1, 11), (2, 20), (None, 5)]
    swaps = spark.createDataFrame([(1, 10, 7), (1, 10, 8), (2, 0, 9)], "k long, old long, new long")
    assert as_list(mutate.compare_and_set(table, swaps, ["k"], "v", "old", "new")) == [(1, 8), (2, 20), (None, 5)]
    assert as_list(mutate.compute(table, changes.select("k", F.col("v").alias("by")), ["k"], "v", lambda v, held: F.coalesce(v, F.lit(0)) + F.col("by"))) == [(1, 22), (2, 20), (3, 30), (None, 5)]
    moves = spark.createDataFrame([(1, 5), (1, 6), (2, 6), (None, 9)], "k long, to long")
    assert as_list(mutate.move(table, moves, ["k"], ["to"])) == [(2, 20), (6, 10), (None, 5)]


def test_bag_calls(spark):
    bag = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), ("b", 2)], "k string, v long")
    as_list = lambda frame: sorted((tuple(r) for r in frame.collect()), key=repr)
    pairs = spark.createDataFrame([("a", 1), ("a", 5), ("a", 5), ("a", None), ("c", None)], "k string, v long")
    assert as_list(mutate.bag_put_if_absent(bag, pairs)) == [("a", 1), ("a", 1), ("a", 5), ("a", None), ("b", 2), ("c", None)]
    changes = spark.createDataFrame([("a", 1, 9), ("b", 3, 4), ("b", 2, None)], "k string, old long, new long")
    assert as_list(mutate.bag_replace(bag, changes, ["k"], "v", "old", "new")) == [("a", 1), ("a", 9), ("a", None)]
    assert as_list(mutate.bag_compute_if_absent(bag, pairs, ["k"], "v", lambda v: v * 2)) == [("a", 1), ("a", 1), ("a", 10), ("a", None), ("b", 2)]
    both = mutate.bag_compute(bag, pairs, ["k"], "v", lambda v: v + 100, absent=lambda v: F.coalesce(v, F.lit(-1)))
    assert as_list(both) == [("a", 1), ("a", 101), ("a", 5), ("b", 2), ("c", -1)]


def test_joins_of_boxes_without_a_width(spark):
    rng = np.random.default_rng(2)
    points = np.round(rng.uniform(0, 20, (400, 2)))
    points[:3] = [[1e12, 0], [0, -1e12], [1e300, 5]]
    frame = spark.createDataFrame([(*map(float, p), i) for i, p in enumerate(points)] + [(None, 1.0, 900)], "x double, y double, p long")
    other = frame.select(F.col("x").alias("u"), F.col("y").alias("v"), F.col("p").alias("q"))
    same = sorted((i, j) for i in range(400) for j in range(400) if (points[i] == points[j]).all())
    got = joins.window_join(frame, other, ["x", "y"], ["u", "v"], ["u", "v"]).collect()
    assert sorted((r.p, r.q) for r in got) == same
    got = joins.box_join(frame, other, ["x", "y"], ["x", "y"], ["u", "v"], ["u", "v"]).collect()
    assert sorted((r.p, r.q) for r in got) == same
    got = joins.distance_join(frame, other, ["x", "y"], ["u", "v"], 0.0).collect()
    assert sorted((r.p, r.q) for r in got) == same and all(r.dist == 0 for r in got)
    near = joins.distance_join(frame, other, ["x", "y"], ["u", "v"], 1.0, L1()).collect()
    assert sorted((r.p, r.q) for r in near) == sorted((i, j) for i in range(400) for j in range(400) if np.abs(points[i] - points[j]).sum() <= 1)
    with pytest.raises(ValueError):
        joins.distance_join(frame, other, ["x", "y"], ["u", "v"], 1.0, Custom(lambda p, c: p[0]))


def test_cells_grow_with_the_data(spark):
    """Ten times the points give about ten times the cells, wherever a few outliers lie."""
    cells = []
    for n in (1000, 10_000):
        frame = spark.range(n).select((F.rand(3) * 10).alias("x"), (F.rand(4) * 10).alias("y")).unionByName(spark.createDataFrame([(1e9, -1e9)], "x double, y double"))
        level, count = joins.finest_level(frame, ["x", "y"], [1.0, 1.0])
        assert count == n + 1
        cells.append(frame.select(*[joins._cell(F.col(c), F.lit(float(level)), 1.0).alias(c) for c in ("x", "y")]).distinct().count())
    assert cells[0] > 1000 / 32 and 4 <= cells[1] / cells[0] <= 25


def test_levels_cost_copies_or_cells():
    assert joins.listing_levels({0: 10, 2: 10, 4: 1}, 1000, 2) == {0: 0, 2: 0, 4: 0}
    assert joins.listing_levels({0: 10**6, 2: 10**6}, 1000, 2) == {0: 0, 2: 2}
    assert joins.listing_levels({}, 5, 2) == {} and joins.listing_levels({0: 1, 40: 1}, 10**9, 2) == {0: 0, 40: 40}


def test_neighbour_join_with_far_queries_and_hot_cells(spark):
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(0, 1, (150, 2)), np.zeros((100, 2)), rng.normal(1000, 1, (50, 2)), [[-1e6, 3.0]]])
    queries = np.concatenate([points[::40], [[5000.0, -5000.0], [1e9, 0.0], [-1e6, 3.0], [500.0, 500.0]]])
    frame = spark.createDataFrame([(*map(float, p), i) for i, p in enumerate(points)] + [(None, 0.0, 998), (math.nan, 0.0, 999)], "x double, y double, p long")
    asked = spark.createDataFrame([(*map(float, q), j) for j, q in enumerate(queries)] + [(None, 1.0, 77)], "u double, v double, q long")
    for n, metric, norm in ((4, L2(), 2), (7, L1(), 1), (400, L2(), 2)):
        near = joins.nearest_join(frame, asked, ["x", "y"], ["u", "v"], "q", ["p"], n, metric).collect()
        for j, q in enumerate(queries):
            dist = np.linalg.norm(points - q, ord=norm, axis=1)
            got = sorted((r for r in near if r.q == j), key=lambda r: r["rank"])
            assert [r.p for r in got] == np.lexsort((np.arange(len(points)), [r.dist for r in sorted(near, key=lambda r: r.p) if r.q == j] if n == 400 else dist))[:n].tolist() or np.allclose([r.dist for r in got], np.sort(dist)[: len(got)]) and len(got) == min(n, len(points))
        assert not [r for r in near if r.q == 77]
    assert joins.nearest_join(frame.limit(0), asked, ["x", "y"], ["u", "v"], "q", ["p"], 3).collect() == []
    assert joins.nearest_join(frame, asked, ["x", "y"], ["u", "v"], "q", ["p"], 0).collect() == []


def test_places_without_a_single_task(spark):
    rng = random.Random(1)
    rows = [(rng.choice([0, 0, rng.randrange(50), None]), i) for i in range(700)]
    frame = spark.createDataFrame(rows, "k long, id long").repartition(3)
    want = {i: n for n, (_, i) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])), 1)}
    placed = order.places(frame, ["k", "id"], parts=6)
    assert {r.id: r.place for r in placed.collect()} == want
    assert "SinglePartition" not in placed._jdf.queryExecution().executedPlan().toString()
    assert order.places(frame.limit(0), ["k", "id"]).collect() == []


def scanned(frame):
    """Rows that the scan of a finished query gave out: row groups that statistics rule out give none."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    leaves = (plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan).collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_clustered_files_are_skipped(spark, tmp_path):
    """Quantile cells keep files apart although a few values lie far off and one value is a third of all."""
    frame = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(7.0)).when(F.col("id") % 1000 == 1, F.rand(1) * 1e9).otherwise(F.rand(2) * 100).alias("a"), (F.rand(3) * 100).alias("b"), "id")
    frame.repartition(16).write.parquet(str(tmp_path / "plain"))
    write_clustered(spark.read.parquet(str(tmp_path / "plain")), str(tmp_path / "z"), ["a", "b"], files=16)
    plain, clustered = (read_points(spark, str(tmp_path / name), ("a", "b"), ("id",)) for name in ("plain", "z"))
    sizes = [r["count"] for r in clustered.df.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 4 * 30_000 / 16
    low, high = (40.0, 40.0), (50.0, 50.0)
    assert sorted(map(tuple, clustered.window(low, high).collect())) == sorted(map(tuple, plain.window(low, high).collect()))
    assert scanned(clustered.window(low, high)) < 0.5 * scanned(plain.window(low, high))
    near = bounded.nearest(clustered, 5, (45.0, 45.0))
    assert [r.id for r in near.collect()] == [r.id for r in plain.nearest(5, (45.0, 45.0)).collect()]
    assert scanned(near) < 0.5 * scanned(plain.nearest(5, (45.0, 45.0)))


def test_bounds_of_encoded_balls(spark):
    frame = spark.createDataFrame([(float(x) / 4,) for x in range(-200, 200)] + [(math.inf,), (-math.inf,)], "x double")
    for own in (encoding.Ieee(), encoding.Ieee(3.5), encoding.Multiply(10.0), encoding.Multiply(7.0, 1.0)):
        stored = SpatialTable(frame.select(own.pre(F.col("x"), 0).alias("k")), ("k",), (), own)
        metric = Decoded(own)
        low, high = metric.box((1.0,), 2.5)[0]
        assert isinstance(low, int) and low < high
        every = stored.df.withColumn("dist", metric.distance([F.col("k")], [F.lit(1.0)])).filter("dist <= 2.5").count()
        assert stored.within((1.0,), 2.5, metric).count() == every > 15


def test_long_addresses(spark):
    rng = random.Random(6)
    edge = [0, -1, 2**63 - 1, -(2**63)]
    rows = [tuple(rng.choice([rng.choice(edge), rng.randrange(-(2**63), 2**63)]) for _ in range(4)) for _ in range(80)]
    a, b = F.array("a", "b"), F.array("c", "d")
    got = spark.createDataFrame(rows, "a long, b long, c long, d long").select("*", bits.long_increment(a).alias("up"), bits.long_decrement(a).alias("down"), bits.long_less(a, b).alias("less"), bits.long_xor_count(a, b).alias("xor"), bits.long_next_address(a, F.array(F.lit(1).cast("long"), F.lit(5).cast("long")), F.array(F.lit(255).cast("long"), F.lit(13).cast("long"))).alias("next"), bits.long_in_mask(F.array(F.lit(7).cast("long")), F.array(F.lit(5).cast("long")), F.array(F.lit(15).cast("long"))).alias("yes")).collect()
    number = lambda hi, lo: (hi % 2**64) << 64 | lo % 2**64
    low, high = number(1, 5), number(255, 13)
    for r in got:
        x, y = number(r.a, r.b), number(r.c, r.d)
        assert number(*r.up) == (x + 1) % 2**128 and number(*r.down) == (x - 1) % 2**128
        assert r.less == (x < y) and r.xor == (x ^ y).bit_count() and r.yes
        assert number(*r.next) == ((x | (2**128 - 1 - high)) + 1) % 2**128 & high | low


def test_moving_objects_in_buckets(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "state")
    source.mkdir()
    schema = "id long, t long, x double"
    stream = spark.readStream.schema(schema).parquet(str(source))
    spark.createDataFrame([(k, 1, 0.0) for k in range(40)], schema).coalesce(1).write.mode("append").parquet(str(source))
    maintain_buckets(stream, "id", "t", path, 4, str(tmp_path / "ck")).awaitTermination(60)
    before = StoredTable.open(spark, path)
    spark.createDataFrame([(3, 9, 3.0), (3, 5, 2.0), (99, 1, 1.0), (7, 0, 7.0)], schema).coalesce(1).write.mode("append").parquet(str(source))
    maintain_buckets(stream, "id", "t", path, 4, str(tmp_path / "ck")).awaitTermination(60)
    got = read_buckets(spark, path).select("id", "t", "x").collect()
    assert {tuple(r) for r in got} == {(k, 1, 0.0) for k in range(40) if k != 3} | {(3, 9, 3.0), (99, 1, 1.0)}
    files = [{r[0] for r in StoredTable.open(spark, path, v).blocks.select("file").collect()} for v in (before.version, before.version + 1)]
    assert files[0] & files[1] and files[0] - files[1]  # some buckets are as they were
    assert StoredTable.open(spark, path).note == {"batch": 1}
    assert read_buckets(spark, str(tmp_path / "none")) is None


def test_written_tables_can_be_dropped(spark, tmp_path):
    with dropping(spark):
        path = shared_path(spark, "x")
        kept = joins.nearest_join(spark.range(5).select(F.col("id").cast("double").alias("x"), "id"), spark.range(2).select(F.col("id").cast("double").alias("u"), F.col("id").alias("q")), ["x"], ["u"], "q", ["id"], 1)
        kept.write.parquet(str(tmp_path / "kept"))
        spark.range(3).write.parquet(path)
        assert spark.read.parquet(path).count() == 3
    with pytest.raises(AnalysisException):
        spark.read.parquet(path)
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 2


def test_updates_of_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    schema = "t timestamp, k string"
    stream = spark.readStream.schema(schema).parquet(str(source))
    counts = windowed_counts(stream, "t", "1 hour", "10 minutes", "k").select(F.col("window.start").alias("at"), "k", "n")
    for rows in ([("2024-01-01 00:01:00", "a"), ("2024-01-01 00:02:00", "a"), ("2024-01-01 00:12:00", "b")], [("2024-01-01 00:03:00", "a")]):
        spark.createDataFrame(rows, "t string, k string").withColumn("t", F.col("t").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(source))
        keep_updates(counts, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    got = sorted((str(r["at"]), r["k"], r["n"]) for r in read_updates(spark, str(tmp_path / "out"), ["at", "k"]).collect())
    assert got == [("2024-01-01 00:00:00", "a", 3), ("2024-01-01 00:10:00", "b", 1)]
