"""Trie statistics against a walk over sorted keys, and how many rows they move."""

import random
from collections import Counter, defaultdict

from cellframe.operators import stats
from tests.helpers import shuffle_reads


def walked(keys):
    """(level, prefixes, children, entries, level of the parent) of each node, and how many keys hang on each level."""
    nodes, hanging = [], Counter()

    def walk(group, parent):
        first, level = group[0], 63
        if parent is not None:
            level = max(((x ^ y) & (1 << 64) - 1).bit_length() - 1 for k in group for x, y in zip(k, first, strict=True))
        children = defaultdict(list)
        for k in group:
            children[tuple(x >> level & 1 for x in k)].append(k)
        nodes.append((level, *[(x & (1 << 64) - 1) >> (level + 1) for x in first], len(children), len(group), parent))
        for child in children.values():
            if len(set(child)) > 1:
                walk(child, level)
            elif len(child) == 1:
                hanging[level] += 1

    if keys:
        walk(sorted(keys), None)
    return Counter(nodes), hanging


def test_nodes_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(stats, "CHUNK", 7)
    rng = random.Random(3)
    signed = [(rng.choice([-1, 1]) * rng.randrange(1 << rng.choice([3, 20, 62])), rng.randrange(1 << 12)) for _ in range(150)]
    positive = [(rng.randrange(9), rng.randrange(40)) for _ in range(90)]  # keys repeat
    for keys in (signed, positive, positive[:1], []):
        nodes, hanging = walked(keys)
        frame = spark.createDataFrame([*keys, (None, 1), (5, None)], "x long, y long")
        assert Counter(map(tuple, stats.trie_nodes(frame, ["x", "y"]).collect())) == nodes
        if len(keys) > 1:
            assert {r.level: r.n_entries for r in stats.entry_depths(frame, ["x", "y"]).collect()} == hanging


def test_rows_moved_do_not_grow_with_the_levels(spark):
    rng = random.Random(4)
    frame = spark.createDataFrame([(rng.randrange(1 << 62), rng.randrange(1 << 62)) for _ in range(2000)], "x long, y long").cache()
    for ask in (stats.infix_lengths, stats.tree_stats, stats.entry_depths):
        assert sum(map(sum, shuffle_reads(spark, lambda ask=ask: ask(frame, ["x", "y"]).collect()))) < 10 * 2000
