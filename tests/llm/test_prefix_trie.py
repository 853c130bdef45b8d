"""The trie against brute force over all prefixes, and the query against SQL."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from cellframe.llm import prefix_trie, registry

SCHEMA = "conv_id long, turn long, role string, text string, depth int, chain string"


def brute(rows, mend=True):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    built = own
    if mend:
        heads = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
        base = {c: c - (c % 20 if c >= 0 else -(-c % 20)) for c in own}
        built = {c: own.get(base[c], [])[: heads[c]] + t[heads[c] :] for c, t in own.items()}
    members = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    out, children, leaves, saved = [], {}, {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = leaves.get(p, 0) or 1
        own_saved = (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = saved.get(p, 0) + own_saved
        if p:
            for found, value in ((children, 1), (leaves, leaves[p]), (saved, saved[p])):
                found[p[:-1]] = found.get(p[:-1], 0) + value
        ends = ",".join(map(str, sorted(c for c in members[p] if built[c] == list(p))))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), children.get(p, 0), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def built_by(spark, rows, mend=True, most=None):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    lines = prefix_trie.turns(table)
    return sorted(map(tuple, prefix_trie.trie(registry.rebuilt(lines) if mend else lines, most).collect()), key=str)


def corpus(seed, convs, deepest, words="a,b c,d"):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "bot"]), rng.choice(words.split(","))) for c in range(-30, convs) for t in range(rng.randint(1, deepest))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("most", [None, 1, 40])
def test_against_brute_force(spark, most):
    rows = corpus(7, 90, 5)
    assert built_by(spark, rows, True, most) == brute(rows)
    assert built_by(spark, rows, False, most) == brute(rows, False)


def test_deep_and_hot(spark):
    rows = [(c, t, "user", "hello there") for c in range(400) for t in range(1 + c % 2)]
    rows += [(1000 + c, t, "user", f"turn {t if t < 180 - c else -t}") for c in range(3) for t in range(200)]
    assert built_by(spark, rows, False, 100_000) == brute(rows, False)
    assert built_by(spark, rows) == brute(rows)


def test_runs_of_ids(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 7)
    rows = [(c * 3, 0, "user", "same") for c in range(150)]
    assert built_by(spark, rows, False) == brute(rows, False)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "no conversation"), (1, None, None, None), (1, 2, "user", ""), (2, None, "", ""), (2, 2, "user", None), (3, 5, "a", "bc"), (4, 5, "ab", "c")]
    rows += [(5, 0, "user", "twice"), (5, 0, "user", "twice"), (20, 0, "user", "long " * 50_000), (21, 0, "x", "y"), (22, 0, "\t", " \x0b\x0c word\xa0word ")]
    assert built_by(spark, rows) == brute(rows) and built_by(spark, rows, False) == brute(rows, False)
    assert built_by(spark, rows[:1]) == [] and built_by(spark, []) == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    wanted = duckdb.sql(registry.ORACLES["op11_prefix_trie"])
    got = registry.op11_prefix_trie(spark, sf)
    assert got.columns == wanted.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(wanted.fetchall(), key=str)
