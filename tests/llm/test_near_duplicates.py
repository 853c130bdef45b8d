import random
import re
from itertools import combinations

from cellframe.llm import decontaminate, graph, jaccard
from cellframe.llm.graph import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    n = min(n, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b in range(a):
            j = rows[b][0]
            if i is None or j is None or not sets[a] or not sets[b]:
                continue
            common = len(sets[a] & sets[b])
            if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted([(i, len(s), None if i is None else root(i)) for (i, _), s in zip(rows, sets, strict=True)], key=repr)


def corpus(seed, sizes):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=40))
    rows = []
    for size in sizes:
        words = rng.choices(vocabulary, k=size)
        if rng.random() < 0.4:
            words[size // 2 : size // 2] = passage.split()
        for _ in range(rng.randrange(1, 7)):
            own = list(words)
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(own))
                own[at : at + rng.randrange(2)] = rng.choices(vocabulary, k=rng.randrange(3))
            rows.append((len(rows) * 7 % 5003, " ".join(own)))
    return rows


def test_near_duplicates(spark):
    rows = corpus(1, [6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 17, 20, 24, 30, 40, 60, 90, 150, 300] * 3)
    rows += [(6000, None), (6001, ""), (6002, " \n\t "), (6003, "one"), (6004, "ONE"), (6005, "one two"), (6006, "one  two"), (6007, "one two three four"), (None, rows[0][1]), (None, rows[0][1]), (6010, rows[5][1].upper()), (6011, "x" * 200_000)]
    rows += [(7000 + k, rows[9][1]) for k in range(50)] + [rows[3], rows[3], (7100, rows[2][1]), (7100, rows[40][1])]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, rep long").repartition(6)
    got = sorted(map(tuple, jaccard.near_duplicates(frame).collect()), key=repr)
    assert got == brute(rows)
    assert len({r[2] for r in got}) < len(rows) - 60
    assert jaccard.near_duplicates(frame.limit(0)).collect() == []


def test_large_group_of_edited_copies(spark):
    rng = random.Random(3)
    words = [f"v{k}" for k in range(120)]
    rows = []
    for k in range(150):
        own = list(words)
        for _ in range(rng.randrange(1, 4)):
            own[rng.randrange(120)] = f"new{rng.randrange(40)}"
        rows.append((k, " ".join(own)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, jaccard.near_duplicates(frame).collect()), key=repr) == brute(rows)


def test_texts_of_one_template_do_not_link(spark):
    """Most of each text is a template, but no two reach the threshold; entries of such lists are dropped before pairs."""
    template = [f"t{k}" for k in range(85)]
    rows = [(k, " ".join(template + [f"own{k}x{j}" for j in range(16)])) for k in range(120)]
    rows += [(500, rows[7][1] + " more"), (501, " ".join(template))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, jaccard.near_duplicates(frame).collect()), key=repr) == brute(rows)


def test_sizes():
    for n in range(1, 60):
        for m in range(1, 60):
            common = jaccard.needed(n, m)
            if common <= min(n, m):
                assert 100 * common >= 80 * (n + m - common) and 100 * (common - 1) < 80 * (n + m - common + 1)
                assert m in jaccard.partners(n)
            else:
                assert m not in jaccard.partners(n)


def test_boundary_is_the_cheapest():
    def cost(counts, listed, most):
        total = 0
        for n, many in counts.items():
            if n <= most:
                for m in range(1, most + 1):
                    common = jaccard.needed(n, m)
                    if common <= min(n, m):
                        total += many * len(list(combinations(range(n), common)))
            if any(jaccard.needed(n, m) <= min(n, m) for m in range(most + 1, 2 * n + 1)):
                total += many * sum(1 + n * listed for _ in range(n - -(-4 * n // 5) + 1))
        return total

    rng = random.Random(8)
    for counts, listed in [({7: 10**7}, 1.0), ({n: 100 for n in range(1, 16)}, 2.0), ({5: 3, 12: 900}, 40.0), ({rng.randrange(1, 14): rng.randrange(1000) for _ in range(6)}, 0.0)]:
        costs = [cost(counts, listed, most) for most in range(jaccard.MOST_LIGHT + 1)]
        assert costs[jaccard.boundary(counts, listed)] == min(costs)
    assert jaccard.boundary({7: 10**7}) <= 8


def test_long_lists_in_blocks_and_subsets_in_slices(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    monkeypatch.setattr(jaccard, "SUBSETS", 11)
    rng = random.Random(9)
    rows = []
    for group in range(6):
        words = [f"g{group % 2}x{k}" for k in range(60)]
        for _ in range(25):
            own = list(words)
            for _ in range(rng.randrange(0, 9)):
                own[rng.randrange(60)] = f"new{rng.randrange(4)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(1000 + k, " ".join(f"s{(k // 4) * 3 + j}" for j in range(9 + k % 3))) for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, jaccard.near_duplicates(frame).collect()), key=repr) == brute(rows)


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)] + [(5, 5)]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = components(spark.createDataFrame(pairs, "a long, b long"))
    assert {r.node: r.comp for r in got.collect()} == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_decontamination(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 4, 5, 6, 9, 20, 50, 200])))) for k in range(60)]
    items += [(60, None), (61, ""), (None, items[0][1]), (62, items[8][1])]
    docs = []
    for k in range(120):
        words = rng.choices(vocabulary, k=rng.choice([3, 30, 400, 4000]))
        own = items[rng.randrange(60)][1].split()
        for _ in range(rng.randrange(0, 3)):
            own[rng.randrange(len(own))] = "changed"
        at = rng.randrange(len(words))
        words[at:at] = own
        docs.append((k, " ".join(words).upper() if k % 5 == 0 else "\n".join(words)))
    docs += [(500, None), (501, ""), (None, items[3][1]), (502, items[3][1]), (502, items[3][1])]
    want = []
    for i, text in docs:
        for j, item in items:
            own = shingle_set(item)
            n = len(next(iter(own))) if own else 0
            held = shingle_set(text, n) if own else set()
            if j is not None and own and all(len(x) == n for x in list(held)[:1]) and 5 * len(own & held) >= 4 * len(own):
                want.append((i, j, len(own), len(own & held)))
    frame = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, item_id string")
    table = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, doc_id string")
    assert sorted(map(tuple, decontaminate.contained(frame, table).collect()), key=repr) == sorted(want, key=repr)
    clean = decontaminate.clean(frame, table)
    dirty = {repr(docs[k]) for k in range(len(docs)) if any(w[0] == docs[k][0] for w in want)}
    assert clean.schema == frame.schema and sorted(repr((r.doc_id, r.text)) for r in clean.collect()) == sorted(repr(d) for d in docs if repr(d) not in dirty)
    for empty in (frame.limit(0), frame):
        assert decontaminate.contained(empty, table.limit(0)).collect() == []
    assert decontaminate.contained(frame.limit(0), table).collect() == []


def test_more_items_than_are_broadcast(spark, monkeypatch):
    """The join gives what the index gives, with clashing columns and repeated rows."""
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(200)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 5, 6, 9, 40])))) for k in range(30)] + [(30, None), (None, "w1 w2")]
    docs = [(k, " ".join(rng.choices(vocabulary, k=60)) + " " + items[k % 30][1], k) for k in range(60)] + [(None, items[3][1], 0), (7, items[5][1], 0), (7, items[5][1], 0), (8, None, 0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, row int")
    table = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, decontaminate.contained(frame, table).collect()), key=repr)
    clean = sorted(map(tuple, decontaminate.clean(frame, table).collect()), key=repr)
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 10)
    assert sorted(map(tuple, decontaminate.contained(frame, table).collect()), key=repr) == want and len(want) > 60
    kept = decontaminate.clean(frame, table)
    assert kept.columns == frame.columns and sorted(map(tuple, kept.collect()), key=repr) == clean


def test_sketches_miss_nothing():
    for size in (1, 4, 5, 31, 63, 127, 1023):
        assert decontaminate.sketch_size(size.bit_length(), 0.8) > 0.2 * size - 1e-9


def test_components_with_hot_nodes_and_labels(spark, monkeypatch):
    """One node with very many neighbours, and chains: salted joins give the same components."""
    rng = random.Random(3)
    pairs = [(0, k) for k in range(1, 400)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5000, 5000)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    found = []
    for many in (10**9, 0):
        monkeypatch.setattr(graph, "MANY", many)
        found.append(sorted(map(tuple, graph.components(edges).collect())))
    assert found[0] == found[1] and {c for n, c in found[0] if n < 400} == {0} and {c for n, c in found[0] if 1000 <= n <= 1040} == {1000}


def test_small_components_are_few_files(spark, monkeypatch):
    """Rounds over a small graph are not written by all shuffle partitions: the files of a round follow the number of edges."""
    files, plain = [], graph.written

    def seen(*args):
        out = plain(*args)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(graph, "written", seen)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = graph.components(spark.createDataFrame([(k // 10 * 10, k) for k in range(600)], "a long, b long")).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert {r.node: r.comp for r in got} == {k: k // 10 * 10 for k in range(600)}
    assert len(files) >= 3 and max(files) <= spark.sparkContext.defaultParallelism
