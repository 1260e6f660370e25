from __future__ import annotations

import random

from cairn.llm import near_duplicates as N

VOCAB = [f"w{i}" for i in range(400)]


def brute(rows):
    import itertools

    words = [(i, t, N.word_counts(t)) for i, t in rows if i is not None and t is not None]
    words = [(i, t, c) for i, t, c in words if c.total() >= 20]
    out = set()
    for (i, t, a), (j, u, b) in itertools.combinations(words, 2):
        common = (a & b).total()
        if t != u and i != j and common * 5 >= 4 * (a.total() + b.total() - common):
            out.add((min(i, j), max(i, j)))
    return out


def pairs(spark, rows):
    df = spark.createDataFrame(rows, "id long, t string")
    return set(map(tuple, N.pairs(df, "id", "t").collect()))


def edited(rng, words):
    w = list(words)
    for _ in range(rng.randint(0, max(1, len(w) // 6))):
        k = rng.randrange(len(w))
        act = rng.random()
        if act < 0.4:
            w[k] = rng.choice(VOCAB)
        elif act < 0.7:
            w.insert(k, rng.choice(VOCAB))
        else:
            w.pop(k)
    if rng.random() < 0.3:
        rng.shuffle(w)
    return w


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows, n = [], 0
    for _ in range(40):
        base = [rng.choice(VOCAB) for _ in range(rng.randint(15, 60))]
        for _ in range(rng.randint(1, 6)):
            n += 1
            rows.append((n, rng.choice([" ", "\n", ", "]).join(edited(rng, base))))
    want = brute(rows)
    assert len(want) > 50 and pairs(spark, rows) == want


def test_blocks_of_hot_words(spark, monkeypatch):
    """Words of many texts are split over pairs of blocks; the pairs stay the same."""
    rng = random.Random(4)
    base = [rng.choice(VOCAB[:30]) for _ in range(40)]
    rows = [(k, " ".join(edited(rng, base))) for k in range(120)]
    monkeypatch.setattr(N, "BLOCK", 16)
    assert pairs(spark, rows) == brute(rows)


def test_copies_and_dirt(spark):
    t = " ".join(VOCAB[:30])
    rows = [(1, t), (2, t), (3, t + "  \n"), (4, None), (5, ""), (6, "too few words"), (None, t), (7, t.upper()), (8, " ".join(reversed(VOCAB[:30])))] + [(100 + k, t) for k in range(50)]
    got = pairs(spark, rows)
    assert got == brute(rows) and (1, 2) not in got and (1, 3) in got and (1, 8) in got and (1, 7) not in got
    assert pairs(spark, []) == set()
    assert pairs(spark, [(1, "é_ü 中文 " * 12), (2, "é_ü 中文 " * 12 + ".")]) == {(1, 2)}


def test_long_text(spark):
    t = " ".join(f"x{k}" for k in range(60_000))
    assert pairs(spark, [(1, t), (2, t + " end"), (3, "y " + t)]) == {(1, 2), (1, 3), (2, 3)}


def test_boundary(spark):
    a = [f"a{k}" for k in range(40)]
    rows = [(1, " ".join(a)), (2, " ".join(a[:36] + [f"b{k}" for k in range(5)])), (3, " ".join(a[:32])), (4, " ".join(a[:31]))]
    assert pairs(spark, rows) == brute(rows) and (1, 3) in brute(rows) and (1, 4) not in brute(rows)


def test_groups(spark):
    a = " ".join(VOCAB[:40])
    df = spark.createDataFrame([(1, a, 0), (2, a, 0), (3, a + " extra", 0), (4, " ".join(VOCAB[100:140]), 0)], "id long, t string, sig int")
    got = {r.id: (r.class_id, r.links, r.copies) for r in N.groups(df, "id", "t").collect()}
    assert got == {1: (1, 1, 2), 2: (1, 1, 2), 3: (3, 1, 1), 4: (4, 0, 1)}


def test_rows_of_one_id_keep_their_links(spark):
    a, z = VOCAB[:40], VOCAB[100:140]
    rows = [(1, " ".join(a)), (1, " ".join(z)), (2, " ".join([*a[:39], "other"]))]
    assert pairs(spark, rows) == {(1, 2)}
    assert pairs(spark, [*rows, *rows, (3, " ".join([*z[:39], "more"]))]) == {(1, 2), (1, 3)}


def test_words_of_equal_short_hashes(spark):
    """Short hashes of tokens collide all the time here; no pair may be lost by it."""
    rng = random.Random(8)
    base = [[rng.choice(VOCAB) for _ in range(rng.randint(20, 45))] for _ in range(25)]
    rows = [(k * 10 + j, " ".join(edited(rng, b))) for k, b in enumerate(base) for j in range(4)]
    a = [f"w{k}" for k in range(26020, 26050)] + ["w26041", "w95849"]
    rows += [(5001, " ".join(a)), (5002, " ".join([*a[:-2], "w95849", "w26041", "x"]))]
    assert pairs(spark, rows) == brute(rows)
    trie = N._Trie(0.8)
    codes = (1, 1, 1, 2)
    trie.add(codes, 7, 20, False, 16, 0, 64)
    assert trie.partners((1, 2), 20, 16, 16, 0, 64) == [(7, False)]


def test_parities_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(300):
        n, m = int(rng.integers(20, 900)), int(rng.integers(20, 900))
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[: min(n, m) // 2], rng.integers(0, 1 << 63, m - min(n, m) // 2).astype(np.uint64)])
        differ = len(set(a.tolist()) ^ set(b.tolist()))
        x, y = N._parities(a, n), N._parities(b, m)
        assert N.least_difference(int.from_bytes(x, "little"), 8 * len(x), int.from_bytes(y, "little"), 8 * len(y)) <= differ


def routed_bytes(texts):
    import numpy as np
    import pyarrow as pa
    from types import SimpleNamespace

    heat = SimpleNamespace(value=np.full(N.BUCKETS, 9, np.uint8))  # every word is in two texts
    out = N._routes(heat, 20, 0.8)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])]))
    return sum(c.nbytes for b in out for c in b.columns)


def test_routes_grow_as_the_text_does():
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9)))
    for n in (60, 300, 3_000, 10_000):
        text = " ".join(word() for _ in range(n))
        assert routed_bytes([text]) < 5 * len(text), n


def test_copies_cost_one_route():
    text = " ".join(VOCAB[:40])
    assert routed_bytes([text] * 5000) == routed_bytes([text])
    batches = list(N._scan(20)(iter([__import__("pyarrow").RecordBatch.from_pydict({"i": list(range(5000)), "t": [text] * 5000})])))
    counters = [c for b in batches for i, c in zip(b.column(0).to_pylist(), b.column(3).to_pylist()) if i is None]
    assert len(counters) >= 39 and max(counters) <= 2


def test_components_against_brute_force(spark):
    rng = random.Random(10)
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [tuple(rng.sample(range(200, 320), 2)) for _ in range(70)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in N.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in root}
    assert N.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_links_and_groups_hold_every_pair(spark):
    rng = random.Random(12)
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(VOCAB) for _ in range(30)]
        for _ in range(rng.randint(1, 5)):
            text = " ".join(edited(rng, base))
            for _ in range(rng.randint(1, 3)):
                n += 1
                rows.append((n, text))
    df = spark.createDataFrame(rows, "id long, t string")
    of = {r.id: r for r in N.groups(df, "id", "t").collect()}
    tied = {(r.class_a, r.class_b) for r in N.class_links(df, "id", "t").collect()}
    want = {tuple(sorted((of[a].class_id, of[b].class_id))) for a, b in brute(rows)}
    assert tied == {w for w in want if w[0] != w[1]} and len(tied) > 5
    assert all(of[a].group_id == of[b].group_id for a, b in tied)
    assert all(r.links == sum(r.class_id in t for t in tied) and r.copies == sum(x.class_id == r.class_id for x in of.values()) for r in of.values())
