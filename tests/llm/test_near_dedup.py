import random
import re

import numpy as np

from wayfold.llm.near_dedup import near_duplicates


def brute(rows, part, whole):
    sets = {}
    for id_, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        if id_ is not None:
            sets[id_] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and whole * len(sets[a] & sets[b]) >= part * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=3):
    rnd = random.Random(seed)
    words = ["w%d" % i for i in range(3000)]
    foot = " ".join(rnd.choices(words, k=40))
    rows = []
    for _ in range(40):
        base = rnd.choices(words, k=rnd.choice([3, 20, 120, 400]))
        for _ in range(rnd.choice([1, 2, 6, 25])):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 60))):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            rows.append(" ".join(w) + (" " + foot if rnd.random() < 0.3 else ""))
    rows += ["", None, "one", "one", "ONE", " \t one ", "a b c d", "a  B c D", "x" * 50000]
    rnd.shuffle(rows)
    return [(i * 7 + 1, t) for i, t in enumerate(rows)]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr("wayfold.llm.near_dedup.BLOCK", 4)  # lists of many blocks
    monkeypatch.setattr("wayfold.llm.near_dedup.MEMBERS", 5)
    rows = corpus()
    for part in (85, 80):
        want = brute(rows, part, 100)
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), part, 100).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len({c for _, c in want.values()}) < len(want) - 100


def test_nulls_repeats_and_nothing(spark):
    rows = [(None, "a b c d e f", 1), (5, "a b c d e f", 2), (5, "a b c d e f", 3), (4, "A b c d e f", 4), (3, None, 5), (4, "p q r s t u", 6), (9, "p q r s t u", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id int").withColumnRenamed("id", "n")
    got = sorted(near_duplicates(df).collect(), key=str)
    want = [(3, 0, 3, True), (4, 2, 4, True), (4, 2, 4, True), (5, 2, 4, False), (5, 2, 4, False), (9, 2, 4, False), (None, 2, None, True)]
    assert [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got] == sorted(want, key=str)
    assert near_duplicates(df.limit(0)).count() == 0


def test_a_group_far_from_its_head_is_open(spark):
    """Copies of copies: the list's head reaches only some, the rest are found in blocks."""
    rnd = random.Random(8)
    words = ["v%d" % i for i in range(5000)]
    now, rows = rnd.choices(words, k=300), []
    for i in range(40):
        rows.append((i, " ".join(now)))
        for _ in range(4):
            now[rnd.randrange(len(now))] = rnd.choice(words)
    want = brute(rows, 80, 100)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_chained_classes_ship_no_sets(spark, monkeypatch):
    """Each text shares one passage with the next: all would be one cluster, but no pair is near."""
    import wayfold.llm.near_dedup as near

    shipped = []
    kept = near._shipped
    monkeypatch.setattr(near, "_shipped", lambda docs, classes, nodes, b, n: (shipped.append(nodes.count()), kept(docs, classes, nodes, b, n))[1])
    rnd = random.Random(4)
    part = lambda: ["u%d" % rnd.randrange(10**6) for _ in range(60)]
    links = [part() for _ in range(301)]
    rows = [(i, " ".join(links[i] + part() + part() + links[i + 1])) for i in range(300)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80, 100).collect()
    assert all(r.kept for r in got) and sum(shipped) == 0


def test_estimate_uses_the_unions_least_values():
    from wayfold.llm.near_dedup import padded, passes

    a = np.arange(64, dtype=np.uint64)
    half = np.concatenate([np.arange(0, 64, 2, dtype=np.uint64), np.arange(1000, 1032, dtype=np.uint64)])
    x = padded([s.tobytes() for s in (a, a, a[:10])], 64)
    y = padded([s.tobytes() for s in (a, half, a[:5])], 64)
    # of the 64 least of each union: 64 shared, 32, and 5 of 10
    for part, want in ((100, [True, False, False]), (50, [True, True, True]), (51, [True, False, False])):
        assert passes(x, y, part, 100, 0.0).tolist() == want


def test_forest_needs_whole_sets():
    from wayfold.llm.near_dedup import forest

    a = np.arange(100, dtype=np.uint64)
    got = forest([a, np.append(a[:92], np.arange(900, 908, dtype=np.uint64)), a + np.uint64(500)], ~np.eye(3, dtype=bool), 85, 100)
    assert got.tolist() == [0, 0, 2]


def test_nothing_is_left_but_the_result(spark, monkeypatch):
    """Also where lists stay open and classes are chained."""
    import os

    from wayfold.llm import _shared

    docs = [(i, " ".join(f"w{j}" for j in range(i * 3, i * 3 + 60))) for i in range(12)] + [(50 + i, "a b c d e f " + " ".join(f"q{i}x{j}" for j in range(3))) for i in range(9)]
    at = f"{_shared._local(_shared.base(spark))}/wayfold"
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    for slack in (0.1, 1.0):
        out = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 80, 100, 5, slack=slack)
        assert {x.rsplit("-", 1)[0] for x in set(os.listdir(at)) - before} == {"near-duplicates"}
        _shared.drop(out)
