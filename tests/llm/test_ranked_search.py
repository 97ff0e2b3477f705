import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from wayfold.llm import ranked_search
from wayfold.llm.ranked_search import build, cut, forget, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    each = [(i, split(t)) for i, t in docs]
    each = [(i, Counter(t), len(t)) for i, t in each if t]
    n, total = len(each), sum(x[2] for x in each)
    df = Counter(t for _, c, _ in each for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(split(t))
    out = []
    for i, terms in asked.items():
        scores = []
        for d, c, size in each:
            m = 10 + 90 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s:
                scores.append((-s, d is None, d))
        out += [(i, r, x[2], -x[0]) for r, x in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def got(spark, docs, items, k=10, schema="doc_id long, text string", kinds="item_id long, text string", **options):
    index = build(spark.createDataFrame(docs, schema).repartition(3), **options)
    rows = [tuple(r) for r in search(index, spark.createDataFrame(items, kinds), k).collect()]
    forget(index)
    return sorted(rows, key=str)


def corpus(seed, n):
    rnd = random.Random(seed)
    words = ["w%d" % i for i in range(400)] + ["É", "ñ3"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, ". ".join(rnd.choices(words, weights, k=rnd.choice([0, 1, 5, 40, 300])))) for i in range(n)]
    rnd.shuffle(docs)
    items = [(i, " ".join(rnd.choices(words, weights if i % 2 else None, k=rnd.choice([1, 3, 30])))) for i in range(25)]
    items += [(90 + i, docs[i][1].upper()) for i in range(5)]
    return docs, items


@pytest.mark.parametrize("shard", [2000, ranked_search.SHARD])
def test_equals_brute_force(spark, shard, monkeypatch):
    docs, items = corpus(1, 700)
    docs += [(d + 10_000, t) for d, t in docs[:60]]  # ties
    for k in (1, 10):
        assert got(spark, docs, items, k, shard=shard) == brute(docs, items, k)


def test_most_intervals_are_skipped():
    """One shard, where few documents hold the query's rare terms."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    n = 5000
    texts = [" ".join(["common"] * int(rng.integers(1, 4)) + ["often"] * int(rng.random() < 0.5) + (["rare", "odd"] if i % 500 == 7 else []) + ["x"] * int(rng.integers(0, 90))) for i in range(n)]
    words, count = ranked_search.terms(*ranked_search.flat(pa.array(texts)))
    row = np.repeat(np.arange(n), count)
    key, tf = np.unique(row * len(words.dictionary) + words.indices.to_numpy(), return_counts=True)
    rows = list(ranked_search._shard(1, [(words.dictionary, key // len(words.dictionary), key % len(words.dictionary), tf, count, pa.array(np.arange(n)))], n, int(count.sum())))
    shard = ranked_search.Shard(pa.Table.from_batches([rows[0], *rows[1:]]), n, int(count.sum()))
    scored = []
    real = ranked_search.impacts
    ranked_search.impacts = lambda tf, *a: (scored.append(len(tf)), real(tf, *a))[1]
    try:
        docs, _ = shard.best([(b"common", 3), (b"often", 700), (b"rare", 6000), (b"odd", 6000)], 5)
    finally:
        ranked_search.impacts = real
    assert set(docs % 500) == {7} and sum(scored) < len(shard.docs) / 8


def test_blocks_are_the_best_there_are():
    rng = np.random.default_rng(3)
    sizes = [1, 2, 3, 7, 8, 9, 30, 100, 1, 64]
    impact = rng.choice([5, 50, 70, 900, 1000], sum(sizes)).astype(np.int64)
    first = np.append(0, np.cumsum(sizes))
    for cost, longest in ((100, 64), (1500, 8), (0, 64), (10**9, 16)):
        ends = cut(impact, first, cost, longest)
        for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            u = impact[a:z].tolist()
            least = [0]
            for i in range(1, len(u) + 1):
                least.append(min(least[j] + (i - j) * max(u[j:i]) + cost for j in range(max(0, i - longest), i)))
            stop = np.flatnonzero(ends[a:z]) + 1
            assert stop[-1] == z - a and np.diff(np.append(0, stop)).max() <= longest
            assert sum((b - c) * max(u[c:b]) + cost for c, b in zip([0, *stop[:-1]], stop, strict=True)) == least[-1]


def test_edges(spark):
    docs = [(3, "a b"), (1, "a b"), (1, "a b"), (None, "a b"), (None, None), (4, None), (5, ""), (6, "..."), (7, "A-B, c"), (-2, "c" * 70_000), (8, "ab cd")]
    items = [(1, "a"), (1, "B b"), (2, None), (3, ""), (4, "zzz"), (None, "a"), (5, "c" * 70_000 + " c"), (6, "Ab")]
    assert got(spark, docs, items) == brute(docs, items)
    assert got(spark, docs, []) == [] and got(spark, [], items) == []
    assert got(spark, [(1, None)], items) == []


def test_clashing_columns_other_item_ids_and_a_long_text(spark):
    rnd = random.Random(8)
    docs = [(1, " ".join("t%d" % rnd.randrange(5000) for _ in range(200_000)), 3, "x"), (2, "t1 t2", 3, "x")]
    items = [("a", "t1 t2 t3", 1, 2), ("b", "t4999", 1, 2)]
    rows = got(spark, docs, items, schema="doc_id long, text string, shard int, term string", kinds="item_id string, text string, score int, doc_id int")
    assert rows == brute([d[:2] for d in docs], [i[:2] for i in items])
