import hashlib
import random

import numpy as np
import pytest

from wayfold.llm import _shared, suffix_dedup
from wayfold.llm.suffix_dedup import fit, forget, parse, removed


def brute(docs, length=50):
    """Every string of every text in a dictionary of least ids."""
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            if i is not None:
                s = b[p : p + length]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if i is not None and first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        runs = "".join(map(chr, gone)).split("\0")
        out.append((i, len(b), sum(gone), sum(bool(r) for r in runs), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def got(spark, docs, schema="doc_id long, text string", **options):
    df = spark.createDataFrame(docs, schema)
    d = fit(df, **options)
    rows = removed(df, d).collect()
    forget(spark, d)
    assert all(r.n_removed == sum(s.end - s.start for s in r.spans) and r.n_bytes == r.n_removed + len(r.kept) for r in rows)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in rows), key=str)


def corpus(seed, n=60):
    rnd = random.Random(seed)
    syllables = ["th", "en", "ó", "er ", "a", "in ", "ß.", "\n"]
    text = lambda k: "".join(rnd.choices(syllables, k=k))
    shared = [text(rnd.choice([20, 40, 90])) for _ in range(8)]
    docs = []
    for i in range(n):
        docs.append((i * 3 % n, "".join(x for _ in range(rnd.randint(0, 4)) for x in (text(rnd.choice([1, 30, 200])), rnd.choice(shared)))))
    return docs + [(n + 1, docs[4][1]), (n + 2, docs[4][1][7:]), (n + 1, docs[9][1] + docs[4][1])]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_equals_brute_force(spark, seed, hot):
    docs = corpus(seed)
    want = brute(docs)
    assert got(spark, docs, hot=hot) == want
    assert sum(r[2] > 0 for r in want) > 20


def test_other_lengths_and_small_sorts(spark, monkeypatch):
    docs = corpus(5, 30)
    monkeypatch.setattr(suffix_dedup, "SORT", 100)
    assert got(spark, docs, length=20) == brute(docs, 20)
    assert got(spark, docs, length=120) == brute(docs, 120)
    with pytest.raises(ValueError):
        fit(spark.createDataFrame(docs, "doc_id long, text string"), length=5)


def test_edges(spark):
    run = "x" * 49
    docs = [(1, run), (2, run + "y"), (3, "z" + run + "y"), (4, None), (5, ""), (None, run + "y"), (None, run + "y"), (-7, run + "y" + run), (6, "a" * 500), (9, "a" * 300 + "b" * 60), (8, "b" * 60), (8, "b" * 60), (10, run + "q")]
    assert got(spark, docs) == brute(docs)
    assert got(spark, [], "doc_id long, text string") == []
    assert got(spark, [(None, None)], "doc_id long, text string") == [(None, 0, 0, 0, hashlib.sha256(b"").hexdigest())]


def test_clashing_columns_and_a_long_text(spark):
    rnd = random.Random(3)
    long = "".join(rnd.choices("abcdefgh", k=700_000))
    docs = [(1, long, 5, "n", 2), (2, "-" + long[1000:650_000] + "-", 5, "n", 2), (3, long[1000:1060], 5, "n", 2)]
    rows = got(spark, docs, "doc_id long, text string, id int, number string, who int")
    assert [r[:4] for r in rows] == [(1, 700_000, 0, 0), (2, 649_002, 649_000, 1), (3, 60, 60, 1)]


def test_phrases_hold_every_string_once_wherever_it_stands():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 4, 600_000).astype(np.uint8)
    at = np.array([0, 10, 10, 300_000, 300_049, 600_000])
    found = parse(data, at)
    starts = np.repeat(found.start, found.count) + np.arange(found.count.sum()) - np.repeat(np.cumsum(found.count) - found.count, found.count)
    want = np.concatenate([np.arange(a, max(a, z - 49)) for a, z in zip(at[:-1], at[1:], strict=True)])
    assert np.array_equal(starts, want) and found.count.max() <= 26
    again = parse(data[300_049:].copy(), np.array([0, 299_951]))
    some = found.start >= 300_049
    assert np.array_equal(found.start[some] - 300_049, again.start) and np.array_equal(found.trigger[some], again.trigger)


def test_nothing_is_left_but_what_is_read(spark):
    import os

    df = spark.createDataFrame(corpus(8, 20), "doc_id long, text string")
    before = set(os.listdir(f"{_shared._local(_shared.base(spark))}/wayfold")) if os.path.isdir(f"{_shared._local(_shared.base(spark))}/wayfold") else set()
    d = fit(df)
    removed(df, d).count()
    forget(spark, d)
    assert set(os.listdir(f"{_shared._local(_shared.base(spark))}/wayfold")) == before
