import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from wayfold.llm import _arrays, _shared
from wayfold.llm.lm_scoring import discounts, fit, score

TEXTS = [
    (1, "The cat sat on the mat. The cat ran."),
    (2, "a cat sat\ton a\nmat"),
    (3, ""),
    (4, None),
    (5, "the cat sat on the mat. the cat ran."),
    (6, "É é ünï the  dog sat on the mat on the mat on the mat"),
    (7, "b c d e f g h i j k l m n o p " * 3),
    (7, "b c d e f g h i j k l m n o p " * 3),
]
OTHER = [(10, "the cat sat on a dog that nobody knows"), (None, "cat"), (11, None), (12, "mat mat mat")]


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def brute(train, order=2):
    grams, words, pairs = Counter(), Counter(), Counter()
    for _, t in train:
        w = tokens(t)
        words.update(w)
        pairs.update(zip([0, *w], w))
        grams.update(zip([0, *w], w, w[1:]))
    own = pairs if order == 2 else Counter({(u, v): c if u == 0 else len({x for x, *y in grams if y == [u, v]}) for (u, v), c in pairs.items()})
    before = Counter(v for _, v in pairs)
    counts = lambda x: [sum(1 for c in x.values() if c == k) for k in (1, 2, 3, 4)]
    d3, d2, d1 = ([0, *discounts(counts(x))] for x in (grams, own, before))
    s, v = sum(before.values()), len(words)
    free = sum(d1[min(c, 3)] for c in before.values()) / s if s else 1.0

    def mixed(counts, context, w, d, low):
        after = {k[-1]: c for k, c in counts.items() if k[:-1] == context}
        if not after:
            return low
        c = after.get(w, 0)
        return (max(c - d[min(c, 3)], 0) + sum(d[min(x, 3)] for x in after.values()) * low) / sum(after.values())

    def p(context, w):
        low = (max(before[w] - d1[min(before[w], 3)], 0) / s if s else 0) + free / (v + 1)
        low = mixed(own, context[-1:], w, d2, low)
        return mixed(grams, context, w, d3, low) if order == 3 and len(context) == 2 else low

    n = sum(words.values())
    return p, lambda w: math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))), words, n


@pytest.mark.parametrize("order", [2, 3])
def test_equals_brute_force(spark, order):
    schema = "doc_id long, text string"
    model = fit(spark.createDataFrame(TEXTS, schema), order=order)
    p, base, words, n = brute(TEXTS, order)
    vocabulary = [*words, "unknown"]
    for context in [(0,), ("the",), (0, "the"), ("on", "the"), ("the", "mat"), ("nobody", "the"), ("the", "nobody")]:
        assert sum(p(context, w) for w in vocabulary) == pytest.approx(1)
    rows = TEXTS + OTHER
    got = score(model, spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for id_, t in rows:
        w = tokens(t)
        r = by[id_][0]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(words[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(map(base, w)))
        history = [0, *w]
        assert r.score == pytest.approx(sum(math.log10(p(tuple(history[max(0, i - 1) : i + 1]), x)) for i, x in enumerate(w)))


def test_order_three_by_hand():
    p, *_ = brute([(1, "a b"), (2, "a b")], 3)
    # both triples, (0 a b) and (a b end), occur twice and none once: D3 = 0
    assert p((0, "a"), "b") == p(("a", "b"), None) == 1
    # pairs: (0 a) 2 as nothing stands before it, (a b) and (b end) after one thing each: D2(2) = 2, all goes to p1;
    # every word has one word before it: D1(1) = 1, all goes to the even share of 3 words and an unknown one
    assert p((0,), "a") == 0.25


def test_random_texts_long_texts_and_clashing_columns(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice("abcdefg") for _ in range(rnd.randint(0, 30)))) for i in range(120)] + [(500, "a b " * 300_000)]
    df = spark.createDataFrame([(*r, 1, 2, "x", 3.0) for r in rows], "doc_id long, text string, id int, counts int, words string, total double")
    p, _, words, n = brute(rows[:120], 3)
    got = {r.doc_id: r for r in score(fit(df.where("doc_id < 500").repartition(5)), df).collect()}
    for i, t in rows[:120:7]:
        w = [0, *tokens(t)]
        assert got[i].score == pytest.approx(sum(math.log10(p(tuple(w[max(0, k - 2) : k]), w[k])) for k in range(1, len(w))))
    assert got[500].n_tokens == 600_001 and math.isfinite(got[500].score)
    both = [{r.doc_id: r.score for r in score(fit(df.repartition(k)), df).collect()} for k in (1, 6)]
    assert all(both[0][i] == pytest.approx(both[1][i]) for i in both[0])
    with pytest.raises(ValueError):
        fit(df, order=4)


def test_small_numbers_take_a_byte(tmp_path):
    x = np.array([0, 3, 254, 255, 256, 70_000, 1 << 40, 7], np.int64)
    for y in (x, x[:3], x[:0]):
        _arrays.save_small(f"file://{tmp_path}/{len(y)}", 4, counts=y)
        got = _arrays.small(f"file://{tmp_path}/{len(y)}", "counts", 4, len(y))
        assert np.array_equal(got.whole(), y) and np.array_equal(got[np.arange(len(y))[::-1]], y[::-1])
        assert os.path.getsize(f"{tmp_path}/{len(y)}/counts-4.u1") == len(y)


def test_columns_of_pairs_take_a_byte_although_some_counts_are_large(spark):
    """Six columns of a byte beside the key (seven of up to four bytes before), with the same scores where a context has more than 255 followers."""
    rows = [(i, f"the w{i % 280}") for i in range(290)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = fit(df)
    at, n = _shared.fetched(f"{model.path}/pairs"), sum(size for _, size in model.pairs)
    assert n == 561
    assert sum(os.path.getsize(f"{at}/{name}") for name in os.listdir(at) if not name.startswith("keys-")) < 6.9 * n
    p, *_ = brute(rows, 3)
    for r in score(model, df.where("doc_id in (5, 200, 285)")).collect():
        w = [0, *tokens(rows[r.doc_id][1])]
        assert r.score == pytest.approx(sum(math.log10(p(tuple(w[max(0, k - 2) : k]), w[k])) for k in range(1, len(w))))


def test_nothing_to_learn_from(spark):
    model = fit(spark.createDataFrame([], "doc_id long, text string"))
    got = score(model, spark.createDataFrame(OTHER, "doc_id long, text string")).collect()
    assert all(r.score == 0 and r.n_known == 0 for r in got) and len(got) == len(OTHER)
    assert score(model, spark.createDataFrame([], "doc_id long, text string")).count() == 0
