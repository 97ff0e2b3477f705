import math
import random
import re
from collections import Counter, defaultdict

import pytest

from wayfold.llm.lm_scoring import discounts
from wayfold.llm.quality_rules import END, LEAST, ORDER, START, quality
from wayfold.llm.queries import QUERIES

WORDS = "river stone bridge light under morning quiet field carry winter road before small green".split()


def prose(i, n=80):
    rnd = random.Random(i)
    return " ".join(rnd.choice(WORDS) + ("." if j % 11 == 10 else "") + ("\n" if j % 23 == 22 else "") for j in range(n))


ROWS = [(i, prose(i), "en") for i in range(30)] + [
    (100, " ".join("%s %d" % (WORDS[j % 14], j) for j in range(60)), "en"),
    (101, "".join(chr(0x4E00 + 37 * j % 5000) + " " for j in range(200)), "en"),
    (102, "same line here\nother\n\n \nsame line here\nsame line here \nother", "en"),
    (103, "a b c a b c a b c d " * 30, "fr"),
    (104, None, "en"),
    (105, "", None),
    (106, prose(3), None),
    (None, "É# *é$ %ü& | <ñ>  x\ty\x0bz", "fr"),
    (3, prose(3), "en"),
]


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(w, w[1:], w[2:]))
    inside = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def brute(rows):
    counts = defaultdict(Counter)
    frame = lambda t: chr(START) * (ORDER - 1) + (t or "") + chr(END)
    for _, t, lang in rows:
        s = frame(t)
        counts[lang or ""].update(s[i - ORDER + 1 : i + 1] for i in range(ORDER - 1, len(s)))
    models = {}
    for lang, c in counts.items():
        levels = {ORDER: c}
        for k in range(ORDER - 1, 0, -1):
            levels[k] = Counter(g[1:] for g in levels[k + 1])
        d = {k: [0, *discounts([sum(v == i for v in levels[k].values()) for i in (1, 2, 3, 4)])] for k in levels}
        sums = {k: defaultdict(lambda: [0, 0.0]) for k in levels}
        for k in levels:
            for g, n in levels[k].items():
                x = sums[k][g[:-1]]
                x[0] += n
                x[1] += d[k][min(n, 3)]
        models[lang] = levels, d, sums

    def p(lang, g):
        levels, d, sums = models[lang]
        k = len(g)
        if not k:
            return 1 / (len(levels[1]) + 1)
        if g[:-1] not in sums[k]:
            return p(lang, g[1:])
        n, (total, free) = levels[k][g], sums[k][g[:-1]]
        return max(n - d[k][min(n, 3)], 0) / total + free / total * p(lang, g[1:])

    def log(t, lang):
        s = frame(t)
        return -sum(math.log10(p(lang or "", s[i - ORDER + 1 : i + 1])) for i in range(ORDER - 1, len(s))) / (len(t or "") + 1)

    assert sum(p("en", "ver" + x) for x in [*models["en"][0][1], "香"]) == pytest.approx(1)
    return log


def test_equals_brute_force(spark):
    log = brute(ROWS)
    got = quality(spark.createDataFrame(ROWS, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    for i, t, lang in ROWS:
        r = by[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(t), i
        assert r.log_perplexity == pytest.approx(log(t, lang)), i
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed
        assert r.kept == (not failed and r.lower <= r.log_perplexity <= r.upper)
    assert by[5].kept and not by[101].kept and not by[101].base_failed


def test_empty(spark):
    assert quality(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def op7(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    return {r.doc_id: r for r in QUERIES["op7_quality_rules"](spark, str(folder)).collect()}


def test_copies_do_not_narrow_the_band(spark, tmp_path):
    rows = [(i, prose(i if i < 40 else 0), "de") for i in range(300)]  # 261 copies of one text
    rows += [(1000, prose(50), "fr"), (1001, prose(50), "fr")]
    by = op7(spark, tmp_path, rows)
    assert len(by) == len(rows)
    assert [i for i, r in by.items() if not r.base_failed and not r.kept] == []
    assert not any(r.base_failed for r in by.values())
    assert all(r.upper - r.lower >= 2 * LEAST - 1e-9 for r in by.values())  # also that of fr, with one text
    assert len({r.log_perplexity for i, r in by.items() if i >= 40 and i < 300}) == 1
    once = quality(spark.createDataFrame(rows[:40], "doc_id long, text string, lang string")).collect()
    assert all(by[r.doc_id].log_perplexity == pytest.approx(r.log_perplexity) for r in once)


def test_junk_is_caught_and_not_learned_from(spark, tmp_path):
    clean = [(i, prose(i), "en") for i in range(30)]
    junk = [(100 + i, " | ".join(f"{w}{j}" for j, w in enumerate(prose(60 + i).split())), "en") for i in range(20)] + [(200 + i, " ".join(f"{w}{j}" + "$%&*"[j % 4] * 3 for j, w in enumerate(prose(90 + i).split())), "en") for i in range(20)]
    by = op7(spark, tmp_path, clean + junk)
    assert {i for i, r in by.items() if r.kept} == {r[0] for r in clean}
    assert all(by[i].n_words >= 50 and 2 * by[i].n_repeat_words <= by[i].n_words for i, _, _ in junk)
    alone = quality(spark.createDataFrame(clean, "doc_id long, text string, lang string")).collect()
    assert all(by[r.doc_id].log_perplexity == pytest.approx(r.log_perplexity) for r in alone)


def test_base_rules_are_the_contracts(spark, tmp_path):
    """Symbols are counted and keep a text out of the model, but only perplexity rejects it."""
    rows = [(i, prose(i), "en") for i in range(30)] + [(500, prose(77) + " #" * 9, "en")]
    by = op7(spark, tmp_path, rows)
    assert 10 * by[500].n_symbols > by[500].n_words and not by[500].base_failed
    assert by[500].kept == (by[500].lower <= by[500].log_perplexity <= by[500].upper)


def test_bands_do_not_gather_rows_by_language(spark):
    """Few bands are broadcast; with many, both sides are salted. Both give the same."""
    from wayfold.llm.quality_rules import _with_bands

    measured = spark.range(200).selectExpr("id", "concat('l', id % 3) as lang", "xxhash64(id) as hash")
    bands = spark.createDataFrame([("l0", 1.0), ("l1", 2.0)], "lang string, lower double")
    few, many = (_with_bands(measured, bands, x) for x in (True, False))
    assert sorted(map(tuple, few.select("id", "lower").collect()), key=str) == sorted(map(tuple, many.select("id", "lower").collect()), key=str)
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString() and "Exchange hashpartitioning(lang" not in few._jdf.queryExecution().executedPlan().toString()


def test_clashing_columns_and_a_very_long_text(spark):
    rows = [(i, prose(i), "en") for i in range(20)] + [(900, " ".join(prose(j) for j in range(3000)), "en")]
    df = spark.createDataFrame([(*r, 1, 2, "x", True, 3.0) for r in rows], "doc_id long, text string, lang string, id int, hash int, n_words string, kept boolean, lower double")
    by = {r.doc_id: r for r in quality(df, clean=True).collect()}
    assert len(by) == 21 and by[900].n_words == 240_000 and math.isfinite(by[900].log_perplexity)
    assert (by[3].n_words, by[3].n_dup_lines) == (base(prose(3))[0], base(prose(3))[3])
