import hashlib
import random
import re

from wayfold.llm.decontamination import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = cut(t)
        if i is None or t is None:
            continue
        for a in range(max(1, len(w) - 12)):
            if w:
                windows.setdefault(tuple(w[a : a + 13]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    found |= windows[tuple(w[a : a + n])]
                    hit |= set(range(a, a + n))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_equals_brute_force(spark):
    rnd = random.Random(5)
    words = ["v%d" % i for i in range(60)]
    items = [(i, " ".join(rnd.choices(words, k=rnd.choice([1, 2, 12, 13, 14, 30])))) for i in range(9, 40)]
    items += [(50, ""), (51, None), (None, "v1 v2"), (52, items[0][1]), (52, items[3][1]), (53, "É é, É-é"), (54, " ".join(["v9"] * 40))]
    docs = []
    for i in range(60):
        w = rnd.choices(words[20:], k=rnd.choice([0, 3, 30, 300]))
        for _ in range(rnd.randint(0, 3)):
            part = cut(rnd.choice(items)[1])
            a = rnd.randint(0, len(part))
            w += [x.upper() for x in part[a : a + rnd.choice([5, 13, 40])]] + rnd.choices(words, k=2)
        docs.append((i, ", ".join(w)))
    docs += [(None, items[5][1]), (70, None), (71, ""), (72, "é É é é x"), (73, "v9 " * 5000), (73, "v9 " * 5000)]
    got = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(brute(docs, items), key=str)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_hit for r in got)
    assert sum(r.n_hit > 0 for r in got) > 20


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in decontaminate(docs, items).collect()] == [(1, 2, 0, 0)]
    assert decontaminate(docs.limit(0), items).count() == 0


def test_clashing_columns_and_a_very_long_text(spark):
    item = " ".join("b%d" % i for i in range(20))
    docs = spark.createDataFrame([(1, item, 1, "x", "y"), (2, "a " * 400_000 + item, 1, "x", "y")], "doc_id long, text string, id int, item_id string, spans string")
    items = spark.createDataFrame([(7, item, 5, "k")], "item_id long, text string, doc_id int, mark string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate(docs, items).collect()}
    assert got == {1: (20, 20, 1, True), 2: (400_020, 20, 1, False)}
