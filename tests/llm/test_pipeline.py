"""The pipeline against brute-force versions of its stages, on a small corpus."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from tests.llm.test_decontamination import brute as contaminated  # noqa: E402
from tests.llm.test_near_dedup import brute as duplicates  # noqa: E402
from tests.llm.test_quality_rules import base  # noqa: E402

WORDS = [a + b + c for a in ("ba", "te", "lo", "mi") for b in ("ra", "n", "do", "st") for c in ("el", "in", "ous", "a", "er")]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rnd = random.Random(12)
    at = tmp_path_factory.mktemp("tables")
    text = lambda n: rnd.choices(WORDS, k=n)
    items = [(i, " ".join(text(20))) for i in range(5)]
    rows, labels = [], []
    for i in range(260):
        w = text(rnd.choice([30, 90, 90, 150]))
        toxic = i % 6 == 0
        if toxic:
            w[::9] = [rnd.choice(["slurone", "slurtwo"]) for _ in w[::9]]
        if i % 10 == 3:
            w[5:5] = items[i % 5][1].upper().split()
        if i % 13 == 4 and i > 20:
            w = rows[i - 13][1].split() + text(3)
        if i % 40 == 7:
            w = w[:9] * 12
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(any(x.startswith("slur") for x in w))))
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0), (902, rows[1][1], "en", "s", 0)]
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    pq.write_table(pa.table({k: [r[j] for r in rows] for j, k in enumerate(names)}), at / "documents.parquet")
    pq.write_table(pa.table({k: [r[j] for r in labels] for j, k in enumerate(["doc_id", "quality", "toxic"])}), at / "labels.parquet")
    pq.write_table(pa.table({k: [r[j] for r in items] for j, k in enumerate(["item_id", "text"])}), at / "benchmark.parquet")
    return str(at), rows, items


def test_each_stage(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {r[0]: r[1] for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline._shared.written(stage(spark, docs, path), "test-stage")
        assert out.columns == docs.columns
        kept = {r.doc_id: r.text for r in out.collect()}
        assert all(kept[i] == seen[i] for i in kept)
        if name == "quality rules":
            fails = {i for i, t in seen.items() if (b := base(t))[0] < 50 or 100 * b[4] > 50 * b[0]}
            assert fails & set(kept) == set() and len(kept) >= 0.6 * (len(seen) - len(fails))
        elif name == "toxicity":
            toxic = {i for i, t in seen.items() if "slur" in t}
            assert len(toxic & set(kept)) <= 1 and set(seen) - toxic <= set(kept)
        elif name == "near dedup":
            want = duplicates(list(seen.items()), 80, 100)
            assert set(kept) == {i for i, (_, c) in want.items() if i == c} and len(kept) < len(seen)
        else:
            bad = {r[0] for r in contaminated(list(seen.items()), items) if r[5]}
            assert set(kept) == set(seen) - bad and bad
        docs, seen = out, kept
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert {r.doc_id for r in pieces} == set(seen)
    assert all(len(np.frombuffer(r.ids, "<u4")) == r.length for r in pieces)
    whole = corpus_pipeline.run(spark, path).collect()
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.start, r.ids_crc32) for r in pieces)


@pytest.mark.parametrize("rows", [[], [(5_000, 1, 1)]])
def test_toxicity_keeps_all_without_labels(spark, folder, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    assert corpus_pipeline.toxicity(spark, docs, str(tmp_path)).count() == docs.count()


def test_rows_are_judged_not_ids(spark, folder, tmp_path):
    """Repeated and null ids, columns of clashing names, and a stage that rejects all."""
    path, rows, items = folder
    good = rows[1][1]
    poor = "a b c " * 30
    extra = [(None, good, "en", "s", 0), (None, poor, "en", "s", 0), (50, good, "en", "t", 0), (50, poor, "en", "s", 0), (51, items[0][1] + " " + good, "en", "s", 0), (None, items[0][1], "en", "s", 0)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([*rows[:40], *extra], names).selectExpr("*", "1 as n_words", "'x' as kept", "2.0 as score", "3 as hash", "'y' as `a.b`", "map('k', 1) as m", "4 as key")
    by = {name: f for name, f in corpus_pipeline.STAGES}
    out = by["quality rules"](spark, docs, path)
    assert out.columns == docs.columns
    texts = [(r.doc_id, r.text) for r in out.collect()]
    assert (None, good) in texts and (50, good) in texts and (None, poor) not in texts and (50, poor) not in texts
    out = by["decontamination"](spark, docs, path)
    texts = [(r.doc_id, r.text) for r in out.collect()]
    assert out.columns == docs.columns and (None, items[0][1]) not in texts and (None, good) in texts
    out = by["near dedup"](spark, docs, path)
    assert out.columns == docs.columns and {r.text for r in out.where("doc_id is null").collect()} == {x[1] for x in extra if x[0] is None}
    assert by["toxicity"](spark, docs, path).columns == docs.columns
    none = docs.where("doc_id < 0")
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, none, path).count() == 0, name
    assert by["quality rules"](spark, docs.where("text like 'a b c%'"), path).count() == 0


def test_a_very_long_text_goes_through(spark, folder):
    path, rows, items = folder
    long = " ".join("w%d" % (i * 7919 % 50_021) for i in range(120_000))
    docs = spark.createDataFrame([*rows[:30], (7000, long, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, f in corpus_pipeline.STAGES[:-1]:
        if name != "quality rules":
            assert f(spark, docs, path).where("doc_id = 7000").count() == 1, name
    pieces = corpus_pipeline.packing(spark, docs, path).where("doc_id = 7000").collect()
    assert sum(r.length for r in pieces) == pieces[0].doc_tokens > 120_000 and max(r.length for r in pieces) == 4096


def test_keys_tell_nulls_apart_and_take_no_name(spark):
    rows = [(1, "t", None, "en", 1), (1, "t", "en", None, 1), (1, "t", None, "en", 1), (None, "t", "en", "en", None), (None, "t", "en", "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    key = corpus_pipeline._key(docs)
    got = [r[key] for r in corpus_pipeline._keyed(docs, key).collect()]
    assert len(set(got)) == 4 and got[0] == got[2] and all(len(k) == 33 or "-" in k for k in got)
    taken = docs.selectExpr("*", "'mine' as _Row_key")
    out = corpus_pipeline._filtered(taken, lambda d, k: d.select(k, (d.lang == "en").alias("bad")), "bad", "test-rejected")
    assert out.columns == taken.columns and sorted((r.lang or "", r._Row_key) for r in out.collect()) == [("", "mine")] * 2


def test_superseded_tables_go(spark, folder):
    import os

    at = f"{corpus_pipeline._shared._local(corpus_pipeline._shared.base(spark))}/wayfold"
    names = lambda: sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(at)) - before)
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    out = corpus_pipeline.run(spark, folder[0])
    n = out.count()
    left = names()
    assert [x for x in left if x.startswith(("stage", "rejected", "near"))] == ["stage-decontamination"], left
    assert out.count() == n > 0
