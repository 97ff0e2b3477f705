import random

import numpy as np
import pyarrow as pa
import pytest

from wayfold.llm import _arrays, _pieces, _text
from wayfold.llm._pieces import Coder, coder, parts, pretokens, strings
from wayfold.llm.token_counts import token_counts

P = pytest.importorskip("public_tokenizers")

FILES = [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")]
ALPHABET = [*"aB's t'rve ll  \n\t.,!1 2é²Ñ İ́漢字🙂\x1c\x85 ς<|½٣߀ª", "<|endoftext|>", "<|startoftext|>", "'re", "'LL", " 's", "\r\n", "ﬁ", "  ", "don't", "ǅ", "　", "​", "é"]


def texts(n=4000, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 25))) for _ in range(n)] + [None, "", " ", "\n\n", "''", "'s's"]


@pytest.mark.parametrize("name,rule", FILES)
def test_ids_equal_the_library(name, rule, monkeypatch):
    monkeypatch.setattr(_pieces, "KEPT", 3000)  # starts anew now and then
    c, some = Coder(P.path(name), rule), texts()
    want = [x.ids for x in c.tokenizer.encode_batch([t or "" for t in some], add_special_tokens=False)]
    for lo in range(0, len(some), 1500):
        ids, first = c.encode(pa.array(some[lo : lo + 1500], pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == want[lo : lo + 1500]


@pytest.mark.parametrize("name,rule", FILES)
def test_long_texts_are_cut_where_pretokens_start(name, rule, monkeypatch):
    monkeypatch.setattr(_pieces, "SPAN", 60)
    c = Coder(P.path(name), rule)
    rnd = random.Random(3)
    some = [" ".join(rnd.choice(["it's", "word", "12", "end.\n", "X"]) for _ in range(200)), "x" * 500, "short", "".join(rnd.choice(["漢字", "かな", "，", "。", "１", "’s"]) for _ in range(200))]
    at = _text.flat(pa.array(some))[1]
    assert len(parts(_text.flat(pa.array(some))[0], at)) > len(at) + 1
    ids, first = c.encode(pa.array(some))
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [x.ids for x in c.tokenizer.encode_batch(some, add_special_tokens=False)]


def test_tables_last_for_a_stage_that_keeps_them(spark):
    """A worker's next task of the stage knows what the last one met; no other stage finds it."""
    path = P.path("byte_bpe_50k.json")

    def known(keep):
        def f(batches):
            with coder(path, "byte", keep=keep) as c:
                before = c.known
                for b in batches:
                    c.encode(b.column("text"))
                yield pa.RecordBatch.from_pydict({"before": [before], "after": [c.known]})

        df = spark.range(0, 400, 1, 40).selectExpr("concat('some words and number ', id % 10) AS text")
        return [tuple(r) for r in _arrays.run(df, f, "before long, after long", keep=keep).collect()]

    assert {a for a, _ in known(False)} == {0}
    again = known(True)
    assert {b for _, b in again} == {b for _, b in known(False)} and 14 in {a for a, _ in again}
    assert {a for a, _ in known(False)} == {0}


def test_tables_of_a_failed_task_are_dropped():
    path = P.path("byte_bpe_50k.json")
    with coder(path, "byte", keep=True) as c:
        c.encode(pa.array(["some words"]))
    with pytest.raises(KeyError), coder(path, "byte", keep=True) as c:
        assert c.known == 2
        raise KeyError
    with coder(path, "byte", keep=True) as c:
        assert c.known == 0
    _pieces.forget()


def test_pretokens_are_looked_up_once(monkeypatch):
    c, calls, find = Coder(P.path("byte_bpe_50k.json"), "byte"), [], Coder.find
    monkeypatch.setattr(Coder, "find", lambda self, h: calls.append(len(h)) or find(self, h))
    for _ in range(2):
        ids, _ = c.encode(pa.array(["new words, new words"]))
        assert ids.tolist() == c.tokenizer.encode("new words, new words", add_special_tokens=False).ids
    assert calls == [5, 5]


def test_pretokens_equal_the_librarys_cut():
    c = Coder(P.path("byte_bpe_50k.json"), "byte")
    for t in texts(500, 9):
        if t and "<|" not in t:
            got = [x for _, cp, s, e, _, _ in pretokens(*_text.flat(pa.array([t])), "byte") for x in strings(cp, s, e)]
            assert got == [t[a:b] for _, (a, b) in c.tokenizer.pre_tokenizer.pre_tokenize_str(t)]


def test_words_and_grams_by_hand(monkeypatch):
    monkeypatch.setattr(_text, "SPAN", 16)
    _text.powers.cache_clear()
    import re

    rnd = random.Random(2)
    some = ["".join(rnd.choice("aB é\n.1") for _ in range(rnd.randint(0, 60))) for _ in range(300)] + ["a" * 100, "", "b" * 40 + " " + "é" * 30]
    for rule, pattern in (("space", r"[^\x20\x09-\x0D]+"), ("alnum", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = _text.words(*_text.flat(pa.array(some)), rule)
        low = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in some]
        want = [re.findall(pattern, t) for t in low]
        assert w.count.tolist() == [len(x) for x in want]
        of = {}
        for h, x in zip(w.hash.tolist(), sum(want, [])):
            assert of.setdefault(x, h) == h
        assert len(set(of.values())) == len(of)
        g, first = _text.grams(w, 3, short=True)
        shingles = [[tuple(x[i : i + 3]) for i in range(max(1, len(x) - 2))] if x else [] for x in want]
        assert np.diff(first).tolist() == [len(x) for x in shingles]
        of = {}
        for h, x in zip(g.tolist(), sum(shingles, [])):
            assert of.setdefault(x, h) == h
        assert len(set(of.values())) == len(of)


def test_sums_dont_depend_on_place_or_span(monkeypatch):
    rnd = np.random.default_rng(5)
    data = rnd.integers(0, 256, 1000).astype(np.uint8)
    start = np.sort(rnd.choice(900, 60, replace=False))
    end = np.minimum(start + 1, np.append(start[1:], 1000))
    end[::7] = np.append(start[1:], 1000)[::7]
    value = _text.constants(256, 11)
    got = []
    for span in (1 << 18, 64, 7, 1000, 999):
        monkeypatch.setattr(_text, "SPAN", span)
        _text.powers.cache_clear()
        got.append(_text.sums(data, value, start, end).tolist())
    p = 0x5851F42D4C957F2D
    want = [sum(int(value[data[i]]) * pow(p, i - a, 1 << 64) for i in range(a, z)) % (1 << 64) for a, z in zip(start.tolist(), end.tolist())]
    assert all(x == want for x in got)
    _text.powers.cache_clear()
    assert len(_text.words(data[:0], np.zeros(3, np.int64)).hash) == 0


def test_a_long_run_without_gaps_needs_no_larger_tables():
    _text.powers.cache_clear()
    text = np.full(5 * _text.SPAN + 3, 0x61, np.uint8)
    w = _text.words(text, np.array([0, len(text)]))
    assert w.start.tolist() == [0] and w.end.tolist() == [len(text)] and len(_text.powers()[0]) == _text.SPAN


def test_token_counts(spark):
    from tokenizers import Tokenizer

    rows = [(i, t, "x") for i, t in enumerate(texts(400, 5))] + [(None, "null id", "y"), (3, "same", "y"), (3, "same", "y"), (10_000, "word " * 40_000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = token_counts(df, P.path("byte_bpe_50k.json")).collect()
    want = []
    for i, x, _ in rows:
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        want.append((i, len((x or "").encode()), n, n > 512))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts(df.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_buckets_follow_the_input(spark, tmp_path, monkeypatch):
    from wayfold.llm import _arrays

    spark.range(200_000).selectExpr("id", "sha2(cast(id as string), 256) as text").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert _arrays.bits(df) == (least - 1).bit_length() == _arrays.bits(spark.createDataFrame([(1,)], "id int"))
    size = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    assert size * 0.9 < _arrays.input_bytes(df.where("id > 5")) < size * 1.1
    monkeypatch.setattr(_arrays, "PER_BUCKET", size // 100)
    assert _arrays.bits(df) == 7 and _arrays.bits(df.join(spark.range(9), "id")) == 7
    monkeypatch.setattr(_arrays, "PER_BUCKET", 1)
    assert _arrays.bits(df) == _arrays.MOST_BITS
