import random
from collections import defaultdict

import numpy as np
import pytest

from wayfold.llm.packing import first_fit_decreasing, pack

P = pytest.importorskip("public_tokenizers")


def plain_first_fit(sizes, room):
    free, where = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        for b, f in enumerate(free):
            if f >= sizes[i]:
                break
        else:
            b, f = len(free), room
            free.append(room)
        where[i] = (b, room - free[b])
        free[b] -= sizes[i]
    return [where[i] for i in range(len(sizes))], len(free)


def test_tree_equals_plain_first_fit():
    rnd = random.Random(2)
    for n in (1, 2, 3, 17, 64, 65, 300):
        sizes = np.array([rnd.choice([1, 2, 5, rnd.randint(1, 64), 64]) for _ in range(n)])
        b, at, used = first_fit_decreasing(sizes, 64)
        want, bins = plain_first_fit(sizes.tolist(), 64)
        assert list(zip(b.tolist(), at.tolist())) == want and used == bins


def test_pieces_rebuild_all_ids(spark):
    from tokenizers import Tokenizer

    rnd = random.Random(4)
    words = "alpha Bravo çédille don't 12 é! <|endoftext|> 漢字 İs".split()
    docs = [(i, " ".join(rnd.choices(words, k=rnd.choice([0, 1, 5, 40, 200])))) for i in range(150)]
    docs += [(900, None), (None, "null id"), (901, ""), (902, "twice"), (902, "twice"), (903, "long " * 3000)]
    path = P.path("word_bpe_49k.json")
    got = pack(spark.createDataFrame(docs, "doc_id long, text string"), path, end=2, length=64, group=20).collect()
    t = Tokenizer.from_file(path)
    want = sorted([[i, t.encode(x or "", add_special_tokens=False).ids + [2]] for i, x in docs], key=str)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length <= 64
        pieces[r.doc_id].append((r.start, ids, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, ids in want:
        if i != 902:
            own = sorted(pieces[i])
            assert sum((p[1] for p in own), []) == ids and {p[2] for p in own} == {len(ids)}
    assert len(pieces[902]) == 2
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 64
    total = sum(len(x) for _, x in want)
    assert total / (64 * len(sequences)) > 0.9


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), P.path("word_bpe_49k.json"), end=2).count() == 0


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "a few words " * i, 1, 2, "x") for i in range(9)], "doc_id long, text string, id int, group int, ids string")
    got = pack(docs, P.path("word_bpe_49k.json"), end=2).collect()
    assert {r.doc_id for r in got} == set(range(9)) and sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)
