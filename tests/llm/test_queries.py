"""The registered queries' own columns against plain versions, on a small folder of tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

P = pytest.importorskip("public_tokenizers")
from wayfold.llm.queries import QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rnd = random.Random(7)
    at = tmp_path_factory.mktemp("tables")
    words = ["the", "Of", "a", "naïve", "x1", "rain,", "über", "slur"]
    docs = [(i * 7 % 41, " ".join(rnd.choices(words, k=rnd.choice([0, 1, 9, 80])))) for i in range(41)] + [(100, None), (101, "\t\n"), (None, "the rain"), (3, "the rain")]
    pq.write_table(pa.table({"doc_id": pa.array([d[0] for d in docs], pa.int64()), "text": [d[1] for d in docs], "lang": ["en"] * len(docs), "source": ["s"] * len(docs), "n_chars": [len(d[1] or "") for d in docs]}), at / "documents.parquet")
    pq.write_table(pa.table({"doc_id": list(range(41)), "quality": [1] * 41, "toxic": [int("slur" in (dict(docs)[i] or "")) for i in range(41)]}), at / "labels.parquet")
    vectors = [[float(np.float32(rnd.gauss(0, 1))) for _ in range(6)] for _ in range(30)]
    pq.write_table(pa.table({"vec_id": list(range(32)), "embedding": pa.array([*vectors, None, vectors[0]], pa.list_(pa.float32())), "label": [0] * 32}), at / "embeddings.parquet")
    return str(at), docs, vectors


def remainder(i, n):
    """Whether crc32 of the id as text is divisible by n; a missing id is never learned from."""
    return i is None or zlib.crc32(str(i).encode()) % n == 0


def ids_of(docs, name, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    return [(i, np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4")) for i, x in docs]


def test_op1_starts_and_checksums(spark, folder):
    at, docs, _ = folder
    rows = QUERIES["op1_id_files"](spark, at).collect()
    want = {}
    for i, ids in ids_of(docs, "byte_bpe_50k.json", 0):
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    order = sorted((r for r in rows if r.doc_id is not None), key=lambda r: (r.doc_id, r.start))
    first = [r.start for r in sorted(rows, key=lambda r: r.start)]
    sizes = [r.n_tokens for r in sorted(rows, key=lambda r: r.start)]
    assert first == [sum(sizes[:k]) for k in range(len(sizes))] and [r.start for r in order] == sorted(r.start for r in order)


def test_op2_and_op4_hold_out_by_checksum(spark, folder):
    at, docs, _ = folder
    rows = QUERIES["op2_toxicity"](spark, at).collect()
    assert sorted((str(r.doc_id), r.held_out) for r in rows) == sorted((str(i), remainder(i, 5)) for i, _ in docs)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    count = Counter()
    for i, t in docs:
        if not remainder(i, 10):
            count.update([*words(t), None])
    n, v = sum(count.values()), len(count)
    want = []
    for i, t in docs:
        tokens = [*words(t), None]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        want.append((str(i), remainder(i, 10), len(tokens), sum(count[w] > 0 for w in tokens), n, round(base, 6)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in QUERIES["op4_lm_scoring"](spark, at).collect()]
    assert sorted(got) == sorted(want)


def test_op8_pieces_are_the_ids(spark, folder):
    at, docs, _ = folder
    rows = QUERIES["op8_packing"](spark, at).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, ids in ids_of([d for d in docs if d[0] not in (3, None)], "word_bpe_49k.json", 2):
        pieces = sorted(by[i], key=lambda r: r.start)
        assert [r.start for r in pieces] == [sum(x.length for x in pieces[:k]) for k in range(len(pieces))]
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in pieces)
    at_ = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at_.get(r.sequence_id, 0)
        at_[r.sequence_id] = r.offset + r.length
    assert max(at_.values()) <= 4096


def test_op11_and_op12_columns(spark, folder):
    at, docs, vectors = folder
    rows = QUERIES["op11_suffix_dedup"](spark, at)
    assert dict(rows.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}
    from tests.llm.test_suffix_dedup import brute

    assert sorted((tuple(r) for r in rows.collect()), key=str) == brute(docs)
    rows = QUERIES["op12_whitening"](spark, at)
    assert dict(rows.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    got = rows.collect()
    assert sorted((r.vec_id, r.component) for r in got) == [(i, c) for i in [*range(30), 31] for c in range(1, 7)] and {r.n for r in got} == {30}
