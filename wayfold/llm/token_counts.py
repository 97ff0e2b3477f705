"""Token counts without token ids: each distinct pre-token's pieces are counted once.

Pass 1 finds the distinct pre-tokens of the whole corpus: map tasks drop those they
have sent before, one task per hash bucket drops the rest, counts the pieces of each
with the tokenizers library and writes them as a sorted array to the shared folder.
Pass 2 cuts each text again into pre-token frequencies, joins them to the memory-mapped
arrays and sums pieces times frequency. No ids are made and no text is shuffled.

Pre-tokens are told apart by 64-bit hashes: of a billion different ones, two agree with a
chance of 3 in 100, and then one of them is counted with the other's number of pieces.

Nulls: a null text counts as empty (0 tokens, 0 bytes); a null id is kept. Repeated rows
are counted each. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm import _arrays, _shared
from wayfold.llm._pieces import coder, pretokens, strings
from wayfold.llm._text import Index, U, flat

#: Distinct pre-tokens a map task remembers having sent; beyond it, it may send one again.
REMEMBERED = 2_000_000


def _segments(texts: pa.Array, special: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts cut at special strings, the row of each segment, and the number of special strings of each row."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    found = np.zeros(len(texts), np.int64)
    odd = np.zeros(len(texts), bool)
    for s in special:
        odd |= np.asarray(pc.fill_null(pc.match_substring(texts, s), False).to_numpy(zero_copy_only=False), bool)
    row = np.arange(len(texts))
    if not odd.any():
        return texts, row, found
    import re

    cut = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))))
    more, owner = [], []
    for i in np.flatnonzero(odd).tolist():
        pieces = cut.split(texts[i].as_py())
        found[i] = len(pieces) - 1
        more += pieces
        owner += [i] * len(pieces)
    plain = texts.filter(pa.array(~odd))
    return pa.concat_arrays([plain.cast(pa.string()), pa.array(more, pa.string())]), np.concatenate([row[~odd], np.array(owner, np.int64)]), found


def _row(parts: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.minimum(np.searchsorted(at, parts[:-1], "right"), len(at) - 1) - 1


def token_counts(docs: DataFrame, path: str, rule: str = "byte", limit: int = 512, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (more than limit tokens) of every row. path: a tokenizers file whose pre-tokens follow rule, "byte" (see _pieces.starts)."""
    if rule != "byte":
        raise ValueError("only vocabularies without a normaliser: their pre-tokens don't depend on the text around them")
    spark = docs.sparkSession
    docs = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    n = _arrays.bits(docs)
    at = _shared.folder(spark, "pieces")

    def distinct(batches):
        with coder(path, rule) as c:
            yield from distinct_by(c, batches)

    def distinct_by(c, batches):
        sent = Index(np.zeros(0, U))
        recent: list[np.ndarray] = []
        for batch in batches:
            texts, _, _ = _segments(batch.column("text"), c.special)
            for _, cp, s, e, _, h in pretokens(*flat(texts), rule):
                new = np.flatnonzero(~sent.find(h)[1])
                keys, where = np.unique(h[new], return_index=True)
                for old in recent:
                    keep = ~Index(old).find(keys)[1]
                    keys, where = keys[keep], where[keep]
                if not len(keys):
                    continue
                pick = new[where]
                recent.append(keys)
                if sum(map(len, recent)) > len(sent.keys) // 4 or len(recent) > 8:
                    every = [*recent] if len(sent.keys) > REMEMBERED else [sent.keys, *recent]
                    sent, recent = Index(np.sort(np.concatenate(every))), []
                yield pa.RecordBatch.from_arrays([pa.array(_arrays.bucket(keys, n).astype(np.int64)), pa.array(keys.view(np.int64)), pa.array(strings(cp, s[pick], e[pick]), pa.string())], ["bucket", "key", "piece"])

    def pieces(batches):
        with coder(path, rule) as c:
            yield from pieces_by(c, batches)

    def pieces_by(c, batches):
        now, keys, counts = None, [], []

        def end():
            k = np.concatenate(keys).view(U)
            order = np.argsort(k)
            _arrays.save(at, now, keys=k[order], counts=np.concatenate(counts).astype(np.uint32)[order])
            return pa.RecordBatch.from_pylist([{"bucket": now, "n": len(k)}])

        last = None
        for batch in batches:
            b, k, t = batch.column("bucket").to_numpy(), batch.column("key").to_numpy(), batch.column("piece")
            first = np.ones(len(b), bool)
            first[1:] = (b[1:] != b[:-1]) | (k[1:] != k[:-1])
            if last is not None and len(b):
                first[0] = last != (b[0], k[0])
            last = (b[-1], k[-1]) if len(b) else last
            b, k, t = b[first], k[first], t.filter(pa.array(first)).to_pylist()
            lo = 0
            while lo < len(b):
                hi = int(np.searchsorted(b, b[lo], "right"))
                if b[lo] != now:
                    if keys:
                        yield end()
                    now, keys, counts = int(b[lo]), [], []
                keys.append(k[lo:hi])
                counts.append(c.pieces(t[lo:hi])[1])
                lo = hi
        if keys:
            yield end()

    found = _arrays.run(docs.select("text"), distinct, "bucket long, key long, piece string")
    stats = _arrays.run(found.repartition(1 << n, "bucket").sortWithinPartitions("bucket", "key"), pieces, "bucket long, n long")
    sizes = _arrays.sizes(stats)

    def count(batches):
        with coder(path, rule) as c:
            yield from count_by(c, batches)

    def count_by(c, batches):
        store = _arrays.arrays(at, n, sizes)
        for batch in batches:
            texts, owner, total = _segments(batch.column("text"), c.special)
            data, off = flat(texts)
            found = []
            for parts, _, s, _, first, h in pretokens(data, off, rule):
                keys, _ = _arrays.counted(h)
                place, per = store.find(keys)
                if (place < 0).any():
                    raise RuntimeError("a pre-token isn't in the store; the texts changed between the passes")
                at_, _ = Index(keys).find(h)
                run = np.concatenate([[0], np.cumsum(per[at_])])[np.searchsorted(s, first)]
                found.append((_row(parts, off), np.diff(run)))
            for row, got in found:
                np.add.at(total, owner[row], got)
            size = pc.fill_null(pc.binary_length(batch.column("text").cast(pa.binary())), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), size, pa.array(total), pa.array(total > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    schema = f"id {docs.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    out = _shared.written(_arrays.run(docs, count, schema).withColumnRenamed("id", id), "token-counts")
    _shared.remove(spark, at)
    return out
