"""Benchmark decontamination by winnowing.

A window is SPAN words in a row of a benchmark item; an item of fewer words, but not none,
is one window. Of every K-gram hash in a window of SPAN - K + 1 K-grams the least is kept,
so each shared run of SPAN words leaves the same fingerprint on both sides: none is missed.

The benchmark's fingerprints and windows (with their items) are sorted arrays in the
shared folder, whatever their number; tasks map them and join the documents' fingerprints
to them, so no document is shuffled and nothing is broadcast. A hit is extended to the
windows whose least K-gram it is, which are looked up by the hash of all their words and
then compared word by word, and these cover words. Items shorter than SPAN are looked up by their whole length.

Nulls: a null text has no words and hits nothing; a null id is kept; items with a null id
or text are no items. Repeated rows are judged each; a repeated item id is one item with
the windows of all its rows. Empty tables: no rows, or no hits. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm import _arrays, _shared
from wayfold.llm._text import Index, U, flat, gram_at, grams, sum_by, words

K = 7


def least(w, k: int, width: int) -> np.ndarray:
    """For each place the least hash of the width k-grams that start there or after; places near a text's end, where these leave the text, are meaningless."""
    n = len(w.hash) - k + 1
    if n < width:
        return np.zeros(0, U)
    g = gram_at(w, np.arange(n), k)
    done = 1
    while done < width:
        step = min(done, width - done)
        g = np.minimum(g[: len(g) - step], g[step:])
        done += step
    return g


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = 13, ratio: int = 20, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and ratio * n_hit >= n_words) and spans (start and end word of each hit run) of every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).where("item is not null and text is not null")
    b = _arrays.bits(docs)
    k = min(K, span)

    def windows(batches):
        for batch in _arrays.slices(batches):
            data, at = flat(batch.column("text"))
            w = words(data, at, "alnum")
            g, first = grams(w, span, short=True)
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            size = np.minimum(w.count, span)[row]
            # windows come in the order of their texts, one for each start
            start = np.arange(len(g)) - first[:-1][row] + w.first[:-1][row]
            low = least(w, k, span - k + 1)
            texts = [_window(w, data, i, n) for i, n in zip(start.tolist(), size.tolist(), strict=True)]
            mark = np.where(size == span, low[np.minimum(start, max(len(low) - 1, 0))] if len(low) else U(0), U(0))
            yield pa.RecordBatch.from_arrays([pa.array(_arrays.bucket(g, b).astype(np.int64)), pa.array(g.view(np.int64)), pa.array(size), pa.array(mark.view(np.int64)), batch.column("item").take(pa.array(row)), pa.array(texts, pa.binary())], ["bucket", "key", "size", "mark", "item", "words"])

    found = _shared.written(_arrays.run(items, windows, "bucket long, key long, size long, mark long, item string, words binary").distinct(), "benchmark-windows")
    lengths = sorted(r["size"] for r in found.where(F.col("size") < span).select("size").distinct().collect())  # fewer than span values
    path = _shared.folder(spark, "benchmark")

    def marks(batches):
        for batch in batches:
            yield _arrays.rows(*_arrays.counted(batch.column("mark").to_numpy().view(U)), b)

    fingerprints = _arrays.sizes(_arrays.store(_arrays.run(found.where(F.col("size") == span).select("mark").distinct(), marks, _arrays.BLOBS), f"{path}/marks", b))

    def index(batches):
        for i, held in _arrays.by_bucket(batches):
            key = np.array([r["key"] for r in held], np.int64).view(U)
            order = np.argsort(key, kind="stable")
            key = key[order]
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            _arrays.save(f"{path}/windows", i, keys=key[at], counts=np.diff(np.append(at, len(key))), start=at.astype(np.int64))
            _shared.write(f"{path}/windows/items-{i}.arrow", [_strings([held[j]["item"] for j in order.tolist()], [held[j]["words"] for j in order.tolist()])])
            yield pa.RecordBatch.from_pylist([{"bucket": i, "n": len(at)}])

    sizes = _arrays.sizes(_arrays.run(found.select("bucket", "key", "item", "words").distinct().repartition(1 << b, "bucket").sortWithinPartitions("bucket"), index, "bucket long, n long"))

    def judge(batches):
        marked, store = _arrays.arrays(f"{path}/marks", b, fingerprints), _arrays.arrays(f"{path}/windows", b, sizes)
        for batch in _arrays.slices(batches):
            data, off = flat(batch.column("text"))
            w = words(data, off, "alnum")
            count, ends = w.count, w.first[1:]
            row = w.text_of()
            tries = []
            low = least(w, k, span - k + 1)
            if len(low):
                run = np.flatnonzero(np.append(True, low[1:] != low[:-1]))  # places that share a fingerprint
                uniq = _arrays.counted(low[run])[0]
                hit = (marked.find(uniq)[0] >= 0)[Index(uniq).find(low[run])[0]]
                at = np.flatnonzero(np.repeat(hit, np.diff(np.append(run, len(low)))))
                at = at[at + span <= ends[row[at]]]
                tries.append((at, gram_at(w, at, span), span))
            for n in lengths:
                at = np.arange(len(w.hash))
                at = at[at + n <= ends[row]]
                tries.append((at, gram_at(w, at, n), n))
            cover = np.zeros(len(w.hash) + 1, np.int64)
            own: dict[int, set[str]] = {}
            for at, h, n in tries:
                uniq = _arrays.counted(h)[0]
                hit = (store.find(uniq)[0] >= 0)[Index(uniq).find(h)[0]] if len(h) else np.zeros(0, bool)
                at, h = at[hit], h[hit]
                known = _items(store, _arrays.counted(h)[0].tolist())
                same = np.zeros(len(at), bool)
                for j, (i, key) in enumerate(zip(at.tolist(), h.tolist(), strict=True)):
                    if names := known[key].get(_window(w, data, i, n)):
                        same[j] = True
                        own.setdefault(int(row[i]), set()).update(names)
                np.add.at(cover, at[same], 1)
                np.add.at(cover, at[same] + n, -1)
            inside = np.cumsum(cover[:-1]) > 0
            n_hit = sum_by(w.first, inside.astype(np.int64))
            n_items, digest, spans = np.zeros(batch.num_rows, np.int64), [_EMPTY] * batch.num_rows, [[] for _ in range(batch.num_rows)]
            for r, names in own.items():
                n_items[r], digest[r] = len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
                x = np.diff(inside[w.first[r] : w.first[r + 1]].astype(np.int8), prepend=0, append=0)
                spans[r] = [{"start": a, "end": z} for a, z in zip(np.flatnonzero(x == 1).tolist(), np.flatnonzero(x == -1).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(count), pa.array(n_hit), pa.array(n_items), pa.array(digest, pa.string()), pa.array((n_hit > 0) & (ratio * n_hit >= count)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
            )

    schema = f"id {docs.schema['id'].dataType.simpleString()}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start: long, end: long>>"
    out = _shared.written(_arrays.run(docs, judge, schema).withColumnRenamed("id", id), "decontaminated")
    _shared.remove(spark, path)
    _shared.drop(found)
    return out


_EMPTY = hashlib.sha256(b"").hexdigest()


def _window(w, data: np.ndarray, at: int, n: int) -> bytes:
    """The n words from a place on, lower-cased (A-Z) and set apart by single spaces."""
    return b" ".join(data[a:z].tobytes().lower() for a, z in zip(w.start[at : at + n].tolist(), w.end[at : at + n].tolist(), strict=True))


def _strings(items: list[str], texts: list[bytes]) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([pa.array(items, pa.large_string()), pa.array(texts, pa.large_binary())], ["item", "words"])
    with pa.ipc.new_file(sink, batch.schema) as f:
        f.write_batch(batch)
    return sink.getvalue()


def _items(store: _arrays.Arrays, keys: list[int]) -> dict[int, dict[bytes, set[str]]]:
    """The windows with each hash, by their words, and their items; the strings are mapped too."""
    h = np.array(keys, U)
    place, start, count = store.find(h, "start", "counts")
    out: dict[int, dict[bytes, set[str]]] = {}
    for key, b, a, n in zip(keys, _arrays.bucket(h, store.n).tolist(), start.tolist(), count.tolist(), strict=True):
        if ("items", b) not in store.open:
            store.open["items", b] = pa.ipc.open_file(pa.memory_map(_shared.fetched(f"{store.path}/items-{b}.arrow"))).get_batch(0)
        some = store.open["items", b].slice(a, n)
        for name, text in zip(some.column("item").to_pylist(), some.column("words").to_pylist(), strict=True):
            out.setdefault(key, {}).setdefault(text, set()).add(name)
    return out
