"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

A text's features are the distinct hashes (64 bits) of its words, pairs of neighbours and
pairs with one word between, of lower-cased runs of letters and digits. Each coordinate
has its own learning rate from its past gradients; L1 keeps the weights of few features.

Learning takes at most `sample` labelled rows of the documents, those with the least hashes
of id and text; rows alike in both are one, so however often an id repeats, no more come.
They are written once, and all passes of learning read them.
Their features are counted and numbered in Spark; those of so few rows that L1 keeps their
weight at 0 for certain are left out, which changes no weight. One task takes the rows in
hash order: it writes their numbers to the shared folder as they come and maps them, so in
memory it holds two numbers a feature and one row. Its time follows the sample's size, not
the corpus. What comes back are the non-zero weights, at most MOST of them (else fit()
refuses and asks for a larger l1), which are broadcast. Every text is scored whole.

Nulls: a null text is empty and scores by the bias alone; a null id is kept but never
learned from; a null label is no label. Of several labels of one id the largest counts,
of rows that repeat an id each different text is learned from, once. With no labels every score is 0.5. Empty
tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm import _arrays, _shared
from wayfold.llm._text import Index, U, constants, flat, mix, words

SAMPLE = 16_000
MOST = 1_000_000
_KIND = constants(3, 515)
_SECOND = constants(1, 516)[0]
BIAS = U(1)


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each feature occurrence of the texts."""
    w = words(data, at, "alnum")
    row, h = w.text_of(), w.hash
    rows, out = [row], [mix(h ^ _KIND[0])]
    for kind, gap in ((1, 1), (2, 2)):
        same = row[:-gap] == row[gap:]
        rows.append(row[:-gap][same])
        out.append(mix(h[:-gap][same] * _SECOND + h[gap:][same] ^ _KIND[kind]))
    return np.concatenate(rows), np.concatenate(out)


def train(rows: list[np.ndarray], labels: list[int], size: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> np.ndarray:
    """The weights of features 0 to size - 1, then the bias. rows: each text's distinct features, which may be memory-mapped."""
    z, s = np.zeros(size + 1), np.zeros(size + 1)
    for _ in range(epochs):
        for r, y in zip(rows, labels, strict=True):
            a = np.append(r, size)
            za, sa = z[a], s[a]
            free = np.abs(za) - l1
            free[-1] = abs(za[-1])  # the bias isn't shrunk
            root = np.sqrt(sa)
            w = np.where(free > 0, -np.sign(za) * free / ((beta + root) / alpha + l2), 0.0)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            z[a] = za + g - (np.sqrt(sa + g * g) - root) / alpha * w
            s[a] = sa + g * g
    free = np.abs(z) - l1
    free[-1] = abs(z[-1])
    return np.where(free > 0, -np.sign(z) * free / ((beta + np.sqrt(s)) / alpha + l2), 0.0)


def _distinct(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct features of each text, in order."""
    row, h = features(*flat(batch.column("text")))
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[keep], h[keep]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id: str = "doc_id", text: str = "text", sample: int = SAMPLE, alpha: float = 3.0, beta: float = 1.0, l1: float = 0.15, l2: float = 0.0, epochs: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights of the features that matter. l1: times the square root of the number of rows, as the noise of a sum of gradients grows."""
    spark = docs.sparkSession
    y = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    y = y.join(docs.select(F.col(id).alias("id")), "id", "left_semi")
    y = _shared.written(y.withColumn("turn", F.xxhash64(F.col("id").cast("string"))).orderBy("turn", "id").limit(sample), "toxicity-labels")
    # at most `sample` rows of three numbers: their size is bounded, so they are broadcast
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(y), "id").withColumn("own", F.xxhash64("text"))
    rows = every = _shared.written(rows.groupBy("turn", "own").agg(F.first("y").alias("y"), F.min("text").alias("text")), "toxicity-rows")
    n = rows.count()
    if n > sample:
        first = _shared.written(rows.select("turn", "own").orderBy("turn", "own").limit(sample), "toxicity-first")
        rows, n = rows.join(F.broadcast(first), ["turn", "own"], "left_semi"), sample
    l1 = l1 * n**0.5
    # a row moves a feature's gradient sum by 1 an epoch at most: below so many rows it never gets over l1, and its weight stays 0
    least = max(1, math.floor(l1 / epochs) + 1)
    b, path = _arrays.bits(docs), _shared.folder(spark, "toxicity")

    def count(batches):
        for batch in _arrays.slices(batches):
            yield _arrays.rows(*_arrays.counted(_distinct(batch)[1]), b)

    sizes = _arrays.sizes(_arrays.store(_arrays.run(rows.select("text"), count, _arrays.BLOBS), f"{path}/features", b, least=least))

    def take(batches):
        store = _arrays.arrays(f"{path}/features", b, sizes)
        for batch in _arrays.slices(batches):
            row, h = _distinct(batch)
            uniq = _arrays.counted(h)[0]
            place = store.find(uniq)[0][Index(uniq).find(h)[0]] if len(h) else np.zeros(0, np.int64)
            row, place = row[place >= 0], place[place >= 0].astype(np.uint32)
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column("turn"), batch.column("y"), pa.array([place[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["turn", "y", "features"])

    def learn(batches):
        store = _arrays.arrays(f"{path}/features", b, sizes)
        xs, ys = [], []
        for i, batch in enumerate(batches):
            x = batch.column("features").to_pylist()
            _arrays.save(f"{path}/rows", i, places=np.frombuffer(b"".join(x), np.uint32))
            ends = np.cumsum([0, *(len(r) // 4 for r in x)])
            held = _arrays.mapped(f"{path}/rows", "places", i, "u4", int(ends[-1]))
            xs += [held[p:q] for p, q in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            ys += batch.column("y").to_pylist()
        w = train(xs, ys, int(store.sizes.sum()), alpha, beta, l1, l2, epochs)
        use = np.flatnonzero(w[:-1])
        at = np.searchsorted(np.cumsum(store.sizes), use, "right")
        key = np.concatenate([store.column("keys", int(i), ("u8",))[use[at == i] - store.base[i]] for i in np.unique(at)] + [np.array([BIAS])])
        w = np.append(w[use], w[-1])
        for lo in range(0, len(key), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(key[lo : lo + 100_000].view(np.int64)), pa.array(w[lo : lo + 100_000])], ["key", "w"])

    taken = _arrays.run(rows.select("turn", "y", "text"), take, "turn long, y int, features binary")
    got = _arrays.run(taken.repartition(1).sortWithinPartitions("turn", F.xxhash64("features")), learn, "key long, w double").limit(MOST + 1).toArrow()
    _shared.remove(spark, path)
    _shared.drop(y, every, *([first] if n == sample and rows is not every else []))
    if got.num_rows > MOST:
        raise ValueError(f"more than {MOST} weights; set a larger l1")
    key, w = got.column("key").to_numpy().view(U), got.column("w").to_numpy()
    order = np.argsort(key)
    return key[order], w[order]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, score (0 to 1) and predicted (1 from 0.5 on) of every row."""
    docs = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        key, w = sent.value
        index, bias = Index(key), float(w[key == BIAS].sum())
        for batch in _arrays.slices(batches):
            row, h = features(*flat(batch.column("text")))
            place, there = index.find(h)
            hit = np.unique(row[there].astype(np.int64) * len(key) + place[there])
            total = np.full(batch.num_rows, bias) + np.bincount(hit // max(len(key), 1), w[hit % max(len(key), 1)] if len(hit) else None, minlength=batch.num_rows)
            p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    return _arrays.run(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, score double, predicted int").withColumnRenamed("id", id)
