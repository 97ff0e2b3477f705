"""Ranked lexical search: an inverted index in shards, searched by block-max WAND with variable blocks.

A term is a run of letters, digits and bytes from 0x80 on, A-Z lower-cased. A term's weight is
w = floor(1000 ln((2N + 2) / (2 df + 1))), its impact in a document with tf of its n terms
u = 10^9 tf div (1000 tf + 8 m), m = 10 + 90 n N div L; a document scores the sum of w u over
the query's terms, once each. N: documents with a term, L: all their terms.

Index: each task cuts its documents into shards of SHARD bytes of text. A shard has a row for
each of its terms: its documents, how often each has it, and its blocks. Where blocks end is
found by dynamic programming over the whole list, so that the sum over blocks of (size * largest
impact - impacts), by which the bounds are too high, plus COST a block is least; blocks have
at most LONGEST postings. Terms are told apart by their bytes. Nothing is shuffled.

Search: the rows of the queries' terms, and only those, are shuffled by shard. In a shard, the
ends of a query's blocks cut the documents into intervals; in each the blocks' largest
impacts, by weight, bound all scores. Intervals are visited from the highest bound on, until
the next is below the k-th score found so far (the threshold); all other blocks are skipped.
In a visited interval a document is a pivot if the bounds of the terms that it has reach the
threshold, and only pivots are scored. So a shard's k best are exact, equal scores by
id; what shards return, k rows a query, is ranked in Spark. Queries lie in files of QUERIES
each, which tasks map: a task holds one shard's lists and one such file.

Nulls: null texts have no terms; documents with a null id are ranked, last among equals; items
with a null id aren't queries. Repeated document rows are ranked each; rows that repeat an
item id are one query of all their terms. Empty tables, items without terms and terms that no
document has give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.llm import _arrays, _shared
from wayfold.llm._text import WORD_BYTES, flat

#: Bytes of text of a shard, postings of a block at most, and what a block costs, in units of impact.
SHARD, LONGEST, COST = 16 << 20, 64, 4_000_000
#: Items of a file of queries, and query terms that are broadcast at most (some 100 bytes each).
QUERIES, BROADCAST = 4096, 500_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All numbers of ranges, one after another."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def terms(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of texts in order, coded by a dictionary, and each text's number of them."""
    inside = WORD_BYTES["alnum"][data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    begin = np.flatnonzero(inside & (edge[:-1] | np.append(True, ~inside[:-1])[: len(inside)]))
    end = np.flatnonzero(inside & (edge[1:] | np.append(~inside[1:], True)[: len(inside)])) + 1
    offsets = np.append(0, np.cumsum(end - begin))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[inside]])])
    return words.dictionary_encode(), np.diff(np.searchsorted(begin, at))


def cut(impact: np.ndarray, first: np.ndarray, cost: int = COST, longest: int = LONGEST) -> np.ndarray:
    """Whether each posting ends a block, of lists that begin at first (the end included): least sum of size * largest a block, plus cost each."""
    size = np.diff(first)
    ends = np.zeros(len(impact), bool)
    ends[first[1:] - 1] = True
    kind = np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)
    for c in np.unique(kind[size > 1]).tolist():  # lists of about the same size together
        every = np.flatnonzero((kind == c) & (size > 1))
        every = every[np.argsort(-size[every], kind="stable")]
        for lists in np.array_split(every, len(every) * min(1 << c, longest) // (1 << 21) + 1):
            _cut(impact, first[lists], size[lists], ends, cost, longest)
    return ends


def _cut(impact: np.ndarray, first: np.ndarray, size: np.ndarray, ends: np.ndarray, cost: int, longest: int) -> None:
    """Dynamic programming over lists of falling size, a posting of each at a time; the starts at hand are a ring."""
    n, m = len(size), int(size[0])
    back = np.zeros((n, m + 1), np.int32)
    top, before = np.zeros((n, longest), np.int64), np.zeros((n, longest), np.int64)
    ring = np.arange(longest)
    active = np.searchsorted(-size, -np.arange(m + 1), "right")
    rows = np.arange(n)
    for i in range(1, m + 1):
        a, w = int(active[i]), min(i, longest)
        top[:a, (i - 1) % longest] = 0
        now = np.maximum(top[:a, :w], impact[first[:a] + i - 1][:, None])
        top[:a, :w] = now
        length = (i - 1 - ring[:w]) % longest + 1
        now *= length
        now += before[:a, :w]
        best = now.argmin(1)
        back[:a, i] = i - length[best]
        before[:a, i % longest] = now[rows[:a], best] + cost
    at = size.astype(np.int64)
    open_ = rows
    while len(open_):
        ends[first[open_] + at[open_] - 1] = True
        at[open_] = back[open_, at[open_]]
        open_ = open_[at[open_] > 0]


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """u of each posting, from its document's number of terms."""
    large = len(n) and int(n.max()) * docs * 90 >= 1 << 63
    m = 10 + (90 * n.astype(object) * docs // total if large else 90 * n * docs // max(total, 1)).astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


@dataclass(frozen=True)
class Index:
    """The table of shards: for each term its n documents, and a row without a term of the shard's documents; N and L."""

    table: DataFrame
    docs: int
    total: int


_ROWS = "shard long, term binary, n long, docs binary, tfs binary, ends binary, tops binary"
_NAMES = [c.split()[0] for c in _ROWS.split(", ")]


def build(docs: DataFrame, id: str = "doc_id", text: str = "text", shard: int = SHARD) -> Index:
    """The index of all documents."""
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))

    def measure(batches):
        n = total = 0
        for batch in _arrays.slices(batches):
            data, at = flat(batch.column("text"))
            inside = WORD_BYTES["alnum"][data]
            edge = np.zeros(len(data) + 1, bool)
            edge[at] = True
            begin = np.append(0, np.cumsum(inside & (edge[:-1] | np.append(True, ~inside[:-1])[: len(inside)])))
            count = np.diff(begin[at])
            n, total = n + int((count > 0).sum()), total + int(count.sum())
        yield pa.RecordBatch.from_pydict({"n": [n], "total": [total]})

    stats = _arrays.run(docs, measure, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    n_docs, total = stats[0] or 0, stats[1] or 0

    def shards(batches):
        parts, size, k = [], 0, 0
        base = TaskContext.get().partitionId() << 32
        for batch in _arrays.slices(batches):
            data, at = flat(batch.column("text"))
            words, count = terms(data, at)
            row = np.repeat(np.arange(len(count)), count)
            many = max(len(words.dictionary), 1)
            key, tf = np.unique(row * many + words.indices.to_numpy(), return_counts=True)
            parts.append((words.dictionary, key // many, key % many, tf, count, batch.column("id")))
            size += len(data)
            if size >= shard:
                yield from _shard(base + k, parts, n_docs, total)
                parts, size, k = [], 0, k + 1
        if parts:
            yield from _shard(base + k, parts, n_docs, total)

    return Index(_shared.written(_arrays.run(docs, shards, _ROWS), "postings"), n_docs, total)


def _binary(x: np.ndarray, first: np.ndarray) -> pa.Array:
    """Values of each range as bytes."""
    width = x.dtype.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer((first * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def _shard(number: int, parts: list[tuple], n_docs: int, total: int) -> Iterator[pa.RecordBatch]:
    """The rows of a shard: its documents by id, then its terms in order."""
    ids = pa.concat_arrays([p[5] for p in parts])
    none = np.asarray(ids.is_null())
    ids = ids.fill_null(0).to_numpy()
    order = np.lexsort((ids, none))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    sizes = np.concatenate([p[4] for p in parts])[order]
    one = np.array([0, len(order)])
    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([None], pa.binary()), pa.array([len(order)]), _binary(ids[order], one), _binary(_arrays.narrow(sizes), one), _binary(none[order].view(np.uint8), one), pa.array([b""])], _NAMES)
    dictionary = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
    words = dictionary.dictionary
    if not len(words):
        return
    by = pc.array_sort_indices(words).to_numpy()
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    place = place[dictionary.indices.to_numpy()]
    shift = np.cumsum([0, *(len(p[0]) for p in parts)])
    start = np.cumsum([0, *(len(p[4]) for p in parts)])
    term = np.concatenate([place[p[2] + s] for p, s in zip(parts, shift.tolist(), strict=False)])
    doc = rank[np.concatenate([p[1] + s for p, s in zip(parts, start.tolist(), strict=False)])]
    tf = np.concatenate([p[3] for p in parts])
    parts.clear()
    order = np.argsort(term * len(ids) + doc)
    term, doc, tf = term[order], doc[order], tf[order]
    size = np.bincount(term, minlength=len(words))
    first = np.append(0, np.cumsum(size))
    u = impacts(tf, sizes[doc], n_docs, total)
    last = np.flatnonzero(cut(u, first))
    top = np.maximum.reduceat(u, np.append(0, last[:-1] + 1))
    blocks = np.append(0, np.cumsum(np.bincount(term[last], minlength=len(words))))
    doc, tf, last = _arrays.narrow(doc), _arrays.narrow(tf), _arrays.narrow(last - first[:-1][term[last]])
    # in pieces: binary columns have 32-bit offsets
    step = max(1, (1 << 28) // max(1, int(size.max()) * 8))
    words = words.take(pa.array(by)).cast(pa.binary())
    for lo in range(0, len(words), step):
        f, b = first[lo : lo + step + 1], blocks[lo : lo + step + 1]
        some = [_binary(x[at[0] : at[-1]], at - at[0]) for x, at in ((doc, f), (tf, f), (last, b), (top.astype(np.uint32), b))]
        m = len(f) - 1
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, number)), words.slice(lo, m), pa.array(size[lo : lo + m]), *some], _NAMES)


def _values(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """All bytes of a binary column as whole numbers of a width."""
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return np.frombuffer(data.tobytes(), f"<u{width}").astype(np.int64)


class Shard:
    """The lists of a shard that queries ask for."""

    def __init__(self, table: pa.Table, docs: int, total: int):
        head = table.slice(0, 1)
        n = int(head.column("n")[0].as_py())
        self.ids = np.frombuffer(head.column("docs")[0].as_py(), np.int64)
        self.none = np.frombuffer(head.column("ends")[0].as_py(), bool)
        sizes = head.column("tfs")[0].as_py()
        self.sizes = np.frombuffer(sizes, f"<{'i' if len(sizes) // n == 8 else 'u'}{len(sizes) // n}").astype(np.int64)
        lists = table.slice(1)
        self.term = {t: i for i, t in enumerate(lists.column("term").to_pylist())}
        self.first = np.append(0, np.cumsum(lists.column("n").to_numpy()))
        width = lambda name, per: len(lists.column(name)[0].as_py()) // per
        if lists.num_rows:
            each = int(lists.column("n")[0].as_py())
            self.docs, self.tfs = (_values(lists.column(c), width(c, each)) for c in ("docs", "tfs"))
            self.top = _values(lists.column("tops"), 4)
            n_blocks = pc.binary_length(lists.column("tops")).to_numpy() // 4
            self.block = np.append(0, np.cumsum(n_blocks))
            end = _values(lists.column("ends"), width("ends", int(n_blocks[0]))) + np.repeat(self.first[:-1], n_blocks)
            self.begin, self.size = np.append(0, end[:-1] + 1), np.diff(np.append(-1, end))
            self.last = self.docs[end]
            # the first document that a block's bound stands for, and by how much the bound changes after its last
            self.since = np.append(0, self.last[:-1] + 1)
            self.since[self.block[:-1]] = 0
            after = np.append(self.top[1:], 0)
            after[self.block[1:] - 1] = 0
            self.change = after - self.top
        self.n_docs, self.total = docs, total

    def best(self, query: list[tuple[bytes, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k highest-scoring documents (those with a score above 0) and their scores."""
        found = [(self.term[t], w) for t, w in query if t in self.term]
        none = np.zeros(0, np.int64)
        if not found:
            return none, none
        lists, weight = np.array(found, np.int64).T
        many = self.block[lists + 1] - self.block[lists]
        block, w = ranges(self.block[lists], many), np.repeat(weight, many)
        order = np.argsort(self.last[block], kind="stable")
        # interval i holds the documents from point i on; its bound is that of all blocks over it
        point = np.append(0, self.last[block][order] + 1)
        bound = np.cumsum(np.append((weight * self.top[self.block[lists]]).sum(), (w * self.change[block])[order]))
        full = np.flatnonzero(np.append(point[1:] > point[:-1], False))
        point, bound = np.append(point[full], point[-1]), bound[full]
        lo, hi = np.searchsorted(point, self.since[block], "right") - 1, np.searchsorted(point, self.last[block], "right")
        queue = np.argsort(-bound, kind="stable")
        threshold, take, at = 1, k, 0
        docs, scores = none, none
        while at < len(queue) and bound[queue[at]] >= threshold:
            some = queue[at : at + take]
            some = some[bound[some] >= threshold]
            at, take = at + len(some), take * 4
            chosen = np.zeros(len(bound) + 1, np.int64)
            chosen[some] = 1
            upto = np.append(0, np.cumsum(chosen))
            use = np.flatnonzero(upto[hi] > upto[lo])
            b = block[use]
            posting = ranges(self.begin[b], self.size[b])
            owner = np.repeat(use, self.size[b])
            doc = self.docs[posting]
            inside = chosen[np.searchsorted(point, doc, "right") - 1] > 0
            posting, owner, doc = posting[inside], owner[inside], doc[inside]
            held, slot = np.unique(doc, return_inverse=True)
            high = np.zeros(len(held), np.int64)
            np.add.at(high, slot, w[owner] * self.top[block[owner]])
            pivot = high >= threshold
            stay = pivot[slot]
            posting, owner, slot = posting[stay], owner[stay], slot[stay]
            score = np.zeros(len(held), np.int64)
            np.add.at(score, slot, w[owner] * impacts(self.tfs[posting], self.sizes[self.docs[posting]], self.n_docs, self.total))
            pivot &= score >= threshold
            docs, scores = np.append(docs, held[pivot]), np.append(scores, score[pivot])
            best = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[best], scores[best]
            if len(scores) == k:
                threshold = int(scores[-1])
        return docs, scores


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each shard, of batches sorted by it and then by term."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        number = batch.column("shard").to_numpy()
        at = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        for lo, hi in zip(at.tolist(), np.append(at[1:], len(number)).tolist(), strict=True):
            if held and number[lo] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = number[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def search(index: Index, queries: DataFrame, k: int = 10, item: str = "item_id", text: str = "text") -> DataFrame:
    """item, rank (from 1), doc_id and score of each query's k best documents."""
    spark = queries.sparkSession
    kind = queries.schema[item].dataType.simpleString()
    queries = queries.select(F.col(item).alias("item"), F.col(text).cast("string").alias("text")).where("item is not null and text is not null")

    def split(batches):
        for batch in _arrays.slices(batches):
            words, count = terms(*flat(batch.column("text")))
            row = np.repeat(np.arange(len(count)), count)
            many = max(len(words.dictionary), 1)
            key = np.unique(row * many + words.indices.to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(key // many)), words.dictionary.take(pa.array(key % many)).cast(pa.binary())], ["item", "term"])

    asked = _shared.written(_arrays.run(queries, split, f"item {kind}, term binary").distinct(), "query-terms")
    wanted = _shared.written(asked.select("term").distinct(), "terms")
    small = wanted.count() <= BROADCAST
    rows = index.table.where("term is not null")
    lists = rows.join(F.broadcast(wanted) if small else wanted, "term", "left_semi")
    n = F.lit(2.0 * index.docs + 2)
    weights = lists.groupBy("term").agg(F.sum("n").alias("df")).select("term", F.floor(1000 * F.log(n / (2 * F.col("df") + 1))).cast("long").alias("w")).where("w > 0")
    weighted = asked.join(weights, "term").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("terms"))
    path = _shared.folder(spark, "queries")

    def lay(batches):
        i = TaskContext.get().partitionId()
        some = [b for b in batches if b.num_rows]
        if some:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_file(sink, some[0].schema) as f:
                for b in some:
                    f.write_batch(b)
            _shared.write(f"{path}/{i}.arrow", [sink.getvalue()])
            yield pa.RecordBatch.from_pydict({"file": [i]})

    files = (asked.select(F.approx_count_distinct("item").alias("n")).first()["n"] or 0) // QUERIES + 1
    laid = sorted(r["file"] for r in _arrays.run(weighted.repartition(files, "item"), lay, "file long").collect())  # a number a file
    docs, total = index.docs, index.total

    def find(batches):
        for table in _shards(batches):
            shard = Shard(table, docs, total)
            for i in laid:
                with pa.memory_map(_shared.fetched(f"{path}/{i}.arrow")) as source:
                    for batch in pa.ipc.open_file(source).read_all().to_batches():
                        row, doc, score = [], [], []
                        for j, query in enumerate(batch.column("terms").to_pylist()):
                            d, s = shard.best([(t["term"], t["w"]) for t in query], k)
                            row.append(np.full(len(d), j))
                            doc.append(d)
                            score.append(s)
                        at = np.concatenate(doc)
                        yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(np.concatenate(row))), pa.array(shard.ids[at], mask=shard.none[at]), pa.array(np.concatenate(score))], ["item", "doc_id", "score"])

    # each shard's documents come first: a null term is the least
    needed = index.table.where("term is null").unionByName(lists) if laid else index.table.limit(0)
    found = _shared.written(_arrays.run(needed.repartition("shard").sortWithinPartitions("shard", "term"), find, f"item {kind}, doc_id long, score long"), "found")
    _shared.remove(spark, path)
    _shared.drop(asked, wanted)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(F.col("item").alias(item), "rank", "doc_id", "score")


def forget(index: Index) -> None:
    """Remove the index."""
    _shared.drop(index.table)
