"""Interpolated modified Kneser-Ney model of word n-grams, counted in Spark and scored from memory-mapped arrays.

A text is a start mark, its words and an end mark. Of order 3 (the default), with a uniform
share for unknown words:

    p3(w|uv) = max(c(uvw) - D3(c), 0) / c(uv.) + g3(uv) p2(w|v)
    p2(w|v)  = max(a(vw) - D2(a), 0) / a(v.) + g2(v) p1(w)
    p1(w)    = max(n(w) - D1(n), 0) / n(.) + g1 / (V + 1)

c: counts; a(vw): distinct words seen before vw, or the count where v is the start mark, as
nothing stands before it; n(w): distinct words before w; a dot: the sum over what can stand
there; the three discounts D of each order come from its counts of counts; g: what they
free. A context that was never seen gives the next lower order, as does a text's first word
at order 3; of order 2, a is the count. So every p sums to 1 over the V words and one unknown.

Passes over the texts: word counts by word hash (a word's id is its rank); pair counts, key
u (V + 1) + v, by a hash of the pair, so a frequent word spreads over all tasks; triples by
the bucket of their first pair, which has their context's sums. Then what triples add to
their last pairs goes to these pairs' buckets, and what pairs add to words to the words'.
All tables are sorted arrays in the shared folder, which scoring tasks map and search.
Nothing of the corpus reaches the driver but sums per bucket.

Nulls: a null text is empty (one token, the end mark); a null id is kept. Repeated rows
count each time. Texts are counted a megabyte at a time, a longer one stands alone. With no
text to learn from all probabilities are uniform (1 / (V + 1) with V = 0). Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm import _arrays, _shared
from wayfold.llm._text import Index, U, constants, flat, mix, spread, sum_by, words

ORDER = 3
END = constants(2, 909)[0]

#: n-grams a map task holds before it sends them.
HELD = 2_000_000
#: Columns of words and of pairs that are a byte a key but for few.
OF_WORDS = ("total", "n1", "n2", "n3", "before")
OF_PAIRS = ("counts", "adjusted", "n1", "n2", "n3", "after")
#: Pairs (a power of 2) whose first followers are counted from one place.
GROUP = 5


def discounts(n: np.ndarray) -> tuple[float, float, float]:
    """Of counts 1, 2 and 3 or more, from n[0..3] keys with counts 1 to 4; 0 where there are none to tell."""
    n1, n2, n3, n4 = map(float, n)
    if not n1:
        return 0.0, 0.0, 0.0
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(min(max(x, 0.0), k) for x, k in zip(d, (1.0, 2.0, 3.0), strict=True))


def _tokens(batch: pa.RecordBatch):
    """Hash of each token of a batch (words, then an end mark, of each text) and each text's range of them."""
    w = words(*flat(batch.column("text")))
    n = len(w.first) - 1
    out = np.empty(len(w.hash) + n, U)
    out[np.arange(len(w.hash)) + w.text_of()] = w.hash
    first = w.first + np.arange(n + 1)
    out[first[1:] - 1] = END
    return out, first


def _before(x: np.ndarray, first: np.ndarray, start) -> np.ndarray:
    """The value at the token before each; start at the beginning of a text."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[first[:-1]] = start
    return out


def _counts_of(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _context_sums(counts: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Of each context (they begin at these places): the sum, and followers with count 1, 2 and 3 or more."""
    if not len(at):
        return [np.zeros(0, np.int64)] * 4
    return [np.add.reduceat(x.astype(np.int64), at) for x in (counts, counts == 1, counts == 2, counts >= 3)]


def _sent(found: Iterator[tuple], n: int) -> Iterator[pa.RecordBatch]:
    """Blobs of (buckets or None, keys) of batches, those alike counted together as long as HELD allows."""
    held, size = [], 0

    def out():
        keys = [k for _, k in held]
        if held[0][0] is None:
            return _arrays.rows(*_arrays.counted(np.concatenate(keys)), n)
        return _arrays.placed(np.concatenate([b for b, _ in held]), np.concatenate(keys), n)

    for item in found:
        held.append(item)
        size += len(item[1])
        if size > HELD:
            yield out()
            held, size = [], 0
    if held:
        yield out()


@dataclass
class Model:
    path: str
    bits: int
    order: int
    words: tuple
    pairs: tuple
    tokens: int
    vocabulary: int
    d: tuple[tuple[float, float, float], ...]
    start: tuple[int, int, int, int]
    sum1: int
    free1: float

    def stores(self) -> tuple[_arrays.Arrays, _arrays.Arrays]:
        return _arrays.arrays(f"{self.path}/words", self.bits, self.words, OF_WORDS), _arrays.arrays(f"{self.path}/pairs", self.bits, self.pairs, OF_PAIRS)


def _pair_keys(ids: np.ndarray, first: np.ndarray, v: int) -> np.ndarray:
    return _before(ids, first, U(v)) * U(v + 1) + ids


def fit(texts: DataFrame, text: str = "text", order: int = ORDER) -> Model:
    """The model of all rows of texts. Its files stay in the shared folder until forget(). order: 2 or 3."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = texts.sparkSession
    texts = texts.select(F.col(text).cast("string").alias("text"))
    n = _arrays.bits(texts)
    path = _shared.folder(spark, "kneser-ney")

    def count_words(batches):
        held, size = [], 0
        for batch in _arrays.slices(batches):
            held.append(_arrays.counted(_tokens(batch)[0]))
            size += len(held[-1][0])
            if size > HELD:
                yield _arrays.rows(*_arrays.merged(*zip(*held, strict=True)), n)
                held, size = [], 0
        if held:
            yield _arrays.rows(*_arrays.merged(*zip(*held, strict=True)), n)

    stats = _arrays.store(_arrays.run(texts, count_words, _arrays.BLOBS), f"{path}/words", n).collect()
    _shared.tidy(spark)
    sizes = tuple(sorted((r["bucket"], r["n"]) for r in stats))
    v, tokens = sum(r["n"] for r in stats), sum(r["total"] for r in stats)
    if v >= 1 << 32:
        raise ValueError("more than 2**32 distinct words")

    def ids(store: _arrays.Arrays, batch: pa.RecordBatch):
        h, first = _tokens(batch)
        known = _arrays.counted(h)[0]
        return store.find(known)[0][Index(known).find(h)[0]].astype(U), first

    def count_pairs(batches):
        store = _arrays.arrays(f"{path}/words", n, sizes)
        yield from _sent(((None, _pair_keys(*ids(store, batch), v)) for batch in _arrays.slices(batches)), n)

    pairs = _arrays.sizes(_arrays.store(_arrays.run(texts, count_pairs, _arrays.BLOBS), f"{path}/pairs", n, small=True))
    _shared.tidy(spark)
    own = (_triples(texts, ids, path, n, sizes, pairs, v),) if order == 3 else ()
    _shared.tidy(spark)
    d2, d1, start, one = _lower(spark, path, n, sizes, pairs, v, "adjusted" if order == 3 else "counts")
    free = (d1[0] * one[0] + d1[1] * one[1] + d1[2] * one[4]) / one[5] if one[5] else 1.0
    return Model(path, n, order, sizes, pairs, tokens, v, (d1, d2, *own), start, int(one[5]), float(free))


def _triples(texts: DataFrame, ids: Callable, path: str, n: int, sizes: tuple, pairs: tuple, v: int) -> tuple[float, float, float]:
    """Count triples, save them and their sums beside the pairs that are their contexts, and save what each pair counts for at order 2 ("adjusted"); returns their discounts.

    followers: the last words of each context's triples, in order, and their counts; begin and after: where those of each
    2**GROUP pairs begin, and each pair's after that; n1, n2 and n3: how many have count 1, 2, 3 or more. Their sum is the
    pair's own count, as a word follows it each time (the end mark is no context).
    """
    spark = texts.sparkSession

    def count(batches):
        store, pair_store = _arrays.arrays(f"{path}/words", n, sizes), _arrays.arrays(f"{path}/pairs", n, pairs, OF_PAIRS)

        def found():
            for batch in _arrays.slices(batches):
                w, first = ids(store, batch)
                key = _pair_keys(w, first, v)
                known = _arrays.counted(key)[0]
                at = spread(known)
                place = pair_store.find(known)[0][at.order[at.find(mix(key))[0]]] if len(key) else np.zeros(0, np.int64)
                context = _before(place, first, -1)
                some = context >= 0
                b = pair_store.bucket_of(context[some])
                yield b, (context[some] - pair_store.base[b]).astype(U) * U(v + 1) + w[some]

        yield from _sent(found(), n)

    def merge(batches):
        pair_store = _arrays.arrays(f"{path}/pairs", n, pairs, OF_PAIRS)
        for i, held in _arrays.by_bucket(batches):
            size = int(pair_store.sizes[i])
            if not size:
                continue
            k, c = _arrays.merged([_arrays.unpack_sorted(r["keys"]) for r in held], [_arrays.unpack(r["counts"], np.int64) for r in held])
            context, w = (k // U(v + 1)).astype(np.int64), k % U(v + 1)
            at = np.flatnonzero(np.diff(context, prepend=-1))
            columns = [np.zeros(size, np.int64) for _ in range(3)]
            for column, x in zip(columns, _context_sums(c, at)[1:], strict=True):
                column[context[at]] = x
            first = np.searchsorted(context, np.arange(size))
            begin = first[:: 1 << GROUP]
            _arrays.save(f"{path}/triples", i, followers=w.astype(np.uint32), begin=_arrays.narrow(begin))
            _arrays.save_small(f"{path}/triples", i, counts=c)
            _arrays.save_small(f"{path}/pairs", i, after=first - np.repeat(begin, 1 << GROUP)[:size], **dict(zip(("n1", "n2", "n3"), columns, strict=True)))
            yield pa.RecordBatch.from_pylist([{"bucket": -1 - i, "keys": None, "counts": None, "stats": _counts_of(c)}], schema=arrow)
            last = pair_store.column("keys", i)[context] % U(v + 1) * U(v + 1) + w
            blobs = _arrays.rows(*_arrays.counted(last), n)
            yield pa.RecordBatch.from_arrays([*blobs.columns, pa.nulls(blobs.num_rows, arrow.field("stats").type)], schema=arrow)

    def adjust(batches):
        pair_store = _arrays.arrays(f"{path}/pairs", n, pairs, OF_PAIRS)
        for i, held in _arrays.by_bucket(batches):
            if i < 0:
                yield pa.RecordBatch.from_pylist([{"stats": r["stats"]} for r in held], schema=pa.schema([arrow.field("stats")]))
            elif pair_store.sizes[i]:
                keys = pair_store.column("keys", i)
                out = np.where(keys // U(v + 1) == U(v), pair_store.column("counts", i).whole(), 0)
                for r in held:
                    out[np.searchsorted(keys, _arrays.unpack_sorted(r["keys"]))] += _arrays.unpack(r["counts"], np.int64)
                _arrays.save_small(f"{path}/pairs", i, adjusted=out)

    arrow = pa.schema([("bucket", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("stats", pa.list_(pa.int64()))])
    # every bucket gets a row, so that each is saved
    none = spark.range(0, 1 << n, 1, 1).select(F.col("id").alias("bucket"), *(F.lit(bytearray(_arrays.pack(np.zeros(0, np.int64)))).alias(c) for c in ("keys", "counts")))
    counted = _arrays.run(texts, count, _arrays.BLOBS).unionByName(none)
    merged = _arrays.run(counted.repartition(1 << n, "bucket").sortWithinPartitions("bucket"), merge, "bucket long, keys binary, counts binary, stats array<long>")
    merged = merged.unionByName(none.withColumn("stats", F.lit(None).cast("array<long>")))
    got = _arrays.run(merged.repartition(1 << n, "bucket").sortWithinPartitions("bucket"), adjust, "stats array<long>").collect()  # a row a bucket
    return discounts(np.sum([r["stats"] for r in got], axis=0)) if got else (0.0, 0.0, 0.0)


def _lower(spark, path: str, n: int, sizes: tuple, pairs: tuple, v: int, column: str) -> tuple:
    """Sums of pairs by first word (total, n1, n2, n3) and numbers of pairs by last word (before), saved beside the words; discounts of orders 2 and 1, the start mark's sums, and counts of before."""
    bounds = np.zeros(1 << n, np.int64)
    for i, size in sizes:
        bounds[i] = size
    bounds = np.concatenate([[0], np.cumsum(bounds)])

    def sums(batches):
        pair_store = _arrays.arrays(f"{path}/pairs", n, pairs, OF_PAIRS)
        for i in (x for batch in batches for x in batch.column("id").to_pylist()):
            if not pair_store.sizes[i]:
                continue
            keys, counts = pair_store.column("keys", i), pair_store.column(column, i).whole()
            u = (keys // U(v + 1)).astype(np.int64)
            at = np.flatnonzero(np.diff(u, prepend=-1))
            uniq, own = u[at], _context_sums(counts, at)
            w, c = _arrays.counted(keys % U(v + 1))
            start = [int(x[-1]) if len(uniq) and uniq[-1] == v else 0 for x in own]
            yield pa.RecordBatch.from_pylist([{"bucket": -1, "u": None, "n": None, "v": None, "c": None, "stats": [*_counts_of(counts), *start]}], schema=arrow)
            ua, wa = np.searchsorted(uniq, bounds), np.searchsorted(w.astype(np.int64), bounds)
            out = []
            for b in range(1 << n):
                a, z, p, q = ua[b], ua[b + 1], wa[b], wa[b + 1]
                if a < z or p < q:
                    out.append({"bucket": b, "u": _arrays.pack_sorted((uniq[a:z] - bounds[b]).astype(U)), "n": _arrays.pack(np.concatenate([x[a:z] for x in own])), "v": _arrays.pack_sorted(w[p:q] - U(bounds[b])), "c": _arrays.pack(c[p:q]), "stats": None})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    arrow = pa.schema([("bucket", pa.int64()), *((k, pa.binary()) for k in "unvc"), ("stats", pa.list_(pa.int64()))])
    shares = _shared.written(_arrays.run(spark.range(0, 1 << n, 1, 1 << n), sums, "bucket long, u binary, n binary, v binary, c binary, stats array<long>"), "kneser-ney-shares")
    stats = [r["stats"] for r in shares.where("bucket < 0").select("stats").collect()]
    two = np.sum(stats, axis=0) if stats else np.zeros(8, np.int64)

    def gather(batches):
        for i, held in _arrays.by_bucket(batches):
            size = int(bounds[i + 1] - bounds[i])
            total, n1, n2, n3, before = (np.zeros(size, np.int64) for _ in range(5))
            for r in held:
                u, x = _arrays.unpack_sorted(r["u"]).astype(np.int64), _arrays.unpack(r["n"], np.int64).reshape(4, -1)
                for to, k in zip((total, n1, n2, n3), x, strict=True):
                    to[u] += k
                before[_arrays.unpack_sorted(r["v"]).astype(np.int64)] += _arrays.unpack(r["c"], np.int64)
            _arrays.save_small(f"{path}/words", i, total=total, n1=n1, n2=n2, n3=n3, before=before)
            yield pa.RecordBatch.from_pylist([{"stats": [*_counts_of(before), int((before >= 3).sum()), int(before.sum())]}])

    got = _arrays.run(shares.where("bucket >= 0").repartition(1 << n, "bucket").sortWithinPartitions("bucket"), gather, "stats array<long>").collect()
    one = np.sum([r["stats"] for r in got], axis=0) if got else np.zeros(6, np.int64)
    _shared.drop(shares)
    return discounts(two[:4]), discounts(one[:4]), tuple(int(x) for x in two[4:]), one


def forget(spark, model: Model) -> None:
    """Remove the model's files; nothing lazy may still score by it."""
    _shared.remove(spark, model.path)


def _interpolated(count: np.ndarray, sums: list[np.ndarray], d: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """The probability at an order from the counts of n-grams, their contexts' sums (total, n1, n2, n3) and the order below; a context without any gives the order below."""
    total = np.maximum(sums[0], 1)
    p = np.maximum(count - d[np.minimum(count, 3)], 0) / total + (d[1] * sums[1] + d[2] * sums[2] + d[3] * sums[3]) / total * lower
    return np.where(sums[0] > 0, p, lower)


def _follower_counts(model: Model, store: _arrays.Arrays, context: np.ndarray, kinds: np.ndarray, w: np.ndarray) -> np.ndarray:
    """How often each word follows a context (a pair's place, -1 for none; kinds: its number of followers), found by halving its range of followers."""
    out = np.zeros(len(w), np.int64)
    order = np.flatnonzero((context >= 0) & (kinds > 0))
    order = order[np.argsort(context[order], kind="stable")]
    b = store.bucket_of(context[order])
    ends = np.searchsorted(b, np.arange((1 << model.bits) + 1))
    for i in np.flatnonzero(np.diff(ends)).tolist():
        at = order[ends[i] : ends[i + 1]]
        followers, begin = (_arrays.whole(f"{model.path}/triples", name, i, kind) for name, kind in (("followers", ("u4",)), ("begin", _arrays.WHOLE)))
        pair = context[at] - store.base[i]
        lo = begin[pair >> GROUP] + store.column("after", i)[pair]
        hi, x = lo + kinds[at], w[at]
        end = hi.copy()
        todo = np.arange(len(at))
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            right = followers[mid] < x[todo]
            lo[todo[right]] = mid[right] + 1
            hi[todo[~right]] = mid[~right]
            todo = todo[lo[todo] < hi[todo]]
        there = np.flatnonzero(lo < end)
        there = there[followers[lo[there]] == x[there]]
        out[at[there]] = _arrays.small(f"{model.path}/triples", "counts", i, len(followers))[lo[there]]
    return out


def score(model: Model, docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score (additive unigrams) and score (log10 probability) of every row."""
    docs = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    m = model
    d = [np.array([0.0, *x]) for x in m.d]
    even = 1.0 / (m.vocabulary + 1)

    def run(batches):
        store, pair_store = m.stores()
        for batch in _arrays.slices(batches):
            h, first = _tokens(batch)
            known = _arrays.counted(h)[0]
            at = Index(known).find(h)[0]
            place, count, total, n1, n2, n3, before = (x[at] for x in store.find(known, "counts", "total", "n1", "n2", "n3", "before"))
            base = np.log10((count + 0.1) / (m.tokens + 0.1 * (m.vocabulary + 1)))
            p = m.free1 * even + (np.maximum(before - d[0][np.minimum(before, 3)], 0) / m.sum1 if m.sum1 else 0.0)
            prev = _before(place, first, m.vocabulary)
            seen = np.flatnonzero((place >= 0) & (prev >= 0))
            key = prev[seen].astype(U) * U(m.vocabulary + 1) + place[seen].astype(U)
            pairs = _arrays.counted(key)[0]
            at = spread(pairs)
            at = at.order[at.find(mix(key))[0]] if len(key) else np.zeros(0, np.int64)

            def full(x, absent=0):
                out = np.full(len(h), absent, np.int64)  # noqa: B023
                out[seen] = x[at]  # noqa: B023
                return out

            names = ("adjusted", "counts", "n1", "n2", "n3") if m.order == 3 else ("counts",)
            pair, number, *rest = (full(x, -1 if k == 0 else 0) for k, x in enumerate(pair_store.find(pairs, *names)))
            p = _interpolated(number, [_before(x, first, s) for x, s in zip((total, n1, n2, n3), m.start, strict=True)], d[1], p)
            if m.order == 3:
                sums = [_before(x, first, 0) for x in rest]
                number = _follower_counts(m, pair_store, np.where(place >= 0, _before(pair, first, -1), -1), sums[1] + sums[2] + sums[3], place)
                p = _interpolated(number, sums, d[2], p)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.diff(first)), pa.array(sum_by(first, (count > 0).astype(np.int64))), pa.array(np.full(batch.num_rows, m.tokens)), pa.array(sum_by(first, base)), pa.array(sum_by(first, np.log10(p)))],
                ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    schema = f"id {docs.schema['id'].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _arrays.run(docs, run, schema).withColumnRenamed("id", id)
