"""Counts of 64-bit keys made in Spark and kept as sorted arrays that workers memory-map.

Map tasks count keys by batch and send, per bucket, one row of packed sorted keys
and counts; a bucket is a hash of the key, so a frequent key is one entry a batch
and buckets are even. One task merges a bucket and writes its arrays to the shared
folder. Memory: one bucket of one task; disk: a few bytes a distinct key and batch.
"""

from __future__ import annotations

import gc
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm import _pieces, _shared
from wayfold.llm._text import U, cut, flat, mix, release, resident

#: Bytes of text that a map function takes at a time.
SLICE = 1 << 20
#: Bytes of a worker's memory (mapped files too) from which it gives back what it can at the end of a task.
LARGE = 128 << 20


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches cut to about SLICE bytes of text; a longer text stands alone."""
    for batch in batches:
        if batch.num_rows:
            _, at = flat(batch.column(text))
            for lo, hi in cut(at, SLICE):
                yield batch.slice(lo, hi - lo)


def run(df: DataFrame, f: Callable, schema: str, keep: bool = False) -> DataFrame:
    """df.mapInArrow(f, schema); when a task ends, its worker closes its stores and gives all memory back, for it is kept for tasks of other stages. keep: but for the tables of pre-tokens, which the first task of another stage drops."""

    def task(batches):
        if not keep:
            _pieces.forget()
        try:
            yield from f(batches)
        finally:
            arrays.cache_clear()
            _shared.forget()
            if resident() > LARGE:  # else it costs a small task more than the task itself
                gc.collect()
                pa.default_memory_pool().release_unused()
                release()

    _shared.limit(df.sparkSession)
    return df.mapInArrow(task, schema)


#: Types of whole numbers in files, by name.
WHOLE = ("u1", "u2", "u4", "i8")


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 on in as few bytes as hold the largest."""
    top = int(x.max()) if len(x) else 0
    return x.astype(next((k for k, bits in (("u1", 8), ("u2", 16), ("u4", 32)) if top < 1 << bits), "i8"))


BLOBS = "bucket long, keys binary, counts binary"


#: Bytes of the input's files a bucket, and buckets at most, as a power of 2.
PER_BUCKET, MOST_BITS = 64 << 20, 16


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that a frame reads, as Spark's planner knows them; what has no files counts nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)


def bits(df: DataFrame) -> int:
    """2**bits buckets: as many as shuffle partitions, and as the input's bytes ask for, rounded up."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(df) // PER_BUCKET)
    return min(max(1, (n - 1).bit_length()), MOST_BITS)


def bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return (mix(keys ^ U(0x5BD1E995)) >> U(64 - n)).astype(np.uint16 if n <= 16 else np.uint32)


def pack(values: np.ndarray) -> bytes:
    """Byte planes, compressed: leading zero bytes cost nothing."""
    width = values.dtype.itemsize
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes, dtype) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], decompressed_size=n, codec="zstd", asbytes=True) if n else b""
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).reshape(-1).view(dtype)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=U(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, U), dtype=U)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each occurs."""
    s = np.sort(keys)
    if not len(s):
        return s, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return s[at], np.diff(np.append(at, len(s)))


def placed(b: np.ndarray, keys: np.ndarray, n: int) -> pa.RecordBatch:
    """Keys counted in given buckets, packed by bucket."""
    order = np.lexsort((keys, b))
    b, keys = b[order], keys[order]
    at = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (b[1:] != b[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return rows(keys[at], np.diff(np.append(at, len(keys))), n, b[at])


def rows(keys: np.ndarray, counts: np.ndarray, n: int, b: np.ndarray | None = None) -> pa.RecordBatch:
    """Distinct keys, sorted within each bucket, and their counts, packed by bucket (of the key's hash, if none are given)."""
    b = bucket(keys, n) if b is None else b
    order = np.argsort(b, kind="stable")
    ids, ks, cs = [], [], []
    for i, at in by_number(b, order):
        ids.append(i)
        ks.append(pack_sorted(keys[at]))
        cs.append(pack(counts[at].astype(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ks, pa.binary()), pa.array(cs, pa.binary())], ["bucket", "keys", "counts"])


def by_number(b: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The rows of each bucket that has any, in an order by bucket."""
    s = b[order]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1])[: len(s)])
    for lo, hi in zip(first.tolist(), np.append(first[1:], len(s))[: len(first)].tolist(), strict=True):
        yield int(s[lo]), order[lo:hi]


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    at = np.flatnonzero(np.append(True, k[1:] != k[:-1])[: len(k)])
    return k[at], np.add.reduceat(c, at) if len(k) else c


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each bucket, of batches sorted by it."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != now and held:
                yield now, held
                held = []
            now = row["bucket"]
            held.append(row)
    if held:
        yield now, held


def store(blobs: DataFrame, path: str, n: int, least: int = 1, then: Callable | None = None, schema: str = "bucket long, n long, total long", small: bool = False) -> DataFrame:
    """Merge each bucket, write the keys that occur least times or more with their counts (small: by save_small()) to path, and return a row of the number of keys and the sum of counts of each bucket (or what then(bucket, keys, counts) yields)."""

    def merge(batches):
        for i, held in by_bucket(batches):
            k, c = merged([unpack_sorted(r["keys"]) for r in held], [unpack(r["counts"], np.int64) for r in held])
            if least > 1:
                k, c = k[c >= least], c[c >= least]
            save(path, i, keys=k)
            save_small(path, i, counts=c) if small else save(path, i, counts=narrow(c))
            if then:
                yield from then(i, k, c)
            else:
                yield pa.RecordBatch.from_pylist([{"bucket": i, "n": len(k), "total": int(c.sum())}])

    return run(blobs.repartition(1 << n, "bucket").sortWithinPartitions("bucket"), merge, schema)


def save(path: str, i: int, **columns: np.ndarray) -> None:
    for name, x in columns.items():
        _shared.write(f"{path}/{name}-{i}.{x.dtype.str[1:]}", [memoryview(np.ascontiguousarray(x)).cast("B") if len(x) else b""])


class Small:
    """Whole numbers in a byte each, memory-mapped; 255 stands for those that a table of places and values has."""

    def __init__(self, low: np.ndarray, over: np.ndarray):
        self.low, (self.at, self.over) = low, over.reshape(2, -1)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        out = self.low[at].astype(np.int64)
        big = np.flatnonzero(out == 255)
        if len(big):
            out[big] = self.over[np.searchsorted(self.at, at[big])]
        return out

    def whole(self) -> np.ndarray:
        out = self.low.astype(np.int64)
        out[self.at] = self.over
        return out


def save_small(path: str, i: int, **columns: np.ndarray) -> None:
    """Whole numbers from 0 on of which few are 255 or more, to be read by small()."""
    for name, x in columns.items():
        at = np.flatnonzero(x >= 255)
        save(path, i, **{name: np.minimum(x, 255).astype(np.uint8), f"{name}_over": np.concatenate([at, x[at].astype(np.int64)])})


def small(path: str, name: str, i: int, n: int) -> Small:
    return Small(mapped(path, name, i, "u1", n), whole(path, f"{name}_over", i, ("i8",)))


def mapped(path: str, name: str, i: int, dtype: str, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype)
    return np.asarray(np.memmap(_shared.fetched(f"{path}/{name}-{i}.{dtype}"), dtype, "r", shape=(n,)))


def whole(path: str, name: str, i: int, dtypes: tuple[str, ...]) -> np.ndarray:
    """All of an array of one of these types, memory-mapped."""
    for d in dtypes:
        try:
            at = _shared.fetched(f"{path}/{name}-{i}.{d}")
            return mapped(path, name, i, d, os.path.getsize(at) // np.dtype(d).itemsize)
        except OSError:
            if d == dtypes[-1]:
                raise
    raise AssertionError


class Arrays:
    """The arrays of a store, memory-mapped bucket by bucket as they are needed. sizes: bucket -> number of keys; small: columns of save_small()."""

    def __init__(self, path: str, n: int, sizes: tuple[tuple[int, int], ...], small: tuple[str, ...] = ()):
        self.path, self.n, self.small = path, n, small
        self.sizes = np.zeros(1 << n, np.int64)
        for i, size in sizes:
            self.sizes[i] = size
        self.base = np.cumsum(self.sizes) - self.sizes
        self.open: dict[tuple[str, int], np.ndarray | Small] = {}

    def bucket_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base + self.sizes, place, "right")

    def column(self, name: str, i: int, dtypes: tuple[str, ...] | None = None) -> np.ndarray | Small:
        dtypes = dtypes or (("u8",) if name == "keys" else WHOLE)
        if (name, i) not in self.open and name in self.small:
            self.open[name, i] = small(self.path, name, i, int(self.sizes[i]))
        if (name, i) not in self.open:
            for d in dtypes:
                try:
                    self.open[name, i] = mapped(self.path, name, i, d, int(self.sizes[i]))
                    break
                except OSError:
                    if d == dtypes[-1]:
                        raise
        return self.open[name, i]

    def find(self, keys: np.ndarray, *columns: str) -> list[np.ndarray]:
        """Of each key (best sorted): its place in the whole store, -1 if absent, then the columns' values (0 if absent): logarithms in columns log..., else whole numbers."""
        columns = columns or ("counts",)
        place, values = np.full(len(keys), -1, np.int64), [np.zeros(len(keys), np.float64 if name.startswith("log") else np.int64) for name in columns]
        b = bucket(keys, self.n)
        for i, at in by_number(b, np.argsort(b, kind="stable")):
            if not self.sizes[i]:
                continue
            have = self.column("keys", i, ("u8",))
            pos = np.minimum(np.searchsorted(have, keys[at]), len(have) - 1)
            ok = have[pos] == keys[at]
            at, pos = at[ok], pos[ok]
            place[at] = self.base[i] + pos
            for value, name in zip(values, columns, strict=True):
                value[at] = self.column(name, i, ("f8",) if name.startswith("log") else None)[pos]
        return [place, *values]


@lru_cache(maxsize=4)
def arrays(path: str, n: int, sizes: tuple[tuple[int, int], ...], small: tuple[str, ...] = ()) -> Arrays:
    """A task's open store."""
    return Arrays(path, n, sizes, small)


def sizes(stats: DataFrame) -> tuple[tuple[int, int], ...]:
    """(bucket, number of keys) of each: at most 2**n rows."""
    return tuple((r["bucket"], r["n"]) for r in sorted(stats.select("bucket", "n").collect()))


__all__ = ["BLOBS", "Arrays", "F", "arrays", "bits", "bucket", "by_bucket", "counted", "merged", "pack", "pack_sorted", "rows", "save", "sizes", "store", "unpack", "unpack_sorted"]
