"""Which keys aren't known yet, without a join of all of them.

The known keys are put into a Bloom filter: tasks set bits in an array of their own, which are
put together by slice, and what reaches the driver is the filter, at most 2**MOST_BITS bits.
Tasks that hold new keys look them up in it. A key that isn't there is new for certain; only
the others, which are the known ones and about one in a hundred of the new, are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Known keys up to which a plain anti join does; bits a key, hashes a key, and bits at most (64 MB).
FEW, PER_KEY, HASHES, MOST_BITS = 200_000, 10, 5, 29
#: Bytes of a slice of the filter.
SLICE = 1 << 16


def _places(one: np.ndarray, two: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The bits of keys, from two hashes."""
    one, two = one.view(np.uint64), two.view(np.uint64) | np.uint64(1)
    for k in range(HASHES):
        yield (one + two * np.uint64(k)) >> np.uint64(64 - bits)


def _hashed(df: DataFrame, key: str) -> DataFrame:
    return df.withColumns({"_one": F.xxhash64(key), "_two": F.xxhash64(F.lit(7), key)})


def bloom(known: DataFrame, key: str, n: int) -> tuple[bytes, int]:
    """A filter of n known keys, and the number of its bits as a power of 2."""
    bits = min(max((n * PER_KEY).bit_length(), 10), MOST_BITS)
    width = min(SLICE, (1 << bits) >> 3)

    def fill(batches):
        own = np.zeros(1 << bits, bool) if bits <= 20 else None
        held = [] if own is None else None
        for batch in batches:
            for at in _places(batch.column("_one").to_numpy(), batch.column("_two").to_numpy(), bits):
                if own is None:
                    held.append(np.unique(at))
                else:
                    own[at] = True
        places = np.flatnonzero(own) if own is not None else np.unique(np.concatenate(held)) if held else np.zeros(0, np.uint64)
        part = places.astype(np.int64) // (width * 8)
        for i in np.unique(part).tolist():
            bit = np.zeros(width * 8, np.uint8)
            bit[places[part == i].astype(np.int64) - i * width * 8] = 1
            yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int64()), "bits": pa.array([np.packbits(bit).tobytes()], pa.binary())})

    def either(table: pa.Table) -> pa.Table:
        bit = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in table.column("bits").to_pylist()])
        return pa.table({"slice": table.column("slice")[:1], "bits": pa.array([bit.tobytes()], pa.binary())})

    schema = "slice long, bits binary"
    out = np.zeros((1 << bits) >> 3, np.uint8)
    for r in _hashed(known.select(key), key).select("_one", "_two").mapInArrow(fill, schema).groupBy("slice").applyInArrow(either, schema).toLocalIterator():
        out[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes(), bits


def unknown(rows: DataFrame, known: DataFrame, key: str = "file", few: int = FEW) -> DataFrame:
    """The rows whose key isn't among the known ones; null keys are never known."""
    n = known.count()
    if n <= few:
        return rows.join(known.select(key), key, "left_anti").select(*rows.columns)
    data, bits = bloom(known, key, n)
    shared = rows.sparkSession.sparkContext.broadcast(data)

    def look(batches):
        bit = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            maybe = np.ones(batch.num_rows, bool)
            for at in _places(batch.column("_one").to_numpy(), batch.column("_two").to_numpy(), bits):
                at = at.astype(np.int64)
                maybe &= (bit[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names if c not in ("_one", "_two")), pa.array(maybe)], [*(c for c in names if c not in ("_one", "_two")), "_maybe"])

    from pyspark.sql.types import BooleanType, StructType

    schema = StructType(list(rows.schema.fields)).add("_maybe", BooleanType())
    judged = _hashed(rows, key).mapInArrow(look, schema)
    certain = judged.where("not _maybe").select(*rows.columns)
    return certain.unionByName(judged.where("_maybe").join(known.select(key), key, "left_anti").select(*rows.columns))
