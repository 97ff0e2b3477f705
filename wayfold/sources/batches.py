"""Arrow batches in tasks, a bounded piece at a time: what Python makes of a row takes many times its bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of rows that Spark hands to a Python worker at a time where the session doesn't say, and how the session calls it.
BATCH = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes that are made Python objects at a time, and those that an item of an array counts.
PIECE, ITEM = 1 << 18, 32


def limit(spark: SparkSession) -> None:
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH)


def pieces(batches: Iterable[pa.RecordBatch], *columns: str, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of batches that hold about size bytes in columns (text, binary or arrays) and a last row of any size."""
    for batch in batches:
        held = np.zeros(batch.num_rows, np.int64)
        for name in columns:
            c = batch.column(name)
            many, each = (pc.list_value_length(c), ITEM) if pa.types.is_list(c.type) or pa.types.is_large_list(c.type) else (pc.binary_length(c), 1)
            held += pc.fill_null(many, 0).to_numpy(zero_copy_only=False).astype(np.int64) * each
        at = (np.cumsum(held) - held) // size
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))[: batch.num_rows]
        for lo, hi in zip(first.tolist(), np.append(first[1:], batch.num_rows).tolist()):
            yield batch.slice(lo, hi - lo)
