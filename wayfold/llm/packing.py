"""Packing token ids into sequences: first-fit decreasing in random groups of documents.

A document is its ids and one end id. It is cut at multiples of the sequence length; whole
pieces are sequences of their own as they come, and the rest of each document (at most one
a document) is packed first-fit decreasing with the others of its group: a tournament tree
over the sequences' free room finds the first that fits in logarithmic time.

Groups are drawn by place in the input (task and row number), so neither a frequent id nor
a long text makes a large group; GROUP documents are expected in each. A group holds only
rests, GROUP * length ids or so; whole pieces stream through.

Nulls: a null text is empty (only the end id); a null id is kept. Repeated rows are packed
each. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm import _arrays
from wayfold.llm._pieces import coder
from wayfold.llm._text import U, mix

LENGTH = 4096
GROUP = 4096


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The bin of each size and its place there, and the number of bins; sizes are 1 to room. Equal sizes keep their order."""
    order = np.argsort(-sizes, kind="stable")
    leaves = 1 << max(1, (len(sizes) - 1).bit_length())
    tree = [room] * (2 * leaves)  # each node: the most room below it; unopened bins are empty
    bin_, at, used = [0] * len(sizes), [0] * len(sizes), 0
    size = sizes.tolist()
    for i in order.tolist():
        s, node = size[i], 1
        while node < leaves:
            node *= 2
            if tree[node] < s:
                node += 1
        bin_[i], at[i] = node - leaves, room - tree[node]
        used = max(used, node - leaves + 1)
        tree[node] -= s
        while node > 1:
            node //= 2
            best = tree[2 * node] if tree[2 * node] >= tree[2 * node + 1] else tree[2 * node + 1]
            if tree[node] == best:
                break
            tree[node] = best
    return np.array(bin_, np.int64), np.array(at, np.int64), used


def pack(docs: DataFrame, path: str, end: int, rule: str = "word", length: int = LENGTH, group: int = GROUP, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces: id, start (in the document), ids (binary, little-endian unsigned 32-bit), length, doc_tokens, sequence_id and offset (there).

    path: a tokenizers file whose pre-tokens follow rule (see _pieces.starts); end: the id after each document.
    """
    docs = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    groups = max(1, -(-docs.count() // group))
    schema = f"group long, id {docs.schema['id'].dataType.simpleString()}, start long, n long, doc_tokens long, ids binary"

    def cut(batches):
        with coder(path, rule) as c:
            yield from cut_by(c, batches)

    def cut_by(c, batches):
        width = np.uint16 if c.tokenizer.get_vocab_size() <= 1 << 16 and end < 1 << 16 else np.uint32
        seen = TaskContext.get().partitionId() << 40
        for batch in _arrays.slices(batches):
            ids, first = c.encode(batch.column("text"))
            rows = batch.num_rows
            out = np.empty(len(ids) + rows, width)
            out[np.arange(len(ids)) + np.repeat(np.arange(rows), np.diff(first))] = ids
            first = first + np.arange(rows + 1)
            out[first[1:] - 1] = end
            tokens = np.diff(first)
            mine = mix(np.arange(seen, seen + rows).astype(U)) % U(groups)
            seen += rows
            pieces = -(-tokens // length)
            row = np.repeat(np.arange(rows), pieces)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
            n = np.minimum(length, tokens[row] - start)
            raw, wide = memoryview(out).cast("B"), out.dtype.itemsize
            a, z = (first[:-1][row] + start) * wide, (first[:-1][row] + start + n) * wide
            yield pa.RecordBatch.from_arrays([pa.array(mine.astype(np.int64)[row]), batch.column("id").take(pa.array(row)), pa.array(start), pa.array(n), pa.array(tokens[row]), pa.array([raw[i:j] for i, j in zip(a.tolist(), z.tolist(), strict=True)], pa.binary())], schema=arrow)

    def place(batches):
        now, used, held = None, 0, []

        def ids(raw: list) -> pa.Array:
            return pa.array([np.frombuffer(x, np.uint16 if 2 * n == len(x) else np.uint32).astype("<u4").tobytes() for x, n in raw], pa.binary())

        def out(rows, seq, at):
            cols = [pa.concat_arrays([r.column(c) if isinstance(r.column(c), pa.Array) else r.column(c).combine_chunks() for r in rows]) for c in ("id", "start", "n", "doc_tokens", "ids")]
            for lo in range(0, len(seq), 256):
                part = [c.slice(lo, 256) for c in cols]
                yield pa.RecordBatch.from_arrays([part[0], part[1], ids(list(zip(part[4].to_pylist(), part[2].to_pylist(), strict=True))), part[2], part[3], pa.array((now << 32) + seq[lo : lo + 256]), pa.array(at[lo : lo + 256])], ["id", "start", "ids", "length", "doc_tokens", "sequence_id", "offset"])

        def rest():
            if held:
                sizes = np.concatenate([r.column("n").to_numpy() for r in held])
                bin_, at, _ = first_fit_decreasing(sizes, length)
                yield from out(held, bin_ + used, at)

        for batch in batches:
            g = batch.column("group").to_numpy()
            edges = np.append(np.flatnonzero(np.append(True, g[1:] != g[:-1])), len(g)) if len(g) else []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(lo, hi - lo)
                if g[lo] != now:
                    yield from rest()
                    now, used, held = int(g[lo]), 0, []
                whole = np.asarray(part.column("n").to_numpy() == length)
                if whole.any():
                    full = part.filter(pa.array(whole))
                    yield from out([full], used + np.arange(full.num_rows), np.zeros(full.num_rows, np.int64))
                    used += full.num_rows
                if not whole.all():
                    held.append(part.filter(pa.array(~whole)))
        yield from rest()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    cuts = _arrays.run(docs, cut, schema)
    kind = docs.schema["id"].dataType.simpleString()
    dealt = cuts.repartition("group").sortWithinPartitions("group", "id", "start")
    return _arrays.run(dealt, place, f"id {kind}, start long, ids binary, length long, doc_tokens long, sequence_id long, offset long").withColumnRenamed("id", id)
