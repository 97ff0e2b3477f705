"""Token ids of whole texts in compressed files, in ascending order of the documents' ids.

Rows are dealt to files by ranges of the id (rows of one id by a hash of their text), as many
as keep the texts of each to FILE bytes, however large the input is; each task sorts its range, encodes its texts, appends the end id to each and writes one file:

    "WFID2\\n", coded blocks, footer, footer length (8 bytes), crc32 of the footer (4), "WFID2\\n"

A block (see id_coder) is decoded alone; the footer, an Arrow batch of one row, has the end
and crc32 of each block, the chances that each LANES blocks are coded by, the documents' ids
and their numbers of ids. A file is written whole or not at all, and a retried task writes the
same name. Reading goes through Spark's own readers, checks every sum and gives back each
document's ids and its start, the number of ids of all documents before it; of the files only
their totals reach the driver.

Nulls: a null text is empty (only the end id); a null id comes first. Repeated rows are
stored each. An empty table gives no file. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import _arrays, _shared, id_coder
from wayfold.llm._pieces import coder

MARK = b"WFID2\n"
#: Bytes of texts in a file, on average at most: files are held whole by their tasks.
FILE = 128 << 20


def _file(docs: list, tokens: np.ndarray, blocks: list[bytes], width: int, chances: list[bytes]) -> list[bytes]:
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array([docs], pa.list_(pa.int64())),
            pa.array([tokens.tolist()], pa.list_(pa.int64())),
            pa.array([np.cumsum([len(b) for b in blocks], dtype=np.int64).tolist()], pa.list_(pa.int64())),
            pa.array([[zlib.crc32(b) for b in blocks]], pa.list_(pa.uint32())),
            pa.array([width], pa.int64()),
            pa.array([chances], pa.list_(pa.binary())),
        ],
        ["docs", "tokens", "ends", "sums", "width", "chances"],
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as f:
        f.write_batch(batch)
    footer = sink.getvalue().to_pybytes()
    return [MARK, *blocks, footer, len(footer).to_bytes(8, "little"), zlib.crc32(footer).to_bytes(4, "little"), MARK]


def parse(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, their numbers of ids and all ids of a file; ValueError says what is damaged."""
    tail = len(data) - len(MARK)
    if data[: len(MARK)] != MARK or data[tail:] != MARK or tail < 12:
        raise ValueError("not a whole file of ids")
    size = int.from_bytes(data[tail - 12 : tail - 4], "little")
    footer = data[tail - 12 - size : tail - 12]
    if size > tail - 12 or zlib.crc32(footer) != int.from_bytes(data[tail - 4 : tail], "little"):
        raise ValueError("the footer is damaged")
    with pa.ipc.open_stream(footer) as f:
        row = f.read_next_batch()
    docs, tokens, ends, sums = (row.column(i)[0].values for i in range(4))
    tokens, ends = tokens.to_numpy().astype(np.int64), ends.to_numpy().astype(np.int64)
    body = memoryview(data)[len(MARK) : tail - 12 - size]
    begin = 0
    for i, (end, s) in enumerate(zip(ends.tolist(), sums.to_pylist(), strict=True)):
        if zlib.crc32(body[begin:end]) != s:
            raise ValueError(f"block {i} is damaged")
        begin = end
    ids = id_coder.decode(np.frombuffer(body, np.uint8), ends, int(tokens.sum()), row.column(4)[0].as_py(), row.column(5)[0].as_py())
    return docs.to_pylist(), tokens, ids


def write_ids(docs: DataFrame, path: str, tokenizer: str, end: int = 0, rule: str = "byte", id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all rows to files in the folder path and return file, n_docs and n_ids of each. tokenizer, rule: see _pieces.Coder."""
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE))

    def write(batches):
        with coder(tokenizer, rule, keep=True) as c:
            yield from write_by(c, batches)

    def write_by(c, batches):
        width = id_coder.nibbles(max(c.tokenizer.get_vocab_size(), end))
        part = TaskContext.get().partitionId()
        names, tokens, blocks, chances, held, size = [], [], [], [], [], 0
        whole = id_coder.BLOCK * id_coder.LANES

        for batch in _arrays.slices(batches):
            ids, first = c.encode(batch.column("text"))
            rows = batch.num_rows
            out = np.full(len(ids) + rows, end, np.uint32)
            out[np.arange(len(ids)) + np.repeat(np.arange(rows), np.diff(first))] = ids
            names += batch.column("id").to_pylist()
            tokens.append(np.diff(first) + 1)
            held.append(out)
            size += len(out)
            if size >= whole:
                every = np.concatenate(held)
                blocks += id_coder.encode(every[:whole], width, chances)
                held, size = [every[whole:]], size - whole
        blocks += id_coder.encode(np.concatenate(held) if held else np.zeros(0, np.uint32), width, chances)
        n = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
        _shared.write(f"{path}/ids-{part:06d}.wfid", _file(names, n, blocks, width, chances))
        yield pa.RecordBatch.from_pylist([{"file": part, "n_docs": len(names), "n_ids": int(n.sum())}])

    dealt = docs.repartitionByRange(files, F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))
    return _arrays.run(dealt, write, "file long, n_docs long, n_ids long", keep=True)


def read_ids(spark: SparkSession, path: str, totals: list[tuple[int, int]], id: str = "doc_id") -> DataFrame:
    """id, start, n_tokens and ids (binary, little-endian unsigned 32-bit) of every document in the folder. totals: file and number of ids of each file."""
    if not totals:
        return spark.createDataFrame([], f"{id} long, start long, n_tokens long, ids binary")
    totals = sorted(totals)
    before = dict(zip((f for f, _ in totals), np.cumsum([0, *(n for _, n in totals)]).tolist(), strict=False))

    def read(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                docs, tokens, ids = parse(content.as_py())
                ends = np.cumsum(tokens)
                begin = before[int(re.search(r"ids-(\d+)\.wfid", name)[1])]
                for lo in range(0, len(docs), 128):
                    hi = min(len(docs), lo + 128)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs[lo:hi], pa.int64()), pa.array(begin + ends[lo:hi] - tokens[lo:hi]), pa.array(tokens[lo:hi]), pa.array([ids[e - n : e].astype("<u4").tobytes() for e, n in zip(ends[lo:hi].tolist(), tokens[lo:hi].tolist(), strict=True)], pa.binary())],
                        [id, "start", "n_tokens", "ids"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "ids-*.wfid").load(path)
    return _arrays.run(files.select("path", "content"), read, f"{id} long, start long, n_tokens long, ids binary")
