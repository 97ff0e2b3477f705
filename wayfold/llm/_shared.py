"""Files in the folder that the driver and all executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import contextlib
import gc
import os
import tempfile
import time
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def base(spark: SparkSession) -> str:
    """The shared folder of this session. Where it is unset and Spark runs in this process alone, as in tests, a new local one is set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wayfold-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{base(spark)}/wayfold/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes of rows that Spark hands to a Python worker at a time, and how the session calls it.
BATCH = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def limit(spark: SparkSession) -> None:
    """Where the session doesn't say how many bytes go to Python at a time, BATCH do: a batch lies in the executor's memory outside the heap and in the worker's at once, and both keep room for the largest they met."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: it is computed once, and losing an executor loses none of it."""
    spark = df.sparkSession
    base(spark)
    path = folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop(*frames: DataFrame) -> None:
    """Remove tables that written() made and nothing reads any more."""
    for df in frames:
        remove(df.sparkSession, df.written_to)


def tidy(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of frames that are gone now, not whenever the driver happens to collect its garbage: between the passes of a job they are most of its disk."""
    for _ in range(3):  # frames go first, then what they held
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def _local(path: str) -> str | None:
    u = urlparse(path)
    return u.path if u.scheme in ("", "file") else None


def write(path: str, parts: list) -> None:
    """A whole file or none: a retried or doubled task replaces it by the same bytes."""
    if (here := _local(path)) is not None:
        os.makedirs(os.path.dirname(here), exist_ok=True)
        part = f"{here}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            for x in parts:
                f.write(x)
        os.replace(part, here)
        return
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(at), recursive=True)
    with store.open_output_stream(at) as f:
        for x in parts:
            f.write(x)


_FETCHED: dict[str, str] = {}


def fetched(path: str) -> str:
    """A local path of a shared file: itself where the folder is mounted, else a copy in the worker's own temporary folder."""
    if (here := _local(path)) is not None:
        return here
    if path not in _FETCHED:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(path)
        with store.open_input_stream(at) as f, tempfile.NamedTemporaryFile(delete=False) as out:
            while chunk := f.read(1 << 22):
                out.write(chunk)
        _FETCHED[path] = out.name
    return _FETCHED[path]


def forget() -> None:
    """Remove a worker's copies of shared files; open maps of them stay valid."""
    while _FETCHED:
        with contextlib.suppress(OSError):
            os.remove(_FETCHED.popitem()[1])


def clean(spark: SparkSession) -> None:
    """Remove all tables that these operators left in the shared folder; frames that read them can't be used any more."""
    remove(spark, f"{base(spark)}/wayfold")
