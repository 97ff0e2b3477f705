"""Structured Streaming ingestion of a landing folder: each micro-batch is upserted, so a batch that runs again changes nothing.

Services deliver again what was not confirmed in time. What came within the last TTL with the
same name and content (a webhook: with the same content) is passed over by state keyed by
both, kept in the query's checkpoint, so it doesn't reach the store. Time is that of arrival,
so nothing is ever too late.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayfold.sources import pull


def files_in(engine, folder: str) -> DataFrame:
    """A stream of path and content of the files that arrive."""
    raw = engine.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(folder)
    return raw.select(F.regexp_replace("path", r"^file:/+", "/").alias("path"), "content")


#: How long a delivery is remembered.
TTL = "7 days"


def first_deliveries(arrived: DataFrame, keys: list[str], ttl: str = TTL) -> DataFrame:
    """A stream without rows whose keys came within ttl before."""
    timed = arrived.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", ttl)
    return timed.dropDuplicatesWithinWatermark(keys).drop("_arrived")


def _batches(rows: DataFrame, write, checkpoint: str, available_now: bool) -> StreamingQuery:
    """A query that hands each batch with rows to write()."""

    def upsert(batch: DataFrame, _: int) -> None:
        batch = batch.persist()  # state is read and changed once a batch
        try:
            if not batch.isEmpty():
                write(batch)
        finally:
            batch.unpersist()

    out = rows.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def ingest(engine, folder: str, checkpoint: str, available_now: bool = True, ttl: str = TTL) -> StreamingQuery:
    """Upsert arriving activity files as upload:{name}; available_now: what is there, then stop."""
    new = files_in(engine, folder).withColumns({"name": F.element_at(F.split("path", "/"), -1), "digest": F.sha2("content", 256)})
    return _batches(first_deliveries(new, ["name", "digest"], ttl), lambda batch: engine.upload(batch.select("path", "content")), checkpoint, available_now)


def ingest_pulled(engine, client, since: date, checkpoint: str, lookback: int = 0, until: date | None = None) -> StreamingQuery:
    """Import what a client of a day (see wayfold.sources.pull) lists, from since on; a day and the lookback before it are asked again whenever a new day begins, files that are known are passed over. until: the day to stop before, else today is the last."""
    engine.spark.dataSource.register(pull.source(client))
    options = {"since": since.isoformat(), "lookback": str(lookback)} | ({"until": until.isoformat()} if until else {})
    if cutoff := engine.store.config().cutoff():
        options["cutoff"] = cutoff.isoformat()
    rows = engine.spark.readStream.format(pull.NAME).options(**options).load()

    def upsert(batch: DataFrame, _: int) -> None:
        engine._pulled(batch)

    return rows.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).start()


def ingest_webhooks(engine, folder: str, checkpoint: str, available_now: bool = True, ttl: str = TTL) -> StreamingQuery:
    """Upsert activity details that land as one JSON document a file."""
    bodies = engine.spark.readStream.format("text").option("wholetext", True).load(folder).select(F.col("value").alias("body"), F.sha2("value", 256).alias("digest"))
    return _batches(first_deliveries(bodies, ["digest"], ttl), lambda batch: engine.webhook(batch.select("body")), checkpoint, available_now)
