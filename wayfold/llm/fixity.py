"""Merkle fixity audit of archive files (WARC records) across replicas.

A file's records lie at ordered offsets. Leaves are the records' sha256; a node of level 1
covers RANGE bytes of offsets, one of level k + 1 FANOUT nodes of level k, and its hash is
the sha256 of "key:hash;" of what it covers, in order (n equal leaves: "key:hash*n;", counted
before they are gathered). A node has at most FANOUT children and a range a bounded number
of different records, so no aggregate gathers more, and all files grow
their trees in the same few aggregations. Replicas are compared root by root; only below
nodes that differ are the next level's nodes joined, down to the records.

Nulls: a record with a null file or offset can't be placed and is left out; a null hash is
a value of its own. Repeated rows are one leaf with their number. A file or record that one
side lacks is reported as missing there. Empty tables give no rows. Extra columns are kept
out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm import _shared

RANGE = 1 << 16
FANOUT = 16


def records(pages: DataFrame, per_file: int = 1000) -> DataFrame:
    """file, offset, length, page_id and sha256 of the WARC response record of each page; a file holds the pages of per_file ids in order of id."""
    from pyspark.sql import Window

    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    record = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(F.col("url").cast("string"), F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))
    rows = pages.where("page_id is not null").select(F.floor(F.col("page_id") / per_file).alias("file"), F.col("page_id").cast("long").alias("page_id"), F.sha2(record.cast("binary"), 256).alias("hash"), F.octet_length(record).cast("long").alias("length"))
    # the hashes travel, not the records
    before = Window.partitionBy("file").orderBy("page_id", "hash").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("file", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"), "length", "page_id", "hash")


def _named(hash_: F.Column, n: F.Column) -> F.Column:
    return F.concat(F.coalesce(hash_, F.lit("")), F.when(n > 1, F.concat(F.lit("*"), n.cast("string"))).otherwise(F.lit("")))


def _parents(level: DataFrame, key: F.Column) -> DataFrame:
    covered = F.array_sort(F.collect_list(F.struct("key", _named(F.col("hash"), F.col("n")).alias("hash"))))
    text = F.concat_ws("", F.transform(covered, lambda x: F.concat(x["key"].cast("string"), F.lit(":"), x["hash"], F.lit(";"))))
    return level.groupBy("file", key.alias("node")).agg(F.sha2(text, 256).alias("hash")).select("file", F.col("node").alias("key"), "hash", F.lit(1).cast("long").alias("n"))


def tree(leaves: DataFrame) -> list[DataFrame]:
    """Levels of all files' trees: 0 the records (key: offset), then the ranges, last the roots (key 0); each written to the shared folder."""
    leaves = leaves.where("file is not null and offset is not null").select("file", F.col("offset").alias("key"), "hash")
    leaves = _shared.written(leaves.groupBy("file", "key", "hash").agg(F.count(F.lit(1)).alias("n")), "merkle-0")
    levels, of = [leaves], F.floor(F.col("key") / RANGE)
    top = leaves.agg(F.max(of)).first()[0] or 0
    while True:
        levels.append(_shared.written(_parents(levels[-1], of), f"merkle-{len(levels)}"))
        if top == 0:
            return levels
        of, top = F.floor(F.col("key") / FANOUT), top // FANOUT


def audit(one: list[DataFrame], other: list[DataFrame]) -> DataFrame:
    """file, offset, hash and other_hash of the records that differ between two replicas' trees; null: the replica lacks it."""
    while len(one) < len(other):
        one = [*one, _shared.written(_parents(one[-1], F.floor(F.col("key") / FANOUT)), "merkle-top")]
    while len(other) < len(one):
        other = [*other, _shared.written(_parents(other[-1], F.floor(F.col("key") / FANOUT)), "merkle-top")]
    wrong = None
    for k in range(len(one) - 1, -1, -1):
        a, b = one[k], other[k]
        if wrong is not None:
            up = F.floor(F.col("key") / (RANGE if k == 0 else FANOUT))
            a, b = (x.withColumn("up", up).join(wrong, ["file", "up"], "left_semi").drop("up") for x in (a, b))
        # repeated records of one place are compared as one
        a, b = (x.groupBy("file", "key").agg(F.concat_ws(";", F.array_sort(F.collect_list(_named(F.col("hash"), F.col("n"))))).alias(h)) if k == 0 else x.withColumnRenamed("hash", h) for x, h in ((a, "hash"), (b, "other_hash")))
        found = a.join(b, ["file", "key"], "full").where("not hash <=> other_hash")
        if k == 0:
            return found.select("file", F.col("key").alias("offset"), "hash", "other_hash")
        wrong = _shared.written(found.select("file", F.col("key").alias("up")), "merkle-wrong")
    raise AssertionError
