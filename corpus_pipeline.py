"""The corpus pipeline: STAGES applied in turn to documents.

Each stage works on every row its predecessor kept; all but the last return the columns of
documents, extra ones too. A filtering stage drops the rows that the operator rejects. Rows
are told apart by 128 bits of hash of all their columns and of which are null, not by id: of
rows that repeat an id each has its own verdict, rows alike in every column share it, a null
id is no shelter.
Only near duplicates go by id, as their groups are made of ids: there a row with a null id
stays, and rows that repeat a kept id stay.

Null and empty texts have too few words and go in the first stage; texts of any length are
judged whole. Where a stage rejects every row, or there are none, the rest return none.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import _shared
from wayfold.llm.decontamination import decontaminate
from wayfold.llm.near_dedup import near_duplicates
from wayfold.llm.packing import pack
from wayfold.llm.quality_rules import quality
from wayfold.llm.toxicity import fit, score

#: Rejected keys that are broadcast at most (33 bytes each and a hash table: under 128 MB); more are joined by a shuffle.
BROADCAST = 1_000_000


def _key(docs: DataFrame) -> str:
    """A column name that docs doesn't have."""
    name = "_row_key"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def _keyed(docs: DataFrame, key: str) -> DataFrame:
    """docs with a key of the row's content: two 64-bit hashes, of all columns and of which are null (maps can't be hashed and don't count)."""
    columns = [F.col(f"`{f.name}`") for f in docs.schema if f.dataType.typeName() != "map"]
    every = [*columns, F.concat(*(F.when(c.isNull(), "0").otherwise("1") for c in columns))]
    return docs.withColumn(key, F.concat_ws("-", *(F.hex(F.xxhash64(F.lit(k), *every)) for k in (1, 2))))


def _without(docs: DataFrame, rejected: DataFrame, name: str, key: str = "doc_id", used: tuple[DataFrame, ...] = ()) -> DataFrame:
    """docs without the rows whose key was rejected. used: tables that only rejected reads, removed; the frame's attribute keys is the table that it reads."""
    keys = _shared.written(rejected.where(F.col(key).isNotNull()).select(key).distinct(), name)
    _shared.drop(*(df for df in used if hasattr(df, "written_to")))
    out = docs.join(F.broadcast(keys) if keys.count() <= BROADCAST else keys, key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    out.keys = keys
    return out


def _filtered(docs: DataFrame, judged: Callable[[DataFrame, str], DataFrame], condition: str, name: str) -> DataFrame:
    """docs without the rows for which judged(), given them with a key as id, says condition."""
    key = _key(docs)
    keyed = _keyed(docs, key)
    found = judged(keyed, key)
    out = _without(keyed, found.where(condition), name, key, (found,))
    rest = out.drop(key)
    rest.keys = out.keys
    return rest


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _filtered(docs, lambda d, key: quality(d, clean=True, id=key), "not kept", "rejected-quality")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where no document has a label there is nothing to judge by, and all rows stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    if docs.join(labels.where("toxic is not null"), "doc_id", "left_semi").isEmpty():
        return docs
    model = fit(docs, labels)
    return _filtered(docs, lambda d, key: score(d, model, id=key), "predicted = 1", "rejected-toxic")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words, similarity 0.8 or more; of each group the document with the least id stays."""
    found = near_duplicates(docs, part=80, whole=100, n=5)
    return _without(docs, found.where("not kept"), "rejected-copies", used=(found,))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _filtered(docs, lambda d, key: decontaminate(d, benchmark, id=key), "contaminated", "rejected-contaminated")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of op8 with their ids; the end id is 2."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), end=2).withColumn("ids_crc32", F.crc32("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: A learned model and perplexities decide: not expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. What a stage wrote goes when the next one has been written; what the frame returned reads stays."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            keys = getattr(out, "keys", None)
            out = _shared.written(out, f"stage-{name.replace(' ', '-')}")
            _shared.drop(*(df for df in (keys, last) if df is not None))
            last = out
        docs = out
    return docs
