"""CSV metadata joined to activities by path."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import props
from wayfold.sources import files


def header(c: Column) -> Column:
    return F.lower(F.replace(c, F.lit(" "), F.lit("_")))


def fragment(cell: Column) -> Column:
    """A CSV cell as JSON text: itself if it is JSON, else a string."""
    return F.when(F.try_parse_json(cell).isNotNull(), F.to_json(F.try_parse_json(cell))).otherwise(props.fragment(cell, "string"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """path (of the file, below the CSV's folder) and more (its cells as JSON fragments, spaces kept, without blank ones) of each row; of rows with one path the last counts, rows without a filename are left out."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    rows = rows.toDF(*(c.lower().replace(" ", "_") for c in rows.columns)).withColumn("_line", F.monotonically_increasing_id())
    names = [c for c in rows.columns if c not in ("filename", "_line")]
    if "filename" not in rows.columns:
        raise ValueError("the metadata has no filename column")
    _, at, lead = files._system(path)  # as files.names() names what it lists
    base = posixpath.dirname(lead + at)
    cells = F.map_filter(F.create_map(*(x for c in names for x in (F.lit(c), F.when(F.trim(F.col(c)) != "", fragment(F.col(c)))))), lambda _, v: v.isNotNull()) if names else F.create_map().cast("map<string,string>")
    out = rows.where(F.trim("filename") != "").select(F.concat(F.lit(base + "/"), F.col("filename")).alias("path"), cells.alias("more"), "_line")
    return out.groupBy("path").agg(F.max_by("more", "_line").alias("more"))


def enrich(activities: DataFrame, metadata: DataFrame, on: str = "path") -> DataFrame:
    """Activities (properties: a map of JSON fragments) with the metadata's cells, which win. Spark broadcasts the metadata where its size allows."""
    return activities.join(metadata, on, "left").withColumn("properties", props.merge(F.col("properties"), F.col("more"))).drop("more")


def activity_id(more: Column) -> Column:
    """The activity id of the metadata, if it is a number or a string."""
    v = F.try_parse_json(F.element_at(more, "activity_id"))
    return F.when(props.kind(v).isin("number", "string"), props.as_text(v))
