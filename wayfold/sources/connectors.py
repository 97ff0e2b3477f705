"""Activities pushed or pulled from services: webhook JSON and an injectable client."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import props
from wayfold.sources.polyline import decoded

#: Properties of a webhook activity that are dropped, the renamed ones, those that are made anew, and those that are 0 where they are missing.
NOISY = ("laps", "segment_efforts", "splits_metric", "splits_standard", "photos", "highlighted_kudosers")
RENAMED = {"total_elevation_gain": "elevation_gain", "elev_low": "min_elevation", "elev_high": "max_elevation", "type": "activity_type"}
HANDLED = ("name", "map", "gear", "distance", "average_speed", "max_speed")
ABSENT = ("elevation_gain", "min_elevation", "max_elevation")


def unit_columns(distance: Column, average: Column, fastest: Column) -> dict[str, Column]:
    """Kilometres and km/h of metres and m/s."""
    return {"total_distance": distance / 1000, "average_speed": average * 3.6, "max_speed": fastest * 3.6}


def webhook_activities(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Activity detail JSON as path (strava:{id}), status, title, start_time, properties (fragments) and points; virtual ones and those without points are skipped. What isn't JSON, or lacks its id, name, type, start, line or one of distance and speeds, has failed."""
    v = F.try_parse_json(F.col(column))
    rows = bodies.select(v.alias("v"))
    get = lambda k, t: F.try_variant_get("v", props.path(k) if "." not in k else "$" + "".join(f"['{p}']" for p in k.split(".")), t)
    units = unit_columns(get("distance", "double"), get("average_speed", "double"), get("max_speed", "double"))
    name = lambda k: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in RENAMED.items() for x in kv)), k), k)
    rest = F.map_filter(F.coalesce(F.expr("cast(v as map<string, variant>)"), F.create_map().cast("map<string,variant>")), lambda k, x: ~k.isin(*NOISY, *HANDLED))
    fields = F.map_from_entries(F.transform(F.map_entries(rest), lambda e: F.struct(name(e["key"]).alias("key"), F.to_json(e["value"]).alias("value"))))
    own = F.create_map(
        *(x for k, c in units.items() for x in (F.lit(k), c.cast("string"))),
        F.lit("activity_gear"), props.fragment(get("gear.name", "string"), "string"),
        F.lit("gear_id"), props.fragment(get("gear.id", "string"), "string"),
    )
    own = F.map_filter(own, lambda _, x: x.isNotNull() & (x != ""))
    rows = rows.select(
        F.concat(F.lit("strava:"), get("id", "string")).alias("path"),
        get("name", "string").alias("title"),
        F.try_to_timestamp(get("start_date", "string")).alias("start_time"),
        F.coalesce(get("type", "string").startswith("Virtual"), F.lit(False)).alias("virtual"),
        props.merge(F.create_map(*(F.lit(x) for k in ABSENT for x in (k, "0.0"))), fields, own).alias("properties"),
        F.exists(F.array(get("name", "string"), get("type", "string"), get("map.polyline", "string"), *(get(k, "double").cast("string") for k in ("distance", "average_speed", "max_speed"))), lambda x: x.isNull()).alias("lacks"),
        get("map.polyline", "string").alias("line"),
    )
    rows = decoded(rows, "line", "q")
    points = F.transform(F.coalesce("q", F.array().cast("array<struct<lat:double,lng:double>>")), lambda p: F.struct(F.lit(0).alias("part"), p["lng"].alias("lng"), p["lat"].alias("lat"), F.lit(None).cast("double").alias("ele"), F.lit(None).cast("long").alias("t")))
    status = F.when(F.col("path").isNull() | F.col("start_time").isNull() | F.col("lacks"), "failed").when(F.col("virtual"), "skipped").when(F.size(points) < 1, "skipped").otherwise("imported")
    return rows.select("path", status.alias("status"), "title", "start_time", "properties", points.alias("points"))


def events(bodies: DataFrame, column: str = "body") -> DataFrame:
    """id of the activities that webhook events announce; other objects are ignored."""
    v = F.try_parse_json(F.col(column))
    return bodies.select(v.alias("v")).where(F.try_variant_get("v", "$.object_type", "string") == "activity").select(F.try_variant_get("v", "$.object_id", "long").alias("id"), F.try_variant_get("v", "$.aspect_type", "string").alias("aspect"))


def fetched(spark: SparkSession, client: Callable[[date], Iterable[tuple[str, bytes]]], known: DataFrame, today: date, lookback: int = 30, cutoff: date | None = None) -> DataFrame:
    """path and content of what a client lists since the later of today - lookback days and the cutoff, without known files. The client yields (name, content); the list of one pull is small and made on the driver."""
    since = today - timedelta(days=lookback)
    if cutoff is not None:
        since = max(since, cutoff)
    rows = {name: bytes(content) for name, content in client(since)}
    df = spark.createDataFrame(list(rows.items()), "path string, content binary")
    return df.join(known.select(F.col("file").alias("path")), "path", "left_anti")
