"""Listing, counting and profiling activities (id, file, title, start_time, created_at, properties as VARIANT; JSON text is parsed once a row). Where they have hot, typed copies of some keys, scans skip by it."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import props
from wayfold.plans.filters import implied, parse, predicate


def matching(activities: DataFrame, filter: str | None = None, before: date | None = None, after: date | None = None) -> DataFrame:
    if not filter:
        return activities.where(predicate(F.lit(None), F.col("start_time"), None, before, after))
    if is_variant(activities):
        skip = implied(parse(filter), F.col("hot"), props.HOT) if "hot" in activities.columns else None
        some = activities if skip is None else activities.where(skip)
        return some.where(predicate(F.col("properties"), F.col("start_time"), filter, before, after))
    parsed = props.once(activities, "_v", props.variant(F.col("properties")))
    return parsed.where(predicate(F.col("_v"), F.col("start_time"), filter, before, after)).drop("_v")


def is_variant(activities: DataFrame) -> bool:
    return activities.schema["properties"].dataType.typeName() == "variant"


def count(activities: DataFrame, **conditions) -> int:
    return matching(activities, **conditions).count()


def listing(activities: DataFrame, tiles: DataFrame, **conditions) -> DataFrame:
    """file, title, start_time, created_at, properties (JSON) and tile_count, the oldest first. An activity without tiles counts one, as it always has."""
    n = tiles.groupBy("activity_id").agg(F.countDistinct("z", "x", "y").alias("n"))
    out = matching(activities, **conditions).join(n, F.col("id") == F.col("activity_id"), "left")
    order = F.coalesce(F.col("created_at").cast("string"), F.col("start_time").cast("string"), F.col("id").cast("string"))
    properties = F.to_json("properties").alias("properties") if is_variant(activities) else F.col("properties")
    return out.select("file", "title", "start_time", "created_at", properties, F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)).alias("tile_count"), order.alias("_o")).orderBy("_o", "file").drop("_o")


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON object a row, the properties nested."""
    return df.select(F.to_json(F.struct(*(F.try_parse_json("properties").alias("properties") if c == "properties" else F.col(c) for c in df.columns))).alias("value"))


def type_class(v: Column) -> Column:
    return props.kind(v)


def property_stats(activities: DataFrame, by: tuple[str, ...] = (), **conditions) -> DataFrame:
    """key, count (activities with a scalar there) and types (sorted) of every property, for each value of by."""
    v = F.col("properties") if is_variant(activities) else props.variant(F.col("properties"))
    rows = props.once(matching(activities, **conditions).select("id", *by, v.alias("p")), "v", F.col("p")).where(F.schema_of_variant("v").startswith("OBJECT"))
    each = rows.select("id", *by, F.explode(F.map_entries(F.expr("cast(v as map<string, variant>)"))).alias("e")).select("id", *by, F.col("e.key").alias("key"), props.kind(F.col("e.value")).alias("type"))
    return each.where(F.col("type").isin("string", "number", "bool")).groupBy(*by, "key").agg(F.countDistinct("id").alias("count"), F.array_sort(F.collect_set("type")).alias("types"))


def profile(activities: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """property_stats, and the number of activities at a null key: what profiles of tables that share no activity add up to."""
    n = activities.groupBy(*by).agg(F.lit(None).cast("string").alias("key"), F.count(F.lit(1)).alias("count"), F.array().cast("array<string>").alias("types"))
    return property_stats(activities, by).unionByName(n)


def merged_profiles(profiles: DataFrame) -> DataFrame:
    """The profile of all, from those of their parts."""
    return profiles.groupBy("key").agg(F.sum("count").alias("count"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))).alias("types"))


def enriched(properties: Column, more: Column) -> Column:
    """Property maps merged; what the metadata table says wins over what was computed."""
    return props.merge(properties, more)


def upserted(old: DataFrame, new: DataFrame, key: str = "file") -> DataFrame:
    """old with the rows of new in place of those with the same key (a row of new for each key, the last by created_at)."""
    newest = new.groupBy(key).agg(F.max_by(F.struct(*[c for c in new.columns if c != key]), F.struct("created_at", "id")).alias("r")).select(key, "r.*").select(*new.columns)
    return old.join(newest.select(key), key, "left_anti").select(*new.columns).unionByName(newest)
