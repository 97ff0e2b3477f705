"""Track statistics of points (activity_id, seq, lng, lat, ele, t).

One shuffle by activity serves the windows and the aggregate; all of it stays in the JVM.
All parts of an activity count as one sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.geo import MAX_GAP, haversine
from wayfold.functions.props import fragment, round4

#: The longest pause that counts as moving (s), and the least climb or descent that counts (m).
PAUSE = 60
STEP = 2.0


def pairs(points: DataFrame) -> DataFrame:
    """Each point with the distance (m) and time (s) from the one before it."""
    w = Window.partitionBy("activity_id").orderBy("seq")
    before = {c: F.lag(c).over(w) for c in ("lng", "lat", "t")}
    return points.withColumns({f"{c}0": v for c, v in before.items()}).withColumns({"d": haversine(F.col("lng0"), F.col("lat0"), F.col("lng"), F.col("lat")), "dt": F.col("t") - F.col("t0")})


def climb(elevations: Column) -> Column:
    """Gain and loss of an array of elevations in order: a change counts when it reaches STEP from the last level that counted."""
    start = F.struct(F.element_at(elevations, 1).alias("level"), F.lit(0.0).alias("gain"), F.lit(0.0).alias("loss"))

    def fold(acc: Column, e: Column) -> Column:
        d = e - acc["level"]
        return F.struct(F.when(F.abs(d) >= STEP, e).otherwise(acc["level"]).alias("level"), (acc["gain"] + F.when(d >= STEP, d).otherwise(0.0)).alias("gain"), (acc["loss"] + F.when(d <= -STEP, -d).otherwise(0.0)).alias("loss"))

    return F.aggregate(elevations, start, fold)


def track_stats(points: DataFrame, elevation: bool = True) -> DataFrame:
    """total_distance (km), elapsed_time and moving_time (s), average_speed and max_speed (km/h), elevation_gain and elevation_loss, min_elevation and max_elevation of each activity; null where its points can't tell."""
    near = F.col("d") <= MAX_GAP
    moving = near & (F.col("dt") > 0) & (F.col("dt") <= PAUSE)
    timed = F.col("t").isNotNull()
    out = pairs(points).groupBy("activity_id").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.coalesce(F.sum(F.when(near, F.col("d"))), F.lit(0.0)).alias("metres"),
        F.max_by("t", F.when(timed, F.col("seq"))).alias("last_t"),
        F.min_by("t", F.when(timed, F.col("seq"))).alias("first_t"),
        F.coalesce(F.sum(F.when(moving, F.col("dt"))), F.lit(0)).alias("moving"),
        F.greatest(F.coalesce(F.max(F.when(moving, F.col("d") / F.col("dt"))), F.lit(0.0)), F.lit(0.0)).alias("fastest"),
        *([F.array_sort(F.collect_list(F.when(F.col("ele").isNotNull(), F.struct("seq", "ele")))).alias("levels")] if elevation else []),
    )
    some = F.col("n_points") >= 2
    clocked = some & F.col("first_t").isNotNull()
    columns = {
        "total_distance": F.when(some, F.col("metres") / 1000),
        "elapsed_time": F.when(clocked, F.col("last_t") - F.col("first_t")),
        "moving_time": F.when(clocked, F.col("moving")),
        "average_speed": F.when(clocked & (F.col("moving") > 0), F.col("metres") / F.col("moving") * 3.6),
        "max_speed": F.when(clocked, F.col("fastest") * 3.6),
    }
    if elevation:
        values = F.transform("levels", lambda x: x["ele"])
        enough = F.size("levels") >= 2
        fold = F.when(enough, climb(values))
        columns |= {"elevation_gain": fold["gain"], "elevation_loss": fold["loss"], "min_elevation": F.when(enough, F.array_min(values)), "max_elevation": F.when(enough, F.array_max(values))}
    return out.select("activity_id", *(v.alias(k) for k, v in columns.items()))


NAMES = ("total_distance", "elapsed_time", "moving_time", "average_speed", "max_speed", "elevation_gain", "elevation_loss", "min_elevation", "max_elevation")


def fragments(stats: DataFrame) -> Column:
    """The statistics as a map of JSON fragments: whole seconds, and decimals rounded to four places; absent ones are null."""
    kinds = dict(stats.dtypes)
    return F.create_map(*(x for n in NAMES for x in (F.lit(n), fragment(F.col(n) if kinds[n] == "bigint" else round4(F.col(n)), "number"))))
