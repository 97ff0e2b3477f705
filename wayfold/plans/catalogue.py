"""The registered queries over the test tables, and the same in DuckDB SQL.

events serve as tracks: a user is an activity, its events in order of time are the points.
Every query runs over its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import geo, props
from wayfold.operators import activities as acts
from wayfold.operators import masks, raster, stats, tiling
from wayfold.plans import gradients
from wayfold.plans.filters import predicate
from wayfold.sources import files, known, metadata

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Masks (name, lat, lng, metres) used by the mask queries.
MASKS = [("home", 52.51, 13.33, 700.0), ("work", 52.53, 13.38, 1500.0), ("far", 48.0, 2.0, 900.0)]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def points(spark: SparkSession, sf: str) -> DataFrame:
    """activity_id, part, seq, lng, lat, ele, t of the events."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("activity_id"),
        F.lit(0).alias("part"),
        F.row_number().over(w).cast("long").alias("seq"),
        (F.lit(13.3) + F.get_json_object("props", "$.k").cast("double") / 1000).alias("lng"),
        (F.lit(52.5) + F.col("value") / 10000).alias("lat"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("ele"),
        F.expr("unix_micros(ts) div 1000000000").alias("t"),
    )


C, R = repr(geo.CIRCLE), repr(geo.RADIUS)
HALF = repr(geo.HALF)
_POINTS = """points AS (SELECT user_id AS activity_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
  13.3::DOUBLE + CAST(json_extract_string(props, '$.k') AS DOUBLE) / 1000 AS lng, 52.5::DOUBLE + value / 10000 AS lat,
  CASE WHEN event_type <> 'error' THEN value END AS ele, epoch_us(ts) // 1000000000 AS t FROM events)"""
_METRES = f"2 * {geo.MEAN_RADIUS!r}::DOUBLE * asin(sqrt(least(pow(sin((radians(lat) - radians(lat0)) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lng - lng0) / 2), 2), 1.0)))"
_PAIRS = f"""{_POINTS},
lagged AS (SELECT *, lag(lng) OVER w AS lng0, lag(lat) OVER w AS lat0, t - lag(t) OVER w AS dt FROM points WINDOW w AS (PARTITION BY activity_id ORDER BY seq)),
pairs AS (SELECT *, {_METRES} AS d FROM lagged)"""
_STATS = f"""{_PAIRS},
sums AS (SELECT activity_id, count(*) AS n, coalesce(sum(d) FILTER (WHERE d <= 5000), 0.0) AS metres, max_by(t, seq) - min_by(t, seq) AS elapsed,
  CAST(coalesce(sum(dt) FILTER (WHERE d <= 5000 AND dt > 0 AND dt <= 60), 0) AS BIGINT) AS moving,
  coalesce(max(d / dt) FILTER (WHERE d <= 5000 AND dt > 0 AND dt <= 60), 0.0) AS fastest, count(ele) AS levels, min(ele) AS low, max(ele) AS high FROM pairs GROUP BY activity_id)"""
_MERCATOR = f"projected AS (SELECT *, {R}::DOUBLE * radians(lng) AS mx, {R}::DOUBLE * ln(tan(pi() / 4 + radians(lat) / 2)) AS my FROM points WHERE lat >= -89.99999 AND lat < 90)"


def _tile_sql(z: str) -> str:
    return f"CAST(greatest(floor(pow(2, {z}) / {C}::DOUBLE * (mx + {HALF}::DOUBLE)), 0) AS BIGINT) AS x, CAST(greatest(floor(pow(2, {z}) / {C}::DOUBLE * ({HALF}::DOUBLE - my)), 0) AS BIGINT) AS y"


def _r(name: str, digits: int = 4) -> Column:
    return F.round(F.col(name), digits).alias(name)


# --- track statistics


@query(f"WITH {_STATS} SELECT activity_id, round(metres / 1000, 4) AS total_distance, elapsed AS elapsed_time, moving AS moving_time, round(CASE WHEN moving > 0 THEN metres / moving * 3.6::DOUBLE END, 4) AS average_speed, round(fastest * 3.6::DOUBLE, 4) AS max_speed, CASE WHEN levels >= 2 THEN low END AS elevation_min, CASE WHEN levels >= 2 THEN high END AS elevation_max FROM sums")
def track_stats(spark, sf):
    s = stats.track_stats(points(spark, sf))
    return s.select("activity_id", _r("total_distance"), "elapsed_time", "moving_time", _r("average_speed"), _r("max_speed"), F.col("min_elevation").alias("elevation_min"), F.col("max_elevation").alias("elevation_max"))


@query(f"WITH {_STATS} SELECT activity_id, round(metres / 1000, 4) AS total_distance FROM sums")
def track_distance_km(spark, sf):
    return stats.track_stats(points(spark, sf), elevation=False).select("activity_id", _r("total_distance"))


@query(f"WITH {_STATS} SELECT activity_id, elapsed AS elapsed_time, moving AS moving_time FROM sums")
def moving_elapsed_time(spark, sf):
    return stats.track_stats(points(spark, sf), elevation=False).select("activity_id", "elapsed_time", "moving_time")


@query(f"WITH {_STATS} SELECT activity_id, round(CASE WHEN moving > 0 THEN metres / moving * 3.6::DOUBLE END, 4) AS average_speed, round(fastest * 3.6::DOUBLE, 4) AS max_speed FROM sums")
def max_avg_speed(spark, sf):
    return stats.track_stats(points(spark, sf), elevation=False).select("activity_id", _r("average_speed"), _r("max_speed"))


@query(
    f"""WITH RECURSIVE {_POINTS},
e AS (SELECT activity_id, ele, row_number() OVER (PARTITION BY activity_id ORDER BY seq) AS i FROM points WHERE ele IS NOT NULL),
fold AS (SELECT activity_id, i, ele AS level, 0.0::DOUBLE AS gain, 0.0::DOUBLE AS loss FROM e WHERE i = 1
  UNION ALL SELECT f.activity_id, e.i, CASE WHEN abs(e.ele - level) >= 2 THEN e.ele ELSE level END, gain + CASE WHEN e.ele - level >= 2 THEN e.ele - level ELSE 0 END, loss + CASE WHEN level - e.ele >= 2 THEN level - e.ele ELSE 0 END
  FROM fold f JOIN e ON e.activity_id = f.activity_id AND e.i = f.i + 1)
SELECT p.activity_id, round(max_by(gain, f.i) FILTER (WHERE f.i >= 2), 4) AS elevation_gain, round(max_by(loss, f.i) FILTER (WHERE f.i >= 2), 4) AS elevation_loss
FROM (SELECT DISTINCT activity_id FROM points) p LEFT JOIN fold f USING (activity_id) GROUP BY p.activity_id"""
)
def elevation_gain_loss(spark, sf):
    return stats.track_stats(points(spark, sf)).select("activity_id", _r("elevation_gain"), _r("elevation_loss"))


# --- projection and tiles


@query(f"WITH {_POINTS}, {_MERCATOR} SELECT activity_id, seq, round(mx, 3) AS mx, round(my, 3) AS my FROM projected")
def mercator_project(spark, sf):
    return tiling.projected(points(spark, sf)).select("activity_id", "seq", _r("mx", 3), _r("my", 3))


@query(f"WITH {_POINTS}, {_MERCATOR} SELECT activity_id, seq, CAST(z AS INT) AS z, {_tile_sql('z')} FROM projected, (SELECT unnest([2, 6, 10, 14, 16]) AS z)")
def tile_index(spark, sf):
    p = tiling.projected(points(spark, sf)).withColumn("z", F.explode(F.array(*map(F.lit, tiling.ZOOMS))))
    x, y = geo.tile(F.col("mx"), F.col("my"), F.col("z"))
    return p.select("activity_id", "seq", "z", x.alias("x"), y.alias("y"))


def _density(spark, sf, z: int) -> DataFrame:
    x, y = geo.tile(F.col("mx"), F.col("my"), z)
    return tiling.projected(points(spark, sf)).groupBy(x.alias("x"), y.alias("y")).agg(F.count(F.lit(1)).alias("visits"))


_D14 = f"{_POINTS}, {_MERCATOR}, density AS (SELECT x, y, count(*) AS visits FROM (SELECT {_tile_sql('14')} FROM projected) GROUP BY x, y)"


@query(f"WITH {_D14} SELECT x, y, visits FROM density")
def tile_density_z14(spark, sf):
    return _density(spark, sf, 14)


@query(f"WITH {_D14} SELECT x >> 4 AS x, y >> 4 AS y, count(*) AS tiles, CAST(sum(visits) AS BIGINT) AS visits FROM density GROUP BY 1, 2")
def tile_parent_rollup(spark, sf):
    return _density(spark, sf, 14).groupBy(F.shiftright("x", 4).alias("x"), F.shiftright("y", 4).alias("y")).agg(F.count(F.lit(1)).alias("tiles"), F.sum("visits").alias("visits"))


@query(f"WITH {_D14}, s AS (SELECT x, y, {C}::DOUBLE / pow(2, 14) AS size FROM density) SELECT x, y, round(x * size - {HALF}::DOUBLE, 3) AS box_left, round({HALF}::DOUBLE - (y + 1) * size, 3) AS box_bottom, round((x + 1) * size - {HALF}::DOUBLE, 3) AS box_right, round({HALF}::DOUBLE - y * size, 3) AS box_top FROM s")
def tile_bounds(spark, sf):
    box = geo.bounds(F.col("x"), F.col("y"), 14)
    return _density(spark, sf, 14).select("x", "y", *(F.round(b, 3).alias(f"box_{n}") for n, b in zip(("left", "bottom", "right", "top"), box)))


@query(f"WITH {_POINTS}, {_MERCATOR} SELECT activity_id, seq, round(pow(2, 10) * 2048 / {C}::DOUBLE * (mx + {HALF}::DOUBLE), 3) AS gx, round(pow(2, 10) * 2048 / {C}::DOUBLE * ({HALF}::DOUBLE - my), 3) AS gy FROM projected")
def global_pixels_z10(spark, sf):
    gx, gy = geo.global_pixel(F.col("mx"), F.col("my"), 10, 2048)
    return tiling.projected(points(spark, sf)).select("activity_id", "seq", F.round(gx, 3).alias("gx"), F.round(gy, 3).alias("gy"))


@query("SELECT o_orderkey, CASE WHEN w < -180 THEN w + 360 * ceil((-180 - w) / 360) ELSE w END AS lng FROM (SELECT o_orderkey, CAST(o_orderkey % 1500 - 900 AS DOUBLE) AS w FROM orders)")
def longitude_wrap(spark, sf):
    w = (F.col("o_orderkey") % 1500 - 900).cast("double")
    return table(spark, sf, "orders").select("o_orderkey", geo.wrap(w).alias("lng"))


# --- segments


_SEGMENTS = f"""{_POINTS}, {_MERCATOR},
led AS (SELECT activity_id, seq, mx, my, lead(mx) OVER w AS nx, lead(my) OVER w AS ny, lead(seq, 2) OVER w AS more FROM projected WINDOW w AS (PARTITION BY activity_id ORDER BY seq)),
segs AS (SELECT * FROM led WHERE more IS NOT NULL AND sqrt((nx - mx) * (nx - mx) + (ny - my) * (ny - my)) <= 5000)"""


@query(f"WITH {_SEGMENTS}, kept AS (SELECT activity_id, count(*) AS kept FROM segs GROUP BY activity_id) SELECT activity_id, count(*) AS n_points, coalesce(any_value(kept), 0) AS kept FROM points LEFT JOIN kept USING (activity_id) GROUP BY activity_id")
def segment_jump_filter(spark, sf):
    p = points(spark, sf)
    kept = tiling.joined(tiling.projected(p)).groupBy("activity_id").agg(F.count(F.lit(1)).alias("kept"))
    return p.groupBy("activity_id").agg(F.count(F.lit(1)).alias("n_points")).join(kept, "activity_id", "left").select("activity_id", "n_points", F.coalesce("kept", F.lit(0)).alias("kept"))


@query(
    f"""WITH {_POINTS}, {_MERCATOR},
far AS (SELECT *, sqrt(pow(mx - first_value(mx) OVER w, 2) + pow(my - first_value(my) OVER w, 2)) >= 2000 AS a, sqrt(pow(mx - last_value(mx) OVER w, 2) + pow(my - last_value(my) OVER w, 2)) >= 2000 AS b
  FROM projected WINDOW w AS (PARTITION BY activity_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
cut AS (SELECT activity_id, min(seq) FILTER (WHERE a) AS lo, max(seq) FILTER (WHERE b) AS hi FROM far GROUP BY activity_id)
SELECT f.activity_id, count(*) AS n, min(seq) AS lo, max(seq) AS hi FROM far f JOIN cut c ON c.activity_id = f.activity_id AND seq BETWEEN lo AND hi GROUP BY f.activity_id"""
)
def trim_track(spark, sf):
    kept = tiling.trimmed(tiling.projected(points(spark, sf)), 2000.0)
    return kept.groupBy("activity_id").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi"))


def _clip_sql(z: int, extent: int) -> str:
    half = lambda e: f"CAST(CASE WHEN {e} >= 0 THEN floor({e} + 0.5) ELSE ceil({e} - 0.5) END AS BIGINT)"
    px = lambda t: half(f"((mx + {t} * (nx - mx) - l) / (r - l) * {extent})")
    py = lambda t: f"{extent} - " + half(f"((my + {t} * (ny - my) - b) / (t_ - b) * {extent})")
    return f"""{_SEGMENTS},
ends AS (SELECT *, {_tile_sql(str(z)).replace(' AS x', ' AS ax').replace(' AS y', ' AS ay')}, {_tile_sql(str(z)).replace('mx', 'nx').replace('my', 'ny').replace(' AS x', ' AS bx').replace(' AS y', ' AS by_')} FROM segs),
tiled AS (SELECT *, ax AS x, ay AS y FROM ends UNION ALL SELECT *, bx, by_ FROM ends WHERE ax <> bx OR ay <> by_),
boxed AS (SELECT *, x * ({C}::DOUBLE / pow(2, {z})) - {HALF}::DOUBLE AS l, {HALF}::DOUBLE - (y + 1) * ({C}::DOUBLE / pow(2, {z})) AS b, (x + 1) * ({C}::DOUBLE / pow(2, {z})) - {HALF}::DOUBLE AS r, {HALF}::DOUBLE - y * ({C}::DOUBLE / pow(2, {z})) AS t_ FROM tiled),
clips AS (SELECT *, greatest(0.0, least((l - mx) / nullif(nx - mx, 0), (r - mx) / nullif(nx - mx, 0)), least((b - my) / nullif(ny - my, 0), (t_ - my) / nullif(ny - my, 0))) AS t0,
  least(1.0, greatest((l - mx) / nullif(nx - mx, 0), (r - mx) / nullif(nx - mx, 0)), greatest((b - my) / nullif(ny - my, 0), (t_ - my) / nullif(ny - my, 0))) AS t1 FROM boxed
  WHERE NOT (nx = mx AND (mx < l OR mx > r)) AND NOT (ny = my AND (my < b OR my > t_))),
clipped AS (SELECT activity_id, seq, x, y, {px('t0')} AS x0, {py('t0')} AS y0, {px('t1')} AS x1, {py('t1')} AS y1 FROM clips WHERE t0 <= t1)"""


@query(f"WITH {_clip_sql(14, 2048)} SELECT activity_id, seq, x, y, x0, y0, x1, y1 FROM clipped")
def segments_clipped_z14(spark, sf):
    return tiling.segments(points(spark, sf), 14).drop("part")


@query(f"WITH {_clip_sql(10, 2048)} SELECT activity_id, x, y, count(*) AS n FROM clipped GROUP BY ALL")
def tile_segments_z10(spark, sf):
    return tiling.segments(points(spark, sf), 10).groupBy("activity_id", "x", "y").agg(F.count(F.lit(1)).alias("n"))


# --- rasters


def _heat_sql(z: int, extent: int) -> str:
    return f"""{_clip_sql(z, extent)},
steps AS (SELECT *, greatest(abs(x1 - x0), abs(y1 - y0)) AS n FROM clipped),
pix AS (SELECT *, unnest(generate_series(0, n)) AS i FROM steps),
minor AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE (i * least(abs(x1 - x0), abs(y1 - y0))) // n END AS m, abs(y1 - y0) > abs(x1 - x0) AS steep FROM pix),
heat AS (SELECT x, y, x0 + (CASE WHEN x1 >= x0 THEN 1 ELSE -1 END) * (CASE WHEN steep THEN m ELSE i END) AS px, y0 + (CASE WHEN y1 >= y0 THEN 1 ELSE -1 END) * (CASE WHEN steep THEN i ELSE m END) AS py, least(count(*), 255) AS visits FROM minor GROUP BY ALL)"""


def _heat(spark, sf, z: int, extent: int) -> DataFrame:
    s = tiling.segments(points(spark, sf), z, extent)
    return raster.counted(raster.bresenham(s, ["x", "y"]), ["x", "y"])


@query(f"WITH {_heat_sql(14, 256)} SELECT x, y, px, py, visits FROM heat")
def heat_pixels_z14(spark, sf):
    return _heat(spark, sf, 14, 256)


@query(f"WITH {_heat_sql(6, 256)} SELECT x, y, px, py, visits FROM heat")
def heat_pixels_saturated(spark, sf):
    return _heat(spark, sf, 6, 256)


_MASK_SQL = "masks AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {lat}::DOUBLE, {lng}::DOUBLE, {r}::DOUBLE)" for n, lat, lng, r in MASKS) + f") AS m(name, mlat, mlng, radius)), centres AS (SELECT name, radius, {R}::DOUBLE * radians(mlng) AS cx, {R}::DOUBLE * ln(tan(pi() / 4 + radians(mlat) / 2)) AS cy FROM masks)"


def _masks(spark: SparkSession) -> DataFrame:
    return masks.centred(spark.createDataFrame(MASKS, "name string, lat double, lng double, radius double"))


@query(f"WITH {_POINTS}, {_MERCATOR}, {_MASK_SQL} SELECT activity_id, seq FROM projected p WHERE EXISTS (SELECT 1 FROM centres WHERE (mx - cx) * (mx - cx) + (my - cy) * (my - cy) <= radius * radius)")
def mask_vertices(spark, sf):
    return masks.covered(tiling.projected(points(spark, sf)), _masks(spark), ["activity_id", "seq"])


@query(f"WITH {_D14}, {_MASK_SQL}, box AS (SELECT x, y, x * ({C}::DOUBLE / pow(2, 14)) - {HALF}::DOUBLE AS l, {HALF}::DOUBLE - (y + 1) * ({C}::DOUBLE / pow(2, 14)) AS b, (x + 1) * ({C}::DOUBLE / pow(2, 14)) - {HALF}::DOUBLE AS r, {HALF}::DOUBLE - y * ({C}::DOUBLE / pow(2, 14)) AS t FROM density) SELECT x, y, name FROM box, centres WHERE pow(cx - greatest(l, least(cx, r)), 2) + pow(cy - greatest(b, least(cy, t)), 2) <= radius * radius")
def mask_tile_intersect(spark, sf):
    tiles = _density(spark, sf, 14).select("x", "y")
    return masks.touched(tiles, 14, _masks(spark))


def _lut_sql(name: str) -> str:
    at = gradients.stops(gradients.PALETTES[name])
    rows = ", ".join(f"({n}, {m}, {', '.join(map(str, (*a, *b)))})" for (n, a), (m, b) in zip(at, [*at[1:], (256, at[-1][1])]))
    ch = lambda i: f"CAST(floor(CASE WHEN hi = 256 THEN a{i} ELSE a{i}::FLOAT * (1::FLOAT - (v - lo)::FLOAT / (hi - lo)::FLOAT) + b{i}::FLOAT * ((v - lo)::FLOAT / (hi - lo)::FLOAT) END) AS INT)"
    text = " || ".join(f"printf('%02x', coalesce({ch(i)}, 0))" for i in range(4))
    cols = ", ".join([*(f"a{i}" for i in range(4)), *(f"b{i}" for i in range(4))])
    return f"lut AS (SELECT v AS visits, {text} AS rgba FROM (SELECT unnest(generate_series(0, 255)) AS v) LEFT JOIN (VALUES {rows}) AS s(lo, hi, {cols}) ON v >= lo AND v < hi)"


@query(f"WITH {_lut_sql('orange')} SELECT visits, rgba, count(*) AS activities FROM (SELECT least(count(*), 255) AS visits FROM events GROUP BY user_id) JOIN lut USING (visits) GROUP BY ALL")
def gradient_lut(spark, sf):
    """Activities by their number of points (at most 255) and its colour."""
    n = table(spark, sf, "events").groupBy("user_id").agg(F.least(F.count(F.lit(1)), F.lit(255)).alias("visits"))
    return n.join(F.broadcast(gradients.table(spark, "orange")), "visits").groupBy("visits", "rgba").agg(F.count(F.lit(1)).alias("activities"))


@query("WITH v AS (SELECT least(count(*), 255) AS visits FROM events GROUP BY user_id), " + ", ".join(_lut_sql(n).replace("lut AS", f"lut{i} AS", 1) for i, n in enumerate(gradients.PALETTES)) + " ".join(f"{' UNION ALL' if i else ''} SELECT '{n}' AS palette, rgba, count(*) AS activities FROM v JOIN lut{i} USING (visits) GROUP BY ALL" for i, n in enumerate(gradients.PALETTES)))
def palettes(spark, sf):
    """Activities by the colour that each palette gives their number of points."""
    n = table(spark, sf, "events").groupBy("user_id").agg(F.least(F.count(F.lit(1)), F.lit(255)).alias("visits"))
    rows = reduce(DataFrame.unionByName, (gradients.table(spark, p).withColumn("palette", F.lit(p)) for p in gradients.PALETTES))
    return n.join(F.broadcast(rows), "visits").groupBy("palette", "rgba").agg(F.count(F.lit(1)).alias("activities"))


@query(f"WITH {_heat_sql(10, 256)}, {_lut_sql('orange')} SELECT rgba, count(*) AS pixels FROM heat JOIN lut USING (visits) GROUP BY rgba")
def heat_colored(spark, sf):
    heat = _heat(spark, sf, 10, 256)
    return heat.withColumn("visits", F.col("visits").cast("long")).join(F.broadcast(gradients.table(spark, "orange")), "visits").groupBy("rgba").agg(F.count(F.lit(1)).alias("pixels"))


@query(f"WITH {_heat_sql(14, 256)}, o AS (SELECT min(x) AS ox, min(y) AS oy FROM heat) SELECT ((x - ox) * 256 + px) // 16 AS cx, ((y - oy) * 256 + py) // 16 AS cy, CAST(sum(visits) AS BIGINT) AS visits, count(*) AS pixels FROM heat, o GROUP BY 1, 2")
def viewport_mosaic(spark, sf):
    heat = _heat(spark, sf, 14, 256)
    origin = F.broadcast(_density_origin(tiling.segments(points(spark, sf), 14, 256)))  # one row; a tile has pixels where it has segments
    m = heat.join(origin)
    return m.groupBy(F.expr("((x - ox) * 256 + px) div 16").alias("cx"), F.expr("((y - oy) * 256 + py) div 16").alias("cy")).agg(F.sum("visits").alias("visits"), F.count(F.lit(1)).alias("pixels"))


def _density_origin(heat: DataFrame) -> DataFrame:
    return heat.agg(F.min("x").alias("ox"), F.min("y").alias("oy"))


# --- properties and filters: each event as an activity


def event_activities(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a table of activities, with properties as the store has them: VARIANT."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    p = F.struct(k.alias("k"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("type"), F.col("value"), F.when(k % 3 == 0, k % 2 == 0).alias("flag"), F.when(k % 5 == 0, F.array(k)).alias("list"))
    rows = e.select(F.col("event_id").alias("id"), F.concat(F.lit("upload:"), F.col("event_id").cast("string")).alias("file"), F.col("event_type").alias("title"), F.col("ts").cast("timestamp").alias("start_time"), F.lit(None).cast("timestamp").alias("created_at"), p.alias("p"))
    return props.once(rows, "properties", F.to_variant_object("p")).drop("p")


_EVENTS = "a AS (SELECT event_id AS id, ts, k, CASE WHEN event_type <> 'error' THEN event_type END AS type, value, CASE WHEN k % 3 = 0 THEN k % 2 = 0 END AS flag FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"


def _filter(name: str, text: str | None, sql: str, before=None, after=None) -> None:
    def run(spark, sf):
        return acts.matching(event_activities(spark, sf), filter=text, before=before, after=after).select("id")

    run.__name__ = name
    query(f"WITH {_EVENTS} SELECT id FROM a WHERE {sql}")(run)


def _dates():
    from datetime import date

    return date(2024, 1, 11), date(2024, 1, 4)


_filter("filter_eq", "type = click", "type = 'click'")
_filter("filter_neq_missing", "type != click", "type IS DISTINCT FROM 'click'")
_filter("filter_cmp_number", "value > 18.5 && k <= 40", "value > 18.5::DOUBLE AND k <= 40")
_filter("filter_cmp_cross_type", "type > 5 && k < '4'", "type IS NOT NULL")
_filter("filter_bool", "flag = true || flag < 1", "flag OR NOT flag")
_filter("filter_in", "k in [1, 2, 50, 'x'] || type in [purchase, signup]", "k IN (1, 2, 50) OR type IN ('purchase', 'signup')")
_filter("filter_like_ci", "type like 'P%' || type like '_LIC_'", "type ILIKE 'p%' OR type ILIKE '_lic_'")
_filter("filter_has", "has? flag && has? type", "flag IS NOT NULL AND type IS NOT NULL")
_filter("filter_and_or_not", "!(type = click) && k > 10 || value < 5", "(NOT (type = 'click') AND k > 10) OR value < 5")
_filter("filter_grouping", "(type = click || (type = purchase && !(k > 70))) && !(has? missing || flag = false)", "(type = 'click' OR (type = 'purchase' AND NOT k > 70)) AND NOT (false OR flag = false)")
_filter("filter_date_range", None, "ts < TIMESTAMP '2024-01-11' AND ts > TIMESTAMP '2024-01-04'", *_dates())


@query(f"WITH {_EVENTS} SELECT count(*) AS n FROM a WHERE k >= 50 AND ts > TIMESTAMP '2024-01-04'")
def activity_count(spark, sf):
    return acts.matching(event_activities(spark, sf), filter="k >= 50", after=_dates()[1]).agg(F.count(F.lit(1)).alias("n"))


def user_activities(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy("user_id").agg(F.min(F.col("ts").cast("timestamp")).alias("start_time"), F.count(F.lit(1)).alias("n"))
    return e.select(F.col("user_id").alias("id"), F.concat(F.lit("upload:"), F.col("user_id").cast("string")).alias("file"), F.lit(None).cast("string").alias("title"), "start_time", F.lit(None).cast("timestamp").alias("created_at"), F.to_json(F.struct("n")).alias("properties"))


@query(f"WITH {_POINTS}, {_MERCATOR}, tiles AS (SELECT DISTINCT activity_id, z, {_tile_sql('z')} FROM projected, (SELECT unnest([2, 6, 10, 14, 16]) AS z)), n AS (SELECT activity_id, count(*) AS n FROM tiles GROUP BY 1) SELECT 'upload:' || user_id AS file, epoch_us(min(ts)) // 1000 AS start_ms, greatest(coalesce(any_value(n.n), 0), 1) AS tile_count FROM events LEFT JOIN n ON n.activity_id = user_id GROUP BY user_id")
def activity_listing(spark, sf):
    out = acts.listing(user_activities(spark, sf), tile_index(spark, sf))
    return out.select("file", F.unix_millis("start_time").alias("start_ms"), "tile_count")


@query(f"WITH {_EVENTS}, e AS (SELECT id, 'k' AS key, 'number' AS type FROM a UNION ALL SELECT id, 'type', 'string' FROM a WHERE type IS NOT NULL UNION ALL SELECT id, 'value', 'number' FROM a UNION ALL SELECT id, 'flag', 'bool' FROM a WHERE flag IS NOT NULL) SELECT key, count(DISTINCT id) AS n, string_agg(DISTINCT type, ',') AS types FROM e GROUP BY key")
def property_stats(spark, sf):
    return acts.property_stats(event_activities(spark, sf)).select("key", F.col("count").alias("n"), F.array_join("types", ",").alias("types"))


# --- metadata, keys, upserts


@query("SELECT o_orderkey, '{\"distance\":' || o_custkey || CASE WHEN c_custkey IS NOT NULL THEN ',\"segment\":' || CAST(to_json(c_mktsegment) AS VARCHAR) ELSE '' END || ',\"type\":' || CAST(to_json(CASE WHEN c_custkey IS NOT NULL THEN c_name ELSE o_orderstatus END) AS VARCHAR) || '}' AS properties FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON c_custkey = o_custkey")
def metadata_left_join(spark, sf):
    o = table(spark, sf, "orders").withColumn("path", F.concat(F.lit("a/"), F.col("o_custkey").cast("string")))
    c = table(spark, sf, "customer").where("c_custkey % 2 = 0")
    source = c.select(F.concat(F.lit("a/"), F.col("c_custkey").cast("string")).alias("path"), F.create_map(F.lit("segment"), props.fragment(F.col("c_mktsegment"), "string"), F.lit("type"), props.fragment(F.col("c_name"), "string")).alias("more"))
    own = F.create_map(F.lit("distance"), F.col("o_custkey").cast("string"), F.lit("type"), props.fragment(F.col("o_orderstatus"), "string"))
    return metadata.enrich(o.withColumn("properties", own), source, "path").select("o_orderkey", props.object_text(F.col("properties")).alias("properties"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def dedupe_anti_join(spark, sf):
    """The import's own way of passing over what is known, by its filter."""
    seen = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return known.unknown(table(spark, sf, "orders").select("o_orderkey"), seen, "o_orderkey", few=100)


@query("WITH old AS (SELECT c_custkey AS id, c_name AS file, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 0), new AS (SELECT c_custkey + 1000000 AS id, c_name AS file, -c_acctbal AS v FROM customer WHERE c_custkey % 2 = 0) SELECT id, file, v FROM new UNION ALL SELECT id, file, v FROM old WHERE file NOT IN (SELECT file FROM new)")
def upsert_by_key(spark, sf):
    c = table(spark, sf, "customer")
    row = lambda shift, sign: [(F.col("c_custkey") + shift).alias("id"), F.col("c_name").alias("file"), (F.col("c_acctbal") * sign).alias("v"), F.lit(None).cast("timestamp").alias("created_at")]
    return acts.upserted(c.where("c_custkey % 3 != 0").select(*row(0, 1)), c.where("c_custkey % 2 = 0").select(*row(1000000, -1))).drop("created_at")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'strava:' || p_partkey ELSE 'rides/' || replace(lower(p_name), ' ', '_') || '.gpx' END AS key FROM part")
def file_key_normalize(spark, sf):
    p = table(spark, sf, "part")
    path = F.concat(F.lit("rides/"), metadata.header(F.col("p_name")), F.lit(".gpx"))
    return p.select("p_partkey", files.file_key(path, F.when(F.col("p_size") % 2 == 0, F.col("p_partkey").cast("string"))).alias("key"))


@query("WITH c AS (SELECT p_partkey, unnest(['n', 's', 'b', 'z']) AS name, unnest([CAST(p_size AS VARCHAR), p_name, CASE WHEN p_size > 25 THEN 'true' ELSE 'yes' END, '00' || p_size]) AS cell FROM part) SELECT name, CASE WHEN cell IN ('true', 'false') THEN 'bool' WHEN regexp_full_match(cell, '-?(0|[1-9][0-9]*)') THEN 'number' ELSE 'string' END AS type, count(*) AS n FROM c GROUP BY ALL")
def csv_cell_typing(spark, sf):
    size = F.col("p_size")
    cells = F.create_map(F.lit("n"), size.cast("string"), F.lit("s"), F.col("p_name"), F.lit("b"), F.when(size > 25, "true").otherwise("yes"), F.lit("z"), F.concat(F.lit("00"), size.cast("string")))
    return table(spark, sf, "part").select(F.explode(cells).alias("name", "cell")).groupBy("name", props.kind(props.cell(F.col("cell"))).alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT z, CASE WHEN z <= 6 THEN 6 WHEN z <= 14 THEN 14 WHEN z <= 16 THEN 16 END AS source, count(*) AS n FROM (SELECT CAST(event_id % 19 AS INT) AS z FROM events) GROUP BY ALL")
def source_zoom_select(spark, sf):
    """Tiles asked for (the zoom is the event's id modulo 19) by the stored zoom that serves them."""
    stored = [6, 2, 14, 10, 16]
    serves = F.create_map(*(F.lit(x) for z in range(19) for x in (z, geo.source_zoom(stored, z))))
    return table(spark, sf, "events").select((F.col("event_id") % 19).cast("int").alias("z")).groupBy("z").agg(F.count(F.lit(1)).alias("n")).select("z", F.element_at(serves, F.col("z")).alias("source"), "n")


@query("WITH f AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'a.gpx' WHEN 1 THEN 'b.tcx.gz' WHEN 2 THEN 'dir.x/c.FIT' WHEN 3 THEN 'gpx' WHEN 4 THEN 'd.fit.gz' WHEN 5 THEN 'e.gz' ELSE 'f.gpx.zip' END AS name FROM part) SELECT name, CASE name WHEN 'a.gpx' THEN 'gpx' WHEN 'b.tcx.gz' THEN 'tcx' WHEN 'gpx' THEN 'gpx' WHEN 'd.fit.gz' THEN 'fit' END AS kind, name LIKE '%.gz' AND name <> 'e.gz' AS gzip, count(*) AS n FROM f GROUP BY ALL")
def file_type_sniff(spark, sf):
    names = ["a.gpx", "b.tcx.gz", "dir.x/c.FIT", "gpx", "d.fit.gz", "e.gz", "f.gpx.zip"]
    p = table(spark, sf, "part").select(F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 7 + 1).cast("int")).alias("name"))
    kind, gz = files.sniff(F.col("name"))
    return p.groupBy("name", kind.alias("kind"), (gz & kind.isNotNull()).alias("gzip")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linestatus = 'O' THEN 'imported' ELSE 'skipped' END AS status, count(*) AS n FROM lineitem GROUP BY 1")
def import_counters(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_linestatus") == "O", "imported").otherwise("skipped").alias("status"))
    return files.counters(rows)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS kudos, value / 1000 AS total_distance, round(value * 3.6::DOUBLE, 4) AS max_speed FROM events WHERE event_type NOT LIKE 'v%'")
def webhook_properties(spark, sf):
    from wayfold.sources.connectors import unit_columns

    e = table(spark, sf, "events").where(~F.col("event_type").startswith("v"))
    units = unit_columns(F.col("value"), F.col("value"), F.col("value"))
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("kudos"), units["total_distance"].alias("total_distance"), F.round(units["max_speed"], 4).alias("max_speed"))


# --- order-dependent or codec operators: no SQL, tested on their own


def _walk_sql(zooms: list[int], extent: int = 2048, epsilon: float = tiling.EPSILON) -> str:
    """kept: activity_id, z, line, idx, x, y, px, py of the vertices of stored polylines, from the bottom left: the walk as a recursion over an activity's segments, the simplification as one over chords."""

    def clip(p: str, a: str, b: str) -> str:
        """Columns of the part of segment a to b (prefixes) in the box l, b, r, t: p0, p1 (shares of it) and pm (whether they meet)."""
        sides = [(f"{b}x - {a}x", f"l - {a}x", f"r - {a}x"), (f"{b}y - {a}y", f"b - {a}y", f"t - {a}y")]
        near = ", ".join(f"CASE WHEN {d} = 0 THEN 0.0::DOUBLE ELSE least(({lo}) / ({d}), ({hi}) / ({d})) END" for d, lo, hi in sides)
        far = ", ".join(f"CASE WHEN {d} = 0 THEN 1.0::DOUBLE ELSE greatest(({lo}) / ({d}), ({hi}) / ({d})) END" for d, lo, hi in sides)
        out = " OR ".join(f"({d} = 0 AND ({lo} > 0 OR {hi} < 0))" for d, lo, hi in sides)
        return f"greatest(0.0::DOUBLE, {near}) AS {p}0, least(1.0::DOUBLE, {far}) AS {p}1, NOT ({out}) AS {p}m"

    at = lambda t, a, b, c, end, v: f"CASE WHEN {t} = {end} THEN {v}{c} ELSE {a}{c} + {t} * ({b}{c} - {a}{c}) END"
    tile = lambda v: f"CAST(greatest(floor(pow(2, z) / {C}::DOUBLE * ({v}x + {HALF}::DOUBLE)), 0) AS BIGINT), CAST(greatest(floor(pow(2, z) / {C}::DOUBLE * ({HALF}::DOUBLE - {v}y)), 0) AS BIGINT)"
    pair = lambda v, x, y: tile(v).replace(" AS BIGINT), ", f" AS BIGINT) AS {x}, ") + f" AS {y}"
    box = lambda x, y: f"{x} * size - {HALF}::DOUBLE AS l, {HALF}::DOUBLE - ({y} + 1) * size AS b, ({x} + 1) * size - {HALF}::DOUBLE AS r, {HALF}::DOUBLE - {y} * size AS t"
    pixel = lambda v, lo, hi: f"CAST(least(greatest(floor(({v} - {lo}) / ({hi} - {lo}) * {extent} + 0.5), 0), {extent}) AS BIGINT)"
    return f"""{_SEGMENTS},
numbered AS (SELECT activity_id, row_number() OVER (PARTITION BY activity_id ORDER BY seq) AS i, mx AS px, my AS py, nx AS qx, ny AS qy FROM segs),
zooms AS (SELECT z, {C}::DOUBLE / pow(2, z) AS size FROM (SELECT unnest({zooms}) AS z)),
walk AS (
  SELECT activity_id, z, size, 0::BIGINT AS i, false AS first, false AS second, false AS opened, NULL::BIGINT AS wx, NULL::BIGINT AS wy, 0.0::DOUBLE AS ax, 0.0::DOUBLE AS ay, 0.0::DOUBLE AS mx, 0.0::DOUBLE AS my, 0::BIGINT AS tx, 0::BIGINT AS ty, 0.0::DOUBLE AS cx, 0.0::DOUBLE AS cy, 0.0::DOUBLE AS dx, 0.0::DOUBLE AS dy, NULL::BIGINT AS nx, NULL::BIGINT AS ny, false AS going
  FROM (SELECT DISTINCT activity_id FROM numbered), zooms
  UNION ALL
  SELECT activity_id, z, size, i, first, leaves AND second AS second, opened, wx, wy, ax, ay, mx, my, tx, ty, cx, cy, dx, dy,
    CASE WHEN NOT first THEN sx WHEN NOT leaves THEN wx WHEN second THEN tx ELSE ux END, CASE WHEN NOT first THEN sy WHEN NOT leaves THEN wy WHEN second THEN ty ELSE uy END,
    (first AND mx = qx AND my = qy) OR (leaves AND second AND dx = qx AND dy = qy)
  FROM (SELECT *, {pair("m", "ux", "uy")}, {at("e0", "m", "q", "x", 0, "m")} AS cx, {at("e0", "m", "q", "y", 0, "m")} AS cy, {at("e1", "m", "q", "x", 1, "q")} AS dx, {at("e1", "m", "q", "y", 1, "q")} AS dy, em AND e0 <= e1 AS second
  FROM (SELECT *, {clip("e", "m", "q")}
  FROM (SELECT * EXCLUDE (l, b, r, t), {box("tx", "ty")}, first AND NOT (mx = qx AND my = qy) AND NOT (tx = wx AND ty = wy) AS leaves
  FROM (SELECT *, {at("c0", "p", "q", "x", 0, "p")} AS ax, {at("c0", "p", "q", "y", 0, "p")} AS ay, {at("c1", "p", "q", "x", 1, "q")} AS mx, {at("c1", "p", "q", "y", 1, "q")} AS my, {pair("q", "tx", "ty")}, cm AND c0 <= c1 AS first
  FROM (SELECT *, {clip("c", "p", "q")}
  FROM (SELECT *, {box("wx", "wy")}
  FROM (SELECT * EXCLUDE (nx, ny), coalesce(nx, sx) AS wx, coalesce(ny, sy) AS wy
  FROM (SELECT w.activity_id, w.z, w.size, n.i, w.going AS opened, w.nx, w.ny, n.px, n.py, n.qx, n.qy, {pair("p", "sx", "sy").replace("z)", "w.z)")} FROM walk w JOIN numbered n ON n.activity_id = w.activity_id AND n.i = w.i + 1))))))))),
parts AS (
  SELECT activity_id, z, size, i, 1 AS k, wx AS x, wy AS y, ax AS sx, ay AS sy, mx AS ex, my AS ey, NOT opened AS fresh FROM walk WHERE first
  UNION ALL SELECT activity_id, z, size, i, 2, tx, ty, cx, cy, dx, dy, true FROM walk WHERE second),
lined AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY activity_id, z ORDER BY i, k) AS line, {box("x", "y")} FROM parts),
vertices AS (
  SELECT activity_id, z, line, x, y, row_number() OVER (PARTITION BY activity_id, z, line ORDER BY i, k, e) AS idx, {pixel("vx", "l", "r")} AS px, {pixel("vy", "b", "t")} AS py
  FROM (SELECT *, 0 AS e, sx AS vx, sy AS vy FROM lined WHERE fresh UNION ALL SELECT *, 1, ex, ey FROM lined)),
chords AS (
  SELECT activity_id, z, line, 1::BIGINT AS lo, max(idx) AS hi FROM vertices GROUP BY ALL
  UNION ALL
  SELECT activity_id, z, line, unnest([lo, far]) AS lo, unnest([far, hi]) AS hi
  FROM (SELECT activity_id, z, line, lo, hi, arg_min(idx, (-d, idx)) AS far, max(d) AS d
    FROM (SELECT *, (ox - t * dx) * (ox - t * dx) + (oy - t * dy) * (oy - t * dy) AS d
    FROM (SELECT *, greatest(0.0, least(1.0, (ox * dx + oy * dy) / CASE WHEN dx * dx + dy * dy > 0 THEN dx * dx + dy * dy ELSE 1 END)) AS t
    FROM (SELECT c.*, v.idx, (v.px - a.px)::DOUBLE AS ox, (v.py - a.py)::DOUBLE AS oy, (b.px - a.px)::DOUBLE AS dx, (b.py - a.py)::DOUBLE AS dy
      FROM chords c JOIN vertices a ON a.activity_id = c.activity_id AND a.z = c.z AND a.line = c.line AND a.idx = lo JOIN vertices b ON b.activity_id = c.activity_id AND b.z = c.z AND b.line = c.line AND b.idx = hi
      JOIN vertices v ON v.activity_id = c.activity_id AND v.z = c.z AND v.line = c.line AND v.idx > lo AND v.idx < hi)))
    GROUP BY activity_id, z, line, lo, hi)
  WHERE d > {epsilon * epsilon}),
kept AS (SELECT v.* FROM vertices v SEMI JOIN (SELECT activity_id, z, line, lo AS idx FROM chords UNION SELECT activity_id, z, line, hi FROM chords) c ON v.activity_id = c.activity_id AND v.z = c.z AND v.line = c.line AND v.idx = c.idx)"""


@query(f"WITH RECURSIVE {_walk_sql(tiling.ZOOMS)} SELECT activity_id, z, x, y, string_agg(px || ' ' || py, ',' ORDER BY idx) AS line FROM kept GROUP BY activity_id, z, x, y, kept.line")
def exact_clip(spark, sf):
    """The stored polylines of all zooms, their vertices as text."""
    return tiling.exact(points(spark, sf)).select("activity_id", "z", "x", "y", F.array_join(F.transform("coords", lambda c: F.concat_ws(" ", c["x"].cast("string"), c["y"].cast("string"))), ",").alias("line"))


VIEW = geo.viewport_tiles((13.3, 52.5, 13.4, 52.55), 1024, 1024, [14])


def _stored_raster_sql(view: tuple[int, int, int, int, int], width: int = 256, source: int = 14, extent: int = 2048) -> str:
    """The polylines of the walk drawn vertex by vertex, as a recursion that carries the last vertex."""
    z, x0, y0, x1, y1 = view
    d, shift = source - z, raster.scale(source, z, extent, width)
    side = width - 1
    lows, highs = (", ".join(f"{f}(-p{c} / nullif(q{c} - p{c}, 0), ({side} - p{c}) / nullif(q{c} - p{c}, 0))" for c in "xy") for f in ("least", "greatest"))
    at = lambda t, c: f"CAST(floor(p{c} + {t} * (q{c} - p{c})) AS BIGINT)"
    return f"""{_walk_sql([source], extent)}, {_MASK_SQL},
boxes AS (SELECT x, y, {C}::DOUBLE / pow(2, {z}) AS size FROM (SELECT unnest(range({x0}, {x1 + 1})) AS x), (SELECT unnest(range({y0}, {y1 + 1})) AS y)),
sides AS (SELECT x, y, x * size - {HALF}::DOUBLE AS l, {HALF}::DOUBLE - (y + 1) * size AS b, (x + 1) * size - {HALF}::DOUBLE AS r, {HALF}::DOUBLE - y * size AS t FROM boxes),
near AS (SELECT x, y, CAST(trunc((cx - l) * ({width} / (r - l))) AS BIGINT) AS mx, CAST(trunc((t - cy) * ({width} / (r - l))) AS BIGINT) AS my, CAST(trunc(radius * ({width} / (r - l))) AS BIGINT) AS mr FROM sides, centres
  WHERE pow(cx - greatest(l, least(cx, r)), 2) + pow(cy - greatest(b, least(cy, t)), 2) <= radius * radius),
scaled AS (SELECT activity_id, line, row_number() OVER (PARTITION BY activity_id, line ORDER BY idx) AS i, x >> {d} AS tx, y >> {d} AS ty, (px + {extent} * (x - ((x >> {d}) << {d}))) >> {shift} AS vx, ({extent} - py + {extent} * (y - ((y >> {d}) << {d}))) >> {shift} AS vy FROM kept),
seen AS (SELECT *, EXISTS (SELECT 1 FROM near n WHERE n.x = tx AND n.y = ty AND (vx - mx) * (vx - mx) + (vy - my) * (vy - my) <= mr * mr) AS hide FROM scaled WHERE tx BETWEEN {x0} AND {x1} AND ty BETWEEN {y0} AND {y1}),
draw AS (
  SELECT activity_id, line, i, tx, ty, CASE WHEN NOT hide THEN vx::DOUBLE END AS lx, CASE WHEN NOT hide THEN vy::DOUBLE END AS ly, false AS draws, 0.0::DOUBLE AS px, 0.0::DOUBLE AS py, 0.0::DOUBLE AS qx, 0.0::DOUBLE AS qy, 0.0::DOUBLE AS t0, 0.0::DOUBLE AS t1 FROM seen WHERE i = 1
  UNION ALL
  SELECT activity_id, line, i, tx, ty, CASE WHEN hide THEN NULL WHEN px IS NULL OR draws THEN qx ELSE px END, CASE WHEN hide THEN NULL WHEN px IS NULL OR draws THEN qy ELSE py END, draws AND NOT hide, px, py, qx, qy, t0, t1
  FROM (SELECT *, coalesce((px <> qx OR py <> qy) AND t0 <= t1 AND NOT (px = qx AND px > {side}) AND NOT (py = qy AND py > {side}), false) AS draws
  FROM (SELECT *, greatest(0.0::DOUBLE, {lows}) AS t0, least(1.0::DOUBLE, {highs}) AS t1
  FROM (SELECT w.activity_id, w.line, s.i, s.tx, s.ty, s.hide, w.lx AS px, w.ly AS py, s.vx::DOUBLE AS qx, s.vy::DOUBLE AS qy FROM draw w JOIN seen s ON s.activity_id = w.activity_id AND s.line = w.line AND s.i = w.i + 1)))),
strokes AS (SELECT tx, ty, {at("t0", "x")} AS x0, {at("t0", "y")} AS y0, {at("t1", "x")} AS x1, {at("t1", "y")} AS y1 FROM draw WHERE draws),
pix AS (SELECT *, unnest(generate_series(0, greatest(abs(x1 - x0), abs(y1 - y0)))) AS i FROM strokes),
minor AS (SELECT *, CASE WHEN greatest(abs(x1 - x0), abs(y1 - y0)) = 0 THEN 0 ELSE (i * least(abs(x1 - x0), abs(y1 - y0))) // greatest(abs(x1 - x0), abs(y1 - y0)) END AS m, abs(y1 - y0) > abs(x1 - x0) AS steep FROM pix)
SELECT tx, ty, x0 + (CASE WHEN x1 >= x0 THEN 1 ELSE -1 END) * (CASE WHEN steep THEN m ELSE i END) AS px, y0 + (CASE WHEN y1 >= y0 THEN 1 ELSE -1 END) * (CASE WHEN steep THEN i ELSE m END) AS py, least(count(*), 255) AS visits FROM minor GROUP BY ALL"""


def _stored_raster(spark, sf, view: tuple[int, int, int, int, int]) -> DataFrame:
    z, x0, y0, x1, y1 = view
    return raster.rasterize(tiling.exact(points(spark, sf), [14]), [(z, x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)], 14, 256, 2048, [m[1:] for m in MASKS])


@query(f"WITH RECURSIVE {_stored_raster_sql(VIEW)}")
def stored_raster_z14(spark, sf):
    """The rasters of all z14 tiles of the view from the stored polylines."""
    return _stored_raster(spark, sf, VIEW)


VIEW_11 = geo.viewport_tiles((13.3, 52.5, 13.4, 52.55), 256, 256, [11])


@query(f"WITH RECURSIVE {_stored_raster_sql(VIEW_11)}")
def stored_raster_z11(spark, sf):
    """The same of z11 tiles, each from the 64 stored ones below it, scaled down."""
    return _stored_raster(spark, sf, VIEW_11)


@query(f"WITH {_POINTS} SELECT activity_id, count(*) AS n, CAST(sum(seq * (CAST(round(lat * 100000) AS BIGINT) * 3 + CAST(round(lng * 100000) AS BIGINT) * 7)) AS BIGINT) AS checksum FROM points GROUP BY activity_id")
def polyline_codec(spark, sf):
    """Lines encoded and decoded again: number of points and a checksum of places and coordinates in 1e-5 degrees."""
    from wayfold.sources.polyline import decoded, encoded

    lines = points(spark, sf).groupBy("activity_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lng"))).alias("p"))
    lines = lines.select("activity_id", F.transform("p", lambda q: F.struct(q["lat"].alias("lat"), q["lng"].alias("lng"))).alias("p"))
    back = decoded(encoded(lines, "p", "line"), "line", "q").select("activity_id", F.posexplode("q").alias("i", "d"))
    whole = lambda c: F.round(F.col(c) * 100000).cast("long")
    return back.groupBy("activity_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("i") + 1) * (whole("d.lat") * 3 + whole("d.lng") * 7)).alias("checksum"))


def entry(spark: SparkSession) -> DataFrame:
    return track_stats(spark, "/root/testdata/sf0.001")


__all__ = ["QUERIES", "SQL", "entry", "predicate"]
