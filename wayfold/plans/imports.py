"""Registered queries that go through files: events written as activity files, read, imported and listed again.

A user is an activity. Its file is made by Spark from the user's events, whole, so the work
grows with the table; DuckDB computes the same results from the events themselves.

A store that a query imports into lies in the folder that driver and executors share, and
stays there, since the returned frame reads it; the files it was made of are removed.
"""

from __future__ import annotations

import gzip
import struct
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.engine import Engine
from wayfold.operators import tiling
from wayfold.plans.catalogue import _POINTS, _STATS, _walk_sql, points, query, table
from wayfold.sources import connectors, files, fit, polyline
from wayfold.sources.batches import limit, pieces

#: Seconds that are added to the times of events, which lie in 1970: FIT files begin later. Points of a line of GPX and TCX files.
LATER, LINE = 1_000_000_000, 20


def shared(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; a local one where that is unset and Spark runs in this process alone."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wayfold-"))
        at = spark.sparkContext.getCheckpointDir()
    return f"{at.rstrip('/')}/wayfold/{name}-{uuid.uuid4().hex}"


def _utc(t: Column) -> Column:
    """Seconds as RFC 3339 text, whatever the session's time zone is."""
    return F.date_format(F.to_utc_timestamp(F.timestamp_seconds(t), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _tracks(spark: SparkSession, sf: str) -> DataFrame:
    """user_id and its points in order."""
    p = points(spark, sf).withColumn("t", F.col("t") + LATER).withColumn("time", _utc(F.col("t")))
    return p.groupBy(F.col("activity_id").alias("user_id")).agg(F.array_sort(F.collect_list(F.struct("seq", "lng", "lat", "ele", "t", "time"))).alias("p"))


def _lines(p: Column, tag: str, size: int | None, text) -> Column:
    """Points as text, in elements of size points (None: one)."""
    if size is None:
        return F.concat(F.lit(f"<{tag}>"), F.array_join(F.transform(p, text), ""), F.lit(f"</{tag}>"))
    starts = F.sequence(F.lit(1), F.size(p), F.lit(size))
    return F.array_join(F.transform(starts, lambda i: F.concat(F.lit(f"<{tag}>"), F.array_join(F.transform(F.slice(p, i, size), text), ""), F.lit(f"</{tag}>"))), "")


def _element(name: str, c: Column) -> Column:
    """An XML element, nothing where its value is null."""
    return F.coalesce(F.concat(F.lit(f"<{name}>"), c.cast("string"), F.lit(f"</{name}>")), F.lit(""))


def gpx(size: int | None, kind: Column) -> Column:
    point = lambda q: F.concat(F.lit('<trkpt lat="'), q["lat"].cast("string"), F.lit('" lon="'), q["lng"].cast("string"), F.lit('">'), _element("ele", q["ele"]), _element("time", q["time"]), F.lit("</trkpt>"))
    head = F.concat(F.lit('<?xml version="1.0"?><gpx xmlns="http://www.topografix.com/GPX/1/1"><metadata>'), _element("time", F.element_at("p", 1)["time"]), F.lit("</metadata><trk>"), _element("name", F.concat(F.lit("user "), F.col("user_id").cast("string"))), _element("type", kind))
    return F.concat(head, _lines(F.col("p"), "trkseg", size, point), F.lit("</trk></gpx>")).cast("binary")


def tcx(size: int | None) -> Column:
    point = lambda q: F.concat(F.lit("<Trackpoint>"), _element("Time", q["time"]), F.lit("<Position>"), _element("LatitudeDegrees", q["lat"]), _element("LongitudeDegrees", q["lng"]), F.lit("</Position>"), _element("AltitudeMeters", q["ele"]), F.lit("</Trackpoint>"))
    return F.concat(F.lit('  <?xml version="1.0"?><TrainingCenterDatabase><Activities><Activity Sport="Running"><Lap>'), _lines(F.col("p"), "Track", size, point), F.lit("</Lap></Activity></Activities></TrainingCenterDatabase>")).cast("binary")


def _fit(points: list[dict], virtual: bool) -> bytes:
    """A FIT stream of a session and its records."""
    define = lambda local, number, fields: bytes([0x40 | local, 0, 0]) + struct.pack("<HB", number, len(fields)) + b"".join(map(bytes, fields))
    start = points[0]["t"] - fit.EPOCH
    body = define(0, 0, [(0, 1, 0)]) + bytes([0, 4]) + define(1, 18, [(2, 4, 0x86), (6, 1, 0)]) + struct.pack("<BIB", 1, start, 58 if virtual else 7)
    body += define(2, 20, [(253, 4, 0x86), (0, 4, 0x85), (1, 4, 0x85), (2, 2, 0x84)])
    for q in points:
        height = 0xFFFF if q["ele"] is None else int((q["ele"] + 500) * 5)
        body += struct.pack("<BIiiH", 2, q["t"] - fit.EPOCH, round(q["lat"] * fit.SEMICIRCLES), round(q["lng"] * fit.SEMICIRCLES), height)
    return struct.pack("<BBHI4sH", 14, 0x10, 2132, len(body), b".FIT", 0) + body + b"\0\0"


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FIT files encoded, .gz files packed, broken ones cut in their middle."""
    for batch in pieces(batches, "content", "p"):
        out = []
        for r in batch.to_pylist():
            content = r["content"] if r["content"] is not None else _fit(r["p"], r["virtual"])
            if r["path"].endswith(".gz"):
                content = gzip.compress(content, mtime=0)
            out.append(content[: len(content) // 2] if r["broken"] else content)
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.binary())], ["path", "content"])


def user_files(spark: SparkSession, sf: str) -> DataFrame:
    """path and content: GPX, TCX, FIT and gzipped GPX by the user's id modulo 4; each fifth user's ride is virtual, each seventh file is cut off."""
    u = F.col("user_id")
    kind, virtual = u % 4, u % 5 == 0
    name = F.element_at(F.array(*map(F.lit, (".gpx", ".tcx", ".fit", ".gpx.gz"))), (kind + 1).cast("int"))
    content = F.when(kind == 1, tcx(LINE)).when(kind != 2, gpx(LINE, F.when(virtual, "VirtualRide").otherwise("ride")))
    rows = _tracks(spark, sf).select(F.concat(F.lit("files/"), u.cast("string"), name).alias("path"), content.alias("content"), F.when(kind == 2, F.col("p")).alias("p"), virtual.alias("virtual"), (u % 7 == 0).alias("broken"))
    limit(spark)
    return rows.mapInArrow(_finished, "path string, content binary")


@query(
    f"""WITH {_POINTS},
p AS (SELECT activity_id AS u, seq, t + {LATER} AS t, CASE WHEN u % 4 = 2 THEN 0 ELSE (seq - 1) // {LINE} END AS part,
  CASE WHEN u % 4 = 2 THEN round(lng * {fit.SEMICIRCLES!r}::DOUBLE) / {fit.SEMICIRCLES!r}::DOUBLE ELSE lng END AS lng, CASE WHEN u % 4 = 2 THEN round(lat * {fit.SEMICIRCLES!r}::DOUBLE) / {fit.SEMICIRCLES!r}::DOUBLE ELSE lat END AS lat,
  CASE WHEN u % 4 = 2 THEN floor((ele + 500) * 5) / 5 - 500 ELSE ele END AS ele,
  CASE WHEN u % 7 = 0 THEN 'failed' WHEN u % 5 = 0 AND u % 4 <> 1 THEN 'skipped' ELSE 'imported' END AS status FROM points)
SELECT 'files/' || u || CASE u % 4 WHEN 0 THEN '.gpx' WHEN 1 THEN '.tcx' WHEN 2 THEN '.fit' ELSE '.gpx.gz' END AS path, any_value(status) AS status,
  CASE WHEN any_value(status) = 'imported' AND u % 4 IN (0, 3) THEN 'user ' || u END AS title,
  CASE WHEN any_value(status) = 'imported' THEN min_by(t, seq) * 1000 END AS start_ms,
  count(*) FILTER (WHERE status = 'imported') AS n_points, count(DISTINCT part) FILTER (WHERE status = 'imported') AS n_lines, count(ele) FILTER (WHERE status = 'imported') AS n_levels,
  coalesce(CAST(sum(t * (part + 1)) FILTER (WHERE status = 'imported') AS BIGINT), 0) AS times, round(coalesce(sum(lng * (seq % 9)) FILTER (WHERE status = 'imported'), 0), 4) AS lngs, round(coalesce(sum(lat * (seq % 9)) FILTER (WHERE status = 'imported'), 0), 4) AS lats, round(coalesce(sum(ele) FILTER (WHERE status = 'imported'), 0), 3) AS levels
FROM p GROUP BY u"""
)
def parsed_files(spark, sf):
    """Every user's file read: status, title, start, and its points' number, lines and sums (0 where it isn't imported)."""
    rows = files.parsed(user_files(spark, sf))
    good = F.col("status") == "imported"
    own = F.when(good, F.col("points"))
    total = lambda f: F.coalesce(F.aggregate(F.transform(own, f), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))), F.lit(0.0))
    nth = lambda i: ((i + 1) % 9).cast("double")
    return rows.select(
        "path",
        "status",
        F.when(good, F.col("title")).alias("title"),
        F.when(good, F.unix_millis("start_time")).alias("start_ms"),
        F.coalesce(F.size(own), F.lit(0)).cast("long").alias("n_points"),
        F.coalesce(F.size(F.array_distinct(F.transform(own, lambda q: q["part"]))), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(F.filter(own, lambda q: q["ele"].isNotNull())), F.lit(0)).cast("long").alias("n_levels"),
        F.coalesce(F.aggregate(own, F.lit(0).cast("long"), lambda a, q: a + q["t"] * (q["part"] + 1)), F.lit(0).cast("long")).alias("times"),
        F.round(total(lambda q, i: q["lng"] * nth(i)), 4).alias("lngs"),
        F.round(total(lambda q, i: q["lat"] * nth(i)), 4).alias("lats"),
        F.round(total(lambda q: q["ele"]), 3).alias("levels"),
    )


# --- imports into a store


def _saved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files written where their paths say; a task that is run again writes the same."""
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            store, at, _ = files._system(path.as_py())
            store.create_dir(at.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(at) as f:
                f.write(content.as_buffer())
        yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def imported(spark: SparkSession, sf: str) -> Engine:
    """A new store of every user's track, a GPX file of one line each, joined to a CSV that knows two of three users and the ids of every other of these."""
    at, u = shared(spark, "files"), F.col("user_id")
    tracks = _tracks(spark, sf)
    name = F.concat(F.lit("f/"), u.cast("string"), F.lit(".gpx"))
    written = tracks.select(F.concat(F.lit(at + "/"), name).alias("path"), gpx(None, F.lit("ride")).alias("content"))
    limit(spark)
    written.mapInArrow(_saved, "n long").agg(F.sum("n")).collect()  # one row
    cells = {
        "Filename": name,
        "Activity ID": F.when(u % 2 == 0, (u + 1000).cast("string")).otherwise(" "),
        "Sport Name": F.concat(F.lit('Trail, "'), (u % 4).cast("string"), F.lit('"')),
        "Rank": (u % 9).cast("string"),
        "Blank": F.lit("  "),
        "Elapsed Time": F.when(u % 5 == 0, "-1").otherwise(""),
    }
    known = table(spark, sf, "events").select("user_id").distinct().where(u % 3 != 0)
    known.select(*(c.alias(n) for n, c in cells.items())).write.option("header", True).option("escape", '"').csv(f"{at}/meta.csv")
    engine = Engine(spark, shared(spark, "store"))
    engine.import_path(f"{at}/f", join=f"{at}/meta.csv")
    _delete(spark, at)
    return engine


_IMPORTED = f"""{_STATS},
i AS (SELECT s.*, activity_id AS u, CASE WHEN activity_id % 3 <> 0 AND activity_id % 2 = 0 THEN 'strava:' || (activity_id + 1000) ELSE activity_id || '.gpx' END AS file, activity_id % 3 <> 0 AS known,
  (SELECT min(t) FROM points p WHERE p.activity_id = s.activity_id) + {LATER} AS start FROM sums s)"""


@query(
    f"""WITH RECURSIVE {_walk_sql(tiling.ZOOMS)}, {_IMPORTED.removeprefix(_POINTS + ",")},
t AS (SELECT activity_id, count(DISTINCT (z, x, y)) AS tile_count FROM kept GROUP BY 1)
SELECT file, 'user ' || u AS title, start * 1000 AS start_ms, greatest(coalesce(tile_count, 0), 1) AS tile_count, 'ride' AS activity_type, CASE WHEN known THEN 'Trail, "' || u % 4 || '"' END AS sport, CASE WHEN known THEN u % 9 END AS rank,
  CASE WHEN known AND u % 5 = 0 THEN -1 WHEN n >= 2 THEN elapsed END AS elapsed_time, CASE WHEN n >= 2 THEN moving END AS moving_time, CASE WHEN n >= 2 THEN round(metres / 1000, 4) END AS total_distance, round(CASE WHEN moving > 0 THEN metres / moving * 3.6::DOUBLE END, 4) AS average_speed, CASE WHEN levels >= 2 THEN round(high, 4) END AS max_elevation
FROM i LEFT JOIN t USING (activity_id)"""
)
def stored_import(spark, sf):
    """The listing of a store after an import with metadata: keys, titles, tiles, computed and joined properties."""
    p = F.col("properties")
    get = lambda k, t: F.try_variant_get("v", f"$.{k}", t)
    rows = imported(spark, sf).activities().withColumn("v", F.parse_json(p))
    return rows.select(
        F.regexp_replace("file", "^.*/", "").alias("file"), "title", F.unix_millis("start_time").alias("start_ms"), "tile_count", get("activity_type", "string").alias("activity_type"), get("sport_name", "string").alias("sport"), get("rank", "long").alias("rank"),
        get("elapsed_time", "long").alias("elapsed_time"), get("moving_time", "long").alias("moving_time"), get("total_distance", "double").alias("total_distance"), get("average_speed", "double").alias("average_speed"), get("max_elevation", "double").alias("max_elevation"),
    )


@query(
    f"""WITH {_IMPORTED},
e AS (SELECT 'activity_type' AS key, u FROM i UNION ALL SELECT unnest(['total_distance', 'moving_time', 'max_speed']), u FROM i WHERE n >= 2 UNION ALL SELECT 'elapsed_time', u FROM i WHERE n >= 2 OR (known AND u % 5 = 0)
  UNION ALL SELECT 'average_speed', u FROM i WHERE moving > 0 UNION ALL SELECT unnest(['elevation_gain', 'elevation_loss', 'min_elevation', 'max_elevation']), u FROM i WHERE levels >= 2
  UNION ALL SELECT unnest(['sport_name', 'rank']), u FROM i WHERE known UNION ALL SELECT 'activity_id', u FROM i WHERE known AND u % 2 = 0)
SELECT key, count(*) AS n, CASE WHEN key IN ('activity_type', 'sport_name') THEN 'string' ELSE 'number' END AS types FROM e GROUP BY key"""
)
def stored_profile(spark, sf):
    """The properties of a store after an import with metadata, from the profiles that are kept with its activities."""
    return imported(spark, sf).properties().select("key", F.col("count").alias("n"), F.array_join("types", ",").alias("types"))


@query(f"WITH {_IMPORTED} SELECT file FROM i WHERE (coalesce(n >= 2 AND moving >= 60, false) OR levels < 2) AND NOT (coalesce(known AND u % 4 = 1, false)) AND known AND u % 9 IN (1, 2, 5, 7)")
def stored_filter(spark, sf):
    """A filter of groups, words and lists over a store: hot keys by their typed copies, the rest by the exact filter."""
    rows = imported(spark, sf).activities(filter="(moving_time >= 60 || !(has? max_elevation)) && !(sport_name like '%\"1\"') && rank in [1, 2, 5, 7]")
    return rows.select(F.regexp_replace("file", "^.*/", "").alias("file"))


# --- what services send


@query(
    f"""WITH {_POINTS}, a AS (SELECT activity_id AS u, count(*) AS n, CAST(sum(seq * (CAST(round(lat * 100000) AS BIGINT) * 3 + CAST(round(lng * 100000) AS BIGINT) * 7)) AS BIGINT) AS checksum, min(t) + {LATER} AS start FROM points GROUP BY 1)
SELECT 'strava:' || u AS path, CASE WHEN u % 4 = 0 THEN 'failed' WHEN u % 5 = 0 THEN 'skipped' ELSE 'imported' END AS status, 'user ' || u AS title, start * 1000 AS start_ms, CASE WHEN u % 4 = 0 THEN 0 ELSE n END AS n_points, CASE WHEN u % 4 = 0 THEN 0 ELSE checksum END AS checksum,
  CASE WHEN u % 3 = 0 THEN 'activity_gear,' ELSE '' END || 'activity_type,average_speed,elevation_gain,' || CASE WHEN u % 3 = 0 THEN 'gear_id,' ELSE '' END || 'id,kudos_count,max_elevation,max_speed,min_elevation,start_date,total_distance' AS keys,
  CASE WHEN u % 5 = 0 THEN 'VirtualRide' ELSE 'Run' END AS activity_type, CASE WHEN u % 3 = 0 THEN 'gear "' || u % 2 || '"' END AS gear, round(n * 100 / 1000, 4) AS total_distance, u % 11 AS elevation_gain FROM a"""
)
def webhook_activities(spark, sf):
    """Each user as a service tells it: encoded line, units, renamed and dropped fields, gear, virtual rides, and those without a line, which fail."""
    u = F.col("user_id")
    rows = _tracks(spark, sf).withColumn("q", F.when(u % 4 != 0, F.transform("p", lambda q: F.struct(q["lat"].alias("lat"), q["lng"].alias("lng")))))
    rows = polyline.encoded(rows.select("user_id", "q", F.element_at("p", 1)["time"].alias("start"), F.size("p").alias("n")), "q", "line")
    body = {
        "id": u, "name": F.concat(F.lit("user "), u.cast("string")), "type": F.when(u % 5 == 0, "VirtualRide").otherwise("Run"), "start_date": F.col("start"), "distance": F.col("n") * 100, "average_speed": F.lit(2.5), "max_speed": F.lit(10),
        "total_elevation_gain": u % 11, "kudos_count": F.col("n"), "laps": F.array(F.col("n")), "photos": F.struct(F.lit(0).alias("count")), "splits_metric": F.array(F.struct(F.lit(1).alias("split"))),
        "gear": F.when(u % 3 == 0, F.struct(F.concat(F.lit("g"), u.cast("string")).alias("id"), F.concat(F.lit('gear "'), (u % 2).cast("string"), F.lit('"')).alias("name"))), "map": F.struct(F.col("line").alias("polyline")),
    }
    got = connectors.webhook_activities(rows.select(F.to_json(F.struct(*(c.alias(n) for n, c in body.items()))).alias("body")))
    whole = lambda c: F.round(c * 100000).cast("long")
    value = lambda k: F.element_at("properties", k)
    text = lambda k: F.try_variant_get(F.try_parse_json(value(k)), "$", "string")
    return got.select(
        "path", "status", "title", F.unix_millis("start_time").alias("start_ms"), F.size("points").cast("long").alias("n_points"),
        F.aggregate(F.transform("points", lambda q, i: (i + 1) * (whole(q["lat"]) * 3 + whole(q["lng"]) * 7)), F.lit(0).cast("long"), lambda a, x: a + x).alias("checksum"),
        F.array_join(F.array_sort(F.map_keys("properties")), ",").alias("keys"), text("activity_type").alias("activity_type"), text("activity_gear").alias("gear"), F.round(value("total_distance").cast("double"), 4).alias("total_distance"), value("elevation_gain").cast("long").alias("elevation_gain"),
    )
