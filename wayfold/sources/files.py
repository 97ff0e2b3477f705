"""Activity files: GPX and TCX by Spark's XML functions, FIT by an Arrow decoder."""

from __future__ import annotations

import gzip
import json
import re
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import props
from wayfold.sources.batches import limit, pieces

GPX = "metadata struct<time: string>, trk array<struct<name: string, type: string, trkseg: array<struct<trkpt: array<struct<_lat: double, _lon: double, ele: double, time: string>>>>>>, _corrupt string"
TCX = "Activities struct<Activity: array<struct<Lap: array<struct<Track: array<struct<Trackpoint: array<struct<Time: string, AltitudeMeters: double, Position: struct<LatitudeDegrees: double, LongitudeDegrees: double>>>>>>>>>>, _corrupt string"
POINT = "struct<part: int, lng: double, lat: double, ele: double, t: bigint>"


def sniff(path: Column) -> tuple[Column, Column]:
    """Kind (gpx, fit, tcx, else null) and whether it is gzipped, by the case-sensitive end of the name; a file just named "gpx" counts."""
    parts = F.split(F.element_at(F.split(path, "/"), -1), r"[.]")
    gz = F.element_at(parts, -1) == "gz"
    end = F.when(gz, F.try_element_at(parts, F.lit(-2))).otherwise(F.element_at(parts, -1))
    return F.when(end.isin("gpx", "fit", "tcx"), end), gz


def file_key(path: Column, activity_id: Column) -> Column:
    """strava:{id} if the metadata knows the id, else the path."""
    return F.when(activity_id.isNotNull(), F.concat(F.lit("strava:"), activity_id)).otherwise(path)


def counters(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _system(path: str):
    """The file system of a path, the path there, and what is put before paths there to name them."""
    from pyarrow import fs

    scheme = urlparse(path).scheme
    store, at = fs.FileSystem.from_uri(path) if scheme not in ("", "file") else (fs.LocalFileSystem(), re.sub("^file:/+", "/", path))
    return store, at, "" if scheme in ("", "file") else f"{scheme}://"


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path and is_folder of what lies in folders; what starts with . or _ is passed over, as Spark's own readers do."""
    from pyarrow import fs

    for batch in batches:
        for path in batch.column("path").to_pylist():
            store, at, lead = _system(path)
            info = store.get_file_info(at)
            found = [info] if info.is_file else [f for f in store.get_file_info(fs.FileSelector(at)) if f.base_name[:1] not in ("", ".", "_")]
            for k in range(0, len(found), 10_000):
                some = found[k : k + 10_000]
                yield pa.RecordBatch.from_pydict({"path": pa.array([lead + f.path for f in some], pa.string()), "is_folder": pa.array([not f.is_file for f in some], pa.bool_())})


def names(spark: SparkSession, path: str) -> DataFrame:
    """path of one file or of all below a folder; none is opened.

    Tasks list the folders, a level of the tree at a time, so the driver holds no names, only
    whether a level has folders. Levels are kept by Spark until the frame is gone; if that is
    lost, they are listed again.
    """
    if not _system(path)[0].get_file_info(_system(path)[1]).type.value:
        raise FileNotFoundError(path)
    level = spark.createDataFrame([(path.rstrip("/") or "/",)], "path string")
    out = None
    while level is not None:
        found = level.mapInArrow(_listed, "path string, is_folder boolean").persist()
        files = found.where("not is_folder").select("path")
        out = files if out is None else out.unionByName(files)
        folders = found.where("is_folder").select("path")
        level = None if folders.isEmpty() else folders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return out


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            try:
                store, at, _ = _system(path)
                with store.open_input_file(at) as f:
                    content = f.read()
            except OSError:
                content = None
            yield pa.RecordBatch.from_pydict({"path": pa.array([path]), "content": pa.array([content], pa.binary())})


def opened(spark: SparkSession, at: DataFrame) -> DataFrame:
    """path and content (null if it can't be read) of files by path, read by tasks, one at a time each."""
    return at.select("path").repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(_contents, "path string, content binary")


def unzipped(files: DataFrame) -> DataFrame:
    """Files with kind, and gzipped content unpacked (null if it is damaged)."""
    kind, gz = sniff(F.col("path"))
    limit(files.sparkSession)
    files = files.select("path", kind.alias("kind"), (gz & kind.isNotNull()).alias("gz"), "content")

    def run(batches):
        for b in pieces(batches, "content"):
            out = []
            for c, z in zip(b.column("content").to_pylist(), b.column("gz").to_pylist()):
                try:
                    out.append(gzip.decompress(c) if z else c)
                except (OSError, EOFError, ValueError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("kind"), pa.array(out, pa.binary())], ["path", "kind", "content"])

    return files.mapInArrow(run, "path string, kind string, content binary")


def _time(c: Column) -> Column:
    return F.try_to_timestamp(c)


def _merged(lines: Column) -> Column:
    """Numbered lines of points, without empty ones, as one array."""
    full = F.filter(lines, lambda x: F.size(x) > 0)
    return F.flatten(F.transform(full, lambda line, i: F.transform(line, lambda p: F.struct(i.cast("int").alias("part"), p["lng"].alias("lng"), p["lat"].alias("lat"), p["ele"].alias("ele"), p["t"].alias("t")))))


def _gpx(files: DataFrame) -> DataFrame:
    x = files.withColumn("x", F.from_xml(F.col("content").cast("string"), GPX, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    trk = F.try_element_at("x.trk", F.lit(1))
    lines = F.transform(F.coalesce(trk["trkseg"], F.array()), lambda s: F.transform(F.filter(F.coalesce(s["trkpt"], F.array()), lambda p: p["_lat"].isNotNull() & p["_lon"].isNotNull()), lambda p: F.struct(p["_lon"].alias("lng"), p["_lat"].alias("lat"), p["ele"].alias("ele"), F.unix_seconds(_time(p["time"])).alias("t"))))
    kind = trk["type"]
    return x.select(
        "path",
        F.col("x._corrupt").isNotNull().alias("bad"),
        F.coalesce(kind.startswith("Virtual"), F.lit(False)).alias("virtual"),
        trk["name"].alias("title"),
        _time(F.col("x.metadata.time")).alias("start_time"),
        F.map_filter(F.create_map(F.lit("activity_type"), props.fragment(kind, "string")), lambda _, v: kind.isNotNull()).alias("properties"),
        _merged(lines).alias("points"),
    )


def _tcx(files: DataFrame) -> DataFrame:
    x = files.withColumn("x", F.from_xml(F.ltrim(F.col("content").cast("string")), TCX, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    first = F.try_element_at("x.Activities.Activity", F.lit(1))
    tracks = F.flatten(F.transform(F.coalesce(first["Lap"], F.array()), lambda lap: F.coalesce(lap["Track"], F.array())))
    lines = F.transform(tracks, lambda t: F.transform(F.filter(F.coalesce(t["Trackpoint"], F.array()), lambda p: p["Position"]["LatitudeDegrees"].isNotNull() & p["Position"]["LongitudeDegrees"].isNotNull()), lambda p: F.struct(p["Position"]["LongitudeDegrees"].alias("lng"), p["Position"]["LatitudeDegrees"].alias("lat"), p["AltitudeMeters"].alias("ele"), F.unix_seconds(_time(p["Time"])).alias("t"))))
    start = F.try_element_at(F.try_element_at(F.try_element_at(first["Lap"], F.lit(1))["Track"], F.lit(1))["Trackpoint"], F.lit(1))["Time"]
    return x.select("path", F.col("x._corrupt").isNotNull().alias("bad"), F.lit(False).alias("virtual"), F.lit(None).cast("string").alias("title"), _time(start).alias("start_time"), F.create_map().cast("map<string,string>").alias("properties"), _merged(lines).alias("points"))


def _fit(files: DataFrame) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = f"path string, bad boolean, virtual boolean, title string, start_time timestamp, properties map<string,string>, points array<{POINT}>"
    arrow = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches):
        from wayfold.sources import fit

        for b in pieces(batches, "content"):
            rows = []
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                row = {"path": path, "bad": False, "virtual": False, "title": None, "start_time": None, "properties": [], "points": []}
                try:
                    got = fit.parse(data)
                except (ValueError, IndexError, KeyError):
                    got = None
                    row["bad"] = True
                if got:
                    row["start_time"] = None if got["start_time"] is None else int(got["start_time"] * 1_000_000)
                    row["properties"] = [(k, json.dumps(v)) for k, v in got["properties"].items()]
                    row["points"] = [{"part": 0, "lng": x, "lat": y, "ele": e, "t": t} for x, y, e, t in got["points"]]
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in arrow], schema=arrow)

    return files.mapInArrow(run, ddl)


def parsed(files: DataFrame) -> DataFrame:
    """path, status (imported, skipped, failed), title, start_time, properties (JSON fragments) and points of each file."""
    whole = unzipped(files)
    good = whole.where("content is not null")
    kinds = [f(good.where(F.col("kind") == k).select("path", "content")) for k, f in (("gpx", _gpx), ("tcx", _tcx), ("fit", _fit))]
    out = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    status = F.when(F.col("bad"), "failed").when(F.col("virtual") | (F.size("points") < 1), "skipped").otherwise("imported")
    out = out.select("path", status.alias("status"), "title", "start_time", "properties", F.col("points").cast(f"array<{POINT}>").alias("points"))
    rest = whole.where("kind is null or content is null").select("path", F.when(F.col("kind").isNull(), "skipped").otherwise("failed").alias("status"))
    return out.unionByName(rest, allowMissingColumns=True)


def long_points(activities: DataFrame, id: str = "id") -> DataFrame:
    """activity_id, part, seq, lng, lat, ele, t of the points arrays."""
    return activities.select(F.col(id).alias("activity_id"), F.posexplode("points").alias("seq", "p")).select("activity_id", "p.part", F.col("seq").cast("long").alias("seq"), "p.lng", "p.lat", "p.ele", "p.t")
