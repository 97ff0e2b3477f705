import io
import json
import math
import threading
import urllib.error
import urllib.request
from datetime import date

import pytest
from pyspark.sql import functions as F

from tests import samples
from wayfold import cli
from wayfold.engine import Engine
from wayfold.functions import geo
from wayfold.operators import activities
from wayfold.serve import server, split_size, uploads
from wayfold.sources import files, fit, polyline
from wayfold.sources import known as keys
from wayfold.store import VERSION, Conflict
from wayfold.streaming import landing


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("files")
    samples.write_folder(at / "activities")
    (at / "metadata.csv").write_text("filename,Distance,elevation_gain,activity_type,duration\nactivities/sample.gpx,25000,500,ride,3600\nactivities/sample.tcx,10000,100,run,2400\nactivities/missing.gpx,,,,\n,1,,,\n")
    (at / "export.csv").write_text("Activity ID,filename,activity_type\n19387121985,activities/sample.gpx,ride\n")
    return at


@pytest.fixture(scope="module")
def engine(spark, folder, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store") / "db"))
    e.counts = e.import_path(str(folder / "activities"), str(folder / "metadata.csv"))
    return e


def props(engine, name):
    r = engine.store.activities.where(f"file like '%{name}%'").first()
    return json.loads(str(r.properties))


def kilometres(points):
    """The sum of great-circle distances, by the law of cosines on a sphere of the mean radius."""
    unit = [(math.cos(math.radians(p[1])) * math.cos(math.radians(p[0])), math.cos(math.radians(p[1])) * math.sin(math.radians(p[0])), math.sin(math.radians(p[1]))) for p in points]
    return sum(2 * math.asin(math.dist(a, b) / 2) for a, b in zip(unit, unit[1:])) * geo.MEAN_RADIUS / 1000


def test_import(engine, folder):
    assert engine.counts == {"imported": 3, "skipped": 4, "failed": 2}
    assert engine.count() == 3
    ride = props(engine, "sample.gpx")
    assert ride["total_distance"] == pytest.approx(kilometres(samples.RIDE), abs=1e-4) and (ride["min_elevation"], ride["max_elevation"], ride["elevation_loss"]) == (61.5, 61.8, 0)
    assert ride["elevation_gain"] == 500 and ride["activity_type"] == "ride"  # the CSV wins
    run = props(engine, "sample.tcx")
    assert run["total_distance"] == pytest.approx(kilometres([p[1:] for p in samples.RUN if p[1] is not None]), abs=1e-4) and (run["elapsed_time"], run["moving_time"], run["max_speed"]) == (384, 0, 0.0)  # 06:12:07 to 06:18:31, no two places within a minute
    assert "average_speed" not in run and "min_elevation" not in run
    loop = props(engine, "sample.fit")
    assert loop["manufacturer"] == "garmin" and loop["total_calories"] == 1188 and loop["elapsed_time"] == 590
    assert engine.import_path(str(folder / "activities"))["imported"] == 0 and engine.count() == 3


def test_listing_filters_and_stats(engine):
    one = [r.file for r in engine.activities(filter="activity_type in [ride, run]", before=date(2025, 9, 1)).collect()]
    assert len(one) == 1 and one[0].endswith("sample.gpx")
    assert engine.count(filter="manufacturer != garmin") == 2
    assert engine.count(filter="manufacturer = garmin") == 1
    assert engine.count(before=date(2023, 7, 1)) == 1 and engine.count(after=date(2100, 1, 1)) == 0
    lines = [json.loads(r.value) for r in engine.json_lines().collect()]
    assert len(lines) == 3 and all(x["tile_count"] >= 1 for x in lines) and lines[0]["properties"]
    s = {r["key"]: (r["count"], r["types"]) for r in engine.properties().collect()}
    assert s["total_distance"] == (3, ["number"]) and s["manufacturer"] == (1, ["string"])


def test_images(engine):
    data = engine.tile("14/8800/5374", 256)
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    assert engine.tile("17/0/0") is None
    assert engine.tile_pixels("10/550/335", 256).count() > 0
    plan = engine.tile_pixels("10/550/335", 256)._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "PartitionFilters" in x and "(z#" in x)
    assert "GreaterThanOrEqual(x,550)" in scan and "coords:array" in scan
    assert engine.render("13.2,52.4,13.5,52.6", 300, 200)[:4] == b"\x89PNG"
    with pytest.raises(ValueError):
        engine.render("13,52,14,53", 4000)
    with pytest.raises(ValueError):
        engine.tile("10/1/1", color="red", gradient="1:fff")


def test_masks(engine, spark):
    before = engine.tile_pixels("10/550/335", 256).count()
    engine.store.add_mask("home", 52.5, 13.35, 9000)
    engine.store.add_mask("home", 52.5, 13.35, 9000.5)
    assert engine.mask_lines() == ["home - 52.50000,13.35000 (radius: 9000.5m)"]
    assert engine.tile_pixels("10/550/335", 256).count() < before
    engine.store.remove_mask("home")
    with pytest.raises(KeyError):
        engine.store.remove_mask("home")
    assert engine.tile_pixels("10/550/335", 256).count() == before


def test_keys_upsert_and_reset(spark, folder, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    got = e.import_path(str(folder / "activities" / "sample.gpx"), str(folder / "export.csv"))
    assert got["imported"] == 1 and [r.file for r in e.store.activities.collect()] == ["strava:19387121985"]
    up = spark.createDataFrame([("x/a.gpx", bytearray(samples.gpx(samples.RIDE)))], "path string, content binary")
    e.upload(up)
    n = e.store.tiles.count()
    e.upload(up)  # the same file again replaces itself and its tiles
    assert e.count() == 2 and e.store.tiles.count() == n
    e.store.reset()
    assert e.count() == 0 and e.store.tiles.count() == 0 and e.tile("2/1/1", 256) is not None
    with pytest.raises(FileNotFoundError):
        Engine(spark, str(tmp_path / "none"), create=False)


def test_two_writers_lose_nothing(spark, folder, tmp_path):
    one, two = Engine(spark, str(tmp_path / "db")), Engine(spark, str(tmp_path / "db"))
    since = one.store._latest()
    up = lambda n: spark.createDataFrame([(n, bytearray(samples.gpx(samples.RIDE)))], "path string, content binary")
    two.upload(up("b.gpx"))
    with pytest.raises(Conflict):  # one began before two ended
        one.store._write({"activities": one.store.activities.limit(0), "activity_tiles": one.store.tiles.limit(0)}, since)
    assert one.count() == 1
    threads = [threading.Thread(target=e.upload, args=(up(f"{n}{i}.gpx"),)) for i in range(2) for n, e in (("x", one), ("y", two))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert one.count() == two.count() == 5
    assert not [x for x in (tmp_path / "db").iterdir() if x.name.startswith(".") and not x.name.endswith(".crc")]


def test_older_stores_are_migrated(spark, tmp_path):
    at = tmp_path / "db"
    spark.sql("select 1L as id, 'f' as file, 't' as title, timestamp '2024-01-01' as start_time, '{\"a\": 1.5}' as properties, timestamp '2024-01-02' as created_at").write.parquet(str(at / "activities" / "part=x"))
    (at / "manifest.json").write_text(json.dumps({"version": 1, "tables": {"activities": "activities/part=x"}}))
    (at / "config.json").write_text(json.dumps({"zoom_levels": [2], "unknown": 1}))
    e = Engine(spark, str(at), create=False)
    assert e.store._latest()[1]["version"] == VERSION and e.count(filter="a > 1") == 1 and e.store.config().zoom_levels == [2]
    assert [json.loads(r.value)["properties"] for r in e.json_lines().collect()] == [{"a": 1.5}]
    e.store._next(e.store._latest()[0], {"version": VERSION + 1, "tables": {}})
    with pytest.raises(ValueError):
        Engine(spark, str(at))


def _units(e):
    """Bucket folders that the latest manifest names, and the data files in them."""
    from pathlib import Path

    found = e.store._named(e.store._latest()[0])
    return found, {str(f) for u in found for f in Path(e.store.path, u).rglob("*.parquet")}


def test_a_replacement_writes_one_bucket(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    up = lambda *names: spark.createDataFrame([(n, bytearray(samples.gpx(samples.RIDE))) for n in names], "path string, content binary")
    e.upload(up(*(f"{i}.gpx" for i in range(40))))
    units, data = _units(e)
    buckets = {u.split("bucket=")[1] for u in units}
    assert len(buckets) > 8 and len({u.split("/")[1] for u in units}) == 1
    before, tiles = e.store.activities, e.store.tiles
    n = tiles.count()
    e.upload(up("7.gpx"))
    new, more = _units(e)
    changed = units ^ new
    assert len({u.split("bucket=")[1] for u in changed}) == 1 and len(changed) == 6  # a bucket of each table, the old and the new
    one = changed.pop().split("/")[-1]
    assert {f for f in data if f"/{one}/" not in f} == {f for f in more if f"/{one}/" not in f}
    assert e.count() == 40 and e.store.tiles.count() == n
    # profiles are replaced with their bucket, and read without the activities
    same = lambda df: sorted((r.key, r["count"], r.types) for r in df.collect())
    assert same(e.properties()) == same(activities.property_stats(e.store.activities)) != []
    assert "/activities/" not in str(e.properties().inputFiles()) and "variant" not in e.properties()._jdf.queryExecution().executedPlan().toString().lower()
    # a reader that began before goes on
    assert before.count() == 40 and tiles.count() == n
    e.upload(up("new.gpx"))
    assert len(_units(e)[0]) == len(new) + 3 and e.count() == 41  # beside what is there


def test_what_no_manifest_names_is_removed(spark, tmp_path, monkeypatch):
    from wayfold import store

    monkeypatch.setattr(store, "KEPT", 3)
    monkeypatch.setattr(store, "PARTS", 2)
    e = Engine(spark, str(tmp_path / "db"))
    up = spark.createDataFrame([("a.gpx", bytearray(samples.gpx(samples.RIDE)))], "path string, content binary")
    for _ in range(5):
        e.upload(up)
    parts = lambda: {p.name for p in (tmp_path / "db" / "activities").iterdir() if any(p.glob("bucket=*"))}
    assert len(parts()) == 3 == len(e.store._numbers())
    (tmp_path / "db" / "activities" / "part=lost" / "bucket=1").mkdir(parents=True)
    assert e.store.vacuum() == 0 and "part=lost" in parts()
    e.store.vacuum(hours=-1)
    assert len(parts()) == 3 and e.count() == 1
    for i in range(5):  # new files of one bucket: never more than PARTS and one parts
        e.upload(spark.createDataFrame([(f"{i}.gpx", bytearray(samples.gpx(samples.RIDE)))], "path string, content binary"))
    assert e.count() == 6 and max(map(len, e.store._latest()[1]["tables"]["activities"].values())) <= 2


def test_two_writers_of_masks_lose_none(spark, tmp_path):
    one, two = Engine(spark, str(tmp_path / "db")).store, Engine(spark, str(tmp_path / "db")).store
    threads = [threading.Thread(target=s.add_mask, args=(f"{n}{i}", 50.0, 10.0 + i, 100.0)) for i in range(3) for n, s in (("x", one), ("y", two))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(m["name"] for m in one.config().activity_mask) == ["x0", "x1", "x2", "y0", "y1", "y2"]


def test_tiles_of_a_column_are_pruned_by_row(spark, tmp_path):
    """Tiles of one x and many y: a tile's read takes in few rows of the zoom, by y as well as by x."""
    import pyarrow.parquet as pq

    from wayfold.store import morton

    e = Engine(spark, str(tmp_path / "db"), create=True)
    side = 128
    tiles = spark.range(side * side).selectExpr("3L as activity_id", "14 as z", f"cast(id % {side} as int) as x", f"cast(id div {side} as int) as y", "array(named_struct('x', 1, 'y', 1), named_struct('x', 9, 'y', 9)) as coords")
    spark.conf.set("parquet.block.size", "20000")
    spark._jsc.hadoopConfiguration().set("parquet.block.size", "20000")
    spark._jsc.hadoopConfiguration().set("parquet.page.size.row.check.min", "100")
    spark._jsc.hadoopConfiguration().set("parquet.block.size.row.check.min", "100")
    try:
        e.store.upsert(e.store.activities.limit(0), tiles)
    finally:
        for k in ("parquet.block.size", "parquet.page.size.row.check.min", "parquet.block.size.row.check.min"):
            spark._jsc.hadoopConfiguration().unset(k)
        spark.conf.unset("parquet.block.size")
    files_ = [f for f in _units(e)[1] if "activity_tiles" in f]
    groups = [pq.ParquetFile(f).metadata.row_group(i) for f in files_ for i in range(pq.ParquetFile(f).num_row_groups)]
    names = {c: next(i for i in range(groups[0].num_columns) if groups[0].column(i).path_in_schema == c) for c in "xy"}
    spans = [tuple((g.column(names[c]).statistics.min, g.column(names[c]).statistics.max) for c in "xy") for g in groups]
    for x in (3, 70):
        of_x = [s for s in spans if s[0][0] <= x <= s[0][1]]
        both = [s for s in of_x if s[1][0] <= 40 <= s[1][1]]
        assert 0 < len(both) <= max(2, len(of_x) / 2) < len(spans)
    at = spark.createDataFrame([(5, 3), (0, 0), (2**22 - 1, 2**22 - 1)], "x int, y int").select(morton(F.col("x"), F.col("y")).alias("m"))
    assert [r.m for r in at.collect()] == [0b011011, 0, 2**44 - 1]


def test_known_files_are_not_opened(spark, folder, tmp_path, monkeypatch):
    e = Engine(spark, str(tmp_path / "db"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a [1] {x}*.gpx").write_bytes(samples.gpx(samples.RIDE))
    opened, real = [], files.opened
    monkeypatch.setattr(files, "opened", lambda spark, at: (opened.append(at.count()), real(spark, at))[1])
    assert e.import_path(str(tmp_path / "in"))["imported"] == 1 and e.import_path(str(tmp_path / "in"))["imported"] == 0
    (tmp_path / "in" / "b.gpx").write_bytes(samples.gpx(samples.RIDE))
    assert e.import_path(str(tmp_path / "in"))["imported"] == 1 and opened == [1, 1]


def test_names_are_listed_by_tasks(spark, tmp_path):
    for d in ("a/b/c", "a/d", ".hidden", "_tmp", "e"):
        (tmp_path / d).mkdir(parents=True)
    for f in ("x.gpx", "a/b/c/é [1]%20.fit", "a/d/y.tcx", "a/d/.z.gpx", ".hidden/h.gpx", "_tmp/t.gpx", "e/_SUCCESS"):
        (tmp_path / f).write_text(f)
    found = files.names(spark, str(tmp_path))
    assert sorted(r.path for r in found.collect()) == sorted(str(tmp_path / f) for f in ("x.gpx", "a/b/c/é [1]%20.fit", "a/d/y.tcx"))
    assert [r.path for r in files.names(spark, f"file:{tmp_path}/x.gpx").collect()] == [str(tmp_path / "x.gpx")]
    gone = found.unionByName(spark.createDataFrame([(str(tmp_path / "no.gpx"),)], "path string"))
    assert {r.path.split("/")[-1]: bytes(r.content).decode() if r.content else None for r in files.opened(spark, gone).collect()} == {"x.gpx": "x.gpx", "é [1]%20.fit": "a/b/c/é [1]%20.fit", "y.tcx": "a/d/y.tcx", "no.gpx": None}
    with pytest.raises(FileNotFoundError):
        files.names(spark, str(tmp_path / "none"))


def test_unknown_keys_by_a_filter(spark):
    known = spark.range(0, 60_000, 2).selectExpr("concat('f', id) as file")
    rows = spark.range(0, 3000).selectExpr("case when id < 2990 then concat('f', id) end as file", "id")
    want = [r.id for r in keys.unknown(rows, known).orderBy("id").collect()]
    assert want == [i for i in range(3000) if i % 2 or i >= 2990]
    assert [r.id for r in keys.unknown(rows, known, few=0).orderBy("id").collect()] == want
    data, bits = keys.bloom(known, "file", 30_000)
    assert len(data) == (1 << bits) // 8 < 100_000 and 0.1 < sum(b.bit_count() for b in data) / (1 << bits) < 0.5
    # few new keys go to the exact join
    new = keys._hashed(spark.range(100_000, 110_000).selectExpr("concat('f', id) as file"), "file").toArrow()
    import numpy as np

    bit = np.unpackbits(np.frombuffer(data, np.uint8))
    maybe = np.logical_and.reduce([bit[at.astype(np.int64)] for at in keys._places(new.column("_one").to_numpy(), new.column("_two").to_numpy(), bits)])
    assert maybe.mean() < 0.03
    assert [r.id for r in keys.unknown(rows, known.limit(0), few=-1).orderBy("id").collect()] == list(range(3000))


class Days:
    """A client of a day: files in folders named by day, and a log of the days that are asked."""

    def __init__(self, at):
        self.at = str(at)

    def __call__(self, day):
        import pathlib

        at = pathlib.Path(self.at)
        with open(at / "asked", "a") as f:
            f.write(f"{day}\n")
        return [(p.name, p.read_bytes()) for p in sorted((at / day.isoformat()).glob("*.gpx"))] if (at / day.isoformat()).is_dir() else []


def test_pull_by_day_and_as_a_stream(spark, tmp_path):
    for day, name in (("2025-03-01", "a"), ("2025-03-02", "b"), ("2025-03-02", "a"), ("2025-03-04", "c"), ("2025-02-01", "old")):
        (tmp_path / day).mkdir(exist_ok=True)
        (tmp_path / day / f"{name}.gpx").write_bytes(samples.gpx(samples.RIDE))
    asked = lambda: (tmp_path / "asked").read_text().split()
    e = Engine(spark, str(tmp_path / "db"))
    assert e.pull(Days(tmp_path), date(2025, 3, 2), lookback=2) == 2 and set(asked()) == {"2025-02-28", "2025-03-01", "2025-03-02"}
    assert e.pull(Days(tmp_path), date(2025, 3, 2), lookback=2) == 0
    s = Engine(spark, str(tmp_path / "stream"))

    def run(until, **options):
        (tmp_path / "asked").write_text("")
        q = landing.ingest_pulled(s, Days(tmp_path), date(2025, 3, 1), str(tmp_path / "cp"), until=until, **options)
        q.processAllAvailable()
        q.stop()
        return sorted(r.file for r in s.store.activities.collect())

    assert run(date(2025, 3, 3)) == ["a.gpx", "b.gpx"] and set(asked()) == {"2025-03-01", "2025-03-02"}
    assert run(date(2025, 3, 3)) == ["a.gpx", "b.gpx"] and asked() == []  # restarted: nothing is asked again
    (tmp_path / "2025-03-02" / "late.gpx").write_bytes(samples.gpx(samples.RIDE))
    before = s.store._latest()[0]
    assert run(date(2025, 3, 5), lookback=1) == ["a.gpx", "b.gpx", "c.gpx", "late.gpx"] and set(asked()) == {"2025-03-02", "2025-03-03", "2025-03-04"}
    assert s.count() == 4 and s.store._latest()[0] == before + 1


def test_properties_are_parsed_once(spark, engine):
    text = spark.createDataFrame([(1, '{"a": 1, "b": "x"}')], "id int, properties string").selectExpr("id", "properties", "current_timestamp() as start_time")
    condition = "a in [1, 2, x] && (b > 3 || b like 'x%') || has? c"
    plan = activities.matching(text, filter=condition)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json") + plan.lower().count("parsejson") == 1
    plan = activities.matching(engine.store.activities, filter=condition)._jdf.queryExecution().optimizedPlan().toString()
    assert "parse" not in plan.lower()
    assert activities.matching(text, filter=condition).count() == 1


FILTERS = ["activity_type = ride", "activity_type in [ride, 3, true]", "activity_type < run", "activity_type <= 'run'", "activity_type > run", "total_distance > 20", "total_distance >= 20 && activity_type = ride", "total_distance < 20 || activity_type = run", "total_distance < 20 || note = x", "!(activity_type = ride)", "activity_type != ride", "has? total_distance", "activity_type like 'R%'", "total_distance = 7", "total_distance = true", "note = x && has? activity_type", "total_distance in ['20', 20]", "total_distance > 'a'"]


def test_filters_skip_by_typed_copies(spark, tmp_path):
    """Every filter finds with the typed copies what it finds without, whatever kinds of values a key has; a scan reads few row groups."""
    import pyarrow.parquet as pq

    kinds = ['"ride"', '"run"', '"Walk"', "3", "true", "null", "[1]", '{"a": 1}', None]
    rows = []
    for i in range(400):
        p = {"activity_type": kinds[i % 9], "total_distance": ["20", "20.5", "7", "-1e3", '"20"', "false", None, '"b"'][i % 8], "note": '"x"' if i % 5 == 0 else None}
        rows.append((i, f"f{i}", "{" + ", ".join(f'"{k}": {v}' for k, v in p.items() if v is not None) + "}"))
    new = spark.createDataFrame(rows, "id long, file string, json string").selectExpr("xxhash64(file) as id", "file", "'t' as title", "timestamp '2024-01-01' as start_time", "parse_json(json) as properties", "current_timestamp() as created_at")
    e = Engine(spark, str(tmp_path / "db"))
    e.store.upsert(new, e.store.tiles)
    for f in FILTERS:
        want = sorted(r.file for r in activities.matching(new, filter=f).collect())
        assert sorted(r.file for r in activities.matching(e.store.activities, filter=f).collect()) == want, f
    plan = activities.matching(e.store.activities, filter="activity_type = ride && note = x")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(hot.activity_type.text,ride)" in plan
    plan = activities.matching(e.store.activities, filter="total_distance > 20 || note = x")._jdf.queryExecution().executedPlan().toString()
    assert "hot.total_distance" not in plan.split("PushedFilters")[1].split("]")[0]
    # files are sorted by it: those of other types end before or begin after
    at = [(m.min, m.max) for f in _units(e)[1] if "/activities/" in f for g in [pq.ParquetFile(f).metadata] for i in range(g.num_row_groups) for c in range(g.num_columns) if g.row_group(i).column(c).path_in_schema == "hot.activity_type.text" and (m := g.row_group(i).column(c).statistics).has_min_max]
    assert at and all(a <= z for a, z in at)
    one = spark.range(60_000).selectExpr("id", "concat('g', id) as file", "'t' as title", "timestamp '2024-01-01' as start_time", "parse_json(concat('{\"activity_type\": \"', element_at(array('hike', 'ride', 'run', 'swim'), cast(id % 4 as int) + 1), '\"}')) as properties", "current_timestamp() as created_at").withColumn("id", F.lit(5).cast("long"))
    big = Engine(spark, str(tmp_path / "big"))
    spark._jsc.hadoopConfiguration().set("parquet.block.size", "40000")
    spark._jsc.hadoopConfiguration().set("parquet.block.size.row.check.min", "100")
    try:
        big.store.upsert(one, big.store.tiles)
    finally:
        for k in ("parquet.block.size", "parquet.block.size.row.check.min"):
            spark._jsc.hadoopConfiguration().unset(k)
    found = activities.matching(big.store.activities, filter="activity_type = ride")
    assert found.count() == 15_000
    q = found.select("file")
    q.collect()
    plan = q._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    scanned = leaves.apply(0).metrics().apply("numOutputRows").value()
    assert 15_000 <= scanned < 45_000  # of 60,000: row groups of other types were not read


def test_webhook_and_pull(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    line = polyline.encode([(52.5 + i * 1e-3, 13.3 + i * 1e-3) for i in range(9)])
    body = {"id": 7, "name": "Lunch", "map": {"polyline": line}, "start_date": "2024-05-01T10:00:00Z", "total_elevation_gain": 12.5, "type": "Ride", "distance": 2500.0, "average_speed": 5.0, "max_speed": 10.0, "gear": {"id": "g1", "name": "Bike"}, "laps": [1], "kudos": 3}
    lacking = [(json.dumps({k: v for k, v in body.items() if k != gone}),) for gone in ("id", "name", "map", "start_date", "type", "distance", "average_speed", "max_speed")]
    rows = [(json.dumps(body),), (json.dumps(body | {"id": 8, "type": "VirtualRide"}),), ("{broken",), *lacking]
    assert e.webhook(spark.createDataFrame(rows, "body string")) == {"imported": 1, "skipped": 1, "failed": 9}
    p = props(e, "strava:7")
    assert (p["total_distance"], p["average_speed"], p["max_speed"], p["activity_gear"], p["gear_id"], p["kudos"]) == (2.5, 18.0, 36.0, "Bike", "g1", 3)
    assert p["activity_type"] == "Ride" and p["elevation_gain"] == 12.5 and "laps" not in p
    assert (p["id"], p["start_date"], p["min_elevation"], p["max_elevation"]) == (7, "2024-05-01T10:00:00Z", 0, 0) and "map" not in p and "name" not in p
    asked = []

    def client(since):
        asked.append(since)
        return [("pulled/1.fit", samples.fit(samples.LOOP)), ("pulled/1.fit", samples.fit(samples.LOOP))]

    assert e.fetch(client, date(2025, 3, 31)) == 1 and asked == [date(2025, 3, 1)]
    assert e.fetch(client, date(2025, 3, 31)) == 0


def test_streaming(spark, folder, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    (tmp_path / "land").mkdir()
    (tmp_path / "land" / "a.gpx").write_bytes(samples.gpx(samples.RIDE))
    for _ in range(2):
        landing.ingest(e, str(tmp_path / "land"), str(tmp_path / "cp")).awaitTermination(120)
        assert e.count() == 1
        (tmp_path / "land" / "skip.txt").write_text("x")


def test_repeated_deliveries_reach_the_store_once(spark, tmp_path):
    """In one batch, in a later one, and after a restart; a changed file of the same name is another."""
    e = Engine(spark, str(tmp_path / "db"))
    land = tmp_path / "land"
    for d in ("1", "2", "3", "4"):
        (land / d).mkdir(parents=True)
    version = lambda: e.store._latest()[0]

    def run():
        landing.ingest(e, str(land), str(tmp_path / "cp")).awaitTermination(180)
        return e.count(), version()

    (land / "1" / "a.gpx").write_bytes(samples.gpx(samples.RIDE))
    (land / "2" / "a.gpx").write_bytes(samples.gpx(samples.RIDE))
    n, one = run()
    assert n == 1
    (land / "3" / "a.gpx").write_bytes(samples.gpx(samples.RIDE))
    assert run() == (1, one)  # nothing was written
    (land / "4" / "a.gpx").write_bytes(samples.gpx(samples.RIDE, kind="walk"))
    n, two = run()
    assert n == 1 and two == one + 1 and e.count(filter="activity_type = walk") == 1
    body = json.dumps({"id": 7, "map": {"polyline": polyline.encode([(52.5 + i * 1e-3, 13.3) for i in range(9)])}, "type": "Ride", "name": "Lunch", "start_date": "2024-05-01T10:00:00Z", "distance": 900, "average_speed": 5, "max_speed": 6})
    (tmp_path / "hooks").mkdir()
    for name in ("x", "y"):
        (tmp_path / "hooks" / name).write_text(body)
        landing.ingest_webhooks(e, str(tmp_path / "hooks"), str(tmp_path / "cp2")).awaitTermination(180)
    assert e.count() == 2 and version() == two + 1


def test_fit_decoder():
    got = fit.parse(samples.fit(samples.LOOP, chained=True))
    assert len(got["points"]) == 120 and got["points"][3][2] == 43 and got["start_time"] == 1_000_000_000 + fit.EPOCH
    assert got["points"][5][:2] == pytest.approx(samples.LOOP[5][:2], abs=1e-6)
    assert got["properties"]["manufacturer"] == "garmin" and not {"start_time", "sub_sport"} & set(got["properties"])
    assert fit.parse(samples.fit(samples.LOOP, sub_sport=58)) is None and fit.parse(samples.fit([])) is None
    for bad in (b"", b"x" * 40, samples.fit(samples.LOOP)[:200]):
        with pytest.raises((ValueError, IndexError)):
            fit.parse(bad)


def test_polyline():
    pts = [(52.5, 13.4), (52.50123, 13.39876), (-3.25, 179.99999), (0.0, 0.0)]
    assert polyline.decode(polyline.encode(pts)) == pts
    # by hand: 1e-5 degrees is 1, doubled to 2, so "A" (63 + 2); minus 1 is turned over to 1, so "@"
    assert polyline.encode([(0.00001, -0.00001)]) == "A@" and polyline.decode("A@") == [(0.00001, -0.00001)]
    for bad in ("_", " ", polyline.encode([(50.0, 0.0)])[:-1]):
        with pytest.raises(ValueError):
            polyline.decode(bad)


def test_cli(spark, folder, tmp_path, engine):
    def run(*argv):
        out = io.StringIO()
        cli.run(cli.parser().parse_args(["--db", engine.store.path, *argv]), spark, out)
        return out.getvalue()

    assert run("activities", "--count", "--filter", "has? manufacturer") == "1\n"
    assert len(run("activities").splitlines()) == 3
    run("tile", "10/550/335", "--width", "256", "--output", str(tmp_path / "t.png"))
    assert (tmp_path / "t.png").read_bytes()[:4] == b"\x89PNG"
    run("mask", "add", "work", "52.5,13.4", "150")
    assert run("mask") == "work - 52.50000,13.40000 (radius: 150m)\n"
    run("mask", "remove", "work")
    assert run("fetch", "mine", "--client", "tests.samples:pulled", "--lookback", "3") == "0 from mine\n"
    with pytest.raises(ValueError):
        run("fetch", "mine", "--client", "tests.samples:nothing")
    with pytest.raises(ValueError):
        cli.run(cli.parser().parse_args(["--in-memory", "activities"]), spark)
    with pytest.raises(FileNotFoundError):
        cli.run(cli.parser().parse_args(["--db", str(tmp_path / "no"), "activities"]), spark)


def test_http(spark, tmp_path, monkeypatch):
    assert split_size("7@2x") == ("7", 1024) and split_size("7") == ("7", 512)
    form = b'--b\r\nContent-Disposition: form-data; name="file"; filename="a.gpx"\r\n\r\n' + samples.gpx(samples.RIDE) + b'\r\n--b\r\nContent-Disposition: form-data; name="other"\r\n\r\nx\r\n--b--\r\n'
    kind = "multipart/form-data; boundary=b"
    assert [n for n, _ in uploads(kind, form)] == ["a.gpx"]
    monkeypatch.setenv("WAYFOLD_UPLOAD_TOKEN", "secret")
    monkeypatch.setenv("WAYFOLD_WEBHOOK_TOKEN", "hook")

    def broken(since):
        raise OSError("no network")

    line = polyline.encode([(52.5 + i * 1e-3, 13.3 + i * 1e-3) for i in range(9)])
    pace = {"distance": 900, "average_speed": 1.5, "max_speed": 2}
    details = {1: {"id": 1, "name": "a", "map": {"polyline": line}, "start_date": "2024-05-01T10:00:00Z", "type": "Walk", **pace}, 2: {"id": 2, "name": "b", "map": {"polyline": line}, "start_date": "2024-05-02T10:00:00Z", "type": "VirtualRun", **pace}}
    s = server(Engine(spark, str(tmp_path / "db")), upload=True, render=True, cors=True, fetch=True, webhook=True, sources={"mine": lambda since: [("mine/1.fit", samples.fit(samples.LOOP))], "broken": broken}, detail=lambda owner, activity: details[activity])
    threading.Thread(target=s.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{s.server_port}"

    def get(path, data=None, **headers):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, data, headers), timeout=120) as r:
                return r.status, r.read(), r.headers
        except urllib.error.HTTPError as e:
            return e.code, e.read(), e.headers

    try:
        code, _, head = get("/tile/10/550/335@small")
        assert code == 204
        tag = head["ETag"]
        assert get("/tile/10/550/335@small", If_None_Match=tag)[0] in (204, 304)
        assert get("/tile/10/550/335@small", **{"If-None-Match": tag})[0] == 304
        assert get("/upload", form, **{"Content-Type": kind})[0] == 401
        auth = {"Authorization": "Bearer secret", "Content-Type": kind}
        assert get("/upload", b"--b--\r\n", **auth)[0] == 400
        assert get("/upload", form.replace(b"a.gpx", b"a.txt"), **auth)[0] == 415
        assert get("/upload", form, **auth)[0] == 200
        code, data, head = get("/tile/10/550/335@small", **{"If-None-Match": tag})
        assert code == 200 and data[:4] == b"\x89PNG" and head["ETag"] != tag
        assert get("/api/activity-count?filter=activity_type%20%3D%20ride")[1] == b"1"
        assert get("/tile/17/1/1")[0] == 404 and get("/tile/2/x/1")[0] == 400 and get("/tile/2/1/1@big")[0] == 400
        assert get("/api/activity-count?filter=%3D")[0] == 400
        assert "total_distance" in json.loads(get("/")[1])["properties"]
        assert get("/fetch/mine", b"")[0] == 401
        assert get("/fetch/mine?lookback=7", b"", **auth)[:2] == (200, b"ingested 1 activities")
        assert get("/fetch/mine", b"", **auth)[:2] == (200, b"ingested 0 activities")
        assert get("/fetch/other", b"", **auth)[0] == 404 and get("/fetch/broken", b"", **auth)[0] == 500 and get("/fetch/mine?lookback=x", b"", **auth)[0] == 400
        hook = "/strava/webhook?hub.mode=subscribe&hub.challenge=abc&hub.verify_token="
        assert json.loads(get(hook + "hook")[1]) == {"hub.challenge": "abc"} and get(hook + "no")[0] == 401
        assert get("/strava/webhook?hub.mode=other")[0] == 400
        event = lambda kind, i: get("/strava/webhook", json.dumps({"object_type": kind, "object_id": i, "owner_id": 5}).encode())[:2]
        assert event("athlete", 1) == (200, b"nothing to do") and event("activity", 1) == (200, b"added!")
        assert event("activity", 2)[0] == 204 and event("activity", 3)[0] == 500 and get("/strava/webhook", b"{")[0] == 400
        assert get("/api/activity-count?filter=activity_type%20%3D%20Walk")[1] == b"1"
    finally:
        s.shutdown()
