"""The queries that go through files, against DuckDB over the events that the files are made of."""

import random
from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from wayfold.plans import catalogue, imports
from wayfold.sources import files, metadata


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Events of users with many points, with two, and with one; of all kinds of files, virtual and broken ones among them."""
    at, r = tmp_path_factory.mktemp("tables"), random.Random(5)
    rows = []
    for user in range(1, 36):
        at_time = datetime(2024, 1, 1)
        for _ in range(1 if user == 9 else 2 if user == 10 else r.randint(15, 50)):
            at_time += timedelta(hours=r.choice([1, 4, 9, 20]))
            k = r.randint(0, 40)
            rows.append({"event_id": len(rows), "ts": at_time, "user_id": user, "event_type": r.choice(["click", "error", "view"]), "value": round(r.uniform(0, 90), 2), "props": f'{{"k": {k}}}'})
    pq.write_table(pa.Table.from_pylist(rows), f"{at}/events.parquet")
    return str(at)


def plain(rows, names):
    numbers = lambda v: v if v is None or isinstance(v, str) else float(v)
    return sorted((tuple(numbers(r[names.index(c)]) for c in sorted(names)) for r in rows), key=str)


@pytest.mark.parametrize("name", ["parsed_files", "stored_import", "stored_profile", "stored_filter", "webhook_activities", "palettes", "stored_raster_z11"])
def test_query_equals_sql(spark, tables, name):
    got = catalogue.QUERIES[name](spark, tables)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tables}/events.parquet'")
    want = con.execute(catalogue.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = plain([tuple(r) for r in got.collect()], got.columns)
    assert rows and rows == plain(want.fetchall(), names)


def test_files_of_all_kinds(spark, tables):
    rows = {r["path"]: bytes(r["content"]) for r in imports.user_files(spark, tables).collect()}
    assert len(rows) == 35
    assert rows["files/4.gpx"].startswith(b"<?xml") and rows["files/3.gpx.gz"][:2] == b"\x1f\x8b" and rows["files/2.fit"][8:12] == b".FIT"
    status = {r["path"]: r["status"] for r in catalogue.QUERIES["parsed_files"](spark, tables).collect()}
    assert status["files/20.gpx"] == "skipped" and status["files/10.fit"] == "skipped" and status["files/7.gpx.gz"] == "failed" and status["files/5.tcx"] == "imported"


def test_times_of_files_do_not_follow_the_session(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Lima")
        assert spark.range(1).select(imports._utc(F.lit(86_399))).first()[0] == "1970-01-01T23:59:59Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_cells_keep_their_spaces(spark, tmp_path):
    (tmp_path / "m.csv").write_text('Filename,Sport Name,Rank,Blank\na.gpx, Trail Run ," 7 ",  \n b.gpx,x,y,z\n')
    rows = {r["path"]: dict(r["more"]) for r in metadata.read(spark, f"{tmp_path}/m.csv").collect()}
    assert rows == {f"{tmp_path}/a.gpx": {"sport_name": '" Trail Run "', "rank": "7"}, f"{tmp_path}/ b.gpx": {"sport_name": '"x"', "rank": '"y"', "blank": '"z"'}}


def test_metadata_by_uri_has_the_names_that_are_listed(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.gpx").write_text("x")
    (tmp_path / "m.csv").write_text("Filename,Rank\nf/a.gpx,7\n")
    known = metadata.read(spark, f"file://{tmp_path}/m.csv")
    assert [dict(r["more"]) for r in files.names(spark, f"file://{tmp_path}/f").join(known, "path").collect()] == [{"rank": "7"}]
