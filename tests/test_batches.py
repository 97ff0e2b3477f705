"""Python in tasks takes Arrow batches a bounded piece at a time, whatever the session lets a batch hold."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql.types import StructType

from wayfold.plans import imports
from wayfold.sources import batches, files, polyline

LINE = pa.list_(pa.struct([("lat", pa.float64()), ("lng", pa.float64())]))


class Frame:
    """What a frame tells those that map it; keeps the function of batches."""

    def __init__(self, spark, ddl):
        self.sparkSession, self.schema = spark, StructType.fromDDL(ddl)

    def select(self, *columns):
        return self

    def mapInArrow(self, run, ddl):  # noqa: N802
        self.run = run
        return self


def test_pieces_hold_all_rows_in_order():
    texts = ["x" * n for n in (5, 0, 99, 3, 3, 300, 1)] + [None]
    batch = pa.RecordBatch.from_pydict({"i": list(range(8)), "t": pa.array(texts, pa.string())})
    got = [p.column("i").to_pylist() for p in batches.pieces([batch, batch.slice(0, 0), batch.slice(6, 2)], "t", size=100)]
    assert got == [[0, 1, 2], [3, 4, 5], [6, 7], [6, 7]]
    lines = pa.RecordBatch.from_pydict({"p": pa.array([[1, 2], None, [3] * 9, [4]], pa.list_(pa.int64()))})
    assert [p.num_rows for p in batches.pieces([lines], "p", size=3 * batches.ITEM)] == [3, 1]


def test_lines_are_made_objects_by_pieces(spark):
    points = [[{"lat": 52 + i % 7 / 1000, "lng": 13 - k / 1e5} for k in range(i % 40)] if i % 50 else None for i in range(5_000)]
    batch = pa.RecordBatch.from_pydict({"i": pa.array(range(5_000)), "p": pa.array(points, LINE)})
    out = list(polyline.encoded(Frame(spark, "i bigint, p array<struct<lat: double, lng: double>>"), "p", "line").run([batch]))
    assert len(out) > 5 and max(b.num_rows for b in out) < 1_000
    lines = pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    assert lines.column("line").to_pylist() == [None if p is None else polyline.encode([(q["lat"], q["lng"]) for q in p]) for p in points]
    long = pa.RecordBatch.from_pydict({"line": pa.array([*lines.column("line").to_pylist(), "_", None] * 8, pa.string())})
    out = list(polyline.decoded(Frame(spark, "line string"), "line", "q").run([long]))
    assert len(out) > 1
    back = [x for b in out for x in b.column("q").to_pylist()]
    assert back[-2:] == [None, None] and back[0] is None and back[50] is None and [len(x) for x in back[1:50]] == [i % 40 for i in range(1, 50)]
    assert np.allclose([[p["lat"], p["lng"]] for p in back[39]], [[p["lat"], p["lng"]] for p in points[39]], atol=1e-5)


def test_files_are_made_and_unpacked_by_pieces(spark):
    point = [{"seq": i, "lng": 13.3, "lat": 52.5, "ele": None, "t": 1_000_000_000 + i, "time": "x"} for i in range(50)]
    kinds = pa.list_(pa.struct([("seq", pa.int64()), ("lng", pa.float64()), ("lat", pa.float64()), ("ele", pa.float64()), ("t", pa.int64()), ("time", pa.string())]))
    n = 2_000
    rows = pa.RecordBatch.from_pydict({
        "path": pa.array([f"{i}{('.fit', '.gpx.gz')[i % 2]}" for i in range(n)]), "content": pa.array([b"g" * 1_000 if i % 2 else None for i in range(n)], pa.binary()),
        "p": pa.array([None if i % 2 else point for i in range(n)], kinds), "virtual": pa.array([False] * n), "broken": pa.array([i % 100 == 1 for i in range(n)]),
    })
    made = list(imports._finished([rows]))
    assert len(made) > 5 and max(b.num_rows for b in made) < 400
    whole = pa.Table.from_batches(made).combine_chunks().to_batches()[0]
    assert whole.column("path").equals(rows.column("path"))
    packed = pa.RecordBatch.from_arrays([whole.column("path"), pa.array(["gpx"] * n), pa.array([i % 2 == 1 for i in range(n)]), whole.column("content")], ["path", "kind", "gz", "content"])
    out = list(files.unzipped(Frame(spark, "path string, content binary")).run([packed]))
    assert len(out) > 2
    got = [c for b in out for c in b.column("content").to_pylist()]
    assert got[1] is None and got[101] is None and got[3] == b"g" * 1_000 and got[0] == whole.column("content")[0].as_py() and got[0][8:12] == b".FIT"
    assert [p for b in out for p in b.column("path").to_pylist()] == rows.column("path").to_pylist()


def test_files_are_saved_one_at_a_time(tmp_path):
    batch = pa.RecordBatch.from_pydict({"path": [f"{tmp_path}/f/{i}.gpx" for i in range(100)], "content": pa.array([bytes([i]) * 100_000 for i in range(100)], pa.binary())})
    list(imports._saved([batch.slice(0, 1)]))  # what the first call imports isn't counted
    tracemalloc.start()
    try:
        (told,) = imports._saved([batch])
        assert tracemalloc.get_traced_memory()[1] < 2_000_000
    finally:
        tracemalloc.stop()
    assert told.column("n").to_pylist() == [100] and (tmp_path / "f" / "99.gpx").read_bytes() == b"c" * 100_000


def test_session_setting_is_kept(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    try:
        spark.conf.unset(name)
        polyline.decoded(Frame(spark, "line string"), "line", "q")
        assert int(spark.conf.get(name)) == batches.BATCH
        spark.conf.set(name, 1 << 20)
        polyline.decoded(Frame(spark, "line string"), "line", "q")
        assert int(spark.conf.get(name)) == 1 << 20
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
