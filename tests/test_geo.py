import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import raster, tiling
from wayfold.plans import gradients


def test_places_by_formula():
    """Own places, with what the definitions of the projection give for them."""
    assert geo.point(0.0, 0.0) == pytest.approx((0, 0), abs=1e-6)
    assert geo.point(180.0, 0.0) == pytest.approx((math.pi * geo.RADIUS, 0), abs=1e-6)
    # the latitude at which a square map ends
    end = math.degrees(2 * math.atan(math.exp(math.pi)) - math.pi / 2)
    assert geo.point(-180.0, end) == pytest.approx((-geo.HALF, geo.HALF), abs=1e-3)
    for lng, lat in ((9.9937, 53.5511), (-43.2, -22.9), (151.2, -33.86)):
        p = geo.point(lng, lat)
        assert p == pytest.approx((geo.RADIUS * math.radians(lng), geo.RADIUS * math.asinh(math.tan(math.radians(lat)))))
        for z in (0, 3, 9, 16):
            x, y = geo.point_tile(*p, z)
            assert (x, y) == (int((lng + 180) / 360 * 2**z), int((1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * 2**z))
            left, bottom, right, top = geo.tile_bounds(x, y, z)
            assert left <= p[0] < right and bottom < p[1] <= top and right - left == pytest.approx(geo.CIRCLE / 2**z)
    assert geo.point(0, -90) is None and geo.point(0, 90) is None and geo.point(0, -89.9999) is not None


def test_columns_equal_driver_values(spark):
    rows = [(-58.3816, -34.6037), (-179.9, -80.0), (13.4, 52.5), (0.0, 0.0), (5.0, 90.0), (5.0, -90.0)]
    df = spark.createDataFrame(rows, "lng double, lat double")
    x, y = geo.mercator(F.col("lng"), F.col("lat"))
    tx, ty = geo.tile(x, y, 14)
    for r in df.select("lng", "lat", x.alias("x"), y.alias("y"), tx.alias("tx"), ty.alias("ty"), geo.haversine(F.col("lng"), F.col("lat"), F.lit(0.0), F.lit(0.0)).alias("d")).collect():
        want = geo.point(r.lng, r.lat)
        assert (r.x is None) == (want is None)
        if want:
            assert (r.x, r.y) == pytest.approx(want) and (r.tx, r.ty) == geo.point_tile(*want, 14)
        h = math.sin(math.radians(r.lat) / 2) ** 2 + math.cos(math.radians(r.lat)) * math.sin(math.radians(r.lng) / 2) ** 2
        assert r.d == pytest.approx(2 * geo.MEAN_RADIUS * math.asin(math.sqrt(h)))


@pytest.mark.parametrize("line,want", [((-1, 5, 11, 5), ((0, 5), (10, 5))), ((2, 2, 3, 3), ((2, 2), (3, 3))), ((-5, -5, -1, 20), None), ((5, -1, 5, 4), ((5, 0), (5, 4))), ((10, 0, 10, 10), ((10, 0), (10, 10))), ((11, 0, 11, 10), None), ((3, 3, 3, 3), ((3, 3), (3, 3))), ((-1, 9.5, 2, 12.5), None), ((-1, 9, 2, 12), ((0, 10), (0, 10)))])
def test_clip(spark, line, want):
    box = (0.0, 0.0, 10.0, 10.0)
    a, b, low, high = (np.array([p], float) for p in (line[:2], line[2:], box[:2], box[2:]))
    meets, start, end = tiling._clipped(a, b, low, high)
    got = (tuple(start[0].tolist()), tuple(end[0].tolist())) if meets[0] else None
    assert got == (want and tuple(tuple(map(float, p)) for p in want))
    df = spark.createDataFrame([tuple(map(float, line))], "a double, b double, c double, d double")
    t0, t1 = geo.clip(*(F.col(c) for c in "abcd"), tuple(map(F.lit, box)))
    r = df.select(t0.alias("t0"), t1.alias("t1"), geo.outcode(F.col("a"), F.col("b"), tuple(map(F.lit, box))).alias("o")).first()
    if want is None:
        assert r.t0 is None
    else:
        at = lambda t: (line[0] + t * (line[2] - line[0]), line[1] + t * (line[3] - line[1]))
        assert at(r.t0) == pytest.approx(want[0]) and at(r.t1) == pytest.approx(want[1])
    assert r.o == (line[0] < 0) + 2 * (line[0] > 10) + 4 * (line[1] < 0) + 8 * (line[1] > 10)


def test_parsers_and_ranges():
    assert geo.parse_tile("3/2/1") == (3, 2, 1)
    assert geo.descendants(1, 2, 3, 5) == (4, 8, 8, 12)
    assert geo.source_zoom([6, 2, 14], 2) == 6 and geo.source_zoom([6], 7) is None
    assert geo.parse_viewport("13,52,x,14,53") == (13, 52, 14, 53)
    for bad in ("1/2", "a/b/c", "1/2/0", "2/-1/0"):
        with pytest.raises(ValueError):
            geo.parse_tile(bad)
    for bad in ("1,2,3", "14,52,13,53", "13,53,14,52"):
        with pytest.raises(ValueError):
            geo.parse_viewport(bad)
    for bad in ("91,0", "0,181", "x,1", "1"):
        with pytest.raises(ValueError):
            geo.parse_point(bad)
    with pytest.raises(ValueError):
        geo.descendants(0, 0, 5, 3)


def test_gradients():
    p = gradients.palette("1:0a0b0c;21:4cd;61:203040;255:e0e0e080")
    assert [bytes(p[i]).hex() for i in (0, 1, 21, 61, 255)] == ["00000000", "0a0b0cff", "44ccddff", "203040ff", "e0e0e080"]
    assert bytes(p[41]).hex() == "327e8eff"  # half way from 21 to 61
    for bad in ("", "1", "1:12", "300:fff", "x:fff", "1:ggg"):
        with pytest.raises(ValueError):
            gradients.palette(bad)
    with pytest.raises(ValueError):
        gradients.choose("red", "1:fff", "orange")


def test_bresenham_equals_error_terms(spark):
    def walk(x0, y0, x1, y1):
        dx, dy = abs(x1 - x0), abs(y1 - y0)
        steep = dy > dx
        if steep:
            x0, y0, x1, y1, dx, dy = y0, x0, y1, x1, dy, dx
        sx, sy, y, out = (1 if x1 >= x0 else -1), (1 if y1 >= y0 else -1), y0, []
        for i in range(dx + 1):
            m = i * dy // dx if dx else 0
            x, y = x0 + sx * i, y0 + sy * m
            out.append((y, x) if steep else (x, y))
        return out

    lines = [(i, *line) for i, line in enumerate([(0, 0, 7, 3), (7, 3, 0, 0), (2, 9, 2, 1), (5, 5, 5, 5), (0, 0, -6, 5), (3, 1, 1, 12)])]
    df = spark.createDataFrame(lines, "i long, x0 long, y0 long, x1 long, y1 long")
    got = {}
    df = df.withColumnRenamed("i", "k")
    for r in raster.bresenham(df, ["k"]).collect():
        got.setdefault(r.k, []).append((r.px, r.py))
    for i, *line in lines:
        assert sorted(got[i]) == sorted(walk(*line))
