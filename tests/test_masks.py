import numpy as np

from wayfold.functions import geo
from wayfold.operators import masks


def random_masks(rng, n):
    radius = 10 ** rng.uniform(0.5, 6.5, n)
    return [(f"m{i}", float(x), float(y), float(r)) for i, (x, y, r) in enumerate(zip(rng.normal(1.4e6, 4e5, n), rng.normal(6.8e6, 4e5, n), radius))]


def test_masks_are_found_by_cell(spark):
    rng = np.random.default_rng(2)
    some = random_masks(rng, 60) + [("edge", -geo.HALF + 5, geo.HALF - 5, 100.0), ("all", 0.0, 0.0, 3e7), ("point", 1.4e6, 6.8e6, 0.0)]
    small = [m for m in some if m[3] < 2e5] + [("edge2", 1.0, 1.0, 50.0)]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.normal(1.4e6, 3e5, 500), rng.normal(6.8e6, 3e5, 500)))] + [(900, -geo.HALF + 1, geo.HALF - 1), (901, 1.4e6, 6.8e6), (902, -geo.HALF - 40, 0.0)]
    p = spark.createDataFrame(points, "id long, mx double, my double")
    kept = masks.BROADCAST
    for of in (some, small, []):
        m = spark.createDataFrame(of, "name string, cx double, cy double, radius double")
        want = {i for i, x, y in points if any((x - cx) ** 2 + (y - cy) ** 2 <= r * r for _, cx, cy, r in of)}
        for limit in (kept, 0):
            masks.BROADCAST = limit
            got = [r.id for r in masks.covered(p, m, ["id"]).collect()]
            assert len(got) == len(set(got)) and set(got) == want
        masks.BROADCAST = kept
    for z in (3, 9, 14):
        tiles = sorted({geo.point_tile(x, y, z) for _, x, y in points if x > -geo.HALF})
        t = spark.createDataFrame(tiles, "x long, y long")
        m = spark.createDataFrame(some, "name string, cx double, cy double, radius double")
        want = set()
        for x, y in tiles:
            left, bottom, right, top = geo.tile_bounds(x, y, z)
            want |= {(x, y, n) for n, cx, cy, r in some if (cx - max(left, min(cx, right))) ** 2 + (cy - max(bottom, min(cy, top))) ** 2 <= r * r}
        got = [tuple(r) for r in masks.touched(t, z, m).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_many_masks_need_no_nested_loop(spark):
    n = 100_000
    m = spark.range(n).selectExpr("concat('m', id) as name", "1400000 + (id % 317) * 700.0D as cx", "6800000 + (id div 317) * 700.0D as cy", "cast(20 + id % 90 as double) as radius")
    p = spark.range(50_000).selectExpr("id", "1400000 + (id * 7919 % 220000) * 1.0D as mx", "6800000 + (id * 104729 % 220000) * 1.0D as my")
    out = masks.covered(p, m, ["id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    x, y = np.array([(r.mx, r.my) for r in p.collect()]).T
    k = np.arange(n)
    hit = 0
    for i in range(0, len(x), 1000):  # by brute force, in blocks
        d = (x[i : i + 1000, None] - (1400000 + (k % 317) * 700.0)) ** 2 + (y[i : i + 1000, None] - (6800000 + (k // 317) * 700.0)) ** 2
        hit += int((d <= (20.0 + k % 90) ** 2).any(1).sum())
        if i >= 4000:
            break
    assert out.where("id < 5000").count() == hit > 0
