"""Visit-count rasters of stored tile polylines: one job for all tiles of an image.

Vertices are scaled and masked, paired, cut to the target tile and drawn by closed-form
Bresenham, all as Column expressions; the only shuffle is the pixel count, whose map side
already sums, so a busy pixel costs one row a task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geo

#: Masks of all tiles of an image that are broadcast at most; more are joined by tile.
BROADCAST = 200_000


def bresenham(segments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, px, py: every pixel of the segments x0, y0 to x1, y1, both ends included."""
    dx, dy = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    sx, sy = (F.when(F.col(b) >= F.col(a), 1).otherwise(-1) for a, b in (("x0", "x1"), ("y0", "y1")))
    s = segments.withColumns({"dx": dx, "dy": dy, "sx": sx, "sy": sy}).withColumn("n", F.greatest("dx", "dy"))
    s = s.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    minor = F.when(F.col("n") == 0, F.lit(0)).otherwise(F.expr("(i * least(dx, dy)) div n"))
    steep = F.col("dy") > F.col("dx")
    return s.select(*keys, (F.col("x0") + F.col("sx") * F.when(steep, minor).otherwise(F.col("i"))).alias("px"), (F.col("y0") + F.col("sy") * F.when(steep, F.col("i")).otherwise(minor)).alias("py"))


def counted(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, px, py, visits: at most 255."""
    return pixels.groupBy(*keys, "px", "py").agg(F.least(F.count(F.lit(1)), F.lit(255)).alias("visits"))


def scale(source: int, z: int, extent: int, width: int) -> int:
    """Bits by which source pixels are shifted down to a tile of width pixels."""
    if width & (width - 1) or width > extent:
        raise ValueError("the width is a power of two, at most the stored extent")
    return source - z + extent.bit_length() - width.bit_length()


def hidden(x: Column, y: Column, masks: list[tuple[int, int, int]]) -> Column:
    """Whether a pixel lies in one of a few masks (x, y, squared radius)."""
    tests = [(x - a) * (x - a) + (y - b) * (y - b) <= r for a, b, r in masks]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def tile_masks(masks: list[tuple[float, float, float]], tile: tuple[int, int, int], width: int) -> list[tuple[int, int, int]]:
    """Masks (lat, lng, metres) that touch a tile, in its pixels (whole numbers, cut off)."""
    z, x, y = tile
    left, bottom, right, top = geo.tile_bounds(x, y, z)
    per = width / (right - left)
    out = []
    for lat, lng, r in masks:
        p = geo.point(lng, lat)
        if p is None:
            continue
        dx, dy = p[0] - max(left, min(p[0], right)), p[1] - max(bottom, min(p[1], top))
        if dx * dx + dy * dy <= r * r:
            out.append((int((p[0] - left) * per), int((top - p[1]) * per), int(r * per) ** 2))
    return out


def drawn(vertices: str, width: int) -> Column:
    """The segments (a, b) that draw a polyline in a tile: from each visible vertex to the next.

    A vertex that repeats the last one is passed over, and so is one whose segment misses the
    tile: then the last one stays. That takes two vertices in a row on the tile's far edges
    (their pixel is width), so only lines with such are gone through one by one; in all
    others the last vertex is the one before.
    """
    v = F.col(vertices)
    n = F.greatest(F.size(v) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(v, 1, n), F.slice(v, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    differ = lambda a, b: (a["x"] != b["x"]) | (a["y"] != b["y"])
    beyond = lambda p: (p["x"] >= width) | (p["y"] >= width)
    box = [F.lit(0.0), F.lit(0.0), F.lit(width - 1.0), F.lit(width - 1.0)]
    meets = lambda a, b: geo.clip(*(p[c].cast("double") for p in (a, b) for c in "xy"), box)[0].isNotNull()
    kind = "struct<x: bigint, y: bigint, hide: boolean>"
    start = F.struct(F.lit(None).cast(kind).alias("last"), F.array().cast(f"array<struct<a: {kind}, b: {kind}>>").alias("out"))

    def step(state: Column, p: Column) -> Column:
        last, out = state["last"], state["out"]
        draws = last.isNotNull() & differ(last, p) & meets(last, p)
        now = F.when(p["hide"], F.lit(None).cast(kind)).when(last.isNull() | draws, p).otherwise(last)
        return F.struct(now.alias("last"), F.when(~p["hide"] & F.coalesce(draws, F.lit(False)), F.concat(out, F.array(F.struct(last.alias("a"), p.alias("b"))))).otherwise(out).alias("out"))

    each = F.transform(v, lambda p: F.struct(p["x"].cast("bigint").alias("x"), p["y"].cast("bigint").alias("y"), p["hide"].alias("hide")))
    one_by_one = F.aggregate(each, start, step, lambda state: state["out"])
    plain = F.transform(F.filter(pairs, lambda p: ~p["a"]["hide"] & ~p["b"]["hide"] & differ(p["a"], p["b"])), lambda p: p.cast(f"struct<a: {kind}, b: {kind}>"))
    return F.when(F.exists(pairs, lambda p: beyond(p["a"]) & beyond(p["b"])), one_by_one).otherwise(plain)


def rasterize(tiles: DataFrame, targets: list[tuple[int, int, int]], source: int, width: int, extent: int, masks: list[tuple[float, float, float]] = ()) -> DataFrame:
    """tx, ty, px, py, visits of the target tiles (z, x, y; of one zoom, a rectangle) from the polylines stored at zoom source."""
    z = targets[0][0]
    shift = scale(source, z, extent, width)
    dz = source - z
    xs, ys = [t[1] for t in targets], [t[2] for t in targets]
    lines = tiles.where((F.col("z") == source) & (F.col("x") >= min(xs) << dz) & (F.col("x") < (max(xs) + 1) << dz) & (F.col("y") >= min(ys) << dz) & (F.col("y") < (max(ys) + 1) << dz))
    tx, ty = F.shiftright("x", dz).cast("long"), F.shiftright("y", dz).cast("long")
    ox, oy = extent * (F.col("x").cast("long") - F.shiftleft(tx, dz)), extent * (F.col("y").cast("long") - F.shiftleft(ty, dz))
    down = lambda v: F.shiftright(v, shift) if shift >= 0 else F.shiftleft(v, -shift)
    lines = lines.select(tx.alias("tx"), ty.alias("ty"), F.transform("coords", lambda c: F.struct(down(c["x"] + ox).alias("x"), down(F.lit(extent) - c["y"] + oy).alias("y"))).alias("v"))
    box = [F.lit(0.0), F.lit(0.0), F.lit(width - 1.0), F.lit(width - 1.0)]
    near = {}
    for t in targets:
        if found := tile_masks(masks, t, width):
            near[t[1], t[2]] = found
    if near:
        # a row a tile, looked up by it
        of = tiles.sparkSession.createDataFrame([(*t, m) for t, m in near.items()], "tx long, ty long, masks array<struct<x: long, y: long, r: long>>")
        few = sum(map(len, near.values())) <= BROADCAST
        cover = lambda v: F.coalesce(F.exists("masks", lambda m: (v["x"] - m["x"]) * (v["x"] - m["x"]) + (v["y"] - m["y"]) * (v["y"] - m["y"]) <= m["r"]), F.lit(False))
        lines = lines.join(F.broadcast(of) if few else of, ["tx", "ty"], "left").select("tx", "ty", F.transform("v", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"), cover(v).alias("hide"))).alias("v"))
    else:
        lines = lines.withColumn("v", F.transform("v", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"), F.lit(False).alias("hide"))))
    s = lines.select("tx", "ty", F.explode(drawn("v", width)).alias("p"))
    s = s.select("tx", "ty", *(F.col(f"p.{e}.{c}").cast("double").alias(f"{e}{c}") for e in "ab" for c in "xy"))
    t0, t1 = geo.clip(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), box)
    s = s.withColumns({"t0": t0, "t1": t1}).where("t0 is not null")
    at = lambda t, a, b: F.floor(F.col(a) + F.col(t) * (F.col(b) - F.col(a))).cast("long")
    s = s.select("tx", "ty", at("t0", "ax", "bx").alias("x0"), at("t0", "ay", "by").alias("y0"), at("t1", "ax", "bx").alias("x1"), at("t1", "ay", "by").alias("y1"))
    return counted(bresenham(s, ["tx", "ty"]), ["tx", "ty"])


def image(pixels: np.ndarray, width: int, palette: np.ndarray, height: int | None = None) -> bytes:
    """RGBA rows of an array of px, py, visits; pixels without a visit are transparent."""
    out = np.zeros((height or width, width, 4), np.uint8)
    ok = (pixels[:, 0] >= 0) & (pixels[:, 0] < width) & (pixels[:, 1] >= 0) & (pixels[:, 1] < out.shape[0])
    p = pixels[ok]
    out[p[:, 1], p[:, 0]] = palette[p[:, 2]]
    return out.tobytes()
