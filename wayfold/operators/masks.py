"""Which points and tiles privacy masks cover, for any number of masks.

A mask (name, cx, cy, radius; Mercator metres) is put into the tiles, of the deepest zoom where
a tile is at least as wide as the mask, that its bounding square meets: four at most. Points
and tiles are joined to masks by such a tile, an equal join, and the few pairs are tested
exactly. Nothing is compared with all masks. Masks are broadcast up to a number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geo

#: The deepest zoom of a mask's tiles, and rows of masks that are broadcast at most.
DEEPEST, BROADCAST = 22, 200_000


def centred(masks: DataFrame) -> DataFrame:
    """name, cx, cy and radius of masks given by name, lat, lng and radius; those outside the projection are left out."""
    x, y = geo.mercator(F.col("lng"), F.col("lat"))
    return masks.select("name", x.alias("cx"), y.alias("cy"), "radius").where("cx is not null")


def cells(masks: DataFrame) -> DataFrame:
    """name, cx, cy, radius and each tile (level, cell_x, cell_y) that a mask's bounding square meets."""
    level = F.least(F.greatest(F.floor(F.log2(geo.CIRCLE / (2 * F.col("radius")))), F.lit(0)), F.lit(DEEPEST)).cast("int")
    m = masks.withColumn("level", F.when(F.col("radius") > 0, level).otherwise(DEEPEST))
    low = geo.tile(F.col("cx") - F.col("radius"), F.col("cy") + F.col("radius"), F.col("level"))
    high = geo.tile(F.col("cx") + F.col("radius"), F.col("cy") - F.col("radius"), F.col("level"))
    m = m.withColumn("cell_x", F.explode(F.sequence(low[0], high[0]))).withColumn("cell_y", F.explode(F.sequence(low[1], high[1])))
    return m.select("name", "cx", "cy", "radius", "level", "cell_x", "cell_y")


def _held(masks: DataFrame) -> tuple[DataFrame, list[int]]:
    """The masks' tiles, broadcast if they are few, and their levels, at most one a zoom."""
    of = cells(masks)
    n = of.groupBy("level").count().collect()  # a row a zoom
    return F.broadcast(of) if sum(r["count"] for r in n) <= BROADCAST else of, sorted(r["level"] for r in n)


def covered(points: DataFrame, masks: DataFrame, keys: list[str]) -> DataFrame:
    """keys of the points (with mx and my) that lie in a mask, each once."""
    of, levels = _held(masks)
    if not levels:
        return points.select(*keys).limit(0)
    place = lambda z: F.struct(F.lit(z).alias("level"), *(c.alias(n) for c, n in zip(geo.tile(F.col("mx"), F.col("my"), z), ("cell_x", "cell_y"), strict=True)))
    p = points.select(*keys, "mx", "my", F.explode(F.array(*map(place, levels))).alias("at")).select(*keys, "mx", "my", "at.*")
    away = (F.col("mx") - F.col("cx")) * (F.col("mx") - F.col("cx")) + (F.col("my") - F.col("cy")) * (F.col("my") - F.col("cy"))
    return p.join(of, ["level", "cell_x", "cell_y"]).where(away <= F.col("radius") * F.col("radius")).select(*keys).distinct()


def touched(tiles: DataFrame, z: int, masks: DataFrame) -> DataFrame:
    """x, y and name of the tiles (x, y of zoom z) and the masks that touch them."""
    of, levels = _held(masks)
    up = lambda c, by: F.shiftright(c, by).cast("long") if by > 0 else F.col(c).cast("long")
    # a mask's tile below zoom z counts for its ancestor there, a tile below a mask's level for its own
    place = lambda level: F.struct(F.lit(level).alias("level"), up("x", z - level).alias("at_x"), up("y", z - level).alias("at_y"))
    at = lambda c: F.when(F.col("level") > z, F.expr(f"shiftright({c}, greatest(level - {z}, 0))")).otherwise(F.col(c)).cast("long")
    near = of.select("name", "cx", "cy", "radius", "level", at("cell_x").alias("at_x"), at("cell_y").alias("at_y")).distinct()
    t = tiles.select("x", "y", F.explode(F.array(*map(place, levels)) if levels else F.array().cast("array<struct<level:int,at_x:bigint,at_y:bigint>>")).alias("p")).select("x", "y", "p.*")
    meets = geo.meets_circle(F.col("cx"), F.col("cy"), F.col("radius"), geo.bounds(F.col("x"), F.col("y"), z))
    return t.join(near, ["level", "at_x", "at_y"]).where(meets).select("x", "y", "name").distinct()
