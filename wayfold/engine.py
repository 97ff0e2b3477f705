"""The engine: import, list, profile and draw activities of a store."""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Callable, Iterable
from datetime import date, timedelta

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import geo, props
from wayfold.functions.png import png
from wayfold.operators import activities as acts
from wayfold.operators import raster, stats, tiling
from wayfold.plans import gradients
from wayfold.sources import connectors, files, known, metadata, pull
from wayfold.store import Store, mask_text, rounded

LIMIT = 3000


class Engine:
    def __init__(self, spark: SparkSession, path: str, create: bool = True):
        self.spark, self.store = spark, Store(spark, path, create)

    # import

    def _load(self, parsed: DataFrame, meta: DataFrame | None = None, compute: bool = True) -> dict[str, int]:
        """Upsert parsed files (path, file, status, title, start_time, properties, points); counts by status. compute: add the track's statistics."""
        parsed = parsed.persist()
        try:
            counts = {r["status"]: r["n"] for r in files.counters(parsed).collect()}  # three rows
            good = parsed.where("status = 'imported'").withColumn("id", F.xxhash64("file")).dropDuplicates(["file"])
            points = files.long_points(good)
            new = good
            if compute:
                numbers = stats.track_stats(points)
                new = good.join(numbers, F.col("id") == F.col("activity_id"), "left").withColumn("properties", props.merge(F.col("properties"), stats.fragments(numbers)))
            if meta is not None:
                new = metadata.enrich(new, meta)
            new = new.withColumn("properties", F.transform_values("properties", lambda _, v: rounded(v)))
            rows = new.select("id", "file", "title", "start_time", F.parse_json(props.object_text(F.col("properties"))).alias("properties"), F.current_timestamp().alias("created_at"))
            c = self.store.config()
            self.store.upsert(rows, tiling.exact(points, c.zoom_levels, c.tile_extent, c.trim_dist))
        finally:
            parsed.unpersist()
        return {s: counts.get(s, 0) for s in ("imported", "skipped", "failed")}

    def import_path(self, path: str, join: str | None = None, trim: float | None = None, reset: bool = False) -> dict[str, int]:
        """Import a file or all below a folder; files whose key is known are passed over. join: a CSV of metadata."""
        if trim is not None:
            self.store.configure(lambda c: setattr(c, "trim_dist", trim))
        if reset:
            self.store.reset()
        # names first: only files that aren't known yet are opened, all of it by tasks
        found = files.names(self.spark, path)
        meta = metadata.read(self.spark, join) if join else None
        key = F.col("path")
        if meta is not None:
            found = found.join(meta.select("path", metadata.activity_id(F.col("more")).alias("_id")), "path", "left")
            key = files.file_key(key, F.col("_id"))
        new = known.unknown(found.select(key.alias("file"), "path"), self.store.activities.select("file")).persist()
        try:
            if new.isEmpty():
                return {s: 0 for s in ("imported", "skipped", "failed")}
            return self._load(files.parsed(files.opened(self.spark, new)).join(new, "path"), meta)
        finally:
            new.unpersist()
            self.store.vacuum()

    def upload(self, uploads: DataFrame) -> dict[str, int]:
        """path and content of pushed files, stored as upload:{file name}."""
        return self._load(files.parsed(uploads).withColumn("file", F.concat(F.lit("upload:"), F.element_at(F.split("path", "/"), -1))))

    def webhook(self, bodies: DataFrame, column: str = "body") -> dict[str, int]:
        return self._load(connectors.webhook_activities(bodies, column).withColumn("file", F.col("path")), compute=False)

    def fetch(self, client: Callable[[date], Iterable[tuple[str, bytes]]], today: date, lookback: int = 30) -> int:
        """Import what a client lists; the number of activities added."""
        new = connectors.fetched(self.spark, client, self.store.activities, today, lookback, self.store.config().cutoff())
        return self._load(files.parsed(new).withColumn("file", F.col("path")))["imported"]

    def _pulled(self, rows: DataFrame) -> int:
        new = known.unknown(rows.select("path", "content").dropDuplicates(["path"]), self.store.activities.select(F.col("file").alias("path")), "path")
        return self._load(files.parsed(new).withColumn("file", F.col("path")))["imported"]

    def pull(self, client: Callable[[date], Iterable[tuple[str, bytes]]], today: date, lookback: int = 30) -> int:
        """Import what a client of a day lists from today - lookback days (or the cutoff) on, a task a day; the number of activities added."""
        self.spark.dataSource.register(pull.source(client))
        since = max(today - timedelta(days=lookback), self.store.config().cutoff() or date.min)
        return self._pulled(self.spark.read.format(pull.NAME).option("since", since.isoformat()).option("until", (today + timedelta(days=1)).isoformat()).load())

    # listings

    def activities(self, **conditions) -> DataFrame:
        return acts.listing(self.store.activities, self.store.tiles, **conditions)

    def json_lines(self, **conditions) -> DataFrame:
        return acts.json_lines(self.activities(**conditions))

    def count(self, **conditions) -> int:
        if any(v is not None for v in conditions.values()):
            return acts.count(self.store.activities, **conditions)
        n = self.store.profile().where("key is null").first()
        return n["count"] if n else 0

    def properties(self, **conditions) -> DataFrame:
        """Without conditions from the profiles that were kept with the activities."""
        if any(v is not None for v in conditions.values()):
            return acts.property_stats(self.store.activities, **conditions)
        return self.store.profile().where("key is not null")

    def etag(self, **conditions) -> str:
        """Of the number of activities, as it always has been."""
        return hashlib.sha256(str(self.count(**conditions)).encode()).hexdigest()[:16]

    def mask_lines(self) -> list[str]:
        return [mask_text(m) for m in self.store.config().activity_mask]

    # images

    def _drawn(self, targets: list[tuple[int, int, int]], width: int, **conditions) -> DataFrame | None:
        c = self.store.config()
        source = geo.source_zoom(c.zoom_levels, targets[0][0])
        if source is None:
            return None
        ids = acts.matching(self.store.activities, **conditions).select(F.col("id").alias("activity_id"))
        tiles = self.store.tiles.join(ids, "activity_id", "left_semi")
        return raster.rasterize(tiles, targets, source, width, c.tile_extent, c.masks())

    def tile_pixels(self, tile: str, width: int = 1024, **conditions) -> DataFrame | None:
        """px, py, visits of a tile z/x/y; None if no stored zoom serves it."""
        drawn = self._drawn([geo.parse_tile(tile)], width, **conditions)
        return None if drawn is None else drawn.select("px", "py", "visits")

    def tile(self, tile: str, width: int = 1024, color: str | None = None, gradient: str | None = None, default: str = "pinkish", drawn: bool = False, **conditions) -> bytes | None:
        """The PNG of a tile (its pixels are at most width squared, a bound of what comes to the driver); where nothing is it is blank, or with drawn None."""
        palette = gradients.choose(color, gradient, default)
        pixels = self.tile_pixels(tile, width, **conditions)
        if pixels is None:
            return None
        got = _numbers(pixels)
        return None if drawn and not len(got) else png(raster.image(got, width, palette), width, width)

    def render(self, bounds: str, width: int = 1024, height: int = 1024, color: str | None = None, gradient: str | None = None, default: str = "pinkish", **conditions) -> bytes:
        """The PNG of a viewport west,south,east,north, drawn as one job over its tiles and cut out around their middle."""
        if not 1 <= width <= LIMIT or not 1 <= height <= LIMIT:
            raise ValueError(f"the size is from 1 to {LIMIT}")
        palette = gradients.choose(color, gradient, default)
        view = geo.parse_viewport(bounds)
        z, x0, y0, x1, y1 = geo.viewport_tiles(view, width, height, self.store.config().zoom_levels)
        size = 256
        w, h = (x1 - x0 + 1) * size, (y1 - y0 + 1) * size
        width, height = min(width, w), min(height, h)
        left, top = (w - width) // 2, (h - height) // 2
        drawn = self._drawn([(z, x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)], size, **conditions)
        at = drawn.select(((F.col("tx") - x0) * size + F.col("px") - left).alias("px"), ((F.col("ty") - y0) * size + F.col("py") - top).alias("py"), "visits").where((F.col("px") >= 0) & (F.col("px") < width) & (F.col("py") >= 0) & (F.col("py") < height))
        return png(raster.image(_numbers(at), width, palette, height), width, height)


def _numbers(pixels: DataFrame) -> np.ndarray:
    """Rows of px, py, visits."""
    got = pixels.select(*(F.col(c).cast("long") for c in ("px", "py", "visits"))).toArrow()
    return np.stack([c.to_numpy() for c in got.columns], axis=1)


def file_name(path: str) -> str:
    return posixpath.basename(path)
