"""The engine's tables as Parquet in one folder, with configuration, masks and versions.

Activities and their tiles are dealt to buckets by a hash of the file key (an activity's id is
that hash), so what belongs to a file lies in one bucket. Every write makes a new part, a
folder of buckets, and then names them in the store's next manifest, a numbered file that is
put in place by a rename (on a machine's own file system, a link) that fails if another
writer was first. New files are added beside what their buckets hold; a replaced file makes
its bucket anew, and no other. So a reader sees the old version or the new one, a failed
write leaves the old one, and of two writers the second starts over from what the first left.
What no kept manifest names is removed.
Configuration and masks lie in the manifest too. Activities have a column hot beside their
properties, typed copies of the keys that filters ask for most, and are sorted by the first.
With each bucket of a part lies the profile of its properties; these add up, as no file is in
two, so the store's own is read without a look at an activity.
"""

from __future__ import annotations

import contextlib
import json
import os
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wayfold.functions import props
from wayfold.functions.props import round4
from wayfold.operators import tiling
from wayfold.operators.activities import merged_profiles, profile

PLAIN = "id long, file string, title string, start_time timestamp, properties variant, created_at timestamp"
ACTIVITIES = f"{PLAIN}, hot {props.HOT_TYPE}"
VERSION = 4
#: Buckets of a new store: what a replacement reads and writes is one of them. Parts of a bucket before an upsert makes one of them.
BUCKETS, PARTS = 16, 16
#: Manifests that are kept, and times a writer starts over.
KEPT, TRIES = 20, 10


class Conflict(RuntimeError):
    """Another writer changed the store meanwhile."""


SCHEMAS = {"activities": ACTIVITIES, "activity_tiles": tiling.TILES, "profiles": "key string, count long, types array<string>"}


@dataclass
class Config:
    zoom_levels: list[int] = field(default_factory=lambda: list(tiling.ZOOMS))
    tile_extent: int = tiling.EXTENT
    trim_dist: float = 0.0
    activity_mask: list[dict] = field(default_factory=list)
    fetch_cutoff: str | None = None

    def masks(self) -> list[tuple[float, float, float]]:
        return [(m["lat"], m["lng"], m["radius"]) for m in self.activity_mask]

    def cutoff(self) -> date | None:
        return date.fromisoformat(self.fetch_cutoff) if self.fetch_cutoff else None


def mask_text(m: dict) -> str:
    return f"{m['name']} - {m['lat']:.5f},{m['lng']:.5f} (radius: {m['radius']:g}m)"


class Store:
    """A store at a path of any file system that Spark reads. create: make it if it is missing, else FileNotFoundError."""

    def __init__(self, spark: SparkSession, path: str, create: bool = True, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        if self._latest() is None:
            if not create:
                raise FileNotFoundError(f"no store at {path}")
            with contextlib.suppress(Conflict):  # another has just made it
                self._next(0, {"version": VERSION, "buckets": buckets, "config": asdict(Config()), "tables": {}})
        self.migrate()

    def _fs(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _local(self, path: str) -> str | None:
        """The path on this machine, if the file system is its own: there a link is what fails if a file is there, a rename isn't."""
        fs, p = self._fs(path)
        return fs.makeQualified(p).toUri().getPath() if fs.getScheme() == "file" else None

    def _get(self, name: str) -> dict:
        if (here := self._local(f"{self.path}/{name}")) is not None:
            with open(here, encoding="utf-8") as f:
                return json.load(f)
        fs, p = self._fs(f"{self.path}/{name}")
        stream = fs.open(p)
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, name: str, value: dict) -> None:
        """A whole file or none; Conflict if there is one."""
        data = json.dumps(value, ensure_ascii=False).encode()
        if (here := self._local(f"{self.path}/{name}")) is not None:
            os.makedirs(os.path.dirname(here), exist_ok=True)
            part = f"{self._local(self.path)}/.{uuid.uuid4().hex}"
            try:
                with open(part, "wb") as f:
                    f.write(data)
                os.link(part, here)
            except FileExistsError as e:
                raise Conflict(name) from e
            finally:
                os.unlink(part)
            return
        fs, part = self._fs(f"{self.path}/.{uuid.uuid4().hex}")
        out = fs.create(part, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        _, p = self._fs(f"{self.path}/{name}")
        fs.mkdirs(p.getParent())
        kinds = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kinds, 1)
        how[0] = kinds.NONE
        at = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            at.rename(fs.makeQualified(part), fs.makeQualified(p), how)
        except Exception as e:
            fs.delete(part, False)
            if fs.exists(p):
                raise Conflict(name) from e
            raise

    def _numbers(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/manifests")
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def _latest(self) -> tuple[int, dict] | None:
        """The last manifest and its number; 0 is that of an older store."""
        if numbers := self._numbers():
            return numbers[-1], self._get(f"manifests/{numbers[-1]:012d}.json")
        return (0, self._get("manifest.json")) if self._exists(f"{self.path}/manifest.json") else None

    def _next(self, number: int, manifest: dict) -> None:
        self._put(f"manifests/{number + 1:012d}.json", manifest)
        old = self._numbers()[:-KEPT]
        gone = set().union(*(self._named(n) for n in old))
        for n in old:
            self._drop([f"manifests/{n:012d}.json"])
        if gone:
            self._drop(gone - self._kept())

    def _named(self, number: int) -> set[str]:
        """The folders that a manifest names; none if it went meanwhile."""
        try:
            tables = self._get(f"manifests/{number:012d}.json")["tables"]
        except Exception:  # noqa: BLE001  (of the file system's own kind)
            return set()
        return {x for name, parts in tables.items() for x in (parts if isinstance(parts, list) else self._folders(name, parts))}

    def _kept(self) -> set[str]:
        return set().union(*(self._named(n) for n in self._numbers()))

    @staticmethod
    def _folders(name: str, buckets: dict[str, list[str]], some: Iterable[int] | None = None) -> list[str]:
        return [f"{name}/{part}/bucket={b}" for b, parts in buckets.items() if some is None or int(b) in some for part in parts]

    def vacuum(self, hours: float = 24.0) -> int:
        """Remove parts that no kept manifest names and that are older than some hours (a younger one may be a write under way); the number of parts."""
        kept = {x.split("/bucket=")[0] for x in self._kept()}
        old = []
        for name in SCHEMAS:
            fs, p = self._fs(f"{self.path}/{name}")
            for f in fs.listStatus(p) if fs.exists(p) else []:
                part = f"{name}/{f.getPath().getName()}"
                if part not in kept and f.getModificationTime() / 1000 <= time.time() - hours * 3600:
                    old.append(part)
        self._drop(old)
        return len(old)

    def migrate(self) -> None:
        """Bring an older store to VERSION, one step after another; a newer one is refused."""
        n, m = self._latest()
        if m["version"] > VERSION:
            raise ValueError(f"the store is of version {m['version']}, newer than {VERSION}")
        steps = {0: lambda m: m | {"tables": m.get("tables", {})}, 1: lambda m: m | {"tables": {k: [v] for k, v in m["tables"].items()}}, 2: self._to_variant, 3: self._to_buckets}
        while m["version"] < VERSION:
            m = steps[m["version"]](m) | {"version": m["version"] + 1}
            self._next(n, m)
            n += 1

    def _to_buckets(self, m: dict) -> dict:
        """Parts dealt to buckets by file, ids made anew from it, and the configuration's file put into the manifest."""
        config = self._get("config.json") if self._exists(f"{self.path}/config.json") else asdict(Config())
        m = m | {"buckets": BUCKETS, "config": config}
        read = lambda name: self.spark.read.schema(SCHEMAS[name]).option("basePath", f"{self.path}/{name}").parquet(*(f"{self.path}/{p}" for p in m["tables"][name])).drop("part") if m["tables"].get(name) else self._empty(name)
        activities, tiles = read("activities"), read("activity_tiles")
        ids = activities.select(F.col("id").alias("activity_id"), F.xxhash64("file").alias("new"))
        tiles = tiles.join(ids, "activity_id").withColumn("activity_id", F.col("new")).drop("new")
        part, found = self._part({"activities": activities.withColumn("id", F.xxhash64("file")), "activity_tiles": tiles}, m["buckets"])
        return m | {"tables": {k: {str(b): [part] for b in v} for k, v in found.items()}}

    def _to_variant(self, m: dict) -> dict:
        """Properties, JSON text up to version 2, parsed once and for all."""
        parts = m["tables"].get("activities")
        if not parts:
            return m
        old = self.spark.read.schema(PLAIN.replace("variant", "string")).option("basePath", f"{self.path}/activities").parquet(*(f"{self.path}/{p}" for p in parts))
        name = f"activities/part={uuid.uuid4().hex}"
        old.withColumn("properties", F.try_parse_json("properties")).drop("part").write.parquet(f"{self.path}/{name}")
        return m | {"tables": m["tables"] | {"activities": [name]}}

    # configuration

    def config(self) -> Config:
        """Unknown keys are left out."""
        known = Config.__dataclass_fields__
        return Config(**{k: v for k, v in self._latest()[1]["config"].items() if k in known})

    def configure(self, change: Callable[[Config], None]) -> None:
        """Apply change to the configuration as it is then, also where another writer is at it."""

        def write(since):
            known = Config.__dataclass_fields__
            config = Config(**{k: v for k, v in since[1]["config"].items() if k in known})
            change(config)
            self._next(since[0], since[1] | {"config": asdict(config)})

        self._tried(write)

    def save(self, config: Config) -> None:
        self.configure(lambda c: c.__dict__.update(asdict(config)))

    def add_mask(self, name: str, lat: float, lng: float, radius: float) -> None:
        """Add a mask, or replace the one of this name."""
        if not name or not -90 <= lat <= 90 or not -180 <= lng <= 180 or radius <= 0:
            raise ValueError("a mask has a name, a place and a radius above 0")

        def change(c: Config) -> None:
            c.activity_mask = [m for m in c.activity_mask if m["name"] != name] + [{"name": name, "lat": lat, "lng": lng, "radius": radius}]

        self.configure(change)

    def remove_mask(self, name: str) -> None:
        def change(c: Config) -> None:
            rest = [m for m in c.activity_mask if m["name"] != name]
            if len(rest) == len(c.activity_mask):
                raise KeyError(f"no mask {name!r}")
            c.activity_mask = rest

        self.configure(change)

    # tables

    def table(self, name: str) -> DataFrame:
        return self._table(name, self._latest()[1])

    def _table(self, name: str, manifest: dict, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table as a manifest has it, or some of its buckets."""
        schema = SCHEMAS[name]
        found = self._folders(name, manifest["tables"].get(name, {}), buckets)
        if not found:
            return self._empty(name)
        columns = StructType.fromDDL(schema).names
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*(f"{self.path}/{p}" for p in found)).select(*columns)

    def _empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], SCHEMAS[name])

    @property
    def activities(self) -> DataFrame:
        return self.table("activities")

    @property
    def tiles(self) -> DataFrame:
        return self.table("activity_tiles")

    def profile(self) -> DataFrame:
        """key, count and types of all properties, and the number of activities at a null key; no activity is read."""
        return merged_profiles(self.table("profiles"))

    def _part(self, tables: dict[str, DataFrame], buckets: int) -> tuple[str, dict[str, list[int]]]:
        """Write tables as a new part; its name, and which buckets it has of each."""
        part, found = f"part={uuid.uuid4().hex}", {}
        if "activities" in tables:  # of what was written, when it has been
            tables = tables | {"profiles": None}
        for name, df in tables.items():
            at = f"{self.path}/{name}/{part}"
            if name == "profiles":
                written = self.spark.read.schema(f"{ACTIVITIES}, bucket int").parquet(f"{self.path}/activities/{part}")
                profile(written, ("bucket",)).repartition("bucket").write.partitionBy("bucket").parquet(at)
            elif name == "activity_tiles":
                # read by zoom and rectangles of tiles: along a curve, so that both x and y are near each other in a row group
                df = df.withColumns({"bucket": _bucket(F.col("activity_id"), buckets), "_curve": morton(F.col("x"), F.col("y"))})
                df.repartitionByRange("bucket", "z", "_curve").sortWithinPartitions("bucket", "z", "_curve").drop("_curve").write.partitionBy("bucket", "z").parquet(at)
            else:
                df = df.withColumns({"bucket": _bucket(F.col("id"), buckets), "hot": props.hot(F.col("properties"))})
                order = ["bucket", F.col("hot")[props.HOT[0]]["text"], "file"]
                df.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("bucket").parquet(at)
            fs, p = self._fs(at)
            found[name] = sorted(int(f.getPath().getName().removeprefix("bucket=")) for f in fs.listStatus(p) if f.isDirectory() and f.getPath().getName().startswith("bucket="))
        return part, found

    def _write(self, tables: dict[str, DataFrame], since: tuple[int, dict], over: Iterable[int] = ()) -> None:
        """Write tables as a new part and name it in the next manifest: in place of what the buckets over hold, beside what others do."""
        n, m = since
        part, found = self._part(tables, m["buckets"])
        after = {name: {b: parts for b, parts in m["tables"].get(name, {}).items() if int(b) not in over} for name in found}
        for name, buckets in found.items():
            for b in map(str, buckets):
                after[name][b] = [*after[name].get(b, []), part]
        try:
            self._next(n, m | {"tables": m["tables"] | after})
        except Conflict:
            self._drop([f"{name}/{part}" for name in found])
            raise

    def _drop(self, parts: Iterable[str]) -> None:
        for part in parts:
            fs, p = self._fs(f"{self.path}/{part}")
            fs.delete(p, True)

    def _tried(self, write: Callable[[tuple[int, dict]], None]) -> None:
        """write(latest manifest), again if another writer was first."""
        for k in range(TRIES):
            try:
                return write(self._latest())
            except Conflict:
                if k == TRIES - 1:
                    raise

    def upsert(self, activities: DataFrame, tiles: DataFrame) -> None:
        """Put activities (one row a file, its id the hash of the file) and their tiles in place of those with the same file; the replaced ones' tiles go too.

        An import of new files costs what it brings. Only buckets that hold a file to be replaced, or have come to PARTS parts, are read and made anew.
        """

        def write(since):
            m = since[1]
            bucket = _bucket(F.col("id"), m["buckets"]).alias("bucket")
            come = {r["bucket"] for r in activities.select(bucket).distinct().collect()}  # at most a row a bucket
            held = self._table("activities", m, come)
            over = {r["bucket"] for r in held.join(activities.select("file"), "file", "left_semi").select(bucket).distinct().collect()}
            over |= {b for b in come if len(m["tables"].get("activities", {}).get(str(b), [])) >= PARTS}
            new = {"activities": activities, "activity_tiles": tiles}
            if over:
                kept = {"activities": self._table("activities", m, over).drop("hot").join(activities.select("file"), "file", "left_anti"), "activity_tiles": self._table("activity_tiles", m, over).join(activities.select(F.col("id").alias("activity_id")), "activity_id", "left_anti")}
                new = {k: kept[k].unionByName(v.select(*kept[k].columns)) for k, v in new.items()}
            return self._write(new, since, over)

        self._tried(write)

    def reset(self) -> None:
        self._tried(lambda since: self._next(since[0], since[1] | {"tables": {}}))


def _bucket(id: Column, buckets: int) -> Column:
    return F.pmod(id, F.lit(buckets)).cast("int")


def morton(x: Column, y: Column) -> Column:
    """The place of a tile on a Z-shaped curve: the bits of x and y (32 each at most) in turn."""

    def spread(v: Column) -> Column:
        v = v.cast("long")
        for by, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, by)).bitwiseAND(F.lit(keep))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def rounded(fragment):
    """A JSON fragment; a decimal number has four places at most."""
    decimal = fragment.rlike(r"^-?[0-9]+(\.[0-9]+([eE][-+]?[0-9]+)?|[eE][-+]?[0-9]+)$")
    return F.when(decimal, F.regexp_replace(F.to_json(F.struct(round4(fragment.cast("double")).alias("v"))), r'^\{"v":(.*)\}$', "$1")).otherwise(fragment)
