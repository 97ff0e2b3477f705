"""Cutting tracks into stored tile polylines.

exact(): the order-dependent cut: the walk keeps a current tile, through all lines of an
activity, cuts each segment at its edges and goes on in the segment's end tile. Steps are
functions of the tile before them, so those of many activities are made at once, and an
activity's chunks in several tasks.
Known behaviour kept: the last point of every line is left out; a segment that misses the
current tile is lost and only moves the walk to the tile of its start, also after a line's
end; of a segment over more than two tiles only the first and the last get a part.

segments(): the declarative form for queries: each segment's part in the tiles of its start
and its end, one row each, all in the JVM. It differs where the walk loses segments after
a jump, and doesn't chain parts into polylines.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import geo

ZOOMS = [2, 6, 10, 14, 16]
EXTENT = 2048
#: Tolerance of the simplification, in stored pixels.
EPSILON = 4.0

TILES = "activity_id long, z int, x int, y int, coords array<struct<x: int, y: int>>"


def projected(points: DataFrame) -> DataFrame:
    """Points with mx and my (Mercator metres); those outside the projection are dropped."""
    mx, my = geo.mercator(F.col("lng"), F.col("lat"))
    return points.where((F.col("lat") >= geo.LAT_MIN) & (F.col("lat") < geo.LAT_MAX)).withColumns({"mx": mx, "my": my})


def trimmed(points: DataFrame, trim: float) -> DataFrame:
    """Each line without the points before the first one that is trim metres (Mercator) from its start, and after the last one as far from its end."""
    if trim <= 0:
        return points
    w = Window.partitionBy("activity_id", "part")
    o = w.orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    away = lambda f: F.sqrt(F.pow(F.col("mx") - f("mx").over(o), 2) + F.pow(F.col("my") - f("my").over(o), 2)) >= trim
    far = points.withColumns({"a": away(F.first), "b": away(F.last)})
    return far.withColumns({"lo": F.min(F.when(F.col("a"), F.col("seq"))).over(w), "hi": F.max(F.when(F.col("b"), F.col("seq"))).over(w)}).where("seq between lo and hi").drop("a", "b", "lo", "hi")


def joined(points: DataFrame) -> DataFrame:
    """Segments (mx, my) to (nx, ny) of each line, without the one to its last point and those longer than the largest gap."""
    w = Window.partitionBy("activity_id", "part").orderBy("seq")
    out = points.withColumns({"nx": F.lead("mx").over(w), "ny": F.lead("my").over(w), "more": F.lead("seq", 2).over(w)})
    return out.where(F.col("more").isNotNull() & (F.sqrt((F.col("nx") - F.col("mx")) * (F.col("nx") - F.col("mx")) + (F.col("ny") - F.col("my")) * (F.col("ny") - F.col("my"))) <= geo.MAX_GAP)).drop("more")


def segments(points: DataFrame, z: int, extent: int = EXTENT) -> DataFrame:
    """activity_id, part, seq, x, y (tile) and x0, y0, x1, y1 (pixels from the tile's top left) of each segment's parts."""
    s = joined(projected(points))
    ax, ay = geo.tile(F.col("mx"), F.col("my"), z)
    bx, by = geo.tile(F.col("nx"), F.col("ny"), z)
    both = F.when((ax == bx) & (ay == by), F.array(F.struct(ax.alias("x"), ay.alias("y")))).otherwise(F.array(F.struct(ax.alias("x"), ay.alias("y")), F.struct(bx.alias("x"), by.alias("y"))))
    s = s.withColumn("tile", F.explode(both)).select("activity_id", "part", "seq", "mx", "my", "nx", "ny", "tile.x", "tile.y")
    box = geo.bounds(F.col("x"), F.col("y"), z)
    t0, t1 = geo.clip(F.col("mx"), F.col("my"), F.col("nx"), F.col("ny"), box)
    s = s.withColumns({"t0": t0, "t1": t1}).where("t0 is not null")
    at = lambda t, a, b: F.col(a) + F.col(t) * (F.col(b) - F.col(a))
    p0, p1 = (geo.tile_pixel(at(t, "mx", "nx"), at(t, "my", "ny"), box, extent) for t in ("t0", "t1"))
    return s.select("activity_id", "part", "seq", "x", "y", p0[0].alias("x0"), p0[1].alias("y0"), p1[0].alias("x1"), p1[1].alias("y1"))


@dataclass
class Segments:
    """Segments of tracks in the order in which they are walked: ends (n, 2), their track's number and their line's."""

    a: np.ndarray
    b: np.ndarray
    track: np.ndarray
    line: np.ndarray


def segments_of(points: np.ndarray, track: np.ndarray, line: np.ndarray, last: np.ndarray) -> Segments:
    """Of points in order. last: the last point of a line, which no segment goes to; nor do those longer than the largest gap count."""
    d = np.diff(points, axis=0)
    at = np.flatnonzero((track[1:] == track[:-1]) & (line[1:] == line[:-1]) & ~last[1:] & (np.hypot(d[:, 0], d[:, 1]) <= geo.MAX_GAP))
    return Segments(points[at], points[at + 1], track[at], line[at])


@dataclass
class Lines:
    """Polylines: the pixels of each vertex and where each polyline ends; of each polyline its tile, its track and whether it goes on one that was open before."""

    pixel: np.ndarray
    ends: np.ndarray
    tile: np.ndarray
    track: np.ndarray
    continues: np.ndarray


def _tiles(points: np.ndarray, z: int) -> np.ndarray:
    """Tiles of points, as x << 32 | y."""
    n = 2.0**z / geo.CIRCLE
    x, y = (np.maximum(np.floor(n * v), 0).astype(np.int64) for v in (points[:, 0] + geo.HALF, geo.HALF - points[:, 1]))
    return x << 32 | y


def _boxes(tiles: np.ndarray, z: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower left and upper right corners."""
    size = geo.CIRCLE / 2**z
    x, y = tiles >> 32, tiles & 0xFFFFFFFF
    return np.stack([x * size - geo.HALF, geo.HALF - (y + 1) * size], 1), np.stack([(x + 1) * size - geo.HALF, geo.HALF - y * size], 1)


def _clipped(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether segments meet boxes, and the ends of their parts there; an end inside stays as it is."""
    d = b - a
    flat = d == 0
    step = np.where(flat, 1, d)
    p, q = (low - a) / step, (high - a) / step
    enter = np.where(flat, 0, np.minimum(p, q)).max(1)
    leave = np.where(flat, 1, np.maximum(p, q)).min(1)
    enter, leave = np.maximum(enter, 0), np.minimum(leave, 1)
    meets = (enter <= leave) & ~(flat & ((a < low) | (a > high))).any(1)
    start = np.where((enter == 0)[:, None], a, a + enter[:, None] * d)
    end = np.where((leave == 1)[:, None], b, a + leave[:, None] * d)
    return meets, start, end


@dataclass
class Steps:
    """What the walk does with each segment from the tile that it is in: the tile after, whether the line is open then, and the parts in both tiles."""

    after: np.ndarray
    open: np.ndarray
    first: np.ndarray
    start: np.ndarray
    mid: np.ndarray
    second: np.ndarray
    start2: np.ndarray
    end2: np.ndarray

    def put(self, at: np.ndarray, other: Steps) -> None:
        for f in self.__dataclass_fields__:
            getattr(self, f)[at] = getattr(other, f)


def step(s: Segments, at: np.ndarray, now: np.ndarray, z: int) -> Steps:
    """Segments at, each from a tile: one that misses the tile is lost and moves the walk to where it starts; one that leaves it ends the line, and goes on in the tile of its end, if what is left of it meets that."""
    a, b = s.a[at], s.b[at]
    first, start, mid = _clipped(a, b, *_boxes(now, z))
    stays = first & (mid == b).all(1)
    to = _tiles(b, z)
    leaves = np.flatnonzero(first & ~stays & (to != now))
    second, start2, end2 = np.zeros(len(at), bool), np.zeros_like(a), np.zeros_like(a)
    second[leaves], start2[leaves], end2[leaves] = _clipped(mid[leaves], b[leaves], *_boxes(to[leaves], z))
    after = np.where(first, now, _tiles(a, z))
    after[leaves] = np.where(second[leaves], to[leaves], _tiles(mid[leaves], z))
    return Steps(after, stays | (second & (end2 == b).all(1)), first, start, mid, second, start2, end2)


def resolve(s: Segments, z: int, begin: np.ndarray) -> tuple[np.ndarray, Steps]:
    """The tile before each segment, and its step. begin: the tile in which each track's walk is at first, -1 where it hasn't begun.

    A step is a function of the tile before it, and nearly always leads to the tile of the
    segment's end. So all steps are made at once from that guess, and those after a wrong one
    again, from what it led to, until no guess is wrong.
    """
    head = np.append(True, s.track[1:] != s.track[:-1])[: len(s.track)]
    now = np.where(head, _tiles(s.a, z), np.append(0, _tiles(s.b, z)[:-1])[: len(s.track)])
    given = begin[s.track] >= 0
    now = np.where(head & given, begin[s.track], now)
    steps = step(s, np.arange(len(now)), now, z)
    wrong = np.flatnonzero(~head[1:] & (steps.after[:-1] != now[1:])) + 1
    while len(wrong):
        now[wrong] = steps.after[wrong - 1]
        steps.put(wrong, step(s, wrong, now[wrong], z))
        follow = wrong[wrong + 1 < len(now)] + 1
        # the step after each, and those whose own guess was mended meanwhile
        check = np.unique(np.concatenate([wrong, follow]))
        wrong = check[~head[check] & (now[check] != steps.after[check - 1])]
    return now, steps


def walk(s: Segments, z: int, extent: int = EXTENT, begin: np.ndarray | None = None, open_line: np.ndarray | None = None) -> Lines:
    """Polylines in tiles (pixels from the bottom left), in the order in which they begin. begin and open_line: of each track the tile and the open line (-1: none) that an earlier part of it left."""
    n = int(s.track[-1]) + 1 if len(s.track) else 0
    begin = np.full(n, -1) if begin is None else begin
    now, steps = resolve(s, z, begin)
    same = np.append(False, (s.track[1:] == s.track[:-1]) & (s.line[1:] == s.line[:-1]))[: len(now)]
    open_ = same & np.append(False, steps.open[:-1])[: len(now)]
    if open_line is not None and len(now):
        head = np.append(True, s.track[1:] != s.track[:-1])
        open_ |= head & (open_line[s.track] == s.line)
    # vertices: the start where no line is open, the end, and both ends of a part in the next tile
    many = np.where(steps.first, np.where(open_, 1, 2), 0) + 2 * steps.second
    at = np.cumsum(many) - many
    total = int(many.sum())
    vertex, tile, new = np.zeros((total, 2)), np.zeros(total, np.int64), np.zeros(total, bool)
    continues = np.zeros(total, bool)
    fresh, going = np.flatnonzero(steps.first & ~open_), np.flatnonzero(steps.first & open_)
    vertex[at[fresh]], vertex[at[fresh] + 1], vertex[at[going]] = steps.start[fresh], steps.mid[fresh], steps.mid[going]
    tile[at[fresh]] = tile[at[fresh] + 1] = now[fresh]
    tile[at[going]] = now[going]
    new[at[fresh]] = True
    over = going[~same[going]]
    new[at[over]] = continues[at[over]] = True
    cross = np.flatnonzero(steps.second)
    behind = at[cross] + many[cross]
    vertex[behind - 2], vertex[behind - 1] = steps.start2[cross], steps.end2[cross]
    tile[behind - 2] = tile[behind - 1] = steps.after[cross]
    new[behind - 2] = True
    low, high = _boxes(tile, z)
    pixel = np.clip(np.floor((vertex - low) / (high - low) * extent + 0.5), 0, extent).astype(np.int64)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], total)[: len(starts)]
    return Lines(pixel, ends, tile[starts], np.repeat(s.track, many)[starts], continues[starts])


def unrepeated(lines: Lines) -> Lines:
    """Polylines without vertices on their predecessor's pixel, unless they are the last: the simplification keeps none of them."""
    again = np.append(False, (lines.pixel[1:] == lines.pixel[:-1]).all(1))[: len(lines.pixel)]
    again[np.append(0, lines.ends[:-1])[: len(lines.ends)]] = again[lines.ends - 1] = False
    return Lines(lines.pixel[~again], np.append(0, np.cumsum(~again))[lines.ends], lines.tile, lines.track, lines.continues)


def simplified(pixel: np.ndarray, ends: np.ndarray, epsilon: float = EPSILON) -> np.ndarray:
    """Which vertices of polylines stay after Ramer-Douglas-Peucker, with the distance to the chord as a segment: all chords of a depth at once."""
    keep = np.zeros(len(pixel), bool)
    if not len(ends):
        return keep
    start = np.append(0, ends[:-1])
    keep[start] = keep[ends - 1] = True
    point = np.flatnonzero(~keep)
    line = np.searchsorted(ends, point, "right")
    left, right = start[line], ends[line] - 1
    p = pixel.astype(float)
    while len(point):
        d, off = p[right] - p[left], p[point] - p[left]
        size = (d * d).sum(1)
        t = np.clip((off * d).sum(1) / np.where(size > 0, size, 1), 0, 1)
        off -= t[:, None] * d
        away = off[:, 0] * off[:, 0] + off[:, 1] * off[:, 1]  # squared
        first = np.flatnonzero(np.append(True, left[1:] != left[:-1]))
        owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(point))))
        most = np.maximum.reduceat(away, first)
        far = np.minimum.reduceat(np.where(away == most[owner], point, len(pixel)), first)
        cut = far[owner]
        keep[far[most > epsilon * epsilon]] = True
        stay = (most > epsilon * epsilon)[owner] & (point != cut)
        before = (point < cut)[stay]
        point, left, right, cut = point[stay], left[stay], right[stay], cut[stay]
        left, right = np.where(before, left, cut), np.where(before, cut, right)
    return keep


#: Points of an activity from which it is cut to chunks of as many, which are walked by tasks of their own; points of activities that a task takes at a time.
CHUNK, BATCH = 200_000, 1 << 16

_COORDS = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))
_ARROW = pa.schema([("activity_id", pa.int64()), ("z", pa.int32()), ("x", pa.int32()), ("y", pa.int32()), ("coords", _COORDS)])


def _coords(pixel: np.ndarray, ends: np.ndarray) -> pa.Array:
    p = pixel.astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.StructArray.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["x", "y"]))


def _rows(who: np.ndarray, z: int, tile: np.ndarray, pixel: np.ndarray, ends: np.ndarray, epsilon: float) -> pa.RecordBatch:
    """Stored polylines, simplified."""
    keep = simplified(pixel, ends, epsilon)
    return pa.RecordBatch.from_arrays([pa.array(who), pa.array(np.full(len(ends), z, np.int32)), pa.array((tile >> 32).astype(np.int32)), pa.array((tile & 0xFFFFFFFF).astype(np.int32)), _coords(pixel[keep], np.cumsum(keep)[ends - 1] if len(ends) else ends)], schema=_ARROW)


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of whole groups, about BATCH at a time, of batches sorted by keys."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if size >= BATCH:
            key = [held[-1].column(k)[-1] for k in keys]
            new = np.flatnonzero(~np.logical_and.reduce([np.asarray(pc.equal(batch.column(k), v)) for k, v in zip(keys, key, strict=True)]))
            if len(new):
                yield pa.Table.from_batches([*held, batch.slice(0, int(new[0]))])
                held, size, batch = [], 0, batch.slice(int(new[0]))
        held.append(batch)
        size += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _numbered(*columns: np.ndarray) -> np.ndarray:
    """Groups of rows next to each other, from 0 on."""
    new = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def _read(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in names]


def exact(points: DataFrame, zooms: list[int] | None = None, extent: int = EXTENT, trim: float = 0.0, epsilon: float = EPSILON) -> DataFrame:
    """activity_id, z, x, y and coords (from the bottom left, simplified) of every stored polyline.

    A task takes many activities at a time; those of more than CHUNK points are cut to chunks.
    """
    zooms = zooms or ZOOMS
    kept = trimmed(projected(points), trim).select(F.col("activity_id").cast("long"), "part", "seq", "mx", "my")
    large = points.groupBy("activity_id").count().where(F.col("count") > CHUNK).select("activity_id")
    if large.isEmpty():
        return _short(kept, zooms, extent, epsilon)
    return _short(kept.join(large, "activity_id", "left_anti"), zooms, extent, epsilon).unionByName(_long(kept.join(large, "activity_id", "left_semi"), zooms, extent, epsilon))


def _short(points: DataFrame, zooms: list[int], extent: int, epsilon: float) -> DataFrame:
    """The polylines of activities that a task can take whole."""

    def cut(batches):
        for table in _grouped(batches, ["activity_id"]):
            who, part, mx, my = _read(table, "activity_id", "part", "mx", "my")
            track, line = _numbered(who), _numbered(who, part)
            s = segments_of(np.stack([mx, my], 1), track, line, np.append(line[1:] != line[:-1], True))
            ids = who[np.flatnonzero(np.append(True, track[1:] != track[:-1]))]
            for z in zooms:
                found = unrepeated(walk(s, z, extent))
                yield _rows(ids[found.track], z, found.tile, found.pixel, found.ends, epsilon)

    return points.repartition("activity_id").sortWithinPartitions("activity_id", "part", "seq").mapInArrow(cut, TILES)


def transitions(s: Segments, z: int, begin: np.ndarray) -> list[tuple[int, int, int, bool]]:
    """What the walk over each track's segments makes of the tile it is in before: rows of track, tile before, tile after and whether the last line is open then.

    Tile before: -1 where the walk begins here (or at begin), -2 for any tile that isn't named.
    Only tiles that meet the first segment are named; from all others it is lost. Such walks
    are followed until they meet the one that begins here, which most do at once.
    """
    now, steps = resolve(s, z, begin)
    head = np.flatnonzero(np.append(True, s.track[1:] != s.track[:-1])[: len(s.track)])
    stop = np.append(head[1:], len(now))
    out = [(int(s.track[h]), -1, int(steps.after[e - 1]), bool(steps.open[e - 1])) for h, e in zip(head.tolist(), stop.tolist(), strict=True)]
    tries = []
    for k, h in enumerate(head.tolist()):
        tries += [(k, t) for t in _near(s.a[h], s.b[h], z)]
    which, tile = (np.array(c, np.int64) for c in zip(*tries, strict=True)) if tries else (np.zeros(0, np.int64),) * 2
    first = step(s, head[which], tile, z)
    named = first.first
    # from anywhere else the walk is at the first segment's start after it
    which, before, at = np.concatenate([which[named], np.arange(len(head))]), np.concatenate([tile[named], np.full(len(head), -2)]), np.concatenate([head[which[named]], head])
    after, open_ = np.concatenate([first.after[named], _tiles(s.a[head], z)]), np.concatenate([first.open[named], np.zeros(len(head), bool)])
    live = np.arange(len(at))
    while len(live):
        at[live] += 1
        done = at[live] == stop[which[live]]
        live = live[~done]
        met = now[at[live]] == after[live]
        end = stop[which[live[met]]] - 1
        after[live[met]], open_[live[met]] = steps.after[end], steps.open[end]
        live = live[~met]
        if len(live):
            some = step(s, at[live], after[live], z)
            after[live], open_[live] = some.after, some.open
    return out + [(int(s.track[head[k]]), b, t, o) for k, b, t, o in zip(which.tolist(), before.tolist(), after.tolist(), open_.tolist(), strict=True)]


def _near(a: np.ndarray, b: np.ndarray, z: int) -> list[int]:
    """All tiles that a segment can meet, and some next to them, column by column."""
    size = geo.CIRCLE / 2**z
    (x0, x1), top = sorted(((p[0] + geo.HALF) / size for p in (a, b))), 1 << z
    out = []
    for x in range(max(0, math.floor(x0) - 1), min(top - 1, math.floor(x1) + 1) + 1):
        share = [0.0, 1.0] if a[0] == b[0] else [min(max((v * size - geo.HALF - a[0]) / (b[0] - a[0]), 0.0), 1.0) for v in (x, x + 1)]
        y0, y1 = sorted((geo.HALF - a[1] - t * (b[1] - a[1])) / size for t in share)
        out += [x << 32 | y for y in range(max(0, math.floor(y0) - 1), min(top - 1, math.floor(y1) + 1) + 1)]
    return out


def _long(points: DataFrame, zooms: list[int], extent: int, epsilon: float) -> DataFrame:
    """The polylines of activities that several tasks share.

    An activity's points, line after line, are cut to chunks. Each chunk is a function of the
    tile before it; these, some rows a chunk and zoom, are composed in order, so each chunk
    then knows in which tile and in which open line it begins. Lines that reach over chunks
    are put together at the end and simplified, a line in one task.
    """
    lines = points.groupBy("activity_id", "part").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    w = Window.partitionBy("activity_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("base", F.coalesce(F.sum(F.col("hi") - F.col("lo") + 1).over(w), F.lit(0)))
    cut = points.join(lines, ["activity_id", "part"]).withColumn("chunk", F.floor((F.col("base") + F.col("seq") - F.col("lo")) / CHUNK)).withColumn("last", F.col("seq") == F.col("hi")).select("activity_id", "chunk", "part", "seq", "mx", "my", "last")
    # a chunk's last point is the next one's first, if its line goes on
    w = Window.partitionBy("activity_id").orderBy("chunk")
    final = cut.groupBy("activity_id", "chunk").agg(F.max_by(F.struct("part", "seq", "mx", "my", "last"), F.struct("part", "seq")).alias("p"))
    carried = final.withColumn("chunk", F.lead("chunk").over(w)).where("chunk is not null and not p.last").select("activity_id", "chunk", "p.*")
    whole = cut.unionByName(carried)
    keys = ["activity_id", "chunk"]

    def read(table):
        who, chunk, part, mx, my, last = _read(table, "activity_id", "chunk", "part", "mx", "my", "last")
        track = _numbered(who, chunk)
        first = np.flatnonzero(np.append(True, track[1:] != track[:-1]))
        return who[first], chunk[first], segments_of(np.stack([mx, my], 1), track, part.astype(np.int64), last)

    def summed(batches):
        for table in _grouped(batches, keys):
            who, chunk, s = read(table)
            end = dict(zip(s.track.tolist(), s.line.tolist(), strict=True))
            for z in zooms:
                rows = transitions(s, z, np.full(len(who), -1))
                track = np.array([r[0] for r in rows], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(who[track]), pa.array(chunk[track]), pa.array(np.full(len(rows), z, np.int32)), *(pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.bool_()))), pa.array([end[r[0]] for r in rows], pa.int64())], ["activity_id", "chunk", "z", "before", "after", "open", "last_line"])

    dealt = whole.repartition(*keys).sortWithinPartitions(*keys, "part", "seq")
    tables = dealt.mapInArrow(summed, "activity_id long, chunk long, z int, before long, after long, open boolean, last_line long")

    def compose(table: pa.Table) -> pa.Table:
        tile, line, out = -1, -1, []
        chunks: dict[int, dict[int, dict]] = {}
        for r in table.to_pylist():
            chunks.setdefault(r["chunk"], {})[r["before"]] = r
        for chunk, rows in sorted(chunks.items()):
            out.append((table.column("activity_id")[0].as_py(), chunk, table.column("z")[0].as_py(), tile, line))
            r = rows.get(tile, rows[-2])
            tile, line = r["after"], r["last_line"] if r["open"] else -1
        return pa.Table.from_pylist([dict(zip(_BEGIN.names, r, strict=True)) for r in out], schema=_BEGIN)

    begun = tables.groupBy("activity_id", "z").applyInArrow(compose, "activity_id long, chunk long, z int, tile long, line long")
    begins = begun.groupBy("activity_id", "chunk").agg(F.collect_list(F.struct("z", "tile", "line")).alias("begin"))

    def walked(batches):
        for table in _grouped(batches, keys):
            who, chunk, s = read(table)
            track = _numbered(*_read(table, *keys))
            first = np.flatnonzero(np.append(True, track[1:] != track[:-1]))
            begin = [{b["z"]: b for b in (x or [])} for x in table.column("begin").take(pa.array(first)).to_pylist()]
            for z in zooms:
                tile, line = (np.array([b.get(z, {}).get(k, -1) for b in begin], np.int64) for k in ("tile", "line"))
                found = unrepeated(walk(s, z, extent, tile, line))
                final = np.append(found.track[1:] != found.track[:-1], True)[: len(found.track)]
                size = np.diff(np.append(0, found.ends))
                order = np.arange(len(size))
                # of a chunk only the first polyline can go on an earlier one, and only the last can be gone on
                wait = found.continues | final
                pick = np.repeat(wait, size)
                done = _rows(who[found.track[~wait]], z, found.tile[~wait], found.pixel[~pick], np.cumsum(size[~wait]), epsilon)
                some = pa.RecordBatch.from_arrays([pa.array(who[found.track[wait]]), pa.array(np.full(int(wait.sum()), z, np.int32)), *(pa.array((t[wait]).astype(np.int32)) for t in (found.tile >> 32, found.tile & 0xFFFFFFFF)), _coords(found.pixel[pick], np.cumsum(size[wait]))], schema=_ARROW)
                for batch, at, on in ((done, None, None), (some, chunk[found.track[wait]], found.continues[wait])):
                    n = batch.num_rows
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at) if at is not None else pa.nulls(n, pa.int64()), pa.array(order[wait]) if at is not None else pa.nulls(n, pa.int64()), pa.array(on) if on is not None else pa.nulls(n, pa.bool_())], [*_ARROW.names, "chunk", "place", "continues"])

    pieces = whole.join(begins, keys, "left").repartition(*keys).sortWithinPartitions(*keys, "part", "seq").mapInArrow(walked, TILES + ", chunk long, place long, continues boolean")
    w = Window.partitionBy("activity_id", "z").orderBy("chunk", "place").rowsBetween(Window.unboundedPreceding, 0)
    waiting = pieces.where("chunk is not null").withColumn("line", F.sum((~F.col("continues")).cast("long")).over(w))

    def put_together(table: pa.Table) -> pa.Table:
        table = table.sort_by([("chunk", "ascending"), ("place", "ascending")])
        xy = table.column("coords").combine_chunks().flatten()
        pixel = np.stack([xy.field(k).to_numpy() for k in (0, 1)], 1).astype(np.int64)
        x, y = (int(table.column(c)[0].as_py()) for c in "xy")
        return pa.Table.from_batches([_rows(table.column("activity_id").to_numpy()[:1], int(table.column("z")[0].as_py()), np.array([x << 32 | y]), pixel, np.array([len(pixel)]), epsilon)])

    return pieces.where("chunk is null").select(*_ARROW.names).unionByName(waiting.groupBy("activity_id", "z", "line").applyInArrow(put_together, TILES))


_BEGIN = pa.schema([("activity_id", pa.int64()), ("chunk", pa.int64()), ("z", pa.int32()), ("tile", pa.int64()), ("line", pa.int64())])


def encode(coords: list[tuple[int, int]]) -> bytes:
    """Little-endian unsigned 16-bit pairs."""
    return np.array(coords, "<u2").tobytes()


def decode(blob: bytes) -> list[tuple[int, int]]:
    if len(blob) % 4:
        raise ValueError("a polyline has four bytes a vertex")
    return [tuple(p) for p in np.frombuffer(blob, "<u2").reshape(-1, 2).tolist()]
