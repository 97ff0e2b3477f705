import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import raster, stats, tiling

POINTS = "activity_id long, part int, seq long, lng double, lat double, ele double, t long"


def frame(spark, tracks):
    rows = [(a, p[0], i, *p[1:]) for a, ps in tracks.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, POINTS)


def test_stats(spark):
    step = 100 / 111_194.93  # degrees of latitude in 100 m
    tracks = {
        1: [(0, 0.0, 0.0, e, None) for e in (50.0, 53.0, 52.0, 55.0, 50.0)],
        2: [(0, 0.0, 0.0, None, 1000), (0, 0.0, 0.0, None, 1005), (0, 0.0, 0.0, None, 1300)],
        3: [(0, 0.0, 0.0, None, 0), (1, 0.0, step, None, 10)],
        4: [(0, 0.0, 0.0, 1.0, 5)],
        5: [(0, 0.0, 0.0, None, 0), (0, 0.0, 1.0, None, 10), (0, 0.0, 1.0 + step, 7.0, None), (0, 0.0, 1.0, None, 30)],
    }
    got = {r.activity_id: r for r in stats.track_stats(frame(spark, tracks)).collect()}
    assert (got[1].elevation_gain, got[1].elevation_loss, got[1].min_elevation, got[1].max_elevation) == (5, 5, 50, 55)
    assert got[1].elapsed_time is None and got[1].average_speed is None
    assert (got[2].elapsed_time, got[2].moving_time, got[2].max_speed) == (300, 5, 0.0)
    assert got[3].max_speed == pytest.approx(36, abs=0.1) and got[3].total_distance == pytest.approx(0.1, abs=1e-4)
    assert got[4].total_distance is None and got[4].elapsed_time is None
    # a jump doesn't count, nor do times that aren't next to each other; elapsed skips missing ones
    assert got[5].total_distance == pytest.approx(0.2, abs=1e-4) and (got[5].elapsed_time, got[5].moving_time) == (30, 0)
    assert got[5].average_speed is None and got[5].min_elevation is None


def line(n, dx=1e-4, y=52.5):
    return [geo.point(13.37 + i * dx, y + (i % 3) * 1e-5) for i in range(n)]


def segments(tracks):
    """Segments of tracks, each of them lines of Mercator points."""
    points = np.array([p for t in tracks for x in t for p in x], float).reshape(-1, 2)
    track = np.array([i for i, t in enumerate(tracks) for x in t for _ in x], int)
    line = np.array([j for t in tracks for j, x in enumerate(t) for _ in x], int)
    last = np.array([k == len(x) - 1 for t in tracks for x in t for k in range(len(x))], bool)
    return tiling.segments_of(points, track, line, last)


def walked(lines, z):
    """Polylines by tile, of one track."""
    found, out, a = tiling.walk(segments([lines]), z), {}, 0
    for end, tile in zip(found.ends.tolist(), found.tile.tolist()):
        out.setdefault((tile >> 32, tile & 0xFFFFFFFF), []).append([tuple(p) for p in found.pixel[a:end].tolist()])
        a = end
    return out


def plain(track, z):
    """The walk as a machine with a state, segment by segment: polylines as (tile, pixels)."""
    now, held, out = None, [], []

    def cut(p, q, box):
        lo, hi = 0.0, 1.0
        for k in (0, 1):
            d = q[k] - p[k]
            if d == 0:
                if not box[k] <= p[k] <= box[k + 2]:
                    return None
                continue
            u, v = sorted(((box[k] - p[k]) / d, (box[k + 2] - p[k]) / d))
            lo, hi = max(lo, u), min(hi, v)
        at = lambda t: tuple(p[k] + t * (q[k] - p[k]) for k in (0, 1))
        return (p if lo == 0 else at(lo), q if hi == 1 else at(hi)) if lo <= hi else None

    def stop():
        if held:
            out.append((now, held.copy()))
        held.clear()

    def add(part):
        box = geo.tile_bounds(*now, z)
        for p in part if not held else part[1:]:
            held.append(tuple(min(max(math.floor((p[k] - box[k]) / (box[k + 2] - box[k]) * tiling.EXTENT + 0.5), 0), tiling.EXTENT) for k in (0, 1)))

    for line in track:
        for p, q in zip(line[:-2], line[1:-1]):
            if math.dist(p, q) > geo.MAX_GAP:
                continue
            now = now or geo.point_tile(*p, z)
            part = cut(p, q, geo.tile_bounds(*now, z))
            if part is None:
                stop()
                now = geo.point_tile(*p, z)
                continue
            add(part)
            if part[1] == q:
                continue
            stop()
            to = geo.point_tile(*q, z)
            if to == now:
                continue
            rest = cut(part[1], q, geo.tile_bounds(*to, z))
            now = to if rest else geo.point_tile(*part[1], z)
            if rest:
                add(rest)
                if rest[1] != q:
                    stop()
        stop()
    return out


def random_tracks(seed, n=30, z=14):
    """Tracks of several lines: small steps, jumps from tile to tile, gaps, points on tile edges, short and empty lines."""
    rng = np.random.default_rng(seed)
    left, bottom, right, _ = geo.tile_bounds(8802, 5373, z)
    size = right - left
    tracks = []
    for _ in range(n):
        track, at = [], np.array([left, bottom]) + rng.random(2) * size
        for _ in range(rng.integers(1, 6)):
            line, step = [], rng.choice([0.05, 0.6, 2.0])
            for _ in range(rng.choice([0, 1, 2, 3, 40])):
                kind = rng.random()
                if kind < 0.03:
                    at = at + rng.choice([-1, 1], 2) * 9000
                elif kind < 0.1:  # on an edge of tiles
                    at = np.array([left + size * rng.integers(-2, 3), at[1]])
                elif kind > 0.15:
                    at = at + rng.normal(size=2) * size * step
                line.append(tuple(at.tolist()))
            track.append(line)
        tracks.append(track)
    return tracks


@pytest.mark.parametrize("z", [6, 10, 14, 16])
def test_walk_equals_a_plain_machine(z):
    """Of many tracks at once; the tile is kept from line to line."""
    tracks = random_tracks(z)
    found, got, a = tiling.walk(segments(tracks), z), {}, 0
    for end, tile, track in zip(found.ends.tolist(), found.tile.tolist(), found.track.tolist()):
        got.setdefault(track, []).append(((tile >> 32, tile & 0xFFFFFFFF), [tuple(p) for p in found.pixel[a:end].tolist()]))
        a = end
    assert got == {i: lines for i, t in enumerate(tracks) if (lines := plain(t, z))}
    assert sum(map(len, got.values())) > 100 or z < 14


def test_a_line_begins_in_the_tile_where_the_last_one_ended():
    left, bottom, right, top = geo.tile_bounds(8802, 5373, 14)
    mid = (bottom + top) / 2
    far = 6 * (right - left)
    lines = [[(left + x + d, mid) for d in (1, 5, 9, 14, 20, 30)] for x in (0, far)]
    got = walked(lines, 14)
    assert sum(len(p) - 1 for ps in got.values() for p in ps) == 7  # of 4 + 4, the second line's first one is lost


@pytest.mark.parametrize("z", [6, 14, 16])
def test_transitions_are_the_walk_from_any_tile(z):
    tracks = [t for t in random_tracks(z + 50, 12) if len(segments([t]).track)]
    s = segments(tracks)
    rows = {}
    for t, before, after, open_ in tiling.transitions(s, z, np.full(len(tracks), -1)):
        rows.setdefault(t, {})[before] = after, open_
    for t, known in rows.items():
        one = segments([tracks[t]])
        x, y = geo.point_tile(*one.a[0].tolist(), z)
        tiles = [(x + i) << 32 | (y + j) for i in range(-4, 5) for j in range(-4, 5)] + [b for b in known if b >= 0]
        for before in [-1, *tiles]:
            _, steps = tiling.resolve(one, z, np.array([before]))
            assert known.get(before, known[-2]) == (steps.after[-1], steps.open[-1])


def test_chunks_of_one_activity_make_the_same_lines(spark, monkeypatch):
    """Activities above CHUNK points, cut to chunks that different tasks walk, beside one that isn't."""
    rng = np.random.default_rng(1)
    rows, seq = [], 0
    for a in (1, 2, 3):
        for part in range(7 if a < 3 else 1):
            lng, lat = 13.3 + rng.random() / 50, 52.5 + rng.random() / 50
            for _ in range(int(rng.choice([1, 2, 60, 90])) if a < 3 else 20):
                jump = 0.05 if rng.random() < 0.03 else 0.004
                lng, lat = lng + rng.normal() * jump, lat + rng.normal() * jump
                seq += int(rng.choice([1, 1, 2]))
                rows.append((a, part, seq, lng, lat))
    points = spark.createDataFrame(rows, "activity_id long, part int, seq long, lng double, lat double").repartition(3)
    line = lambda df: sorted((r.activity_id, r.z, r.x, r.y, str([tuple(c) for c in r.coords])) for r in df.collect())
    want = line(tiling.exact(points))
    assert len({r[1] for r in want}) == 5 and len(want) > 100
    for size in (25, 9, 40):
        monkeypatch.setattr(tiling, "CHUNK", size)
        assert line(tiling.exact(points)) == want


def test_walk_drops_the_last_point_and_short_lines():
    assert walked([line(2)], 10) == {}
    got = walked([line(5)], 10)
    assert sum(len(p) for ps in got.values() for p in ps) == 4


def test_walk_splits_at_tile_edges():
    z = 14
    x, y = geo.point_tile(*geo.point(13.37, 52.5), z)
    left, bottom, right, top = geo.tile_bounds(x, y, z)
    mid = (bottom + top) / 2
    pts = [(left + 10, mid), (right - 10, mid), (right + 30, mid), (right + 60, mid), (right + 90, mid)]
    got = walked([pts], z)
    assert set(got) == {(x, y), (x + 1, y)}
    assert got[x, y][0][-1][0] == tiling.EXTENT and got[x + 1, y][0][0][0] == 0
    # a segment over three tiles leaves nothing in the middle one
    size = right - left
    far = [(left + 10, mid), (left + 10 + 2 * size, mid), (left + 20 + 2 * size, mid)]
    assert set(walked([far], z)) == {(x, y), (x + 2, y)}


def test_walk_loses_the_segment_after_a_jump():
    z = 14
    x, y = geo.point_tile(*geo.point(13.37, 52.5), z)
    left, bottom, right, top = geo.tile_bounds(x, y, z)
    mid = (bottom + top) / 2
    size = right - left
    there = left + 4 * size
    pts = [(left + 1, mid), (left + 5, mid), (there + 1, mid), (there + 9, mid), (there + 20, mid), (there + 30, mid)]
    got = walked([pts], z)
    n = sum(len(p) - 1 for p in got.get((x + 4, y), []))
    assert n == 1  # of two segments there the first only moved the walk


def test_simplify():
    lines = [[(0, 0), (5, 1), (10, 0)], [(0, 0), (5, 9), (10, 0)], [(0, 0), (50, 0), (0, 0)], [(3, 3)], [(0, 0), (0, 0), (0, 0)]]
    want = [[(0, 0), (10, 0)], [(0, 0), (5, 9), (10, 0)], [(0, 0), (50, 0), (0, 0)], [(3, 3)], [(0, 0), (0, 0)]]
    pixel, ends = np.array(sum(lines, [])), np.cumsum([len(x) for x in lines])
    keep = tiling.simplified(pixel, ends)
    assert [[tuple(p) for p in pixel[e - len(x) : e][keep[e - len(x) : e]].tolist()] for x, e in zip(lines, ends.tolist())] == want
    assert len(tiling.simplified(np.zeros((0, 2), np.int64), np.zeros(0, np.int64))) == 0


def test_simplify_keeps_within_the_tolerance():
    """Every left-out vertex is near the chord of the kept ones around it, and every kept one is farther than the tolerance from some longer chord."""
    rng = np.random.default_rng(3)
    line = np.cumsum(rng.integers(-9, 10, (400, 2)), axis=0)
    keep = tiling.simplified(line, np.array([400]))
    at = np.flatnonzero(keep)
    assert 2 < len(at) < 400 and keep[0] and keep[-1]

    def away(p, a, b):
        d = b - a
        t = min(max(float((p - a) @ d) / float(d @ d), 0), 1) if (d @ d) else 0
        return math.dist(p, a + t * d)

    for a, b in zip(at, at[1:]):
        assert all(away(line[i], line[a], line[b]) <= tiling.EPSILON for i in range(a + 1, b))


def test_parts_inside_one_tile_are_whole_lines():
    """A line that never leaves its tile is one polyline of its own pixels."""
    rng = np.random.default_rng(5)
    z = 14
    box = geo.tile_bounds(8802, 5373, z)
    pts = np.stack([rng.uniform(box[0], box[2], 50), rng.uniform(box[1], box[3], 50)], 1)
    got = walked([pts], z)
    size = (box[2] - box[0]) / tiling.EXTENT
    assert got == {(8802, 5373): [[(math.floor((x - box[0]) / size + 0.5), math.floor((y - box[1]) / size + 0.5)) for x, y in pts[:-1].tolist()]]}


def test_codec():
    c = [(0, 0), (2048, 65535), (7, 8)]
    assert tiling.decode(tiling.encode(c)) == c and tiling.encode([(1, 2)]) == b"\x01\0\x02\0"
    with pytest.raises(ValueError):
        tiling.decode(b"abc")


def test_exact_and_declarative_cover_the_same_tiles(spark):
    tracks = {a: [(0, 13.3 + 0.004 * i + a * 0.01, 52.5 + 0.001 * math.sin(i), None, i) for i in range(40)] for a in (1, 2)}
    points = frame(spark, tracks)
    for z in (10, 14):
        one = {(r.activity_id, r.x, r.y) for r in tiling.exact(points, [z]).collect()}
        two = {(r.activity_id, r.x, r.y) for r in tiling.segments(points, z).collect()}
        assert one == two


def test_trim_and_domain(spark):
    tracks = {1: [(0, 13.0 + i * 0.001, 52.5, None, i) for i in range(10)], 2: [(0, 0.0, 90.0, None, 0), (0, 0.0, 80.0, None, 1)]}
    p = tiling.projected(frame(spark, tracks))
    assert p.where("activity_id = 2").count() == 1
    kept = {r.seq for r in tiling.trimmed(p, 250.0).where("activity_id = 1").collect()}
    assert kept == set(range(3, 7))
    assert tiling.trimmed(p, 1e9).count() == 0


def test_raster_counts_masks_and_scales(spark):
    z, x, y = 10, 550, 335
    rows = [(1, 10, x, y, [(0, 2048), (2040, 2048)]), (2, 10, x, y, [(0, 2048), (2040, 2048)]), (3, 10, x + 1, y, [(0, 0), (8, 0)])]
    tiles = spark.createDataFrame([(a, z_, x_, y_, [{"x": p, "y": q} for p, q in c]) for a, z_, x_, y_, c in rows], tiling.TILES)
    got = {(r.px, r.py): r.visits for r in raster.rasterize(tiles, [(z, x, y)], 10, 256, 2048).collect()}
    assert got == {(i, 0): 2 for i in range(256)}
    half = {(r.px, r.py): r.visits for r in raster.rasterize(tiles, [(9, x // 2, y // 2)], 10, 256, 2048).collect()}
    assert half[0, 128] == 2 and max(half)[0] == 127
    # a mask at the left end hides its vertex, and with it the line to the next
    left, _, _, top = geo.tile_bounds(x, y, z)
    lng, lat = math.degrees(left / geo.RADIUS), math.degrees(2 * math.atan(math.exp((top - 1) / geo.RADIUS)) - math.pi / 2)
    assert raster.rasterize(tiles, [(z, x, y)], 10, 256, 2048, [(lat, lng, 500.0)]).count() == 0
    with pytest.raises(ValueError):
        raster.scale(10, 10, 2048, 300)


def test_saturation(spark):
    s = spark.range(300).select(F.lit(0).cast("long").alias("x0"), F.lit(0).cast("long").alias("y0"), F.lit(1).cast("long").alias("x1"), F.lit(0).cast("long").alias("y1"))
    assert {r.visits for r in raster.counted(raster.bresenham(s, []), []).collect()} == {255}


def test_lines_are_drawn_vertex_by_vertex(spark):
    """A draw loop that keeps its last vertex while segments miss the tile, on lines along and over the far edges, with masks."""
    rng = np.random.default_rng(6)
    width, z, x, y = 64, 10, 550, 335
    left, bottom, right, top = geo.tile_bounds(x, y, z)
    place = lambda px, py: (math.degrees(2 * math.atan(math.exp((top - (top - bottom) * py / width) / geo.RADIUS)) - math.pi / 2), math.degrees((left + (right - left) * px / width) / geo.RADIUS))
    masks = [(*place(40.5, 60.5), 6 * (right - left) / width), (*place(63, 10), 3 * (right - left) / width)]
    lines = []
    for _ in range(60):
        far = rng.choice([0.1, 0.6, 0.95])
        c = np.where(rng.random((int(rng.integers(1, 30)), 2)) < far, [2048, 0], rng.integers(0, 2049, (1, 2)))
        lines.append([tuple(p) for p in np.where(rng.random(c.shape) < 0.4, rng.integers(0, 2049, c.shape), c).tolist()])
    near = raster.tile_masks(masks, (z, x, y), width)
    want, misses = {}, 0
    for line in lines:
        last = None
        for px, py in line:
            v = px * width // 2048, (2048 - py) * width // 2048
            if any((v[0] - a) ** 2 + (v[1] - b) ** 2 <= r for a, b, r in near):
                last = None
            elif last is None:
                last = v
            elif v != last:
                lo, hi = 0.0, 1.0
                for k in (0, 1):
                    d = v[k] - last[k]
                    if d == 0:
                        hi = -1.0 if last[k] > width - 1 else hi
                        continue
                    s, t = sorted((-last[k] / d, (width - 1 - last[k]) / d))
                    lo, hi = max(lo, s), min(hi, t)
                if lo > hi:
                    misses += 1
                    continue
                (ax, ay), (bx, by) = (tuple(math.floor(last[k] + t * (v[k] - last[k])) for k in (0, 1)) for t in (lo, hi))
                n = max(abs(bx - ax), abs(by - ay))
                for i in range(n + 1):
                    short = i * min(abs(bx - ax), abs(by - ay)) // n if n else 0
                    dx, dy = (short, i) if abs(by - ay) > abs(bx - ax) else (i, short)
                    p = ax + (dx if bx >= ax else -dx), ay + (dy if by >= ay else -dy)
                    want[p] = min(want.get(p, 0) + 1, 255)
                last = v
    tiles = spark.createDataFrame([(i, z, x, y, [{"x": a, "y": b} for a, b in line]) for i, line in enumerate(lines)], tiling.TILES)
    for limit in (raster.BROADCAST, 0):
        raster.BROADCAST, kept = limit, raster.BROADCAST
        got = {(r.px, r.py): r.visits for r in raster.rasterize(tiles, [(z, x, y)], z, width, 2048, masks).collect()}
        raster.BROADCAST = kept
        assert got == want
    assert misses > 30
