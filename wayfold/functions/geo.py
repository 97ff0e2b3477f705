"""Web-Mercator and tile arithmetic as Column expressions (all stay in whole-stage codegen)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earth radius of the Mercator projection and mean radius (metres), the latitude domain, the largest gap between two points of a line.
RADIUS = 6378137.0
MEAN_RADIUS = 6371008.8
LAT_MIN, LAT_MAX = -89.99999, 90.0
MAX_GAP = 5000.0
CIRCLE = 2 * math.pi * RADIUS
HALF = CIRCLE / 2


def half_away(x: Column) -> Column:
    """Round to a whole number, halves away from zero."""
    return F.when(x >= 0, F.floor(x + 0.5)).otherwise(F.ceil(x - 0.5)).cast("long")


def haversine(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Metres on the mean sphere."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), F.lit(2.0))
    return 2 * MEAN_RADIUS * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def mercator(lng: Column, lat: Column) -> tuple[Column, Column]:
    """x and y in metres; null outside the latitude domain."""
    inside = (lat >= LAT_MIN) & (lat < LAT_MAX)
    return F.when(inside, F.radians(lng) * RADIUS), F.when(inside, F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * RADIUS)


def wrap(lng: Column) -> Column:
    """Longitudes below -180 brought back by whole turns; those above 180 stay."""
    return F.when(lng < -180, lng + 360 * F.ceil((-180 - lng) / 360)).otherwise(lng)


def tile(x: Column, y: Column, z: Column | int) -> tuple[Column, Column]:
    """Column and row of the tile of a Mercator point, counted from the north-west; never below 0."""
    n = F.pow(F.lit(2.0), F.lit(z) if isinstance(z, int) else z) / CIRCLE
    return F.greatest(F.floor(n * (x + HALF)), F.lit(0)).cast("long"), F.greatest(F.floor(n * (HALF - y)), F.lit(0)).cast("long")


def bounds(x: Column, y: Column, z: Column | int) -> tuple[Column, Column, Column, Column]:
    """left, bottom, right and top of a tile in metres."""
    size = F.lit(CIRCLE) / F.pow(F.lit(2.0), F.lit(z) if isinstance(z, int) else z)
    return x * size - HALF, HALF - (y + 1) * size, (x + 1) * size - HALF, HALF - y * size


def global_pixel(x: Column, y: Column, z: Column | int, extent: int) -> tuple[Column, Column]:
    n = F.pow(F.lit(2.0), F.lit(z) if isinstance(z, int) else z) * float(extent) / CIRCLE
    return n * (x + HALF), n * (HALF - y)


def tile_pixel(x: Column, y: Column, box: tuple[Column, Column, Column, Column], extent: int) -> tuple[Column, Column]:
    """Pixel in a tile of extent pixels, from its top left."""
    left, bottom, right, top = box
    return half_away((x - left) / (right - left) * extent), F.lit(extent) - half_away((y - bottom) / (top - bottom) * extent)


def contains(x: Column, y: Column, box: tuple[Column, Column, Column, Column]) -> Column:
    left, bottom, right, top = box
    return (x >= left) & (x <= right) & (y >= bottom) & (y <= top)


def meets_circle(cx: Column, cy: Column, r: Column, box: tuple[Column, Column, Column, Column]) -> Column:
    """Whether a circle touches a box."""
    left, bottom, right, top = box
    dx, dy = cx - F.greatest(left, F.least(cx, right)), cy - F.greatest(bottom, F.least(cy, top))
    return dx * dx + dy * dy <= r * r


def outcode(x: Column, y: Column, box: tuple[Column, Column, Column, Column]) -> Column:
    """1 left, 2 right, 4 below, 8 above the box, summed."""
    left, bottom, right, top = box
    one = lambda c, v: F.when(c, v).otherwise(0)
    return one(x < left, 1) + one(x > right, 2) + one(y < bottom, 4) + one(y > top, 8)


def clip(x1: Column, y1: Column, x2: Column, y2: Column, box: tuple[Column, Column, Column, Column]) -> tuple[Column, Column]:
    """Start and end, as shares of the segment, of its part inside the box (Liang-Barsky); null if there is none."""
    left, bottom, right, top = box
    dx, dy = x2 - x1, y2 - y1
    enter, leave, out = F.lit(0.0), F.lit(1.0), F.lit(False)
    for d, low, high, at in ((dx, left, right, x1), (dy, bottom, top, y1)):
        a, b = (low - at) / F.nullif(d, F.lit(0.0)), (high - at) / F.nullif(d, F.lit(0.0))
        enter = F.greatest(enter, F.least(a, b))  # nulls (no slope) are skipped
        leave = F.least(leave, F.greatest(a, b))
        out = out | ((d == 0) & ((at < low) | (at > high)))
    inside = ~out & (enter <= leave)
    return F.when(inside, enter), F.when(inside, leave)


def descendants(x: int, y: int, z: int, source: int) -> tuple[int, int, int, int]:
    """xmin, ymin, xmax, ymax (these exclusive) of a tile's descendants at zoom source."""
    if source < z:
        raise ValueError("the source zoom is above the tile")
    d = source - z
    return x << d, y << d, (x + 1) << d, (y + 1) << d


def source_zoom(zooms: list[int], z: int) -> int | None:
    """The first stored zoom, in the order of the list, that is not below z."""
    return next((s for s in zooms if s >= z), None)


# the same for single points on the driver


def point(lng: float, lat: float) -> tuple[float, float] | None:
    if not LAT_MIN <= lat < LAT_MAX:
        return None
    return math.radians(lng) * RADIUS, math.log(math.tan(math.radians(lat) / 2 + math.pi / 4)) * RADIUS


def point_tile(x: float, y: float, z: int) -> tuple[int, int]:
    n = 2.0**z / CIRCLE
    return max(0, math.floor(n * (x + HALF))), max(0, math.floor(n * (HALF - y)))


def tile_bounds(x: int, y: int, z: int) -> tuple[float, float, float, float]:
    size = CIRCLE / 2**z
    return x * size - HALF, HALF - (y + 1) * size, (x + 1) * size - HALF, HALF - y * size


def parse_tile(text: str) -> tuple[int, int, int]:
    """z, x, y of "z/x/y"."""
    parts = text.split("/")
    if len(parts) != 3 or not all(p.isascii() and p.isdigit() for p in parts):
        raise ValueError(f"not a tile: {text!r}")
    z, x, y = map(int, parts)
    if z > 30 or x >= 1 << z or y >= 1 << z:
        raise ValueError(f"no such tile: {text!r}")
    return z, x, y


def parse_point(text: str) -> tuple[float, float]:
    """lat and lng of "lat,lng", in range."""
    try:
        lat, lng = (float(p.strip()) for p in text.split(","))
    except ValueError:
        raise ValueError(f"not a point: {text!r}") from None
    if not -90 <= lat <= 90 or not -180 <= lng <= 180:
        raise ValueError(f"out of range: {text!r}")
    return lat, lng


def parse_viewport(text: str) -> tuple[float, float, float, float]:
    """west, south, east, north; parts that are no numbers are skipped before they are counted."""
    values = []
    for p in text.split(","):
        try:
            values.append(float(p.strip()))
        except ValueError:
            continue
    if len(values) != 4:
        raise ValueError("a viewport is west,south,east,north")
    w, s, e, n = values
    if w > e:
        raise ValueError("west and east are swapped")
    if s > n:
        raise ValueError("south and north are swapped")
    return w, s, e, n


def viewport_tiles(view: tuple[float, float, float, float], width: int, height: int, zooms: list[int], size: int = 256) -> tuple[int, int, int, int, int]:
    """Zoom and inclusive tile range (xmin, ymin, xmax, ymax) that shows a viewport on so many pixels."""
    w, s, e, n = view
    a, b = point(w, s), point(e, n)
    if a is None or b is None:
        raise ValueError("the viewport leaves the projection")
    low, high = min(zooms), max(zooms)
    dx, dy = ((hi - lo) / CIRCLE * size * 2**high for lo, hi in zip(a, b))
    more = math.log2(max(dx / width, dy / height, 1e-12))
    z = min(max(high - max(0, math.floor(more)), low), high)
    x0, y1 = point_tile(*a, z)
    x1, y0 = point_tile(*b, z)
    return z, x0, y0, x1, y1
