"""Column expressions: everything that Catalyst can plan without Python.

"""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EQUATOR = 40075016.68557849
METRES_PER_DEGREE = 111320.0
TILE_SIZE = 512
EXTENT = 4096
BUFFER = 64
MAX_LATITUDE = 85.0511287798066
HASH_MULTIPLIER = 11400714819323198485
POINT, LINE, POLYGON = 0, 1, 2


def lit(x: float) -> Column:
    return F.lit(float(x))


# --- boxes and filters


def bbox_intersects(xmin: Column, ymin: Column, xmax: Column, ymax: Column, q: Sequence[float], keep_missing: bool = True) -> Column:
    """FLT-01/FLT-09: closed boxes intersect; a row with a missing bound is kept. Pushed down to Parquet."""
    hit = (xmax >= lit(q[0])) & (xmin <= lit(q[2])) & (ymax >= lit(q[1])) & (ymin <= lit(q[3]))
    return (xmin.isNull() | ymin.isNull() | xmax.isNull() | ymax.isNull() | hit) if keep_missing else hit


def bbox_empty(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return F.coalesce((xmin > xmax) | (ymin > ymax), F.lit(True))


def point_in_bbox(x: Column, y: Column, q: Sequence[float]) -> Column:
    """FLT-13."""
    return x.between(lit(q[0]), lit(q[2])) & y.between(lit(q[1]), lit(q[3]))


def diagonal2(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    w, h = xmax - xmin, ymax - ymin
    return w * w + h * h


def viewport(west: Column, south: Column, east: Column, north: Column) -> Column:
    """INS-04: a viewport as a box; across the antimeridian it spans all longitudes, latitudes clamp to the poles."""
    wraps = (west < lit(-180)) | (east > lit(180)) | (west > east)
    return F.struct(
        F.when(wraps, lit(-180)).otherwise(west).alias("xmin"), F.greatest(south, lit(-90)).alias("ymin"),
        F.when(wraps, lit(180)).otherwise(east).alias("xmax"), F.least(north, lit(90)).alias("ymax"),
    )


# --- ranks and hashes


def row_hash(row: Column) -> Column:
    """ASG-06: row times a 64-bit constant modulo 2^64, folded by h ^ (h >> 30), as the signed bit pattern."""
    big = lambda n: F.lit(Decimal(n)).cast("decimal(38,0)")
    h = F.pmod(row.cast("decimal(20,0)") * F.lit(Decimal(HASH_MULTIPLIER)).cast("decimal(20,0)"), big(2**64))
    signed = F.when(h >= big(2**63), h - big(2**64)).otherwise(h).cast("long")
    return signed.bitwiseXOR(F.shiftrightunsigned(signed, 30))


def unsigned_order(h: Column) -> Column:
    """A signed column that sorts as the unsigned value of h does."""
    return h.bitwiseXOR(F.lit(-(2**63)))


# --- levels


def visible_level(kind: Column, box: Sequence[Column], ladder: Sequence[float], line_factor: float = 4.0, polygon_factor: float = 4.0) -> Column:
    """FLT-12/ASG-09: first level where the diagonal reaches factor x resolution; points at 0, empty boxes last, no extent at 0."""
    d2, last = diagonal2(*box), len(ladder) - 1
    out = F.when(bbox_empty(*box), last).when(kind == POINT, 0).when(d2 <= 0, 0)
    for i, r in enumerate(ladder):
        reach = F.when(kind == LINE, lit((r * line_factor) ** 2)).otherwise(lit((r * polygon_factor) ** 2))
        out = out.when(d2 >= reach, i)
    return out.otherwise(last).cast("int")


def cell(center: Column, pitch: float) -> Column:
    """ASG-07: a grid cell as a double, so that no coordinate overflows."""
    return F.floor(center / lit(pitch)).cast("double")


def web_mercator_ladder(min_zoom: int = 0, max_zoom: int = 17) -> list[float]:
    """LVL-12."""
    if not 0 <= min_zoom <= max_zoom <= 30:
        raise ValueError("zooms must satisfy 0 <= min <= max <= 30")
    return [EQUATOR / (TILE_SIZE * 2.0**z) for z in range(min_zoom, max_zoom + 1)]


# --- tiles


def tile_latitude(y: Column, z: Column) -> Column:
    """Latitude of a tile edge."""
    return F.degrees(F.atan(F.sinh(lit(math.pi) * (lit(1) - lit(2) * y / F.pow(lit(2), z)))))


def tile_bbox(z: Column, x: Column, y: Column) -> Column:
    """LVL-11: box of a tile with its rendering buffer, in degrees."""
    pad, n = BUFFER / EXTENT, F.pow(lit(2), z)
    lon = lambda t: t / n * lit(360) - lit(180)
    return F.struct(
        lon(x - lit(pad)).alias("xmin"), tile_latitude(y + lit(1 + pad), z).alias("ymin"),
        lon(x + lit(1 + pad)).alias("xmax"), tile_latitude(y - lit(pad), z).alias("ymax"),
    )


def tile_resolution(z: Column, y: Column) -> Column:
    """LVL-11: degrees for one pixel of a tile, at its middle latitude."""
    return lit(360) * F.cos(F.radians(tile_latitude(y + lit(0.5), z))) / (lit(TILE_SIZE) * F.pow(lit(2), z))


def half_up(x: Column) -> Column:
    """Rounds half towards plus infinity (0.49999999999999994 stays below)."""
    f = F.floor(x)
    return F.when(x - f >= lit(0.5), f + 1).otherwise(f).cast("long")


def mercator_y(lat: Column) -> Column:
    """0 at the north edge of the world, 1 at the south edge."""
    s = F.sin(F.radians(F.greatest(lit(-MAX_LATITUDE), F.least(lit(MAX_LATITUDE), lat))))
    return lit(0.5) - F.log((lit(1) + s) / (lit(1) - s)) / lit(4 * math.pi)


def tile_pixel(lon: Column, lat: Column, z: int, x: int, y: int) -> Column:
    """GEO-31: pixel of a point in a tile, moved to the copy of the world nearest to the tile's middle."""
    n = 2.0**z
    world = lit(n * EXTENT)
    px = ((lon + lit(180)) / lit(360) * lit(n) - lit(x)) * lit(EXTENT)
    px = px + half_up((lit(EXTENT / 2) - px) / world) * world
    py = (mercator_y(lat) * lit(n) - lit(y)) * lit(EXTENT)
    return F.struct(half_up(px).alias("px"), half_up(py).alias("py"))


def tile_of(lon: Column, lat: Column, z: int) -> Column:
    n = 2**z
    clamp = lambda c: F.least(F.greatest(F.floor(c * lit(n)).cast("long"), F.lit(0).cast("long")), F.lit(n - 1).cast("long"))
    return F.struct(clamp((lon + lit(180)) / lit(360)).alias("x"), clamp(mercator_y(lat)).alias("y"))


# --- quantization and metrics


def quantize(v: Column, scale: float, offset: float) -> Column:
    """GEO-09/GEO-21: cells of a grid, half away from zero."""
    return F.round((v - lit(offset)) / lit(scale)).cast("long")


def dequantize(q: Column, scale: float, offset: float) -> Column:
    """GEO-05."""
    return lit(offset) + lit(scale) * q.cast("double")


def dequantize_parts(parts: Column, scale: Sequence[float], offset: Sequence[float]) -> Column:
    """GEO-05 over nested lists of depth three."""
    point = lambda p: F.struct(dequantize(p["x"], scale[0], offset[0]).alias("x"), dequantize(p["y"], scale[1], offset[1]).alias("y"))
    return F.transform(parts, lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, point)))


def signed_area(ring: Column) -> Column:
    """GEO-12: area of a closed ring (array of x, y), its coordinates shifted to the first vertex; positive if counter-clockwise."""
    o, n = ring[0], F.size(ring)
    terms = F.zip_with(
        F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1),
        lambda a, b: (a["x"] - o["x"]) * (b["y"] - o["y"]) - (b["x"] - o["x"]) * (a["y"] - o["y"]),
    )
    return F.aggregate(terms, lit(0), lambda s, t: s + t) / lit(2)


def line_length(line: Column) -> Column:
    """GEO-12."""
    n = F.size(line)
    steps = F.zip_with(F.slice(line, 1, n - 1), F.slice(line, 2, n - 1), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.aggregate(steps, lit(0), lambda s, t: s + t)


def segment_distance2(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """GEO-11: squared distance from a point to a segment."""
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    t = F.when(len2 > 0, F.greatest(lit(0), F.least(lit(1), ((px - ax) * dx + (py - ay) * dy) / len2))).otherwise(lit(0))
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return ex * ex + ey * ey


def wkb_kind(wkb: Column) -> Column:
    """ASG-02: dimension from the first five bytes; null for a collection, whose members decide."""
    little = F.substring(wkb, 1, 1) == F.unhex(F.lit("01"))
    code = F.hex(F.substring(wkb, 2, 4))
    swapped = F.concat(F.substring(code, 7, 2), F.substring(code, 5, 2), F.substring(code, 3, 2), F.substring(code, 1, 2))
    base = F.conv(F.when(little, swapped).otherwise(code), 16, 10).cast("long").bitwiseAND(F.lit(0x0FFFFFFF).cast("long")) % 1000
    return F.when(base.isin(1, 4), POINT).when(base.isin(2, 5), LINE).when(base.isin(3, 6), POLYGON).cast("int")
