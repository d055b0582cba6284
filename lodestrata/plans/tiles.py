"""Tiles: URL templates, tile assignment and batch rendering."""

from __future__ import annotations

import base64
import json
import math
import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import expr as X
from lodestrata.functions.mvt import Layer, layer
from lodestrata.functions.wkb import from_nested
from lodestrata.sources.reader import LodTable
from lodestrata.sources.shared import spread

SCHEME = "lodestrata"
MAX_ZOOM = 24


def normalized(layers: Mapping[str, Mapping]) -> list[dict]:
    out = []
    for name in sorted(layers):
        spec = layers[name]
        if not name or "url" not in spec:
            raise ValueError("a layer needs a name and a url")
        one = {"name": name, "url": spec["url"]}
        if spec.get("properties") is not None:
            one["properties"] = dict(sorted(spec["properties"].items()))
        if spec.get("max_rows") is not None:
            one["max_rows"] = int(spec["max_rows"])
        out.append(one)
    return out


def tile_url(layers: Mapping[str, Mapping]) -> str:
    """FN-01: a URL template; equal layers give equal templates."""
    body = json.dumps(normalized(layers), separators=(",", ":"), ensure_ascii=False).encode()
    return f"{SCHEME}://{base64.urlsafe_b64encode(body).decode().rstrip('=')}/{{z}}/{{x}}/{{y}}"


def parse_tile_url(url: str) -> tuple[list[dict], int, int, int]:
    """FN-02."""
    m = re.fullmatch(rf"{SCHEME}://([A-Za-z0-9_-]+)/(\d+)/(\d+)/(\d+)", url)
    if not m:
        raise ValueError(f"not a tile URL: {url}")
    layers = json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
    z, x, y = int(m[2]), int(m[3]), int(m[4])
    if z > MAX_ZOOM or x >= 2**z or y >= 2**z:
        raise ValueError(f"no tile {z}/{x}/{y}")
    names = [one["name"] for one in layers]
    if len(set(names)) != len(names):
        raise ValueError("duplicate layer names")
    return layers, z, x, y


def tile_window(z: int, x: int, y: int) -> tuple[tuple[float, float, float, float], float]:
    """LVL-11 for one tile: buffered box and resolution."""
    n, pad = 2.0**z, X.BUFFER / X.EXTENT
    lat = lambda t: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * t / n))))
    lon = lambda t: t / n * 360.0 - 180.0
    box = (lon(x - pad), lat(y + 1 + pad), lon(x + 1 + pad), lat(y - pad))
    return box, 360.0 * math.cos(math.radians(lat(y + 0.5))) / (X.TILE_SIZE * n)


def assign_tiles(rows: DataFrame, z: int, x: str = "x", y: str = "y") -> DataFrame:
    """SNK-15: tile of each point, tile_x and tile_y."""
    t = X.tile_of(F.col(x), F.col(y), z)
    return rows.withColumn("__t", t).select("*", F.col("__t.x").alias("tile_x"), F.col("__t.y").alias("tile_y")).drop("__t")


def tiles_of_boxes(rows: DataFrame, z: int) -> DataFrame:
    """Tiles that a row's box meets: rows are repeated for each, by a sequence over its own tile range."""
    lo, hi = X.tile_of(F.col("xmin"), F.col("ymax"), z), X.tile_of(F.col("xmax"), F.col("ymin"), z)
    out = rows.where("xmin IS NOT NULL").withColumns({"__lo": lo, "__hi": hi})
    out = out.withColumn("tile_x", F.explode(F.sequence("__lo.x", "__hi.x"))).withColumn("tile_y", F.explode(F.sequence("__lo.y", "__hi.y")))
    return out.drop("__lo", "__hi")


def single_points(g: pa.Array) -> np.ndarray | None:
    """(n, 2) of geometries that are all of one point, else None."""
    if g.null_count or not (pa.compute.equal(pa.compute.struct_field(g, "type"), 1)).to_numpy(zero_copy_only=False).all():
        return None
    parts = pa.compute.struct_field(g, "parts")
    for _ in range(3):
        if parts.null_count or (pa.compute.list_value_length(parts).to_numpy(zero_copy_only=False) != 1).any():
            return None
        parts = parts.flatten()
    if parts.null_count or any(pa.compute.struct_field(parts, c).null_count for c in "xy"):
        return None
    return np.column_stack([pa.compute.struct_field(parts, c).to_numpy(zero_copy_only=False) for c in "xy"])


def render_tiles(rows: DataFrame, z: int, properties: Sequence[str], name: str = "layer", order: str = "row_index") -> DataFrame:
    """SNK-15/GEO-33/GEO-38: (z, tile_x, tile_y, tile) from rows (row_index, geometry, properties, tile_x, tile_y).

    All rows are rendered. Spark sorts them, so that a task holds what one tile has of encoded features; a tile is one value,
    so where tiles may grow too large, limit rows first (per_tile).
    """
    fields = [*properties]

    def one(layer_: Layer, at: tuple[int, int]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([z], pa.int32()), pa.array([at[0]]), pa.array([at[1]]), pa.array([layer_.tile()], pa.binary())], names=["z", "tile_x", "tile_y", "tile"])

    def add(to: Layer, b: pa.RecordBatch) -> None:
        own = {p: b.column(b.schema.get_field_index(p)) for p in fields}
        ids = b.column(b.schema.get_field_index(order))
        if (xy := single_points(b.column(b.schema.get_field_index("geometry")))) is not None:
            to.add_points(ids.to_pylist(), xy, {p: c.to_pylist() for p, c in own.items()})
            return
        for r in b.to_pylist():
            if r["geometry"] is not None:
                to.add(r[order], from_nested(r["geometry"]["type"], r["geometry"]["parts"]), {p: r[p] for p in fields})

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = now = None
        for b in batches:
            x, y = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("tile_x", "tile_y"))
            turns = {0, *(np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1).tolist(), *range(0, len(x), 1000)} if len(x) else set()
            stops = [*sorted(turns), len(x)]
            for i, j in zip(stops, stops[1:], strict=False):
                if (key := (int(x[i]), int(y[i]))) != at:
                    if now is not None:
                        yield one(now, at)
                    at, now = key, Layer(name, z, *key)
                add(now, b.slice(i, j - i))
        if now is not None:
            yield one(now, at)

    narrow = rows.select(*dict.fromkeys([order, "geometry", *fields, "tile_x", "tile_y"]))
    dealt = spread(narrow, "tile_x", "tile_y").sortWithinPartitions("tile_x", "tile_y", F.asc_nulls_last(order))
    return dealt.mapInArrow(render, "z int, tile_x long, tile_y long, tile binary")


def render_tile(spark: SparkSession, url: str, tables: dict[str, LodTable]) -> bytes:
    """FN-03: bytes of one tile of a URL; tables keeps opened files, the eight last used. Rows of the tile come to the driver one partition at a time."""
    layers, z, x, y = parse_tile_url(url)
    box, resolution = tile_window(z, x, y)
    out = b""
    for one in layers:
        t = tables.pop(one["url"], None) or LodTable.open(spark, one["url"])
        tables[one["url"]] = t  # JOI-09: the last used stands last
        while len(tables) > 8:
            tables.pop(next(iter(tables)))
        props = one.get("properties")
        df = t.read(t.select_level(resolution), box, props, use_overview=True, max_rows=one.get("max_rows"))
        names = [c for c in df.columns if c not in ("row_index", "geometry")]
        features = ((r["row_index"], from_nested(r["geometry"]["type"], [[[q.asDict() for q in ring] for ring in p] for p in r["geometry"]["parts"]]), {c: r[c] for c in names}) for r in df.orderBy("row_index").toLocalIterator() if r["geometry"] is not None and r["geometry"]["parts"] is not None)
        out += layer(one["name"], features, z, x, y)
    return out
