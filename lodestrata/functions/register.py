"""SQL functions: register(spark) makes the geometry functions callable from spark.sql."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.mvt import geometry_commands, varint
from lodestrata.functions.overview import Grid, render
from lodestrata.functions.wkb import BOX, NAMES, box_and_kind, parse


def register(spark: SparkSession) -> None:
    """lod_bbox(wkb), lod_kind(wkb), lod_overview(wkb, resolution), lod_geojson(wkb), lod_mvt_geometry(wkb, z, x, y)."""

    @F.arrow_udf(BOX)
    def lod_bbox(a: pa.Array) -> pa.Array:
        rows = [box_and_kind(w) for w in a.to_pylist()]
        return pa.array([dict(zip(("xmin", "ymin", "xmax", "ymax", "kind"), (*((None,) * 4 if r[0] > r[2] else r[:4]), r[4]), strict=True)) for r in rows], pa.struct([(c, pa.float64()) for c in ("xmin", "ymin", "xmax", "ymax")] + [("kind", pa.int32())]))

    @F.arrow_udf("int")
    def lod_kind(a: pa.Array) -> pa.Array:
        return pa.array([None if w is None else box_and_kind(w)[4] for w in a.to_pylist()], pa.int32())

    @F.arrow_udf("string")
    def lod_overview(a: pa.Array, r: pa.Array) -> pa.Array:
        out = []
        for w, res in zip(a.to_pylist(), r.to_pylist(), strict=True):
            made = render(parse(w), Grid.of(res)) if w is not None else None
            out.append(None if made is None else json.dumps(made))
        return pa.array(out, pa.string())

    @F.arrow_udf("string")
    def lod_geojson(a: pa.Array) -> pa.Array:
        return pa.array([None if w is None else json.dumps(shape(parse(w)), separators=(",", ":")) for w in a.to_pylist()], pa.string())

    @F.arrow_udf("binary")
    def lod_mvt_geometry(a: pa.Array, z: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
        rows = zip(a.to_pylist(), z.to_pylist(), x.to_pylist(), y.to_pylist(), strict=True)
        return pa.array([None if w is None else b"".join(map(varint, geometry_commands(parse(w), *t))) for w, *t in rows], pa.binary())

    for f in (lod_bbox, lod_kind, lod_overview, lod_geojson, lod_mvt_geometry):
        spark.udf.register(f.__name__, f)


def shape(g) -> dict:
    parts = [[r.tolist() for r in p] for p in g.parts]
    flat = {1: lambda: parts[0][0][0] if parts else [], 2: lambda: parts[0][0] if parts else [], 3: lambda: parts[0] if parts else [], 4: lambda: [p[0][0] for p in parts], 5: lambda: [p[0] for p in parts], 6: lambda: parts}
    return {"type": NAMES[g.type], "coordinates": flat[g.type]()}
