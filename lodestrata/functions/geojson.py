"""GeoJSON features from columns: nothing but Catalyst expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def geometry_json(kind: Column, parts: Column) -> Column:
    """GEO-04: the geometry object as JSON text; null geometry gives null, an empty one empty coordinates."""
    xy = lambda p: F.array(p["x"], p["y"])
    ring = lambda r: F.transform(r, xy)
    rings = lambda p: F.transform(p, ring)
    first = F.get(parts, 0)
    empty = F.array().cast("array<double>")

    def obj(name: str, coords: Column) -> Column:
        return F.to_json(F.struct(F.lit(name).alias("type"), coords.alias("coordinates")))

    return (
        F.when(parts.isNull(), None)
        .when(kind == 1, obj("Point", F.coalesce(xy(F.get(F.get(first, 0), 0)), empty)))
        .when(kind == 2, obj("LineString", F.coalesce(ring(F.get(first, 0)), F.array())))
        .when(kind == 3, obj("Polygon", F.coalesce(rings(first), F.array())))
        .when(kind == 4, obj("MultiPoint", F.transform(parts, lambda p: xy(p[0][0]))))
        .when(kind == 5, obj("MultiLineString", F.transform(parts, lambda p: ring(p[0]))))
        .when(kind == 6, obj("MultiPolygon", F.transform(parts, rings)))
    )


def feature_json(geometry: Column, properties: Sequence[str], fid: str | None = None) -> Column:
    """SNK-14: one Feature as JSON text; geometry is JSON text."""
    props = F.to_json(F.struct(*properties), {"ignoreNullFields": "false"}) if properties else F.lit("{}")
    head = [F.lit('{"type":"Feature"')] + ([F.lit(',"id":'), F.col(fid).cast("string")] if fid else [])
    return F.concat(*head, F.lit(',"geometry":'), F.coalesce(geometry, F.lit("null")), F.lit(',"properties":'), props, F.lit("}"))


def feature_collection(features: DataFrame, feature: str, order: str) -> DataFrame:
    """SNK-14: one FeatureCollection: for results that a screen can hold (limit them first)."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, feature))), lambda x: x[feature])
    return features.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(listed, ","), F.lit("]}")).alias("geojson"))


def display(c: Column, kind: str) -> Column:
    """GEO-37: property values as a map shows them: null is empty, bytes are counted, dates are ISO, nested values JSON."""
    if kind == "binary":
        out = F.concat(F.lit("<bytes:"), F.length(c), F.lit(">"))
    elif kind in ("double", "float"):
        d = c.cast("double")
        whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
        out = F.when(F.isnan(d), "NaN").when(d == float("inf"), "Infinity").when(d == float("-inf"), "-Infinity").when(whole, d.cast("decimal(38,0)").cast("string")).otherwise(d.cast("string"))
    elif kind.startswith("timestamp"):
        out = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    elif kind == "date":
        out = F.date_format(c, "yyyy-MM-dd'T00:00:00.000Z'")
    elif kind.startswith(("struct", "array", "map")):
        out = F.to_json(c)
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit(""))
