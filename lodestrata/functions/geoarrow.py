"""GeoArrow: Arrow tables and IPC streams with a geometry extension column."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

import pyarrow as pa

from lodestrata.functions.wkb import Geometry

NAMES = ("multipoint", "multilinestring", "multipolygon")


def geometry_array(geoms: Sequence[Geometry | None]) -> tuple[pa.Array, str]:
    """GEO-35: lists over fixed-size lists of doubles, one, two or three deep; mixed families are an error, all null is multipolygon."""
    kinds = {g.kind for g in geoms if g is not None}
    if len(kinds) > 1:
        raise ValueError("geometries of several families")
    kind = kinds.pop() if kinds else 2
    dims = max((r.shape[1] for g in geoms if g for r in g.points()), default=2)
    pad = lambda p: p + [float("nan")] * (dims - len(p))
    rows: list[Any] = []
    for g in geoms:
        if g is None:
            rows.append(None)
        elif kind == 0:
            rows.append([pad(p) for part in g.parts for p in part[0].tolist()])
        elif kind == 1:
            rows.append([[pad(p) for p in part[0].tolist()] for part in g.parts])
        else:
            rows.append([[[pad(p) for p in r.tolist()] for r in part] for part in g.parts])
    t: pa.DataType = pa.list_(pa.float64(), dims)
    for _ in range(kind + 1):
        t = pa.list_(t)
    return pa.array(rows, t), f"geoarrow.{NAMES[kind]}"


def to_table(geoms: Sequence[Geometry | None], properties: pa.Table, ids: Sequence[int] | None = None, id_name: str = "rowIndex", geometry_name: str = "geometry", crs: Any = None) -> pa.Table:
    """SNK-16: ids, attributes, geometry, in this order."""
    names = ([id_name] if ids is not None else []) + properties.schema.names + [geometry_name]
    if len(set(names)) != len(names):
        raise ValueError("duplicate field names")
    if len(properties) != len(geoms) or (ids is not None and len(ids) != len(geoms)):
        raise ValueError("columns of different length")
    column, extension = geometry_array(geoms)
    meta = {b"ARROW:extension:name": extension.encode(), b"ARROW:extension:metadata": json.dumps({} if crs is None else {"crs": crs}).encode()}
    arrays = ([pa.array(ids, pa.int64())] if ids is not None else []) + [c.combine_chunks() for c in properties.columns] + [column]
    fields = ([pa.field(id_name, pa.int64())] if ids is not None else []) + list(properties.schema) + [pa.field(geometry_name, column.type, metadata=meta)]
    return pa.table(arrays, schema=pa.schema(fields))


def to_ipc(table: pa.Table) -> bytes:
    """SNK-17: one stream with one record batch."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table.combine_chunks(), max_chunksize=max(1, len(table)))
    return out.getvalue().to_pybytes()
