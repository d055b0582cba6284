"""Validate a level-of-detail file: footer rules on the driver, values in one Spark job."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.overview import problem
from lodestrata.operators.stats import coverage, coverage_errors
from lodestrata.sources import footer as footers
from lodestrata.sources.datasource import ROW_INDEX, read_row_groups
from lodestrata.sources.meta import CORNERS, DEPTH, FAMILIES, GeoMeta, MetaError, parse


@dataclass
class Report:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    overview_encoding: str | None = None
    overviews_validated: bool = False

    @property
    def valid(self) -> bool:
        return not self.errors

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [("error", m) for m in self.errors] + [("warning", m) for m in self.warnings]
        return spark.createDataFrame(rows, "severity string, message string")

    def text(self) -> str:
        """SNK-18."""
        lines = [f"error: {m}" for m in self.errors] + [f"warning: {m}" for m in self.warnings]
        return "\n".join([*lines, "valid" if self.valid else "invalid"])


def check_geo(raw: bytes | None, rows: int, n_row_groups: int, report: Report) -> GeoMeta | None:
    """VAL-04/VAL-05."""
    if raw is None:
        report.errors.append("the file has no geo metadata")
        return None
    try:
        geo = json.loads(raw)
    except ValueError as e:
        report.errors.append(f"geo metadata is not JSON: {e}")
        return None
    if not isinstance(geo.get("version"), str) or not geo["version"]:
        report.errors.append("geo.version is missing")
    for name, c in (geo.get("columns") or {}).items():
        if not c.get("encoding"):
            report.errors.append(f"column {name} has no encoding")
        if not isinstance(c.get("geometry_types"), list):
            report.errors.append(f"column {name} has no geometry_types")
    if geo.get("primary_column") not in (geo.get("columns") or {}):
        report.errors.append("primary_column is not among the columns")
    if rows == 0 and "lod" in geo:
        report.errors.append("an empty file must not have lod")
    if rows and geo.get("lod") is None:
        report.errors.append("geo.lod is missing")
    if report.errors or rows == 0:
        return None
    try:
        return parse(raw, n_row_groups)
    except MetaError as e:
        report.errors.append(str(e))
        return None


def check_schema(schema: pa.Schema, geo: GeoMeta, report: Report) -> None:
    """VAL-06/VAL-07/VAL-08: the overview column's physical shape."""
    o = geo.overviews
    if o.column == geo.primary or o.column not in schema.names:
        report.errors.append(f"overview column {o.column} is missing or is the primary column")
        return
    if geo.family not in ("line", "polygon"):
        report.errors.append("overviews need geometry types of one line or polygon family")
        return
    f = schema.field(o.column)
    if f.nullable or not pa.types.is_struct(f.type):
        report.errors.append(f"{o.column} must be a required struct")
        return
    names = {c.name for c in f.type}
    if names != {x.name for x in o.lods}:
        report.errors.append(f"children of {o.column} and lods differ")
        return
    for x in o.lods:
        if FAMILIES[x.geometry_type] != geo.family:
            report.errors.append(f"lod {x.name}: {x.geometry_type} is not of the {geo.family} family")
        child = f.type.field(x.name)
        t, ok = child.type, child.nullable
        for _ in range(DEPTH[x.geometry_type]):
            ok = ok and pa.types.is_list(t) and not t.value_field.nullable
            t = t.value_type if pa.types.is_list(t) else t
        ok = ok and pa.types.is_struct(t) and [(c.name, c.type, c.nullable) for c in t] == [("x", pa.int32(), False), ("y", pa.int32(), False)]
        if not ok:
            report.errors.append(f"lod {x.name}: must be a nullable list of depth {DEPTH[x.geometry_type]} of required x and y of 32 bits")
        if (child.metadata or {}).get(b"ARROW:extension:name", b"").startswith(b"geoarrow."):
            report.errors.append(f"lod {x.name}: must not carry a geoarrow extension name")


def check(spark: SparkSession, path: str) -> Report:
    """VAL-01..VAL-13."""
    report = Report()
    f = footers.open_file(path)
    md = f.metadata
    geo = check_geo((md.metadata or {}).get(b"geo"), md.num_rows, md.num_row_groups, report)
    if geo is None:
        return report
    if geo.overviews:
        report.overview_encoding = geo.overviews.encoding
        if geo.overviews.supported:
            check_schema(f.schema_arrow, geo, report)
        else:
            report.warnings.append(f"unknown overview encoding {geo.overviews.encoding}: overviews not validated")
    for corner, p in zip(CORNERS, geo.covering or (), strict=False):
        leaf = footers.leaf_index(md, p)
        if leaf is None:
            report.errors.append(f"covering path {'.'.join(p)} is not in the file")
            continue
        for g in range(md.num_row_groups):
            s = md.row_group(g).column(leaf).statistics
            if s is None or not s.has_min_max:
                report.warnings.append(f"row group {g}: no statistics for {corner}")
    if not report.errors and geo.overviews and geo.overviews.supported:
        check_values(spark, path, md, geo, report)
        report.overviews_validated = True
    return report


def faults(kind: str):
    @F.arrow_udf("string")
    def run(a: pa.Array) -> pa.Array:
        return pa.array([None if not v.is_valid else problem(v.as_py(), kind) for v in a], pa.string())

    return run


def check_values(spark: SparkSession, path: str, md, geo: GeoMeta, report: Report) -> None:
    """VAL-10/VAL-11/VAL-13: coverage for each row group, and the first bad value of each LoD in file order."""
    o = geo.overviews
    rows = read_row_groups(spark, path, None, [o.column])
    ends, at = [], 0
    for g in range(md.num_row_groups):
        at += md.row_group(g).num_rows
        ends.append((g, at - md.row_group(g).num_rows, at))
    groups = F.broadcast(spark.createDataFrame(ends, "rg int, lo long, hi long"))
    rows = rows.join(groups, (F.col(ROW_INDEX) >= F.col("lo")) & (F.col(ROW_INDEX) < F.col("hi")))
    flat = rows.select("rg", ROW_INDEX, *(F.col(f"`{o.column}`.`{x.name}`").alias(x.name) for x in o.lods))
    bounds = spark.createDataFrame([(x.name, geo.lod_row_group_end(x)) for x in o.lods], "lod string, row_group_end int")
    for r in coverage_errors(coverage(flat, [x.name for x in o.lods]), bounds).orderBy("rg", "lod").limit(20).collect():
        report.errors.append(f"row group {r.rg}: lod {r.lod} has {r.nulls} nulls in {r.rows} rows")
    bad = flat.select("rg", ROW_INDEX, *(faults(x.geometry_type)(F.col(x.name)).alias(x.name) for x in o.lods))
    firsts = bad.agg(*(F.min(F.when(F.col(x.name).isNotNull(), F.struct("rg", ROW_INDEX, F.col(x.name).alias("message")))).alias(x.name) for x in o.lods)).first()
    for x in o.lods:
        if first := firsts[x.name]:
            report.errors.append(f"row group {first.rg}, row {first[ROW_INDEX]}: lod {x.name}: {first.message}")
