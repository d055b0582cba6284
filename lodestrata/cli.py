"""Command line: ``python -m lodestrata convert IN OUT`` and ``python -m lodestrata validate FILE``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from lodestrata.plans.convert import Options, convert_file
from lodestrata.plans.validate import check


def parser() -> argparse.ArgumentParser:
    d = Options()
    p = argparse.ArgumentParser(prog="lodestrata")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert", help="rearrange a GeoParquet file into levels of detail")
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("--resolution", type=float, action="append", help="a level, coarse to fine, in CRS units; may be repeated")
    c.add_argument("--webmerc-minzoom", type=int, default=None)
    c.add_argument("--webmerc-maxzoom", type=int, default=None)
    c.add_argument("--min-root-features", type=int, default=d.min_root_features)
    c.add_argument("--row-group-size", type=int, default=d.row_group_size)
    c.add_argument("--zstd-level", type=int, default=d.zstd_level)
    c.add_argument("--simplification-tolerance-factor", type=float, default=d.tolerance_factor)
    c.add_argument("--min-part-size-factor", type=float, default=d.part_factor)
    c.add_argument("--page-row-count", type=int, default=d.page_rows)
    c.add_argument("--page-size-limit", type=int, default=d.page_bytes)
    c.add_argument("--point-thinning-factor", type=float, default=d.thinning_factor)
    c.add_argument("--line-visibility-factor", type=float, default=d.line_factor)
    c.add_argument("--polygon-visibility-factor", type=float, default=d.polygon_factor)
    c.add_argument("--priority-column")
    c.add_argument("--priority-column-order", choices=("asc", "desc"), default="desc")
    c.add_argument("--files", type=int, help="files of a folder; by default one file where the output ends in .parquet, else as many as the rows call for")
    v = sub.add_parser("validate", help="check a level-of-detail file")
    v.add_argument("input")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "convert" and a.resolution and (a.webmerc_minzoom is not None or a.webmerc_maxzoom is not None):
        parser().error("--resolution excludes the --webmerc flags")
    spark = spark or SparkSession.builder.appName("lodestrata").getOrCreate()
    if a.command == "validate":
        report = check(spark, a.input)
        print(report.text())
        return int(not report.valid)
    d = Options()
    options = Options(
        tuple(a.resolution) if a.resolution else None, d.min_zoom if a.webmerc_minzoom is None else a.webmerc_minzoom, d.max_zoom if a.webmerc_maxzoom is None else a.webmerc_maxzoom,
        a.min_root_features, a.row_group_size, a.zstd_level, a.simplification_tolerance_factor, a.min_part_size_factor, a.page_row_count, a.page_size_limit,
        a.point_thinning_factor, a.line_visibility_factor, a.polygon_visibility_factor, a.priority_column, a.priority_column_order == "desc", files=a.files,
    )
    for r in convert_file(spark, a.input, a.output, options).collect():
        print(f"{r.path}: {r.rows} rows, {r.row_groups} row groups")
    return 0


if __name__ == "__main__":
    sys.exit(main())
