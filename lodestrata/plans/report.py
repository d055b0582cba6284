"""Layout report: how well the row groups of files answer boxes (SNK-19)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators import stats as S
from lodestrata.sources.reader import LodTable

FIGURES = ("row_groups", "rows", "compressed_mb", "area_median", "aspect_median", "hits_mean", "hits_p95", "runs_mean", "clusters_mean")


def layout_report(tables: Mapping[str, LodTable], boxes: DataFrame, gap: int = 4) -> dict[str, dict[str, float]]:
    """AGG-07..AGG-12: by layout and figure: size, shape, and for boxes (q, qx0, qy0, qx1, qy1) the row groups hit, their runs and clusters.

    Footers have a row for each row group; what comes to the driver is one row a layout.
    """
    out = {}
    for name, t in tables.items():
        footer = t.footer()
        shape = S.shape_stats(footer).first()
        hit = S.hits(footer, boxes)
        per = S.selectivity(hit, boxes)
        mean = per.agg(F.avg("hits").alias("m")).first().m
        p95 = S.lower_percentiles(per, {"p": ("hits", 0.95)}).first().p
        runs = S.contiguity(hit).agg(F.avg("runs").alias("m")).first().m
        clusters = S.gap_clusters(hit, gap).agg(F.avg("clusters").alias("m")).first().m
        got = t.inspect()
        values = (got["row_groups"], got["rows"], got["compressed_bytes"] / 1e6, shape.area_median, shape.aspect_median, mean, p95, runs, clusters)
        out[name] = {k: float(v or 0) for k, v in zip(FIGURES, values, strict=True)}
    return out


def markdown(report: Mapping[str, Mapping[str, float]]) -> str:
    """The report as a table: a row a figure, a column a layout; with two layouts also the change of the second against the first."""
    names = list(report)
    head = ["figure", *names, *(["change"] if len(names) == 2 else [])]
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    for k in FIGURES:
        row = [report[n][k] for n in names]
        cells = [f"{v:.4g}" for v in row]
        if len(names) == 2:
            cells.append(f"{(row[1] - row[0]) / row[0]:+.1%}" if row[0] else "-")
        lines.append("| " + " | ".join([k, *cells]) + " |")
    return "\n".join(lines)
