"""Layout statistics: envelopes, row-group shape, selectivity, contiguity, range merging."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.expr import bbox_intersects, lit
from lodestrata.operators.assign import global_rank
from lodestrata.sources.shared import written

BOX = ("xmin", "ymin", "xmax", "ymax")


def envelope(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AGG-01/AGG-02/AGG-06: partial minima and maxima; null where there are no boxes."""
    return rows.groupBy(*by).agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


def row_group_stats(rows: DataFrame) -> DataFrame:
    """FLT-03/AGG-05: rows (rg, box) to (rg, rows, row_start, envelope): the shape of a footer table."""
    per = rows.groupBy("rg").agg(F.count("*").alias("rows"), *(f(c).alias(c) for c, f in zip(BOX, (F.min, F.min, F.max, F.max), strict=True)))
    before = Window.orderBy("rg").rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("row_start", F.coalesce(F.sum("rows").over(before), F.lit(0)).cast("long"))


def hits(footer: DataFrame, queries: DataFrame) -> DataFrame:
    """FLT-02/AGG-09: (q, rg, rows, ...) of row groups whose envelope meets a query box; queries (q, qx0, qy0, qx1, qy1) are few and given."""
    f, q = footer, F.broadcast(queries)
    meets = f.xmin.isNull() | ((f.xmax >= q.qx0) & (f.xmin <= q.qx1) & (f.ymax >= q.qy0) & (f.ymin <= q.qy1))
    return f.join(q, meets)


def lower_percentiles(rows: DataFrame, wanted: Mapping[str, tuple[str, float]]) -> DataFrame:
    """AGG-07: one row with, for each name, element int(p (n - 1)) of a column's sorted values, nulls left out.

    Values are numbered in sorted, counted ranges; no task sees them all.
    """
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select("x.*").where("v IS NOT NULL")
    at = global_rank(long, [F.asc("v")], "at", ["name"])
    n = {r["name"]: r.n for r in at.groupBy("name").agg(F.count("*").alias("n")).collect()}
    here = lambda c, p: (F.col("name") == c) & (F.col("at") == int(p * (n.get(c, 0) - 1)))
    return at.agg(*(F.max(F.when(here(c, p), F.col("v"))).alias(k) for k, (c, p) in wanted.items()))


def selectivity(hit: DataFrame, queries: DataFrame) -> DataFrame:
    """AGG-09: (q, hits, rows) for every query, none too."""
    per = hit.groupBy("q").agg(F.count("*").alias("hits"), F.sum("rows").alias("rows"))
    return queries.select("q").join(per, "q", "left").select("q", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))


def shape_stats(footer: DataFrame) -> DataFrame:
    """AGG-08: area sum, median and p95, aspect median, p95 and max, of row-group envelopes."""
    w, h = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    floor = lit(1e-12)
    aspect = F.greatest(F.greatest(w, floor) / F.greatest(h, floor), F.greatest(h, floor) / F.greatest(w, floor))
    shapes = footer.where("xmin IS NOT NULL").select((w * h).alias("area"), aspect.alias("aspect"))
    total = shapes.agg(F.sum("area").alias("area_sum")).first().area_sum
    wanted = {"area_median": ("area", 0.5), "area_p95": ("area", 0.95), "aspect_median": ("aspect", 0.5), "aspect_p95": ("aspect", 0.95), "aspect_max": ("aspect", 1.0)}
    return lower_percentiles(shapes, wanted).select(F.lit(total).cast("double").alias("area_sum"), *wanted)


def contiguity(hit: DataFrame) -> DataFrame:
    """AGG-10/WIN-07: gaps and islands of each query's row groups: hits, runs, longest run, span."""
    island = F.col("rg") - F.row_number().over(Window.partitionBy("q").orderBy("rg"))
    run = hit.select("q", "rg").withColumn("island", island).groupBy("q", "island").agg(F.count("*").alias("n"), F.min("rg").alias("lo"), F.max("rg").alias("hi"))
    return run.groupBy("q").agg(F.sum("n").cast("long").alias("hits"), F.count("*").alias("runs"), F.max("n").alias("longest"), (F.max("hi") - F.min("lo") + 1).alias("span"))


def gap_clusters(hit: DataFrame, gap: int) -> DataFrame:
    """AGG-11: clusters break where more than ``gap`` row groups lie between two hits."""
    before = F.lag("rg").over(Window.partitionBy("q").orderBy("rg"))
    breaks = F.when(before.isNull() | (F.col("rg") - before - 1 > gap), 1).otherwise(0)
    return hit.withColumn("b", breaks).groupBy("q").agg(F.sum("b").cast("long").alias("clusters"))


def merge_ranges(ranges: DataFrame, gap: int, by: Sequence[str] = ()) -> DataFrame:
    """IO-01/SET-02: byte ranges (start, stop) merged where they overlap or at most ``gap`` lies between them.

    Ranges are dealt in order to parts; how far a part's ranges reach, and how many merged ones begin there, is carried on
    to the parts behind it, so that no group of ``by`` (null being one) is sorted in one task.
    """
    n = max(1, int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = ranges.repartitionByRange(n, *by, "start", "stop").withColumn("__range", F.spark_partition_id())
    dealt = written(dealt.select(*by, "start", "stop", "__range"), "dealt")
    keys = [*by, "__range"]
    inner = Window.partitionBy(*keys).orderBy("start", "stop")
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)

    def carried(rows: DataFrame, value: Column, combine: Callable[[Column], Column], name: str) -> DataFrame:
        """One row a part and group: what the parts before it come to."""
        per = rows.groupBy(*keys).agg(value.alias("v"))
        per = per.select(*(F.col(k).alias(f"__{k}") for k in keys), combine(F.col("v")).over(before).alias(name))
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by] + [F.col("__range") == F.col("____range")]
        return rows.join(per, reduce(lambda a, b: a & b, same)).drop(*(f"__{k}" for k in keys))

    reach = F.greatest(F.max("stop").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.col("__reach"))
    rows = carried(dealt, F.max("stop"), F.max, "__reach")
    rows = rows.withColumn("new", F.when(reach.isNull() | (F.col("start") > reach + gap), 1).otherwise(0)).drop("__reach")
    rows = carried(written(rows, "marked"), F.sum("new"), F.sum, "__begun")
    part = F.coalesce("__begun", F.lit(0)) + F.sum("new").over(inner.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("part", part).groupBy(*by, "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n")).drop("part")


def pages_kept(pages: DataFrame, q: Sequence[float]) -> DataFrame:
    """FLT-05: pages that no single bound proves disjoint; null statistics keep a page."""
    return pages.where(bbox_intersects(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), q))


def coverage(rows: DataFrame, lods: Sequence[str]) -> DataFrame:
    """AGG-15/VAL-10: (rg, lod, rows, nulls) of nullable LoD columns."""
    per = rows.groupBy("rg").agg(F.count("*").alias("rows"), *(F.count_if(F.col(c).isNull()).alias(c) for c in lods))
    return per.select("rg", "rows", F.explode(F.array(*(F.struct(F.lit(c).alias("lod"), F.col(c).alias("nulls")) for c in lods))).alias("x")).select("rg", "x.lod", "rows", "x.nulls")


def coverage_errors(cover: DataFrame, boundaries: DataFrame) -> DataFrame:
    """VAL-10: through a LoD's boundary (lod, row_group_end) no value is null, behind it all are."""
    c = cover.join(F.broadcast(boundaries), "lod")
    bad = F.when(F.col("rg") <= F.col("row_group_end"), F.col("nulls") > 0).otherwise(F.col("nulls") < F.col("rows"))
    return c.where(bad).select("rg", "lod", "rows", "nulls")


def layout_delta(a: DataFrame, b: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """AGG-12: differences of two layouts' figures, absolute and relative."""
    x, y = a.alias("x"), b.alias("y")
    out = x.join(y, list(by))
    return out.select(*by, *(c for v in values for c in ((F.col(f"y.{v}") - F.col(f"x.{v}")).alias(f"{v}_delta"), F.try_divide(F.col(f"y.{v}") - F.col(f"x.{v}"), F.col(f"x.{v}")).alias(f"{v}_relative"))))
