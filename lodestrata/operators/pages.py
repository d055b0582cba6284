"""Pages and byte ranges of a layout: which pages meet, which rows are selected, which ranges are fetched together."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def page_overlap(covering: DataFrame, other: DataFrame) -> DataFrame:
    """JOI-08: (rg, covering_page, other_page) of pages (rg, page, first_row, last_row) of two columns that share rows of a row group."""
    a = covering.select("rg", F.col("page").alias("covering_page"), F.col("first_row").alias("a0"), F.col("last_row").alias("a1"))
    b = other.select("rg", F.col("page").alias("other_page"), F.col("first_row").alias("b0"), F.col("last_row").alias("b1"))
    return a.join(b, "rg").where("a0 <= b1 AND a1 >= b0").select("rg", "covering_page", "other_page")


def pages_of(rows: DataFrame, size: int, order: str = "row") -> DataFrame:
    """INS-02: (rg, page, first_row, last_row) of pages of ``size`` rows, from rows (rg, row within it)."""
    return rows.groupBy("rg", F.floor(F.col(order) / size).alias("page")).agg(F.min(order).alias("first_row"), F.max(order).alias("last_row"))


def selection_ranges(rows: DataFrame) -> DataFrame:
    """FLT-06: (rg, start, stop) runs of selected rows, from rows (rg, row, kept); a row group's rows are numbered without gaps."""
    w = Window.partitionBy("rg").orderBy("row")
    kept = rows.where("kept").withColumn("island", F.col("row") - F.row_number().over(w))
    return kept.groupBy("rg", "island").agg(F.min("row").alias("start"), (F.max("row") + 1).alias("stop")).drop("island")


def coalesced(ranges: Sequence[tuple[int, int]], gap: int, extra: int, request: int) -> list[tuple[int, int, int]]:
    """IO-01: (start, stop, number of ranges) of requests over sorted ranges: a range joins the request before it if at most
    ``gap`` bytes lie between, the request then has at most ``extra`` bytes that nobody asked for, and spans at most ``request``."""
    out: list[list[int]] = []
    waste = 0
    for start, stop in sorted(ranges):
        if out:
            begin, end, n = out[-1]
            between = max(0, start - end)
            if between <= gap and waste + between <= extra and max(end, stop) - begin <= request:
                out[-1] = [begin, max(end, stop), n + 1]
                waste += between
                continue
        out.append([start, stop, 1])
        waste = 0
    return [tuple(x) for x in out]


def coalesce_ranges(ranges: DataFrame, gap: int, extra: int, request: int, by: str) -> DataFrame:
    """IO-01 of each file's ranges (by, start, stop): a file's ranges of one read, some thousands, go through one task."""
    kind = dict(ranges.dtypes)[by]

    def run(key: tuple, t: pa.Table) -> pa.Table:
        got = coalesced(list(zip(t.column("start").to_pylist(), t.column("stop").to_pylist(), strict=True)), gap, extra, request)
        return pa.table({by: pa.array([key[0].as_py()] * len(got), t.schema.field(by).type), "start": [x[0] for x in got], "stop": [x[1] for x in got], "n": [x[2] for x in got]})

    return ranges.select(by, "start", "stop").groupBy(by).applyInArrow(run, f"`{by}` {kind}, start long, stop long, n long")


def slices_of(ranges: DataFrame, requests: DataFrame, by: str) -> DataFrame:
    """IO-02: (by, start, stop, request, offset): where each range lies in the request that fetched it."""
    r = requests.select(by, F.col("start").alias("request"), F.col("stop").alias("end"))
    return ranges.join(r, by).where("start >= request AND stop <= end").groupBy(by, "start", "stop").agg(F.max("request").alias("request")).withColumn("offset", F.col("start") - F.col("request"))
