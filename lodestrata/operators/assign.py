"""Level assignment: ranks, grid thinning, visibility, root folding, remapping.

Rows are (fid, xmin, ymin, xmax, ymax, kind, rank, ...); fid is the index of the
source row. Everything is independent of how rows are partitioned.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.expr import POINT, bbox_empty, cell, diagonal2, row_hash, unsigned_order, visible_level
from lodestrata.sources.shared import sort_joined, written

BOX = ("xmin", "ymin", "xmax", "ymax")


def priority_rank(df: DataFrame, column: str, descending: bool = True, out: str = "rank") -> DataFrame:
    """ASG-04/WIN-01: ranks that ties share; nulls are lowest either way, a higher rank goes first.

    A global dense rank over distinct values only: values are ranked in sorted, counted
    ranges, never in one task over all rows.
    """
    if dict(df.dtypes)[column].startswith(("struct", "array", "map")):
        raise ValueError(f"priority column {column} must be numeric, boolean or string")
    values = df.select(F.col(column).alias("__v")).where(F.col("__v").isNotNull()).distinct()
    order = F.asc("__v") if descending else F.desc("__v")
    ranked = global_rank(values, [order], "__r")
    return sort_joined(df, ranked, df[column] == ranked["__v"], "left").withColumn(out, F.coalesce(F.col("__r") + 1, F.lit(0)).cast("long")).drop("__v", "__r")


def global_rank(df: DataFrame, order: Sequence[Column], out: str, within: Sequence[str] = ()) -> DataFrame:
    """Zero-based positions in a total order (within groups), without sorting a group in one task.

    Ranges of the order are counted, then rows are numbered within their range and shifted by the counts before.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = written(df.repartitionByRange(parts, *within, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    keys = [*within, "__range"]
    before = Window.partitionBy(*within).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(*keys).agg(F.count("*").alias("__n")).select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inner = Window.partitionBy(*keys).orderBy(*order)
    return ranged.withColumn("__nth", F.row_number().over(inner)).join(starts, keys).withColumn(out, (F.col("__start") + F.col("__nth") - 1).cast("long")).drop("__range", "__nth", "__start")


def priority(rank: Column, box: Sequence[Column], fid: Column) -> list[Column]:
    """ASG-05: (rank, squared diagonal, unsigned hash of the row), the greatest goes first; fid settles equal hashes."""
    return [rank, F.coalesce(diagonal2(*box), F.lit(0.0)), unsigned_order(row_hash(fid)), fid]


def nested(ladder: Sequence[float]) -> bool:
    """Do cells of each level hold whole cells of the next: ratios are powers of two."""
    ratios = [a / b for a, b in zip(ladder, ladder[1:], strict=False)]
    return all(r >= 1 and math.frexp(r)[0] == 0.5 for r in ratios)


def thin_points(points: DataFrame, ladder: Sequence[float], factor: float = 4.0, force_general: bool = False) -> DataFrame:
    """ASG-08/WIN-02/JOI-03: adds ``level``: at each level but the last, the best unassigned point of every cell
    that holds no assigned point; the rest, and points without a box, go to the last level.

    Nested ladders: a coarse cell's best point is the best of all its finer cells, so winners are found from the
    finest competing level up, each time among the level below's winners: one shuffle of all rows, then ever fewer.
    Other ladders: one pass a level, occupied cells against candidates.
    """
    last = len(ladder) - 1
    box = [F.col(c) for c in BOX]
    best = F.struct(*(c.alias(f"p{i}") for i, c in enumerate(priority(F.col("rank"), box, F.col("fid")))))
    narrow = points.where(~bbox_empty(*box)).select("fid", ((F.col("xmin") + F.col("xmax")) / 2).alias("cx"), ((F.col("ymin") + F.col("ymax")) / 2).alias("cy"), best.alias("best"))
    at = lambda i: [cell(F.col("cx"), ladder[i] * factor).alias("ix"), cell(F.col("cy"), ladder[i] * factor).alias("iy")]
    top = lambda df, i: df.groupBy(*at(i)).agg(F.max(F.struct("best", "fid", "cx", "cy")).alias("w")).select("w.*")
    if nested(ladder) and not force_general:
        won, current = None, narrow
        for i in range(last - 1, -1, -1):
            current = written(top(current, i), f"winners{i}")
            mine = current.select("fid", F.lit(i).alias("level"))
            won = mine if won is None else won.unionByName(mine)
    else:
        won = None
        rest = written(narrow, "points")
        taken = None
        for i in range(last):
            candidates = rest if taken is None else sort_joined(rest, taken, "fid", "left_anti")
            if taken is not None:
                occupied = taken.select(*at(i)).distinct()
                candidates = candidates.select("*", *at(i)).hint("merge").join(occupied.hint("merge"), ["ix", "iy"], "left_anti").drop("ix", "iy")
            new = written(top(candidates, i).select("fid", "cx", "cy", F.lit(i).alias("level")), f"level{i}")
            taken = new.drop("level") if taken is None else taken.unionByName(new.drop("level"))
            won = new.select("fid", "level") if won is None else won.unionByName(new.select("fid", "level"))
    if won is None:
        return points.withColumn("level", F.lit(last))
    first = won.groupBy("fid").agg(F.min("level").alias("level"))
    return sort_joined(points, first, "fid", "left").withColumn("level", F.coalesce("level", F.lit(last)).cast("int"))


def assign_levels(rows: DataFrame, ladder: Sequence[float], thin: float = 4.0, line: float = 4.0, polygon: float = 4.0) -> DataFrame:
    """ASG-08/ASG-09: adds ``level`` to rows of any mixture of kinds; only points compete."""
    box = [F.col(c) for c in BOX]
    is_point = F.coalesce(F.col("kind"), F.lit(POINT)) == POINT
    points = thin_points(rows.where(is_point), ladder, thin)
    others = rows.where(~is_point).withColumn("level", visible_level(F.col("kind"), box, ladder, line, polygon))
    return points.unionByName(others)


def level_counts(rows: DataFrame, levels: int) -> DataFrame:
    """AGG-03/WIN-03: (level, n, cumulative) for every level of the ladder, empty ones too."""
    spark = rows.sparkSession
    all_levels = spark.range(levels).select(F.col("id").cast("int").alias("level"))
    counts = all_levels.join(F.broadcast(rows.groupBy("level").agg(F.count("*").alias("n"))), "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n"))
    running = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("cumulative", F.sum("n").over(running))


def root_level(rows: DataFrame, levels: int, minimum: int) -> int:
    """ASG-11: the first level whose cumulative count reaches the minimum, else the last. One row for each level comes to the driver."""
    counts = {r.level: r.n for r in rows.groupBy("level").agg(F.count("*").alias("n")).collect()}
    total = 0
    for level in range(levels):
        total += counts.get(level, 0)
        if total >= minimum:
            return level
    return levels - 1


def fold_root(rows: DataFrame, levels: int, minimum: int) -> DataFrame:
    """ASG-11/ASG-15: levels above the root fold into it; entry_level keeps what they were."""
    root = root_level(rows, levels, minimum)
    return rows.withColumn("entry_level", F.col("level")).withColumn("level", F.greatest("level", F.lit(root)).cast("int"))


def remap_levels(rows: DataFrame, selected: Sequence[int]) -> DataFrame:
    """ASG-12/ASG-13/JOI-04: the position of the first selected level not below a row's own."""
    out = F.when(F.col("level") <= F.lit(int(selected[0])), 0)
    for i, s in enumerate(selected[1:], 1):
        out = out.when(F.col("level") <= F.lit(int(s)), i)
    return rows.withColumn("level", out.cast("int"))
