"""Sort-tile-recursive packing of each level into row groups, and of row groups into pages.

A node is split on its wider axis at max(ceil(n/m) div 2, 1) x m rows; the right half flips the
direction of the other axis, so neighbours in the output stay neighbours on the map. Large nodes
are split by distributed passes; once a node fits a task, the rest of its recursion runs there, from
the order that the passes left. Where the recursion goes on has no influence on the order.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.assign import BOX, global_rank
from lodestrata.sources.shared import sort_joined


def split_at(n: int, m: int) -> int:
    return max(math.ceil(n / m) // 2, 1) * m


def str_order(box: np.ndarray, ids: np.ndarray, m: int, rev_x: bool, rev_y: bool) -> np.ndarray:
    """ASG-16/ASG-18 on one node: positions in packed order; a node of at most m rows keeps its order."""
    with np.errstate(invalid="ignore"):
        cx, cy = (box[:, 0] + box[:, 2]) / 2, (box[:, 1] + box[:, 3]) / 2
    out, todo = [], [(np.arange(len(box)), rev_x, rev_y)]
    while todo:
        some, rx, ry = todo.pop()
        n = len(some)
        if n <= m:
            out.append(some)
            continue
        part = box[some]
        with np.errstate(all="ignore"):
            known = ~np.isnan(part).any(axis=1)
            wide = known.any() and (part[known, 2].max() - part[known, 0].min()) >= (part[known, 3].max() - part[known, 1].min())
        key, reverse = (cx[some], rx) if wide else (cy[some], ry)
        missing = np.isnan(key)
        value = np.where(missing, 0.0, -key if reverse else key)
        some = some[np.lexsort((ids[some], value, missing))]
        k = split_at(n, m)
        other = (rx, not ry) if wide else (not rx, ry)
        todo.append((some[k:], *other))
        todo.append((some[:k], rx, ry))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def pack(rows: DataFrame, row_group_size: int, page_rows: int | None = None, local_rows: int = 2_000_000) -> DataFrame:
    """ASG-16/ASG-17: adds ``pos``, the row's position within its level, to rows (level, fid, xmin, ymin, xmax, ymax, ...)."""
    return sort_joined(rows, positions(rows, row_group_size, page_rows, local_rows), "fid")


def positions(rows: DataFrame, m: int, page_rows: int | None = None, local_rows: int = 2_000_000) -> DataFrame:
    """(fid, pos). ``local_rows``: a task's share of a node; it has no influence on the order.

    Nodes are (level, start), their rows in the order of (at, tie).
    """
    nodes = rows.select("level", "fid", *BOX, F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("at"), F.col("fid").alias("tie"))
    odd = F.col("level") % 2 == 1
    nodes = nodes.withColumns({"rev_x": odd, "rev_y": ~odd})
    sizes = {r.level: r.n for r in rows.groupBy("level").agg(F.count("*").alias("n")).collect()}  # a row for each level
    of = F.create_map(*(F.lit(x).cast("long") for kv in sizes.items() for x in kv)) if sizes else F.lit(None).cast("map<bigint,bigint>")
    nodes = nodes.withColumn("size", F.element_at(of, F.col("level").cast("long")))
    small, large, sizes = split(nodes, list(sizes.values()), m, local_rows)
    done = [local(small, m, page_rows)]
    if large is not None and page_rows and page_rows < m:  # row groups that no task takes whole
        odd = (F.col("level") + F.floor(F.col("start") / m)) % 2 == 1
        small, large, _ = split(large.withColumns({"tie": F.col("at"), "rev_x": odd, "rev_y": ~odd}), sizes, page_rows, local_rows)
        done.append(local(small, page_rows, None))
    if large is not None:
        done.append(large.select("fid", (F.col("start") + F.col("at")).alias("pos")))
    return reduce(DataFrame.unionByName, done)


def local(nodes: DataFrame, m: int, page_rows: int | None) -> DataFrame:
    """(fid, pos) of nodes that fit a task."""
    return nodes.drop("size").groupBy("level", "start").applyInArrow(lambda t: pack_node(t, m, page_rows), f"fid {dict(nodes.dtypes)['fid']}, pos long")


def split(nodes: DataFrame, sizes: list[int], m: int, local_rows: int) -> tuple[DataFrame, DataFrame | None, list[int]]:
    """Nodes that fit a task, and leaves that don't, with their rows numbered in ``at``, and their sizes. ``sizes``: of all nodes."""
    most = max(local_rows, m)
    while max(sizes, default=0) > most:
        nodes = split_pass(nodes, m, local_rows)
        sizes = [x for n in sizes for x in ((split_at(n, m), n - split_at(n, m)) if n > most else (n,))]
    sizes = [n for n in sizes if n > local_rows]
    if not sizes:
        return nodes, None, sizes
    large = nodes.where(F.col("size") > local_rows)
    large = global_rank(large, [F.asc("at"), F.asc("tie")], "__rank", ["level", "start"]).withColumn("at", F.col("__rank")).drop("__rank")
    return nodes.where(F.col("size") <= local_rows), large, sizes


def split_pass(nodes: DataFrame, m: int, local_rows: int) -> DataFrame:
    """One level of the recursion for every node that is still too large for a task, with the rules of str_order."""
    big = nodes.where((F.col("size") > local_rows) & (F.col("size") > m))
    small = nodes.where((F.col("size") <= local_rows) | (F.col("size") <= m))
    node = ["level", "start"]
    known = ~reduce(or_, (F.coalesce(F.isnan(c), F.lit(False)) | F.col(c).isNull() for c in BOX))
    reach = lambda hi, lo: F.max(F.when(known, F.col(hi))) - F.min(F.when(known, F.col(lo)))
    extent = big.groupBy(*node).agg(reach("xmax", "xmin").alias("__w"), reach("ymax", "ymin").alias("__h"))
    wide = (F.col("__w") >= F.col("__h")) & ~F.isnan("__w") & ~F.isnan("__h")
    big = big.join(F.broadcast(extent.select(*node, F.coalesce(wide, F.lit(False)).alias("wide"))), node)
    center = F.when(F.col("wide"), (F.col("xmin") + F.col("xmax")) / 2).otherwise((F.col("ymin") + F.col("ymax")) / 2)
    center = F.when(~F.isnan(center), center)
    reverse = F.when(F.col("wide"), F.col("rev_x")).otherwise(F.col("rev_y"))
    big = big.withColumn("__key", F.when(reverse, -center).otherwise(center))
    big = global_rank(big, [F.asc_nulls_last("__key"), F.asc("tie")], "__rank", node)
    k = F.greatest(F.floor(F.ceil(F.col("size") / m) / 2), F.lit(1)) * m
    right = F.col("__rank") >= k
    big = big.withColumns({
        "start": F.when(right, F.col("start") + k).otherwise(F.col("start")),
        "at": F.when(right, F.col("__rank") - k).otherwise(F.col("__rank")).cast("long"),
        "size": F.when(right, F.col("size") - k).otherwise(k),
        "rev_x": F.when(right & ~F.col("wide"), ~F.col("rev_x")).otherwise(F.col("rev_x")),
        "rev_y": F.when(right & F.col("wide"), ~F.col("rev_y")).otherwise(F.col("rev_y")),
    })
    return small.unionByName(big.select(small.columns))


def pack_node(t: pa.Table, m: int, page_rows: int | None) -> pa.Table:
    t = t.sort_by([("at", "ascending"), ("tie", "ascending")])
    ids = t.column("tie").to_numpy()
    box = np.column_stack([t.column(c).to_numpy() for c in ("xmin", "ymin", "xmax", "ymax")]).astype(np.float64)
    level, start = t.column("level")[0].as_py(), t.column("start")[0].as_py()
    order = str_order(box, ids, m, t.column("rev_x")[0].as_py(), t.column("rev_y")[0].as_py())
    if page_rows:
        parts = []
        for i in range(0, len(order), m):
            some, odd = order[i : i + m], (level + (start + i) // m) % 2 == 1
            parts.append(some[str_order(box[some], np.arange(len(some)), page_rows, odd, not odd)])
        order = np.concatenate(parts)
    return pa.table({"fid": t.column("fid").take(pa.array(order)), "pos": pa.array(start + np.arange(len(order)))})


def chunks(df: DataFrame, size: int, order: str, out: str = "rg") -> DataFrame:
    """WIN-05: consecutive chunks of ``size`` rows in an order given by unique longs."""
    return global_rank(df, [F.asc(order)], "__at").withColumn(out, F.floor(F.col("__at") / size).cast("long")).drop("__at")


def row_group_of(level: str = "level", pos: str = "pos", size: int = 262_144):
    """Row groups never cross levels: number within the level."""
    return F.floor(F.col(pos) / size)


def row_group_starts(rows: DataFrame, size: int) -> DataFrame:
    """SNK-05: (level, n, groups, first_rg): row groups of each occupied level."""
    n = rows.groupBy("level").agg(F.count("*").alias("n")).withColumn("groups", F.ceil(F.col("n") / size))
    before = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    return n.withColumn("first_rg", F.coalesce(F.sum("groups").over(before), F.lit(0)))
