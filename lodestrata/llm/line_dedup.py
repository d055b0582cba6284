"""Line dedup across sites: boilerplate lines are those that many distinct sites carry.

Stage by stage: (1) a HyperLogLog sketch of the sites of each line key, merged
by aggregation, with the key's count and first occurrence; (2) exact distinct counts,
only for keys whose estimate lies within ``band`` of the threshold; (3) drop
every occurrence of a boilerplate line but its first (least doc_id, then position).
Groupings combine partially before they shuffle, so a line that a third of
all rows hold costs one row for each task. Candidate and boilerplate keys are written
tables of known size: where they are small Spark sends them to the lines, which then don't move;
else it joins by key and splits the partition of a very common line, as no aggregation shares that stage.

Lines are \\n-separated; a key is the line without spaces, tabs and \\r at its
ends. Blank lines never count and always stay. Null text: no lines, stays null. A
null site counts as one site of its own. A null id comes before all others. Repeated ids share
their lines' fate: give unique ids. Extra columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import free_names, written

BLANK = " \t\r"


def line_key(line: Column) -> Column:
    return F.trim(line, F.lit(BLANK))


def occurrences(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(id, pos, key, site) of every line that isn't blank; the key is a 128-bit hash of it."""
    lines = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.concat(F.lit("="), F.col(site_col).cast("string")), F.lit("")).alias("site"),
        F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line"),
    )
    key = line_key(F.col("line"))
    return lines.where(key != "").select("id", "pos", "site", F.unhex(F.md5(key.cast("binary"))).alias("key"))


def boilerplate(lines: DataFrame, min_sites: int, band: float, lg_k: int = 12) -> DataFrame:
    """(key, first) of each line on min_sites sites or more; first: id and pos of its first occurrence."""
    low, high = min_sites * (1 - band), min_sites * (1 + band)
    by_key = (
        lines.groupBy("key")
        .agg(F.hll_sketch_agg("site", lg_k).alias("sketch"), F.count("*").alias("n"), F.min(F.struct("id", "pos")).alias("first"))
        .where(F.col("n") >= min_sites)
        .select("key", "first", F.hll_sketch_estimate("sketch").alias("sites"))
        .where(F.col("sites") >= low)
    )
    by_key = written(by_key, "line_keys")
    near = by_key.where(F.col("sites") <= high).select("key", "first")
    exact = lines.select("key", "site").join(near, "key").groupBy("key", "site").agg(F.first("first").alias("first"))
    exact = exact.groupBy("key").agg(F.count("*").alias("sites"), F.first("first").alias("first")).where(F.col("sites") >= min_sites)
    return by_key.where(F.col("sites") > high).select("key", "first").unionByName(exact.select("key", "first"))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 10, band: float = 0.4) -> DataFrame:
    """(id, positions): the 0-based lines to drop, in order, for documents that lose any."""
    lines = occurrences(docs, id_col, text_col, site_col)
    chosen = written(boilerplate(lines, min_sites, band), "boilerplate")
    return (
        lines.select("id", "pos", "key").join(chosen, "key")
        .where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("pos") == F.col("first.pos"))))
        .groupBy("id").agg(F.array_sort(F.collect_set("pos")).alias("positions"))
    )


def without(text: Column, positions: Column) -> Column:
    """The text without the lines at some positions, in time linear in its lines: the runs between them are sliced out."""
    bound = F.transform(F.array(F.split(text, "\n", -1)), lambda x: F.struct(x.alias("lines"), F.concat(F.array(F.lit(-1)), positions, F.array(F.size(x))).alias("at")))
    run = lambda b: lambda j: F.slice(b["lines"], b["at"][j - 1] + 2, b["at"][j] - b["at"][j - 1] - 1)
    return F.transform(bound, lambda b: F.array_join(F.flatten(F.transform(F.sequence(F.lit(1), F.size(b["at"]) - 1), run(b))), "\n"))[0]


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 10, band: float = 0.4) -> tuple[DataFrame, Column, Column]:
    """(docs joined with the positions to drop, the new text, the number of lines dropped).

    The frame has all columns of docs and one more of a name of its own; the two columns are expressions over it.
    """
    key, dropped = free_names(docs.columns, "line_dedup_id", "line_dedup_dropped")
    drop = dropped_lines(docs, id_col, text_col, site_col, min_sites, band)
    drop = drop.select(F.col("id").alias(key), F.col("positions").alias(dropped))
    joined = docs.join(drop, F.col(id_col).eqNullSafe(F.col(key)), "left").drop(key)
    text = F.when(F.col(dropped).isNull(), F.col(text_col)).otherwise(without(F.col(text_col), F.col(dropped)))
    return joined, text, F.coalesce(F.size(dropped), F.lit(0))
