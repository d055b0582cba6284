"""Connected components of a link table, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import removed, written


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links (a, b); component: the least node reachable.

    Alternating large-star and small-star contraction: every step is a partial
    minimum for each node and a join that AQE may split, and the links end as stars
    around the least node after a logarithmic number of rounds.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours move to the least neighbour
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        # small star: smaller neighbours and the node itself move to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        small = written(small, "small")
        # stars: no node is both a leaf and a centre, and no leaf has two centres
        n = small.agg(F.count("*"), F.count_distinct("u")).first()
        chained = small.join(small.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()
        removed(edges)
        removed(large)
        edges = small
        if n[0] == n[1] and chained:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
