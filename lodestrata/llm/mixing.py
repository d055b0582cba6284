"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Documents hash into at most ``blocks`` blocks for each source (a hot source
   is thus many groups); block sizes come from one partial aggregation. Blocks and
   output shards grow in number with the words of the input, not in size.
2. Targets: each source's weighted share of all sizes, capped at ``max_repeats``
   times its size, the excess reshared by weight until no source is above.
3. A source's quota is a number of block draws: whole passes over its permuted
   blocks, then those blocks, in order, that still fit, then documents of the first block that
   did not, in hash order, that still fit, and one more if that ends nearer the target.
4. The tree halves the range of output shards again and again; at each node a
   multivariate-hypergeometric draw deals the node's block quotas to its halves.
   Leaves own disjoint runs of each source's permuted blocks: what a mix takes is what its leaves
   list. Rows of a shard are ordered by a hash of their own (the local shuffle).

All choices follow from ``seed``, ids and source names, so reruns agree and lost
tasks recompute the same rows.

Null text has size 0, a null source is one source that sorts last, an empty table
has no targets. Documents of size 0 ride along with their block. Rows that share an id, null
among them, are taken together. Extra columns stay, whatever their names. One row a source (name, size, quota)
comes to the driver, as do shards x sources numbers of the tree: sources are the mixture's components, to be listed by hand.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import WORD, free_names, written

WEIGHTS = (5.0, 2.0, 1.0)


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hashed(*parts: Column) -> Column:
    """60 bits of md5, as a non-negative long."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def source_key(c: Column) -> Column:
    """Never null: ``=name``, or an empty string for a null source."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def targets_of(sizes: dict[str, int], weights=WEIGHTS, max_repeats: float = 3.0) -> dict[str, float]:
    """Targets by source key."""
    order = sorted(sizes, key=lambda k: (k == "", k))
    weight = {k: weights[i % len(weights)] for i, k in enumerate(order)}
    out, open_, left = {}, list(order), float(sum(sizes.values()))
    while open_:
        unit = left / sum(weight[k] for k in open_)
        above = [k for k in open_ if weight[k] * unit > max_repeats * sizes[k]]
        for k in above or open_:
            out[k] = float(max_repeats * sizes[k]) if above else weight[k] * unit
        if not above:
            break
        left -= sum(out[k] for k in above)
        open_ = [k for k in open_ if k not in out]
    return out


def split_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Draws of each source for each shard, [source, shard]; shard totals differ by one at most."""
    out = np.zeros((len(quotas), shards), dtype=np.int64)

    def deal(node: int, lo: int, hi: int, have: np.ndarray, before: int) -> None:
        if hi - lo == 1:
            out[:, lo] = have
            return
        mid, total = (lo + hi) // 2, int(quotas.sum())
        cut = total * mid // shards - before
        left = np.random.default_rng([seed, node]).multivariate_hypergeometric(have, cut, method="marginals") if cut else np.zeros_like(have)
        deal(2 * node, lo, mid, left, before)
        deal(2 * node + 1, mid, hi, have - left, before + cut)

    if len(quotas):
        deal(1, 0, shards, quotas.astype(np.int64), 0)
    return out


def fitting(words: np.ndarray, room: float) -> np.ndarray:
    """Which numbers a sum takes that goes through them in order and takes whatever still fits."""
    taken, left = np.zeros(len(words), bool), np.flatnonzero(words <= room)
    while len(left):
        upto = np.cumsum(words[left])
        n = int(np.searchsorted(upto, room, "right"))
        taken[left[:n]] = True
        room -= float(upto[n - 1])
        left = left[n:]
        left = left[words[left] <= room]
    return taken


def nearest(words: np.ndarray, room: float) -> np.ndarray:
    """As fitting(), and the smallest number left if the sum then ends nearer."""
    taken = fitting(words, room)
    room -= float(words[taken].sum())
    left = np.flatnonzero(~taken)
    if len(left):
        i = left[np.argmin(words[left])]
        taken[i] = abs(float(words[i]) - room) < room
    return taken


@dataclass(frozen=True)
class Plan:
    """sized: id, key, src, block, size of each row. draws: src, block, pass, shard, whole. picks: src, key of what is drawn
    of blocks that are not drawn whole. sources: src, source_size, target."""

    sized: DataFrame
    draws: DataFrame
    picks: DataFrame
    sources: DataFrame
    blocks: int


def mixing_plan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, shards: int = 64, blocks: int = 1024,
    shard_words: int = 50_000_000, block_words: int = 2_000_000, weights=WEIGHTS, max_repeats: float = 3.0,
) -> Plan:
    """What is drawn, and where it goes: at least ``shards`` shards of some ``shard_words`` words, at least ``blocks`` blocks a source, of at most some ``block_words``."""
    spark = docs.sparkSession
    sized = docs.select(F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("src"), size_of(F.col(text_col)).alias("size"))
    sized = written(sized.withColumn("key", hashed(F.lit(str(seed)), F.col("id").cast("string"))), "sized")  # words are counted once; what follows reads narrow rows
    total = sized.agg(F.sum("size")).first()[0] or 0
    shards, blocks = max(shards, -(-total // shard_words)), max(blocks, -(-total // block_words))
    sized = sized.withColumn("block", F.col("key") % blocks)
    by_block = written(sized.groupBy("src", "block").agg(F.sum("size").alias("words")), "blocks")
    totals = {r.src: (int(r.size), int(r.n)) for r in by_block.groupBy("src").agg(F.sum("words").alias("size"), F.count("*").alias("n")).collect()}
    target = targets_of({k: v[0] for k, v in totals.items()}, weights, max_repeats)
    whole = {k: (min(int(target[k] // n), int(max_repeats)) if n else 0) for k, (n, _) in totals.items()}
    rest = {k: max(0.0, target[k] - whole[k] * totals[k][0]) if whole[k] < max_repeats else 0.0 for k in totals}
    sources = spark.createDataFrame(
        [(k, totals[k][0], float(target[k]), whole[k], float(rest[k]), totals[k][1]) for k in sorted(totals)],
        "src string, source_size long, target double, whole int, rest double, n_blocks long",
    )

    def choose(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["place", "block"], ignore_index=True)
        room = float(t["rest"].iloc[0])
        full = fitting(t["words"].to_numpy(), room) & (room > 0)
        cut = np.flatnonzero(~full & (t["words"].to_numpy() > 0))[: int(room > 0)]
        t["rank"], t["full"] = np.arange(len(t), dtype=np.int64), full
        t["room"] = np.nan
        t.loc[cut, "room"] = room - float(t["words"][full].sum())
        return t[["src", "block", "whole", "n_blocks", "rank", "full", "room"]]

    place = hashed(F.lit(str(seed)), F.col("src"), F.col("block").cast("string"))
    # one source's blocks: narrow rows, as many as its words call for
    ranked = by_block.join(sources.select("src", "whole", "rest", "n_blocks"), "src").withColumn("place", place)
    ranked = ranked.groupBy("src").applyInPandas(choose, "src string, block long, whole int, n_blocks long, rank long, full boolean, room double")
    ranked = written(ranked, "ranked")

    def pick(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("key", ignore_index=True)
        return t[nearest(t["size"].to_numpy(), float(t["room"].iloc[0]))][["src", "key"]]

    cut_here = F.col("room").isNotNull() & ~F.isnan("room")
    cut = ranked.where(cut_here).select("src", "block", "room")
    parts = sized.join(cut, ["src", "block"]).groupBy("src", "key").agg(F.sum("size").alias("size"), F.first("room").alias("room"))
    picks = written(parts.groupBy("src").applyInPandas(pick, "src string, key long"), "picks")
    partly = cut.join(picks.select("src").distinct(), "src", "left_semi").select("src", F.lit(True).alias("partly"))
    drawn = (
        ranked.join(partly, "src", "left").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("whole"))))
        .withColumn("whole_block", (F.col("pass") < F.col("whole")) | F.col("full"))
        .where(F.col("whole_block") | (F.col("partly") & cut_here))
        .withColumn("draw", F.col("pass") * F.col("n_blocks") + F.col("rank"))
    )
    nth = Window.partitionBy("src").orderBy("draw")
    drawn = written(drawn.withColumn("nth", F.row_number().over(nth) - 1).select("src", "nth", "block", "pass", F.col("whole_block").alias("whole")), "drawn")
    counts = {r.src: int(r.n) for r in drawn.groupBy("src").agg(F.count("*").alias("n")).collect()}
    names = sorted(counts)
    dealt = split_tree(np.array([counts[k] for k in names], dtype=np.int64), shards, seed)
    ends = np.cumsum(dealt, axis=1)
    leaves = [(k, j, int(ends[i, j] - dealt[i, j]), int(ends[i, j]) - 1) for i, k in enumerate(names) for j in np.flatnonzero(dealt[i]).tolist()]
    # a leaf owns a run of its source's draws
    leaf = spark.createDataFrame(leaves, "src string, shard int, low int, high int").select("src", "shard", F.explode(F.sequence("low", "high")).alias("nth"))
    return Plan(sized, drawn.join(leaf, ["src", "nth"]).drop("nth"), picks, sources.select("src", "source_size", "target"), blocks)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mixed corpus: rows of docs, repeated as drawn, and their mix_pass, mix_shard and mix_key, ordered by mix_key within a shard.

    Where docs has a column of such a name, the new one's ends in an underscore.
    """
    seed = str(how.get("seed", 17))
    plan = mixing_plan(docs, id_col, text_col, source_col, **how)
    turn, shard, order, src, key, block, whole, picked = free_names(docs.columns, "mix_pass", "mix_shard", "mix_key", "mix_src", "mix_hash", "mix_block", "mix_whole", "mix_picked")
    rows = docs.withColumns({src: source_key(F.col(source_col)), key: hashed(F.lit(seed), F.col(id_col).cast("string"))}).withColumn(block, F.col(key) % plan.blocks)
    d = plan.draws.select(F.col("src").alias(src), F.col("block").alias(block), F.col("pass").alias(turn), F.col("shard").alias(shard), F.col("whole").alias(whole))
    p = plan.picks.select(F.col("src").alias(src), F.col("key").alias(key), F.lit(True).alias(picked))
    return (
        rows.join(d, [src, block]).join(p, [src, key], "left").where(F.col(whole) | F.col(picked))
        .withColumn(order, hashed(F.lit(seed), F.lit("local"), F.col(turn).cast("string"), F.col(key).cast("string")))
        .select(*docs.columns, turn, shard, order)
        .repartition(shard).sortWithinPartitions(shard, order)
    )


def mixing_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """For each row of docs: id, size, source_size, target, taken (the words that the mix takes, repeats counted), and the shards that have it."""
    plan = mixing_plan(docs, id_col, text_col, source_col, **how)
    of_block = plan.draws.groupBy("src", "block").agg(
        F.sum(F.col("whole").cast("int")).alias("times"), F.collect_list(F.when(F.col("whole"), F.col("shard"))).alias("shards"), F.collect_list(F.when(~F.col("whole"), F.col("shard"))).alias("part"),
    )
    times = F.coalesce("times", F.lit(0)) + F.when(F.col("picked"), F.size("part")).otherwise(0)
    shards = F.concat(F.coalesce("shards", F.array()), F.when(F.col("picked"), F.col("part")).otherwise(F.array()))
    picks = plan.picks.withColumn("picked", F.lit(True))
    return (
        plan.sized.join(of_block, ["src", "block"], "left").join(picks, ["src", "key"], "left").join(plan.sources, "src", "left")
        .select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"), F.array_sort(shards).alias("shards"))
    )
