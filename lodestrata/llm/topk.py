"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted by length and cut into buckets of vectors of like length; the
queries are cut into blocks. A first pass scores each query block on the first
bucket (the longest vectors) and so learns, for each query, a score that k
candidates reach. For a query q with that score t and a bucket of greatest length l
the local cosine threshold is t / (|q| l):

* above 1, the bucket holds nothing for q: pairs of blocks where this is true of all
  queries are never formed, which only their lengths and thresholds decide;
* at least ``coordinate`` of it: coordinate pruning. A vector passes only if its
  normalised coordinate lies within the feasible region of each focus coordinate
  (the largest of q's), found in the bucket's sorted coordinate lists;
* else length pruning: only the bucket's vectors of length t / |q| or more.

What is left is verified by exact integer products: vectors hold whole numbers, and
products are taken in floating point only where they cannot round. A score beyond the range of a
long becomes its nearest end. Ties go to the smaller id.

Block pairs are formed by number. A bucket is sent once for each ``share`` query blocks that it meets,
in the smallest whole-number type that holds it, and the query blocks stream past it.

A vector that is null, or holds a null or a non-finite component, takes no part; vectors
of different dimension never meet, empty ones and null ids meet nothing. A query with fewer candidates returns all. Repeated
ids are candidates of their own, but a query never meets its own id, and queries that share an id are one
query each of whose vectors' candidates count. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import written


@dataclass(frozen=True)
class TopK:
    k: int = 20
    bucket: int = 4096
    queries: int = 1024
    share: int = 16
    focus: int = 3
    coordinate: float = 0.7


def smallest(v: np.ndarray) -> np.ndarray:
    """The same whole numbers in the smallest type that holds them."""
    most = np.abs(v).max(initial=0.0)
    return v.astype(next((t for t, top in ((np.int8, 2**7), (np.int16, 2**15), (np.int32, 2**31)) if most < top), np.float64))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """(block, dim, longest, ids, norms, kind, vectors) of rows (id, v), by dimension and falling length."""
    spark = rows.sparkSession
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    ordered = rows.withColumns({"dim": F.size("v"), "norm": F.sqrt(length)}).where("dim > 0")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = ordered.repartitionByRange(parts, "dim", F.desc("norm"), "id").sortWithinPartitions("dim", F.desc("norm"), "id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, dim, name = [], 0, None, TaskContext.get().partitionId() << 32

        def out() -> pa.RecordBatch:
            nonlocal name
            t = pa.Table.from_batches(held)
            v, norm = smallest(t.column("v").combine_chunks().flatten().to_numpy().astype(np.float64)), t.column("norm").to_numpy()
            name += 1
            columns = [pa.array([name]), pa.array([dim], pa.int32()), pa.array([norm[0]]), pa.array([t.column("id").to_numpy()], pa.list_(pa.int64())), pa.array([norm], pa.list_(pa.float64())), pa.array([v.dtype.str]), pa.array([v.tobytes()])]
            return pa.record_batch(columns, names=["name", "dim", "longest", "ids", "norms", "kind", "vectors"])

        for b in batches:
            at = 0
            dims = b.column("dim").to_numpy()
            while at < b.num_rows:
                if held and (dims[at] != dim or n >= size):
                    yield out()
                    held, n = [], 0
                dim = int(dims[at])
                same = int(np.argmax(dims[at:] != dim)) if (dims[at:] != dim).any() else b.num_rows - at
                take = min(same, size - n)
                held.append(b.slice(at, take))
                n, at = n + take, at + take
        if held:
            yield out()

    cut_rows = written(ordered.mapInArrow(cut, "name long, dim int, longest double, ids array<long>, norms array<double>, kind string, vectors binary"), "cut")
    # numbers need the blocks' lengths alone: one narrow row for thousands of vectors
    number = Window.partitionBy("dim").orderBy(F.desc("longest"), "name")
    named = cut_rows.select("dim", "longest", "name").withColumn("block", F.row_number().over(number) - 1)
    return cut_rows.join(named.select("name", "block"), "name").drop("name")


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores, ties to the smaller id."""
    pick = np.arange(len(scores))
    if len(scores) > k:
        pick = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return pick[np.lexsort((ids[pick], -scores[pick]))][:k]


LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact products of whole numbers as longs; beyond a long's range, its nearest end."""
    bound = float(q.shape[1]) * np.abs(q).max(initial=0.0) * np.abs(p).max(initial=0.0)
    if bound < 2.0**24:
        return (q.astype(np.float32) @ p.astype(np.float32).T).astype(np.int64)
    if bound < 2.0**53:
        return (q @ p.T).astype(np.int64)
    if bound < 2.0**62:
        return q.astype(np.int64) @ p.astype(np.int64).T
    whole = lambda m: np.array([[int(x) for x in r] for r in m.tolist()], object).reshape(m.shape)
    return np.clip(whole(q) @ whole(p).T, LEAST, MOST).astype(np.int64).reshape(len(q), len(p))


class Bucket:
    def __init__(self, ids: list[int], v: np.ndarray) -> None:
        self.ids, self.v = np.array(ids, np.int64), v
        self.norm = np.sqrt((self.v * self.v).sum(axis=1))
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def coordinates(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            x = self.v[:, f] / np.maximum(self.norm, 1e-300)
            order = np.argsort(x, kind="stable")
            self.lists[f] = x[order], order
        return self.lists[f]

    def feasible(self, unit: np.ndarray, theta: float, focus: int) -> np.ndarray:
        """Vectors whose cosine with a unit vector can be theta or more, by the focus coordinates' regions."""
        left = np.ones(len(self.ids), bool)
        for f in np.argsort(-np.abs(unit))[:focus]:
            c, slack = unit[f] * theta, np.sqrt(max(0.0, (1 - theta * theta) * (1 - unit[f] * unit[f])))
            low = -1.0 if unit[f] <= -theta else c - slack
            high = 1.0 if unit[f] >= theta else c + slack
            x, order = self.coordinates(int(f))
            inside = np.zeros(len(left), bool)
            inside[order[np.searchsorted(x, low - 1e-9) : np.searchsorted(x, high + 1e-9, "right")]] = True
            left &= inside
        return np.flatnonzero(left)

    def search(self, qid: np.ndarray, q: np.ndarray, least: np.ndarray, how: TopK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query index, ids, scores) of the best candidates that reach each query's least score."""
        qn = np.sqrt((q * q).sum(axis=1))
        longest = self.norm.max(initial=0.0)
        score = np.where(least == LEAST, -np.inf, least.astype(np.float64))
        with np.errstate(divide="ignore", invalid="ignore"):
            theta = np.where(qn * longest > 0, score / (qn * longest), np.where(least > 0, np.inf, -np.inf))
        by_length = np.flatnonzero((theta <= 1 + 1e-9) & (theta < how.coordinate))
        by_coordinate = np.flatnonzero((theta <= 1 + 1e-9) & (theta >= how.coordinate))
        for at in range(0, len(by_length), 256):
            some = by_length[at : at + 256]
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(least[some] > 0, least[some] / qn[some], 0.0)
            reach = np.searchsorted(-self.norm, -need * (1 - 1e-12), "right")
            got = products(q[some], self.v[: int(reach.max(initial=0))])
            for j, i in enumerate(some):
                yield self.pick(int(i), np.arange(reach[j]), got[j, : reach[j]], qid, least, how.k)
        for i in by_coordinate:
            some = self.feasible(q[i] / qn[i], min(1.0, float(theta[i])), how.focus)
            yield self.pick(int(i), some, products(q[i : i + 1], self.v[some])[0], qid, least, how.k)

    def pick(self, i: int, some: np.ndarray, got: np.ndarray, qid: np.ndarray, least: np.ndarray, k: int) -> tuple[int, np.ndarray, np.ndarray]:
        ok = (got >= least[i]) & (self.ids[some] != qid[i])
        ids, got = self.ids[some[ok]], got[ok]
        best = best_of(got, ids, k)
        return i, ids[best], got[best]


def vectors(kind: str, raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, kind).astype(np.float64).reshape(-1, dim)


def search(pairs: DataFrame, bucket: DataFrame, asked: DataFrame, how: TopK) -> DataFrame:
    """(query_id, vec_id, score) of the pairs (dim, q_block, block) of a query block, asked with its least scores, and a bucket."""
    tasks = max(1, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = pairs.withColumn("part", F.floor(F.col("q_block") / how.share).cast("int"))
    held = pairs.select("dim", "block", "part").distinct().join(bucket.select("dim", "block", "ids", "kind", "vectors"), ["dim", "block"])
    held = held.select("dim", "block", "part", F.lit(-1).alias("turn"), "ids", "kind", "vectors", F.array().cast("array<long>").alias("least"))
    passing = pairs.join(asked.select("dim", F.col("block").alias("q_block"), "ids", "kind", "vectors", "least"), ["dim", "q_block"])
    passing = passing.select("dim", "block", "part", F.col("q_block").cast("int").alias("turn"), "ids", "kind", "vectors", "least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Bucket | None = None
        for b in batches:
            for r in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                v = vectors(r["kind"], r["vectors"], r["dim"])
                if r["turn"] < 0:  # the queries that follow, up to the next bucket, are its own
                    now = Bucket(r["ids"], v)
                    continue
                qid, a, c, s = np.array(r["ids"], np.int64), [], [], []
                for i, ids, got in now.search(qid, v, np.array(r["least"], np.int64), how):
                    a.append(np.full(len(ids), qid[i]))
                    c.append(ids)
                    s.append(got)
                if a:
                    yield pa.record_batch([pa.array(np.concatenate(x)) for x in (a, c, s)], names=["query_id", "vec_id", "score"])

    rows = held.unionByName(passing).repartition(tasks, "dim", "block", "part").sortWithinPartitions("dim", "block", "part", "turn")
    return rows.mapInArrow(run, "query_id long, vec_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, is_query: Column, how: TopK = TopK()) -> DataFrame:
    """(query_id, rank, vec_id, score) for rows (id, v array<double>): each query's k best of all other rows."""
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull())
    bucket = written(blocks(rows, how.bucket), "buckets")
    asked = written(blocks(rows.where(is_query), how.queries), "queries")
    ends = F.transform("ids", lambda _: F.lit(LEAST).cast("long"))
    first = search(asked.select("dim", F.col("block").alias("q_block"), F.lit(0).alias("block")), bucket, asked.withColumn("least", ends), how)
    first = written(ranked(first, how.k), "first")
    reached = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") >= how.k)
    member = asked.select("dim", F.col("block").alias("q_block"), F.posexplode(F.arrays_zip("ids", "norms")).alias("pos", "q"))
    member = member.select("dim", "q_block", "pos", F.col("q.ids").alias("query_id"), F.col("q.norms").alias("norm"))
    # a block's queries come together again: as many rows as a block holds
    least = (
        member.join(reached.select("query_id", "s"), "query_id", "left").groupBy("dim", "q_block")
        .agg(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("s", F.lit(LEAST).cast("long")).alias("s")))), lambda x: x["s"]).alias("least"),
            F.min(F.when(F.coalesce("s", F.lit(0)) <= 0, 0.0).otherwise(F.col("s") / F.col("norm"))).alias("need"),
        )
    )
    least = written(least, "least")
    # block pairs are formed by number: those buckets, the longest first, whose length can reach some threshold
    lengths = bucket.where("block > 0").groupBy("dim").agg(F.collect_list("longest").alias("lengths"))
    lengths = written(lengths, "lengths")  # one number a bucket
    last = F.size(F.filter("lengths", lambda x: x >= F.col("need") * (1 - 1e-12)))
    pair = least.select("dim", "q_block", "need").join(lengths, "dim").withColumn("last", last).where("last > 0")
    pair = pair.select("dim", "q_block", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("block"))
    asked = asked.join(least.select("dim", F.col("q_block").alias("block"), "least"), ["dim", "block"])
    found = search(pair, bucket, asked, how).unionByName(first.select("query_id", "vec_id", "score"))
    return ranked(found, how.k).select("query_id", "rank", "vec_id", "score")


def integer_vectors(v: Column, scale: float) -> Column:
    """floor(scale * x) of each component, as doubles; null if the vector or a component is null or not finite."""
    d = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(v.isNotNull() & ~F.coalesce(bad, F.lit(True)), d)
