"""MinHash near-dedup with odd sketches.

1. Each text becomes its set of word shingles (64-bit hashes), MinHash band keys, and
   an odd sketch: each MinHash sample (the least hash of each of ``bins`` bins of one
   permutation; a set of at most that many shingles is its own sample) flips the bit of
   a bitmap that its hash names, so the bitmap holds parities, and the population count
   of the XOR of two sketches tells how many samples differ, sharply where similarities are high.
2. Texts of equal sets are one class, represented by the least id. Representatives lie in
   buckets by id, so that only ids move to their sketches.
3. Band keys give candidates. First every member of a key is paired with the key's
   least member only (a star; the members of a large key with the least of their part, these with the key's).
   Then only keys whose members are still in several components
   are looked at, in blocks of bounded size: pairs of members of different components, each pair
   in the first key that it shares. Where these keys are large, a first pass takes each
   member's most similar partner only, which joins what a large group holds together.
4. Candidates pass if their sketches do not rule out the threshold: for small sets the count
   is a lower bound of the difference, so nothing is lost; for larger ones ``slack`` is six
   standard deviations. Passing pairs are confirmed on full sets, which one more scan of the texts
   gives: it looks the ids up in a sorted array, and other texts don't move.
5. Components of confirmed links come from star contraction.

No group is paired with itself in full unless its members stay apart, nothing is capped, and
links are never gathered. The bands miss a pair of the threshold with odds of
(1 - 0.8^3)^20, six in 10^7.

Null, empty and wordless texts: empty set, linked with nothing, kept. Fewer words
than a shingle: the whole sequence is one shingle. Rows that share an id share their fate.
A null id links with nothing and is kept. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import LOWER, UPPER, bucketed, released, removed, resting, written
from lodestrata.llm.components import components
from lodestrata.llm.sorted_arrays import SortedArrays, sorted_table

FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


@dataclass(frozen=True)
class Near:
    words: int = 5
    percent: int = 80
    bands: int = 20
    rows: int = 3
    bins: int = 1024
    bits: int = 2048
    slack: float = 0.1
    block: int = 2048
    star: int = 1024


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of a whole text."""
    found = text.encode().translate(FOLD).split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = min(n, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(out)


class Sketcher:
    def __init__(self, how: Near) -> None:
        self.how, self.k = how, how.bands * how.rows
        self.mult = mixed(np.arange(1, self.k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        self.band = mixed(np.arange(how.bands, dtype=np.uint64) + np.uint64(7))

    def samples(self, s: np.ndarray) -> np.ndarray:
        out = np.full(self.k, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(s), 2048):
            x = s[i : i + 2048, None] * self.mult[None, :]
            x ^= x >> np.uint64(29)
            np.minimum(out, x.min(axis=0), out=out)
        return out

    def __call__(self, s: np.ndarray) -> tuple[np.ndarray, int, bytes]:
        """(band keys, samples, odd sketch) of a set that isn't empty."""
        key = self.band.copy()
        for col in self.samples(s).reshape(self.how.bands, self.how.rows).T:
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + col)
        x = mixed(s ^ np.uint64(0x5851F42D4C957F2D))
        if len(x) > self.how.bins:  # the least hash of each bin, bins being leading bits; a smaller set is its own sample
            x = np.sort(x)
            shift = np.uint64(64 - (self.how.bins - 1).bit_length())
            x = x[np.append(True, (x[1:] >> shift) != (x[:-1] >> shift))]
        bit = (mixed(x + np.uint64(1)) % np.uint64(self.how.bits)).astype(np.int64)
        odd = np.bincount(bit, minlength=self.how.bits) & 1
        return key.view(np.int64), len(x), np.packbits(odd.astype(np.uint8)).tobytes()


def may_link(xor_bits: np.ndarray, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, how: Near) -> np.ndarray:
    """Upper estimates of the similarity of sets of n_a and n_b shingles with a and b samples, from XOR population counts.

    Sets that are their own samples: parities that meet only hide differences, so the count is a lower bound of
    the difference and no link is lost. Sampled sets: the estimate corrected for met parities, plus ``slack``. One of each: 1.
    """
    whole_a, whole_b = n_a <= how.bins, n_b <= how.bins
    total = (n_a + n_b).astype(np.float64)
    match = (total - xor_bits) / 2.0
    exact = match / np.maximum(1.0, total - match)
    z = np.maximum(1.0 - 2.0 * xor_bits / how.bits, 1e-9)
    match = np.maximum(0.0, (a + b + how.bits / 2.0 * np.log(z)) / 2.0)
    j = np.full(len(xor_bits), how.percent / 100)
    for _ in range(6):  # share of the bins that either set fills: they follow from the union's size
        filled = how.bins * -np.expm1(total / (1.0 + j) * np.log1p(-1.0 / how.bins))
        j = np.minimum(1.0, match / np.maximum(1.0, filled))
    return np.where(whole_a & whole_b, exact, np.where(whole_a | whole_b, 1.0, j + how.slack))


def signatures(docs: DataFrame, id_col: str, text_col: str, how: Near) -> DataFrame:
    """(id, n, fp, keys, samples, odd) of each row: set size, fingerprint of the set, band keys, odd sketch and its samples."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        sketch = Sketcher(how)
        for b in batches:
            n, fp, keys, samples, odd = [], [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingles(text, how.words)
                n.append(len(s))
                fp.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                k, m, o = sketch(s) if len(s) else (None, None, None)
                keys.append(k)
                samples.append(m)
                odd.append(o)
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(samples, pa.int32()), pa.array(odd, pa.binary())], names=["id", "n", "fp", "keys", "samples", "odd"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(resting(sign), f"id {dict(docs.dtypes)[id_col]}, n long, fp binary, keys array<long>, samples int, odd binary")


def full_sets(docs: DataFrame, wanted: DataFrame, how: Near) -> DataFrame:
    """(id, fp, shingles) of those rows (id, text) whose id is among ``wanted``; fp tells texts of one id from each other."""
    ids = sorted_table(wanted.select(F.xxhash64("id").alias("hash"), F.lit(1.0).cast("float").alias("there")).distinct(), "wanted")
    files = sorted(ids.inputFiles())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        index = SortedArrays(files, 4_000_000)
        for b in batches:
            b = b.filter(pa.array(index.find(b.column(2).to_numpy())[:, 0] > 0))
            for i in range(0, b.num_rows, 64):  # long sets: small batches
                part = [shingles(t, how.words) for t in b.column(1).slice(i, 64).to_pylist()]
                fp = [xxhash.xxh3_128_digest(s.tobytes()) for s in part]
                yield pa.record_batch([b.column(0).slice(i, 64), pa.array(fp, pa.binary()), pa.array([s.view(np.int64) for s in part], pa.list_(pa.int64()))], names=["id", "fp", "shingles"])

    out = docs.where(F.col("id").isNotNull()).select("id", "text", F.xxhash64("id").alias("hash")).mapInArrow(resting(sets), f"id {dict(docs.dtypes)['id']}, fp binary, shingles array<long>")
    out = written(out, "sets")
    removed(ids)
    return out


class Linker:
    """Finds the links between class representatives of one table."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, how: Near) -> None:
        self.how = how
        self.docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        signed = written(signatures(docs, id_col, text_col, how), "signed")
        self.sized = written(signed.select("id", "n", "fp"), "sized")
        classes = self.sized.where(F.col("fp").isNotNull() & F.col("id").isNotNull()).groupBy("fp").agg(F.min("id").alias("rep"))
        self.classes = written(classes, "classes")
        one = signed.join(self.classes.select(F.col("rep").alias("id"), F.col("fp").alias("f")).hint("merge"), "id").where("fp = f")
        one = one.groupBy("id").agg(F.min_by(F.struct("n", "fp", "samples", "odd", "keys"), "fp").alias("x")).select("id", "x.*")
        self.reps = bucketed(one, "id", "reps")
        removed(signed)
        members = self.reps.select("id", "n", F.explode("keys").alias("key"))
        shared = members.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("id", "n")).alias("hub")).where("size > 1")
        shared = written(shared, "shared_keys")
        self.members = written(members.join(shared, "key"), "members")
        removed(shared)

    def stars(self) -> DataFrame:
        """(a, b): each member of a key with the least of its part of the key, and these with the key's least."""
        part = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / self.how.star))
        m = self.members.withColumn("part", part)
        m = m.withColumn("lead", F.min(F.struct("id", "n")).over(Window.partitionBy("key", "part")))
        to = F.when(F.col("id") == F.col("lead.id"), F.col("hub")).otherwise(F.col("lead"))
        pairs = m.select(to["id"].alias("a"), F.col("id").alias("b"), to["n"].alias("n_a"), F.col("n").alias("n_b")).where("a <> b")
        return pairs.where(100 * F.least("n_a", "n_b") >= self.how.percent * F.greatest("n_a", "n_b")).select("a", "b").distinct()

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose full sets are similar enough; sketches and sizes first."""
        how = self.how
        side = lambda c: self.reps.select(F.col("id").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("n", "fp", "samples", "odd")))
        sized = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= how.percent * F.greatest("n_a", "n_b"))
        passing = written(sketch_filter(sized, how).select("a", "b", "fp_a", "fp_b"), "passing")
        sets = full_sets(self.docs, passing.select(F.col("a").alias("id")).unionByName(passing.select(F.col("b").alias("id"))), how)
        of = lambda c: sets.select(F.col("id").alias(c), F.col("fp").alias(f"fp_{c}"), F.col("shingles").alias(f"s_{c}"))
        common = F.size(F.array_intersect("s_a", "s_b"))
        linked = (
            passing.join(of("a"), ["a", "fp_a"]).join(of("b"), ["b", "fp_b"])
            .select("a", "b", common.alias("both"), (F.size("s_a") + F.size("s_b")).alias("total"))
            .where(100 * F.col("both") >= how.percent * (F.col("total") - F.col("both")))
            .select("a", "b").distinct()
        )
        out = written(linked, "linked")
        removed(sets, passing)
        return out

    def open_pairs(self, comp: DataFrame, spread: DataFrame, best: int | None) -> DataFrame:
        """Candidates (a, b), a < b, of the keys ``spread``, whose members are in several components: all, or each member's best."""
        m = self.placed(comp).join(spread, "key", "left_semi").join(self.reps, "id")
        parts = F.ceil(F.col("size") / self.how.block).cast("int")
        m = m.withColumn("mine", F.pmod(F.xxhash64("id"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        m = m.select("key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "id", "component", "n", "samples", "odd", "keys", "mine")
        kind = dict(self.reps.dtypes)["id"]
        how = self.how
        return m.groupBy("key", "x", "y").applyInArrow(lambda t: apart(t, how, best), f"a {kind}, b {kind}")

    def placed(self, comp: DataFrame) -> DataFrame:
        m = self.members.select("key", "id", "size").join(comp.withColumnRenamed("node", "id"), "id", "left")
        return m.select("key", "id", "size", F.coalesce("component", "id").alias("component"))

    def links(self) -> DataFrame:
        tested = written(self.stars(), "tested")
        links = self.confirmed(tested)
        for best in (1, None):
            comp = written(components(links), "comp")
            spread = self.placed(comp).groupBy("key", "size").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
            spread = written(spread.select("key", "size"), "spread")
            rows, pairs = spread.agg(F.sum("size"), F.sum(F.col("size") * F.col("size"))).first()
            if not rows:
                removed(comp, spread)
                break
            if best and pairs <= 64 * rows:  # small keys only: all their pairs at once
                removed(comp, spread)
                continue
            new = self.open_pairs(comp, spread.select("key"), best).distinct().join(tested, ["a", "b"], "left_anti")
            new = written(new, "new")
            removed(comp, spread)
            tested = tested.unionByName(new)
            links = links.unionByName(self.confirmed(new))
        removed(tested, self.members)
        return links


def sketch_filter(pairs: DataFrame, how: Near) -> DataFrame:
    """Pairs whose sketches do not rule out the threshold."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in ("odd_a", "odd_b"))
                s_a, s_b, n_a, n_b = (b.column(c).to_numpy() for c in ("samples_a", "samples_b", "n_a", "n_b"))
                like = may_link(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64), s_a, s_b, n_a, n_b, how)
                yield b.filter(pa.array(like >= how.percent / 100 - 1e-9))

    return pairs.mapInArrow(keep, pairs.schema)


def apart(t: pa.Table, how: Near, best: int | None) -> pa.Table:
    """Pairs of one block pair of a key: members of different components whose sketches allow a link.

    With ``best``, each member's best few. Else all, each where this key is the first that the pair shares.
    """
    odd = np.frombuffer(b"".join(t.column("odd").to_pylist()), np.uint64).reshape(t.num_rows, -1)
    keys = t.column("keys").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
    comp = np.unique(t.column("component").to_numpy(), return_inverse=True)[1]
    mine, ids, n, samples = (t.column(c).to_numpy() for c in ("mine", "id", "n", "samples"))
    x, y, key = (t.column(c)[0].as_py() for c in ("x", "y", "key"))
    band = int(np.flatnonzero(keys[0] == key)[0])
    left, right = np.flatnonzero(mine == x), np.flatnonzero(mine == y)
    a, b = [], []
    for i in left:
        to = right[comp[right] != comp[i]]
        if x == y and best is None:
            to = to[to > i]
        to = to[100 * np.minimum(n[to], n[i]) >= how.percent * np.maximum(n[to], n[i])]
        if best is None and band:
            to = to[~(keys[to, :band] == keys[i, :band]).any(axis=1)]
        if not len(to):
            continue
        like = may_link(np.bitwise_count(odd[to] ^ odd[i]).sum(axis=1, dtype=np.int64), samples[to], samples[i], n[to], n[i], how)
        ok = like >= how.percent / 100 - 1e-9
        to, like = to[ok], like[ok]
        if best is not None and len(to) > best:
            to = to[np.argsort(-like, kind="stable")[:best]]
        a.append(np.minimum(ids[i], ids[to]))
        b.append(np.maximum(ids[i], ids[to]))
    kind = t.schema.field("id").type
    return pa.table({"a": pa.array(np.concatenate(a) if a else [], kind), "b": pa.array(np.concatenate(b) if b else [], kind)})


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Near = Near()) -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row; component_id: the least id reachable over links."""
    linker = Linker(docs, id_col, text_col, how)
    links = linker.links()
    comp = components(links).select(F.col("node").alias("rep"), "component")
    of_class = written(linker.classes.join(comp, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component")), "components")
    removed(linker.classes, linker.reps, links)
    # a class of very many copies is one row here: the join may split the other side
    return (
        linker.sized.join(of_class, "fp", "left")
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("id").isNotNull(), F.col("component")), F.col("id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
    )
