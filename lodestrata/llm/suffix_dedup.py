"""Suffix-array dedup of long byte strings that repeat across documents.

1. Equal texts are one: all but those of least id lose every byte (if long enough).
2. Every string of ``length`` bytes has an anchor, the k-mer of least hash within it, which only its
   content decides. Each text thus falls into segments, runs of
   strings with the same anchor. One shuffle of (anchor, id) finds the anchors that several
   texts have; all other segments hold nothing that repeats. An anchor that a batch of texts has
   more than once sends one entry for the batch, so no anchor fills a task. Entries move in blobs, one for each batch and part of the anchors.
3. The remaining segments meet by anchor. There, equal segments collapse into one with its least
   id; those that no other can share a string with, by the symbols around the anchor, are done. The suffix array of the rest, built by linear grouping, brings
   equal strings next to each other; the least id of such a run decides which
   occurrences go. Every string holds the anchor, so a segment's anchor and what follows it are one symbol there. Groups are streamed from sorted partitions, one at a time.
4. Anchors that occur more than ``hot`` times don't meet in one task. Their segments are dealt to parts by id; each part
   cuts its distinct ones into strings, the least id of each string's 128-bit hash is an aggregation over the
   parts, and the parts that have the string learn it. This is a choice of plan: both ways find the same strings.
5. The removed runs of each text come together again as intervals, and are cut out. Texts lie in
   buckets by id, so that only ids, anchors and intervals move to them.

Texts are UTF-8 bytes, null is empty, matches never cross texts. Texts shorter than
``length`` lose nothing. Each row is judged: rows that share an id never remove each other's bytes,
equal or not. A null id is larger than no other and smaller than none: such a row loses nothing and
takes nothing from others. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import bucketed, removed, written
from lodestrata.llm.gsaca import suffix_array

#: Stands for a segment's anchor, which all segments of a group have; no byte of UTF-8.
CORE = b"\xfe"
#: Bytes of short texts that are hashed together: few numpy calls, and arrays that stay in a core's cache.
TOGETHER = 1 << 14
#: Bits of a place in a text; above them stands the text's tag.
TAG = 40
#: Anchors are dealt to so many parts at least, each of which is held in memory.
PARTS = 1 << 10


@dataclass(frozen=True)
class Repeats:
    length: int = 50
    kmer: int = 20
    slice: int = 1 << 18
    hot: int = 5_000

    @property
    def short(self) -> int:
        """Symbols of a string whose anchor is one symbol."""
        return self.length - self.kmer + 1


def spread(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


#: A number for each byte, and the base of the polynomial that puts them together.
BYTES = spread(spread(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
BASE = 0x9E3779B97F4A7C15


def kmer_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of the k bytes that start at each position."""
    h, have, at, n = BYTES[b], 1, 0, len(b) - k + 1
    out = None
    while True:
        power = np.uint64(pow(BASE, have, 1 << 64))
        if k & have:  # runs of 1, 2, 4, ... bytes, put together by k's binary digits
            part = h[at : at + n]
            out = part if out is None else out * power + part
            at += have
        if at == k:
            return spread(out)
        h = h[:-have] * power + h[have:]
        have *= 2


class Segments(NamedTuple):
    """Runs of string starts first..last of a text with one anchor, and the place of that k-mer; places count within each text."""

    text: np.ndarray
    anchor: np.ndarray
    first: np.ndarray
    last: np.ndarray
    place: np.ndarray


def segments(texts: list[bytes], how: Repeats) -> Iterator[Segments]:
    """The segments of texts: short texts many at a time, long ones slice by slice."""
    w = how.length - how.kmer + 1
    some: list[int] = []
    size = 0

    def cut(raw: bytes, of: list[int], sizes: list[int], begin: int) -> Segments:
        b = np.frombuffer(raw, np.uint8)
        h = kmer_hashes(b, how.kmer)
        # least hash of w neighbours, leftmost on ties: hashes above, positions below
        m = (h >> np.uint64(20) << np.uint64(20)) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while span * 2 <= w:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        if span < w:
            m = np.minimum(m[: len(m) - (w - span)], m[w - span :])
        at = (m & np.uint64((1 << 20) - 1)).astype(np.int64)
        stop = np.cumsum(sizes)
        start = stop - sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)[: len(at)]
        inside = np.arange(len(at)) <= stop[owner] - how.length  # strings that end in the text where they start
        new = np.append(True, (at[1:] != at[:-1]) | ~inside[:-1])
        first = np.flatnonzero(new & inside)
        # a run ends before the next, or with its text's last string
        last = np.minimum(np.append(first[1:], len(at)) - 1, (stop - how.length)[owner[first]])
        own = start[owner[first]]
        return Segments(np.array(of)[owner[first]], h[at[first]].view(np.int64), first - own + begin, last - own + begin, at[first] - own + begin)

    def flush() -> Segments:
        return cut(b"".join(texts[k] for k in some), some, [len(texts[k]) for k in some], 0)

    for k, t in enumerate(texts):
        if len(t) < how.length:
            continue
        if len(t) > how.slice:
            for begin in range(0, len(t) - how.length + 1, how.slice):
                part = t[begin : begin + how.slice + how.length - 1]
                yield cut(part, [k], [len(part)], begin)
            continue
        if some and size + len(t) > min(how.slice, TOGETHER):
            yield flush()
            some, size = [], 0
        some.append(k)
        size += len(t)
    if some:
        yield flush()


def sharing(texts: list[bytes], length: int) -> list[bytes]:
    """The segments that may have a string in common with another: all that do, and few more.

    A common string of d symbols before the anchor has a third of all d, and from there on the symbols that any such string has in common.
    """
    reach = length - 1
    edges = [reach * j // 3 for j in range(4)]
    first: dict[bytes, int] = {}
    some: set[int] = set()
    for k, t in enumerate(texts):
        core = t.index(CORE)
        after = len(t) - core - 1
        for a, b in zip(edges, edges[1:], strict=False):
            if core >= a and after >= reach - b:
                x = first.setdefault(t[core - a : core + 1 + reach - b], k)
                if x != k:
                    some |= {x, k}
    return [texts[k] for k in sorted(some)]


def least_ids(group: dict[bytes, int], length: int) -> dict[bytes, list[tuple[int, int, int]]]:
    """For each segment of a group (segment to least id): runs (first, last, id) of its strings' starts, id the least that has them."""
    found = {t: [(0, len(t) - length, i)] for t, i in group.items()}
    texts = sharing(list(group), length) if len(group) > 1 else []
    if not texts:
        return found
    # what follows the anchor is one symbol, by its rank; the end is smaller than any
    cores = [t.index(CORE) for t in texts]
    rank = {x: 256 + k for k, x in enumerate(sorted({t[c:] for t, c in zip(texts, cores, strict=True)}))}
    whole: list[int] = []
    owner: list[int] = []
    begin: list[int] = []
    for k, (t, c) in enumerate(zip(texts, cores, strict=True)):
        begin.append(len(whole))
        whole += t[:c]
        whole.append(rank[t[c:]])
        owner += [k] * (c + 1)
    whole.append(-1)
    out = [[0] * (len(t) - length + 1) for t in texts]
    run: list[tuple[list[int], int]] = []
    known, least, ids = None, 0, [group[t] for t in texts]
    for p in suffix_array(whole)[1:]:
        k = owner[p]
        i = p - begin[k]
        if i >= len(out[k]):
            continue
        string = texts[k][i : i + length]
        if string != known:
            for o, at in run:
                o[at] = least
            run, known, least = [], string, ids[k]
        elif ids[k] < least:
            least = ids[k]
        run.append((out[k], i))
    for o, at in run:
        o[at] = least
    for t, o in zip(texts, out, strict=True):
        spans, at = [], 0
        for i in range(1, len(o) + 1):
            if i == len(o) or o[i] != o[at]:
                spans.append((at, i - 1, o[at]))
                at = i
        found[t] = spans
    return found


#: Kinds of rows about anchors: one text has it; several texts of a batch have it (the id is how often); an id that wants it; it is hot.
ONE, SEVERAL, WANTED, HOT = range(4)


def anchor_rows(anchors: np.ndarray, ids: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(anchors, pa.int64()), pa.array(ids, pa.int64()), pa.array(kind, pa.int8())], names=["anchor", "id", "kind"])


def turned(anchors: np.ndarray) -> np.ndarray:
    """Halves swapped, as the upper ones of least hashes are small."""
    a = anchors.view(np.uint64)
    return a << np.uint64(32) | a >> np.uint64(32)


def blob(a: np.ndarray, value: np.ndarray, kind: np.ndarray, base: int) -> bytes:
    """Entries in the order of their turned anchors: steps, values (ids less a base) and kinds, byte by byte, so that equal bytes stand together."""
    step = np.append(a[:1], a[1:] - a[:-1])
    less = np.where(kind == SEVERAL, value, value - base)
    planes = np.column_stack([step.view(np.uint8).reshape(-1, 8), less.view(np.uint8).reshape(-1, 8), kind.astype(np.uint8)])
    return base.to_bytes(8, "little", signed=True) + planes.T.tobytes()


def entries(z: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, value, kind) of a blob."""
    planes = np.frombuffer(z, np.uint8, offset=8).reshape(17, -1)
    a = np.cumsum(np.ascontiguousarray(planes[:8].T).view(np.uint64).ravel(), dtype=np.uint64)
    value, kind = np.ascontiguousarray(planes[8:16].T).view(np.int64).ravel(), planes[16]
    return turned(a).view(np.int64), np.where(kind == SEVERAL, value, value + int.from_bytes(z[:8], "little", signed=True)), kind


def anchored(texts: DataFrame, how: Repeats, parts: int) -> DataFrame:
    """(part, blob) of entries (anchor, id, kind): the distinct anchors of each text. Those that several texts of a batch have are wanted at once, in parts below zero, and reported with how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            a, i = turned(np.concatenate(anchors)), np.concatenate(ids)
            order = np.argsort(a)
            a, i = a[order], i[order]
            first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            n = np.diff(np.append(first, len(a)))
            more = np.repeat(n > 1, n)
            base = int(i.min())
            wanted, of = a[more], i[more]
            value = np.where(n > 1, np.add.reduceat(np.concatenate(counts)[order], first), i[first])
            kind, a = np.where(n > 1, SEVERAL, ONE), a[first]
            part = ((a >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            at = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            where, blobs = part[at].tolist(), [blob(a[x:y], value[x:y], kind[x:y], base) for x, y in zip(at, np.append(at[1:], len(a)), strict=True)]
            for x in range(0, len(wanted), 1 << 12):
                some = wanted[x : x + (1 << 12)]
                where.append(-1 - int(spread(some[:1] ^ of[x : x + 1].view(np.uint64))[0]) % parts)
                blobs.append(blob(some, of[x : x + (1 << 12)], np.full(len(some), WANTED), base))
            return pa.record_batch([pa.array(where, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])

        anchors, ids, counts, size = [], [], [], 0
        for b in batches:
            number = b.column(0).to_numpy()
            for at in range(0, b.num_rows, 512):  # bounds the texts held
                raw = [zstandard.decompress(z) for z in b.column(1).slice(at, 512).to_pylist()]
                for g in segments(raw, how):
                    order = np.lexsort((g.anchor, g.text))
                    a, t = g.anchor[order], g.text[order]
                    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (t[1:] != t[:-1])))
                    anchors.append(a[first])
                    ids.append(number[at + t[first]])
                    counts.append(np.diff(np.append(first, len(a))))
                    size += len(first)
                    if size > 1 << 20:
                        yield out()
                        anchors, ids, counts, size = [], [], [], 0
        if anchors:
            yield out()

    return texts.select("id", "z").mapInArrow(run, "part int, blob binary")


def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, id, kind) in the order of the anchors within each part, from rows (part, blob) in the order of their parts."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for part, some in groupby(rows, key=lambda r: r[0]):
        if part < 0:
            for _, z in some:
                yield anchor_rows(*entries(z))
            continue
        a, value, kind = (np.concatenate(x) for x in zip(*(entries(z) for _, z in some), strict=True))
        order = np.argsort(a)
        yield anchor_rows(a[order], value[order], kind[order])


def several(how: Repeats):
    """Over rows in the order of their anchors: those to be wanted, as more than one text has their anchor, and which anchors are hot. Holds one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, alone, total = None, None, 0  # the anchor that may go on, its only text so far if it has just one, how often it occurred

        def hot(anchor: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            some = n > how.hot
            return anchor_rows(anchor[some], n[some], np.full(some.sum(), HOT))

        for b in batches:
            a, i, kind = (b.column(c).to_numpy() for c in range(3))
            ready = kind == WANTED
            yield anchor_rows(a[ready], i[ready], kind[ready])
            a, i, kind = a[~ready], i[~ready], kind[~ready]
            if not len(a):
                continue
            first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            n = np.add.reduceat(np.where(kind == SEVERAL, i, 1), first)
            if a[0] == now:
                n[0] += total
                if alone is not None:
                    yield anchor_rows([now], [alone], [WANTED])
            elif now is not None:
                yield hot(np.array([now]), np.array([total]))
            wanted = (np.repeat(n, np.diff(np.append(first, len(a)))) > 1) & (kind == ONE)
            yield anchor_rows(a[wanted], i[wanted], np.full(wanted.sum(), WANTED))
            yield hot(a[first[:-1]], n[:-1])
            now, total = a[-1], n[-1]
            alone = i[-1] if total == 1 else None
        if now is not None:
            yield hot(np.array([now]), np.array([total]))

    return run


def shared_segments(texts: DataFrame, how: Repeats) -> DataFrame:
    """(anchor, id, start, segment) of rows (id, z, tag, anchors): the segments whose anchor is among them, with one byte in its place.

    The start has the text's tag in its leading bits.
    """

    def mixed(text: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        return anchor.view(np.uint64) ^ spread((text.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number, tags = b.column("id").to_numpy(), b.column("tag").to_numpy()
            for at in range(0, b.num_rows, 512):
                raw = [zstandard.decompress(z) for z in b.column("z").slice(at, 512).to_pylist()]
                lists = b.column("anchors").slice(at, 512)
                owner = np.repeat(np.arange(len(raw)), lists.value_lengths().to_numpy())
                wanted = np.sort(mixed(owner, lists.flatten().to_numpy()))
                for g in segments(raw, how):
                    key = mixed(g.text, g.anchor)
                    hit = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key)
                    if len(hit):
                        t = g.text[hit]
                        ends = zip(t.tolist(), g.first[hit].tolist(), g.last[hit].tolist(), g.place[hit].tolist(), strict=True)
                        some = [raw[k][x:p] + CORE + raw[k][p + how.kmer : y + how.length] for k, x, y, p in ends]
                        start = g.first[hit] + (tags[at + t] << TAG)
                        yield pa.record_batch([pa.array(g.anchor[hit]), pa.array(number[at + t]), pa.array(start), pa.array(some, pa.binary())], names=["anchor", "id", "start", "segment"])

    return texts.mapInArrow(run, "anchor long, id long, start long, segment binary")


def repeated_hot(segs: DataFrame, how: Repeats, parts: int) -> DataFrame:
    """(id, start, stop): bytes to remove, of anchors whose segments are dealt to ``parts`` parts by id, so that none fills a task."""
    tasks = max(1, int(segs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = segs.withColumns({"salt": F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"), "turn": F.lit(1)})
    segs = written(salted.select("anchor", "salt", "turn", "id", "start", "segment"), "hot_segments")
    dealt = lambda rows: rows.repartition(tasks, "anchor", "salt").sortWithinPartitions("anchor", "salt", "turn")

    def strings(segment: bytes) -> list[bytes]:
        return [xxhash.xxh3_128_digest(segment[k : k + how.short]) for k in range(len(segment) - how.short + 1)]

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], Iterator[tuple]]]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        return groupby(rows, key=lambda r: r[:2])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The least id that has each string of a part; equal segments are looked at once."""
        for (anchor, salt), rows in groups(batches):
            least: dict[bytes, int] = {}
            for _, _, _, i, _, segment in rows:
                least[segment] = min(i, least.get(segment, i))
            of: dict[bytes, int] = {}
            for segment, i in least.items():
                for x in strings(segment):
                    of[x] = min(i, of.get(x, i))
            yield pa.record_batch([pa.array([anchor] * len(of)), pa.array([salt] * len(of), pa.int32()), pa.array(list(of), pa.binary()), pa.array(list(of.values()))], names=["anchor", "salt", "string", "least"])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each part that has a string learns the least id of all parts."""
        for b in batches:
            n = b.column("salts").value_lengths().to_numpy()
            again = pa.array(np.repeat(np.arange(b.num_rows), n))
            none = pa.array(np.zeros(len(again), np.int64))
            yield pa.record_batch([b.column("anchor").take(again), b.column("salts").flatten(), pa.array(np.zeros(len(again), np.int32)), b.column("first").take(again), none, b.column("string").take(again)], names=["anchor", "salt", "turn", "id", "start", "segment"])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches):
            first: dict[bytes, int] = {}
            found: dict[bytes, list[tuple[int, int, int]]] = {}
            out: list[tuple[int, int, int]] = []
            for _, _, turn, i, start, segment in rows:
                if turn == 0:
                    first[segment] = i
                    continue
                if segment not in found:
                    least = [first[x] for x in strings(segment)]
                    edge = [k for k in range(len(least) + 1) if k in (0, len(least)) or least[k] != least[k - 1]]
                    found[segment] = [(x, y - 1 + how.length, least[x]) for x, y in zip(edge, edge[1:], strict=False)]
                out += [(i, start + a, start + b) for a, b, least in found[segment] if least < i]
                if len(out) > 20_000:
                    yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["id", "start", "stop"])
                    out = []
            if out:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["id", "start", "stop"])

    least = dealt(segs).mapInArrow(local, "anchor long, salt int, string binary, least long")
    first = least.groupBy("anchor", "string").agg(F.min("least").alias("first"), F.collect_set("salt").alias("salts"))
    told = first.mapInArrow(back, "anchor long, salt int, turn int, id long, start long, segment binary")
    return dealt(told.unionByName(segs)).mapInArrow(spans, "id long, start long, stop long")


def repeated(segs: DataFrame, how: Repeats) -> DataFrame:
    """(id, start, stop): bytes to remove, from segments sorted by anchor within partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, int, bytes]]:
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        ids, starts, stops = [], [], []

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(x, pa.int64()) for x in (ids, starts, stops)], names=["id", "start", "stop"])

        for _, group in groupby(rows(), key=lambda r: r[0]):
            least: dict[bytes, int] = {}
            where: list[tuple[int, int, bytes]] = []
            for _, i, start, seg in group:
                if seg not in least or i < least[seg]:
                    least[seg] = i
                where.append((i, start, seg))
            if len(where) < 2:
                continue
            found = least_ids(least, how.short)
            for i, start, seg in where:
                spans = found[seg]
                for a, b, first in spans:
                    if first < i:
                        if ids and ids[-1] == i and stops[-1] == start + a - 1 + how.length:  # goes on from the run before
                            stops[-1] += b - a + 1
                            continue
                        ids.append(i)
                        starts.append(start + a)
                        stops.append(start + b + how.length)
            if len(ids) > 20_000:
                yield out()
                ids, starts, stops = [], [], []
        if ids:
            yield out()

    return segs.mapInArrow(run, "id long, start long, stop long")


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal runs removed) of a text and intervals to remove."""
    left, at, n = [], 0, 0
    stop = -1
    for a, b in sorted(spans):
        if a > stop:
            left.append(text[at:a])
            n += 1
        at = stop = max(stop, b)
    kept = b"".join([*left, text[at:]])
    return kept, len(text) - len(kept), n


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Repeats = Repeats(), with_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of each row; ids are longs."""
    spark = docs.sparkSession
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    prints = rows.where(F.col("id").isNotNull()).select("id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("fp"), (F.octet_length("text") >= how.length).alias("long"))
    prints = written(prints, "prints")
    first = prints.where("long").groupBy("fp").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep <> last").select("fp", "rep")
    first = written(first, "first")
    copies = prints.where("long").join(first, "fp").where("id <> rep").select("id", "fp").distinct()
    twins = prints.groupBy("id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("id")  # ids of several texts
    marks = copies.withColumns({"copy": F.lit(True), "twin": F.lit(False)}).unionByName(prints.join(twins, "id").select("id", "fp").distinct().withColumns({"copy": F.lit(False), "twin": F.lit(True)}))
    marks = marks.groupBy("id", "fp").agg(F.max("copy").alias("copy"), F.max("twin").alias("twin"))
    marks = written(marks.groupBy("id").agg(F.collect_list(F.struct("fp", "copy", "twin")).alias("marks")), "marks")

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=3)
        for b in batches:
            raw = [t.encode() for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([c.compress(t) for t in raw], pa.binary()), pa.array([hashlib.md5(t).digest() for t in raw], pa.binary())], names=["id", "z", "fp"])

    packed = rows.mapInArrow(squeeze, "id long, z binary, fp binary")
    mine = F.filter("marks", lambda m: m["fp"] == F.col("fp"))[0]
    # the tag tells an id's texts from each other
    tag = F.when(mine["twin"], F.conv(F.substring(F.hex("fp"), 1, 5), 16, 10).cast("long") + 1)
    texts = packed.join(marks.hint("merge"), "id", "left").select("id", "z", F.coalesce(mine["copy"], F.lit(False)).alias("copy"), F.coalesce(tag, F.lit(0)).cast("long").alias("tag"))
    texts = bucketed(texts, "id", "suffix_texts")
    removed(first, prints, marks)
    own = texts.where(~F.col("copy") & F.col("id").isNotNull()).select("id", "z", "tag")

    pick = several(how)
    by_part = anchored(own, how, max(PARTS, 8 * tasks)).repartition(tasks, "part").sortWithinPartitions("part")
    shared = written(by_part.mapInArrow(lambda batches: pick(in_order(batches)), "anchor long, id long, kind byte"), "shared")
    wants, hot = shared.where(F.col("kind") == WANTED).select("anchor", "id"), shared.where(F.col("kind") == HOT)
    most = hot.agg(F.max("id")).first()[0]
    if most:
        hot = written(hot.select("anchor"), "hot_anchors")
        heated, wants = wants.join(hot, "anchor", "left_semi"), wants.join(hot, "anchor", "left_anti")
    segments_of = lambda w: shared_segments(own.join(w.groupBy("id").agg(F.collect_set("anchor").alias("anchors")), "id"), how)
    spans = repeated(segments_of(wants).repartition(tasks, "anchor").sortWithinPartitions("anchor"), how)
    if most:
        spans = spans.unionByName(repeated_hot(segments_of(heated), how, -(-most // how.hot)))
    # texts move for no join: their id decides the bucket
    of_id = spans.groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for z, copy, tag, spans in zip(*(b.column(n).to_pylist() for n in ("z", "copy", "tag", "spans")), strict=True):
                text = zstandard.decompress(z)
                if copy:
                    left, gone, n = b"", len(text), 1
                else:
                    base = tag << TAG
                    left, gone, n = cut(text, [(s["start"] - base, s["stop"] - base) for s in spans or () if s["start"] >> TAG == tag])
                for k, v in zip(got, (len(text), gone, n, hashlib.sha256(left).hexdigest(), left), strict=True):
                    got[k].append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            arrays = [pa.array(v, k) for v, k in zip(got.values(), kinds, strict=True)]
            yield pa.record_batch([b.column("id"), *arrays[: 4 + with_text]], names=[id_col, *list(got)[: 4 + with_text]])

    schema = f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return texts.join(of_id, "id", "left").mapInArrow(finish, schema)
