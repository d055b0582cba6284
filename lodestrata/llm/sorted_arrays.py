"""Sorted arrays in the shared folder, found by binary search: what workers look up without holding it."""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame

from lodestrata.llm.common import filesystem, written


def sorted_table(df: DataFrame, name: str) -> DataFrame:
    """Rows (hash long, numbers) written in the order of their hash, in blocks of a megabyte."""
    tasks = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.repartitionByRange(tasks, "hash").sortWithinPartitions("hash")
    return written(rows, name, **{"parquet.block.size": str(1 << 20), "compression": "uncompressed"})


def opened(file: str) -> pq.ParquetFile:
    fs, path = filesystem(file)
    return pq.ParquetFile(fs.open_input_file(path))


class SortedArrays:
    """Rows (hash, values) in files that are sorted by hash, found by binary search; at most ``held`` rows stay in memory.

    Few enough rows are one block; else blocks come and go.
    """

    def __init__(self, files: list[str], held: int) -> None:
        self.files, self.held, self.rows, self.width = files, held, 0, 1
        self.blocks: OrderedDict[int, tuple[np.ndarray, np.ndarray]] = OrderedDict()
        first, total = [], 0
        for i, f in enumerate(files):
            md = opened(f).metadata
            self.width, total = md.num_columns - 1, total + md.num_rows
            first += [(md.row_group(g).column(0).statistics.min, i, g) for g in range(md.num_row_groups) if md.row_group(g).num_rows]
        first.sort()
        self.first, self.place = np.array([x[0] for x in first], np.int64), [x[1:] for x in first]
        if 0 < total <= held:
            parts = [self.read(*x) for x in self.place]
            self.blocks[0] = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
            self.first, self.rows = self.first[:1], total

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i in self.blocks:
            self.blocks.move_to_end(i)
            return self.blocks[i]
        got = self.blocks[i] = self.read(*self.place[i])
        self.rows += len(got[0])
        while self.rows > self.held and len(self.blocks) > 1:
            self.rows -= len(self.blocks.popitem(last=False)[1][0])
        return got

    def read(self, file: int, group: int) -> tuple[np.ndarray, np.ndarray]:
        t = opened(self.files[file]).read_row_group(group)
        return t.column(0).to_numpy(), np.column_stack([t.column(c).to_numpy() for c in range(1, t.num_columns)])

    def find(self, q: np.ndarray) -> np.ndarray:
        """Values of each hash, zeros where it isn't there."""
        out = np.zeros((len(q), self.width), np.float32)
        if not len(self.first) or not len(q):
            return out
        order = np.argsort(q)
        q = q[order]
        at = np.searchsorted(self.first, q, "right") - 1
        edges = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        for a, b in zip(edges, np.append(edges[1:], len(q)), strict=True):
            if at[a] >= 0:
                key, values = self.block(int(at[a]))
                j = np.minimum(np.searchsorted(key, q[a:b]), len(key) - 1)
                hit = key[j] == q[a:b]
                out[order[a:b][hit]] = values[j[hit]]
        return out


def hashes(name: str, key: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64(name, key) gives."""
    seed = np.uint64(xxhash.xxh64_intdigest(name.encode(), 42))
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    with np.errstate(over="ignore"):
        h = turn(key.view(np.uint64) * p2, 31) * p1 ^ (seed + p5 + np.uint64(8))
        h = turn(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64)
