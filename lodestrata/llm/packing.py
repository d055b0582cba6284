"""Packing: order-preserving dynamic programming over document and sentence boundaries.

Documents stay in the order of their table. Each task walks its own rows, so
nothing is shuffled. Within a run of documents a sequence is a window between two
boundaries, at most ``size`` tokens long. Its cost is its padding plus a penalty if it
ends inside a document; the least total cost follows from

    f(j) = penalty(j) + min over i of f(i) + size - (pos(j) - pos(i))

where the minimum over the sliding window of reachable i is the front of a monotone
queue of f(i) + pos(i). Windows of a power of two are free of padding and are
looked up by position. Boundaries are document ends, sentence ends and, where
a sentence is long, every ``step`` tokens at a higher penalty. Runs are as long
as ``run`` tokens; the last sequence of a run opens the next, so padding at a forced end
comes once a task, and there the rest may be cut into powers of two.

Token ids: the tokenizer splits at white space first, so the ids of a text are those of
its space-separated chunks, which a bounded cache keeps; a chunk never seen
goes through the tokenizer itself. Texts whose chunks stand between single spaces are split together, and each
distinct chunk of some megabytes is looked up once. Texts that hold a special token go through the tokenizer whole.

Null or empty text: just the end id. An empty table gives no rows. Repeated rows are
packed as often as they come. Very long texts run over many sequences.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import held, resting

SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Characters of texts that are split together.
TOGETHER = 1 << 23
RARE = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


@dataclass(frozen=True)
class Packing:
    size: int = 2048
    end_id: int = 1
    cut: float = 8.0
    deep_cut: float = 24.0
    step: int = 64
    run: int = 1 << 19
    cache: int = 1 << 20


#: Fixed value: how byte-level BPE splits text before it merges.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ranked(path: str):
    """The same byte-level BPE in tiktoken, which merges faster; None unless the file's ids follow its merges."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    model, pre = j["model"], j["pre_tokenizer"] or {}
    plain = [b for r in ((33, 126), (161, 172), (174, 255)) for b in range(r[0], r[1] + 1)]
    char = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    if j["normalizer"] or model.get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    vocab, special = model["vocab"], {t["content"] for t in j["added_tokens"]}
    for i, m in enumerate(model["merges"]):
        if vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) != 256 + i:
            return None
    ranks = {bytes(map(char.__getitem__, k)): v for k, v in vocab.items() if k not in special}
    return tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of whole texts and the token offsets of their sentence ends."""

    def __init__(self, path: str, limit: int) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok, self.limit = Tokenizer.from_file(path), limit
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.fast = ranked(path)
        #: Bytes of each id, where ids are tiktoken's.
        self.n_bytes = np.zeros(self.fast.n_vocab if self.fast else 0, np.int64)
        for b in self.fast.token_byte_values() if self.fast else ():
            self.n_bytes[self.fast.encode_single_token(b)] = len(b)
        #: Ids of chunks that follow a space (which belongs to them), and those of them that end a sentence.
        self.ids: dict[str, bytes] = {}
        self.ends: set[str] = set()

    @classmethod
    def of(cls, path: str, limit: int) -> Encoder:
        return held(("encoder", path), lambda: cls(path, limit))

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def ids_of(self, chunks: list[str]) -> Iterator[bytes]:
        if self.fast:
            return (array("I", x).tobytes() for x in map(self.fast.encode_ordinary, chunks))
        return (array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(chunks, add_special_tokens=False))

    def joined(self, chunks: list[str]) -> list[bytes] | None:
        """Ids of chunks that follow a space, by one call: the tokenizer splits before each of these spaces. None where it doesn't."""
        ids = np.array(self.fast.encode_ordinary(" " + " ".join(chunks)), np.uint32)
        done = np.cumsum(self.n_bytes[ids])
        stops = np.cumsum(np.fromiter((len(c) if c.isascii() else len(c.encode()) for c in chunks), np.int64, len(chunks)) + 1)
        last = np.minimum(np.searchsorted(done, stops), len(done) - 1)
        if done[-1] != stops[-1] or (done[last] != stops).any():
            return None
        data, at = ids.tobytes(), [0, *((last + 1) << 2).tolist()]
        return [data[a:b] for a, b in pairwise(at)]

    def learn(self, chunks: set[str]) -> None:
        new = list(chunks)
        if not new:
            return
        got = self.joined(new) if self.fast else None
        self.ids.update(zip(new, got or self.ids_of([" " + c for c in new]), strict=True))
        self.ends.update(c for c in new if not c.isalnum() and sentence_end(c))

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        if not text:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if any(s in text for s in self.special):
            return self.encode(text), np.zeros(0, np.int64)
        if len(self.ids) > self.limit:
            self.ids.clear()
            self.ends.clear()
        first, *chunks = SAFE.split(text)
        got = list(map(self.ids.get, chunks))
        if None in got:
            self.learn({c for c, g in zip(chunks, got, strict=True) if g is None})
            got = list(map(self.ids.__getitem__, chunks))
        head = next(iter(self.ids_of([first])))
        at = (np.cumsum(np.fromiter(map(len, got), np.int64, len(got))) + len(head)) >> 2
        ends = at[np.fromiter(map(self.ends.__contains__, chunks), bool, len(chunks))]
        return np.frombuffer(head + b"".join(got), np.uint32), ends

    def plain(self, text: str | None) -> bool:
        """Are its chunks what stands between its spaces?"""
        if not text or text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text or RARE.search(text):
            return False
        return not any(s in text for s in self.special)

    def together(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What each of some plain texts gives."""
        if len(self.ids) > self.limit:
            self.ids.clear()
            self.ends.clear()
        lists = pc.split_pattern(texts, " ")
        edges = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(), dtype=np.int64))
        coded = lists.flatten().dictionary_encode()
        code, n = coded.indices.to_numpy().copy(), len(coded.dictionary)
        firsts = coded.dictionary.take(pa.array(code[edges[:-1]])).to_pylist()
        code[edges[:-1]] = n + np.arange(len(firsts))
        used = np.zeros(n + len(firsts), bool)
        used[code] = True  # a chunk that only opens texts follows no space
        code = (np.cumsum(used, dtype=np.int32) - 1)[code]
        chunks = coded.dictionary.filter(pa.array(used[:n])).to_numpy(zero_copy_only=False).tolist()
        del lists, coded
        got = list(map(self.ids.get, chunks))
        new = {c for c, g in zip(chunks, got, strict=True) if g is None}
        if new:
            self.learn(new)
            got = list(map(self.ids.__getitem__, chunks))
        _, offsets, data = pa.array([*got, *self.ids_of(firsts)], pa.large_binary()).take(pa.array(code)).buffers()
        at = np.frombuffer(offsets, np.int64, len(code) + 1) >> 2
        ids = np.frombuffer(data, np.uint32, at[-1])
        ending = np.zeros(len(got) + len(firsts), bool)
        ending[: len(got)] = np.fromiter(map(self.ends.__contains__, chunks), bool, len(got))
        stops = np.flatnonzero(ending[code])
        ends, of = at[stops + 1], np.searchsorted(stops, edges)
        del code, chunks, got
        for a, b, i, j in zip(at[edges[:-1]], at[edges[1:]], of, of[1:], strict=False):
            yield ids[a:b], ends[i:j] - a

    def many(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What each of the texts gives, in order."""
        rows, begin = texts.to_pylist(), 0
        while begin < len(rows):
            end, size = begin, 0
            while end < len(rows) and (end == begin or size + len(rows[end] or "") <= TOGETHER):
                size, end = size + len(rows[end] or ""), end + 1
            plain = list(map(self.plain, rows[begin:end]))
            found = self.together(texts.take(pa.array(np.flatnonzero(plain) + begin))) if any(plain) else iter(())
            for text, p in zip(rows[begin:end], plain, strict=True):
                yield next(found) if p else self(text)
            begin = end


def sentence_end(chunk: str) -> bool:
    return chunk.rstrip("\"')»”]")[-1:] in (".", "!", "?", "…") or "\n" in chunk


def boundaries(length: int, ends: np.ndarray, how: Packing) -> tuple[np.ndarray, np.ndarray]:
    """Cut offsets of one document (its end last) and their penalties."""
    main = np.append(ends[:-1] if len(ends) and ends[-1] == length else ends, length)
    gaps = main.copy()
    gaps[1:] -= main[:-1]
    wide = np.flatnonzero(gaps > 2 * how.step)
    if len(wide):
        extra = np.concatenate([np.arange(main[i] - gaps[i] + how.step, main[i], how.step) for i in wide])
        pos = np.concatenate([main, extra])
        pen = np.concatenate([np.full(len(main), how.cut), np.full(len(extra), how.deep_cut)])
        order = np.argsort(pos, kind="stable")
        pos, pen = pos[order], pen[order]
    else:
        pos, pen = main, np.full(len(main), how.cut)
    pen[-1] = 0.0
    return pos, pen


def powers_of_two(pos: np.ndarray, size: int) -> tuple[list[int], list[int]]:
    """(j, i) of all boundaries that lie a power of two apart, 32 at least and less than size, by j and then by that power; -1 ends j."""
    found = []
    for w in (1 << k for k in range(5, size.bit_length()) if 1 << k < size):
        i = np.searchsorted(pos, pos - w, "right") - 1
        j = np.flatnonzero((i >= 0) & (pos[i] == pos - w))
        found.append((j, i[j]))
    j, i = (np.concatenate([x[n] for x in found] or [np.zeros(0, np.int64)]) for n in (0, 1))
    order = np.argsort(j, kind="stable")
    return [*j[order].tolist(), -1], i[order].tolist()


def windows(pos: list[int], pen: list[float], size: int) -> list[int]:
    """Indices of the boundaries that end the windows of least cost; pos[0] is the start, gaps are at most size."""
    f, back = [0.0] * len(pos), [0] * len(pos)
    to, come = powers_of_two(np.array(pos), size)
    turn = 0
    queue: deque[int] = deque([0])
    key = [float(pos[0])] + [0.0] * (len(pos) - 1)  # f(i) + pos(i)
    for j in range(1, len(pos)):
        p = pos[j]
        while pos[queue[0]] < p - size:
            queue.popleft()
        i = queue[0]
        best = key[i] + size - p
        while to[turn] == j:
            o = come[turn]
            turn += 1
            if f[o] < best:
                best, i = f[o], o
        best += pen[j]
        f[j], back[j], k = best, i, best + p
        key[j] = k
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    out, j = [], len(pos) - 1
    while j:
        out.append(j)
        j = back[j]
    return out[::-1]


def rest(length: int, how: Packing) -> list[int]:
    """Lengths of the sequences that hold a task's last one: itself, or powers of two where cuts cost less than padding."""
    if length & (length - 1) == 0:
        return [length]
    bits = [1 << k for k in range(how.size.bit_length(), -1, -1) if length >> k & 1]
    return bits if (len(bits) - 1) * how.deep_cut < how.size - length else [length]


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", how: Packing = Packing(), with_ids: bool = False) -> DataFrame:
    """Pieces (id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of all rows; tokenizer: path of a tokenizers file."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer, how.cache)
        sequence = TaskContext.get().partitionId() << 32
        held: list[list] = []  # [id, ids, cut offsets, penalties, start of what is left]
        total = 0
        kind = None

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, total, sequence
            pos, pen, base = [0], [0.0], 0
            for _, ids, cut, cost, start in held:
                left = cut > start
                pos += (base + cut[left] - start).tolist()
                pen += cost[left].tolist()
                base += len(ids) - start
            ends = [pos[j] for j in windows(pos, pen, how.size)]
            if last:
                begin = ends[-2] if len(ends) > 1 else 0
                ends[-1:] = (begin + np.cumsum(rest(ends[-1] - begin, how))).tolist()
            else:
                ends.pop()  # the last sequence opens the next run
            rows: dict[str, list] = {n: [] for n in ("id", "start", "length", "crc", "tokens", "seq", "offset", "ids")}
            begin, d, doc_at = 0, 0, 0
            for end in ends:
                at = begin
                while at < end:
                    doc, ids, _, _, start = held[d]
                    a = start + at - doc_at
                    n = min(len(ids) - a, end - at)
                    piece = ids[a : a + n]
                    for k, v in zip(rows, (doc, a, n, zlib.crc32(piece), len(ids), sequence, at - begin, piece if with_ids else None), strict=True):
                        rows[k].append(v)
                    at += n
                    if a + n == len(ids):
                        doc_at, d = at, d + 1
                sequence += 1
                begin = end
            held = held[d:]
            if held and begin > doc_at:
                held[0][4] += begin - doc_at
            total -= begin
            for i in range(0, len(rows["id"]), 10_000):
                part = {k: v[i : i + 10_000] for k, v in rows.items()}
                arrays = [pa.array(part["id"], kind), *(pa.array(part[k], pa.int64()) for k in ("start", "length", "crc", "tokens", "seq", "offset"))]
                if with_ids:
                    arrays.append(pa.array([x.astype(np.int32) for x in part["ids"]], pa.list_(pa.int32())))
                yield pa.record_batch(arrays, names=names)

        for b in batches:
            kind = b.column(0).type
            for doc, (ids, ends) in zip(b.column(0).to_pylist(), encoder.many(b.column(1)), strict=True):
                ids = np.append(ids, np.uint32(how.end_id))
                held.append([doc, ids, *boundaries(len(ids), ends, how), 0])
                total += len(ids)
                if total >= how.run:
                    yield from flush(False)
        if held:
            yield from flush(True)

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(resting(packed), schema)
