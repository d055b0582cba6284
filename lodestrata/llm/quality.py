"""Quality rules: base counts and a perplexity band of a modified Kneser-Ney model.

The model is over characters, one for each language. Spark counts the n-grams of
every whole text, each task summing its own batches and Spark the tasks'. A model
that has learnt junk as readily as prose finds junk likely, so a character's
probability mixes two models: that of the texts which read as prose (``trusted``: few symbols
to the word, not mostly capitals), and, with weight ``rest``, that of all texts.
A language without such prose takes the pooled prose of all languages in its place; where
no text at all reads as prose, the model of all texts stands alone.

The model is built by aggregations alone. Counts of the highest order give the continuation
counts of each lower one; each order's contexts get their total and how many of their
n-grams have count one, two and more; counts of counts give the discounts, as for modified
Kneser-Ney. All of it is written to the shared folder as arrays sorted by a 64-bit hash of
(model, language, order, symbols), cut into blocks. Workers hold the first hash of each block
and a bounded number of blocks; they look n-grams up by binary search, many at a
time, and remember the probabilities of the commonest in a table of fixed size. Neither the
driver nor a worker ever holds the model, which grows with the distinct n-grams of the input.
False hits need two equal hashes: odds of (entries / 2^64) a look-up.

A document passes if its perplexity lies within its
language's band: the median log-perplexity plus and minus ``band`` times
the distance between the quartiles (at least ``floor``). Quartiles are exact, over
log-perplexities rounded to 1/``grain``.

Symbols are code points below 2048, the rest fold into 2048 more. The order is the
same for every input, so a text is judged alike in small and large corpora.

Null or empty text: no words, base_failed, perplexity null. A null language is a
language of its own. A null id is an id like others; repeated rows count as often as they stand there
and are judged alike. Very long texts are counted and scored whole, in slices. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import held, released, removed, resting, written
from lodestrata.llm.sorted_arrays import SortedArrays, hashes, opened, sorted_table

BITS = 12
SYMBOLS = re.compile(r"[#*$%&|<>]")
CAPITALS = re.compile(r"[A-Z\xC0-\xDE]")
#: Characters in one numpy slice.
SLICE = 1 << 20
START = 1  # symbol before a text's first character
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Perplexity:
    order: int = 5
    band: float = 4.0
    floor: float = 0.4
    rest: float = 0.01
    grain: int = 1024
    #: Rows of n-grams and of contexts that a worker holds.
    held_grams: int = 8_000_000
    held_heads: int = 3_000_000
    #: log2 of the probabilities that a worker remembers for each language, and languages.
    memo_bits: int = 20
    memo_languages: int = 8


def symbols(text: str) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    if cp.max(initial=0) >= 2048:
        cp = np.where(cp < 2048, cp, 2048 + (cp * 2654435761 % 2048))
    return cp


def trusted(text: str) -> bool:
    """Does it count as prose: at most one symbol to ten words (or to sixty characters, where words are not spaced), at most half of it capitals."""
    return 10 * len(SYMBOLS.findall(text)) <= max(len(text.split()), len(text) // 6) + 1 and 2 * len(CAPITALS.findall(text)) <= len("".join(text.split()))


def grams(text: str, order: int) -> np.ndarray:
    """Packed n-grams that end at each character, padded at the front."""
    s = np.concatenate([np.full(order - 1, START, np.int64), symbols(text)])
    n = len(s) - order + 1
    out, have = s, 1
    while have * 2 <= order:  # runs of 2, 4, ... symbols
        out, have = (out[:-have] << BITS * have) | out[have:], have * 2
    for i in range(have, order):
        out = (out[:n] << BITS) | s[i : n + i]
    return out[:n]


def slices(text: str, order: int) -> Iterator[np.ndarray]:
    """grams() of the whole text in bounded pieces."""
    if len(text) <= SLICE:
        if text:
            yield grams(text, order)
        return
    for at in range(0, len(text), SLICE):
        part = grams(text[max(0, at - order + 1) : at + SLICE], order)
        yield part[min(at, order - 1) :] if at else part


def base_counts(text: str | None, width: int = 8) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode()
    found = raw.split()  # for bytes, white space is just x20 and x09 to x0D
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    n, dup = len(found), len(lines) - len(set(lines))
    repeat = 0
    if n > width:
        number = {w: i for i, w in enumerate(dict.fromkeys(found))}
        if len(number) < n:
            at, alike = np.fromiter(map(number.__getitem__, found), np.int64, n), n
            for step in (1, 2, 4):  # numbers of 2, 4 and 8 words in a row
                pair = at[:-step] * np.int64(n + 1) + at[step:]
                in_order = np.sort(pair)
                alike = 1 + np.count_nonzero(in_order[1:] != in_order[:-1])
                if alike == len(pair):  # no run of so few words comes back, so none of 8 does
                    break
                at = np.unique(pair, return_inverse=True)[1].astype(np.int64)
            twice = np.bincount(at)[at] > 1 if alike < len(pair) else np.zeros(0, bool)
            mark = np.zeros(n + 1, np.int64)
            np.add.at(mark, np.flatnonzero(twice), 1)
            np.add.at(mark, np.flatnonzero(twice) + width, -1)
            repeat = int((np.cumsum(mark) > 0).sum())
    return n, len(b"".join(found).decode()), len(SYMBOLS.findall(text)), dup, repeat


def summed(key: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their numbers (of ones, where n is None)."""
    if n is None:
        key = np.sort(key)
    else:
        at = np.argsort(key)
        key, n = key[at], n[at]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.diff(np.append(first, len(key))) if n is None else np.add.reduceat(n, first)


def count_grams(docs: DataFrame, lang_col: str, text_col: str, order: int) -> DataFrame:
    """(lang, key, n, prose): n-grams of the highest order over all whole texts, and over those that read as prose."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        held: dict[str, list[np.ndarray]] = {}  # keys with prose or not as their last bit
        kept: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        size = 0

        def fold() -> None:
            for lang, parts in held.items():
                key, n = summed(np.concatenate(parts), None)
                if lang in kept:
                    key, n = summed(np.concatenate([kept[lang][0], key]), np.concatenate([kept[lang][1], n]))
                kept[lang] = key, n
            held.clear()

        def out(lang: str) -> Iterator[pa.RecordBatch]:
            key, n = kept.pop(lang)
            for i in range(0, len(key), 1 << 18):
                k, c = key[i : i + (1 << 18)], n[i : i + (1 << 18)]
                yield pa.record_batch([pa.array([lang] * len(k), pa.string()), pa.array(k >> 1), pa.array(c), pa.array(np.where(k & 1, c, 0))], names=["lang", "key", "n", "prose"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                prose = int(trusted(text))
                for g in slices(text, order):
                    held.setdefault(lang, []).append(g << 1 | prose)
                    size += len(g)
                    if size > 4 * SLICE:
                        fold()
                        size = 0
            if sum(len(k) for k, _ in kept.values()) > 8 * SLICE:  # bounded memory; Spark sums what is emitted
                fold()
                for lang in list(kept):
                    yield from out(lang)
        fold()
        for lang in list(kept):
            yield from out(lang)

    rows = docs.where(F.col(text_col) != "").select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(resting(count), "lang string, key long, n long, prose long").groupBy("lang", "key").agg(F.sum("n").alias("n"), F.sum("prose").alias("prose"))


@dataclass(frozen=True)
class Tables:
    """What workers need to find the model: files of sorted arrays, and of counts of counts."""

    grams: tuple[str, ...]
    heads: tuple[str, ...]
    counts: tuple[str, ...]


def fit_model(counted: DataFrame, how: Perplexity) -> tuple[Tables, list[DataFrame]]:
    """Write the sorted arrays of rows (lang, key, n, prose); the frames are for removal once scoring is done."""
    good = counted.where("prose > 0")
    top = counted.select(F.concat(F.lit("a:"), "lang").alias("part"), "key", F.col("n").alias("c"))
    top = top.unionByName(good.select(F.concat(F.lit("p:"), "lang").alias("part"), "key", F.col("prose").alias("c")))
    prose = counted.groupBy("lang").agg(F.max("prose").alias("most")).agg(F.max("most").alias("most"), F.min("most").alias("least")).first()
    if prose.most and not prose.least:
        top = top.unionByName(good.groupBy("key").agg(F.sum("prose").alias("c")).select(F.lit("q:").alias("part"), "key", "c"))
    levels, level = [], top
    for k in range(how.order, 0, -1):
        levels.append((k, level))
        if k > 1:  # continuation counts: how many symbols stand before each n-gram
            low = F.col("key").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1))
            level = written(level.select("part", low.alias("key")).groupBy("part", "key").agg(F.count("*").alias("c")), f"order{k - 1}")
    place = lambda k: F.xxhash64(F.concat("part", F.lit(f":{k}")), "key").alias("hash")
    of = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    alike = [of(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]
    kinds: dict[str, DataFrame] = {}
    for k, level in levels:
        heads = level.groupBy("part", F.shiftright("key", BITS).alias("key")).agg(F.sum("c").alias("total"), *alike[:2], of(F.col("c") > 2).alias("n3"))
        new = {
            "grams": level.select(place(k), F.col("c").cast("float").alias("c")),
            "heads": heads.select(place(k), *(F.col(x).cast("float").alias(x) for x in ("total", "n1", "n2", "n3"))),
            "alike": level.groupBy("part").agg(*alike).withColumn("k", F.lit(k)),
        }
        kinds = {x: kinds[x].unionByName(f) if x in kinds else f for x, f in new.items()}
    frames = [*(sorted_table(kinds[x], x) for x in ("grams", "heads")), written(kinds["alike"], "alike")]
    removed(*(level for _, level in levels[1:]))
    return Tables(*(tuple(sorted(f.inputFiles())) for f in frames)), frames


def discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and more, from counts of counts."""
    n1, n2, n3, n4 = (float(max(1, n)) for n in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    return np.clip([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0.0, 0.1, 0.2, 0.3], [0.0, 0.95, 1.9, 2.85])


class Model:
    """Probabilities from the sorted arrays, as a worker sees them."""

    def __init__(self, tables: Tables, how: Perplexity) -> None:
        self.how = how
        self.grams, self.heads = SortedArrays(tables.grams, how.held_grams), SortedArrays(tables.heads, how.held_heads)
        self.discount: dict[tuple[str, int], np.ndarray] = {}
        for f in tables.counts:
            for r in opened(f).read().to_pylist():
                self.discount[r["part"], r["k"]] = discounts(r["n1"], r["n2"], r["n3"], r["n4"])
        self.memo: OrderedDict[str, tuple[np.ndarray, np.ndarray]] = OrderedDict()

    def probability(self, part: str, g: np.ndarray) -> np.ndarray:
        """Of the last symbol of each packed n-gram, from the lowest order up: what an order does not give goes to the one below."""
        p = np.full(len(g), 1.0 / (1 << BITS))
        for k in range(1, self.how.order + 1):
            key, back = np.unique(g & ((1 << BITS * k) - 1), return_inverse=True)
            d, name = self.discount[part, k], f"{part}:{k}"
            ctx, of = np.unique(key >> BITS, return_inverse=True)
            total, n1, n2, n3 = self.heads.find(hashes(name, ctx)).astype(np.float64).T
            known = total > 0
            total = np.maximum(total, 1.0)
            below = np.where(known, (d[1] * n1 + d[2] * n2 + d[3] * n3) / total, 1.0)
            seen = np.flatnonzero(known[of])  # an n-gram is there only if its context is
            own = np.zeros(len(key))
            c = self.grams.find(hashes(name, key[seen]))[:, 0].astype(np.float64)
            own[seen] = (c - d[np.minimum(c, 3).astype(int)]) / total[of[seen]]
            p = own[back] + below[of][back] * p
        return p

    def logs(self, lang: str, g: np.ndarray) -> np.ndarray:
        """Log-probabilities of both models' mixture for distinct n-grams."""
        p = self.probability(f"a:{lang}", g)
        prose = next((x for x in (f"p:{lang}", "q:") if (x, 1) in self.discount), None)
        if prose:
            p = (1 - self.how.rest) * self.probability(prose, g) + self.how.rest * p
        return np.log(p)

    def scores(self, lang: str, g: np.ndarray) -> np.ndarray:
        """logs() of any n-grams, those met before from memory."""
        if lang not in self.memo:
            self.memo[lang] = np.full(1 << self.how.memo_bits, -1, np.int64), np.zeros(1 << self.how.memo_bits)
            while len(self.memo) > self.how.memo_languages:
                self.memo.popitem(last=False)
        self.memo.move_to_end(lang)
        key, value = self.memo[lang]
        slot = ((g.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.how.memo_bits)).view(np.int64)
        out, miss = value[slot], np.flatnonzero(key[slot] != g)
        if len(miss):
            new, back = np.unique(g[miss], return_inverse=True)
            logs = self.logs(lang, new)
            out[miss] = logs[back]
            slot = ((new.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.how.memo_bits)).view(np.int64)
            key[slot] = new
            value[slot[key[slot] == new]] = logs[key[slot] == new]  # of several new ones in a slot, the one that stands there
        return out

    def perplexities(self, langs: list[str], texts: list[str | None]) -> list[float | None]:
        """exp of the mean negative log-probability of a character of each text; None for an empty one."""
        total, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        held: dict[str, list[tuple[int, np.ndarray]]] = {}
        size = 0

        def settle() -> None:
            for lang, parts in held.items():
                s = self.scores(lang, np.concatenate([g for _, g in parts]))
                at = 0
                for i, g in parts:
                    total[i] += s[at : at + len(g)].sum()
                    n[i] += len(g)
                    at += len(g)
            held.clear()

        for i, (lang, text) in enumerate(zip(langs, texts, strict=True)):
            if text and (f"a:{lang}", 1) in self.discount:
                for g in slices(text, self.how.order):
                    held.setdefault(lang, []).append((i, g))
                    size += len(g)
                    if size > SLICE:
                        settle()
                        size = 0
        settle()
        return [float(np.exp(-t / k)) if k else None for t, k in zip(total, n, strict=True)]


def model_of(tables: Tables, how: Perplexity) -> Model:
    """The model that this worker scored with last, kept for its next task."""
    return held(("model", tables, how), lambda: Model(tables, how))


def scored(docs: DataFrame, tables: Tables, how: Perplexity, id_col: str, lang_col: str, text_col: str) -> DataFrame:
    """(id, lang, base counts, perplexity) of each row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(tables, how)
        for b in batches:
            lang, text = b.column(1).to_pylist(), b.column(2).to_pylist()
            base = np.array([base_counts(t) for t in text], np.int64).reshape(len(text), 5)
            yield pa.record_batch([b.column(0), b.column(1), *(pa.array(base[:, i]) for i in range(5)), pa.array(model.perplexities(lang, text), pa.float64())], names=["id", "lang", *COUNTS, "perplexity"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(resting(score), f"id {dict(rows.dtypes)['id']}, lang string, {', '.join(f'{n} long' for n in COUNTS)}, perplexity double")


def bands_of(rows: DataFrame, how: Perplexity) -> DataFrame:
    """(lang, low, high) of rows (lang, perplexity): exact quartiles of rounded logarithms.

    Tasks count the rounded values of each language, some ten thousand at most, and send these counts.
    """
    step = F.round(F.log("perplexity") * how.grain).cast("int")
    q = lambda i: F.col("q")[i] / how.grain
    wide = F.greatest(how.band * (q(2) - q(0)), F.lit(how.floor))
    return rows.groupBy("lang").agg(F.percentile(step, [0.25, 0.5, 0.75]).alias("q")).select("lang", F.exp(q(1) - wide).alias("low"), F.exp(q(1) + wide).alias("high"))


def quality(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", how: Perplexity = Perplexity()) -> DataFrame:
    """Verdicts of every row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, perplexity, low, high."""
    counted = written(count_grams(docs, lang_col, text_col, how.order), "counted")
    tables, frames = fit_model(counted, how)
    rows = written(scored(docs, tables, how, id_col, lang_col, text_col), "scored")
    removed(counted, *frames)
    rows = rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    bands = written(bands_of(rows.where(~F.col("base_failed") & F.col("perplexity").isNotNull()), how), "bands")
    inside = F.col("perplexity").between(F.col("low"), F.col("high"))
    return rows.join(bands, "lang", "left").select(
        F.col("id").alias(id_col), *COUNTS, "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"), "perplexity", "low", "high"
    )
