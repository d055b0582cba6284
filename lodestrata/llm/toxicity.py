"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: I (insult), T (threat), G (someone
addressed or spoken of), N (negation), R (reported speech), W (any other). Insult words and
word stems, with their weights, are learnt from labels: log-odds of the share of
toxic and of other documents that hold them. Five weighted transducers read one tape and write the next:

* reported speech marks insults and threats that follow a verb of saying;
* negation marks those just after a negation;
* target marks those just after somebody is named;
* threat turns somebody named just after a threat into an attack, with the threat's marks;
* insult weighs: marked insults, aimed threats and attacks.

They are composed into one machine, so each word is read once; the weight of a clause is that of the path that the machine
takes over it. So an insult or threat that is denied or quoted weighs less, one aimed at somebody weighs more, and a threat weighs
only with a target. A document's score is a logistic function, fitted on labels, of the
number of matched clauses, their greatest weight and their total.

Labels are learnt from a bounded sample: at most ``max_labelled`` labelled rows, those of least hash,
one for each text opening and one for each text ending, so that copies count once.

Null or empty texts match nothing and get the score of no match. Without labels of
both kinds nothing is learnt and every score is 0. Very long texts are scored whole, clause by
clause. Repeated rows score alike, labels that disagree count as toxic, a null id is held out;
extra columns are not read.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import written

# Closed classes of words.
THREATS = frozenset("kill killed killing murder hurt destroy beat stab shoot burn die hang töten umbringen schlagen sterben tuer tuerai frapper mourir matar mataré golpear morir".split())
TARGETS = frozenset("you your yours u he she they him her them his their these those people all du dich dir ihr euch sie er tu te toi vous il elle ils elles vosotros usted ustedes él ella ellos ellas".split())
NEGATIONS = frozenset("not no never without isn't aren't wasn't don't nicht kein keine nie ohne pas jamais sans ni nunca sin".split())
REPORTS = frozenset("said says wrote writes quoted quotes claimed claims called reported sagte sagt schrieb zitierte dit disait écrit dijo dice escribió".split())
SYMBOLS = "ITGNRW"
EDGE = re.compile(r"^\W+|\W+$")
CLAUSE_END = (".", "!", "?", ";", ":", ",", "…")


@dataclass(frozen=True)
class Grammar:
    """Weights of the five transducers, and how words are learnt."""

    target: float = 0.5
    threat: float = 3.0
    denied: float = 0.5
    reported: float = 0.6
    reach: int = 3
    stems: tuple[int, ...] = (4, 5, 6)
    max_labelled: int = 60_000
    min_support: int = 4
    min_odds: float = 3.0


#: Symbols of the inner tapes: a kind, A being an attack, and marks: reported, denied, aimed.
KINDS = SYMBOLS + "A"
TAPE = [k + "".join(m) for k in KINDS for n in range(4) for m in itertools.combinations("rda", n)]
Step = tuple[int, str, float, float]  # next state, symbol written, factor on the word's weight, added weight


def marked(symbol: str, *marks: str) -> str:
    return symbol[0] + "".join(m for m in "rda" if m in symbol[1:] or m in marks)


class Transducer:
    """Deterministic: delta[state][symbol read] is a Step. State 0 begins."""

    def __init__(self, delta: list[dict[str, Step]]) -> None:
        self.delta = delta

    def compose(self, other: Transducer) -> Transducer:
        """What this one writes the other reads; factors multiply, added weights add; only reachable pairs of states."""
        number = {(0, 0): 0}
        todo, delta = [(0, 0)], []
        while len(delta) < len(todo):
            a, b = todo[len(delta)]
            row = {}
            for symbol, (x, tape, f, w) in self.delta[a].items():
                y, out, g, v = other.delta[b][tape]
                if (x, y) not in number:
                    number[x, y] = len(todo)
                    todo.append((x, y))
                row[symbol] = number[x, y], out, f * g, w + v
            delta.append(row)
        return Transducer(delta)

    def run(self, tape: list[str]) -> list[tuple[str, float, float]]:
        """(symbol written, factor, added weight) of each symbol read."""
        state, out = 0, []
        for symbol in tape:
            state, *rest = self.delta[state][symbol]
            out.append(tuple(rest))
        return out

    def weigh(self, clause: list[tuple[str, float]]) -> float:
        state, total = 0, 0.0
        for symbol, weight in clause:
            state, _, factor, more = self.delta[state][symbol]
            total += factor * weight + more
        return total


def within_reach(reach: int, opens: str, mark: str) -> Transducer:
    """Marks insults and threats up to ``reach`` words after one of kind ``opens``."""
    row = lambda k: {s: (reach if s[0] == opens else max(0, k - 1), marked(s, mark) if k and s[0] in "IT" else s, 1.0, 0.0) for s in TAPE}
    return Transducer([row(k) for k in range(reach + 1)])


def cascade(how: Grammar) -> list[Transducer]:
    """Reported speech, negation, target, threat, insult; the first reads SYMBOLS alone."""
    told = [{s: (int(k or s == "R"), marked(s, "r") if k and s in "IT" else s, 1.0, 0.0) for s in SYMBOLS} for k in (0, 1)]  # to the clause's end
    negation, target = within_reach(how.reach, "N", "d"), within_reach(how.reach, "G", "a")
    # states of threat: none, or the last threat's marks and how far it still reaches
    states = [("", 0)] + [(m, k) for m in ("", "r", "d", "rd") for k in range(1, how.reach + 1)]
    at = {x: i for i, x in enumerate(states)}
    attack = []
    for marks, k in states:
        row = {}
        for s in TAPE:
            if s[0] == "T":
                row[s] = at[s[1:].replace("a", ""), how.reach], s, 1.0, 0.0
            elif s[0] == "G" and k:
                row[s] = at[marks, k - 1] if k > 1 else 0, marked("A", *marks), 1.0, 0.0
            else:
                row[s] = at[marks, k - 1] if k > 1 else 0, s, 1.0, 0.0
        attack.append(row)
    weights = {}
    for s in TAPE:
        factor = (how.reported if "r" in s else 1.0) * (how.denied if "d" in s else 1.0)
        aimed = "a" in s
        more = {"I": how.target * aimed, "T": how.threat * aimed, "A": how.threat}.get(s[0], 0.0)
        weights[s] = 0, s, factor, factor * more
    return [Transducer(told), negation, target, Transducer(attack), Transducer([weights])]


def grammar(how: Grammar) -> Transducer:
    """The composition of the cascade."""
    machine, *rest = cascade(how)
    for t in rest:
        machine = machine.compose(t)
    return machine


def bare(token: str) -> str:
    return EDGE.sub("", token.casefold())


def features(word: str, stems: tuple[int, ...]) -> list[str]:
    """The word itself, and its stems (marked by a trailing dash)."""
    return [word] + [word[:n] + "-" for n in stems if len(word) > n]


@dataclass
class Model:
    how: Grammar
    weights: dict[str, float]
    fit: tuple[float, ...] | None = None
    seen: dict[str, tuple[str, float]] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {"how": self.how, "weights": self.weights, "fit": self.fit, "seen": {}}

    def symbol(self, token: str) -> tuple[str, float]:
        word = bare(token)
        best = max((self.weights.get(f, 0.0) for f in features(word, self.how.stems)), default=0.0) if word else 0.0
        if best > 0:
            return "I", best
        for symbol, words in (("T", THREATS), ("N", NEGATIONS), ("R", REPORTS), ("G", TARGETS)):
            if word in words:
                return symbol, 0.0
        return "W", 0.0

    def clauses(self, text: str | None) -> tuple[int, float, float]:
        """(matched clauses, greatest weight, total weight) of a whole text."""
        if not text:
            return 0, 0.0, 0.0
        if not hasattr(self, "machine"):
            self.machine = grammar(self.how)
        n, top, total, seen = 0, 0.0, 0.0, self.seen
        if len(seen) > 500_000:
            seen.clear()
        for line in text.split("\n"):
            tokens = line.split()
            got = list(map(seen.get, tokens))
            if None in got:
                for t in tokens:
                    if t not in seen:
                        seen[t] = self.symbol(t)
                got = list(map(seen.__getitem__, tokens))
            if not any(s in "IT" for s, _ in got):
                continue
            clause: list[tuple[str, float]] = []
            for t, s in itertools.chain(zip(tokens, got, strict=True), (("", None),)):
                if s:
                    clause.append(s)
                if s is None or t.endswith(CLAUSE_END):
                    w = self.machine.weigh(clause)
                    if w > 0:
                        n, top, total = n + 1, max(top, w), total + w
                    clause = []
        return n, top, total

    def score(self, text: str | None) -> float:
        if self.fit is None:
            return 0.0
        z = float(np.dot(self.fit, inputs(*self.clauses(text))))
        return 1.0 / (1.0 + np.exp(-min(30.0, max(-30.0, z))))


def inputs(n: int, top: float, total: float) -> list[float]:
    return [1.0, np.log1p(n), top, np.log1p(total)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps for logistic regression with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(i: int | None) -> bool:
    """Never learnt from: a fifth of the ids, and null ones."""
    return i is None or zlib.crc32(str(i).encode()) % 5 == 0


def ends_of(docs: DataFrame, taught: DataFrame) -> DataFrame:
    """(id, y, head, tail) of each text of docs (id, text) that taught (id, y) labels: hashes of its opening and its ending. Texts don't move to labels."""
    first = lambda c: F.xxhash64(F.slice(F.split(c, r"\s+", 9), 1, 8))
    text = F.trim("text")
    return docs.where(F.col("text").isNotNull()).select("id", first(text).alias("head"), first(F.reverse(text)).alias("tail")).join(taught.where(F.col("y").isNotNull()), "id")


def sample(docs: DataFrame, taught: DataFrame, how: Grammar) -> DataFrame:
    """(text, y) of at most how.max_labelled rows of docs (id, text) that taught (id, y; distinct ids) labels, copies of openings and endings left out.

    Only the texts of the sample move; its ids, as many at most, go to all tasks.
    """
    some = ends_of(docs, taught).withColumn("key", F.xxhash64(F.col("id").cast("string"))).orderBy("key", "id").limit(how.max_labelled)
    for end in ("head", "tail"):
        some = some.groupBy(end).agg(F.min_by(F.struct("id", "y", "key", "head", "tail"), F.struct("key", "id")).alias("x")).select("x.*")
    chosen = written(some.groupBy("id").agg(F.max("y").alias("y")), "chosen")
    return docs.where(F.col("text").isNotNull()).join(F.broadcast(chosen), "id").dropDuplicates(["id"]).select("text", "y")


def learn(labelled: DataFrame, how: Grammar = Grammar()) -> Model:
    """A model from rows (id, text, y), y 1 for toxic."""
    return learn_labels(labelled.select("id", "text"), labelled.groupBy("id").agg(F.max("y").alias("y")), how)


def learn_labels(docs: DataFrame, taught: DataFrame, how: Grammar = Grammar()) -> Model:
    """A model from texts (id, text) and the labels (id, y) of some, y 1 for toxic, one an id."""
    rows = written(sample(docs, taught, how), "labelled")
    size = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    if not bad or not good:
        return Model(how, {})
    stems = how.stems

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(counts)), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1))], names=["f", "good", "bad"])

        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for f in {f for w in set(map(bare, text.split())) if w for f in features(w, stems)}:
                    counts.setdefault(f, [0, 0])[y] += 1
            if len(counts) > 1_000_000:
                yield out()
                counts.clear()
        if counts:
            yield out()

    summed = rows.mapInArrow(count, "f string, good long, bad long").groupBy("f").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    # the sample bounds what comes to the driver
    kept = summed.where(F.col("bad") >= how.min_support).select("f", odds.alias("w")).where(F.col("w") >= how.min_odds)
    model = Model(how, {r.f: float(r.w) for r in kept.orderBy("f").collect()})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.clauses(t) for t in b.column(0).to_pylist()]
            yield pa.record_batch([b.column(1).cast(pa.int32()), *(pa.array([g[k] for g in got], pa.float64()) for k in range(3))], names=["y", "n", "top", "total"])

    got = rows.mapInArrow(measure, "y int, n double, top double, total double").toPandas()
    x = np.array([inputs(*r) for r in got[["n", "top", "total"]].to_numpy()])
    model.fit = tuple(float(v) for v in logistic(x, got["y"].to_numpy(float)))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted, n_clauses) of each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            n = [m.clauses(t)[0] for t in texts]
            s = [m.score(t) if k else m.score(None) for k, t in zip(n, texts, strict=True)]
            out = [held_out(i) for i in ids.to_pylist()]
            yield pa.record_batch([ids, pa.array(out), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32()), pa.array(n, pa.int64())], names=names)

    names = [id_col, "held_out", "score", "predicted", "n_clauses"]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, held_out boolean, score double, predicted int, n_clauses long")


def toxicity(docs: DataFrame, labels: DataFrame, how: Grammar = Grammar()) -> DataFrame:
    """Score docs (doc_id, text) with what labels (doc_id, toxic) teach, outside the held-out fifth."""
    taught = labels.where(F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    taught = taught.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    return score(docs, learn_labels(docs.select(F.col("doc_id").alias("id"), "text"), taught, how))
