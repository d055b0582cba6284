"""Search, packing, mixing, toxicity, quality, url filter and HTML extraction."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import mixing, quality as Q, toxicity as X
from lodestrata.llm.html_extract import Block, Cut, Element, Flow, blocks_of, distance, extract, label, log_odds, main_text
from lodestrata.llm.packing import Encoder, Packing, pack, rest, windows
from lodestrata.llm.topk import TopK, integer_vectors, products, top_k
from lodestrata.llm.url_filter import Mining, filter_urls, tokens

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


# --- search


@pytest.mark.parametrize("how", [TopK(k=5, bucket=16, queries=4), TopK(k=5, bucket=16, queries=4, coordinate=0.0), TopK(k=50, bucket=7, queries=64, coordinate=2.0)])
def test_top_k(spark, how):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8) * rng.choice([0.1, 1, 5])]) for i in range(120)]
    rows += [(200 + i, [1.0] * 8) for i in range(40)] + [(300, None), (301, [float("nan")] * 8), (302, [None] + [1.0] * 7), (303, [float("inf")] * 8), (304, [0.0] * 8), (400, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, e array<double>").withColumn("score", F.lit("clash"))
    df = df.select("id", integer_vectors(F.col("e"), 64.0).alias("v"), "score").where("v IS NOT NULL")
    got = {}
    for r in top_k(df.select("id", "v"), F.col("id") % 20 == 0, how).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    vec = {i: np.floor(64 * np.array(e)).astype(np.int64) for i, e in rows if e is not None and None not in e and np.isfinite(e).all()}
    for q in (i for i in vec if i % 20 == 0):
        best = sorted((-int(vec[q] @ v), i) for i, v in vec.items() if i != q and len(v) == len(vec[q]))[: how.k]
        assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)], q
    assert top_k(df.select("id", "v").limit(0), F.col("id") % 20 == 0, how).count() == 0


@pytest.mark.parametrize("top", [1, 100, 10**5, 10**8, 2**31, 10**12])
def test_products_are_exact(top):
    rng = np.random.default_rng(top)
    q, p = (rng.integers(-top, top + 1, (n, 5)) for n in (7, 11))
    want = [[max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(x, y)))) for y in p] for x in q]
    assert products(q.astype(float), p.astype(float)).tolist() == want
    assert products(np.zeros((0, 3)), np.ones((2, 3))).shape == (0, 2)


def test_top_k_of_large_numbers_and_nulls(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-(2**30), 2**30, 4)]) for i in range(60)] + [(i, rows_of) for i, rows_of in ((100, [2.0**29 + 1] * 4), (101, [2.0**29] * 4), (None, [1.0] * 4), (102, None), (103, []))]
    got = {}
    for r in top_k(spark.createDataFrame(rows, "id long, v array<double>"), F.col("id") % 20 == 0, TopK(k=7, bucket=16, queries=2, share=2)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    vec = {i: [int(x) for x in v] for i, v in rows if i is not None and v}
    for q in (i for i in vec if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(vec[q], v)), i) for i, v in vec.items() if i != q)[:7]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


# --- packing


def test_windows_are_the_cheapest():
    rng = random.Random(4)
    for _ in range(60):
        size = 64
        pos = [0]
        for _ in range(rng.randint(1, 11)):
            pos.append(pos[-1] + rng.randint(1, 40))
        pen = [0.0] + [rng.choice([0.0, 3.0]) for _ in pos[1:]]
        cost = lambda n: 0 if n & (n - 1) == 0 and n >= 32 else size - n
        best = [0.0] + [float("inf")] * (len(pos) - 1)
        for j in range(1, len(pos)):
            best[j] = min((best[i] + cost(pos[j] - pos[i]) for i in range(j) if pos[j] - pos[i] <= size), default=float("inf")) + pen[j]
        cuts = [0, *windows(pos, pen, size)]
        assert sum(cost(pos[b] - pos[a]) + pen[b] for a, b in zip(cuts, cuts[1:])) == best[-1]


def test_rest():
    how = Packing()
    assert rest(1024, how) == [1024] and rest(2047, how) == [2047] and rest(1025, how) == [1024, 1] and sum(rest(1000, how)) == 1000


@pytest.mark.parametrize("how", [Packing(), Packing(size=64, run=200), Packing(size=16, run=1, step=4)])
def test_pack(spark, how):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    rows = [None, "", " ", "a  b \n\tc. D! ", "x<|endoftext|> y", "word " * 400, "nospace" * 300, "É. ß? " * 50, "a b.\nc d.", "same", "same"]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(rows)], "doc_id long, text string, length string").repartition(2)
    out = pack(df, TOKENIZER, how=how, with_ids=True).collect()
    for i, t in enumerate(rows):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], np.uint32)
        mine = sorted((r for r in out if r.doc_id == i), key=lambda r: r.start)
        assert [x for r in mine for x in r.ids] == ids.tolist()
        at = 0
        for r in mine:
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
    of = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == of.get(r.sequence_id, 0)
        of[r.sequence_id] = r.offset + r.length
    assert max(of.values()) <= how.size
    assert pack(df.limit(0), TOKENIZER).count() == 0


def test_encoder_equals_the_tokenizer():
    e = Encoder(TOKENIZER, 50)
    rng = random.Random(6)
    for _ in range(300):
        t = "".join(rng.choice(["a", "B", " ", "  ", "\n", ".", "'s", "9", "é", "　", "\t", "😀", "the"]) for _ in range(rng.randint(1, 30)))
        assert e(t)[0].tolist() == e.encode(t).tolist(), repr(t)


def test_texts_encoded_together_equal_the_tokenizer(monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["a", "Bc", "é", ".", "'s", "9", "😀", "\n", "!"]) for _ in range(rng.randint(1, 4)))
    texts = [None, "", " ", "one", "one", "a.", "x<|endoftext|> y", "a  b", " c d", "e.\tf g"] + [" ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(200)]
    for together, fast in ((1, True), (300, True), (1 << 20, True), (1 << 20, False)):
        monkeypatch.setattr("lodestrata.llm.packing.TOGETHER", together)
        e, alone = Encoder(TOKENIZER, 50), Encoder(TOKENIZER, 50)
        if not fast:
            e.n_bytes[:] = 0  # where the ids' bytes don't tell, chunks are encoded one by one
        got = list(e.many(pa.array(texts)))
        assert len(got) == len(texts)
        for t, (ids, ends) in zip(texts, got, strict=True):
            assert ids.tolist() == (alone.encode(t).tolist() if t else []) and ends.tolist() == alone(t)[1].tolist(), repr(t)


def test_new_chunks_take_one_call():
    """The check tool: 412 CPU seconds a GB, budget 400, with a call for each new chunk and a look-up for each chunk."""
    calls = []

    class Counting:
        def encode_ordinary(self, text):
            calls.append(text)
            return e.fast_before.encode_ordinary(text)

    e = Encoder(TOKENIZER, 1 << 20)
    e.fast_before, e.fast = e.fast, Counting()
    texts = [" ".join(f"w{i * j}" for j in range(50)) for i in range(20)]
    ids = [ids.tolist() for ids, _ in e.many(pa.array(texts))]
    assert len(calls) == 1 + len(texts)  # and one for the start of each text, before which there is no space
    assert ids == [e.encode(t).tolist() for t in texts]


# --- mixing


def test_targets():
    t = mixing.targets_of({"=a": 10, "=b": 1000, "=c": 1000, "": 100})
    assert sum(t.values()) == pytest.approx(2110) and t["=a"] == 30 and t[""] <= 300 and t["=b"] == pytest.approx(2 * t["=c"]) or t[""] == 300
    assert mixing.targets_of({}) == {} and mixing.targets_of({"=a": 0}) == {"=a": 0.0}


def test_split_tree_deals_exactly():
    q = np.array([5, 900, 0, 77])
    out = mixing.split_tree(q, 7, 1)
    assert (out.sum(axis=1) == q).all() and out.sum(axis=0).max() - out.sum(axis=0).min() <= 1
    assert (out == mixing.split_tree(q, 7, 1)).all()


@pytest.mark.parametrize("how", [{}, {"blocks": 32, "shards": 5}, {"block_words": 3, "shard_words": 100}])
def test_mixing(spark, how):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["a", "b", "c", "d", None])) for i in range(800)] + [(900, None, "a"), (901, "", None)]
    df = spark.createDataFrame([(i, t, s, "x") for i, t, s in rows], "doc_id long, text string, source string, size string")
    got = [tuple(r) for r in mixing.mixing_digest(df, **how).collect()]
    assert sorted(got) == sorted(tuple(r) for r in mixing.mixing_digest(df.repartition(7), **how).collect())
    sizes = {i: len((t or "").split()) for i, t, _ in rows}
    by = {}
    for i, _, s in rows:
        by[mixing_key(s)] = by.get(mixing_key(s), 0) + sizes[i]
    want = mixing.targets_of(by)
    source = {i: mixing_key(s) for i, _, s in rows}
    taken = {}
    for i, size, source_size, target, t, shards in got:
        assert size == sizes[i] and source_size == by[source[i]] and target == pytest.approx(want[source[i]]) and t == size * len(shards) <= 3 * size
        taken[source[i]] = taken.get(source[i], 0) + t
    for s, n in taken.items():
        assert abs(n - want[s]) <= 15  # half of the longest document
    # what a shard holds is what the tree dealt it
    mixed = mixing.mix(df, **how)
    placed = {}
    for r in mixed.collect():
        placed.setdefault(r.doc_id, []).append(r.mix_shard)
    assert {i: sorted(x) for i, x in placed.items()} == {i: list(shards) for i, _, _, _, _, shards in got if shards}
    assert set(df.columns) < set(mixed.columns)
    assert mixing.mixing_digest(df.limit(0), **how).count() == 0


def test_the_tree_deals_all_draws(spark):
    rows = [(i, "w " * (1 + i % 9), f"s{i % 4}") for i in range(500)]
    plan = mixing.mixing_plan(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    draws = plan.draws.collect()
    names = sorted({d.src for d in draws})
    quotas = np.array([sum(d.src == n for d in draws) for n in names])
    dealt = mixing.split_tree(quotas, 64, 17)
    assert [[sum(d.src == n and d.shard == j for d in draws) for j in range(64)] for n in names] == dealt.tolist()
    per_shard = dealt.sum(axis=0)
    assert per_shard.max() - per_shard.min() <= 1 and len({(d.src, d.block, d["pass"]) for d in draws}) == len(draws)


def test_mixing_comes_near_small_targets_with_long_documents(spark):
    rows = [(i, "w " * n, "small") for i, n in enumerate([5184, 900, 400, 300, 200, 60, 30, 15, 5])] + [(100 + i, "w " * 500, "large") for i in range(400)]
    out = mixing.mixing_digest(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for key in ("small", "large"):
        of = [r for r in out if (r.doc_id < 100) == (key == "small")]
        assert abs(sum(r.taken for r in of) - of[0].target) <= (5 if key == "small" else 250)


def test_fitting():
    rng = random.Random(3)
    for _ in range(300):
        words, room = np.array([rng.randint(0, 20) for _ in range(rng.randint(0, 12))], np.int64), rng.random() * 60
        left, want = room, []
        for w in words:
            want.append(w <= left)
            left -= w * want[-1]
        assert mixing.fitting(words, room).tolist() == want
        assert abs(room - words[mixing.nearest(words, room)].sum()) <= left + 1e-9


def test_mixing_of_clashing_names_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b", "x"), (None, "a b", "x"), (1, "c", None), (1, "c d", None), (2, "e", "y")] * 3
    df = spark.createDataFrame([(i, t, s, 1, 2, 3, 4, 5, 6) for i, t, s in rows], "doc_id long, text string, source string, mix_shard int, upto int, mix_src int, block int, src int, mix_hash int")
    mixed = mixing.mix(df)
    assert mixed.columns == [*df.columns, "mix_pass", "mix_shard_", "mix_key"] and {tuple(r)[3:9] for r in mixed.collect()} == {(1, 2, 3, 4, 5, 6)}
    digest = mixing.mixing_digest(df).collect()
    assert len(digest) == len(rows) and mixed.count() == sum(len(r.shards) for r in digest)


def mixing_key(s):
    return "" if s is None else f"={s}"


# --- toxicity


def test_grammar():
    m = X.Model(X.Grammar(), {"idiot": 4.0, "vequ-": 3.0}, (-4.0, 1.0, 1.0, 0.5))
    w = lambda t: m.clauses(t)[2]
    assert w("an idiot") == 4.0 < w("you idiot") and w("not an idiot") == 2.0 and w('he said the idiot') < 4.5
    assert w("kill you") > 0 == w("kill time") and w("Vequances!") == 3.0 and m.clauses("an idiot. fine day, an idiot")[0] == 2
    assert m.clauses(None) == m.clauses("") == (0, 0.0, 0.0) and 0 <= m.score("") < 0.5 < m.score("idiot idiot idiot idiot")


def test_composition_is_the_cascade_of_tapes():
    how, rng = X.Grammar(), random.Random(13)
    machines, whole = X.cascade(how), X.grammar(how)
    for _ in range(500):
        clause = [(rng.choice(X.SYMBOLS), rng.random()) for _ in range(rng.randint(1, 12))]
        tape, factor, more = [s for s, _ in clause], [1.0] * len(clause), [0.0] * len(clause)
        for m in machines:
            out = m.run(tape)
            tape = [o[0] for o in out]
            factor, more = [f * o[1] for f, o in zip(factor, out)], [a + o[2] for a, o in zip(more, out)]
        assert [o[0] for o in whole.run([s for s, _ in clause])] == tape
        assert whole.weigh(clause) == pytest.approx(sum(f * w + a for (_, w), f, a in zip(clause, factor, more)))


def test_tapes():
    tape = lambda s: [o[0] for o in X.grammar(X.Grammar()).run(list(s))]
    assert tape("GWI") == ["G", "W", "Ia"] and tape("GWWWI")[-1] == "I" and tape("NI")[-1] == "Id" and tape("RWWWWI")[-1] == "Ir"
    assert tape("TG") == ["T", "A"] and tape("NTG") == ["N", "Td", "Ad"] and tape("TWWWG")[-1] == "G" and tape("RGT") == ["R", "G", "Tra"]
    w = lambda s: X.grammar(X.Grammar()).weigh([(c, 2.0 * (c == "I")) for c in s])
    assert w("I") == 2 < w("GI") and w("TW") == 0 < w("RTG") < w("TG") and w("NTG") < w("TG") and w("G") == 0


def test_labels_of_ties_null_ids_and_repeated_rows(spark):
    rng = random.Random(19)
    text = lambda bad: " ".join([f"w{rng.randrange(300)}" for _ in range(30)] + ["zarg blurk"] * bad)
    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "n") for i, t, _ in rows] + [(1, rows[1][1], "n"), (None, "you zarg blurk", "n"), (None, None, "n")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, 5) for i, _, y in rows] + [(1, 1, 5), (None, 1, 5), (2, None, 5)], "doc_id long, toxic int, y int")
    out = X.toxicity(docs, labels).collect()
    assert len(out) == 403 and len({r.score for r in out if r.doc_id == 1}) == 1
    assert all(r.held_out for r in out if r.doc_id is None) and sorted(r.predicted for r in out if r.doc_id is None) == [0, 1]


def test_toxicity_learns(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        w = [word() for _ in range(40)] + (["zarg", "blurk", "zarg"] if bad else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(900, None), (901, ""), (902, "you zarg blurk zarg")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, toxic int")
    out = {r.doc_id: r for r in X.toxicity(docs, spark.createDataFrame(labels + [(5000, None)], "doc_id long, toxic int"), X.Grammar(min_support=3)).collect()}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    held = [(out[i].predicted, y) for i, y in labels if out[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.97 and out[902].predicted == 1 and out[900].predicted == 0
    assert X.toxicity(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_only_the_texts_of_the_sample_move(spark, tmp_path):
    rng = random.Random(23)
    word = lambda: rng.choice(["ab", "cd", "é"])
    rows = [(i, "".join(word() + rng.choice([" ", "\n", "  "]) for _ in range(rng.choice((3, 9, 30))))) for i in range(300)] + [(300, None), (301, ""), (302, " ")]
    for name, data, schema in (("docs", rows, "id long, text string"), ("taught", [(i, i % 3 and i % 2) for i in range(303)] + [(303, None)], "id long, y int")):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / name))
    docs, taught = (spark.read.parquet(str(tmp_path / x)) for x in ("docs", "taught"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frames = X.ends_of(docs, taught), X.sample(docs, taught, X.Grammar(max_labelled=200))
        for f in frames:
            plan = f._sc._jvm.PythonSQLUtils.explainString(f._jdf.queryExecution(), "formatted")
            assert "Exchange" in plan and not re.search(r"Exchange\nInput \[\d+\]: \[[^]]*\btext#", plan), plan
        ends = [tuple(r) for r in frames[0].select("id", "head", "tail").collect()]
        got = sorted(tuple(r) for r in frames[1].collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    parts = {i: re.split(r"\s+", t.strip(" ")) for i, t in rows if t is not None}
    for k, of in ((1, lambda w: tuple(w[:8])), (2, lambda w: tuple(w[::-1][:8]))):
        assert len({(r[k], of(parts[r[0]])) for r in ends}) == len({r[k] for r in ends}) == len({of(parts[r[0]]) for r in ends})
    key = {r.id: r.k for r in spark.range(303).selectExpr("id", "xxhash64(cast(id as string)) as k").collect()}
    left = sorted(parts, key=lambda i: (key[i], i))[:200]
    for of in (lambda w: tuple(w[:8]), lambda w: tuple(w[::-1][:8])):
        left = list({of(parts[i]): i for i in reversed(left)}.values())
        left.sort(key=lambda i: (key[i], i))
    assert got == sorted((rows[i][1], i % 3 and i % 2) for i in left)


def test_rare_insults_are_learnt(spark):
    rows = [(i, f"zarg blurk w{i % 50} and then some more", 1) for i in range(1000)] + [(5000 + i, f"w{i % 50} vex{'abcdef'[i]}x quolm is here", 1) for i in range(6)]
    rows += [(9000 + i, f"w{i % 50} x{i} plain and fine words", 0) for i in range(3000)]
    rows = [(i, f"a{i} b{i} {t} c{i} d{i}", y) for i, t, y in rows]
    m = X.learn(spark.createDataFrame(rows, "id long, text string, y int"))
    assert "quolm" in m.weights and m.clauses("you quolm")[0] == 1  # in six of a thousand toxic texts


# --- quality


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = (text or "").split("\n")
    dup = sum(1 for k, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:k])
    grams = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    marked = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(marked)


def test_base_counts():
    rng = random.Random(10)
    for _ in range(200):
        t = "".join(rng.choice(["a ", "b ", "é\n", "#", "  ", "\x85", "c d e f g h i j ", "\n", "\t"]) for _ in range(rng.randint(0, 40)))
        assert Q.base_counts(t) == brute_counts(t), repr(t)
    assert Q.base_counts(None) == (0, 0, 0, 0, 0)


def test_slices_are_the_whole_text():
    t = "abcdefghij" * 37
    assert np.concatenate(list(Q.slices(t, 3))).tolist() == Q.grams(t, 3).tolist()
    whole, Q.SLICE = Q.grams(t, 4), 50
    try:
        assert np.concatenate(list(Q.slices(t, 4))).tolist() == whole.tolist()
    finally:
        Q.SLICE = 1 << 20


def test_hashes_are_those_of_spark(spark):
    key = np.random.default_rng(0).integers(0, 1 << 60, 200)
    df = spark.createDataFrame([(int(k),) for k in key], "key long").select("key", F.xxhash64(F.lit("p:dé:4"), "key").alias("h"))
    rows = df.collect()
    assert Q.hashes("p:dé:4", np.array([r.key for r in rows])).tolist() == [r.h for r in rows]


class Brute:
    """Interpolated modified Kneser-Ney over tuples of symbols, in dictionaries."""

    def __init__(self, texts, order):
        self.order, self.counts = order, {order: {}}
        for t in texts:
            for g in self.of(t):
                self.counts[order][g] = self.counts[order].get(g, 0) + 1
        for k in range(order, 1, -1):
            low = self.counts[k - 1] = {}
            for g in self.counts[k]:
                low[g[1:]] = low.get(g[1:], 0) + 1
        self.d = {}
        for k, c in self.counts.items():
            n1, n2, n3, n4 = (max(1, sum(v == i for v in c.values())) for i in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2)
            clip = lambda x, lo, hi: min(hi, max(lo, x))
            self.d[k] = [0, clip(1 - 2 * y * n2 / n1, 0.1, 0.95), clip(2 - 3 * y * n3 / n2, 0.2, 1.9), clip(3 - 4 * y * n4 / n3, 0.3, 2.85)]

    def of(self, t):
        s = [1] * (self.order - 1) + [ord(c) if ord(c) < 2048 else 2048 + ord(c) * 2654435761 % 2048 for c in t]
        return [tuple(s[i : i + self.order]) for i in range(len(t))]

    def p(self, g):
        k = len(g)
        below = 1 / 4096 if k == 1 else self.p(g[1:])
        beside = [v for x, v in self.counts[k].items() if x[:-1] == g[:-1]]
        if not beside:
            return below
        d = self.d[k]
        c = self.counts[k].get(g, 0)
        return (c - d[min(c, 3)]) / sum(beside) + sum(d[min(v, 3)] for v in beside) / sum(beside) * below


def test_quality_equals_brute_force(spark):
    rng = random.Random(21)
    words = "the of and lorem ipsum dolor amet sit nulla vita été ß".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(3, 40))), rng.choice(["en", "de", None])) for i in range(40)]
    rows += [(50 + i, " ".join(rng.choice(["#", "$x", "ABC", "%%", "Q"]) for _ in range(25)), x) for i, x in enumerate(["en", "en", "fr", "fr"])]
    rows += [(60, None, "en"), (61, "", "fr"), (None, "a null id counts as well, as any other text of twenty words or more does that is longer than this one word", "en"), (62, rows[0][1], rows[0][2]), (62, rows[0][1], rows[0][2])]
    how = Q.Perplexity(order=3, floor=0.05, band=1.0, held_grams=50, held_heads=20, memo_bits=5, memo_languages=2)
    df = spark.createDataFrame([(i, t, x, 1.0, "n", "part") for i, t, x in rows], "doc_id long, text string, lang string, perplexity double, hash string, part string")
    out = Q.quality(df, how=how).collect()
    assert len(out) == len(rows)
    langs = {x for _, _, x in rows}
    every = {x: Brute([t for _, t, y in rows if y == x and t], 3) for x in langs}
    good = {x: [t for _, t, y in rows if y == x and t and Q.trusted(t)] for x in langs}
    assert not good["fr"] and good["en"]
    prose = {x: Brute(t or [t for y in good.values() for t in y], 3) for x, t in good.items()}
    ppl = {}
    for _, t, x in rows:
        if t:
            logs = [np.log(0.99 * prose[x].p(g) + 0.01 * every[x].p(g)) for g in every[x].of(t)]
            ppl[t, x] = float(np.exp(-np.mean(logs)))
    lang, text = {i: x for i, _, x in rows}, {i: t for i, t, _ in rows}
    steps = {x: sorted(round(np.log(r.perplexity) * 1024) for r in out if lang[r.doc_id] == x and not r.base_failed and r.perplexity) for x in langs}
    for r in out:
        t, x = text[r.doc_id], lang[r.doc_id]
        assert (r.perplexity is None) == (not t) and (not t or r.perplexity == pytest.approx(ppl[t, x], rel=1e-5))
        if s := steps[x]:
            q1, q2, q3 = np.percentile(s, [25, 50, 75]) / 1024
            wide = max(q3 - q1, 0.05)
            assert (r.low, r.high) == (pytest.approx(np.exp(q2 - wide)), pytest.approx(np.exp(q2 + wide)))
        assert r.kept == (not r.base_failed and r.low <= r.perplexity <= r.high)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([("x", t) for t in ("hello there", "help the hero", "other theory")], "lang string, text string")
    how = Q.Perplexity(order=3)
    m = Q.Model(Q.fit_model(Q.count_grams(docs, "lang", "text", 3), how)[0], how)
    for start in ("th", "zz"):
        all_next = Q.grams(start, 3)[-1:] << Q.BITS & ((1 << 36) - 1) | np.arange(1 << Q.BITS)
        assert m.probability("a:x", all_next).sum() == pytest.approx(1)
    a, b, none = m.perplexities(["x"] * 3, ["the hero", "%%$$##@@", ""])
    assert a < b and none is None and m.perplexities(["y"], ["the"]) == [None]


def test_quality(spark):
    rng = random.Random(11)
    prose = [" ".join(rng.choice("the of and lorem ipsum dolor amet sit nulla vita".split()) + rng.choice(["", "s", "ed"]) for _ in range(60)) for _ in range(60)]
    rows = [(i, t, "en") for i, t in enumerate(prose)] + [(100, "%%$ #@! " * 40, "en"), (101, None, "en"), (102, "", None), (103, "few words", None), (104, " ".join(f"ZX{i}QJ!!" for i in range(40)), "en"), (105, "again and again " * 30, "en")]
    df = spark.createDataFrame([(i, t, x, 1, 2) for i, t, x in rows], "doc_id long, text string, lang string, n_words int, n int")
    out = {r.doc_id: r for r in Q.quality(df).collect()}
    for i, t, _ in rows:
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(t)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and (not r.base_failed or not r.kept)
    assert all(out[i].kept for i in range(60)) and not out[100].kept and not out[104].kept
    assert Q.quality(df.limit(0)).count() == 0


def test_every_text_is_counted(spark):
    prose, code = "the hero is over there and the other hero is here", "a[i] = b & c | d; x = y * z; #define F(a) $a"
    assert Q.trusted(prose) and not Q.trusted(code) and Q.trusted("words\n" * 20 + "100%") and Q.trusted("文" * 80 + "%")
    docs = spark.createDataFrame([("en", prose), ("en", code), ("x", code)], "lang string, text string")
    counted = Q.count_grams(docs, "lang", "text", 5)
    rows = counted.collect()
    assert {x: sum(r.n for r in rows if r.lang == x) for x in ("en", "x")} == {"en": len(prose) + len(code), "x": len(code)}
    assert sum(r.prose for r in rows if r.lang == "en") == len(prose)
    m = Q.Model(Q.fit_model(counted, Q.Perplexity())[0], Q.Perplexity())
    assert m.perplexities(["x"], [code])[0] and ("q:", 5) in m.discount and ("p:x", 5) not in m.discount
    a, b, c = m.perplexities(["en"] * 3, [prose, code, "%Q^%7~@!" * 6])
    assert a < b < c


# --- url filter


def test_url_filter(spark):
    urls = ["http://a.Example.com/en/x", "https://www.example.com/en/x", "http://x.net/es/1", "http://x.net/de/1", "http://net/fr/", "no url", None, "://b.com?x", "http://EXAMPLE.COM#f", "http://notexample.com/en/", "http://x.net", "http://x.net/es/1"]
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, host string")
    labelled = spark.createDataFrame([(f"http://spam{i % 2}.org/casino/{i}", True) for i in range(30)] + [(f"http://ok{i}.org/news/{i}", False) for i in range(60)], "url string, blocked boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(df, labelled, Mining(min_support=0.05)).collect()}
    assert got[0] == ("a.example.com", "/en/x", "example.com/en/", "block") and got[1][2:] == ("www.example.com/en/", "allow")
    assert got[2][2:] == ("net/es/", "block") == got[11][2:] and got[3] == ("x.net", "/de/1", None, "allow") and got[4][3] == "block"
    assert got[5] == got[6] == ("", "", None, "allow") and got[7] == ("b.com", "", None, "allow") and got[8] == ("example.com", "", None, "allow")
    assert got[9] == ("notexample.com", "/en/", "com/", "allow") and got[10] == ("x.net", "", None, "allow")
    new = spark.createDataFrame([(1, "http://spam0.org/casino/99"), (2, "http://ok.org/news/1")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in filter_urls(new, labelled, Mining(min_support=0.05)).collect()} == {1: "block", 2: "allow"}
    assert filter_urls(new, labelled.limit(0)).count() == 2 and filter_urls(new.limit(0), labelled).count() == 0


def test_url_rules_of_a_skewed_table_and_of_many_tokens(spark):
    new = spark.createDataFrame([(1, "http://spam.org/casino/99"), (2, "http://ok.org/news/1")], "page_id long, url string")
    labelled = spark.createDataFrame([(f"http://spam.org/casino/{i}", True) for i in range(70)] + [(f"http://ok.org/news/{i}", False) for i in range(30)], "url string, blocked boolean")
    out = {r.page_id: (r.verdict, r.confidence) for r in filter_urls(new, labelled).collect()}
    assert out == {1: ("block", 1.0), 2: ("allow", None)}  # lift is at most 1 / 0.7
    keys = ["a", "b", "c", "d"]
    rows = [("http://h.org/?" + "&".join(f"{k}=1" for k in keys), True)] * 20 + [("http://h.org/?" + "&".join(f"{k}=1" for k in keys if k != x), False) for x in keys] * 20
    pages = spark.createDataFrame([(1, "http://h.org/?a=2&b=2&c=2&d=2"), (2, "http://h.org/?a=2&b=2&c=2")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in filter_urls(pages, spark.createDataFrame(rows, "url string, blocked boolean")).collect()}
    assert got == {1: "block", 2: "allow"}  # only all four tokens are confident


def brute_rules(labelled, how):
    """All frequent token sets that confidently block, without those that a shorter one implies."""
    from itertools import combinations

    rows = [(t, b) for t, b in labelled if t]
    share, kept = sum(b for _, b in rows) / len(rows), {}
    for n in range(1, max(map(lambda r: len(r[0]), rows)) + 1):
        for c in {c for t, _ in rows for c in combinations(sorted(t), n)}:
            has = [b for t, b in rows if set(c) <= set(t)]
            confidence = sum(has) / len(has)
            if sum(has) / len(rows) >= how.min_support and confidence >= how.min_confidence and (confidence > share + 1e-9 or confidence >= 1):
                kept[c] = confidence
    return {c: f for c, f in kept.items() if not any(set(d) < set(c) for d in kept)}


def test_url_filter_equals_brute_force(spark):
    rng = random.Random(31)
    url = lambda: f"{rng.choice(['http', 'https'])}://{rng.choice(['a', 'b', 'www'])}.{rng.choice(['x.org', 'y.org', 'z.de'])}/{rng.choice(['news', 'casino', 'blog'])}/{rng.randrange(99)}" + rng.choice(["", "?ref=1", "?buy=1&ref=2", "#top"])
    urls = [url() for _ in range(150)]
    bad = lambda u: ("casino" in u and rng.random() < 0.9) or ("buy" in u and "y.org" in u) or rng.random() < 0.1
    labelled = spark.createDataFrame([(u, bad(u)) for u in urls], "url string, blocked boolean")
    how = Mining(min_support=0.02, min_confidence=0.6)
    token_of = labelled.select("url", tokens(F.col("url")).alias("t"), "blocked").collect()
    rules = brute_rules([(r.t, r.blocked) for r in token_of], how)
    assert len(rules) > 3
    long = "http://b.x.org/casino/" + "a/" * 3000
    more = [url() for _ in range(60)] + [urls[0]] * 5 + [None, "", long]
    pages = spark.createDataFrame([(i, u, "r", True) for i, u in enumerate(more)], "page_id long, url string, rule string, n_rules boolean")
    of = {r.url: set(r.t) for r in pages.select("url", tokens(F.col("url")).alias("t")).collect()}
    out = filter_urls(pages, labelled, how, rules=()).collect()
    assert len(out) == len(more)
    for r in out:
        fired = [f for c, f in rules.items() if set(c) <= of[more[r.page_id]]]
        assert (r.verdict, r.n_rules, r.rule) == ("block" if fired else "allow", len(fired), None) and (r.confidence or 0) == pytest.approx(max(fired, default=0))


# --- html


def test_minimum_cut_is_minimal():
    rng = random.Random(12)
    for _ in range(60):
        n = rng.randint(1, 7)
        caps = [(rng.random() * 3, rng.random() * 3) for _ in range(n)]
        links = [(i, j, rng.random()) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
        f = Flow(n + 2)
        for i, (s, t) in enumerate(caps):
            f.edge(n, i, s)
            f.edge(i, n + 1, t)
        for i, j, w in links:
            f.edge(i, j, w, w)
        cost = lambda side: sum(t if side[i] else s for i, (s, t) in enumerate(caps)) + sum(w for i, j, w in links if side[i] != side[j])
        assert cost(f.source_side(n, n + 1)[:n]) == pytest.approx(min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n)))


def test_main_text():
    page = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header>Site name</header><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav>
<div id="cookie-notice">We use cookies on this site, please accept them all now.</div><div class="sidebar"><p>Some more reading that is only beside the point here.</p></div>
<article><h1>The title</h1><!-- ad --><p>First paragraph &amp; some <b>bold</b>
 words that go on for a while.<p>Second one, also with
a number of words in it.<br>Still going.</p><div class="comments"><p>I disagree with all of this, says a reader at length.</p></div></article>
<form>Your email <input></form><footer>&copy; 2024 All of us</footer></body></html>"""
    assert main_text(page) == "The title\nFirst paragraph & some bold words that go on for a while.\nSecond one, also with a number of words in it. Still going."
    assert main_text(None) == main_text("") == main_text("<nav>x</nav>") == ""
    assert main_text("<article><p>A cut page that ends in the middle of a ta<b cla").startswith("A cut page")
    assert label([]) == [] and label([Block("x", Element("p"))]) in ([True], [False])


LONG = "This paragraph goes on for quite a while, as those of articles do, with commas and full stops. It has a second sentence and a third, so that it is clearly running text that a reader came for, and not a label of any kind."


def test_wrappers_do_not_hide_the_article():
    other = "<nav><a href=x>Home</a></nav><footer>All rights</footer>"
    for page in (
        f'<div class="main has-sidebar"><article><p>{LONG}</p></article></div>',
        f'<div class="content margin-bottom"><p>{LONG}</p></div>',
        f"<form action=x><div><p>{LONG}</p></div></form>",
        f'<div class="with-comments textBottom"><main><p>{LONG}</p></main></div>',
        f'<div id="page-header-menu"><main><p>{LONG}</p></main></div>',
    ):
        assert main_text(f"<body>{other}{page}{other}</body>") == LONG, page
    titled = f'<div class="post"><header class="entry-header"><h1>Its own title</h1></header><p>{LONG}</p></div>'
    assert main_text(f"<header><p>Site name</p></header>{titled}<footer>x</footer>") == f"Its own title\n{LONG}"
    assert main_text(f"<header>Site</header><article><header><h1>Title</h1></header><p>{LONG}</p></article>") == f"Title\n{LONG}"


def test_boilerplate_of_every_kind_goes():
    away = ['<div class="sidebar">', '<div id="comments"><article>', '<section class="post-comments">', '<div class="cookieNotice">', '<div class="advert">', "<aside>", "<nav>", '<div role="banner">', '<div class="site-footer">', '<div class="newsletter-box">', "<form>", '<ul class="menu">', '<div hidden>', '<div style="display: none">', "<noscript>"]
    for start in away:
        tags = re.findall(r"<(\w+)", start)
        end = "".join(f"</{t}>" for t in reversed(tags))
        some = "A few words that stand beside the article and are not a part of it at all."
        page = f"<body><article><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></article>{start}<p>{some}</p>{end}</body>"
        assert main_text(page) == f"Title\n{LONG}\n{LONG}", start
        inside = f"<body><article><h1>Title</h1><p>{LONG}</p><p>{LONG}</p>{start}<p>{some}</p>{end}</article></body>"
        if start not in ("<form>",):
            assert some not in main_text(inside), start


def test_labels_are_a_minimum_cut():
    rng = random.Random(14)
    for _ in range(30):
        items = [rng.choice([f"<p>{LONG[: rng.randint(5, 200)]}</p>", "<nav><a href=x>menu</a></nav>", "<div class=legal><p>small print</p></div>", "<article><h2>head</h2></article>", "<li><a>link</a> text"]) for _ in range(rng.randint(1, 8))]
        blocks = blocks_of("".join(items), Cut())
        z = [log_odds(b, Cut()) for b in blocks]
        links = [(i - k, i, Cut().near / (1 + distance(blocks[i - k].at, blocks[i].at, Cut().far)) / k + (k == 1) * Cut().adjacent / (1 + (blocks[i - 1].at is not blocks[i].at))) for i in range(len(blocks)) for k in (1, 2) if i >= k]
        cost = lambda side: sum(np.log1p(np.exp(-x if s else x)) for s, x in zip(side, z)) + sum(w for i, j, w in links if side[i] != side[j])
        best = min(cost([bool(m >> i & 1) for i in range(len(z))]) for m in range(1 << len(z)))
        assert cost(label(blocks)) == pytest.approx(best)


def test_deep_and_long_pages_take_linear_time():
    import time

    for unit in ("<div>", "<b>", "<p><b>", "<li><div>", "<td><i>", "</p></x>"):
        def took(n):
            began = time.process_time()
            main_text(unit * n + f"<p>{LONG}")
            return time.process_time() - began

        took(500)
        assert took(16_000) < 40 * took(2_000) + 0.3, unit
    text = main_text("<article>" + f"<p>{LONG}</p>" * 3000 + "</article>")
    assert text == "\n".join([LONG] * 3000)


def test_unclosed_head():
    rest = "<article><p>Hello world text.</p></article>"
    for head in ("<head><title>t</title><body>", "<head><title>t</title>", "<head><title>t<body>", "<head><meta a=b><style>p {}</style>", "<head><title>t</title></p></head><body>", "<head></head>"):
        assert main_text(f"<html>{head}{rest}</body></html>") == "Hello world text.", head
    text = "Bare words that go on for a good while after a head without its end tag."
    assert main_text(f"<head><title>t</title>{text}") == text and main_text("<head><title>t") == ""


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>Some text é.</p></article>", "z"), (2, None, None, None)], "page_id long, url string, html string, text2 string")
    got = {r.page_id: (r.url, r.text, r.n_chars, r.text2) for r in extract(df).collect()}
    assert got == {1: ("u", "Some text é.", 12, "z"), 2: (None, "", 0, None)}
