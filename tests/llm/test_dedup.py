"""Line, near and suffix dedup against brute force, with nulls, empty and repeated rows, ties and clashing columns."""

import hashlib
import random
import re
import signal

import numpy as np
import pytest

from lodestrata.llm.components import components
from lodestrata.llm.gsaca import suffix_array
from lodestrata.llm.line_dedup import line_dedup
from lodestrata.llm.near_dedup import Near, near_dedup, shingles
from lodestrata.llm.suffix_dedup import CORE, Repeats, anchor_rows, blob, cut, entries, in_order, kmer_hashes, least_ids, segments, several, sharing, suffix_dedup, turned

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    base = [" ".join(word() for _ in range(rng.randint(10, 120))) for _ in range(25)]
    rows = [*base, *base[:8], None, "", "  \n ", "one", "ONE", "one two", "dup dup dup dup dup dup dup dup"]
    for t in base[:12]:
        for _ in range(3):
            w = t.split(" ")
            w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w))
    shared = " ".join(word() for _ in range(15))
    rows += [f"{base[i][:60]} {shared} {base[i][70:90]}" for i in range(5)] + ["é" * 30 + shared + "ß" * 30]
    return list(enumerate(rows))


SCHEMA = "doc_id long, text string, key string, id string, component string, size int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", "x", "c", 1) for i, t in rows], SCHEMA)


def near_brute(rows, n, percent=80):
    fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = {}
    for i, t in rows:
        w = WORD.findall(fold(t))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("how", [Near(words=4), Near(words=5), Near(words=4, bins=16, bits=256, slack=0.8, block=8, star=3)])
def test_near_dedup(spark, how):
    rows = texts()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup(frame(spark, rows), how=how).collect()}
    assert got == near_brute(rows, how.words)


def test_near_dedup_of_a_large_group(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(60)] = f"x{i}{rng.random()}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup(frame(spark, rows), how=Near(words=4, block=64, star=16)).collect()}
    assert got == near_brute(rows, 4)


def test_near_dedup_of_sets_larger_than_a_sketch(spark):
    rng = random.Random(11)
    rows = []
    for k in range(6):
        base = [f"w{rng.randrange(10**9)}" for _ in range(rng.choice((1100, 1500, 2600)))]
        for edits in (0, 20, 60, 75, 150):  # four shingles each
            w = list(base)
            for i in rng.sample(range(len(w)), edits * len(w) // 1500):
                w[i] = f"x{rng.randrange(10**9)}"
            rows.append((10 * k + len(rows), " ".join(w)))
    want = near_brute(rows, 4)
    assert 6 < len({c for _, c, _ in want.values()}) < len(rows) and min(n for n, _, _ in want.values()) > 1024
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup(frame(spark, rows), how=Near(words=4)).collect()}
    assert got == want


def test_near_dedup_of_repeated_ids(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    df = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b), (3, b), (4, "z y")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup(df).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (3, 1, False), (4, 4, True)]


def test_near_dedup_of_nothing_and_nulls(spark):
    assert near_dedup(frame(spark, [])).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (9, "a b c d e f")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup(df).collect()}
    assert got == {(None, None, True), (4, 4, True), (9, 4, False)}


def test_shingles_fold_only_ascii():
    assert (shingles("A b", 4) == shingles("a B", 4)).all() and len(shingles("", 4)) == 0
    assert not (shingles("É", 4) == shingles("é", 4)).all()


def test_components(spark):
    rng = random.Random(7)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 400)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: find(n) for a, b in links for n in (a, b) if a != b} and len(got) >= 100


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(500):
        s = [rng.randint(1, rng.choice((1, 2, 5))) for _ in range(rng.randint(1, 40))] + [0]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_array_ends():
    def late(*_):
        raise TimeoutError

    before = signal.signal(signal.SIGALRM, late)
    signal.alarm(20)
    try:
        assert suffix_array([0]) == [0] and suffix_array([1, 0]) == [1, 0] and suffix_array([2, 1, 2, 0]) == [3, 1, 2, 0]
        assert suffix_array([1] * 3000 + [0]) == list(range(3000, -1, -1))
        assert suffix_array([*range(1, 300), *range(1, 300), 0]) == [598, *(x for k in range(299) for x in (k + 299, k))]
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)


def test_kmer_hashes_depend_on_content_alone():
    a = kmer_hashes(np.frombuffer(b"xxabcdefghijabcdefghij", np.uint8), 10)
    assert a[2] == a[12] and len(set(a.tolist())) == len(a) - 1


def runs(mask):
    return sum(bool(m) and not (k and mask[k - 1]) for k, m in enumerate(mask))


def suffix_brute(rows, length):
    first, want = {}, []
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            if i is not None:
                first[b[k : k + length]] = min(i, first.get(b[k : k + length], i))
    for i, t in rows:
        b = (t or "").encode()
        mark = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if i is not None and first[b[k : k + length]] < i:
                mark[k : k + length] = True
        left = bytes(c for c, m in zip(b, mark) if not m)
        want.append((i, len(b), int(mark.sum()), runs(mark), hashlib.sha256(left).hexdigest()))
    return sorted(want, key=str)


@pytest.mark.parametrize("how", [Repeats(), Repeats(length=20, kmer=7), Repeats(length=30, kmer=11, slice=64), Repeats(hot=2), Repeats(length=20, kmer=7, hot=1)])
def test_suffix_dedup(spark, how):
    rows = texts()
    assert sorted(map(tuple, suffix_dedup(frame(spark, rows), how=how).collect()), key=str) == suffix_brute(rows, how.length)


@pytest.mark.parametrize("how", [Repeats(), Repeats(hot=2)])
def test_suffix_dedup_of_nothing_nulls_and_repeated_ids(spark, how):
    assert suffix_dedup(frame(spark, []), how=how).count() == 0
    t, u = "".join(chr(97 + k * k % 26) for k in range(99)), "0123456789" * 12
    rows = [(1, t), (2, t), (2, t), (None, t), (None, u), (3, u), (3, f"{t[:70]}x{u}"), (3, f"{t[:70]}x{u}"), (4, u + t), (None, None), (5, u[:49])]
    assert sorted(map(tuple, suffix_dedup(frame(spark, rows), how=how).collect()), key=str) == suffix_brute(rows, 50)


@pytest.mark.parametrize("how", [Repeats(), Repeats(length=20, kmer=7), Repeats(length=30, kmer=11, slice=64)])
def test_segments_of_many_texts_are_those_of_each(how):
    rng = random.Random(1)
    for _ in range(10):
        many = [bytes(rng.choice(b"abcd") for _ in range(rng.choice((0, 5, 19, 20, 50, 51, 80, 200, 9000, 20_000)))) for _ in range(rng.randint(1, 9))]
        rows = lambda texts: [tuple(int(x) for x in r) for g in segments(texts, how) for r in zip(*g)]
        got = rows(many)
        assert sorted(got) == sorted((k, *r[1:]) for k, t in enumerate(many) for r in rows([t]))
        covered = sorted((t, x) for t, _, first, last, _ in got for x in range(first, last + 1))
        assert covered == [(k, x) for k, t in enumerate(many) for x in range(max(0, len(t) - how.length + 1))]
        for t, anchor, first, last, place in got:
            assert last <= place <= first + how.length - how.kmer
            assert kmer_hashes(np.frombuffer(many[t][place : place + how.kmer], np.uint8), how.kmer).view(np.int64)[0] == anchor


def test_cut():
    rng = random.Random(2)
    for _ in range(200):
        text = bytes(rng.randrange(256) for _ in range(rng.randint(0, 30)))
        spans = [(a, rng.randint(a + 1, len(text))) for a in (rng.randrange(len(text)) for _ in range(rng.randint(0, 5)) if text)]
        gone = [any(a <= k < b for a, b in spans) for k in range(len(text))]
        assert cut(text, spans) == (bytes(c for c, g in zip(text, gone) if not g), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)))


def test_least_ids_of_a_group():
    rng = random.Random(4)
    for _ in range(400):
        length = rng.choice((2, 3, 8, 14, 31))
        near = lambda: bytes(rng.choice(b"abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, length - 1)))
        group = {x: rng.randint(0, 9) for x in (near() + CORE + near() for _ in range(rng.randint(1, 12))) if len(x) >= length}
        strings = lambda t: [t[k : k + length] for k in range(len(t) - length + 1)]
        first = {x: min(i for t, i in group.items() if x in strings(t)) for t in group for x in strings(t)}
        got = least_ids(group, length)
        assert {t: [i for a, b, i in spans for _ in range(a, b + 1)] for t, spans in got.items()} == {t: [first[x] for x in strings(t)] for t in group}
        several_have = {t for t in group if any(x in strings(u) for x in strings(t) for u in group if u != t)}
        assert several_have <= set(sharing(list(group), length)) <= set(group)


def test_blobs_hold_their_entries():
    import pyarrow as pa

    rng = random.Random(6)
    for top in (3, 2**62):
        rows = [(rng.randint(-(2**63), 2**63 - 1), rng.choice((2, -top, top, rng.randint(-top, top))), rng.choice((0, 1, 2))) for _ in range(200)]
        anchor, value, kind = (np.array(c, np.int64) for c in zip(*rows))
        order = np.argsort(turned(anchor))
        z = blob(turned(anchor)[order], value[order], kind[order], -top)
        assert sorted(zip(*(x.tolist() for x in entries(z)))) == sorted(rows)
        batch = pa.record_batch([pa.array([-1, 0, 0], pa.int32()), pa.array([z] * 3, pa.binary())], names=["part", "blob"])
        wanted, got = ([r for r in zip(*(c.to_pylist() for c in b.columns))] for b in in_order(iter([batch.slice(0, 2), batch.slice(2)])))
        assert sorted(wanted) == sorted(rows) and sorted(got) == sorted(rows * 2) and [r[0] for r in got] == sorted(r[0] for r in got)


def test_several_streams_runs_over_batches():
    import pyarrow as pa

    rng = random.Random(2)
    for _ in range(200):
        rows = sorted((rng.randint(1, 6), rng.randint(100, 120) if kind == 0 else rng.randint(2, 4) if kind == 1 else rng.randint(200, 300), kind) for kind in (rng.choice((0, 0, 1, 2)) for _ in range(rng.randint(1, 25))))
        batches, left = [], list(rows)
        while left:
            n = rng.randint(1, 5)
            batches.append(anchor_rows(*(np.array(c, np.int64) for c in zip(*left[:n]))))
            left = left[n:]
        got = [r for b in several(Repeats(hot=3))(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))]
        total = {a: sum(i if k == 1 else 1 for x, i, k in rows if x == a and k < 2) for a, _, _ in rows}
        want = [(a, i, 2) for a, i, k in rows if k == 2 or (k == 0 and total[a] > 1)] + [(a, n, 3) for a, n in total.items() if n > 3]
        assert sorted(got) == sorted(want), rows


def test_line_dedup(spark):
    rows = [(i, f"head {i}\n  common \nonly {i}\n\ncommon\t", f"s{i % 12}") for i in range(30)]
    rows += [(100 + i, "near\nx", f"s{i % 3}") for i in range(40)] + [(200, None, "s1"), (201, "", None), (202, "common", None), (203, "\n\n", "s2")]
    df = spark.createDataFrame([(i, t, s, "k") for i, t, s in rows], "doc_id long, text string, source string, key string")
    out, text, n = line_dedup(df, min_sites=10)
    got = {r.doc_id: (r.new, r.n, r.key) for r in out.select("doc_id", text.alias("new"), n.alias("n"), "key").collect()}
    sites, first = {}, {}
    for i, t, s in sorted(rows, key=lambda r: r[0]):
        for k, line in enumerate((t or "").split("\n")):
            if key := line.strip(" \t\r"):
                sites.setdefault(key, set()).add(s)
                first.setdefault(key, (i, k))
    for i, t, s in rows:
        kept = [line for k, line in enumerate((t or "").split("\n")) if not (x := line.strip(" \t\r")) or len(sites[x]) < 10 or first[x] == (i, k)]
        n = len((t or "").split("\n")) - len(kept)
        assert got[i] == (None if t is None else "\n".join(kept), n, "k"), i
    assert line_dedup(df.limit(0))[0].count() == 0


def test_line_dedup_of_null_ids_and_clashing_names(spark):
    rows = [(i if i else None, f"all\nown {i}\nall\n", f"s{i}") for i in range(12)]
    df = spark.createDataFrame([(i, t, s, "a", "b", "c") for i, t, s in rows], "doc_id long, text string, source string, line_dedup_dropped string, line_dedup_id string, id string")
    out, text, n = line_dedup(df, min_sites=10)
    got = {r.doc_id: (r.new, r.n, r.line_dedup_dropped, r.line_dedup_id, r.id) for r in out.select("*", text.alias("new"), n.alias("n")).collect()}
    assert got[None] == ("all\nown 0\n", 1, "a", "b", "c") and all(got[i] == (f"own {i}\n", 2, "a", "b", "c") for i in range(1, 12))
