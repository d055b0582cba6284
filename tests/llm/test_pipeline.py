"""The stages of the pipeline, each against brute force on its own input."""

import gc
import random
import time
import weakref
from collections import Counter

import corpus_pipeline as C
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from test_dedup import near_brute

from lodestrata.llm import mixing
from lodestrata.llm import quality as quality_module
from lodestrata.llm.common import released
from lodestrata.llm.packing import Encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, new_text string, kept_id int, mix_shard int, id string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, x, s, None if t is None else len(t), "n", 1, 2, "i") for i, t, x, s in rows], SCHEMA)


def rows():
    rng = random.Random(23)
    words = "the of and lorem ipsum dolor amet sit nulla vita house tree road river stone light".split()
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", "s", "ed"]) for _ in range(n))
    out = [(i, text(rng.randint(30, 90)) + "\n All rights reserved \n" + text(20), rng.choice(["en", "de"]), f"s{i % 12}") for i in range(60)]
    for i in range(20):  # near copies
        w = out[i][1].split(" ")
        w[rng.randrange(5)] = "changed"
        out.append((100 + i, " ".join(w), "en", f"s{i % 12}"))
    out += [(200, None, "en", "s1"), (201, "", None, None), (202, "#$% $$ " * 40, "en", "s2"), (203, "few words", "en", None), (None, text(60), None, None), (5, out[5][1], "en", "s5")]
    return out


def test_quality_stage(spark):
    docs = documents(spark, rows())
    kept = Counter(r.doc_id for r in C.quality_rules(spark, docs, "").collect())
    good = {r.doc_id for r in C.quality(docs).where("kept").collect()}
    assert kept == Counter(i for i, *_ in rows() if i in good) and kept[5] == 2 and kept[None] == 1
    assert not {200, 201, 202, 203} & set(kept) and len(kept) > 75  # clean documents stay


def test_line_stage(spark):
    out = {r.doc_id: r for r in C.dedup_lines(spark, documents(spark, rows()), "").collect()}
    first = min((i for i, t, *_ in rows() if i is not None and t and "All rights reserved" in t))
    for i, t, *_ in rows():
        if i == first or not t or "All rights reserved" not in t:
            want = t
        else:
            want = "\n".join(x for x in t.split("\n") if x.strip() != "All rights reserved")
        assert out[i].text == want and out[i].n_chars == (None if t is None else len(want)) and (out[i].new_text, out[i].id) == ("n", "i")
    only = [(i, "same line here", "en", f"s{i}") for i in range(12)]
    assert [r.doc_id for r in C.dedup_lines(spark, documents(spark, only), "").collect()] == [0]  # the others have no words left


def test_near_stage(spark):
    some = [r for r in rows() if r[0] is not None]
    kept = Counter(r.doc_id for r in C.near_duplicates(spark, documents(spark, some), "").collect())
    want = near_brute([(i, t) for i, t, *_ in some], 5)
    assert kept == Counter(i for i, *_ in some if want[i][2])


def test_mixing_stage(spark):
    docs = documents(spark, rows())
    out = C.mix_sources(spark, docs, "")
    assert out.columns == docs.columns
    got = Counter(r.doc_id for r in out.collect())
    want = Counter()
    for r in mixing.mixing_digest(docs).collect():
        want[r.doc_id] += len(r.shards)
    assert got == want and max(got.values()) <= 6  # a repeated id counts twice


def test_packing_stage(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    some = [r for r in rows() if r[0] is not None and r[0] != 5]
    pieces = {}
    for r in sorted(C.pack_tokens(spark, documents(spark, some), "").collect(), key=lambda r: r.start):
        pieces.setdefault(r.doc_id, []).extend(r.ids)
    assert pieces == {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t, *_ in some}


@pytest.mark.parametrize("given", ["all", "none"])
def test_run(spark, tmp_path, given):
    docs = documents(spark, rows() if given == "all" else [])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = C.run(spark, str(tmp_path)).collect()
    assert [n for n, _ in C.STAGES] == ["quality rules", "line dedup", "near dedup", "source mixing", "packing"]
    if given == "none":
        assert out == []
        return
    of = {}
    for r in out:
        of.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in of.values():
        spans.sort()
        assert [a for a, _ in spans] == list(np.cumsum([0] + [n for _, n in spans])[:-1]) and sum(n for _, n in spans) <= 2048
    assert len(out) > 20 and not {200, 201, 202, 203} & {r.doc_id for r in out}


def test_a_worker_keeps_the_state_of_one_stage():
    """The pipeline's stages share their workers: a model must not stay beside an encoder."""
    tables, how = quality_module.Tables((), (), ()), quality_module.Perplexity()
    model = quality_module.model_of(tables, how)
    assert quality_module.model_of(tables, how) is model
    gone = weakref.ref(model)
    del model
    encoder = Encoder.of(public_tokenizers.path("byte_bpe_50k.json"), 10)
    gc.collect()
    assert gone() is None and Encoder.of(public_tokenizers.path("byte_bpe_50k.json"), 10) is encoder
    gone = weakref.ref(encoder)
    del encoder
    quality_module.model_of(tables, how)
    gc.collect()
    assert gone() is None
    released()


def test_idle_workers_keep_nothing(spark):
    """Stages that run in the JVM alone share their executors with the workers of the stage before."""

    def keeps(batches):
        from lodestrata.llm.common import HELD

        for _ in batches:
            yield pa.record_batch({"n": pa.array([len(HELD)], pa.int64())})

    docs = documents(spark, rows())
    for stage in (C.quality_rules, C.pack_tokens):
        stage(spark, docs, "").collect()
        time.sleep(2)
        assert {r.n for r in spark.range(0, 64, 1, 8).mapInArrow(keeps, "n long").collect()} == {0}
