"""Removal of repeated windows of words against a dictionary of all windows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantlake.llm import debruijn

SCHEMA = "doc_id long, text string, row int, n_words string"


def plain(rows, k=20):
    """rows (doc_id, text) in order -> sorted (doc_id, n_words, n_removed, kept)."""
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, out = set(), []
    for i in order:
        w, gone = words[i], set()
        for s in range(len(w) - k + 1):
            window = tuple(w[s : s + k])
            if window in seen:
                gone |= set(range(s, s + k))
            seen.add(window)
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((rows[i][0], len(w), len(gone), " ".join(kept)))
    return sorted(out, key=str)


def found(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    out = debruijn.without_repeats(spark, df, **how).collect()
    for r in out:  # the spans are what is removed
        assert len({j for s in r.spans for j in range(s["at"], s["at"] + s["n"])}) == r.n_removed
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out), key=str)


def corpus(seed):
    rng = random.Random(seed)
    say = lambda n, v=300: [f"w{rng.randrange(v)}" for _ in range(n)]
    shared, texts = [say(rng.randrange(15, 60)) for _ in range(4)], []
    for i in range(60):
        t = say(rng.randrange(0, 80))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(t) + 1)
            p = rng.choice(shared)
            t[at:at] = p[rng.randrange(len(p) // 2) :]
        texts.append(t)
    texts += [t[:5] + ["edited"] + t[6:] for t in texts[:15]] + texts[:10]
    texts += [["a"] * n for n in (19, 20, 21, 60)] + [["a", "b"] * 30, ["a", "b"] * 9 + ["a"]]
    return [rng.choice([" ", "\n", "\t ", "\x0b"]).join(t) for t in texts]


@pytest.mark.parametrize("chunk, block", [(debruijn.CHUNK, debruijn.BLOCK), (30, 7)])
def test_repeats_are_those_of_brute_force(spark, chunk, block):
    texts = corpus(chunk)
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    rows = list(zip(ids, texts, strict=True)) + [(500, None), (501, ""), (502, " \n"), (503, "one"), (2**63 - 1, texts[3]), (-(2**63), texts[4])]
    assert found(spark, rows, chunk=chunk, block=block) == plain(rows)


def test_rows_that_share_or_lack_an_id(spark):
    texts = corpus(9)
    rows = [(None if i % 3 == 0 else i // 4, t) for i, t in enumerate(texts)] + [(None, texts[0])] * 30 + [(2**63 - 1, texts[1])]
    assert found(spark, rows, chunk=50, block=20) == plain(rows)


def test_very_long_text_and_empty_table(spark):
    rng = random.Random(3)
    long = [f"w{rng.randrange(5000)}" for _ in range(200_000)]
    rows = [(1, " ".join(long)), (0, " ".join(long[50_000:50_400])), (2, " ".join(["z"] * 100_000)), (3, "é " * 40 + "日本")]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []


@pytest.mark.parametrize("k", [8, 9, 30])
def test_other_lengths(spark, k):
    rows = list(enumerate(corpus(k)))
    assert found(spark, rows, k=k) == plain(rows, k)


def test_common_grams_and_spans():
    words = np.random.default_rng(0).integers(1, 1 << 62, 400).astype(np.uint64)
    words[200:260] = words[20:80]
    none = np.empty(0, np.uint64)
    begin, n, h, c = debruijn.runs(words, 20, none, debruijn.Spans())
    assert n.sum() == 381 and (begin == np.r_[0, np.cumsum(n)[:-1]]).all()
    common = np.sort(h[:10])
    again = debruijn.runs(words, 20, common, debruijn.Spans())
    assert not np.isin(again[2], common).any()  # every window has another gram here
    spans = debruijn.Spans()
    assert spans.of(words, np.array([20]), np.array([80])) == spans.of(words, np.array([200]), np.array([260]))


def test_a_join_on_the_row_does_not_move_texts(spark):
    from quantlake.llm.common import Workspace, numbered

    texts = Workspace(spark, "plan").save_by(numbered(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")), "texts", "row")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = texts.join(spark.range(5).select(F.col("id").alias("row")), "row")
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_windows_of_a_part_of_a_text(spark):
    """Of a long text of which few runs are asked for, only their words are hashed; the pointers are those of the whole text."""
    from quantlake.llm import debruijn
    from quantlake.llm.common import Workspace

    words = [f"w{i * i % 1009}x{i % 7}" for i in range(3000)]
    words[2000:2040] = words[100:140]
    rows = [(1, 1, bytearray(" ".join(words).encode()))]
    texts = spark.createDataFrame(rows, "row long, doc long, data binary")
    asked = spark.createDataFrame([(1, 100, 5), (1, 104, 4), (1, 2000, 8)], "row long, at long, n long")
    found = debruijn.branches(Workspace(spark, "test"), texts, asked, debruijn.K).collect()
    assert {(r["at"], r["src_at"]) for r in found if r["at"] >= 2000} == {(2000 + i, 100 + i) for i in range(8)}
