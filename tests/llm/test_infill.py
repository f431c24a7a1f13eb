"""Fill-in-middle against a regular expression in plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quantlake.llm import infill

SCHEMA = "doc_id long, text string, n int, form string"


def plain(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    sha = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(sha[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    return doc_id, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", text


ODD = ["", None, "a", "é", "日本語 text", "😀😀a😀", "ab<P", "<P>x", "x<S>", "a<M>b", "<<P>", "<P<S", "< P>", "<p>", "\n\t\0 x", "á" * 50, "é‍", "<" * 40, "a1b2C3", "ÿ\u0080￿\U0010ffff"]


def test_infill_equals_plain(spark):
    rows = [(i, t) for i, t in enumerate(ODD * 12)] + [(5, "shared id"), (5, "shared id too"), (None, "no id"), (None, "no id"), (2**63 - 1, "last"), (-(2**63), "first")]
    rows += [(1000, "wörd, " * 400_000), (1001, "a" * 1_000_000), (1002, "<" * 300_000 + "P>")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    out = infill.transform(df).withColumn("restored", infill.restore(F.col("output"), F.col("form")))
    assert sorted(map(tuple, out.collect()), key=str) == sorted((plain(*r) for r in rows), key=str)


def test_infill_of_an_empty_table(spark):
    assert infill.transform(spark.createDataFrame([], SCHEMA)).collect() == []


def test_scan_is_the_same_in_blocks_and_byte_by_byte():
    auto = infill.Automaton()
    data = "\xff".join(t or "" for t in ODD * 40).encode("utf-8").replace("\xff".encode(), b"\xff") * 5
    step, emit = auto.table
    state, codes = 0, []
    for byte in data:
        codes.append(emit[state, byte])
        state = step[state, byte]
    assert auto.scan(data).tolist() == codes and 0 < auto.memory <= 4


def test_other_sentinels(spark):
    marks = infill.Sentinels("⟨pre⟩", "⟨suf⟩", "⟨mid⟩")
    rows = [(i, t) for i, t in enumerate(["some text, words", "x⟨suf⟩y", "⟨su", "<P> stays", "⟨⟨mid"] * 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = infill.transform(df, sentinels=marks, plain_percent=0, spm_percent=50).withColumn("restored", infill.restore(F.col("output"), F.col("form"), marks)).collect()
    assert {(r.doc_id, r.restored) for r in out} == set(rows)
    assert {r.doc_id for r in out if r.form == "plain"} == {i for i, t in rows if "⟨suf⟩" in t}


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("ab", "ba", "c")])
def test_sentinels_that_could_be_mistaken(marks):
    with pytest.raises(ValueError):
        infill.Sentinels(*marks)
