"""The stages of corpus_pipeline.py on repeated and null doc_ids, held against plain Python."""

from collections import Counter
from fractions import Fraction

import pytest

import corpus_pipeline
from quantlake.llm import mixing, pieces

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
A, B, C, D, E = (" ".join(f"{name}{i % 53}x{i % 17}" for i in range(120)) for name in ("alpha", "beta", "gamma", "delta", "eps"))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t)) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def rows():
    """Repeats of a doc_id with the same and with another text, and null doc_ids with and without a near copy."""
    return [(1, A, "en", "s1"), (1, A, "en", "s1"), (1, B, "fr", "s2"), (2, A + " end", "en", "s2"), (None, A, "en", "s1"), (None, C, "de", "s3"), (None, C, "de", "s3"), (None, D, "es", "s1"), (3, E, "en", "s3")]


def found(df):
    return Counter((r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.select(*COLUMNS).collect())


def test_one_row_of_each_group_stays(spark, rows):
    have = found(corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), ""))
    assert have == Counter([(1, A, "en", "s1"), (1, B, "fr", "s2"), (None, C, "de", "s3"), (None, D, "es", "s1"), (3, E, "en", "s3")])


def test_cut_texts_stay_with_their_own_rows(spark):
    shared = " ".join(f"shared{i}" for i in range(30))
    rows = [(4, shared + " " + A, "en", "s1"), (4, B, "fr", "s2"), (None, shared + " " + C, "de", "s3"), (None, D, "es", "s1"), (None, D, "es", "s1")]
    have = found(corpus_pipeline.cut_repeats(spark, frame(spark, rows), ""))
    assert have == Counter([rows[0], rows[1], (None, C, "de", "s3"), rows[3]])


def test_copies_are_counted_by_row(spark, rows):
    """Weights by source, 1.5 times the words in all: with all rows of one doc_id the sums must still be the targets'."""
    rows = [(None if i % 3 == 0 else 7, f"{A} {i}", "en", f"s{i % 3}") for i in range(60)]
    have = found(corpus_pipeline.mix_sources(spark, frame(spark, rows), ""))
    assert set(have) <= set(rows) and max(have.values()) <= 2
    words = Counter()
    for (_, _, _, source), n in have.items():
        words[source] += n
    # 60 documents of 121 words: 90 by 3, 1 and 2 sixths, at most twice each source's 20, the rest reshared.
    assert abs(words["s0"] - 40) <= 1 and abs(words["s1"] - 50 / 3) <= 1.5 and abs(words["s2"] - 100 / 3) <= 1.5


def plain_near_duplicates(texts):
    """Places of the texts that stay: the first of each group linked by 75 % of the five-word shingles."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    name = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    name[i] = name[j] = min(name[i], name[j])
    return [i for i, n in enumerate(name) if i == n]


def plain_cut(texts):
    """Each text without the bytes of 50-byte strings that an earlier text has."""
    seen, out = set(), []
    for t in texts:
        b = t.encode()
        gone = set()
        for s in range(len(b) - 49):
            if b[s : s + 50] in seen:
                gone.update(range(s, s + 50))
        seen.update(b[s : s + 50] for s in range(len(b) - 49))
        out.append(bytes(x for k, x in enumerate(b) if k not in gone).decode("utf-8", "ignore"))
    return out


def test_run_against_brute_force(spark, tmp_path):
    """Nulls, blanks, numbers, a very long text, repeated rows, near copies and shared passages, through all five stages."""
    english, french = "the house and a man of the city with water for her".split(), "le chat et la maison dans une ville avec son eau".split()

    def text(k, words, n=70):
        return " ".join(f"{words[(k * 7 + i) % len(words)]} {''.join(chr(97 + (k * 31 + i * i * 17 + j * 5) % 26) for j in range(6))}" for i in range(n))

    passage = "this passage of more than fifty bytes is repeated word for word in several of the texts"
    rows = [(i, text(i, english if i % 2 else french), "en" if i % 2 else "fr", "abc"[i % 3]) for i in range(24)]
    rows += [(30 + i, f"{text(40 + i, english, 40)} {passage} {text(50 + i, english, 40)}", "en", "a") for i in range(3)]
    rows += [(40, rows[3][1] + " more", "en", "b"), (41, rows[3][1], "en", "c"), (3, rows[3][1], "en", "a"), (None, rows[5][1], None, None)]
    rows += [(42, None, "en", "a"), (43, "", "en", "b"), (44, "12 34 ### ½", None, "c"), (45, text(99, english, 30_000), "en", "c")]
    frame = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = sorted((r for r in rows if r[1] and r[0] not in (42, 43, 44)), key=lambda r: (r[0] is None, r[0] or 0))
    kept = [kept[i] for i in plain_near_duplicates([r[1] for r in kept])]
    cut = plain_cut([r[1] for r in kept])
    want = {(r[0], t): r[3] for r, t in zip(kept, cut, strict=True) if t}
    coder = pieces.coder(pieces.VOCABULARY, 0.1, 17)
    have = Counter((r["doc_id"], coder.decode(r["ids"])) for r in out)
    assert all(r["lossless"] and r["n_pieces"] == len(r["ids"]) for r in out)
    assert set(have) <= set(want) and max(have.values()) <= 2
    size, words = Counter(), Counter()
    for (i, t), s in want.items():
        size[s] += len(t.split())
        words[s] += have[i, t] * len(t.split())
    targets = mixing.targets([size[s] for s in "abc"], [3, 1, 2], Fraction(3, 2) * sum(size.values()))
    longest = {s: max(len(t.split()) for (_, t), x in want.items() if x == s) for s in "abc"}
    assert all(abs(words[s] - t) <= longest[s] / 2 + 1 for s, t in zip("abc", targets, strict=True))


def test_stages_of_an_empty_table(spark):
    """Every stage gives an empty table of its own columns; extra columns with clashing names stay as they are."""
    empty = frame(spark, [(1, A, "en", "s1")]).limit(0)
    for _, stage in corpus_pipeline.STAGES[:3]:
        found = stage(spark, empty, "")
        assert found.columns == COLUMNS and found.count() == 0
    assert corpus_pipeline.mix_sources(spark, empty, "").count() == 0
    clash = frame(spark, [(1, A, "en", "s1"), (2, A, "en", "s1")]).selectExpr("*", "'x' AS component_id", "'y' AS kept")
    assert corpus_pipeline.drop_near_duplicates(spark, clash, "").select("component_id", "kept").collect() == [("x", "y")]


def test_extra_columns_of_any_name_pass_through_every_stage(spark, tmp_path):
    names = ["copy", "copy_", "language", "d", "row", "kept", "n", "copies", "taken", "_language", "_copies", "size", "h"]
    docs = frame(spark, [(1, A, "en", "s1"), (2, A + " end", "en", "s1"), (3, B, "en", "s2"), (None, C, None, None)])
    docs = docs.selectExpr("*", *(f"concat('{c}', doc_id) AS `{c}`" for c in names))
    mine = lambda df: Counter(tuple(r[c] for c in names) for r in df.collect())
    whole = mine(docs)
    near, cut, mixed = (f(spark, docs, "") for f in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.cut_repeats, corpus_pipeline.mix_sources))
    assert corpus_pipeline.identify_language(spark, docs, "").columns == docs.columns == near.columns == cut.columns
    assert mine(near) <= whole and sum(mine(near).values()) == 3 and mine(cut) <= whole
    mixed.write.parquet(str(tmp_path / "mixed"))
    back = spark.read.parquet(str(tmp_path / "mixed"))
    assert back.columns == [*docs.columns, "copy__"] and set(mine(back)) <= set(whole)
    encoded = corpus_pipeline.encode_pieces(spark, back, "")
    assert encoded.count() == back.count() and encoded.where("not lossless").count() == 0
