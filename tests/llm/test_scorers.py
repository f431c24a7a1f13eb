"""Language scores and document statistics against plain Python."""

import math
from collections import Counter

import numpy as np
import pytest

from quantlake.llm import language, quality

LEARNED = [("the cat sat on the mat and the dog", "en"), ("a cat and a dog ran", "en"), ("le chat et le chien", "fr"), ("le chien mange la pomme", "fr"), ("der hund und die katze", "de"), ("die katze frisst", "de"), (None, "de"), ("no language", None)]
ASKED = ["the cat", "le chat mange", "katzen und hunde", "zzz qqq", "chiens", "", None, "12 ½ !!", "THE DOG; le chien", "ab " * 60_001, "a", "é", "cat chat katze", "dogdogdogdog"]


def plain_model():
    units = [Counter() for _ in range(5)]
    for text, lang in LEARNED:
        if text and lang:
            for w in language.words_of(text):
                units[0][w, lang] += 1
                for n in range(1, 5):
                    for g in language.grams_of(w, n):
                        units[n][g, lang] += 1
    return units


def plain_predict(units, text):
    languages = ["de", "en", "fr"]
    words = language.words_of(text) if text else []
    if not words:
        return "und", 0.0
    sizes = [len({u for u, _ in c}) for c in units]
    totals = [{x: sum(v for (_, k), v in c.items() if k == x) for x in languages} for c in units]
    log = lambda n, u, x: math.log(units[n][u, x] + 0.1) - math.log(totals[n][x] + 0.1 * (sizes[n] + 1))
    known = [{u for u, _ in c} for c in units]
    total = dict.fromkeys(languages, 0.0)
    for w, times in Counter(words).items():
        if w in known[0]:
            add = {x: log(0, w, x) for x in languages}
        else:
            found, n = [], 5
            while not found and n > 1:
                n -= 1
                found = [g for g in language.grams_of(w, n) if g in known[n]]
            add = {x: sum(log(n, g, x) for g in found) / len(found) if found else 0.0 for x in languages}
        for x in languages:
            total[x] += times * add[x]
    top = max(total.values())
    best = next(x for x in languages if total[x] == top)
    return best, 1 / sum(math.exp(v - top) for v in total.values())


def test_languages_are_those_of_a_plain_scorer(spark):
    docs = spark.createDataFrame([(i, t, x, "clash") for i, (t, x) in enumerate(LEARNED)], "doc_id long, text string, lang string, lang_pred string").repartition(3)
    model = language.fit(spark, docs)
    assert model.languages == ["de", "en", "fr"]
    asked = spark.createDataFrame(list(enumerate(ASKED)), "doc_id long, text string")
    units = plain_model()
    for r in language.identify(spark, asked, model).collect():
        lang, score = plain_predict(units, ASKED[r["doc_id"]])
        assert math.isclose(r["score"], score, abs_tol=1e-4), ASKED[r["doc_id"]]
        assert r["lang_pred"] == lang or math.isclose(score, 1 / 3, abs_tol=1e-4), ASKED[r["doc_id"]]


@pytest.mark.parametrize("text", ["", None, "one", "a b c. d e f! " * 50, "Line\nLine\nOther line\n\n", "###$$$ 123 456", "é " * 2000])
def test_statistics_are_finite_and_the_same_every_time(text):
    found = quality.statistics(text)
    assert len(found) == len(quality.STATISTICS) and np.isfinite(found).all() and list(found) == list(quality.statistics(text))
