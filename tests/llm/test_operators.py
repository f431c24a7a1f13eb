"""Small tables with nulls, empty and repeated texts, ties and clashing extra columns, held against brute force."""

import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from quantlake.llm.common import Workspace
from quantlake.llm import hmm, language, minhash, mixing, pieces, quality, rules, suffixes, vectors, warc

LONG = " ".join(f"word{i % 37}x{i % 11}" for i in range(400))
OTHER = " ".join(f"other{i % 41}y{i % 13}" for i in range(300))
TEXTS = [None, "", " \n ", "one", "a b c d", LONG, LONG, LONG + " end", OTHER, OTHER.upper(), "▁ é😀 " + OTHER[:400], "12 34 ###", OTHER[50:500] + LONG[:300]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "fr", None if i % 3 == 0 else f"s{i % 3}", -1, "clash", 0.5) for i, t in enumerate(TEXTS)]
    rows += [(5, LONG, "en", "s2", -1, "clash", 0.5), (None, LONG, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string, score double")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_mixing(spark, docs, none):
    rows = mixing.mix(spark, docs, block=16).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert sorted(rows, key=str) == sorted(mixing.mix(spark, docs, block=16).collect(), key=str)
    taken, target = Counter(), {}
    for r in rows:
        taken[r["target"]] += r["taken"]
        target[r["target"]] = r["target"]
    assert all(abs(taken[t] - t) < 1 for t in target)
    assert mixing.mix(spark, none).count() == 0


def test_mixing_of_repeated_rows(spark):
    """A row for each row, sizes, source sizes and targets as by hand, with hot copies and rows without words or id."""
    from fractions import Fraction

    rows = [(1, None, "a"), (1, None, "a"), (1, "", "a"), (1, " ", "a"), (None, "", "b"), (None, "", "b"), (None, None, None), (None, "x y", "b"), (None, "x y", "b")]
    rows += [(7, "one two three", "\U0001f600")] * 2500 + [(i, "w " * (i % 9), "\uffee") for i in range(300)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, copy string").repartition(5)
    have = mixing.mix(spark, docs).collect()
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    order = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(size(t) for _, t, s in rows if s == o) for o in order]
    want, left, free = {}, Fraction(3, 2) * sum(sizes), list(range(len(order)))
    while free:
        share = {i: left * (3, 1, 2)[i % 3] / sum((3, 1, 2)[j % 3] for j in free) for i in free}
        over = [i for i in free if share[i] > 2 * sizes[i]]
        for i in over or free:
            want[i] = Fraction(2 * sizes[i]) if over else share[i]
        left, free = (left - sum(want[i] for i in over), [i for i in free if i not in over]) if over else (0, [])
    facts = {o: (sizes[i], float(want[i])) for i, o in enumerate(order)}
    assert Counter((r["doc_id"], r["size"], r["source_size"], r["target"]) for r in have) == Counter((d, size(t), *facts[s]) for d, t, s in rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in have)
    taken = Counter()
    for r in have:
        taken[(r["source_size"], r["target"])] += r["taken"]
    assert all(t - 1 < taken[(n, t)] <= t for n, t in facts.values() if t)


def test_mixture_is_the_schedule(spark):
    """The mixed stream against the schedule played slot by slot: whose turn it is, and which words of which document."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(5 + i * 7 % 40)), "abc"[i % 3]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed, parts = mixing.mixture(spark, docs, block=16)
    streams, quota = {}, {}
    for r in sorted(placed.collect(), key=lambda r: (r["k"], r["start"])):
        assert r["start"] == len(streams.setdefault(r["k"], []))
        streams[r["k"]] += [(r["doc_id"], j) for j in range(r["size"])]
        quota[r["k"]] = int(r["target"])
    edges = np.cumsum([0, *(quota[k] for k in sorted(quota))]) / sum(quota.values())
    want, rank, slot = [], dict.fromkeys(streams, 0), 0
    taken = dict.fromkeys(streams, 0)
    while any(taken[k] < quota[k] for k in streams):
        point = int(f"{slot:040b}"[::-1], 2) / 2**40
        k = int(np.searchsorted(edges, point, "right") - 1)
        blocks = -(-len(streams[k]) // 16)
        at = rank[k] % blocks * 16
        words = streams[k][at : at + 16][: max(0, quota[k] - taken[k])]
        rank[k] += 1
        taken[k] += len(words)
        want += [(slot, *w) for w in words]
        slot += 1
    have = [(r["slot"], r["doc_id"], r["first"] + j) for r in sorted(parts.collect(), key=lambda r: (r["slot"], r["place"])) for j in range(r["length"])]
    assert have == want


def test_language(spark, docs, none):
    model = language.fit(spark, docs)
    found = {(r["doc_id"], r["lang_pred"]) for r in language.identify(spark, docs, model).collect()}
    assert {(0, "und"), (1, "und"), (2, "und"), (11, "und")} <= found
    assert language.words_of("½ ² ① Ⅳ x²y Été") == ["x", "y", "été"] and language.Scorer(model).predict("½ ² ①") == ("und", 0.0)
    assert language.identify(spark, docs, language.fit(spark, none)).where("lang_pred <> 'und'").count() == 0
    assert language.identify(spark, none, model).count() == 0


def test_language_keeps_small_languages(spark):
    """A large language with 45,000 words, and a small one whose words are rare and made of the same letters."""
    rng = np.random.default_rng(5)
    words = sorted({"".join(rng.choice(list("abcdefgh"), 8)) for _ in range(46_000)})
    rng.shuffle(words)
    small, large = words[:400], words[400:]
    rows = [(" ".join(large[i : i + 100]), "en") for _ in range(2) for i in range(0, len(large), 100)]
    rows = [(f"{t} {'x' * (k % 7 + 1)}", lang) for k, (t, lang) in enumerate(rows)] + [(" ".join(small[i : i + 10]), "es") for i in range(0, 400, 10)]
    model = language.fit(spark, spark.createDataFrame(rows, "text string, lang string"))
    scorer = language.Scorer(model)
    assert all(scorer.predict(w)[0] == "es" for w in small)
    assert all(scorer.predict(w)[0] == "en" for w in large[:2000])


def test_language_learns_every_gram(spark):
    words = ["a", "häuser", "straße", "été", "𝒜bc"]
    model = language.fit(spark, spark.createDataFrame([(" ".join(words), "xx")], "text string, lang string"))
    scorer = language.Scorer(model)
    for n in range(1, 5):
        grams = {g for w in words for g in language.grams_of(w, n)}
        assert len(model.hashes[n]) == len(grams) == len(scorer.known(sorted(grams), n))


def test_language_samples_each_language(spark):
    rows = [(f"common{i % 50} other{i % 70}", "en") for i in range(4000)] + [(f"rare{chr(97 + i)}", "es") for i in range(20)]
    used = language.sampled(Workspace(spark, "test"), spark.createDataFrame(rows + rows, "text string, lang string"), 100).collect()
    assert sorted(r["text"] for r in used if r["lang"] == "es") == sorted(t for t, lang in rows if lang == "es")
    assert len({r["text"] for r in used}) == len(used) and 50 <= sum(r["lang"] == "en" for r in used) <= 150


@pytest.mark.parametrize("dropout", [0.0, 0.1])
def test_pieces(spark, docs, none, dropout):
    import sentencepiece

    coder, sp = pieces.Pieces(pieces.VOCABULARY, dropout, 3), sentencepiece.SentencePieceProcessor(model_file=pieces.VOCABULARY)
    for text in filter(None, TEXTS):
        ids = coder.encode(text, 7)
        assert coder.decode(ids) == text
        if not dropout and "▁" not in text:
            assert ids.tolist() == sp.encode(text)
    assert pieces.encode(spark, docs).where("not lossless").count() == 0
    assert pieces.encode(spark, none).count() == 0


def plain_agenda(coder, unit, key):
    """The agenda one merge at a time, on strings; returns the parts."""
    parts, starts, gone = list(unit), list(range(len(unit) + 1)), set()
    while True:
        offers = [(coder.rank[x], i) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) in coder.rank and (starts[i], starts[i + 2]) not in gone]
        if not offers:
            return parts
        i = min(offers)[1]
        if coder.below and coder.skips(key, starts[i], starts[i + 2]):
            gone.add((starts[i], starts[i + 2]))
            continue
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del starts[i + 1]


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.6])
def test_pieces_side_by_side_by_heap_and_one_by_one(dropout):
    """Units below and above the bound of the two ways, in texts that are cut into chunks and not."""
    coder, heap = (pieces.Pieces(pieces.VOCABULARY, dropout, 3, short=n) for n in (pieces.SHORT, 0))
    words = "internationalization the naïve Straße 日本語 x y zz 1234567 aaaaaaaaaaaaaaaa".split()
    long = ["ab" * n for n in (23, 24, 25, 40)] + ["straßen" * 30]
    texts = [" ".join(words * 9), "\n\n ".join(words), "  ▁▁ ".join(words), " ".join(long), "", " ", "▁", "\n"]
    keys = np.arange(len(texts), dtype=np.uint64) * np.uint64(977)
    have = coder.encode_all(texts, keys)
    for text, key, ids in zip(texts, keys, have, strict=True):
        assert ids.tolist() == heap.encode(text, int(key)).tolist()
        assert coder.decode(ids) == text
    for text, key in zip(texts[:2] + texts[3:4], (0, 977, 3 * 977), strict=True):
        units = re.findall(r"\n|▁+[^▁\n]*|[^▁\n]+", "▁" + text.replace(" ", "▁"))
        unit_keys = coder.unit_keys(np.full(len(units), key, np.uint64), np.arange(len(units)))
        want = [i for u, k in zip(units, unit_keys.tolist(), strict=True) for p in plain_agenda(coder, u, k) for i in ([coder.ids[p]] if p in coder.ids else coder.byte_ids[list(p.encode())].tolist())]
        assert coder.encode(text, key).tolist() == want


def test_pieces_of_a_very_long_text(monkeypatch):
    coder = pieces.Pieces(pieces.VOCABULARY, 0.1, 3)
    text = "".join(f"word{i % 101} {'  ' if i % 7 == 0 else ''}{chr(10) if i % 11 == 0 else ''}" for i in range(60_000)) + "z" * 3000
    whole = coder.encode(text, 5)
    monkeypatch.setattr(pieces, "CHUNK", 10_000)
    assert (coder.encode(text, 5) == whole).all() and coder.decode(whole) == text


def test_pieces_draw_every_occurrence(spark):
    coder = pieces.Pieces(pieces.VOCABULARY, 0.1, 3)
    ids = coder.encode(" internationalization" * 3000, 7)
    assert len(set(coder.decode(ids).split())) == 1
    begins = np.flatnonzero(np.isin(ids, [i for p, i in coder.ids.items() if p.startswith("▁")]))
    assert len({tuple(x.tolist()) for x in np.split(ids, begins[1:])}) > 8
    rows = [(1, 1, LONG), (1, 2, LONG), (None, 1, LONG), (None, 1, OTHER), (1, 1, LONG)]
    docs = spark.createDataFrame(rows, "doc_id long, copy int, text string")
    encoded = pieces.encode(spark, docs.coalesce(1), copy="copy").collect()
    assert len({tuple(r["ids"]) for r in encoded}) == 4
    back = pieces.decode(spark, pieces.encode(spark, docs, copy="copy")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter((r[0], r[2]) for r in rows)


def brute_components(texts):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    name = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    name[i] = name[j] = min(name[i], name[j])
    return {i: (len(sets[i]), name[i]) for i in sets}


def test_minhash(spark, docs, none):
    rows = minhash.near_duplicates(spark, docs).collect()
    assert len(rows) == docs.count()
    want = brute_components(list(enumerate(TEXTS)))
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert minhash.near_duplicates(spark, none).count() == 0


def brute_passages(rows):
    first = {}
    for i, b in rows:
        for s in range(len(b) - 49):
            first[b[s : s + 50]] = min(i, first.get(b[s : s + 50], i))
    out = {}
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 49):
            gone[s : s + 50] |= first[b[s : s + 50]] < i
        out[i] = (len(b), int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_suffixes(spark, docs, none):
    rows = suffixes.without_repeats(spark, docs, digest=True).collect()
    assert len(rows) == docs.count()
    want = brute_passages([(i, (t or "").encode()) for i, t in enumerate(TEXTS)])
    assert all((r["n_bytes"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]] for r in rows if r["doc_id"] is not None)
    assert next(r for r in rows if r["doc_id"] is None)["n_removed"] == len(LONG)
    assert suffixes.without_repeats(spark, none).count() == 0


@pytest.mark.parametrize("hot", [suffixes.HOT, 1])
def test_suffixes_of_rows_that_share_or_lack_an_id(spark, monkeypatch, hot):
    """Against brute force over rows: only a smaller id takes bytes away, null is larger than the largest long."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    rng = np.random.default_rng(4)
    say = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    shared = [say(70) for _ in range(3)]
    texts = [say(rng.integers(0, 60)) + shared[k % 3][k % 11 :] + say(rng.integers(0, 60)) for k in range(24)]
    ids = [None if k % 3 == 0 else [5, 5, -(2**63), 2**63 - 1, 9][k % 5] for k in range(24)]
    rows = list(zip(ids, texts, strict=True)) + [(None, texts[0])] * 5 + [(5, texts[1])] * 3 + [(None, None), (None, "")]
    order = lambda i: (i is None, i or 0)
    first, want = {}, Counter()
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - 49):
            first[b[s : s + 50]] = min(order(i), first.get(b[s : s + 50], order(i)))
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 49):
            gone[s : s + 50] |= first[b[s : s + 50]] < order(i)
        want[(i, len(b), int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = suffixes.without_repeats(spark, df, digest=True).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in found) == want


def test_suffixes_of_a_hot_passage(spark, monkeypatch):
    """One q-gram in many contexts, some of which share more, with the bound of a task at 2."""
    monkeypatch.setattr(suffixes, "HOT", 2)
    shared = " ".join(f"common{i}" for i in range(12))
    rows = [(i, f"{'lead' * (i % 3)} {OTHER[i * 7 : i * 7 + 60]} {shared} {LONG[(i % 5) * 40 : (i % 5) * 40 + 70]} {i * 7919}") for i in range(40)]
    have = suffixes.without_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"), digest=True, buckets=3).collect()
    want = brute_passages([(i, t.encode()) for i, t in rows])
    assert all((r["n_bytes"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]] for r in have)


def test_suffixes_of_a_very_long_text(spark):
    long = " ".join(str(i * i) for i in range(200_000))
    have = suffixes.without_repeats(spark, spark.createDataFrame([(2, long[5000:900_000] + "x"), (1, long)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in have} == {1: (0, 0), 2: (895_000, 1)}


def test_refine_ignores_what_lies_beyond_a_text():
    rows = np.full((2, suffixes.CONTEXT), 256, np.uint16)
    rows[:, 10:70] = 65
    bits = suffixes.refine(rows, np.array([1, 2]), np.array([0, 0]))
    assert bits[0] == 0 and bits[1] == sum(1 << o for o in range(10, 21))


def test_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 8))
    near = base[:20] + rng.normal(size=(20, 8)) * 0.05
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(np.vstack([base, near, base[:3]]))]
    odd = [(100, None, 0), (101, [0.0] * 8, 0), (102, [float("nan")] * 8, 0), (103, rows[0][1], None), (None, rows[0][1], 0), (104, [1.0, None], 1), (105, [], 1)]
    df = spark.createDataFrame([(*r, 9) for r in rows + odd], "vec_id long, embedding array<double>, label int, n_links int")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(spark, df).collect()}
    assert len(found) == len(rows) + len(odd)
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = (x @ x.T >= 0.98) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows]))
    np.fill_diagonal(linked, False)
    name = np.arange(len(rows))
    for _ in rows:
        name = np.minimum(name, np.where(linked, name, len(rows)).min(1))
    assert all(found[i] == (linked[i].sum(), name[i]) for i in range(len(rows)))
    assert all(found[i] == (0, i) for i in range(100, 106)) and found[None] == (0, None)
    assert vectors.near_duplicates(spark, df.limit(0)).count() == 0


@pytest.mark.parametrize("recall", [0.9999, 1.0])
def test_vectors_recall(recall):
    """Pairs just above the threshold, in random and in clustered vectors: whether one visits the other's cell."""
    rng = np.random.default_rng(4)
    x = vectors.unit(np.vstack([rng.normal(size=(3000, 32)), rng.normal(size=(30, 32)).repeat(100, 0) + 0.3 * rng.normal(size=(3000, 32))]))
    away = rng.normal(size=x.shape)
    away = vectors.unit(away - (away * x).sum(1, keepdims=True) * x)
    y = 0.981 * x + np.sqrt(1 - 0.981**2) * away
    books = vectors.codebooks(list(x), 24, 0.98, recall)[32]
    i, j, row, to_i, to_j = vectors.visits(np.vstack([x, y]), books)
    visited = set(zip(row.tolist(), to_i.tolist(), to_j.tolist(), strict=True))
    n = len(x)
    met = [(k, i[n + k], j[n + k]) in visited or (n + k, i[k], j[k]) in visited for k in range(n)]
    assert np.mean(met) >= (0.999 if recall < 1 else 1.0)
    assert len(row) < 2 * n * 24 * 24 * (0.2 if recall < 1 else 1)


def test_traversal_is_in_order():
    rng = np.random.default_rng(2)
    a, b = rng.random((5, 7)), rng.random((5, 6))
    row, i, j = vectors.traversal(a, b, 0.8)
    want = sorted((k, a[k, p] + b[k, q], p, q) for k in range(5) for p in range(7) for q in range(6) if a[k, p] + b[k, q] <= 0.8)
    assert [(k, p, q) for k, _, p, q in want] == list(zip(row.tolist(), i.tolist(), j.tolist(), strict=True))


def test_language_model(spark, docs, none):
    texts = [np.array([1, 2, 0]), np.array([4]), np.array([3, 3, 1, 0])]
    chain = hmm.Chain.initial(3, np.ones(5) / 5, 0)
    for text, log in zip(texts, hmm.forward(chain, hmm.Lanes(texts), False)[0], strict=True):
        alpha = chain.start * chain.emit[text[0]]
        for s in text[1:]:
            alpha = (alpha @ chain.step) * chain.emit[s]
        assert abs(np.log10(alpha.sum()) - log) < 1e-12
    starts, steps, emits, _ = hmm.expected(chain, hmm.Lanes(texts))
    assert np.allclose([starts.sum(), steps.sum(), emits.sum()], [3, 5, 8])
    # Posterior counts by enumeration of all state paths, and the same in parts of two tokens.
    want = np.zeros(3 + 9 + 15)
    for text in texts:
        paths = list(itertools.product(range(3), repeat=len(text)))
        p = [chain.start[z[0]] * np.prod([chain.step[a, b] for a, b in itertools.pairwise(z)]) * np.prod([chain.emit[s, k] for s, k in zip(text, z, strict=True)]) for z in paths]
        for z, w in zip(paths, np.array(p) / sum(p), strict=True):
            want[z[0]] += w
            for a, b in itertools.pairwise(z):
                want[3 + 3 * a + b] += w
            for s, k in zip(text, z, strict=True):
                want[12 + 3 * s + k] += w
    assert np.allclose(hmm.expected_counts(chain, texts), want) and np.allclose(hmm.expected_counts(chain, texts, 2), want)
    assert np.allclose(hmm.log_likelihoods(chain, texts), hmm.log_likelihoods(chain, texts, 2))
    out = hmm.score(spark, docs.selectExpr("doc_id", "text", "doc_id = 5 AND doc_id IS NOT NULL AS held_out").na.fill(False, ["held_out"])).collect()
    assert len(out) == docs.count() and all(r["score"] < 0 for r in out)
    assert hmm.score(spark, none.selectExpr("doc_id", "text", "true AS held_out")).count() == 0


def test_quality_and_rules(spark, docs, none):
    labels = spark.createDataFrame([(5, 1), (8, 1), (11, 0), (3, 0), (3, None)], "doc_id long, y int")
    out = quality.classify(spark, docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert quality.classify(spark, none, labels).count() == 0
    model = quality.fit(spark, spark.createDataFrame([([0.0] * len(quality.STATISTICS), 1.0)], "stats array<double>, y double").limit(0))
    assert model.score(np.zeros((2, len(quality.STATISTICS)))).tolist() == [0.5, 0.5]
    judged = rules.judge(spark, docs, labels.where("y = 1")).collect()
    assert len(judged) == docs.count() and not any(r["kept"] for r in judged if r["base_failed"])
    repeated = rules.base_rules("a b c x a b c\n\nz\nz", np.array([1, 2, 3, 9, 1, 2, 3, 7, 7], np.uint64))
    assert repeated[:5] == (9, 9, 0, 1, 6)
    assert rules.judge(spark, none, labels).count() == 0


def test_quality_against_plain_ridge_and_isotonic(spark):
    """The normal equations summed by partition against one solve, and the levels against the best monotone fit by bins."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, len(quality.STATISTICS)))
    y = (x[:, 0] + 0.5 * rng.normal(size=300) > 0).astype(float)
    model = quality.fit(spark, spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y, strict=True)], "stats array<double>, y double").repartition(5))
    z = model.features(x)
    want = np.linalg.solve(z.T @ z + 1e-3 * 300 / z.shape[1] * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(z @ model.weights, z @ want, atol=1e-6)
    scores = model.score(x)
    assert (np.diff(scores[np.argsort(model.raw(x))]) >= -1e-12).all() and abs(scores.mean() - y.mean()) < 0.05
    assert np.mean((scores - y) ** 2) < 0.15


def plain_base(text):
    words = (text or "").split()
    lines = [x for x in (text or "").split("\n") if x.strip()]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


def test_rules_against_brute_force(spark):
    """Base counts, the ratio of every document, and the threshold, in plain Python."""
    rng = np.random.default_rng(7)
    good, bad = [f"good{i}" for i in range(300)], [f"bad{i}" for i in range(300)]
    texts = [" ".join(rng.choice(good if i % 3 else bad, 60 + i)) + "\n# again\n# again" for i in range(60)] + [None, "", "a b", "x y z " * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    trusted = [i for i in range(60) if i % 3 and i % 5]
    rows = {r["doc_id"]: r for r in rules.judge(spark, docs, spark.createDataFrame([(i,) for i in trusted], "doc_id long"), spread=2.0).collect()}
    grams = {i: rules.ngram_buckets(np.array([xxhash.xxh64_intdigest(w) for w in (t or "").encode().split()], np.uint64), 1 << 18).tolist() for i, t in enumerate(texts)}
    every, kept = Counter(g for x in grams.values() for g in x), Counter(g for i in trusted for g in grams[i])
    n = [sum(c.values()) + 0.5 * (1 << 18) for c in (kept, every)]
    llr = {i: float(np.mean([np.log((kept[g] + 0.5) / n[0]) - np.log((every[g] + 0.5) / n[1]) for g in x])) if x else 0.0 for i, x in grams.items()}
    base = {i: plain_base(t) for i, t in enumerate(texts)}
    seen = [llr[i] for i in trusted if not base[i][5]]
    least = np.mean(seen) - 2 * np.std(seen)
    for i, r in rows.items():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base[i]
        assert abs(r["llr"] - llr[i]) < 1e-6 and r["kept"] == (not base[i][5] and llr[i] >= least - 1e-9)
    assert any(not r["kept"] and not r["base_failed"] for r in rows.values())


def test_language_model_base_figures(spark, docs):
    """base_score, n_known, train_tokens by plain counting."""
    found = hmm.score(spark, docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).selectExpr("doc_id", "text", "doc_id % 3 = 1 AS held_out")).collect()
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in enumerate(TEXTS)}
    counts = Counter(w for i, x in tokens.items() if i % 3 != 1 for w in x)
    n, v = sum(counts.values()), len(counts)
    for r in found:
        x = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(x), sum(counts[w] > 0 for w in x), n)
        assert abs(r["base_score"] - sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in x)) < 1e-6


def test_minhash_recall(spark):
    """Pairs around the threshold, links held against exact Jaccard over all pairs."""
    rng = np.random.default_rng(11)
    texts = []
    for i in range(250):
        words = [f"t{i}w{j}" for j in range(80)]
        texts.append(" ".join(words))
        for cuts in (1, 2, 3):
            other = list(words)
            for at in rng.choice(80, cuts, replace=False):
                other[at] = f"new{rng.integers(1 << 40)}"
            texts.append(" ".join(other))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    have = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark, docs).collect()}
    for i in range(0, len(texts), 4):
        want = brute_components(list(enumerate(texts[i : i + 4])))
        assert {k: c - i for k, c in ((k - i, have[k]) for k in range(i, i + 4))} == {k: c for k, (_, c) in want.items()}


def test_warc(spark, tmp_path):
    html = ["x" * 1500, "x" * 1500, None, "", "WARC/1.1\r\n\r\nWARC/1.1 é", "x" * 1500, "short", "short"]
    pages = spark.createDataFrame([(i, f"http://www.b{i % 2}.example/p?b=2&a={i}" if i else None, h, "clash") for i, h in enumerate(html)], "page_id long, url string, html string, digest string")
    history = warc.capture_history(spark, pages, str(tmp_path / "out"))
    rows = history.collect()
    assert [warc.order_of(tuple(r)) for r in rows] == sorted(warc.order_of(tuple(r)) for r in rows)
    assert all(r["intact"] for r in rows) and len(rows) == len(html)
    by_id = {r["page_id"]: r for r in rows}
    assert [(by_id[i]["record_type"], by_id[i]["refers_to"]) for i in (0, 1, 5, 6, 7)] == [("revisit", 5), ("revisit", 5), ("response", None), ("response", None), ("response", None)]
    for i, h in enumerate(html):
        assert by_id[i]["payload_digest"] == hashlib.sha1((h or "").encode()).hexdigest()
    assert warc.capture_history(spark, pages.limit(0), str(tmp_path / "none")).count() == 0


def test_warc_of_ids_of_any_size(spark, tmp_path):
    """Extreme, negative, null and repeated ids: all dates are of four digits and in order, and revisits name exact ids."""
    ids = [2**63 - 1, -(2**63), 10**15, 4 * 10**11, -1, 0, None, None, 2**53 + 1, 2**53 + 1, 10**15]
    rows = [(i, "http://x.example/", "y" * 1200 if k % 2 else "z" * (3 * k)) for k, i in enumerate(ids)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = warc.capture_history(spark, pages, str(tmp_path / "out")).collect()
    assert [warc.order_of(tuple(r)) for r in found] == sorted(warc.order_of(tuple(r)) for r in found)
    assert all(re.fullmatch(r"20\d\d-\d\d-\d\dT\d\d:\d\d:\d\dZ", r["captured"]) and r["intact"] for r in found)
    top = max(i for i, _, h in rows if i is not None and len(h) >= 1000)
    want = Counter((i, len(h), "revisit" if len(h) >= 1000 and i != top else "response", top if len(h) >= 1000 and i != top else None) for i, _, h in rows)
    assert Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in found) == want


def test_runs_in_pieces_are_merged_without_sorting(spark):
    """Runs that arrive cut up and out of order are merged into one order."""
    entry = lambda key, page, file, at: (key, "2024-01-01T00:00:00Z", page, "response", None, 0, "", file, at, 1, True)
    entries = [entry(f"k{i * 7 % 50:02d}", i, f"f{i % 3}", i) for i in range(200)]
    index = spark.createDataFrame(entries, warc.INDEX).repartition(4)
    got = [tuple(r) for r in warc.merge_runs(index).collect()]
    assert got == sorted(entries, key=warc.order_of)


def test_ids_beyond_doubles_stay_exact_beside_nulls(spark):
    """Ids of 64 bits, some null, come back as they are from every operator that reads texts in Python."""
    ids = [None, 2**63 - 1, -(2**63), 2**53 + 1, 2**53 + 3, None, 1]
    rows = [(i, f"{LONG} {OTHER} number {k}") for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    trusted = spark.createDataFrame([(2**53 + 1,), (None,)], "doc_id long")
    want = Counter(ids)
    found = {
        "hmm": hmm.score(spark, docs.selectExpr("*", "doc_id = 1 as held_out").na.fill({"held_out": False})),
        "pieces": pieces.encode(spark, docs, digest=True),
        "rules": rules.judge(spark, docs, trusted),
        "minhash": minhash.near_duplicates(spark, docs),
        "suffixes": suffixes.without_repeats(spark, docs),
    }
    for name, out in found.items():
        assert Counter(r["doc_id"] for r in out.collect()) == want, name


def test_suffixes_settle_hot_passages_inside_a_task(spark, monkeypatch):
    """Of the contexts that a task compares, a repeated passage goes on as a row of its least document alone; results as by brute force."""
    import pandas as pd

    passage = "a passage of some sixty bytes that occurs in many texts, again"
    texts = [f"{i:05d} {'xyz'[i % 3] * (i % 7)} {passage} {i * 7919:06d}" for i in range(60)]
    at = [t.encode().index(b"sixty bytes that") for t in texts]
    pad = b"\0" * suffixes.CONTEXT
    contexts = [(pad + t.encode() + pad)[suffixes.CONTEXT - suffixes.BEFORE + k :][: suffixes.CONTEXT] for t, k in zip(texts, at, strict=True)]
    frame = pd.DataFrame({"h": 1, "share": 0, "doc": range(60), "row": range(60), "at": at, "size": [len(t.encode()) for t in texts], "context": contexts})
    found = pd.concat(suffixes.passages_of(iter([frame[:25], frame[25:]])))
    shared = found[(found["bits"] == 0) & found.duplicated(["p1", "p2"], keep=False)]
    assert not len(shared) and set(found.loc[found["bits"] != 0, "doc"]) == set(range(1, 60))
    for name, value in {"HOT": 2, "SHARE": 3, "TOGETHER": 4}.items():
        monkeypatch.setattr(suffixes, name, value)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    have = {r["doc_id"]: r["n_removed"] for r in suffixes.without_repeats(spark, df, digest=True, buckets=3).collect()}
    want = {}
    for i, t in enumerate(texts):
        earlier = {u[k : k + 50] for u in texts[:i] for k in range(len(u) - 49)}
        gone = {k + j for k in range(len(t) - 49) if t[k : k + 50] in earlier for j in range(50)}
        want[i] = len(gone)
    assert have == want


@pytest.mark.parametrize("kind", ["line", "mixed"])
def test_suffixes_halve_a_hot_q_gram(spark, monkeypatch, kind):
    """Contexts of a hot q-gram become a few rows, not one a passage; results as by brute force, with texts that end inside a context."""
    made = Counter()

    def counted(self, df, name, compression="snappy"):
        out = save(self, df, name, compression)
        made[name] += out.count()
        return out

    save = suffixes.Workspace.save
    monkeypatch.setattr(suffixes.Workspace, "save", counted)
    monkeypatch.setattr(suffixes, "HOT", 8)
    rng = np.random.default_rng(6)
    say = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    if kind == "line":
        line = say(90)
        texts = [say(40) + line + say(40) for _ in range(200)]
    else:
        gram, tails = say(16), [say(40) for _ in range(6)]
        texts = [say(k % 50) + tails[k % 5][: k % 37] + gram + tails[k % 6][: k % 41] + (say(30) if k % 4 else "") for k in range(300)]
        texts += ["the " * (12 + k % 20) + say(k % 23) for k in range(60)] + [say(k) + "e" * 70 + say(9) for k in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    have = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in suffixes.without_repeats(spark, df, digest=True, buckets=3).collect()}
    assert have == brute_passages([(i, t.encode()) for i, t in enumerate(texts)])
    assert kind != "line" or (made["halves"] <= 6 * made["cuts"] and made["passages"] <= 5 * made["cuts"]), made


def test_halves_of_a_context():
    import pandas as pd

    context = (b"\0" * suffixes.CONTEXT + b"q" * 60 + b"\0" * suffixes.CONTEXT)[suffixes.CONTEXT + 30 - suffixes.BEFORE :][: suffixes.CONTEXT]
    frame = pd.DataFrame({"h": 1, "doc": 1, "row": 1, "at": 30, "size": 60, "context": [context], "low": 0, "high": suffixes.BEFORE})
    halves = pd.concat(suffixes.halved(iter([frame])))
    assert dict(zip(halves["low"], halves["bits"], strict=True)) == {18: sum(1 << suffixes.BEFORE - k for k in range(20, 31))}
