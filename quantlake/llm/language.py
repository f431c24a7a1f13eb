"""Language identification by words, with a backoff to character n-grams for words that were not learned."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantlake.llm.common import Workspace, id_bucket, small_batches

UNDETERMINED = "und"
WORD = re.compile(r"[^\W\d_]+")


#: Spark's xxhash64.
SEED = 42


@dataclass
class LanguageModel:
    """Log frequencies by language: hashes[0] are those of whole words and hashes[n] of n-grams of ^word$, sorted; logs[n]
    has a row for each. A unit is its 64-bit hash, so a unit of one language costs 8 bytes and 4 for each language."""

    languages: list[str]
    hashes: list[np.ndarray]
    logs: list[np.ndarray]


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case. Signs that only count as numbers (½, ², Ⅳ) are no letters and end a word."""
    found = WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return "".join(c if c.isalpha() else " " for c in " ".join(found)).split()


def grams_of(word: str, n: int) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def grams_column(padded: Column, n: int) -> Column:
    """grams_of() for a padded word of n characters at least. F.transform would give a second argument the place."""
    return F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), lambda i: F.substr(padded, i, F.lit(n)))


def sampled(work: Workspace, docs: DataFrame, max_docs: int) -> DataFrame:
    """Distinct texts (text, lang), about ``max_docs`` of each language, or all if it has fewer, chosen by their hash, whose
    64 bits are compared as a fraction, so the share may be as small as a table of any size asks."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang", F.xxhash64("text").alias("h"))
    shares = rows.select("lang", "h").distinct().groupBy("lang").agg((F.lit(float(max_docs)) / F.count("*")).alias("below"))
    shares = work.save(shares, "shares")  # a row for each language: written, so that its size is known and no text moves
    some = rows.join(shares, "lang").where(F.col("h") / F.lit(2.0**64) + 0.5 < F.col("below"))
    return some.groupBy("lang", "h").agg(F.first("text").alias("text")).select("text", "lang")


def fit(spark: SparkSession, docs: DataFrame, *, max_docs: int = 20_000, order: int = 4) -> LanguageModel:
    """Learn from ``docs`` (text, lang), of which about ``max_docs`` distinct texts of each language are used.

    Every word of these and every n-gram up to ``order`` is in the model, whatever its frequency, so a large language does
    not push out the units of a small one. Rows without text or lang teach nothing. Each distinct lang costs a column of the
    model, so the column should hold languages.
    """
    small_batches(spark)
    work = Workspace(spark, "language")
    rows = sampled(work, docs, max_docs)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                for word, c in Counter(words_of(text)).items():
                    found[word, lang] += c
            if len(found) > 500_000:
                yield frame(found)
                found = Counter()
        if found:
            yield frame(found)

    def frame(found: Counter) -> pd.DataFrame:
        return pd.DataFrame({"word": [k[0] for k in found], "lang": [k[1] for k in found], "n": list(found.values())})

    counts = rows.mapInPandas(count, "word string, lang string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    counts = work.save(counts, "counts")
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    padded = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    parts = counts.select(F.col("word").alias("unit"), "lang", "n", F.lit(0).alias("size"))
    for k in range(1, order + 1):
        long_enough = counts.where(F.length(padded) >= k)
        parts = parts.unionByName(long_enough.select(F.explode(grams_column(padded, k)).alias("unit"), "lang", "n", F.lit(k).alias("size")))
    by_lang = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).cast("float").alias(f"n{i}") for i, lang in enumerate(languages)]
    totals = parts.groupBy("size", F.xxhash64("unit").alias("h")).agg(*by_lang) if languages else parts.select("size", F.xxhash64("unit").alias("h"))
    columns = [f"n{i}" for i in range(len(languages))]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, some in batch.groupby("size"):
                yield pd.DataFrame({"size": [size], "hashes": [some["h"].to_numpy().tobytes()], "counts": [some[columns].to_numpy(np.float32).tobytes()]})

    packed = work.save(totals, "totals").mapInPandas(pack, "size int, hashes binary, counts binary").collect()
    hashes, logs = [], []
    for k in range(order + 1):
        own = [r for r in packed if r["size"] == k]
        h = np.frombuffer(b"".join(r["hashes"] for r in own), np.int64)
        found = np.frombuffer(b"".join(r["counts"] for r in own), np.float32).reshape(len(h), len(languages))
        by_hash = np.argsort(h)
        hashes.append(h[by_hash])
        total = np.log(found.sum(0, dtype=float) + 0.1 * (len(h) + 1)).astype(np.float32)
        logs.append(np.log(found[by_hash] + np.float32(0.1)) - total)
    return LanguageModel(languages, hashes, logs)


class Scorer:
    """Sums log frequencies over words; remembers up to ``limit`` of the words that it met."""

    def __init__(self, model: LanguageModel, limit: int = 200_000) -> None:
        self.model = model
        self.table = np.zeros((limit, len(model.languages)), np.float32)
        self.forget()

    @staticmethod
    def of(model: LanguageModel) -> Scorer:
        """One for each model in a worker process, so tasks share the words met."""
        if not hasattr(model, "scorer"):
            model.scorer = Scorer(model)
        return model.scorer

    def forget(self) -> None:
        self.rows: dict[str, int] = {}

    def find(self, units: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of logs[n], and which of ``units`` they belong to; those that were not learned are left out."""
        hashes = self.model.hashes[n]
        if not len(hashes):
            return np.empty(0, int), np.empty(0, int)
        wanted = np.array([xxhash.xxh64_intdigest(u.encode(), SEED) for u in units], np.uint64).view(np.int64)
        at = np.searchsorted(hashes, wanted)
        at[at == len(hashes)] = 0
        there = np.flatnonzero(hashes[at] == wanted)
        return at[there], there

    def known(self, units: list[str], n: int) -> np.ndarray:
        return self.find(units, n)[0]

    def backoff(self, word: str) -> np.ndarray:
        for n in range(len(self.model.hashes) - 1, 0, -1):
            if (grams := grams_of(word, n)) and len(found := self.known(grams, n)):
                return self.model.logs[n][found].mean(0)
        return np.zeros(len(self.model.languages))

    def remember(self, words: list[str]) -> None:
        at, there = self.find(words, 0)
        start, learned = len(self.rows), set(there.tolist())
        self.rows.update(zip(words, range(start, start + len(words)), strict=True))
        self.table[start + there] = self.model.logs[0][at]
        for i, word in enumerate(words):
            if i not in learned:
                self.table[start + i] = self.backoff(word)

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not words or not self.model.languages:
            return UNDETERMINED, 0.0
        total = np.zeros(len(self.model.languages))
        for at in range(0, len(words), 50_000):  # a block never overfills the table
            block = words[at : at + 50_000]
            if len(self.rows) + len(block) > len(self.table):
                self.forget()
            if new := [w for w in dict.fromkeys(block) if w not in self.rows]:
                self.remember(new)
            total += self.table[[self.rows[w] for w in block]].sum(0, dtype=float)
        shares = np.exp(total - total.max())
        shares /= shares.sum()
        best = int(shares.argmax())
        return self.model.languages[best], float(shares[best])


def predictor(spark: SparkSession, model: LanguageModel):
    """A column function text -> struct(lang_pred, score). Null texts and texts without a letter get ``und`` and 0."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer.of(shared.value)
        for texts in batches:
            found = [scorer.predict(t) for t in texts]
            yield pd.DataFrame({"lang_pred": np.array([f[0] for f in found], object), "score": np.array([f[1] for f in found], float)})

    def column(text: Column) -> Column:
        return predict(text)

    return column


def identify(spark: SparkSession, docs: DataFrame, model: LanguageModel, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``docs``, lang_pred and score (posterior of the best language) for every whole text.

    A tie goes to the language first in order. Null texts and texts without a letter get ``und`` and score 0, as all do with
    a model that learned nothing. Very long texts are read in blocks of words. Repeated rows are scored alike; an empty
    table gives an empty result; other columns are left out unless named in ``keep``.
    """
    small_batches(spark)
    scored = docs.select(*keep, predictor(spark, model)(F.col("text")).alias("_language"))
    return scored.select(*keep, "_language.lang_pred", "_language.score")


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(id_bucket("doc_id", 3) != 1)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(spark, training_rows(docs))
    rows = docs.select("doc_id", "text", (id_bucket("doc_id", 3) == 1).alias("held_out"))
    return identify(spark, rows, model, keep=("doc_id", "held_out"))
