"""Quality rules, and the likelihood ratio of hashed n-grams between trusted documents and all documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantlake.llm.common import WordHashes, Workspace, added_up, as_long, id_text, ngram_hashes, packed, small_batches

SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\r\x0b\x0c"
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def ngram_buckets(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of all words and word pairs of a text."""
    return (np.concatenate([ngram_hashes(hashes, 1), ngram_hashes(hashes, 2)]) % np.uint64(buckets)).astype(np.int64)


def base_rules(text: str, hashes: np.ndarray) -> tuple[int, int, int, int, int, bool]:
    n = len(hashes)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    covered = 0
    if n >= 4:
        windows = ngram_hashes(hashes, 3)
        order = np.sort(windows)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            again = np.isin(windows, twice)
            marks = np.zeros(n, bool)
            for k in range(3):
                marks[k : n - 2 + k] |= again
            covered = int(marks.sum())
    return (
        n, len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), covered,
        n < 50 or 100 * covered > 50 * n,
    )


def fit_ratio(spark: SparkSession, docs: DataFrame, trusted: DataFrame, *, buckets: int = 1 << 18) -> np.ndarray:
    """log(p_trusted / p_all) of each bucket, counted over all ``docs`` (doc_id, text) and those in ``trusted`` (doc_id).

    Each task sums its counts; the sums are added up in tasks, so the driver gets a few times the model's size.
    """
    small_batches(spark)
    # Texts move by id at every size, as they must once the ids are many; rows without an id never do.
    good = docs.select("doc_id", "text").join(trusted.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, total = WordHashes(), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch["text"]:
                np.add.at(total, ngram_buckets(words.of((text or "").encode().split()), buckets), 1)
        yield pd.DataFrame({"v": [packed(total)]})

    counts = np.array([added_up(rows.select("text").mapInPandas(count, "v binary"), buckets) for rows in (docs, good)]) + 0.5
    if counts[1].sum() == 0.5 * buckets:
        return np.zeros(buckets)
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def measure(spark: SparkSession, docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, the base counts, and llr: the mean log ratio over a text's words and word pairs (0 without words)."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(ratio)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, table = WordHashes(), shared.value
        for batch in batches:
            out = []
            for text in batch["text"]:
                text = text or ""
                hashes = words.of(text.encode().split())
                llr = float(table[ngram_buckets(hashes, len(table))].mean()) if len(hashes) else 0.0
                out.append((*base_rules(text, hashes), round(llr, 9)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in COLUMNS.split(", ")] + ["llr"]).assign(doc_id=batch["doc_id"])

    return as_long(docs.select(id_text(), "text").mapInPandas(work, f"{COLUMNS}, llr double, doc_id string"))


def judge(spark: SparkSession, docs: DataFrame, trusted: DataFrame, *, spread: float = 6.0) -> DataFrame:
    """doc_id, base counts, base_failed, llr and kept of every row of ``docs`` (doc_id, text).

    A document that passes the base rules is kept if its llr is at least the mean of the trusted documents that pass,
    less ``spread`` of their standard deviations; without trusted documents all such rows are kept. Null and empty texts
    have no words and fail the base rules. Repeated rows are judged alike, and an llr equal to the threshold is kept; null
    doc_ids are judged and never trusted. A very long text costs memory in proportion to it. An empty table gives an empty
    result; other columns are left out.
    """
    work = Workspace(spark, "rules")
    rows = work.save(measure(spark, docs, fit_ratio(spark, docs, trusted)), "measured")
    seen = rows.where("not base_failed").join(trusted.select("doc_id").distinct(), "doc_id", "left_semi")
    mean, sd = seen.agg(F.avg("llr"), F.stddev_pop("llr")).first()
    least = float("-inf") if mean is None else mean - spread * sd
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(least)))


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    names = ["doc_id", *(c.split()[0] for c in COLUMNS.split(", ")), "kept", "llr"]
    return judge(spark, docs, trusted).select(*names)
