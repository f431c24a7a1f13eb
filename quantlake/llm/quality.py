"""A quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantlake.llm.common import Workspace, added_up, id_bucket, packed, small_batches

STATISTICS = (
    "log_words", "log_bytes", "word_bytes", "distinct_words", "line_words", "dup_lines", "upper", "digit", "symbol", "comma_stop",
    "other_punct", "space", "high", "top_byte", "entropy", "capital_words", "bare_words", "long_words", "repeat_words",
)
_CLASS = np.full(256, 7)
_CLASS[list(range(65, 91))] = 0
_CLASS[list(range(97, 123))] = 1
_CLASS[list(range(48, 58))] = 2
_CLASS[list(b"#*$%&|<>{}[]\\^~_=+@")] = 3
_CLASS[list(b".,;:!?")] = 4
_CLASS[list(b"'\"()-/`")] = 5
_CLASS[list(b" \t\n\r\x0b\x0c")] = 6
_CLASS[128:] = 8


def statistics(text: str | None) -> list[float]:
    """Shares and logarithms over the whole text; all zero for null and empty texts."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, size = len(words), len(raw)
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=bytes_, minlength=9) / size
    share = bytes_[bytes_ > 0] / size
    lines = [x for x in raw.split(b"\n") if x.strip()]
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    first = np.fromiter((w[0] for w in words), np.uint8, n)
    sizes = np.fromiter(map(len, words), np.int64, n)
    return [
        np.log1p(n), np.log1p(size), sizes.sum() / n, distinct / n, np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), kinds[0], kinds[2], kinds[3],
        kinds[4], kinds[5] + kinds[7], kinds[6], kinds[8], share.max(), -(share * np.log(share)).sum(), ((first >= 65) & (first <= 90)).mean(),
        (_CLASS[first] > 1).mean(), (sizes > 20).mean(), 1 - pairs / max(n - 1, 1),
    ]


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.directions + self.phases
        return np.hstack([np.sqrt(2 / len(self.phases)) * np.cos(z), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.round(np.interp(self.raw(x), self.edges, self.levels), 9)


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(-1, len(STATISTICS))


def document_statistics(spark: SparkSession, docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``stats`` (the values named in STATISTICS) of every row of ``docs``."""
    small_batches(spark)

    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: np.array(statistics(t)))

    return docs.select(*keep, stats("text").alias("stats"))


def fit(spark: SparkSession, rows: DataFrame, *, features: int = 256, width: float = 3.0, ridge: float = 1e-3, bins: int = 400, seed: int = 5) -> QualityModel:
    """Learn from ``rows`` (stats array<double>, y double in 0..1), all of them.

    Each partition sums its part of the normal equations; what reaches the driver has the size of the model. Isotonic
    calibration pools adjacent violators over ``bins`` equal steps of the raw score. Without rows every score is 0.5.
    """
    k, d = len(STATISTICS), features + 1
    rng = np.random.default_rng(seed)
    model = QualityModel(np.zeros(k), np.ones(k), rng.normal(size=(k, features)) / width, rng.uniform(0, 2 * np.pi, features), np.zeros(d), np.zeros(1), np.full(1, 0.5))
    sums = rows.select(F.count("*").alias("n"), *(f(F.col("stats")[i]).alias(f"{name}{i}") for i in range(k) for name, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if not sums["n"]:
        return model
    model.mean = np.array([sums[f"m{i}"] for i in range(k)])
    model.scale = np.array([sums[f"s{i}"] if sums[f"s{i}"] > 1e-9 else 1.0 for i in range(k)])

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d, d + 1))
        for batch in batches:
            z = model.features(matrix(batch["stats"]))
            total += z.T @ np.hstack([z, batch["y"].to_numpy(float)[:, None]])
        yield pd.DataFrame({"v": [packed(total[upper])]})

    upper = np.triu_indices(d, 0, d + 1)  # of the symmetric part one half, and the right side
    sums_ = added_up(rows.select("stats", "y").mapInPandas(equations, "v binary"), len(upper[0]))
    total = np.zeros((d, d + 1))
    total[upper] = sums_
    total[:, :d] += np.triu(total[:, :d], 1).T
    model.weights = np.linalg.solve(total[:, :d] + ridge * sums["n"] / d * np.eye(d), total[:, d])

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = np.clip(((model.raw(matrix(batch["stats"])) + 0.5) / 2 * bins).astype(int), 0, bins - 1)
            yield pd.DataFrame({"bin": at, "y": batch["y"].to_numpy(float)})

    points = rows.select("stats", "y").mapInPandas(binned, "bin int, y double").groupBy("bin").agg(F.sum("y"), F.count("*")).orderBy("bin").collect()
    pools: list[list[float]] = []
    for at, y, n in points:
        pools.append([y, n, at, at])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            y, n, _, last = pools.pop()
            pools[-1][0] += y
            pools[-1][1] += n
            pools[-1][3] = last
    middle = lambda at: (at + 0.5) * 2 / bins - 0.5
    model.edges = np.array([middle(at) for p in pools for at in (p[2], p[3])])
    model.levels = np.repeat([p[0] / p[1] for p in pools], 2)
    return model


def score(spark: SparkSession, stats: DataFrame, model: QualityModel, keep: tuple[str, ...]) -> DataFrame:
    """``keep``, score (0 to 1) and predicted (1 if score >= 0.5) of every row of document_statistics()."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(column: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(matrix(column)))

    return stats.select(*keep, scores("stats").alias("score")).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, train: str = "true") -> DataFrame:
    """Score every row of ``docs`` (doc_id, text), learning from those where ``train`` holds that ``labels`` (doc_id, y) marks.

    Several labels of one document count as their mean, null labels not at all, and null doc_ids match no label.
    Repeated rows are scored alike, and equal raw scores get one level. Null texts count as empty; empty texts are scored from
    what empty training texts show. A very long text costs memory in proportion to it. Without labels every score is 0.5;
    an empty table gives an empty result; other columns are left out.
    """
    work = Workspace(spark, "quality")
    stats = work.save(document_statistics(spark, docs.withColumn("_train", F.expr(train)), ("doc_id", "_train")), "statistics")
    y = labels.where("y is not null").groupBy("doc_id").agg(F.avg("y").alias("y"))
    rows = work.save(stats.where("_train").join(y, "doc_id").select("stats", F.col("y").cast("double").alias("y")), "training")
    return score(spark, stats, fit(spark, rows), ("doc_id", "_train"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", (id_bucket("doc_id", 3) != 1).alias("train"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("y"))
    out = classify(spark, docs, labels, "train")
    return out.select("doc_id", (~F.col("_train")).alias("held_out"), "score", "predicted")
