"""Logistic regression by gradient descent as an Estimator: works in a Pipeline and in CrossValidator, and is saved and loaded.

Every step reads the rows once: tasks add up the slopes and the loss of their rows as arrays, which are summed by place, so what
reaches the driver has the size of the model. Mini-batches are dealt by a keyed hash of the row, so that a rerun sees the same
batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml.base import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, HasRegParam, HasSeed, HasStepSize, HasThreshold, HasTol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLIP = 1e-15


class DescentParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, HasThreshold, HasMaxIter, HasTol, HasSeed, HasStepSize, HasRegParam):
    patience: Param[int] = Param(Params._dummy(), "patience", "steps without an improvement of tol after which the fit stops", TypeConverters.toInt)
    batches: Param[int] = Param(Params._dummy(), "batches", "mini-batches the rows are dealt to; each step takes one (1: all rows)", TypeConverters.toInt)

    def getPatience(self) -> int:
        return self.getOrDefault(self.patience)

    def getBatches(self) -> int:
        return self.getOrDefault(self.batches)


class Descent(Estimator["DescentModel"], DescentParams, DefaultParamsReadable, DefaultParamsWritable):
    """Minimises the mean log loss plus regParam / (2 n) times the squared weights (not the constant) of standardised features, from a
    seeded start. Stops after maxIter steps, or once ``patience`` steps in a row did not better the least loss by tol.

    Rows with a null label are left out; a feature without spread counts as 0. Without rows, or with labels of one kind, the
    steps are taken all the same; no rows at all leave the start.
    """

    @keyword_only
    def __init__(self, **kwargs) -> None:  # any Param by its name
        super().__init__()
        self._setDefault(maxIter=1000, stepSize=0.01, regParam=0.01, tol=1e-6, patience=20, batches=1, seed=42, threshold=0.5)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> DescentModel:
        label = F.col(self.getLabelCol()).cast("double")
        rows = dataset.where(label.isNotNull()).select(vector_to_array(self.getFeaturesCol()).alias("x"), label.alias("y"))
        batches = self.getBatches()
        rows = rows.withColumn("batch", F.pmod(F.xxhash64(F.lit(self.getSeed()), "x", "y"), F.lit(batches)).cast("int")).persist()
        try:
            return self._descend(rows, batches)
        finally:
            rows.unpersist()

    def _descend(self, rows: DataFrame, batches: int) -> DescentModel:
        first = rows.select(F.size("x")).first()
        k = first[0] if first else 0
        n, sums, squares = np.split(summed(rows, 2 * k + 1, lambda x, y: np.concatenate([[len(y)], x.sum(0), (x**2).sum(0)])), [1, k + 1])
        mean = sums / max(n[0], 1)
        spread = np.sqrt(np.maximum(squares / max(n[0], 1) - mean**2, 0))
        spread[spread <= 1e-12 * np.maximum(np.abs(mean), 1)] = np.inf  # no spread: the feature counts as 0
        weights, bias = np.random.default_rng(self.getSeed()).normal(0, 1 / np.sqrt(max(k, 1)), k), 0.0
        least, stale, history = np.inf, 0, []
        for step in range(self.getMaxIter() if n[0] else 0):

            def slopes(x: np.ndarray, y: np.ndarray, weights: np.ndarray = weights, bias: float = bias) -> np.ndarray:
                z = (x - mean) / spread
                p = 1 / (1 + np.exp(-(z @ weights + bias)))
                clipped = np.clip(p, CLIP, 1 - CLIP)
                loss = -(y * np.log(clipped) + (1 - y) * np.log(1 - clipped)).sum()
                return np.concatenate([[len(y), loss, (p - y).sum()], (p - y) @ z])

            part = rows if batches == 1 else rows.where(F.col("batch") == step % batches)
            got = summed(part, k + 3, slopes)
            size = max(got[0], 1)
            history.append(float((got[1] + self.getRegParam() / 2 * (weights**2).sum()) / size))
            weights = weights - self.getStepSize() * (got[3:] + self.getRegParam() * weights) / size
            bias -= self.getStepSize() * got[2] / size
            if history[-1] < least - self.getTol():
                least, stale = history[-1], 0
            else:
                stale += 1
                if stale >= self.getPatience():
                    break
        return self._copyValues(DescentModel(mean, np.where(np.isinf(spread), 0, 1 / spread), weights, float(bias), history))


def summed(rows: DataFrame, size: int, of) -> np.ndarray:
    """The sum of ``of(x, y)``, an array of ``size``, over all rows: one row a place reaches the driver."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                total += of(np.array(batch["x"].tolist(), float).reshape(len(batch), -1), batch["y"].to_numpy(float))
        yield pd.DataFrame({"i": np.arange(size), "v": total})

    out = np.zeros(size)
    for r in rows.select("x", "y").mapInPandas(work, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


class DescentModel(Model, DescentParams, MLReadable, MLWritable):
    """Weights of standardised features. Adds rawPrediction, probability and prediction, all by expressions."""

    def __init__(self, mean=(), scale=(), weights=(), bias: float = 0.0, history=()) -> None:
        super().__init__()
        self.mean, self.scale, self.weights = (np.asarray(x, float) for x in (mean, scale, weights))
        self.bias, self.history = bias, list(history)

    @property
    def coefficients(self) -> np.ndarray:
        """Weights of the features as they are."""
        return self.weights * self.scale

    @property
    def intercept(self) -> float:
        return float(self.bias - (self.coefficients * self.mean).sum())

    def importance(self) -> list[tuple[int, float]]:
        """Features by the size of their standardised weights, most first."""
        return sorted(enumerate(self.weights.tolist()), key=lambda x: -abs(x[1]))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        x = vector_to_array(self.getFeaturesCol())
        z = F.lit(self.bias) + sum(((x[i] - m) * (s * w) for i, (m, s, w) in enumerate(zip(self.mean.tolist(), self.scale.tolist(), self.weights.tolist(), strict=True))), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        out = dataset.withColumn(self.getRawPredictionCol(), array_to_vector(F.array(-z, z))).withColumn(self.getProbabilityCol(), array_to_vector(F.array(1 - p, p)))
        return out.withColumn(self.getPredictionCol(), (p >= self.getThreshold()).cast("double"))

    def write(self) -> MLWriter:
        return DescentModelWriter(self)

    @classmethod
    def read(cls) -> DescentModelReader:
        return DescentModelReader()


class DescentModelWriter(MLWriter):
    def __init__(self, instance: DescentModel) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        m = self.instance
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession)
        row = (m.mean.tolist(), m.scale.tolist(), m.weights.tolist(), m.bias, m.history)
        schema = "mean array<double>, scale array<double>, weights array<double>, bias double, history array<double>"
        self.sparkSession.createDataFrame([row], schema).coalesce(1).write.parquet(f"{path}/data")


class DescentModelReader(MLReader):
    def load(self, path: str) -> DescentModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = DescentModel(*self.sparkSession.read.parquet(f"{path}/data").first())
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
