"""Boosted trees with an early stop on a held-out share, weights that balance the classes, and Platt scaling of their scores."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import Model, Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HELD, WEIGHT, RAW = "_held", "_weight", "p_raw"


def held_out(label: Column, *key: Column, share: float = 0.2, seed: int = 1) -> Column:
    """Whether a row is in the held-out share of its class: a keyed hash of row and label, so a rerun holds out the same rows."""
    return F.pmod(F.xxhash64(F.lit(seed), label, *key), F.lit(1_000_000)) < int(share * 1_000_000)


@dataclass(frozen=True)
class Platt:
    """p = 1 / (1 + exp(-(slope * score + shift)))"""

    slope: float
    shift: float

    def of(self, score: Column) -> Column:
        return 1 / (1 + F.exp(-(F.lit(self.slope) * score + F.lit(self.shift))))


def platt(rows: DataFrame, score: str, label: str, *, rounds: int = 12, ridge: float = 1.0, tol: float = 1e-10) -> Platt:
    """The two parameters that maximise the likelihood of the labels, with ``ridge`` / 2 times the squared slope as penalty, by
    Newton's method from 0: each round is one aggregate of five sums. ``rows`` are read once a round. Without rows both stay 0."""
    slope = shift = 0.0
    s, y = F.col(score), F.col(label)
    for _ in range(rounds):
        p = Platt(slope, shift).of(s)
        w = p * (1 - p)
        got = rows.agg(*(F.coalesce(F.sum(x), F.lit(0.0)) for x in ((p - y) * s, p - y, w * s * s, w * s, w))).first()
        slopes, curve = np.array([got[0] + ridge * slope, got[1]]), np.array([[got[2] + ridge, got[3]], [got[3], got[4]]])
        if got[4] <= 0:
            break
        move = np.linalg.solve(curve, slopes)
        slope, shift = slope - float(move[0]), shift - float(move[1])
        if np.abs(move).max() < tol:
            break
    return Platt(slope, shift)


@dataclass
class Boosted:
    """Fitted trees and the scaling of their scores; names of features, and rounds kept."""

    trees: Model
    scaling: Platt | None
    names: list[str]

    @property
    def rounds(self) -> int:
        return self.trees.stages[-1].getNumTrees

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with p_raw, the trees' own score, and p, the scaled one."""
        drop = ("_x", "rawPrediction", "probability", "prediction")
        out = self.trees.transform(rows).withColumn(RAW, vector_to_array("probability")[1]).drop(*drop)
        return out.withColumn("p", self.scaling.of(F.col(RAW)) if self.scaling else F.col(RAW))

    def importance(self) -> list[tuple[str, float]]:
        gains = self.trees.stages[-1].featureImportances.toArray().tolist()
        return sorted(zip(self.names, gains, strict=True), key=lambda x: (-x[1], x[0]))


def boost(
    rows: DataFrame, names: list[str], *, label: str = "y", key: tuple[str, ...] = ("symbol", "date"), rounds: int = 500, rate: float = 0.05, depth: int = 4,
    share: float = 0.2, least_gain: float = 1e-4, subsample: float = 0.8, seed: int = 1,
) -> Boosted:
    """Trees over ``names``, fitted on the rows that are not held out, with the positive class weighted by negatives to positives.

    Rounds stop once the loss on the held-out share no longer falls by ``least_gain`` (of itself); scores are scaled on that share.
    With one class held out there is neither an early stop nor scaling. Rows with a null feature or label are left out.
    """
    known = rows.dropna(subset=[label, *names]).withColumn(HELD, held_out(F.col(label), *map(F.col, key), share=share, seed=seed))
    counts = {(r[HELD], r[label] == 1): r["n"] for r in known.groupBy(HELD, label).agg(F.count("*").alias("n")).collect()}
    balance = counts.get((False, False), 0) / max(counts.get((False, True), 0), 1)
    known = known.withColumn(WEIGHT, F.when(F.col(label) == 1, balance or 1.0).otherwise(1.0))
    judged = counts.get((True, True), 0) > 0 and counts.get((True, False), 0) > 0
    trees = GBTClassifier(featuresCol="_x", labelCol=label, weightCol=WEIGHT, maxIter=rounds, stepSize=rate, maxDepth=depth, subsamplingRate=subsample, seed=seed, validationTol=least_gain)
    if judged:
        trees = trees.setValidationIndicatorCol(HELD)
    fitted = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="_x"), trees]).fit(known if judged else known.where(~F.col(HELD)))
    model = Boosted(fitted, None, names)
    if judged:
        scored = model.transform(known.where(HELD)).select(RAW, F.col(label).cast("double").alias(label)).persist()
        model.scaling = platt(scored, RAW, label)
        scored.unpersist()
    return model
