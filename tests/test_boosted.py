"""Platt scaling against plain Newton steps, and boosted trees that stop early, on data with a known answer."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantlake.operators import boosted


def plain_platt(s, y, ridge=1.0):
    a = b = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * s + b)))
        w = p * (1 - p)
        move = np.linalg.solve([[(w * s * s).sum() + ridge, (w * s).sum()], [(w * s).sum(), w.sum()]], [((p - y) * s).sum() + ridge * a, (p - y).sum()])
        a, b = a - move[0], b - move[1]
    return a, b


def test_platt_is_plain_newton(spark):
    rng = np.random.default_rng(2)
    s = rng.random(500)
    y = (rng.random(500) < 0.2 + 0.3 * s).astype(float)
    df = spark.createDataFrame(list(zip(s.tolist(), y.tolist(), strict=True)), "s double, y double")
    got = boosted.platt(df, "s", "y")
    assert np.allclose([got.slope, got.shift], plain_platt(s, y), atol=1e-8)
    assert boosted.platt(df.limit(0), "s", "y") == boosted.Platt(0.0, 0.0)


@pytest.fixture(scope="module")
def rows(spark):
    rng, out = np.random.default_rng(4), []
    for i in range(1500):
        a, b = rng.normal(), rng.normal()
        out.append((f"S{i % 5}", i, a, b, float(rng.random() < (0.25 if a * b > 0 else 0.1))))
    return spark.createDataFrame(out, "symbol string, date int, a double, b double, y double").repartition(4).persist()


def test_scores_are_calibrated_and_rounds_stop(rows):
    model = boosted.boost(rows, ["a", "b"], rounds=60, rate=0.3)
    assert 1 <= model.rounds < 60
    brier = lambda c: F.avg((F.col(c) - F.col("y")) ** 2)
    held = model.transform(rows).where(boosted.held_out(F.col("y"), F.col("symbol"), F.col("date")))
    raw, scaled, mean_p, mean_y, n = held.agg(brier("p_raw"), brier("p"), F.avg("p"), F.avg("y"), F.count("*")).first()
    assert scaled <= raw and math.isclose(mean_p, mean_y, abs_tol=0.01) and 200 < n < 400
    assert {k for k, _ in model.importance()} == {"a", "b"} and math.isclose(sum(g for _, g in model.importance()), 1)


def test_one_class_held_out_means_no_stop_and_no_scaling(rows):
    few = rows.where("y = 0 OR date < 40")
    one = few.where((F.col("y") == 0) | ~boosted.held_out(F.col("y"), F.col("symbol"), F.col("date")))
    model = boosted.boost(one, ["a", "b"], rounds=3)
    assert model.scaling is None and model.rounds == 3
    assert model.transform(one).where("p <> p_raw").count() == 0


def test_both_classes_are_held_out_alike(rows):
    shares = rows.groupBy("y").agg(F.avg(boosted.held_out(F.col("y"), F.col("symbol"), F.col("date")).cast("double")).alias("s")).collect()
    assert all(0.14 < r["s"] < 0.26 for r in shares)
