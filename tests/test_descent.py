"""The descent learner against plain Python: its steps, its optimum, its stop, and what is saved."""

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

from quantlake.operators.descent import Descent, DescentModel


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3)) * [1, 50, 0.01] + [0, 7, 3]
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] + x[:, 1] / 60 - 0.3)))).astype(float)
    return np.c_[x, np.full(400, 5.0)], y


@pytest.fixture(scope="module")
def rows(spark, data):
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(*data, strict=True))], "id int, a double, b double, c double, flat double, label double")
    extra = spark.createDataFrame([(999, 1.0, 1.0, 1.0, 5.0, None)], df.schema)
    return VectorAssembler(inputCols=["a", "b", "c", "flat"], outputCol="features").transform(df.union(extra)).repartition(3).persist()


def plain(data, steps, rate, penalty, tol=1e-6, patience=20):
    x, y = data
    sd = x.std(0)
    z = np.where(sd > 0, (x - x.mean(0)) / np.where(sd > 0, sd, 1), 0)
    w, b, least, stale, history = np.random.default_rng(42).normal(0, 0.5, 4), 0.0, math.inf, 0, []
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(z @ w + b)))
        history.append(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) + penalty / 2 / len(y) * (w**2).sum())
        w, b = w - rate * (z.T @ (p - y) + penalty * w) / len(y), b - rate * np.mean(p - y)
        if history[-1] < least - tol:
            least, stale = history[-1], 0
        else:
            stale += 1
            if stale >= patience:
                break
    return w, b, history, z


def test_steps_are_those_of_plain_descent(rows, data):
    model = Descent(maxIter=12, stepSize=0.3, regParam=0.5).fit(rows)
    w, b, history, _ = plain(data, 12, 0.3, 0.5)
    assert np.allclose(model.weights, w, atol=1e-10) and math.isclose(model.bias, b, abs_tol=1e-10) and np.allclose(model.history, history)


def test_it_reaches_the_optimum_and_stops(rows, data):
    model = Descent(maxIter=70, stepSize=3.0, regParam=1.0, tol=0.0, patience=70).fit(rows)
    _, _, _, z = plain(data, 1, 0.1, 1.0)
    z, y, w = np.c_[z, np.ones(400)], data[1], np.zeros(5)
    for _ in range(30):  # Newton's method
        p = 1 / (1 + np.exp(-z @ w))
        ridge = np.diag([1.0] * 4 + [0.0])
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge + 1e-12 * np.eye(5), z.T @ (p - y) + ridge @ w)
    assert np.allclose(np.r_[model.weights[:3], model.bias], np.r_[w[:3], w[4]], atol=1e-6)
    early = Descent(maxIter=100, stepSize=1.0, tol=10.0, patience=4).fit(rows)
    assert len(early.history) == 5  # the first step is better than none, the next four are not


def test_mini_batches_are_the_same_at_every_rerun(rows):
    fits = [Descent(maxIter=6, stepSize=0.5, batches=3, seed=s).fit(r) for s, r in ((1, rows), (1, rows.repartition(5)), (2, rows))]
    assert np.allclose(fits[0].weights, fits[1].weights, atol=1e-12) and not np.allclose(fits[0].weights, fits[2].weights)
    assert len(set(fits[0].history)) == 6


def test_saved_and_loaded_alone_and_in_a_pipeline(spark, rows, tmp_path):
    learner = Descent(maxIter=3, stepSize=0.5, patience=7)
    learner.save(str(tmp_path / "learner"))
    assert Descent.load(str(tmp_path / "learner")).getPatience() == 7
    model = learner.fit(rows)
    model.save(str(tmp_path / "model"))
    back = DescentModel.load(str(tmp_path / "model"))
    scores = lambda m: sorted((r[0], *r[1]) for r in m.transform(rows).select("id", vector_to_array("probability")).collect())
    assert scores(back) == scores(model) and back.uid == model.uid and back.history == model.history
    assert [abs(w) for _, w in model.importance()] == sorted(map(abs, model.weights), reverse=True)
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="f2"), Descent(featuresCol="f2", maxIter=2)]).fit(rows)
    pipeline.write().overwrite().save(str(tmp_path / "pipeline"))
    assert scores(PipelineModel.load(str(tmp_path / "pipeline"))) == scores(pipeline)


def test_cross_validation_chooses_a_rate(rows):
    learner, judge = Descent(maxIter=5), BinaryClassificationEvaluator(labelCol="label")
    grid = ParamGridBuilder().addGrid(learner.stepSize, [1e-9, 1.0]).build()
    found = CrossValidator(estimator=learner, estimatorParamMaps=grid, evaluator=judge, numFolds=2, seed=1).fit(rows.where("label IS NOT NULL"))
    assert found.bestModel.getStepSize() == 1.0 and found.avgMetrics[1] > 0.6


def test_no_rows_leave_the_start(spark, rows):
    model = Descent(maxIter=4).fit(rows.limit(0))
    assert model.history == [] and model.bias == 0
