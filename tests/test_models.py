"""What SQL cannot express: models and the normal distribution, against what they must satisfy or a plain computation."""

from statistics import NormalDist

import numpy as np
from pyspark.sql import functions as F

from quantlake.functions import normal
from quantlake.plans import learning, models
from quantlake.plans.market import QUERIES
from tests.helpers import DATA


def test_scores_are_out_of_fold(spark):
    rows = models.panel(spark, DATA)
    folds = models.roles(rows)
    train, test = (folds.where(f"role = '{role}'") for role in ("train", "test"))
    assert train.join(test, ["fold", "date"]).count() == 0
    gap = train.groupBy("fold").agg(F.max("date").alias("a")).join(test.groupBy("fold").agg(F.min("date").alias("b")), "fold")
    assert gap.where("datediff(b, a) <= 7 * 4").count() == 0
    found = QUERIES["mdl_oof"](spark, DATA)
    assert found.count() == rows.join(test, "date").count()
    assert found.where("linear NOT BETWEEN 0 AND 1 OR boosted NOT BETWEEN 0 AND 1 OR linear IS NULL").count() == 0
    assert models.out_of_fold(rows.limit(0), folds).count() == 0


def test_probabilistic_sharpe(spark):
    rows = {r["symbol"]: r for r in models.moments(spark, DATA).collect()}
    for r in QUERIES["st_psr"](spark, DATA).collect():
        m = rows[r["symbol"]]
        spread = 1 - m["skew"] * m["sr"] + (m["kurt"] - 1) / 4 * m["sr"] ** 2
        assert abs(r["probability"] - NormalDist().cdf(m["sr"] * ((m["n"] - 1) / spread) ** 0.5)) < 1e-7
    dsr = QUERIES["st_dsr"](spark, DATA).collect()
    assert len(dsr) == len(rows) and all(r["expected_max"] > 0 and 0 <= r["probability"] <= 1 for r in dsr)


def test_normal_expressions(spark):
    rows = spark.createDataFrame([(float(x), float(p)) for x, p in zip(np.linspace(-9, 9, 241), np.linspace(1e-6, 1 - 1e-6, 241), strict=True)], "x double, p double")
    for r in rows.selectExpr("x", "p", f"{normal.cdf('x')} AS c", f"{normal.inverse('p')} AS q").collect():
        assert abs(r["c"] - NormalDist().cdf(r["x"])) < 1e-14
        assert abs(r["q"] - NormalDist().inv_cdf(r["p"])) < 1e-8


def test_gradient_descent_reaches_the_optimum(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 2))
    y = (rng.random(500) < 1 / (1 + np.exp(-(0.4 + x @ [1.0, -2.0])))).astype(int)
    rows = spark.createDataFrame([(int(k), float(a), float(b)) for k, (a, b) in zip(y, x, strict=True)], "y int, a double, b double")
    w = learning.descend(learning.standardised(rows, ["a", "b"]), ["a", "b"], steps=60, rate=2.0, penalty=0.0)
    z = (x - x.mean(0)) / x.std(0)
    miss = 1 / (1 + np.exp(-(w["bias"] + z @ [w["a"], w["b"]]))) - y
    assert abs(miss.mean()) < 1e-3 and np.abs(miss @ z / 500).max() < 1e-3


def plain_draws(exits, draws, rng):
    cover, out = np.zeros(len(exits)), []
    for _ in range(draws):
        mean = np.array([np.mean(1 / (1 + cover[i : e + 1])) if e >= i else 0.0 for i, e in enumerate(exits)])
        out.append(int(rng.choice(len(exits), p=mean / mean.sum())))
        cover[out[-1] : exits[out[-1]] + 1] += 1
    return out


def test_sequential_bootstrap(spark):
    exits = np.array([3, 2, -1, 6, 5, 9, 8, -1, 9, 9])
    assert learning.drawn(exits, 20, np.random.default_rng(3)).tolist() == plain_draws(exits, 20, np.random.default_rng(3))
    assert len(learning.drawn(np.array([-1, -1]), 5, np.random.default_rng(0))) == 0
    rows = spark.createDataFrame([(s, i, int(e) if e >= 0 else None) for s in "AB" for i, e in enumerate(exits)], "symbol string, t int, exit_t int")
    found = learning.sequential_bootstrap(rows, 7).collect()
    assert len(found) == 14 and all(exits[r["t"]] >= 0 for r in found)


def test_served_drivers_are_those_of_the_served_model(spark):
    """Shares and the constant add up to the linear base's log-odds, and the newest bar of every symbol is served once."""
    import math

    from quantlake.plans import learning

    rows, linear = learning.served(spark, "/root/testdata/sf0.001")
    rows = rows.persist()
    said = {(r["symbol"], r["date"]): (math.log(r["linear"] / (1 - r["linear"])), r["p"]) for r in rows.collect()}
    total = {}
    for r in learning.shares(rows, linear).collect():
        total[r["symbol"], r["date"]] = total.get((r["symbol"], r["date"]), 0.0) + r["share"]
    rests = [said[k][0] - total[k] for k in said]
    assert said.keys() == total.keys() and max(rests) - min(rests) < 1e-9 and all(0 <= p <= 1 for _, p in said.values())
    rows.unpersist()


def test_fits_read_a_table_of_their_own(spark, monkeypatch):
    """No learner goes back to the trades, and what it reads has the parts that its rows need (F1 to F5)."""
    from pyspark.ml.classification import LogisticRegression

    seen = []

    class Seen(LogisticRegression):
        def _fit(self, dataset):
            seen.append((any("lineitem" in f for f in dataset.inputFiles()), dataset.rdd.getNumPartitions()))
            return super()._fit(dataset)

    few = {"linear": Seen(featuresCol="x", labelCol="y", maxIter=2), "other": Seen(featuresCol="x", labelCol="y", maxIter=2)}
    monkeypatch.setattr(models, "learners", lambda: few)
    monkeypatch.setattr(learning, "learners", lambda: few)
    parts = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert models.mdl_oof(spark, DATA).count() and len(seen) == 2 * models.SPLITS
        assert learning.mdl_serving(spark, DATA).count() and len(seen) == 2 * models.SPLITS + 2
        assert learning.mdl_meta_label(spark, DATA).count() and len(seen) == 3 * models.SPLITS + 2  # the primary alone
        assert set(seen) == {(False, 1)}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", parts)
