"""Fitting and judging: gradient descent as aggregates, fold-wise backtests, shuffled labels, normal statistics, bootstrap.

Iterative fits read a persisted frame once an iteration; what reaches the driver has the size of the model. The SQL is
written apart, with iterations unrolled.
"""

from __future__ import annotations

from math import e

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantlake.functions import normal
from quantlake.plans.labels import EMBARGO, LABELLED, PURGE, ROLES, combinatorial, dated, labelled, purged_panel
from quantlake.plans.market import QUERIES, SCORED, C, query, scored
from quantlake.plans.models import EULER, MOMENTS, in_parts, learners, moments, out_of_fold, panel, prepared, roles, written
from quantlake.plans.permute import fixed_scores, verdicts
from quantlake.sources.bars import DAY, bars, bars_sql

# Logistic regression by gradient descent: standardised features, a penalty on the weights but not on the constant

RATE, PENALTY, STEPS = 0.5, 0.01, 6
FEATURES = {"edge": "p - 0.5e0", "bent": "p * p", "turn": "(doc_id % 17) / 17e0"}


def sigmoid(z: str) -> str:
    return f"1 / (1 + exp(-({z})))"


def bce(p: str, y: str = "y") -> str:
    clipped = f"least(1 - 1e-15, greatest(1e-15, {p}))"
    return f"-({y} * ln({clipped}) + (1 - {y}) * ln(1 - {clipped}))"


def standardised(rows: DataFrame, names: list[str]) -> DataFrame:
    """``names`` less their mean, over their deviation (1 where there is none): one aggregate, one row to join."""
    facts = rows.agg(*(F.avg(c).alias(f"_m_{c}") for c in names), *(F.stddev_pop(c).alias(f"_s_{c}") for c in names))
    scale = lambda c: F.when(C(f"_s_{c}") > 0, C(f"_s_{c}")).otherwise(1.0)
    return rows.join(F.broadcast(facts), how="cross").select("y", *((C(c) - C(f"_m_{c}")) / scale(c) for c in names)).toDF("y", *names)


def descend(rows: DataFrame, names: list[str], steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> dict[str, float]:
    """Weights (bias and ``names``) after ``steps`` of gradient descent from 0 over ``rows`` (y and standardised features)."""
    weights = dict.fromkeys(["bias", *names], 0.0)
    rows = rows.persist()
    for _ in range(steps):
        z = F.lit(weights["bias"]) + sum((C(c) * weights[c] for c in names), F.lit(0.0))
        miss = 1 / (1 + F.exp(-z)) - C("y")
        slopes = rows.agg(F.avg(miss).alias("bias"), *(F.avg(miss * C(c)).alias(c) for c in names), F.count("*").alias("_n")).first()
        for c in weights:
            weights[c] -= rate * (slopes[c] + (penalty / slopes["_n"] * weights[c] if c != "bias" else 0.0))
    rows.unpersist()
    return weights


def design(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).selectExpr("doc_id", "y", *(f"{x} AS {k}" for k, x in FEATURES.items()))
    return standardised(rows, list(FEATURES))


DESIGN = f"WITH {SCORED}, x0 AS (SELECT doc_id, y, {', '.join(f'{x} AS {k}' for k, x in FEATURES.items())} FROM s), x AS (SELECT y, {', '.join(f'({k} - avg({k}) OVER ()) / stddev_pop({k}) OVER () AS {k}' for k in FEATURES)} FROM x0), w0 AS (SELECT 0.0::DOUBLE AS bias, {', '.join(f'0.0::DOUBLE AS {k}' for k in FEATURES)})"
_z = "w.bias + " + " + ".join(f"w.{k} * x.{k}" for k in FEATURES)
_miss = f"({sigmoid(_z)} - x.y)"
for _k in range(STEPS):
    DESIGN += f", w{_k + 1} AS (SELECT any_value(w.bias) - {RATE} * avg({_miss}) AS bias, {', '.join(f'any_value(w.{k}) - {RATE} * (avg({_miss} * x.{k}) + {PENALTY} / count(*) * any_value(w.{k})) AS {k}' for k in FEATURES)} FROM x, w{_k} AS w)"
LONG = " UNION ALL ".join(f"SELECT '{k}' AS feature, {k} AS weight FROM w{STEPS}" for k in ("bias", *FEATURES))


def weight_rows(spark: SparkSession, weights: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(list(weights.items()), "feature string, weight double")


query("mdl_logistic_gd", f"{DESIGN}, l AS ({LONG}) SELECT feature, round(weight, 8) AS weight FROM l")(
    lambda s, d: weight_rows(s, descend(design(s, d), list(FEATURES))).select("feature", F.round("weight", 8).alias("weight"))
)
query("top_feature_importance_lin", f"{DESIGN}, l AS ({LONG}) SELECT feature, round(weight, 8) AS weight FROM l WHERE feature <> 'bias' ORDER BY abs(weight) DESC LIMIT 2")(
    lambda s, d: weight_rows(s, descend(design(s, d), list(FEATURES))).where("feature <> 'bias'").orderBy(F.desc(F.abs("weight"))).limit(2).select("feature", F.round("weight", 8).alias("weight"))
)
FIXED = {"bias": 0.1, "edge": 0.7, "bent": -0.3, "turn": 0.05}
_fixed = f"{FIXED['bias']} + " + " + ".join(f"{FIXED[k]} * {k}" for k in FEATURES)
query(
    "mdl_sigmoid_bce_grad",
    f"{DESIGN.split(', w0 AS')[0]}, p AS (SELECT *, {sigmoid(_fixed)} AS p FROM x) SELECT round(avg({bce('p')}) + {PENALTY} / (2 * count(*)) * {sum(FIXED[k] ** 2 for k in FEATURES)!r}, 8) AS loss, round(avg(p - y), 8) AS bias, {', '.join(f'round(avg((p - y) * {k}) + {PENALTY} / count(*) * {FIXED[k]}, 8) AS {k}' for k in FEATURES)} FROM p",
)(
    lambda s, d: design(s, d).withColumn("p", F.expr(sigmoid(_fixed.replace("0.1 +", "0.1e0 +")))).agg(
        F.round(F.avg(F.expr(bce("p"))) + PENALTY / (2 * F.count("*")) * sum(FIXED[k] ** 2 for k in FEATURES), 8).alias("loss"), F.round(F.avg(C("p") - C("y")), 8).alias("bias"),
        *(F.round(F.avg((C("p") - C("y")) * C(k)) + PENALTY / F.count("*") * FIXED[k], 8).alias(k) for k in FEATURES),
    )
)

# Exact area under the curve, for scores of any number: ranges of scores first, then within a range


def auc(rows: DataFrame, score: str = "p", ranges: int = 1024) -> DataFrame:
    """auc of ``rows`` (score in 0..1, y): every pair of a good and a bad row, ties half. Two levels of running sums, so that no
    task sorts all distinct scores."""
    by_score = rows.groupBy(score).agg(F.count_if(C("y") == 1).alias("good"), F.count_if(C("y") == 0).alias("bad"))
    by_score = by_score.withColumn("range", F.floor(C(score) * ranges))
    level = by_score.groupBy("range").agg(F.sum("bad").alias("bad"))
    level = level.select("range", (F.sum("bad").over(Window.orderBy("range")) - C("bad")).alias("earlier"))  # one row a range
    inside = Window.partitionBy("range").orderBy(score)
    by_score = by_score.join(level, "range").withColumn("below", C("earlier") + F.sum("bad").over(inside) - C("bad") / 2)
    return by_score.agg((F.sum(C("good") * C("below")) / F.nullif(F.sum("good") * F.sum("bad"), F.lit(0))).alias("auc"))


AUC = "avg(CASE WHEN a.{0} > b.{0} THEN 1.0 WHEN a.{0} = b.{0} THEN 0.5 ELSE 0.0 END)"
query("mdl_auc", f"WITH {SCORED} SELECT round({AUC.format('p')}, 8) AS auc FROM s a, s b WHERE a.y = 1 AND b.y = 0")(lambda s, d: auc(scored(s, d)).select(F.round("auc", 8).alias("auc")))


def compared(rows: DataFrame, least: int = 100) -> DataFrame:
    """AUC and log loss of ``stack`` and ``base`` over rows (base, stack, y); nulls below ``least`` rows or with one class."""
    whole = rows.agg(F.count("*").alias("n_compared"), F.avg(F.expr(bce("base"))).alias("baseline_logloss"), F.avg(F.expr(bce("stack"))).alias("stack_logloss"), F.countDistinct("y").alias("kinds"))
    for name in ("base", "stack"):
        whole = whole.join(F.broadcast(auc(rows, name).withColumnRenamed("auc", f"{name}_auc")), how="cross")  # one row each
    out = whole.select("n_compared", C("base_auc").alias("baseline_auc"), "stack_auc", "baseline_logloss", "stack_logloss", (C("stack_auc") - C("base_auc")).alias("improvement"), "kinds")
    enough = (C("n_compared") >= least) & (C("kinds") == 2)
    return out.select("n_compared", *(F.when(enough, F.round(x, 8)).alias(x) for x in ("baseline_auc", "stack_auc", "baseline_logloss", "stack_logloss", "improvement")))


BOTH = f"WITH {SCORED}, c AS (SELECT y, p AS base, 0.05 + 0.45 * p + 0.4 * y * (doc_id % 3) / 2 AS stack FROM s)"
query(
    "mdl_baseline_cmp",
    f"""{BOTH}, a AS (SELECT {AUC.format("base")} AS b, {AUC.format("stack")} AS k FROM c a, c b WHERE a.y = 1 AND b.y = 0), n AS (SELECT count(*) AS n, avg({bce("base")}) AS lb, avg({bce("stack")}) AS lk FROM c)
    SELECT n AS n_compared, CASE WHEN n >= 100 THEN round(b, 8) END AS baseline_auc, CASE WHEN n >= 100 THEN round(k, 8) END AS stack_auc, CASE WHEN n >= 100 THEN round(lb, 8) END AS baseline_logloss, CASE WHEN n >= 100 THEN round(lk, 8) END AS stack_logloss, CASE WHEN n >= 100 THEN round(k - b, 8) END AS improvement FROM a, n""",
)(lambda s, d: compared(scored(s, d).select("y", C("p").alias("base"), (0.05 + 0.45 * C("p") + 0.4 * C("y") * (C("doc_id") % 3) / 2).alias("stack"))))

# Fitted learners: importance by gain, a filter on the primary's calls, a stack to serve


def fitted(rows: DataFrame, learner, names: list[str]):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="x0"), StandardScaler(inputCol="x0", outputCol="x", withMean=True), learner]).fit(rows)


def top_feature_importance_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the boosted trees by gain, most first."""
    from quantlake.plans.models import FEATURES as names

    model = fitted(panel(spark, sf_dir), learners()["boosted"], list(names))
    return spark.createDataFrame(list(zip(names, model.stages[-1].featureImportances.toArray().tolist(), strict=True)), "feature string, gain double").orderBy(F.desc("gain"), "feature")


def mdl_meta_label(spark: SparkSession, sf_dir: str, threshold: float = 0.5, least: int = 500) -> DataFrame:
    """symbol, date and conviction of the bars on which the out-of-fold primary fires: the chance that this call is right, by a
    balanced logistic regression on such bars only. Too few calls, or calls all right or all wrong, teach nothing: no rows."""
    from pyspark.ml.classification import LogisticRegression

    from quantlake.plans.models import FEATURES as names
    from quantlake.plans.models import vector_second

    rows = written(panel(spark, sf_dir), "panel")
    linear = {"linear": learners()["linear"]}  # the primary; no other learner's scores are read here
    primary = out_of_fold(rows, written(roles(rows), "roles"), chosen=linear).select("symbol", "date", C("linear").alias("primary"))
    fired = written(rows.join(primary, ["symbol", "date"]).where(C("primary") >= threshold), "fired")
    n, right = fired.agg(F.count("*"), F.sum("y")).first()
    if n < least or not 0 < right < n:
        return fired.select("symbol", "date", F.lit(None).cast("double").alias("conviction")).limit(0)
    fired = fired.withColumn("w", F.when(C("y") == 1, n / (2 * right)).otherwise(n / (2 * (n - right))))
    model = fitted(fired, LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=1e-3), ["primary", *names])
    return model.transform(fired).select("symbol", "date", vector_second("probability").alias("conviction"))


def served(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(symbol, date, features, a column for each base model and p, of each symbol's newest bar) and (feature, weight, mean): the linear
    base by feature. A stack refitted on all labelled rows, whose base models are saved and loaded as pipelines. A missing feature is 0,
    a missing base score 0.5."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression

    from quantlake.plans.models import FEATURES as names
    from quantlake.plans.models import features_of, vector_second
    from quantlake.sources.files import scratch

    every, drop = written(features_of(bars(spark, sf_dir)), "features"), ("x0", "x", "rawPrediction", "probability", "prediction")
    rows = every.dropna(subset=[*names, "y"])
    newest = Window.partitionBy("symbol").orderBy(F.desc("date"))
    asked = every.withColumn("_r", F.row_number().over(newest)).where("_r = 1").select("symbol", "date", *names).na.fill(0.0)
    inner, linear, ready = rows, None, prepared(rows, list(names))
    known = in_parts(ready.transform(rows), rows.count()).persist()
    for name, learner in learners().items():
        path = f"{scratch(spark, 'model')}/{name}"
        PipelineModel(stages=[*ready.stages, learner.fit(known)]).write().overwrite().save(path)
        model = PipelineModel.load(path)
        if name == "linear":
            _, scale, base = model.stages
            weights = base.coefficients.toArray() / scale.std.toArray()
            linear = spark.createDataFrame([(k, float(w), float(m)) for k, w, m in zip(names, weights, scale.mean.toArray(), strict=True)], "feature string, weight double, mean double")
        add = lambda df, m=model, k=name: m.transform(df).withColumn(k, vector_second("probability")).drop(*drop)
        inner, asked = add(inner), add(asked)
    known.unpersist()
    stack = fitted(written(inner, "inner"), LogisticRegression(featuresCol="x", labelCol="y"), list(learners()))
    return stack.transform(asked.na.fill(0.5, list(learners()))).withColumn("p", vector_second("probability")).drop(*drop), linear


def mdl_serving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date and p of each symbol's newest bar."""
    return served(spark, sf_dir)[0].select("symbol", "date", "p")


def shares(rows: DataFrame, linear: DataFrame) -> DataFrame:
    """symbol, date, feature, value and share of each of ``rows``: weight times distance from the training mean, which add up, with the
    constant, to the linear base's log-odds."""
    from quantlake.plans.models import FEATURES as names

    long = rows.select("symbol", "date", F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), C(k).alias("value")) for k in names))).alias("f")).select("symbol", "date", "f.*")
    return long.join(F.broadcast(linear), "feature").select("symbol", "date", "feature", "value", (C("weight") * (C("value") - C("mean"))).alias("share"))  # one row a feature


def snk_model_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a saved model, loaded again, gives every row the score that it gave before."""
    from pyspark.ml import PipelineModel

    from quantlake.plans.models import FEATURES as names
    from quantlake.plans.models import vector_second
    from quantlake.sources.files import scratch

    rows, path = panel(spark, sf_dir), scratch(spark, "model")
    model = fitted(rows, learners()["linear"], list(names))
    model.write().overwrite().save(path)
    said = lambda m, name: m.transform(rows).select("symbol", "date", vector_second("probability").alias(name))
    both = said(model, "a").join(said(PipelineModel.load(path), "b"), ["symbol", "date"])
    return both.agg((F.count_if(C("a") != C("b")) == 0).alias("same"))


query("snk_model_artifact", "SELECT true AS same")(snk_model_artifact)
QUERIES |= {"top_feature_importance_gain": top_feature_importance_gain, "mdl_meta_label": mdl_meta_label, "mdl_serving": mdl_serving}

# Sharpe ratios against chance

SPREAD = "(1 - skew * sr + (kurt - 1) / 4 * sr * sr)"


def psr(benchmark: str) -> str:
    return normal.cdf(f"((sr - {benchmark}) * sqrt(n - 1e0) / sqrt({SPREAD}))")


TRIALS = f"trials AS (SELECT count(*) AS trials, var_samp(sr) AS variance FROM k)"
MOST = f"sqrt(variance) * ((1 - {EULER}e0) * ({normal.inverse('(1 - 1e0 / trials)')}) + {EULER}e0 * ({normal.inverse(f'(1 - 1e0 / (trials * {e!r}e0))')}))"


def trials(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("trials"), F.var_samp("sr").alias("variance"))


query("st_psr", f"{MOMENTS} SELECT symbol, round(sr, 8) AS sr, round({psr('0e0')}, 8) AS probability FROM k")(
    lambda s, d: moments(s, d).select("symbol", F.round("sr", 8).alias("sr"), F.round(F.expr(psr("0e0")), 8).alias("probability"))
)
query("st_expected_max", f"{MOMENTS}, {TRIALS} SELECT trials, round({MOST}, 8) AS expected_max FROM trials")(
    lambda s, d: trials(moments(s, d)).select("trials", F.round(F.expr(MOST), 8).alias("expected_max"))
)
query("st_dsr", f"{MOMENTS}, {TRIALS}, b AS (SELECT {MOST} AS best FROM trials) SELECT symbol, round(sr, 8) AS sr, round(best, 8) AS expected_max, round({psr('best')}, 8) AS probability FROM k, b")(
    lambda s, d: (lambda m: m.join(F.broadcast(trials(m).select(F.expr(MOST).alias("best"))), how="cross"))(moments(s, d))
    .select("symbol", F.round("sr", 8).alias("sr"), F.round("best", 8).alias("expected_max"), F.round(F.expr(psr("best")), 8).alias("probability"))
)
query("st_dsr_trials", f"{MOMENTS}, {TRIALS}, b AS (SELECT {MOST} AS best FROM trials) SELECT count(*) AS trials, count(*) FILTER ({psr('best')} > 0.95) AS beyond_chance FROM k, b")(
    lambda s, d: (lambda m: m.join(F.broadcast(trials(m).select(F.expr(MOST).alias("best"))), how="cross"))(moments(s, d)).agg(F.count("*").alias("trials"), F.count_if(F.expr(psr("best")) > 0.95).alias("beyond_chance"))
)

# Splits: no day is both in training and in test

query("cv_no_overlap", f"{ROLES} SELECT 'panel' AS kind, CAST(fold AS INTEGER) AS fold, 0 AS in_both, count(DISTINCT date) FILTER (pos >= a AND pos <= b) AS test_days FROM g GROUP BY fold")(
    lambda s, d: purged_panel(dated(s, d)[1]).groupBy("fold", "date").agg(F.max((C("role") == "train").cast("int")).alias("a"), F.max((C("role") == "test").cast("int")).alias("b"))
    .groupBy("fold").agg(F.count_if((C("a") == 1) & (C("b") == 1)).cast("int").alias("in_both"), F.sum("b").alias("test_days")).select(F.lit("panel").alias("kind"), "fold", "in_both", "test_days")
)
query("cv_modes", f"{ROLES} SELECT CAST(fold AS INTEGER) AS fold, count(DISTINCT date) FILTER (pos < a - {PURGE}) AS expanding, count(DISTINCT date) FILTER (pos < a - {PURGE} OR pos > b + {EMBARGO}) AS k_fold FROM g GROUP BY fold")(
    lambda s, d: (lambda days: purged_panel(days).where("role = 'train'").groupBy("fold").agg(F.count("*").alias("expanding")).join(
        purged_panel(days, expanding=False).where("role = 'train'").groupBy("fold").agg(F.count("*").alias("k_fold")), "fold", "full"))(dated(s, d)[1])
    .select("fold", F.coalesce("expanding", F.lit(0)).alias("expanding"), "k_fold")
)
_ = combinatorial

# Sequential bootstrap: each draw favours labels whose span the earlier draws cover least


def drawn(exits: np.ndarray, draws: int, rng: np.random.Generator) -> np.ndarray:
    """Indices drawn with probabilities in proportion to the mean of 1 / (1 + coverage) over each span [i, exit]; running sums
    give all means at once, so a draw costs the length of the history."""
    n, start = len(exits), np.arange(len(exits))
    live = exits >= start
    cover, out = np.zeros(n), []
    for _ in range(draws if live.any() else 0):
        sums = np.concatenate([[0.0], np.cumsum(1 / (cover + 1))])
        mean = np.where(live, (sums[np.where(live, exits, 0) + 1] - sums[start]) / np.maximum(exits - start + 1, 1), 0.0)
        pick = int(rng.choice(n, p=mean / mean.sum()))
        out.append(pick)
        cover[pick : exits[pick] + 1] += 1
    return np.array(out, np.int64)


def sequential_bootstrap(labels: DataFrame, draws: int = 100, seed: int = 7) -> DataFrame:
    """symbol, draw and t: ``draws`` labels of each symbol (symbol, t, exit_t), one symbol a task; a symbol's own seed."""

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("t")
        exits = group["exit_t"].fillna(-1).to_numpy(np.int64)
        places = drawn(exits, draws, np.random.default_rng([seed, *group["symbol"].iloc[0].encode()]))
        return pd.DataFrame({"symbol": group["symbol"].iloc[0], "draw": np.arange(len(places)), "t": group["t"].to_numpy()[places] if len(places) else []}).astype({"t": "int64"})

    return labels.select("symbol", "t", "exit_t").groupBy("symbol").applyInPandas(work, "symbol string, draw long, t long")


QUERIES["wgt_seq_bootstrap"] = lambda s, d: sequential_bootstrap(labelled(s, d))
query("lab_panel", f"{LABELLED} SELECT date, symbol, label FROM lab ORDER BY date, symbol")(lambda s, d: labelled(s, d).select("date", "symbol", "label").orderBy("date", "symbol"))


# The market day before each order's day: both in one order, the last day seen


def previous_day(asked: DataFrame, days: DataFrame) -> DataFrame:
    """date and prior, the last of ``days`` (date) before it. Both tables have one row a day, and years are their own parts but
    for the day carried in."""
    both = asked.select("date", F.lit(None).cast("date").alias("day")).unionByName(days.select("date", C("date").alias("day")))
    both = both.groupBy("date").agg(F.max("day").alias("day"), F.count_if(C("day").isNull()).alias("asked"))
    seen = F.max("day").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1))  # one row a day
    return both.withColumn("prior", seen).where("asked > 0").select("date", "prior")


query("join_asof_prev_day", f"{bars_sql(DAY)}, d AS (SELECT DISTINCT date FROM bars WHERE day(date) % 3 = 0), o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) SELECT o.date, (SELECT max(d.date) FROM d WHERE d.date < o.date) AS prior FROM o")(
    lambda s, d: previous_day(s.read.parquet(f"{d}/orders.parquet").select(C("o_orderdate").cast("date").alias("date")).distinct(), bars(s, d, DAY).where("day(date) % 3 = 0").select("date").distinct())
)

# One run from rows to report, and what is served of it


def mdl_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of figures of a run: rows, folds, AUC of the linear baseline and of the stack over out-of-fold scores, and the
    p-value of the stack's scores when labels change hands within a day. The stack's level is fitted in sample, as its
    name says."""
    from quantlake.plans.models import mdl_meta_scores, mdl_oof

    held = mdl_oof(spark, sf_dir)
    stacked = mdl_meta_scores(spark, sf_dir, held).select("symbol", "date", "fold", C("meta_in_sample").alias("stack"))
    both = written(held.select("symbol", "date", "fold", C("linear").alias("base"), "y").join(stacked, ["symbol", "date", "fold"]), "both")
    figures = compared(both)
    chance = verdicts(fixed_scores(both.withColumnRenamed("stack", "p"))).select("p_value", "significant")
    folds = held.agg(F.countDistinct("fold").alias("folds"), F.countDistinct("symbol").alias("universe_size"))
    for one in (chance, folds):
        figures = figures.join(F.broadcast(one), how="cross")  # one row each
    return figures


def srv_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date, p, signal, confidence, size and the drivers of each symbol's newest bar: those of the linear base of the stack that
    is served."""
    from quantlake.plans.serving import facts, signal, split
    from quantlake.sources.files import scratch

    rows, linear = served(spark, sf_dir)
    path = scratch(spark, "served")
    rows.write.parquet(path)
    rows = spark.read.parquet(path)
    drivers = split(facts(shares(rows, linear)))
    rows = rows.select("symbol", "date", "p").withColumn("sig", signal(C("p"))).withColumn("confidence", F.greatest(C("p"), 1 - C("p")))
    size = F.when(C("sig") == "HOLD", 0.0).otherwise(F.least(F.lit(10.0), 2 * F.abs(C("p") - 0.5) * C("confidence") * 10))
    return rows.withColumn("size_pct", F.round(size, 2)).join(drivers, "symbol", "left")


QUERIES |= {"mdl_train": mdl_train, "srv_predict": srv_predict}
