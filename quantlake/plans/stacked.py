"""Learners of the library's own, and a stack whose two levels both stay out of fold.

The stack of a fold is fitted on scores of inner folds, each of which lies inside that fold's training days; its base models are
then fitted anew on all of the fold's training days. Both levels are the regressions of refit.py, so every (fold, inner fold) is
a sum over kinds of days, and all of them are solved at once.
"""

from __future__ import annotations

from math import sqrt

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantlake.operators.boosted import boost, platt
from quantlake.operators.descent import Descent
from quantlake.plans.chains import placed
from quantlake.plans.labels import PURGE, purged_panel
from quantlake.plans.learning import FEATURES, PENALTY, bce, sigmoid
from quantlake.plans.market import QUERIES, SCORED, C, query, scored
from quantlake.plans.models import FEATURES as PANEL_FEATURES
from quantlake.plans.models import panel, vector_second
from quantlake.plans.refit import DESIGN, FOLDS, LEAST_ROWS, X, coefficients, cut, cut_sql, days_of, design, kinds, normal_sums, solve_sql, solved, sums_sql
from quantlake.sources.files import scratch

INNER = 3
#: Features of each base model, by place.
BASES = {"short": (0, 1), "wide": (0, 2, 3)}
STACK = ("x0", *BASES)


def nested_roles(days: DataFrame, inner: int = INNER) -> DataFrame:
    """date, fold, inner and role (train, test) of each day in the inner folds of each outer fold: expanding folds over the days that
    train the outer one, purged before each inner test."""
    outer = purged_panel(days).where("role = 'train'").select("date", "pos", "fold", (C("start") - PURGE).alias("end"))
    size = F.floor(C("end") / (inner + 1))
    rows = outer.withColumn("inner", F.explode(F.sequence(F.lit(0), F.lit(inner - 1)))).withColumn("from", (C("inner") + 1) * size)
    to = F.when(C("inner") == inner - 1, C("end")).otherwise(C("from") + size)
    role = F.when((C("pos") >= C("from")) & (C("pos") < to), "test").when(C("pos") < C("from") - PURGE, "train")
    return rows.withColumn("role", role).where("role IS NOT NULL").select("date", "fold", "inner", "role")


def base_scores(rows: DataFrame, days: DataFrame, sums: DataFrame) -> DataFrame:
    """The rows of every fold's test days with fold and a column for each base model; ``days`` and ``sums`` of the same folds."""
    out = rows.join(days.select("date", F.explode("tests").alias("fold")), "date")
    for name, of in BASES.items():
        betas = coefficients(sums, of=of).select("fold", C("beta").alias("_beta"))
        out = out.join(betas, "fold").withColumn(name, cut(C("_beta"))).drop("_beta")
    return out


def stack_betas(rows: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """fold and beta of the stack, over rows (fold, y, base scores) of the inner folds."""
    pairs = [(i, j) for i in range(len(STACK)) for j in range(i, len(STACK))]
    sums = rows.where("y IS NOT NULL").groupBy("fold").agg(F.count("*").alias("n"), *(F.sum(C(STACK[i]) * C(STACK[j])).alias(f"a{i}{j}") for i, j in pairs), *(F.sum(C(c) * C("y")).alias(f"b{i}") for i, c in enumerate(STACK)))

    def solve(batches):
        for batch in batches:
            a = np.empty((len(batch), len(STACK), len(STACK)))
            for i, j in pairs:
                a[:, i, j] = a[:, j, i] = batch[f"a{i}{j}"]
            b = batch[[f"b{i}" for i in range(len(STACK))]].to_numpy()[:, :, None]
            yield batch[["fold"]].assign(beta=list(solved(a, b, batch["n"].to_numpy())[:, :, 0]))

    return sums.where(C("n") >= least).mapInPandas(solve, "fold int, beta array<double>")


def nested(rows: DataFrame) -> DataFrame:
    """``rows`` (design()) of the outer test days with fold, base scores and p, the stack's. No score depends on a label of its own
    test days, at either level. A fold whose inner folds teach nothing has no rows."""
    days = days_of(rows)
    roles = nested_roles(days).withColumn("fold", C("fold") * INNER + C("inner"))
    inner = kinds(roles.drop("inner"))
    below = base_scores(rows, inner, normal_sums(rows, inner)).withColumn("fold", F.floor(C("fold") / INNER).cast("int"))
    outer = kinds(purged_panel(days))
    above = base_scores(rows, outer, normal_sums(rows, outer)).join(stack_betas(below), "fold")
    return above.withColumn("p", cut(C("beta"), STACK)).drop("beta")


def _base_sql(cte: str, rows: str, keys: str, joined: str) -> str:
    """CTE ``cte``: rows of ``joined`` with both base scores, fitted over ``rows`` by ``keys``."""
    out, using = [], keys
    for name, of in BASES.items():
        x = tuple(X[i] for i in of)
        out += [sums_sql(rows, keys, x=x, e=f"{cte}_{name}_"), solve_sql(keys, LEAST_ROWS, len(x), f"{cte}_{name}_", f"{cte}_{name}", f"{name}_c")]
    scores = ", ".join(f"{cut_sql(tuple(X[i] for i in of), f'{name}_c')} AS {name}" for name, of in BASES.items())
    return ", ".join(out) + f", {cte} AS (SELECT symbol, date, {using}, x0, y, {scores} FROM {joined} {' '.join(f'JOIN {cte}_{name} USING ({using})' for name in BASES)})"


NESTED = f"""{DESIGN}, {FOLDS}, inn AS (SELECT fold, i AS inner_fold, a - {PURGE} AS until, (i + 1) * ((a - {PURGE}) // {INNER + 1}) AS lo, CASE WHEN i = {INNER - 1} THEN a - {PURGE} ELSE (i + 2) * ((a - {PURGE}) // {INNER + 1}) END AS hi FROM f, range({INNER}) r(i)),
    {_base_sql("low", f"d JOIN inn ON d.pos < inn.lo - {PURGE}", "fold, inner_fold", "d JOIN inn ON d.pos >= inn.lo AND d.pos < inn.hi")},
    {sums_sql("low", "fold", x=STACK, e="st")}, {solve_sql("fold", LEAST_ROWS, len(STACK), "st", "stb", "sc")},
    {_base_sql("high", f"d JOIN f ON d.pos < f.a - {PURGE}", "fold", "d JOIN f ON d.pos BETWEEN f.a AND f.b")}
    SELECT symbol, date, CAST(fold AS INTEGER) AS fold, round(short, 6) AS short, round(wide, 6) AS wide, round({cut_sql(STACK, "sc")}, 6) AS p FROM high JOIN stb USING (fold)"""
query("mdl_meta_nested", NESTED)(lambda s, d: nested(design(placed(s, d))).select("symbol", "date", "fold", *(F.round(c, 6).alias(c) for c in ("short", "wide", "p"))))

# The descent learner in a pipeline, saved and loaded; its steps in SQL start from the same seeded weights

STEPS, RATE = 8, 0.5
START = [float(w) for w in np.random.default_rng(42).normal(0, 1 / sqrt(len(FEATURES)), len(FEATURES))]


def mdl_interface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the probability of a pipeline that was fitted, saved and loaded."""
    rows = scored(spark, sf_dir).selectExpr("doc_id", "y", *(f"{x} AS {k}" for k, x in FEATURES.items()))
    learner = Descent(labelCol="y", maxIter=STEPS, stepSize=RATE, regParam=PENALTY)
    path = scratch(spark, "descent")
    Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), learner]).fit(rows).write().overwrite().save(path)
    return PipelineModel.load(path).transform(rows).select("doc_id", F.round(vector_second("probability"), 8).alias("p"), "prediction")


_std = ", ".join(f"({k} - avg({k}) OVER ()) / stddev_pop({k}) OVER () AS {k}" for k in FEATURES)
_z = "w.bias + " + " + ".join(f"w.{k} * x.{k}" for k in FEATURES)
INTERFACE = f"WITH {SCORED}, x0 AS (SELECT doc_id, y, {', '.join(f'{x} AS {k}' for k, x in FEATURES.items())} FROM s), x AS (SELECT doc_id, y, {_std} FROM x0), w0 AS (SELECT 0.0::DOUBLE AS bias, {', '.join(f'{w!r}::DOUBLE AS {k}' for k, w in zip(FEATURES, START, strict=True))})"
_miss = f"({sigmoid(_z)} - x.y)"
for _k in range(STEPS):
    INTERFACE += f", w{_k + 1} AS (SELECT any_value(w.bias) - {RATE} * avg({_miss}) AS bias, {', '.join(f'any_value(w.{k}) - {RATE} * (avg({_miss} * x.{k}) + {PENALTY} / count(*) * any_value(w.{k})) AS {k}' for k in FEATURES)} FROM x, w{_k} AS w)"
query("mdl_interface", f"{INTERFACE} SELECT doc_id, round({sigmoid(_z)}, 8) AS p, CASE WHEN {sigmoid(_z)} >= 0.5 THEN 1.0 ELSE 0.0 END AS prediction FROM x, w{STEPS} AS w")(mdl_interface)

# Platt scaling, and boosted trees with it

ROUNDS = 12


def mdl_platt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).select("doc_id", "p", C("y").cast("double").alias("y")).persist()
    scaling = platt(rows, "p", "y", rounds=ROUNDS, tol=0.0)
    out = spark.createDataFrame([(scaling.slope, scaling.shift)], "slope double, shift double")
    raw, fitted = rows.agg(F.avg(F.expr(bce("p"))), F.avg(F.expr(bce(f"1 / (1 + exp(-({scaling.slope!r}D * p + ({scaling.shift!r}D))))")))).first()
    rows.unpersist()
    return out.select(F.round("slope", 6).alias("slope"), F.round("shift", 6).alias("shift"), F.round(F.lit(raw), 6).alias("raw_logloss"), F.round(F.lit(fitted), 6).alias("logloss"))


PLATT = f"WITH {SCORED}, t0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)"
for _k in range(ROUNDS):
    PLATT += f""", g{_k} AS (SELECT any_value(a) AS a, any_value(b) AS b, sum((q - y) * p) + any_value(a) AS ga, sum(q - y) AS gb, sum(q * (1 - q) * p * p) + 1 AS haa, sum(q * (1 - q) * p) AS hab, sum(q * (1 - q)) AS hbb FROM (SELECT p, y, a, b, {sigmoid("a * p + b")} AS q FROM s, t{_k})),
    t{_k + 1} AS (SELECT a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM g{_k})"""
query("mdl_platt", f"{PLATT} SELECT round(any_value(a), 6) AS slope, round(any_value(b), 6) AS shift, round(avg({bce('p')}), 6) AS raw_logloss, round(avg({bce(sigmoid('a * p + b'))}), 6) AS logloss FROM s, t{ROUNDS}")(mdl_platt)


def mdl_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date, p_raw and p of boosted trees over the panel; at most 60 rounds here, fewer where the held-out loss stops falling."""
    rows = panel(spark, sf_dir)
    return boost(rows, list(PANEL_FEATURES), rounds=60, rate=0.1).transform(rows).select("symbol", "date", "y", "p_raw", "p")


QUERIES["mdl_boosted"] = mdl_boosted
