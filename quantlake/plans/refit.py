"""Models fitted in every fold at once, and what is traded on them: backtests, combinatorial paths, permutation tests.

The model is the regression of the direction of the next HORIZON bars on a few features, by normal equations. Its sums are
aggregated once by which folds a day trains (folds change role on a few days only), and a fold's sums are those of its
kinds of days: rows are never copied from fold to fold. What is solved has one row a fold. Permutations share the sums of
products of the features; only those with the labels are taken anew. The SQL is written apart: rows meet folds in range
joins, and the systems are eliminated step by step.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantlake.plans.chains import PLACED, placed
from quantlake.plans.labels import COMBINATIONS, EMBARGO, GROUPS, LEAST_TRAIN, PURGE, SPLITS, combinatorial, purged_panel
from quantlake.plans.market import C, query
from quantlake.plans.serving import BUY, SELL
from quantlake.sources.bars import by_symbol

HORIZON, RIDGE, COST, YEAR = 5, 1e-6, 0.001, 252
EVERY = {"weekly": 5, "daily": 1}
X = ("x0", "x1", "x2", "x3")
PAIRS = [(i, j) for i in range(len(X)) for j in range(i, len(X))]
#: Training rows that a fold of one symbol, and a split of the whole panel, must have.
LEAST_ROWS, LEAST_SPLIT_ROWS = 10, 500
FLAT = 1e-12


def design(rows: DataFrame) -> DataFrame:
    """Daily bars with the constant, the features, y (whether the close is higher HORIZON bars on; null at the end) and the return
    of the next bar; rows without all features are left out."""
    lag = lambda n: F.lag("close", n).over(by_symbol())
    ahead = F.lead("close", HORIZON).over(by_symbol())
    return rows.select(
        "symbol", "date", (C("place") - 1).alias("pos"), "n_days", F.lit(1.0).alias("x0"), (C("close") / lag(1) - 1).alias("x1"), (C("close") / lag(5) - 1).alias("x2"),
        ((C("high") - C("low")) / C("close")).alias("x3"), (ahead > C("close")).cast("double").alias("y"), (F.lead("close").over(by_symbol()) / C("close") - 1).alias("next_return"),
    ).dropna(subset=list(X))


def days_of(rows: DataFrame) -> DataFrame:
    return rows.select("date", "pos", "n_days").distinct()


def kinds(roles: DataFrame) -> DataFrame:
    """date, trains and tests: the folds in which a day has the role. Few days differ in them."""
    of = lambda role: F.sort_array(F.collect_list(F.when(C("role") == role, C("fold"))))
    return roles.groupBy("date").agg(of("train").alias("trains"), of("test").alias("tests"))


def normal_sums(rows: DataFrame, days: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys``, fold, n and the sums of products of X with X (a) and with y (b), over the rows that train the fold."""
    sums = [F.count("*").alias("n"), *(F.sum(C(X[i]) * C(X[j])).alias(f"a{i}{j}") for i, j in PAIRS), *(F.sum(C(x) * C("y")).alias(f"b{i}") for i, x in enumerate(X))]
    parts = rows.where("y IS NOT NULL").join(days.select("date", "trains"), "date").groupBy(*keys, "trains").agg(*sums)
    names = [c for c in parts.columns if c not in (*keys, "trains")]
    return parts.withColumn("fold", F.explode("trains")).groupBy(*keys, "fold").agg(*(F.sum(c).alias(c) for c in names))


def solved(a: np.ndarray, b: np.ndarray, n: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Coefficients of each system (…, k, k) and (…, k, m); the constant, which is first, is not shrunk."""
    shrink = np.eye(a.shape[-1]) * ridge
    shrink[0, 0] = 0
    return np.linalg.solve(a + np.asarray(n, float)[..., None, None] * shrink, b)


def coefficients(sums: DataFrame, keys: tuple[str, ...] = (), least: int = LEAST_ROWS, of: tuple[int, ...] = tuple(range(len(X)))) -> DataFrame:
    """``keys``, fold, n and beta (0 for features that are not ``of`` the model) of each fold with at least ``least`` training rows;
    one small system a row."""
    types, of = dict(sums.dtypes), list(of)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a = np.empty((len(batch), len(X), len(X)))
            for i, j in PAIRS:
                a[:, i, j] = a[:, j, i] = batch[f"a{i}{j}"]
            b = batch[[f"b{i}" for i in range(len(X))]].to_numpy()[:, :, None]
            beta = np.zeros((len(batch), len(X)))
            beta[:, of] = solved(a[:, of][:, :, of], b[:, of], batch["n"].to_numpy())[:, :, 0]
            yield batch[[*keys, "fold", "n"]].assign(beta=list(beta))

    schema = ", ".join(f"{k} {types[k]}" for k in (*keys, "fold", "n")) + ", beta array<double>"
    return sums.where(C("n") >= least).mapInPandas(solve, schema)


def predicted(rows: DataFrame, days: DataFrame, betas: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The rows of each fold's test days with fold and p, cut to 0..1."""
    tests = rows.join(days.select("date", F.explode("tests").alias("fold")), "date").join(betas.select(*keys, "fold", "beta"), [*keys, "fold"])
    return tests.withColumn("p", cut(C("beta"))).drop("beta")


def cut(beta: Column, names: tuple[str, ...] = X) -> Column:
    """The prediction of the coefficients ``beta`` for the features ``names``, cut to 0..1."""
    p = sum((beta[i] * C(x) for i, x in enumerate(names)), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))


def traded(rows: DataFrame, frequency: str = "weekly", by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``rows`` (by, date, fold, p, next_return) with position and strategy_return (of the next bar, less costs). A position is set
    every few bars of a fold, held between and carried into the next fold; bars without a next one earn nothing and go."""
    if frequency not in EVERY:
        raise ValueError(f"frequency {frequency} is none of {sorted(EVERY)}")
    in_fold, in_order = Window.partitionBy(*by, "fold").orderBy("date"), Window.partitionBy(*by).orderBy("date")
    sets = (F.row_number().over(in_fold) - 1) % EVERY[frequency] == 0
    rows = rows.withColumn("wanted", F.when(sets, F.when(C("p") >= BUY, 1).when(C("p") <= SELL, -1).otherwise(0)))
    rows = rows.withColumn("position", F.last("wanted", ignorenulls=True).over(in_order))
    cost = F.abs(C("position") - F.coalesce(F.lag("position").over(in_order), F.lit(0))) * COST
    return rows.withColumn("strategy_return", C("position") * C("next_return") - cost).where("next_return IS NOT NULL").drop("wanted")


def backtest(spark: SparkSession, sf_dir: str, frequency: str = "weekly") -> DataFrame:
    """Each symbol's expanding folds, fitted on what came before the purged days, and traded on the fold's test days."""
    rows = design(placed(spark, sf_dir))
    days = kinds(purged_panel(days_of(rows)))
    betas = coefficients(normal_sums(rows, days, ("symbol",)), ("symbol",))
    return traded(predicted(rows, days, betas, ("symbol",)), frequency)


def sharpe(r: Column, ddof: int = 1) -> Column:
    """Of daily returns: null below two or when flat; with ddof 0 a flat one is 0."""
    if ddof:
        sd = F.stddev_samp(r)
        return F.when(sd >= FLAT, F.avg(r) / sd * sqrt(YEAR))
    sd = F.stddev_pop(r)
    return F.when(sd >= FLAT, F.avg(r) / sd * sqrt(YEAR)).otherwise(0.0)


# The same in SQL

DESIGN = f"""{PLACED}, d0 AS (SELECT symbol, date, place - 1 AS pos, n_days, 1.0::DOUBLE AS x0, close / lag(close) OVER w - 1 AS x1, close / lag(close, 5) OVER w - 1 AS x2, (high - low) / close AS x3,
      CASE WHEN lead(close, {HORIZON}) OVER w > close THEN 1.0::DOUBLE WHEN lead(close, {HORIZON}) OVER w <= close THEN 0.0::DOUBLE END AS y, lead(close) OVER w / close - 1 AS next_return
      FROM placed WINDOW w AS (PARTITION BY symbol ORDER BY date)),
    d AS (SELECT * FROM d0 WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL)"""
FOLDS = f"""mdays AS MATERIALIZED (SELECT DISTINCT date, pos, n_days FROM d), f0 AS (SELECT fold, any_value(n_days) AS n_days, {LEAST_TRAIN} + fold * ((any_value(n_days) - {LEAST_TRAIN}) // {SPLITS}) AS a FROM mdays, range({SPLITS}) r(fold) GROUP BY fold),
    f AS (SELECT fold, a, CASE WHEN fold = {SPLITS - 1} THEN n_days - 1 ELSE a + (n_days - {LEAST_TRAIN}) // {SPLITS} - 1 END AS b FROM f0)"""


def sums_sql(rows: str, keys: str, y: str = "y", x: tuple[str, ...] = X, e: str = "e") -> str:
    """CTE e0: the sums over ``rows``, a join that gives ``x``, y and ``keys``."""
    sums = [f"sum({x[i]} * {x[j]}) AS a{i}{j}" for i in range(len(x)) for j in range(i, len(x))] + [f"sum({c} * {y}) AS b{i}" for i, c in enumerate(x)]
    return f"{e}0 AS (SELECT {keys}, count(*) AS n, {', '.join(sums)} FROM {rows} WHERE {y} IS NOT NULL GROUP BY {keys})"


def solve_sql(keys: str, least: int, k: int = len(X), e: str = "e", beta: str = "beta", c: str = "c") -> str:
    """CTEs e1.. that eliminate the system of each row of e0, and beta with the coefficients c0..; no pivots are needed, as the
    matrix is positive definite."""
    entry = lambda i, j: f"a{min(i, j)}{max(i, j)}" + (f" + n * {RIDGE!r}" if i == j and i else "")
    out = [f"{e}1 AS (SELECT {keys}, n, {', '.join(f'{entry(i, j)} AS m{i}{j}' for i in range(k) for j in range(k))}, {', '.join(f'b{i}' for i in range(k))} FROM {e}0 WHERE n >= {least})"]
    for s in range(k):  # row s is made to lead with 1, and taken from all other rows
        cells = [f"m{s}{j} / m{s}{s} AS m{s}{j}" if i == s else f"m{i}{j} - m{i}{s} / m{s}{s} * m{s}{j} AS m{i}{j}" for i in range(k) for j in range(k)]
        rights = [f"b{s} / m{s}{s} AS b{s}" if i == s else f"b{i} - m{i}{s} / m{s}{s} * b{s} AS b{i}" for i in range(k)]
        out.append(f"{e}{s + 2} AS (SELECT {keys}, n, {', '.join(cells)}, {', '.join(rights)} FROM {e}{s + 1})")
    return ", ".join([*out, f"{beta} AS (SELECT {keys}, n, {', '.join(f'b{i} AS {c}{i}' for i in range(k))} FROM {e}{k + 1})"])


def cut_sql(x: tuple[str, ...] = X, c: str = "c") -> str:
    return "greatest(0.0, least(1.0, " + " + ".join(f"{c}{i} * {name}" for i, name in enumerate(x)) + "))"


P = cut_sql()


def trade_sql(rows: str, by: str, every: int) -> str:
    """CTE bt over ``rows`` (by, date, fold, p, next_return)."""
    return f"""w0 AS (SELECT *, row_number() OVER (PARTITION BY {by}, fold ORDER BY date) - 1 AS k FROM {rows}),
    w1 AS (SELECT *, CASE WHEN k % {every} = 0 THEN CASE WHEN p >= {BUY} THEN 1 WHEN p <= {SELL} THEN -1 ELSE 0 END END AS wanted FROM w0),
    w2 AS (SELECT *, last_value(wanted IGNORE NULLS) OVER (PARTITION BY {by} ORDER BY date ROWS UNBOUNDED PRECEDING) AS position FROM w1),
    w3 AS (SELECT *, position * next_return - abs(position - coalesce(lag(position) OVER (PARTITION BY {by} ORDER BY date), 0)) * {COST} AS strategy_return FROM w2),
    bt AS (SELECT * FROM w3 WHERE next_return IS NOT NULL)"""


def backtest_sql(every: int) -> str:
    return f"""{DESIGN}, {FOLDS}, {sums_sql(f"d JOIN f ON d.pos < f.a - {PURGE}", "symbol, fold")}, {solve_sql("symbol, fold", LEAST_ROWS)},
    tests AS (SELECT d.*, fold, {P} AS p FROM d JOIN f ON pos BETWEEN a AND b JOIN beta USING (symbol, fold)), {trade_sql("tests", "symbol", every)}"""


query("bt_run", f"{backtest_sql(5)} SELECT symbol, date, CAST(fold AS INTEGER) AS fold, round(p, 6) AS p, position, round(strategy_return, 8) AS strategy_return FROM bt")(
    lambda s, d: backtest(s, d).select("symbol", "date", "fold", F.round("p", 6).alias("p"), "position", F.round("strategy_return", 8).alias("strategy_return"))
)
_totals = "count(*) AS n, round(sum(strategy_return), 6) AS total, count(DISTINCT fold) AS folds"
query("bt_config", " UNION ALL ".join(f"(SELECT '{k}' AS frequency, * FROM ({backtest_sql(n)} SELECT {_totals} FROM bt))" for k, n in EVERY.items()))(
    lambda s, d: (lambda one: one("weekly").unionByName(one("daily")))(
        lambda k: backtest(s, d, k).agg(F.lit(k).alias("frequency"), F.count("*").alias("n"), F.round(F.sum("strategy_return"), 6).alias("total"), F.countDistinct("fold").alias("folds"))
    )
)
query(
    "bt_folds",
    f"{backtest_sql(5)} SELECT symbol, CAST(fold AS INTEGER) AS fold, any_value(n) AS n_train, count(*) AS n_test, min(date) AS test_start, max(date) AS test_end FROM bt JOIN beta USING (symbol, fold) GROUP BY symbol, fold",
)(lambda s, d: fold_report(s, d))


def fold_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each fold of a symbol was fitted and tested on."""
    rows = design(placed(spark, sf_dir))
    days = kinds(purged_panel(days_of(rows)))
    fits = normal_sums(rows, days, ("symbol",)).where(C("n") >= LEAST_ROWS).select("symbol", "fold", C("n").alias("n_train"))
    tests = rows.where("next_return IS NOT NULL").join(days.select("date", F.explode("tests").alias("fold")), "date").groupBy("symbol", "fold")
    return tests.agg(F.count("*").alias("n_test"), F.min("date").alias("test_start"), F.max("date").alias("test_end")).join(fits, ["symbol", "fold"])


# Combinatorial paths: every group of days is tested in several splits, and a path takes each group from one of them


def path_table(spark: SparkSession) -> DataFrame:
    """fold, group and path: the n-th split that tests a group serves path n. C(GROUPS, TESTED) * TESTED rows."""
    seen, rows = [0] * GROUPS, []
    for fold, groups in enumerate(COMBINATIONS):
        for g in groups:
            rows.append((fold, g, seen[g]))
            seen[g] += 1
    return spark.createDataFrame(rows, "fold int, group int, path int")


def on_paths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(rows of complete paths with path, group, fold and p; training rows of each split). A path has one prediction for every bar."""
    rows = design(placed(spark, sf_dir))
    found = days_of(rows)
    group = sum((F.when(C("pos") >= F.floor(C("n_days") * g / GROUPS), 1).otherwise(0) for g in range(GROUPS)), F.lit(0)) - 1
    days = kinds(combinatorial(found)).join(found.select("date", group.alias("group")), "date")
    betas = coefficients(normal_sums(rows, days), least=LEAST_SPLIT_ROWS)
    tested = predicted(rows.join(days.select("date", "group"), "date"), days, betas)
    paths = path_table(spark).join(betas.select("fold", "n"), "fold")
    whole = paths.groupBy("path").agg(F.count("*").alias("groups")).where(C("groups") == GROUPS).select("path")
    paths = paths.join(whole, "path")
    return tested.join(F.broadcast(paths.select("fold", "group", "path")), ["fold", "group"]), paths


def path_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, date and r: the mean over symbols of what each path earns on a day."""
    rows = on_paths(spark, sf_dir)[0]
    earned = traded(rows.drop("fold").withColumnRenamed("group", "fold"), by=("path", "symbol"))
    return earned.groupBy("path", "date").agg(F.avg("strategy_return").alias("r"))


def path_sharpes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return path_returns(spark, sf_dir).groupBy("path").agg(F.count("*").alias("n_days"), sharpe(C("r")).alias("sharpe"))


PATHS = f"""{DESIGN}, mdays AS MATERIALIZED (SELECT DISTINCT date, pos, n_days FROM d), sp AS (SELECT row_number() OVER (ORDER BY x, y) - 1 AS fold, x, y FROM range({GROUPS}) a(x), range({GROUPS}) b(y) WHERE x < y),
    dr AS MATERIALIZED (SELECT date, fold, CASE WHEN (pos >= n_days * x // {GROUPS} AND pos < n_days * (x + 1) // {GROUPS}) THEN x WHEN (pos >= n_days * y // {GROUPS} AND pos < n_days * (y + 1) // {GROUPS}) THEN y END AS grp,
      (pos >= n_days * x // {GROUPS} - {PURGE} AND pos < n_days * (x + 1) // {GROUPS} + {EMBARGO}) OR (pos >= n_days * y // {GROUPS} - {PURGE} AND pos < n_days * (y + 1) // {GROUPS} + {EMBARGO}) AS kept_out FROM mdays, sp),
    {sums_sql("d JOIN dr USING (date)", "fold").replace("WHERE y IS NOT NULL", "WHERE NOT kept_out AND d.y IS NOT NULL")}, {solve_sql("fold", LEAST_SPLIT_ROWS)},
    pt0 AS (SELECT fold, grp, row_number() OVER (PARTITION BY grp ORDER BY fold) - 1 AS path FROM (SELECT fold, x AS grp FROM sp UNION ALL SELECT fold, y FROM sp)),
    pt AS (SELECT fold, grp, path, n FROM pt0 JOIN beta USING (fold) QUALIFY count(*) OVER (PARTITION BY path) = {GROUPS}),
    ps AS (SELECT d.symbol, d.date, path, grp AS fold, fold AS split, {P} AS p, next_return FROM d JOIN dr USING (date) JOIN pt USING (fold, grp) JOIN beta USING (fold)), {trade_sql("ps", "path, symbol", 5)},
    pr AS (SELECT path, date, avg(strategy_return) AS r FROM bt GROUP BY path, date), sh AS (SELECT path, count(*) AS n_days, CASE WHEN stddev_samp(r) >= {FLAT} THEN avg(r) / stddev_samp(r) * sqrt({YEAR}) END AS sharpe FROM pr GROUP BY path)"""
query("cv_cpcv_paths", f"{PATHS} SELECT CAST(path AS INTEGER) AS path, CAST(ps.fold AS INTEGER) AS \"group\", CAST(split AS INTEGER) AS fold, any_value(pt.n) AS n_train, count(*) AS n_test FROM ps JOIN pt USING (path) WHERE pt.grp = ps.fold GROUP BY ALL")(
    lambda s, d: (lambda rows, paths: rows.groupBy("path", "group", "fold").agg(F.count("*").alias("n_test")).join(paths.select("path", "group", C("n").alias("n_train")), ["path", "group"]))(*on_paths(s, d))
)
query("st_sharpe_paths", f"{PATHS} SELECT CAST(path AS INTEGER) AS path, n_days, round(sharpe, 6) AS sharpe FROM sh")(
    lambda s, d: path_sharpes(s, d).select("path", "n_days", F.round("sharpe", 6).alias("sharpe"))
)
query("st_evaluate_paths", f"{PATHS} SELECT CAST(path AS INTEGER) AS path, date, round(r, 8) AS r FROM pr")(lambda s, d: path_returns(s, d).select("path", "date", F.round("r", 8).alias("r")))
query(
    "st_distribution",
    f"{PATHS} SELECT count(*) AS n_paths, round(avg(sharpe), 6) AS mean, round(stddev_samp(sharpe), 6) AS std, round(median(sharpe), 6) AS median, round(quantile_cont(sharpe, 0.05), 6) AS p05, round(quantile_cont(sharpe, 0.95), 6) AS p95, avg(CASE WHEN sharpe < 0 THEN 1.0 WHEN sharpe >= 0 THEN 0.0 END) AS prob_negative FROM sh",
)(
    lambda s, d: path_sharpes(s, d).agg(
        F.count("*").alias("n_paths"), F.round(F.avg("sharpe"), 6).alias("mean"), F.round(F.stddev_samp("sharpe"), 6).alias("std"),
        *(F.round(F.percentile("sharpe", F.lit(q)), 6).alias(k) for k, q in {"median": 0.5, "p05": 0.05, "p95": 0.95}.items()), F.avg(F.when(C("sharpe").isNotNull(), (C("sharpe") < 0).cast("double"))).alias("prob_negative"),
    )
)
