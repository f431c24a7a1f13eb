"""Permutation tests that run the whole procedure on shuffled labels, without a copy of the rows for each shuffle.

Products of features with each other do not depend on the labels, so they are summed once; products with the labels are taken
for all shuffles of a group at a time, as arrays. A group is one symbol's history, or one day's cross-section: both are bounded
by the calendar or the universe. Shuffles are keyed: label i goes where a hash of (symbol, date, shuffle) ranks i-th.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantlake.plans.chains import placed
from quantlake.plans.labels import PURGE, purged_panel
from quantlake.plans.market import C, query
from quantlake.plans.refit import COST, DESIGN, EVERY, FLAT, FOLDS, LEAST_ROWS, PAIRS, YEAR, P, X, days_of, design, kinds, normal_sums, solve_sql, solved, sums_sql, trade_sql
from quantlake.plans.serving import BUY, SELL

SHUFFLES = 50
PRIME, FACTORS = 2147483647, (7919, 104729, 1299709, 48271, 16807)


def orders(symbol: np.ndarray, day: np.ndarray, shuffles: int, ties: np.ndarray) -> np.ndarray:
    """(row, shuffle): which row's label each row gets; column 0 leaves labels where they are. Rows are in the order of ``ties``."""
    a, b, c, d, e = FACTORS
    out = np.empty((len(symbol), shuffles + 1), np.int64)
    out[:, 0] = np.arange(len(symbol))
    for s in range(1, shuffles + 1):
        h = (symbol * a + day * b + s * c) * d % PRIME * e % PRIME
        out[:, s] = np.lexsort((ties, h))
    return out


KEY = "({0} * {f[0]} + {1} * {f[1]} + shuffle * {f[2]}) * {f[3]} % {p} * {f[4]} % {p}".format("sk", "dk", f=FACTORS, p=PRIME)


def keyed(rows: DataFrame) -> DataFrame:
    """With the numbers that shuffles are keyed by: a hash of the symbol and the day."""
    return rows.withColumn("sk", F.conv(F.substring(F.md5("symbol"), 1, 8), 16, 10).cast("long") % 1_000_000).withColumn("dk", F.unix_date("date").cast("long"))


def positions(p: np.ndarray) -> np.ndarray:
    return (p >= BUY).astype(np.int8) - (p <= SELL)


def replay(group: pd.DataFrame, shuffles: int, every: int) -> np.ndarray:
    """The Sharpe ratio of one symbol's backtest under each shuffle of its labels; NaN if nothing was traded."""
    group = group.sort_values("date", kind="stable")
    x, y, r = group[list(X)].to_numpy(float), group["y"].to_numpy(float), group["next_return"].to_numpy(float)
    known = np.flatnonzero(~np.isnan(y))
    order = orders(group["sk"].to_numpy()[known], group["dk"].to_numpy()[known], shuffles, np.arange(len(known)))
    labels = y[known][order]
    folds = sorted({f for t in group["tests"] for f in t})
    held, earned, row = None, [], group["tests"].map(lambda t: t[0] if len(t) else -1).to_numpy()
    for fold in folds:
        train = group["trains"].map(lambda t, f=fold: f in t).to_numpy()[known]
        if train.sum() < LEAST_ROWS:
            continue
        xt, test = x[known[train]], np.flatnonzero(row == fold)
        beta = solved(xt.T @ xt, xt.T @ labels[train], np.float64(train.sum()))
        wanted = positions(np.clip(x[test[::every]] @ beta, 0, 1))
        position = np.repeat(wanted, every, 0)[: len(test)].astype(float)
        before = np.concatenate([np.zeros((1, shuffles + 1)) if held is None else held, position[:-1]])
        gain = position * r[test][:, None] - np.abs(position - before) * COST
        held = position[-1:]
        earned.append(gain[~np.isnan(r[test])])
    if not earned or not sum(map(len, earned)):
        return np.full(shuffles + 1, np.nan)
    gains = np.concatenate(earned)
    sd = gains.std(0)
    return np.where(sd >= FLAT, gains.mean(0) / np.where(sd >= FLAT, sd, 1) * sqrt(YEAR), 0.0)


def by_ticker(rows: DataFrame, days: DataFrame, shuffles: int = SHUFFLES, frequency: str = "weekly") -> DataFrame:
    """symbol, shuffle (0: labels as they are) and score: the Sharpe ratio of a full backtest on the shuffled labels of ``rows``,
    which design() made. ``days`` (kinds()) test each day in one fold at most."""

    def work(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"symbol": group["symbol"].iloc[0], "shuffle": np.arange(shuffles + 1, dtype=np.int32), "score": replay(group, shuffles, EVERY[frequency])})

    ready = keyed(rows).join(days, "date").select("symbol", "date", "sk", "dk", *X, "y", "next_return", "trains", "tests")
    out = ready.groupBy("symbol").applyInPandas(work, "symbol string, shuffle int, score double")
    return out.withColumn("score", F.nanvl("score", F.lit(None).cast("double")))


def verdicts(scores: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys``, observed, p_value, null_mean, null_std, null_95pct, z_score, significant and what it says. Shuffles without a score
    are left out; without an observed score nothing can be said, and there is no row."""
    seen = F.max(F.when(C("shuffle") == 0, C("score"))).over(Window.partitionBy(*keys))  # one row a shuffle
    rows = scores.withColumn("observed", seen).where("shuffle > 0 AND score IS NOT NULL AND observed IS NOT NULL")
    out = rows.groupBy(*keys, "observed").agg(
        ((F.count_if(C("score") >= C("observed")) + 1) / (F.count("*") + 1)).alias("p_value"), F.count("*").alias("n_shuffles"), F.avg("score").alias("null_mean"),
        F.stddev_samp("score").alias("null_std"), F.percentile("score", F.lit(0.95)).alias("null_95pct"),
    )
    z = (C("observed") - C("null_mean")) / F.nullif(C("null_std"), F.lit(0.0))
    good = F.format_string("The result survives label shuffling (p=%.4f): fewer than 1 in 20 random relabellings did this well.", "p_value")
    bad = F.format_string("The result does NOT survive label shuffling (p=%.4f). Randomly reshuffled labels produced a score this good %.1f%% of the time, so this edge is not distinguishable from chance.", "p_value", C("p_value") * 100)
    digits = ("observed", "p_value", "null_mean", "null_std", "null_95pct")
    return out.select(*keys, *(F.round(x, 6).alias(x) for x in digits), F.round(z, 4).alias("z_score"), "n_shuffles", (C("p_value") < 0.05).alias("significant"), F.when(C("p_value") < 0.05, good).otherwise(bad).alias("verdict"))


# The whole panel: labels change hands within a day, so the market's days stay as they are

#: What a shuffle is judged by, over the test rows: (row, shuffle) arrays of predictions and of shuffled labels to a value a cell.
Score = Callable[[np.ndarray, np.ndarray], np.ndarray]


def edge(p: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (p - 0.5) * (2 * y - 1)


def accuracy(p: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((p >= 0.5) == (y >= 0.5)).astype(float)


def shuffled_day(group: pd.DataFrame, shuffles: int) -> tuple[pd.DataFrame, np.ndarray]:
    group = group.sort_values("symbol", kind="stable")
    return group, group["y"].to_numpy(float)[orders(group["sk"].to_numpy(), group["dk"].to_numpy(), shuffles, np.arange(len(group)))]


def panel_scores(rows: DataFrame, days: DataFrame, shuffles: int = SHUFFLES, score: Score = edge, least: int = LEAST_ROWS) -> DataFrame:
    """shuffle and score: the mean of ``score`` over the test rows of all folds, each fold fitted on the shuffled labels."""
    ready = keyed(rows.where("y IS NOT NULL")).join(days, "date")

    def products(group: pd.DataFrame) -> pd.DataFrame:
        group, labels = shuffled_day(group, shuffles)
        b = group[list(X)].to_numpy(float).T @ labels
        return pd.DataFrame({"trains": [group["trains"].iloc[0]] * (shuffles + 1), "shuffle": np.arange(shuffles + 1, dtype=np.int32)} | {f"b{i}": b[i] for i in range(len(X))})

    given = ", ".join(f"b{i} double" for i in range(len(X)))
    parts = ready.where(F.size("trains") > 0).groupBy("date").applyInPandas(products, f"trains array<int>, shuffle int, {given}")
    parts = parts.groupBy("trains", "shuffle").agg(*(F.sum(f"b{i}").alias(f"b{i}") for i in range(len(X))))
    b = parts.withColumn("fold", F.explode("trains")).groupBy("fold", "shuffle").agg(*(F.sum(f"b{i}").alias(f"b{i}") for i in range(len(X))))
    a = normal_sums(rows, days).where(C("n") >= least).select("fold", "n", *(f"a{i}{j}" for i, j in PAIRS))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            m = np.empty((len(batch), len(X), len(X)))
            for i, j in PAIRS:
                m[:, i, j] = m[:, j, i] = batch[f"a{i}{j}"]
            right = batch[[f"b{i}" for i in range(len(X))]].to_numpy()[:, :, None]
            yield batch[["fold", "shuffle"]].assign(beta=list(solved(m, right, batch["n"].to_numpy())[:, :, 0]))

    betas = b.join(a, "fold").mapInPandas(solve, "fold int, shuffle int, beta array<double>")
    betas = betas.groupBy("fold").agg(F.sort_array(F.collect_list(F.struct("shuffle", "beta"))).alias("betas"))  # folds x shuffles

    def judge(group: pd.DataFrame) -> pd.DataFrame:
        group, labels = shuffled_day(group, shuffles)
        beta = np.array([b["beta"] for b in group["betas"].iloc[0]]).T
        cells = score(np.clip(group[list(X)].to_numpy(float) @ beta, 0, 1), labels)
        return pd.DataFrame({"shuffle": np.arange(shuffles + 1, dtype=np.int32), "total": cells.sum(0), "n": np.int64(len(group))})

    tests = ready.withColumn("fold", F.explode("tests")).join(F.broadcast(betas), "fold")  # one row a fold
    found = tests.groupBy("date", "fold").applyInPandas(judge, "shuffle int, total double, n long")
    return found.groupBy("shuffle").agg((F.sum("total") / F.sum("n")).alias("score"))


def fixed_scores(rows: DataFrame, shuffles: int = SHUFFLES, score: Score = edge) -> DataFrame:
    """shuffle and score of predictions that are given (symbol, date, p, y): labels change hands within a day."""

    def judge(group: pd.DataFrame) -> pd.DataFrame:
        group, labels = shuffled_day(group, shuffles)
        cells = score(group["p"].to_numpy(float)[:, None], labels)
        return pd.DataFrame({"shuffle": np.arange(shuffles + 1, dtype=np.int32), "total": cells.sum(0), "n": np.int64(len(group))})

    found = keyed(rows.where("y IS NOT NULL AND p IS NOT NULL")).groupBy("date").applyInPandas(judge, "shuffle int, total double, n long")
    return found.groupBy("shuffle").agg((F.sum("total") / F.sum("n")).alias("score"))


def prepared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = design(placed(spark, sf_dir))
    return rows, kinds(purged_panel(days_of(rows)))


# The same in SQL


def shuffle_sql(group: str, order: str) -> str:
    """CTE y: symbol, date, shuffle and the label that the row gets."""
    return f"""v0 AS (SELECT symbol, date, y, CAST(CAST('0x' || substr(md5(symbol), 1, 8) AS UBIGINT) % 1000000 AS BIGINT) AS sk, CAST(date - DATE '1970-01-01' AS BIGINT) AS dk FROM d WHERE y IS NOT NULL), v1 AS (SELECT *, {KEY} AS h FROM v0, range({SHUFFLES + 1}) AS g(shuffle)),
    v2 AS (SELECT *, row_number() OVER (PARTITION BY shuffle, {group} ORDER BY {order}) AS i, CASE WHEN shuffle = 0 THEN row_number() OVER (PARTITION BY shuffle, {group} ORDER BY {order}) ELSE row_number() OVER (PARTITION BY shuffle, {group} ORDER BY h, {order}) END AS j FROM v1),
    y AS MATERIALIZED (SELECT a.symbol, a.date, a.shuffle, b.y AS label FROM v2 a JOIN v2 b ON a.shuffle = b.shuffle AND a.{group} = b.{group} AND a.i = b.j)"""


def verdict_sql(scores: str, key: str = "") -> str:
    by = f"{key}, " if key else ""
    return f"""z AS (SELECT {by}score AS observed FROM {scores} WHERE shuffle = 0 AND score IS NOT NULL),
    n AS (SELECT {by}any_value(observed) AS observed, (count(*) FILTER (score >= observed) + 1) / (count(*) + 1.0) AS p_value, count(*) AS n_shuffles, avg(score) AS null_mean, stddev_samp(score) AS null_std, quantile_cont(score, 0.95) AS null_95pct
      FROM {scores} JOIN z {f"USING ({key})" if key else "ON true"} WHERE shuffle > 0 AND score IS NOT NULL {f"GROUP BY {key}" if key else ""})
    SELECT {by}round(observed, 6) AS observed, round(p_value, 6) AS p_value, round(null_mean, 6) AS null_mean, round(null_std, 6) AS null_std, round(null_95pct, 6) AS null_95pct, round((observed - null_mean) / nullif(null_std, 0), 4) AS z_score, n_shuffles, p_value < 0.05 AS significant,
      CASE WHEN p_value < 0.05 THEN format('The result survives label shuffling (p={{:.4f}}): fewer than 1 in 20 random relabellings did this well.', p_value) ELSE format('The result does NOT survive label shuffling (p={{:.4f}}). Randomly reshuffled labels produced a score this good {{:.1f}}% of the time, so this edge is not distinguishable from chance.', p_value, p_value * 100) END AS verdict FROM n"""


TICKER = f"""{DESIGN}, {FOLDS}, {shuffle_sql("symbol", "date")}, l AS (SELECT d.* EXCLUDE (y), shuffle, label AS y FROM d JOIN y USING (symbol, date)),
    {sums_sql(f"l JOIN f ON l.pos < f.a - {PURGE}", "symbol, fold, shuffle")}, {solve_sql("symbol, fold, shuffle", LEAST_ROWS)},
    ts AS (SELECT d.symbol, d.date, next_return, fold, shuffle, {P} AS p FROM d JOIN f ON pos BETWEEN a AND b JOIN beta USING (symbol, fold)), {trade_sql("ts", "symbol, shuffle", 5)},
    sc AS (SELECT symbol, shuffle, CASE WHEN stddev_pop(strategy_return) >= {FLAT} THEN avg(strategy_return) / stddev_pop(strategy_return) * sqrt({YEAR}) ELSE 0.0 END AS score FROM bt GROUP BY symbol, shuffle)"""
PANEL = f"""{DESIGN}, {FOLDS}, {shuffle_sql("date", "symbol")}, l AS (SELECT d.* EXCLUDE (y), shuffle, label AS y FROM d JOIN y USING (symbol, date)),
    {sums_sql(f"l JOIN f ON l.pos < f.a - {PURGE}", "fold, shuffle")}, {solve_sql("fold, shuffle", LEAST_ROWS)},
    sc AS (SELECT shuffle, avg(({P} - 0.5) * (2 * y - 1)) AS score, avg(CASE WHEN ({P} >= 0.5) = (y >= 0.5) THEN 1.0 ELSE 0.0 END) AS hits FROM l JOIN f ON pos BETWEEN a AND b JOIN beta USING (fold, shuffle) GROUP BY shuffle)"""
query("perm_ticker", f"{TICKER}, {verdict_sql('sc', 'symbol')}")(lambda s, d: verdicts(by_ticker(*prepared(s, d)), ("symbol",)))
query("perm_run", f"{PANEL}, {verdict_sql('sc')}")(lambda s, d: verdicts(panel_scores(*prepared(s, d))))
query("perm_shuffle", f"{PANEL} SELECT CAST(shuffle AS INTEGER) AS shuffle, round(score, 8) AS score FROM sc")(lambda s, d: panel_scores(*prepared(s, d)).select("shuffle", F.round("score", 8).alias("score")))
query("perm_score_fn", f"{PANEL} SELECT CAST(shuffle AS INTEGER) AS shuffle, round(hits, 8) AS score FROM sc")(
    lambda s, d: panel_scores(*prepared(s, d), score=accuracy).select("shuffle", F.round("score", 8).alias("score"))
)
query("cmp_model", f"{PANEL}, r AS ({verdict_sql('sc').replace('z AS', 'WITH z AS', 1)}) SELECT (SELECT count(DISTINCT symbol) FROM d) AS universe_size, p_value, significant AS is_significant, {SHUFFLES} AS permutations FROM r")(
    lambda s, d: (lambda rows, days: verdicts(panel_scores(rows, days)).join(F.broadcast(rows.agg(F.countDistinct("symbol").alias("universe_size"))), how="cross"))(*prepared(s, d))  # one row each
    .select("universe_size", "p_value", C("significant").alias("is_significant"), F.lit(SHUFFLES).alias("permutations"))
)
