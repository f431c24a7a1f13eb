"""Fold-wise fits, backtests, paths and permutation tests against plain Python, on a planted signal and on noise."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantlake.plans import permute, refit
from quantlake.plans.labels import COMBINATIONS, PURGE, SPLITS, LEAST_TRAIN, purged_panel

SCHEMA = "symbol string, date date, high double, low double, close double, place int, n_days int"


def bars(spark, signal: float, symbols: int = 4, n: int = 700, seed: int = 3):
    """Closes whose next moves follow, with strength ``signal``, from today's range."""
    import datetime

    rng, rows = np.random.default_rng(seed), []
    for s in range(symbols):
        close, lift = 100.0, 0.0
        for t in range(n):
            close *= math.exp(0.01 * rng.normal() + signal * lift)
            wide = rng.uniform(0.0, 0.04)
            lift = (wide - 0.02) * 0.5
            rows.append((f"S{s}", datetime.date(2020, 1, 1) + datetime.timedelta(t), close * (1 + wide), close, close, t + 1, n))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def noise(spark):
    return refit.design(bars(spark, 0.0)).persist()


@pytest.fixture(scope="module")
def planted(spark):
    return refit.design(bars(spark, 2.0)).persist()


def folds(rows):
    return refit.kinds(purged_panel(refit.days_of(rows)))


def plain_backtest(rows, labels=None, every=5):
    """date -> (fold, position, return) of one symbol's rows in order, by numpy's least squares a fold."""
    rows = sorted(rows, key=lambda r: r["date"])
    n, out, before = rows[0]["n_days"], {}, 0
    y = [r["y"] for r in rows] if labels is None else labels
    size = (n - LEAST_TRAIN) // SPLITS
    for fold in range(SPLITS):
        a = LEAST_TRAIN + fold * size
        b = n - 1 if fold == SPLITS - 1 else a + size - 1
        train = [i for i, r in enumerate(rows) if r["pos"] < a - PURGE and y[i] is not None]
        if len(train) < refit.LEAST_ROWS:
            continue
        x = np.array([[rows[i][c] for c in refit.X] for i in train])
        shrink = np.diag([0] + [math.sqrt(refit.RIDGE * len(train))] * 3)
        beta = np.linalg.lstsq(np.r_[x, shrink], np.r_[[y[i] for i in train], np.zeros(4)], rcond=None)[0]
        for k, r in enumerate([r for r in rows if a <= r["pos"] <= b]):
            p = min(1, max(0, float(np.dot(beta, [r[c] for c in refit.X]))))
            position = (1 if p >= refit.BUY else -1 if p <= refit.SELL else 0) if k % every == 0 else before
            if r["next_return"] is not None:
                out[r["date"]] = (fold, position, position * r["next_return"] - abs(position - before) * refit.COST)
            before = position
    return out


@pytest.mark.parametrize("frequency", ["weekly", "daily"])
def test_backtest_is_that_of_plain_least_squares(planted, frequency):
    days = folds(planted)
    betas = refit.coefficients(refit.normal_sums(planted, days, ("symbol",)), ("symbol",))
    found = refit.traded(refit.predicted(planted, days, betas, ("symbol",)), frequency).collect()
    for symbol in ("S0", "S3"):
        want = plain_backtest([r for r in planted.collect() if r["symbol"] == symbol], every=refit.EVERY[frequency])
        have = {r["date"]: (r["fold"], r["position"], r["strategy_return"]) for r in found if r["symbol"] == symbol}
        assert have.keys() == want.keys()
        assert all(have[d][:2] == want[d][:2] and math.isclose(have[d][2], want[d][2], abs_tol=1e-12) for d in want)
    with pytest.raises(ValueError):
        refit.traded(planted, "hourly")


def test_each_shuffle_is_a_whole_backtest(planted):
    one = planted.where("symbol = 'S1'")
    scores = {r["shuffle"]: r["score"] for r in permute.by_ticker(one, folds(one), shuffles=3).collect()}
    rows = sorted(permute.keyed(one).collect(), key=lambda r: r["date"])
    known = [i for i, r in enumerate(rows) if r["y"] is not None]
    order = permute.orders(np.array([rows[i]["sk"] for i in known]), np.array([rows[i]["dk"] for i in known]), 3, np.arange(len(known)))
    for s in range(4):
        labels = [None] * len(rows)
        for i, j in zip(known, order[:, s], strict=True):
            labels[i] = rows[known[j]]["y"]
        r = np.array([x[2] for x in plain_backtest(rows, labels).values()])
        assert math.isclose(scores[s], r.mean() / r.std() * math.sqrt(refit.YEAR) if r.std() else 0.0, abs_tol=1e-9)


def test_a_planted_signal_is_found_and_noise_refused(planted, noise):
    good, bad = (permute.verdicts(permute.by_ticker(rows, folds(rows), frequency="daily"), ("symbol",)).collect() for rows in (planted, noise))
    assert sum(r["significant"] for r in good) >= 3 and sum(r["significant"] for r in bad) <= 1
    good, bad = (permute.verdicts(permute.panel_scores(rows, folds(rows))).first() for rows in (planted, noise))
    assert good["significant"] and not bad["significant"] and good["p_value"] == round(1 / 51, 6)
    assert "does NOT survive" in bad["verdict"] and "survives" in good["verdict"]


def test_no_shuffle_without_a_score_counts(spark):
    scores = spark.createDataFrame([(0, 1.0), (1, None), (2, 2.0), (3, 0.5), (4, 1.0)], "shuffle int, score double")
    got = permute.verdicts(scores).first()
    assert (got["n_shuffles"], got["p_value"]) == (3, 0.75)
    assert permute.verdicts(scores.where("shuffle > 0")).count() == 0


def test_paths_take_every_group_once_from_splits_that_test_it(spark):
    rows = [tuple(r) for r in refit.path_table(spark).collect()]
    assert len(rows) == len(COMBINATIONS) * 2 and {p for _, _, p in rows} == set(range(5))
    for path in range(5):
        assert sorted(g for _, g, p in rows if p == path) == list(range(6))
    assert all(g in COMBINATIONS[f] for f, g, _ in rows) and len({(f, g) for f, g, _ in rows}) == 30


def test_sharpe_of_flat_and_short_series(spark):
    df = spark.createDataFrame([("flat", 0.1), ("flat", 0.1), ("one", 0.3), ("two", 0.1), ("two", 0.3)], "k string, r double").groupBy("k")
    got = {r["k"]: (r["a"], r["b"]) for r in df.agg(refit.sharpe(F.col("r")).alias("a"), refit.sharpe(F.col("r"), 0).alias("b")).collect()}
    assert got["flat"] == (None, 0.0) and got["one"] == (None, 0.0) and math.isclose(got["two"][0], 0.2 / math.sqrt(0.02) * math.sqrt(252))


def test_no_row_of_the_nested_stack_depends_on_its_own_label(planted):
    from quantlake.plans.stacked import BASES, nested, nested_roles

    day = planted.where("pos = 450").select("date").first()[0]
    flipped = planted.withColumn("y", F.when((F.col("date") == day) & F.col("y").isNotNull(), 1 - F.col("y")).otherwise(F.col("y")))
    said = lambda rows: {(r["symbol"], r["date"]): (r["p"], *(r[b] for b in BASES)) for r in nested(rows).collect()}
    one, two = said(planted), said(flipped)
    assert one.keys() == two.keys() and sum(d == day for _, d in one) == 4
    assert all(one[k] == two[k] for k in one if k[1] <= day) and any(one[k] != two[k] for k in one if k[1] > day)
    roles = nested_roles(refit.days_of(planted)).join(refit.days_of(planted), "date").groupBy("fold", "inner", "role").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).collect()
    at = {(r["fold"], r["inner"], r["role"]): (r["lo"], r["hi"]) for r in roles}
    assert all(at[f, i, "train"][1] < at[f, i, "test"][0] - PURGE for f, i, role in at if role == "train")
