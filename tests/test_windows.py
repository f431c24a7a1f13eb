"""Exponential averages over long histories, held against the plain recursion."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantlake.functions import windows as fw
from quantlake.plans import chains

ROWS = 10_000


@pytest.fixture(scope="module")
def history(spark):
    rng = np.random.default_rng(1)
    values = {"A": np.full(ROWS, 100.0), "B": 100 * np.exp(np.cumsum(rng.normal(0, 0.01, ROWS))), "C": np.array([5.0, 7.0])}
    first = datetime.date(1980, 1, 1)
    rows = [(s, first + datetime.timedelta(i), float(x)) for s, v in values.items() for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "symbol string, date date, close double"), values


def recursion(values, alpha):
    out = [values[0]]
    for x in values[1:]:
        out.append(out[-1] + alpha * (x - out[-1]))
    return np.array(out)


@pytest.mark.parametrize("alpha", [0.2, 2 / 13, 1 / 14, 2 / 51])
def test_exponential_average_of_any_length(history, alpha):
    frame, values = history
    text = frame.selectExpr("*", "row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS t")
    for have in (frame.select("symbol", "date", fw.ewm(F.col("close"), alpha, 1).alias("y")), text.selectExpr("symbol", "date", chains.ewm("close", "t", alpha, 1) + " AS y")):
        found = have.orderBy("symbol", "date").toPandas()
        for symbol, part in found.groupby("symbol"):
            assert np.allclose(part["y"].to_numpy(), recursion(values[symbol], alpha), rtol=1e-11, atol=0)


def test_exponential_average_waits_for_enough_values(history):
    frame, _ = history
    found = frame.where("symbol = 'C'").select(fw.ewm(F.col("close"), 0.5, 2).alias("y")).collect()
    assert [r["y"] for r in found] == [None, 6.0]
