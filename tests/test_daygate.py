"""The gate over files made by hand: T1 stops a file, rows are owned by their first rule, later tiers see accepted rows only."""

import datetime

import pytest

from quantlake.plans import daygate
from quantlake.plans.gate import CANONICAL, missing_columns

COLUMNS = "file_date date, symbol string, date date, open double, high double, low double, close double, prev_close double, volume long, turnover double, trades long, delivery_qty long, series string, delivery_pct double, isin string"
MONDAY = datetime.date(2021, 3, 1)


def day(k):
    return MONDAY + datetime.timedelta(k)


def bar(k, symbol, close: float | None = 10.0, prev=10.0, volume=100, file=None, **other):
    row = {"file_date": day(k if file is None else file), "symbol": symbol, "date": day(k), "open": close, "high": close, "low": close, "close": close, "prev_close": prev, "volume": volume, "turnover": 10.0 * volume if close is None else close * volume, "trades": 1, "delivery_qty": 1, "series": "EQ", "delivery_pct": 1.0, "isin": symbol}
    return tuple((row | other).values())


def files(spark, rows, actions=(), other=(), expected=(), days=(), lacking=()):
    frame = spark.createDataFrame(rows, COLUMNS)
    acts = spark.createDataFrame(list(actions), "symbol string, ex_date date, ratio double")
    seen = daygate.examined(frame, acts, spark.createDataFrame(list(other), "symbol string, date date, other double"))
    return daygate.judged_files(seen, spark.createDataFrame([(s,) for s in expected], "symbol string"), acts, spark.createDataFrame([(day(k),) for k in days], "date date"), list(lacking))


def told(found):
    verdicts = {(r["date"] - MONDAY).days: (r["verdict"], r["rows_in"], r["rows_accepted"]) for r in daygate.judged(found).collect()}
    rules = {}
    for r in daygate.reported(found).collect():
        rules.setdefault((r["date"] - MONDAY).days, {})[r["rule"]] = (r["affected_rows"], r["symbols"])
    return verdicts, rules


def test_a_file_of_another_day_and_one_without_rows_are_rejected(spark):
    rows = [bar(0, "A"), bar(0, "B"), bar(1, "A"), bar(2, "B", file=1), bar(2, "A"), bar(4, "A", low=99.0)]
    verdicts, rules = told(files(spark, rows, days=range(4)))
    assert verdicts == {0: ("PASS", 2, 2), 1: ("REJECTED", 2, 0), 2: ("PASS_WITH_WARNINGS", 1, 1), 3: ("REJECTED", 0, 0), 4: ("QUARANTINED", 1, 0)}
    assert rules[1] == {"T1_structural_date_match": (1, "")} and rules[3] == {"T1_structural_non_empty": (0, "")}
    # B is missed since the last accepted day, not since the rejected one; an accepted count of 1 is half of the usual 2
    assert rules[2] == {"T3_completeness_missing_symbols": (1, "B"), "T3_completeness_row_count": (1, "")}
    assert rules[4]["T2_validity_high_low"] == (1, "A") and "T2_validity_low_bounds" not in rules[4]


def test_columns_that_files_lack_reject_them_all(spark):
    verdicts, rules = told(files(spark, [bar(0, "A"), bar(1, "A", low=99.0)], lacking=["isin", "series"]))
    assert {v[0] for v in verdicts.values()} == {"REJECTED"} and rules[1] == {"T1_structural_schema": (2, "")}
    frame = spark.createDataFrame([bar(0, "A")], COLUMNS)
    assert missing_columns(frame) == [] and missing_columns(frame.drop("isin")) == ["isin"] and len(CANONICAL) == 14


def test_histories_are_of_accepted_rows(spark):
    rows = [bar(0, "A"), bar(1, "A", close=20.0, prev=10.0, low=99.0), bar(2, "A", close=10.0, prev=10.0), bar(3, "A", close=5.0, prev=5.0), bar(4, "A", close=5.0, prev=5.0)]
    _, rules = told(files(spark, rows))
    assert "T4_continuity_prev_close" not in rules.get(2, {})  # the held close of 20 is not what came before
    assert rules[3]["T4_continuity_prev_close"] == (1, "A") and 4 not in rules
    _, rules = told(files(spark, rows, actions=[("A", day(3), 0.5)]))
    assert "T4_continuity_prev_close" not in rules.get(3, {})


def test_expected_symbols_closed_days_and_a_second_source(spark):
    rows = [bar(0, "A"), bar(5, "A"), bar(7, "A", close=10.0)]
    verdicts, rules = told(files(spark, rows, expected=["A", "Z"], other=[("A", day(7), 11.0), ("A", day(0), 10.05)]))
    assert rules[5]["T3_completeness_trading_day"] == (1, "") and "T3_completeness_trading_day" not in rules[0]
    assert all(rules[k]["T3_completeness_expected_constituents"] == (1, "Z") for k in (0, 5, 7))
    assert rules[7]["T6_cross_source_close_agreement"] == (1, "A") and "T6_cross_source_close_agreement" not in rules[0]
    assert verdicts[0][0] == "PASS_WITH_WARNINGS"


@pytest.mark.parametrize("field", ["open", "close"])
def test_a_null_price_is_held_by_the_rule_of_prices(spark, field):
    verdicts, rules = told(files(spark, [bar(0, "A", **{field: None}), bar(0, "B")]))
    assert verdicts[0] == ("QUARANTINED", 2, 1) and rules[0]["T2_validity_positive_prices"] == (1, "A")
