"""The panel's columns of one symbol against pandas, whose rolling and exponential windows define them."""

import numpy as np
import pandas as pd
import pytest

from quantlake.plans import daygate, gate, panel, store
from quantlake.plans.market import QUERIES
from quantlake.sources.bars import DAY, bars
from quantlake.sources.files import put, scratch
from tests.helpers import DATA


def plain(b: pd.DataFrame) -> pd.DataFrame:
    o, c, h, low, v = pd.DataFrame(), b["close"], b["high"], b["low"], b["volume"].astype(float)
    sma = lambda n: c.rolling(n, min_periods=n // 2).mean()
    ema = lambda x, n: x.ewm(span=n, adjust=False, min_periods=n // 2).mean()
    rma = lambda x, n: x.ewm(alpha=1 / n, adjust=False, min_periods=n).mean()
    z = lambda x, n: (x - x.rolling(n, min_periods=max(2, n // 4)).mean()) / x.rolling(n, min_periods=max(2, n // 4)).std().replace(0, np.nan)
    for n in (20, 50, 200):
        o[f"trend_sma_{n}"], o[f"trend_price_vs_sma{n}"] = sma(n), (c - sma(n)) / sma(n)
    for n in (12, 26, 50):
        o[f"trend_ema_{n}"] = ema(c, n)
    o["trend_golden_cross"] = np.where(sma(50).isna() | sma(200).isna(), np.nan, np.where(sma(50) > sma(200), 1.0, -1.0))
    macd = ema(c, 12) - ema(c, 26)
    signal = ema(macd, 9)
    o["trend_macd"], o["trend_macd_signal"], o["trend_macd_hist"], o["trend_macd_norm"] = macd, signal, macd - signal, macd / c
    d = c.diff()
    for n in (14, 28):
        o[f"momentum_rsi_{n}"] = (100 - 100 / (1 + rma(d.clip(lower=0), n) / rma(-d.clip(upper=0), n).replace(0, np.nan))).fillna(100)
    lo, hi = low.rolling(14, min_periods=7).min(), h.rolling(14, min_periods=7).max()
    k = 100 * (c - lo) / (hi - lo).replace(0, np.nan)
    o["momentum_stoch_k"], o["momentum_stoch_d"] = k, k.rolling(3, min_periods=1).mean()
    o["momentum_stoch_diff"] = k - o["momentum_stoch_d"]
    for name, n in {"1m": 21, "3m": 63, "6m": 126, "12m": 252}.items():
        o[f"momentum_roc_{name}"] = c.pct_change(n) * 100
    o["momentum_composite"] = pd.concat([z(o["momentum_roc_3m"], 252), z(o["momentum_roc_6m"], 252)], axis=1).mean(axis=1)
    sd = c.rolling(20, min_periods=10).std()
    o["volatility_bb_mid"], o["volatility_bb_upper"], o["volatility_bb_lower"] = sma(20), sma(20) + 2 * sd, sma(20) - 2 * sd
    o["volatility_bb_width"], o["volatility_bb_pct_b"] = 4 * sd / sma(20), (c - (sma(20) - 2 * sd)) / (4 * sd).replace(0, np.nan)
    tr = pd.concat([h - low, (h - c.shift()).abs(), (low - c.shift()).abs()], axis=1).max(axis=1)
    o["volatility_atr_14"], o["volatility_atr_21"] = rma(tr, 14), rma(tr, 21)
    o["volatility_atr_pct"] = o["volatility_atr_14"] / c
    o["volatility_regime"] = z(o["volatility_atr_pct"], 252)
    o["volume_obv"] = (np.sign(d).fillna(0) * v).cumsum()
    o["volume_obv_norm"] = z(o["volume_obv"], 63)
    tp = (h + low + c) / 3
    vwap = (tp * v).rolling(20, min_periods=10).sum() / v.rolling(20, min_periods=10).sum().replace(0, np.nan)
    o["typical_price"], o["volume_vwap_20"], o["volume_price_vs_vwap"] = tp, vwap, (c - vwap) / vwap
    o["volume_ratio"] = v / v.rolling(20, min_periods=5).mean().replace(0, np.nan)
    o["volume_mfr"] = v.where(d > 0, 0).rolling(14, min_periods=5).sum() / v.where(d < 0, 0).rolling(14, min_periods=5).sum().replace(0, np.nan)
    up, down = h.diff(), -low.diff()
    di = [100 * rma(pd.Series(np.where(x, y, 0.0), index=b.index), 14) / rma(tr, 14).replace(0, np.nan) for x, y in (((up > down) & (up > 0), up), ((down > up) & (down > 0), down))]
    dx = 100 * (di[0] - di[1]).abs() / (di[0] + di[1]).replace(0, np.nan)
    o["regime_plus_di"], o["regime_minus_di"], o["regime_di_diff"], o["regime_adx"] = *di, di[0] - di[1], rma(dx, 14)
    peak = c.rolling(252, min_periods=21).max()
    top, least = h.rolling(252, min_periods=21).max(), low.rolling(252, min_periods=21).min()
    o["regime_drawdown"], o["regime_52w_position"] = (c - peak) / peak, (c - least) / (top - least).replace(0, np.nan)
    return o


def test_features_equal_pandas(spark):
    found = panel.with_features(bars(spark, DATA, DAY)).toPandas().sort_values(["symbol", "date"])
    assert len(panel.FEATURES) == 46
    for _, have in list(found.groupby("symbol"))[:4]:
        want = plain(have)
        assert set(want.columns) == set(panel.FEATURES)
        for name in panel.FEATURES:
            np.testing.assert_allclose(have[name].to_numpy(float), want[name].to_numpy(float), rtol=1e-7, atol=1e-7, err_msg=name)


def test_preprocess_refuses_short_histories(spark):
    rows = bars(spark, DATA, DAY).where("symbol = 'Brand#11'").limit(10)
    with pytest.raises(Exception, match="too few rows"):
        panel.preprocess(rows).collect()


def test_every_rule_of_the_gate_fires(spark):
    rules = {r["rule"] for r in daygate.report(spark, DATA).select("rule").distinct().collect()}
    silent = set(gate.SEVERITY) - rules  # the files have all columns, and at some scales every weekday has one
    assert silent <= {"T1_structural_schema", "T1_structural_non_empty"} and rules <= set(gate.SEVERITY), silent
    assert {r["verdict"] for r in QUERIES["gate_verdict"](spark, DATA).select("verdict").distinct().collect()} >= {"REJECTED", "QUARANTINED", "PASS_WITH_WARNINGS"}


def test_stores_refuse_what_is_missing(spark):
    path = scratch(spark, "raw")
    spark.range(3).write.parquet(path)
    with pytest.raises(ValueError, match="not adjusted"):
        store.panel_scan(spark, f"{path}-none", path)
    assert store.panel_scan(spark, f"{path}-none", f"{path}-neither").count() == 0
    put(spark, f"{path}-actions/a.csv", b"symbol,when\nA,1995-01-01\n")
    with pytest.raises(ValueError, match="columns missing"):
        store.read_actions(spark, f"{path}-actions/a.csv")
