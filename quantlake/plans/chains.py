"""Market queries in steps: each adds columns that the next one uses, in expressions that Spark and DuckDB read alike.

Windows over a symbol's history share one ordering, so a chain of any length costs one shuffle by symbol. Literals are
written as doubles (``2e0``), since a plain decimal would bring decimal arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantlake.functions.windows import block_of
from quantlake.plans.market import GATED, SCORED, accepted, query, scored
from quantlake.sources.bars import DAY, bars, bars_sql



def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars with the place of their day among all market days. The window runs over one row for each day."""
    rows = bars(spark, sf_dir, DAY)
    days = rows.select("date").distinct().withColumn("place", F.row_number().over(Window.orderBy("date")))
    return rows.join(days.withColumn("n_days", F.count("*").over(Window.partitionBy())), "date")


PLACED = f"""{bars_sql(DAY)}, days AS (SELECT date, row_number() OVER (ORDER BY date) AS place, count(*) OVER () AS n_days FROM (SELECT DISTINCT date FROM bars)),
    placed AS (SELECT * FROM bars JOIN days USING (date))"""
BASES = {
    "placed": (placed, PLACED, "placed"),
    "week": (lambda s, d: bars(s, d), bars_sql(), "bars"),
    "day": (lambda s, d: bars(s, d, DAY), bars_sql(DAY), "bars"),
    "accepted": (accepted, GATED, "ok"),
    "scored": (scored, f"WITH {SCORED}", "s"),
}
#: A step adds columns; a Where filters; a Group aggregates to its keys and values.
type Step = dict[str, str] | Where | Group


class Where(str):
    pass


class Group(tuple):
    """(keys, {name: aggregate})"""


def chain(name: str, base: str, *steps: Step, keep: str, values: tuple[str, ...] = (), digits: int = 6) -> None:
    """Register the query that applies ``steps`` to a base and returns ``keep`` and the rounded ``values``."""
    source, sql, last = BASES[base]
    out = [*keep.split(), *(f"round({v}, {digits}) AS {v}" for v in values)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = source(spark, sf_dir)
        for step in steps:
            if isinstance(step, Where):
                rows = rows.where(step)
            elif isinstance(step, Group):
                rows = rows.groupBy(*step[0].split()).agg(*(F.expr(x).alias(k) for k, x in step[1].items()))
            else:
                rows = rows.selectExpr("*", *(f"{x} AS {k}" for k, x in step.items()))
        return rows.selectExpr(*out)

    for i, step in enumerate(steps):
        if isinstance(step, Where):
            body = f"SELECT * FROM {last} WHERE {step}"
        elif isinstance(step, Group):
            keys = step[0].split()
            body = f"SELECT {', '.join([*keys, *(f'{x} AS {k}' for k, x in step[1].items())])} FROM {last}" + (f" GROUP BY {', '.join(keys)}" if keys else "")
        else:
            body = f"SELECT *, {', '.join(f'{x} AS {k}' for k, x in step.items())} FROM {last}"
        sql, last = f"{sql}, step{i} AS ({body})", f"step{i}"
    query(name, f"{sql} SELECT {', '.join(out)} FROM {last}")(run)


BY = "OVER (PARTITION BY symbol ORDER BY date)"
SO_FAR = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
WHOLE = "OVER (PARTITION BY symbol)"


def last_rows(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(f: str, x: str, n: int, least: int) -> str:
    return f"CASE WHEN count({x}) {last_rows(n)} >= {least} THEN {f}({x}) {last_rows(n)} END"


def since_first(x: str) -> str:
    """Position counted from the first row with a value; needs column t."""
    return f"t - min(CASE WHEN {x} IS NOT NULL THEN t END) {SO_FAR}"


def ewm(x: str, t: str, alpha: float, least: int) -> str:
    """Exponential average from the first value on; ``t``, the position from there, is a column. Weights are counted from the
    start of a block of rows, as in functions/windows.py, so they stay within a double however long the history is."""
    size, decay = block_of(alpha), 1 - alpha
    inside, block = f"({t} % {size})", f"floor({t} / {size}e0)"
    part = f"CASE WHEN {t} = 0 THEN 1e0 ELSE {alpha!r}e0 END * pow({decay!r}e0, -{inside}) * {x}"
    own = f"sum({part}) OVER (PARTITION BY symbol, {block} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    before = f"coalesce(sum({part}) OVER (PARTITION BY symbol ORDER BY {block} RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), 0e0)"
    return f"CASE WHEN count({x}) {SO_FAR} >= {least} THEN pow({decay!r}e0, {inside}) * ({own} + pow({decay!r}e0, {size}) * {before}) END"


def wilder(x: str, t: str, n: int) -> str:
    return ewm(x, t, 1 / n, n)


def ema(x: str, t: str, span: int) -> str:
    return ewm(x, t, 2 / (span + 1), span // 2)


def zscore(x: str, n: int) -> str:
    least = max(2, n // 4)
    return f"({x} - ({roll('avg', x, n, least)})) / nullif(round({roll('stddev_samp', x, n, least)}, 12), 0e0)"


KEY = "symbol date"
AT = {"t": f"row_number() {BY} - 1", "prior": f"lag(close) {BY}"}

# Momentum, volatility, volume and regime columns that need more than one pass

GAINS = {"d": "close - prior"}, {"gain": "CASE WHEN d > 0 THEN d WHEN d <= 0 THEN 0e0 END", "loss": "CASE WHEN d < 0 THEN -d WHEN d >= 0 THEN 0e0 END", "u": since_first("d")}
chain(
    "momentum_rsi", "day", AT, *GAINS,
    {f"momentum_rsi_{n}": f"coalesce(100 - 100 / (1 + ({wilder('gain', 'u', n)}) / nullif({wilder('loss', 'u', n)}, 0e0)), 100e0)" for n in (14, 28)},
    keep=KEY, values=("momentum_rsi_14", "momentum_rsi_28"),
)
TRUE_RANGE = {"tr": "greatest(high - low, abs(high - prior), abs(low - prior))"}
ATR = {"volatility_atr_14": wilder("tr", "t", 14), "volatility_atr_21": wilder("tr", "t", 21)}
ATR_PCT = {"volatility_atr_pct": "volatility_atr_14 / close"}
chain("volatility_atr", "day", AT, TRUE_RANGE, ATR, ATR_PCT, keep=KEY, values=("volatility_atr_14", "volatility_atr_21", "volatility_atr_pct"))
chain("volatility_regime", "day", AT, TRUE_RANGE, ATR, ATR_PCT, {"volatility_regime": zscore("volatility_atr_pct", 252)}, keep=KEY, values=("volatility_regime",))
ADX = (
    AT, TRUE_RANGE, {"up": f"high - lag(high) {BY}", "down": f"lag(low) {BY} - low"},
    {"plus_dm": "CASE WHEN up > down AND up > 0 THEN up ELSE 0e0 END", "minus_dm": "CASE WHEN down > up AND down > 0 THEN down ELSE 0e0 END"},
    {"atr": wilder("tr", "t", 14), "plus_rma": wilder("plus_dm", "t", 14), "minus_rma": wilder("minus_dm", "t", 14)},
    {"regime_plus_di": "100 * plus_rma / nullif(atr, 0e0)", "regime_minus_di": "100 * minus_rma / nullif(atr, 0e0)"},
    {"regime_di_diff": "regime_plus_di - regime_minus_di", "dx": "100 * abs(regime_plus_di - regime_minus_di) / nullif(regime_plus_di + regime_minus_di, 0e0)"},
    {"u": since_first("dx")}, {"regime_adx": wilder("dx", "u", 14)},
)
chain("regime_adx", "day", *ADX, keep=KEY, values=("regime_adx", "regime_plus_di", "regime_minus_di", "regime_di_diff"))
chain(
    "trend_macd_signal", "day", AT, {"trend_macd": f"({ema('close', 't', 12)}) - ({ema('close', 't', 26)})"}, {"u": since_first("trend_macd")},
    {"trend_macd_signal": ema("trend_macd", "u", 9), "trend_macd_norm": "trend_macd / close"}, {"trend_macd_hist": "trend_macd - trend_macd_signal"},
    keep=KEY, values=("trend_macd_signal", "trend_macd_hist", "trend_macd_norm"),
)
chain(
    "trend_golden_cross", "day", {"s50": roll("avg", "close", 50, 25), "s200": roll("avg", "close", 200, 100)},
    {"trend_golden_cross": "CASE WHEN s50 > s200 THEN 1 WHEN s50 <= s200 THEN -1 END"}, keep="symbol date trend_golden_cross",
)
chain(
    "momentum_stoch", "day", {"lo": roll("min", "low", 14, 7), "hi": roll("max", "high", 14, 7)}, {"k": "100 * (close - lo) / nullif(hi - lo, 0e0)"},
    {"momentum_stoch_d": roll("avg", "k", 3, 1)}, {"momentum_stoch_diff": "k - momentum_stoch_d"}, keep=KEY, values=("momentum_stoch_d", "momentum_stoch_diff"),
)
chain(
    "momentum_composite", "day", {f"roc{n}": f"(close / lag(close, {n}) {BY} - 1) * 100" for n in (63, 126)}, {f"z{n}": zscore(f"roc{n}", 252) for n in (63, 126)},
    {"momentum_composite": "coalesce((z63 + z126) / 2, z63, z126)"}, keep=KEY, values=("momentum_composite",),
)
chain(
    "volatility_bb_width", "day", {"mid": roll("avg", "close", 20, 10), "sd": roll("stddev_samp", "close", 20, 10)},
    {"volatility_bb_width": "4 * sd / mid", "volatility_bb_pct_b": "(close - (mid - 2 * sd)) / nullif(4 * sd, 0e0)"}, keep=KEY, values=("volatility_bb_width", "volatility_bb_pct_b"),
)
LOG_RETURN = {"lr": f"ln(close / lag(close) {BY})"}
chain("volatility_rv", "day", LOG_RETURN, {f"volatility_rv_{n}": f"({roll('stddev_samp', 'lr', n, n)}) * sqrt(252e0)" for n in (21, 63)}, keep=KEY, values=("volatility_rv_21", "volatility_rv_63"))
chain(
    "regime_trend_consistency", "day", LOG_RETURN, {"up": "CASE WHEN lr > 0 THEN 1e0 WHEN lr <= 0 THEN 0e0 END"},
    {f"regime_trend_consistency_{n}": roll("avg", "up", n, n) for n in (21, 63)}, keep=KEY, values=("regime_trend_consistency_21", "regime_trend_consistency_63"),
)
chain(
    "volume_obv", "day", AT, {"volume_obv": f"sum(CASE WHEN prior IS NULL THEN 0e0 ELSE sign(close - prior) * volume END) {SO_FAR}"}, {"volume_obv_norm": zscore("volume_obv", 63)},
    keep=KEY, values=("volume_obv", "volume_obv_norm"),
)
chain(
    "volume_price_vs_vwap", "day", {"tv": "(high + low + close) / 3 * volume", "v": "CAST(volume AS DOUBLE)"}, {"vwap": f"({roll('sum', 'tv', 20, 10)}) / nullif({roll('sum', 'v', 20, 10)}, 0e0)"},
    {"volume_price_vs_vwap": "(close - vwap) / vwap"}, keep=KEY, values=("volume_price_vs_vwap",),
)
chain(
    "volume_mfr", "day", AT, {"rise": "CASE WHEN close > prior THEN CAST(volume AS DOUBLE) ELSE 0e0 END", "fall": "CASE WHEN close < prior THEN CAST(volume AS DOUBLE) ELSE 0e0 END"},
    {"volume_mfr": f"({roll('sum', 'rise', 14, 5)}) / nullif({roll('sum', 'fall', 14, 5)}, 0e0)"}, keep=KEY, values=("volume_mfr",),
)
chain("core_zscore", "day", {"zscore_20": zscore("close", 20)}, keep=KEY, values=("zscore_20",))
chain(
    "win_roll_minmax", "day", {"lo": roll("min", "close", 20, 1), "hi": roll("max", "close", 20, 1)}, {"minmax_20": "(close - lo) / nullif(hi - lo, 0e0)"}, keep=KEY, values=("minmax_20",)
)
OUTLIERS = AT, LOG_RETURN, {"z": f"(lr - avg(lr) {WHOLE}) / nullif(stddev_samp(lr) {WHOLE}, 0e0)"}
chain("win_outliers", "day", *OUTLIERS, {"outlier": "coalesce(abs(z) > 5, false)"}, keep="symbol date outlier", values=("z",))
chain("win_realised_vol", "day", LOG_RETURN, {"sigma": roll("stddev_samp", "lr", 63, 63)}, keep=KEY, values=("sigma",))
SECTOR = "OVER (PARTITION BY date, substr(symbol, 1, 7))"
chain(
    "win_sector_neutral", "day", {"r": "close / prev_close - 1"}, {"m": f"avg(r) {SECTOR}", "sd": f"stddev_samp(r) {SECTOR}"},
    {"return_sect": "CASE WHEN sd > 0 THEN (r - m) / sd END"}, keep=KEY, values=("return_sect",),
)
chain("fn_typical_range", "day", {"price_range": "(high - low) / close"}, keep=KEY, values=("price_range",))

# Labels, folds, returns of positions

chain(
    "agg_label_distribution", "day", {"y": f"CASE WHEN lead(close, 4) {BY} > close THEN 1 WHEN lead(close, 4) {BY} <= close THEN 0 END"}, Where("y IS NOT NULL"),
    Group(("y", {"n": "count(*)"})), {"share": "n / CAST(sum(n) OVER (PARTITION BY 1) AS DOUBLE)"}, keep="y n", values=("share",),
)
RETURN = Where("prev_close IS NOT NULL"), {"r": "close / prev_close - 1"}
chain("met_sortino", "day", *RETURN, Group(("symbol", {"m": "avg(r)", "losses": "count_if(r < 0)", "sd": "stddev_pop(CASE WHEN r < 0 THEN r END)"})),
      {"sortino": "CASE WHEN losses < 2 OR sd < 1e-15 THEN 0e0 ELSE m / sd * sqrt(252e0) END"}, keep="symbol", values=("sortino",))
chain("met_max_drawdown", "day", *RETURN, {"total": f"exp(sum(ln(1 + r)) {SO_FAR})"}, {"peak": f"max(total) {SO_FAR}"},
      Group(("symbol", {"max_drawdown": "min((total - peak) / peak)"})), keep="symbol", values=("max_drawdown",))
chain("met_cagr", "day", *RETURN, Group(("symbol", {"total": "exp(sum(ln(1 + r)))", "n": "count(*)"})), {"cagr": "pow(total, 252e0 / n) - 1"}, keep="symbol", values=("cagr",))
POSITION = {"position": f"CASE WHEN close > lag(close, 4) {BY} THEN 1 WHEN close < lag(close, 4) {BY} THEN -1 ELSE 0 END"}
CHANGE = {"change": f"abs(position - coalesce(lag(position) {BY}, position))"}
chain("met_turnover", "day", POSITION, CHANGE, Group(("symbol", {"turnover": "avg(CAST(change AS DOUBLE))"})), keep="symbol", values=("turnover",))
# Scores: signals, sizes, calibration

SIGNAL = {"sig": "CASE WHEN p >= 0.55e0 THEN 'BUY' WHEN p <= 0.45e0 THEN 'SELL' ELSE 'HOLD' END"}
chain("sig_serve", "scored", SIGNAL, {"confidence": "greatest(p, 1 - p)"}, keep="doc_id sig", values=("confidence",), digits=4)
chain("siz_serve", "scored", SIGNAL, {"size_pct": "CASE WHEN sig = 'HOLD' THEN 0e0 ELSE least(10e0, 2 * abs(p - 0.5e0) * greatest(p, 1 - p) * 10) END"}, keep="doc_id", values=("size_pct",), digits=2)
chain("cal_bss", "scored", Group(("", {"brier": "avg((p - y) * (p - y))", "ref": "var_pop(y)"})), {"bss": "1 - brier / nullif(ref, 0e0)"}, keep="", values=("brier", "bss"))
EDGES = " + ".join(f"CASE WHEN p > {k}e-1 THEN 1 ELSE 0 END" for k in range(1, 10))
chain(
    "cal_ece", "scored", {"bin": EDGES}, Group(("bin", {"gap": "abs(avg(p) - avg(y))", "n": "count(*)"})), Group(("", {"ece": "sum(n * gap) / sum(n)"})), keep="", values=("ece",)
)
REGIME = {"m200": roll("avg", "close", 200, 100)}, {"regime": "CASE WHEN regime_adx < 20 THEN 'ranging' WHEN regime_adx IS NULL OR m200 IS NULL THEN NULL WHEN close > m200 THEN 'bull' ELSE 'bear' END"}
NEWEST = {"newest": "row_number() OVER (PARTITION BY symbol ORDER BY date DESC)"}, Where("newest = 1")
chain("reg_classify", "day", *ADX, *REGIME, *NEWEST, keep="symbol date regime")
chain("agg_market_regime", "day", *ADX, *REGIME, *NEWEST, Group(("regime", {"n": "count(*)"})), keep="regime n")
