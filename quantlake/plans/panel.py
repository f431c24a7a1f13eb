"""The feature panel: all indicators of a symbol in one frame, ranks across the market, and the steps that prepare bars.

All columns of a symbol come from windows in one order (one exchange by symbol); the ranks take one exchange by date.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantlake.functions import windows as fw
from quantlake.plans.chains import BY, SO_FAR, ema, roll, since_first, wilder, zscore
from quantlake.plans.market import C, query
from quantlake.sources.bars import DAY, bars, bars_sql, by_symbol

# Lengths, thresholds and the columns that are no features.
LEAST_ROWS, LEAST_SYMBOLS, OUTLIER = 252, 20, 5
IDENTITY = ("symbol", "date", "series", "isin", "sector")
RAW = ("open", "high", "low", "close", "prev_close", "volume", "turnover", "trades", "delivery_qty", "adj_close", "adj_factor")
ROC = {"1m": 21, "3m": 63, "6m": 126, "12m": 252}

#: Steps of expressions that Spark and DuckDB read alike; each may use the columns of those before.
STEPS: tuple[dict[str, str], ...] = (
    {
        "t": f"row_number() {BY} - 1", "prior": f"lag(close) {BY}", "typical_price": "(high + low + close) / 3", "v": "CAST(volume AS DOUBLE)",
        "delivery_pct": "delivery_qty * 100e0 / nullif(volume, 0)", "prior_high": f"lag(high) {BY}", "prior_low": f"lag(low) {BY}",
        **{f"momentum_roc_{k}": f"(close / lag(close, {n}) {BY} - 1) * 100" for k, n in ROC.items()},
    },
    {
        "d": "close - prior", "tr": "greatest(high - low, abs(high - prior), abs(low - prior))", "up": "high - prior_high", "down": "prior_low - low", "flow": "typical_price * v",
        **{f"trend_sma_{n}": roll("avg", "close", n, n // 2) for n in (20, 50, 200)}, **{f"trend_ema_{n}": ema("close", "t", n) for n in (12, 26, 50)},
        "low14": roll("min", "low", 14, 7), "high14": roll("max", "high", 14, 7), "sd20": roll("stddev_samp", "close", 20, 10),
        "top_close": roll("max", "close", 252, 21), "top_high": roll("max", "high", 252, 21), "least_low": roll("min", "low", 252, 21),
        "zroc_3m": zscore("momentum_roc_3m", 252), "zroc_6m": zscore("momentum_roc_6m", 252), "mean_v": roll("avg", "v", 20, 5), "sum_v": roll("sum", "v", 20, 10),
    },
    {
        "gain": "CASE WHEN d > 0 THEN d WHEN d <= 0 THEN 0e0 END", "loss": "CASE WHEN d < 0 THEN -d WHEN d >= 0 THEN 0e0 END", "t_d": since_first("d"),
        "plus_dm": "CASE WHEN up > down AND up > 0 THEN up ELSE 0e0 END", "minus_dm": "CASE WHEN down > up AND down > 0 THEN down ELSE 0e0 END",
        "volatility_atr_14": wilder("tr", "t", 14), "volatility_atr_21": wilder("tr", "t", 21), "trend_macd": "trend_ema_12 - trend_ema_26",
        **{f"trend_price_vs_sma{n}": f"(close - trend_sma_{n}) / trend_sma_{n}" for n in (20, 50, 200)},
        "trend_golden_cross": "CASE WHEN trend_sma_50 > trend_sma_200 THEN 1e0 WHEN trend_sma_50 <= trend_sma_200 THEN -1e0 END",
        "momentum_stoch_k": "100 * (close - low14) / nullif(high14 - low14, 0e0)", "momentum_composite": "coalesce((zroc_3m + zroc_6m) / 2, zroc_3m, zroc_6m)",
        "volatility_bb_mid": "trend_sma_20", "volatility_bb_upper": "trend_sma_20 + 2 * sd20", "volatility_bb_lower": "trend_sma_20 - 2 * sd20", "volatility_bb_width": "4 * sd20 / trend_sma_20",
        "volatility_bb_pct_b": "(close - (trend_sma_20 - 2 * sd20)) / nullif(4 * sd20, 0e0)",
        "volume_obv": f"sum(CASE WHEN prior IS NULL THEN 0e0 ELSE sign(d) * v END) {SO_FAR}", "volume_vwap_20": f"({roll('sum', 'flow', 20, 10)}) / nullif(sum_v, 0e0)",
        "volume_ratio": "v / nullif(mean_v, 0e0)", "rise": "CASE WHEN d > 0 THEN v ELSE 0e0 END", "fall": "CASE WHEN d < 0 THEN v ELSE 0e0 END",
        "regime_drawdown": "(close - top_close) / top_close", "regime_52w_position": "(close - least_low) / nullif(top_high - least_low, 0e0)",
    },
    {
        **{f"momentum_rsi_{n}": f"coalesce(100 - 100 / (1 + ({wilder('gain', 't_d', n)}) / nullif({wilder('loss', 't_d', n)}, 0e0)), 100e0)" for n in (14, 28)},
        "momentum_stoch_d": roll("avg", "momentum_stoch_k", 3, 1), "volatility_atr_pct": "volatility_atr_14 / close", "trend_macd_norm": "trend_macd / close",
        "volume_price_vs_vwap": "(close - volume_vwap_20) / volume_vwap_20", "volume_obv_norm": zscore("volume_obv", 63),
        "volume_mfr": f"({roll('sum', 'rise', 14, 5)}) / nullif({roll('sum', 'fall', 14, 5)}, 0e0)",
        "regime_plus_di": f"100 * ({wilder('plus_dm', 't', 14)}) / nullif(volatility_atr_14, 0e0)", "regime_minus_di": f"100 * ({wilder('minus_dm', 't', 14)}) / nullif(volatility_atr_14, 0e0)",
        "t_macd": since_first("trend_macd"),
    },
    {
        "momentum_stoch_diff": "momentum_stoch_k - momentum_stoch_d", "volatility_regime": zscore("volatility_atr_pct", 252), "trend_macd_signal": ema("trend_macd", "t_macd", 9),
        "regime_di_diff": "regime_plus_di - regime_minus_di", "dx": "100 * abs(regime_plus_di - regime_minus_di) / nullif(regime_plus_di + regime_minus_di, 0e0)",
    },
    {"trend_macd_hist": "trend_macd - trend_macd_signal", "t_dx": since_first("dx")},
    {"regime_adx": wilder("dx", "t_dx", 14)},
)
GROUPS = ("trend", "momentum", "volatility", "volume", "regime")
FEATURES = sorted(name for step in STEPS for name in step if name.split("_")[0] in GROUPS and "_" in name) + ["typical_price"]
FEATURES_SQL = bars_sql(DAY) + "".join(
    f", f{i} AS (SELECT *, {', '.join(f'{x} AS {k}' for k, x in step.items())} FROM {f'f{i - 1}' if i else 'bars'})" for i, step in enumerate(STEPS)
)
LAST = f"f{len(STEPS) - 1}"


def with_features(rows: DataFrame) -> DataFrame:
    """``rows`` (bars) with the 46 indicator columns FEATURES, delivery_pct, and the place t of a row in its symbol's history."""
    names = rows.columns
    for step in STEPS:
        rows = rows.selectExpr("*", *(f"{x} AS {k}" for k, x in step.items()))
    return rows.select(*names, "t", "delivery_pct", *FEATURES)


def feature_columns(rows: DataFrame) -> list[str]:
    """Numeric columns that are neither an identity nor raw."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [c for c, kind in rows.dtypes if (kind in numeric or kind.startswith("decimal")) and c not in (*IDENTITY, *RAW, "t", "n")]


def panel(rows: DataFrame, least_rows: int = LEAST_ROWS, least_symbols: int = LEAST_SYMBOLS) -> DataFrame:
    """Features and their ranks (_xs: the average rank within the day as a share of the values) of every bar that has a year of history;
    symbols with less are left out, and days with fewer than ``least_symbols`` have no ranks. All features of a day, whose size the
    universe bounds, are ranked together: one exchange, where a window for each would sort the wide rows as often as there are."""
    rows = with_features(rows).where(C("t") >= least_rows - 1).select("symbol", "date", *(C(x).cast("double").alias(x) for x in FEATURES))

    def ranks(day: pd.DataFrame) -> pd.DataFrame:
        values = day[FEATURES].astype(float)
        found = values.rank() / values.count() if len(day) >= least_symbols else values * float("nan")
        return pd.concat([day, found.add_suffix("_xs")], axis=1)

    schema = "symbol string, date date, " + ", ".join(f"{x} double" for x in [*FEATURES, *(f"{x}_xs" for x in FEATURES)])
    return rows.groupBy("date").applyInPandas(ranks, schema)


def skipped(rows: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Symbols that the panel leaves out, with the reason."""
    counts = rows.groupBy("symbol").agg(F.count("*").alias("n")).where(C("n") < least_rows)
    return counts.select("symbol", F.format_string("%d rows, below %d", "n", F.lit(least_rows)).alias("reason"))


#: Prices have two digits, so that their means often lie on a half; a shift before rounding keeps engines of other orders alike.
SHIFT = 1.23e-5


def rounded(name: str, n: int = 4):
    return F.round(C(name) + SHIFT, n).alias(name)


def digits(names: list[str], n: int = 4) -> str:
    return ", ".join(f"round({x} + {SHIFT!r}, {n}) AS {x}" for x in names)


for _group in GROUPS:
    _names = [x for x in FEATURES if x.startswith(_group)] + (["typical_price"] if _group == "volume" else [])
    query(f"add_{_group}_features", f"{FEATURES_SQL} SELECT symbol, date, {digits(_names)} FROM {LAST}")(
        lambda s, d, names=_names: with_features(bars(s, d, DAY)).select("symbol", "date", *(rounded(x) for x in names))
    )
query("add_all_features", f"{FEATURES_SQL} SELECT symbol, date, {digits(["delivery_pct", *FEATURES])} FROM {LAST}")(
    lambda s, d: with_features(bars(s, d, DAY)).select("symbol", "date", *(rounded(x) for x in ("delivery_pct", *FEATURES)))
)
RANKS_SQL = ", ".join(
    f"round(CASE WHEN m >= {LEAST_SYMBOLS} AND {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY date) END, 4) AS {x}_xs"
    for x in FEATURES
)
query(
    "win_panel_build",
    f"{FEATURES_SQL}, y AS (SELECT *, count(symbol) OVER (PARTITION BY date) AS m FROM {LAST} WHERE t >= {LEAST_ROWS - 1}) SELECT symbol, date, {digits(FEATURES)}, {RANKS_SQL} FROM y",
)(lambda s, d: panel(bars(s, d, DAY)).select("symbol", "date", *(rounded(x) for x in FEATURES), *(F.round(f"{x}_xs", 4).alias(f"{x}_xs") for x in FEATURES)))
query("win_panel_features", f"{bars_sql(DAY)} SELECT symbol, format('{{}} rows, below {{}}', count(*), 1500) AS reason FROM bars GROUP BY symbol HAVING count(*) < 1500")(
    lambda s, d: skipped(bars(s, d, DAY), 1500)
)

# Preparing bars: types, gaps, outliers, returns, normal columns. A later step sees what an earlier one left.

PRICES = ("open", "high", "low", "close")


def filled(rows: DataFrame, ahead: bool = True) -> DataFrame:
    """Null prices take the last value before, then (``ahead``) the first after; a null volume is 0."""
    past, future = by_symbol().rowsBetween(Window.unboundedPreceding, 0), by_symbol().rowsBetween(0, Window.unboundedFollowing)
    last = {c: F.last(c, ignorenulls=True).over(past) for c in PRICES}
    if ahead:
        last = {c: F.coalesce(x, F.first(c, ignorenulls=True).over(future)) for c, x in last.items()}
    return rows.withColumns(last | {"volume": F.coalesce("volume", F.lit(0))})


def without_outliers(rows: DataFrame, z: float = OUTLIER) -> DataFrame:
    """Bars whose log return lies more than ``z`` deviations from the symbol's mean lose their values, which are then filled
    forward; ``outlier`` marks them."""
    whole, past = Window.partitionBy("symbol"), by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_r", F.ln(C("close") / F.lag("close").over(by_symbol())))
    far = F.abs(C("_r") - F.avg("_r").over(whole)) / F.nullif(F.stddev_samp("_r").over(whole), F.lit(0.0)) > z
    rows = rows.withColumn("outlier", F.coalesce(far, F.lit(False)))
    names = (*PRICES, "volume")
    rows = rows.withColumns({c: F.when(~C("outlier"), C(c)) for c in names})
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(past) for c in names}).drop("_r")


def normalised(rows: DataFrame, columns: tuple[str, ...], how: str = "zscore") -> DataFrame:
    """A column name_norm for each of ``columns``, over the whole history of the symbol."""
    whole = Window.partitionBy("symbol")
    scaled = {
        "zscore": lambda c: (C(c) - F.avg(c).over(whole)) / F.nullif(F.stddev_samp(c).over(whole), F.lit(0.0)),
        "minmax": lambda c: (C(c) - F.min(c).over(whole)) / F.nullif((F.max(c).over(whole) - F.min(c).over(whole)).cast("double"), F.lit(0.0)),
    }[how]
    return rows.withColumns({f"{c}_norm": scaled(c) for c in columns})


def preprocess(rows: DataFrame, least_rows: int = 30) -> DataFrame:
    """The whole chain: numbers, gaps, outliers, returns, derived and normal columns. Symbols with fewer rows are an error."""
    rows = rows.withColumns({c: C(c).try_cast("double") for c in (*PRICES, "volume")})
    rows = without_outliers(filled(rows)).withColumn("_n", F.count("*").over(Window.partitionBy("symbol")))
    rows = rows.withColumn("symbol", F.when(C("_n") >= least_rows, C("symbol")).otherwise(F.raise_error(F.lit("too few rows of a symbol")).cast("string"))).drop("_n")
    lag = F.lag("close").over(by_symbol())
    rows = rows.withColumns({"simple_return": C("close") / lag - 1, "log_return": F.ln(C("close") / lag), "typical_price": (C("high") + C("low") + C("close")) / 3, "price_range": (C("high") - C("low")) / C("close")})
    return normalised(rows, ("close", "volume"))


#: Bars with gaps: every 89th close and every 83rd volume is missing, every 97th close is ten times what it was.
GAPS = "CASE WHEN t % 89 = 3 THEN NULL WHEN t % 97 = 11 THEN close * 10 ELSE close END AS close, CASE WHEN t % 83 = 5 THEN NULL ELSE volume END AS volume"
GAPS_SQL = f"{bars_sql(DAY)}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS t FROM bars), gaps AS (SELECT symbol, date, open, high, low, {GAPS} FROM n)"
PAST, FUTURE = "OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)", "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
FILLED_SQL = f"{GAPS_SQL}, filled AS (SELECT symbol, date, open, high, low, coalesce(last_value(close IGNORE NULLS) {PAST}, first_value(close IGNORE NULLS) {FUTURE}) AS close, coalesce(volume, 0) AS volume FROM gaps)"
CLEAN_SQL = f"""{FILLED_SQL}, r AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY date)) AS r FROM filled), z AS (SELECT *, coalesce(abs(r - avg(r) OVER (PARTITION BY symbol)) / nullif(stddev_samp(r) OVER (PARTITION BY symbol), 0) > {OUTLIER}, false) AS outlier FROM r),
    clean AS (SELECT symbol, date, outlier, {", ".join(f"last_value(CASE WHEN NOT outlier THEN {c} END IGNORE NULLS) {PAST} AS {c}" for c in (*PRICES, "volume"))} FROM z)"""


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir, DAY).withColumn("t", F.row_number().over(by_symbol())).selectExpr("symbol", "date", "open", "high", "low", *GAPS.split(", "))


query("win_fill", f"{FILLED_SQL} SELECT symbol, date, close, volume FROM filled")(lambda s, d: filled(gaps(s, d)).select("symbol", "date", "close", "volume"))
query("win_outliers_filled", f"{CLEAN_SQL} SELECT symbol, date, outlier, open, close, CAST(volume AS DOUBLE) AS volume FROM clean")(
    lambda s, d: without_outliers(filled(gaps(s, d))).select("symbol", "date", "outlier", "open", "close", C("volume").cast("double").alias("volume"))
)
query(
    "win_normalise",
    f"{bars_sql(DAY)} SELECT symbol, date, round((close - avg(close) OVER p) / nullif(stddev_samp(close) OVER p, 0), 6) AS close_norm, round((volume - min(volume) OVER p) / nullif(max(volume) OVER p - min(volume) OVER p, 0), 6) AS volume_norm FROM bars WINDOW p AS (PARTITION BY symbol)",
)(lambda s, d: normalised(normalised(bars(s, d, DAY), ("close",)), ("volume",), "minmax").select("symbol", "date", F.round("close_norm", 6).alias("close_norm"), F.round("volume_norm", 6).alias("volume_norm")))
query(
    "win_preprocess",
    f"""{CLEAN_SQL}, x AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS p FROM clean)
    SELECT symbol, date, outlier, round(close / p - 1, 6) AS simple_return, round(ln(close / p), 6) AS log_return, round((high + low + close) / 3, 6) AS typical_price, round((high - low) / close, 6) AS price_range,
      round((close - avg(close) OVER s) / nullif(stddev_samp(close) OVER s, 0), 6) AS close_norm, round((volume - avg(volume) OVER s) / nullif(stddev_samp(volume) OVER s, 0), 6) AS volume_norm FROM x WINDOW s AS (PARTITION BY symbol)""",
)(lambda s, d: preprocess(gaps(s, d)).select("symbol", "date", "outlier", *(F.round(x, 6).alias(x) for x in ("simple_return", "log_return", "typical_price", "price_range", "close_norm", "volume_norm"))))

# Labels on the next bars, and the rows that a model can be fitted on

HORIZON, RISE = 21, 0.02


def labelled(rows: DataFrame, horizon: int = HORIZON, rise: float = RISE) -> DataFrame:
    """label: 1 if the close is more than ``rise`` higher ``horizon`` bars on, else 0; null for the last bars."""
    forward = F.lead("close", horizon).over(by_symbol()) / C("close") - 1
    return rows.withColumn("label", F.when(forward > rise, 1).when(forward <= rise, 0))


LABEL_SQL = f"CASE WHEN lead(close, {HORIZON}) OVER (PARTITION BY symbol ORDER BY date) / close - 1 > {RISE} THEN 1 WHEN lead(close, {HORIZON}) OVER (PARTITION BY symbol ORDER BY date) / close - 1 <= {RISE} THEN 0 END"
MODEL = ["momentum_roc_1m", "trend_price_vs_sma50", "volatility_bb_width", "volume_ratio", "regime_drawdown"]
query("win_make_labels", f"{bars_sql(DAY)} SELECT symbol, date, {LABEL_SQL} AS label FROM bars")(lambda s, d: labelled(bars(s, d, DAY)).select("symbol", "date", "label"))


def dataset(rows: DataFrame) -> DataFrame:
    """symbol, date, MODEL features and label of the rows where none is missing."""
    return labelled(with_features(rows)).select("symbol", "date", *MODEL, "label").dropna()


DATASET_SQL = f"{FEATURES_SQL}, l AS (SELECT *, {LABEL_SQL} AS label FROM {LAST}), dataset AS (SELECT symbol, date, {', '.join(MODEL)}, label FROM l WHERE {' AND '.join(f'{x} IS NOT NULL' for x in [*MODEL, 'label'])})"
query("win_prepare_dataset", f"{DATASET_SQL} SELECT symbol, date, {digits(MODEL, 6)}, label FROM dataset")(
    lambda s, d: dataset(bars(s, d, DAY)).select("symbol", "date", *(rounded(x, 6) for x in MODEL), "label")
)
query("join_align_dropna", f"{DATASET_SQL} SELECT symbol, count(*) AS n, min(date) AS first_day, max(date) AS last_day FROM dataset GROUP BY symbol")(
    lambda s, d: dataset(bars(s, d, DAY)).groupBy("symbol").agg(F.count("*").alias("n"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))
)
query("set_concat_symbols", f"{FEATURES_SQL} SELECT symbol, count(*) AS n, count(trend_sma_200) AS with_sma_200 FROM {LAST} GROUP BY symbol")(
    lambda s, d: with_features(bars(s, d, DAY)).groupBy("symbol").agg(F.count("*").alias("n"), F.count("trend_sma_200").alias("with_sma_200"))
)
