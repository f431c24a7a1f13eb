"""Every market query with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from quantlake.functions import windows as fw
from quantlake.sources.bars import DAY, bars, bars_sql, by_symbol, dirty_bars, dirty_sql, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def C(name: str) -> Column:  # noqa: N802
    return F.col(name)


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


def over_bars(name: str, sqls: dict[str, str], columns: Callable[[], dict[str, Column]], period: str = DAY) -> None:
    """A query of indicator columns over bars, rounded to 8 places. ``columns`` is called when a session is there."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return bars(spark, sf_dir, period).select("symbol", "date", *(F.round(c, 8).alias(k) for k, c in columns().items()))

    sql = f"{bars_sql(period)}, t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS t FROM bars) SELECT symbol, date, "
    query(name, sql + ", ".join(f"round({x}, 8) AS {k}" for k, x in sqls.items()) + " FROM t")(run)


# Scans and spans

COLUMNS = ["symbol", "date", "open", "high", "low", "close", "volume", "turnover", "trades", "delivery_qty", "prev_close"]
query("bars_week", f"{bars_sql()} SELECT {', '.join(COLUMNS)} FROM bars")(lambda s, d: bars(s, d).select(*COLUMNS))
query("bars_day", f"{bars_sql(DAY)} SELECT {', '.join(COLUMNS)} FROM bars")(lambda s, d: bars(s, d, DAY).select(*COLUMNS))
query("src_trading_days", f"{bars_sql(DAY)} SELECT DISTINCT date FROM bars")(lambda s, d: bars(s, d, DAY).select("date").distinct())
query("src_row_count", f"{bars_sql()} SELECT count(*) AS n FROM bars")(lambda s, d: bars(s, d).agg(F.count("*").alias("n")))
query(
    "src_prices_scan",
    f"{bars_sql()} SELECT symbol, date, close FROM bars WHERE symbol IN ('Brand#11', 'Brand#23') AND date BETWEEN DATE '1994-01-01' AND DATE '1995-12-31'",
)(lambda s, d: bars(s, d).where(C("symbol").isin("Brand#11", "Brand#23") & C("date").between("1994-01-01", "1995-12-31")).select("symbol", "date", "close"))
query(
    "agg_symbol_span",
    f"{bars_sql(DAY)} SELECT symbol, min(date) AS first_seen, max(date) AS last_seen, count(*) AS n_days FROM bars GROUP BY symbol",
)(lambda s, d: bars(s, d, DAY).groupBy("symbol").agg(F.min("date").alias("first_seen"), F.max("date").alias("last_seen"), F.count("*").alias("n_days")))
query("agg_rows_per_day", f"{bars_sql(DAY)} SELECT date, count(*) AS n FROM bars GROUP BY date")(lambda s, d: bars(s, d, DAY).groupBy("date").agg(F.count("*").alias("n")))
query("agg_panel_coverage", f"{bars_sql()} SELECT date, count(DISTINCT symbol) AS symbols FROM bars GROUP BY date")(lambda s, d: bars(s, d).groupBy("date").agg(F.countDistinct("symbol").alias("symbols")))

# The quality gate: row rules in their order; the first that a row breaks owns it.

ROW_RULES = {
    "T2_validity_high_low": "high < low",
    "T2_validity_high_bounds": "high < greatest(open, close)",
    "T2_validity_low_bounds": "low > least(open, close)",
    "T2_validity_positive_prices": "least(open, high, low, close) <= 0 OR open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL",
    "T2_validity_non_negative_volume": "volume < 0 OR turnover < 0",
    "T2_validity_delivery_bounds": "delivery_qty > volume",
}
BATCH_RULES = {
    "T2_validity_turnover_reconciles": "volume > 0 AND turnover > 0 AND (turnover / nullif(volume, 0) < low * 0.95 OR turnover / nullif(volume, 0) > high * 1.05)",
    "T5_plausibility_zero_volume_move": "volume = 0 AND prev_close IS NOT NULL AND (close <> prev_close OR close IS NULL)",
}
for _name, _rule in (ROW_RULES | BATCH_RULES).items():
    query(_name, f"{dirty_sql()} SELECT symbol, date FROM dirty WHERE {_rule}")(lambda s, d, rule=_rule: dirty_bars(s, d).where(rule).select("symbol", "date"))
OWNER = "CASE " + " ".join(f"WHEN {rule} THEN '{name}'" for name, rule in ROW_RULES.items()) + " END"


def history(days: int = 120) -> WindowSpec:
    """The calendar days before a bar's own."""
    return Window.partitionBy("symbol").orderBy(F.unix_date("date")).rangeBetween(-days, -1)


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirty_bars(spark, sf_dir).withColumn("held_by", F.expr(OWNER))


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated(spark, sf_dir).where("held_by IS NULL")


GATED = f"{dirty_sql()}, gated AS (SELECT *, {OWNER} AS held_by FROM dirty), ok AS (SELECT * FROM gated WHERE held_by IS NULL)"
query("gate_run", f"{GATED} SELECT symbol, date, held_by FROM gated")(lambda s, d: gated(s, d).select("symbol", "date", "held_by"))
query("gate_held_by_rule", f"{GATED} SELECT held_by, count(*) AS n FROM gated WHERE held_by IS NOT NULL GROUP BY held_by")(
    lambda s, d: gated(s, d).where("held_by IS NOT NULL").groupBy("held_by").agg(F.count("*").alias("n"))
)
query(
    "T5_plausibility_volume_spike",
    f"{GATED}, m AS (SELECT *, median(volume) OVER (PARTITION BY symbol ORDER BY date RANGE BETWEEN INTERVAL 120 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS m FROM ok) SELECT symbol, date FROM m WHERE m > 0 AND volume / m > 50",
)(
    lambda s, d: accepted(s, d)
    .withColumn("m", F.percentile("volume", F.lit(0.5)).over(history()))
    .where("m > 0 AND volume / m > 50")
    .select("symbol", "date")
)
query(
    "T3_completeness_row_count",
    f"""{bars_sql(DAY)}, n AS (SELECT date, count(*) AS n FROM bars GROUP BY date), m AS (SELECT *, median(n) OVER (ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS m FROM n)
    SELECT date, n FROM m WHERE m > 0 AND abs(n - m) / m > 0.25""",
)(
    # One row for each trading day: a window over days, not over rows.
    lambda s, d: bars(s, d, DAY).groupBy("date").agg(F.count("*").alias("n"))
    .withColumn("m", F.percentile("n", F.lit(0.5)).over(Window.orderBy("date").rowsBetween(-20, -1)))
    .where("m > 0 AND abs(n - m) / m > 0.25").select("date", "n")
)
query(
    "T3_completeness_trading_day",
    f"{bars_sql(DAY)} SELECT DISTINCT date FROM bars WHERE isodow(date) >= 6 OR (month(date), day(date)) IN ((1, 26), (5, 1), (8, 15), (10, 2), (12, 25))",
)(
    lambda s, d: bars(s, d, DAY).select("date").distinct()
    .where((F.weekday("date") >= 5) | F.date_format("date", "MM-dd").isin("01-26", "05-01", "08-15", "10-02", "12-25"))
)
query(
    "T6_cross_source_close_agreement",
    f"{bars_sql()}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS t FROM bars), o AS (SELECT symbol, date, CASE WHEN t % 139 = 25 THEN close * 1.02 ELSE close END AS other FROM n) SELECT symbol, date FROM bars JOIN o USING (symbol, date) WHERE abs(close - other) / other * 100 > 1",
)(
    lambda s, d: (lambda b: b.join(b.select("symbol", "date", F.expr("CASE WHEN t % 139 = 25 THEN close * 1.02 ELSE close END").alias("other")), ["symbol", "date"]))(
        bars(s, d).withColumn("t", F.row_number().over(by_symbol()))
    ).where("abs(close - other) / other * 100 > 1").select("symbol", "date")
)

# Corporate actions and adjustment: (symbol, ex_date, purpose).

ACTIONS = (
    ("Brand#11", "1994-06-06", "FACE VALUE SPLIT FROM RS 10/- TO RS 2/-"),
    ("Brand#11", "1996-03-04", "BONUS 1:1"),
    ("Brand#11", "1996-03-04", "SPLIT FROM RS 2 TO RE 1"),
    ("Brand#12", "1995-05-01", "SUB-DIVISION FROM RS 10 TO RE 1"),
    ("Brand#12", "1996-05-06", "Split from Rs. 5 to Rs. 4"),
    ("Brand#13", "1995-05-01", "SPLIT FROM RS 2 TO RS 10"),
    ("Brand#21", "1996-02-05", "SCHEME OF ARRANGEMENT"),
    ("Brand#22", "1996-02-05", "DEMERGER OF A UNIT"),
    ("Brand#23", "1995-01-02", "BONUS ISSUE 3:5"),
    ("Brand#24", "1996-02-05", "DELISTED"),
    ("Brand#25", "1996-02-05", "CHANGE IN NAME TO BRAND#27"),
    ("Brand#34", "1995-07-03", "RIGHTS 1:4 @ PREMIUM RS 90/-"),
    ("Brand#45", "1996-01-01", "ANNUAL GENERAL MEETING / DIVIDEND RS 5.50 PER SHARE"),
    ("Brand#52", "1996-01-01", "SOMETHING UNEXPECTED"),
)
# Patterns of a purpose, without regard to case, in their order: fixed values.
FACES = {
    "split": r"SPLIT.*?FROM\s*(?:RS\.?\s*)?([\d.]+).*?TO\s*(?:RS\.?\s*)?([\d.]+)",
    "sub_division": r"SUB[\s-]*DIVISION.*?FROM\s*(?:RS\.?|RE\.?\s*)?\s*([\d.]+).*?TO\s*(?:RS\.?|RE\.?\s*)?\s*([\d.]+)",
}
SHARES = {"bonus": r"BONUS.*?(\d+)\s*:\s*(\d+)", "rights": r"RIGHTS.*?(\d+)\s*:\s*(\d+)"}
KINDS = {
    "demerger": r"\b(?:DEMERGER|SPIN[\s-]?OFF)\b",
    "merger": r"\b(?:AMALGAMATION|MERGER|SCHEME OF ARRANGEMENT)\b",
    "delisting": r"\b(?:DELISTING|DELISTED)\b",
    "symbol_change": r"\b(?:CHANGE IN NAME|NAME CHANGE|SYMBOL CHANGE)\b",
    "dividend": r"\bDIVIDEND\b",
}
PRICE_KINDS = ("split", "bonus", "rights")


def extracts(name: str, pattern: str) -> str:
    return ", ".join(f"TRY_CAST(regexp_extract(purpose, '{pattern}', {k}, 'is') AS DOUBLE) AS {name}{k}" for k in (1, 2))


ACTIONS_SQL = "actions AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', DATE '{b}', '{c}')" for a, b, c in ACTIONS) + ") AS v(symbol, ex_date, purpose))"
PARSED_SQL = f"""{ACTIONS_SQL}, x AS (SELECT *, {", ".join(extracts(k, p) for k, p in (FACES | SHARES).items())} FROM actions),
  y AS (SELECT *, CASE WHEN split2 > 0 AND split2 < split1 THEN split2 / split1 WHEN sub_division2 > 0 AND sub_division2 < sub_division1 THEN sub_division2 / sub_division1 END AS faces,
    CASE WHEN bonus1 > 0 AND bonus2 > 0 THEN bonus2 / (bonus1 + bonus2) END AS bonus, CASE WHEN rights1 > 0 AND rights2 > 0 THEN rights2 / (rights1 + rights2) END AS rights FROM x),
  parsed AS (SELECT symbol, ex_date, CASE WHEN faces IS NOT NULL THEN 'split' WHEN bonus IS NOT NULL THEN 'bonus' WHEN rights IS NOT NULL THEN 'rights' {" ".join(f"WHEN regexp_matches(purpose, '{p}', 'i') THEN '{k}'" for k, p in KINDS.items())} ELSE 'other' END AS kind,
    coalesce(faces, bonus, rights, 1.0) AS ratio, faces IS NOT NULL OR bonus IS NOT NULL OR (rights IS NULL AND regexp_matches(purpose, '{"|".join(KINDS.values())}', 'i')) AS confident, purpose FROM y),
  act AS (SELECT symbol, ex_date, product(ratio) AS ratio FROM parsed WHERE confident AND kind IN {PRICE_KINDS} AND ratio <> 1 GROUP BY symbol, ex_date)"""


def parse_purpose(actions: DataFrame) -> DataFrame:
    """``actions`` (symbol, ex_date, purpose) with kind, ratio (of prices before the date) and confident; the first pattern
    that fits decides. A rights issue's ratio leaves out what was paid, so it is not confident."""
    pair = lambda p: [F.regexp_extract("purpose", f"(?is){p}", k).try_cast("double") for k in (1, 2)]
    faces = F.coalesce(*(F.when((new > 0) & (new < old), new / old) for old, new in map(pair, FACES.values())))
    shares = {k: F.when((a > 0) & (b > 0), b / (a + b)) for k, (a, b) in ((k, pair(p)) for k, p in SHARES.items())}
    rows = actions.withColumns({"_faces": faces, **{f"_{k}": x for k, x in shares.items()}})
    kind = F.when(C("_faces").isNotNull(), "split").when(C("_bonus").isNotNull(), "bonus").when(C("_rights").isNotNull(), "rights")
    for name, pattern in KINDS.items():
        kind = kind.when(C("purpose").rlike(f"(?i){pattern}"), name)
    rows = rows.withColumn("kind", kind.otherwise("other")).withColumn("ratio", F.coalesce("_faces", "_bonus", "_rights", F.lit(1.0)))
    return rows.select("symbol", "ex_date", "kind", "ratio", (~C("kind").isin("rights", "other")).alias("confident"), "purpose")


def parsed(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(ACTIONS, "symbol string, ex_date string, purpose string")
    return parse_purpose(rows.withColumn("ex_date", C("ex_date").cast("date")))


def price_actions(spark: SparkSession) -> DataFrame:
    """symbol, ex_date and ratio of the confident actions that change prices; those of one day multiply."""
    rows = parsed(spark).where(C("confident") & C("kind").isin(*PRICE_KINDS) & (C("ratio") != 1))
    return rows.groupBy("symbol", "ex_date").agg(F.product("ratio").alias("ratio"))


def adjust(rows: DataFrame, actions: DataFrame) -> DataFrame:
    """``rows`` (bars) with prices times the ratios of later actions: actions and bars in one order, a reverse running product;
    no range join. prev_close takes the factor of the row before, volume is divided, turnover stays."""
    later_ = actions.select("symbol", C("ex_date").alias("date"), "ratio")
    both = rows.unionByName(later_, allowMissingColumns=True)
    # An action on a bar's own date does not count: bars sort as if a day later.
    both = both.withColumn("_day", F.unix_date(F.when(C("ratio").isNull(), F.date_add("date", 1)).otherwise(C("date"))))
    later = Window.partitionBy("symbol").orderBy(F.desc("_day")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("adj_factor", F.product(F.coalesce("ratio", F.lit(1.0))).over(later)).where("ratio IS NULL").drop("ratio", "_day")
    guard = F.when(~C("adj_factor").between(1e-4, 1e4), F.raise_error(F.lit("an adjustment factor out of bounds")).cast("double")).otherwise(C("adj_factor"))
    both = both.withColumn("adj_factor", guard).withColumn("_before", F.coalesce(F.lag("adj_factor").over(by_symbol()), C("adj_factor")))
    scaled = {c: C(c) * C("adj_factor") for c in ("open", "high", "low", "close")} | {"prev_close": C("prev_close") * C("_before")}
    both = both.withColumns(scaled | {"volume": F.bround(C("volume") / C("adj_factor")).cast("long")})
    return both.withColumn("adj_close", C("close")).drop("_before")


def adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjust(bars(spark, sf_dir), price_actions(spark))


def continuity_breaks(rows: DataFrame, actions: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Bars whose prev_close is not the close before; an action of that day with that ratio explains it."""
    rows = rows.withColumn("prior_close", F.lag("close").over(by_symbol())).withColumn("gap", C("prev_close") / C("prior_close"))
    rows = rows.where(F.abs(C("gap") - 1) > tolerance).join(actions.withColumnRenamed("ex_date", "date"), ["symbol", "date"], "left")
    explained = F.coalesce(F.abs(C("gap") - C("ratio")) <= tolerance, F.lit(False))
    return rows.select("symbol", "date", "prev_close", "prior_close", C("gap").alias("ratio"), explained.alias("explained"))


ADJUSTED_SQL = f"""{bars_sql()}, {PARSED_SQL}, f AS (SELECT b.symbol, b.date, coalesce(product(ratio), 1.0) AS factor FROM bars b LEFT JOIN act p ON p.symbol = b.symbol AND p.ex_date > b.date GROUP BY b.symbol, b.date),
    adj AS (SELECT b.* REPLACE (open * factor AS open, high * factor AS high, low * factor AS low, close * factor AS close, prev_close * coalesce(lag(factor) OVER (PARTITION BY b.symbol ORDER BY b.date), factor) AS prev_close,
      CAST(round_even(volume / factor, 0) AS BIGINT) AS volume), factor AS adj_factor, close * factor AS adj_close FROM bars b JOIN f USING (symbol, date))"""
ADJUSTED = ("open", "high", "low", "close", "prev_close", "adj_factor", "adj_close")
query("agg_cumulative_factor", f"{ADJUSTED_SQL} SELECT symbol, date, round(factor, 8) AS adj_factor FROM f")(lambda s, d: adjusted(s, d).select("symbol", "date", F.round("adj_factor", 8).alias("adj_factor")))
query("agg_adjust_symbol", f"{ADJUSTED_SQL} SELECT symbol, date, {', '.join(f'round({c}, 6) AS {c}' for c in ADJUSTED)}, volume, turnover FROM adj")(
    lambda s, d: adjusted(s, d).select("symbol", "date", *(F.round(c, 6).alias(c) for c in ADJUSTED), "volume", "turnover")
)
query("agg_adjust_all", f"{ADJUSTED_SQL} SELECT symbol, count(*) AS n, count(*) FILTER (adj_factor <> 1) AS changed, round(sum(adj_close), 4) AS total, sum(volume)::BIGINT AS volume FROM adj GROUP BY symbol")(
    lambda s, d: adjusted(s, d).groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(C("adj_factor") != 1).alias("changed"), F.round(F.sum("adj_close"), 4).alias("total"), F.sum("volume").alias("volume"))
)
query("prj_scale_volume", f"{ADJUSTED_SQL} SELECT symbol, date, volume, turnover FROM adj")(lambda s, d: adjusted(s, d).select("symbol", "date", "volume", "turnover"))
query(
    "agg_continuity",
    f"""{GATED}, {PARSED_SQL}, p AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prior_close FROM ok)
    SELECT p.symbol, date, prev_close, prior_close, prev_close / prior_close AS ratio, coalesce(abs(prev_close / prior_close - act.ratio) <= 0.005, false) AS explained FROM p LEFT JOIN act ON act.symbol = p.symbol AND act.ex_date = p.date WHERE abs(prev_close / prior_close - 1) > 0.005""",
)(lambda s, d: continuity_breaks(accepted(s, d), price_actions(s)))

# Indicators

W = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
LAG = "OVER (PARTITION BY symbol ORDER BY date)"


def sql_rolling(f: str, x: str, n: int, least: int) -> str:
    w = W.format(n - 1)
    return f"CASE WHEN count({x}) {w} >= {least} THEN {f}({x}) {w} END"


def sql_ewm(x: str, alpha: float, least: int) -> str:
    b, w = 1 - alpha, W.format("UNBOUNDED")
    return f"CASE WHEN count({x}) {w} >= {least} THEN pow({b!r}, t) * sum(CASE WHEN t = 0 THEN 1.0 ELSE {alpha!r} END * pow({b!r}, -t) * {x}) {w} END"


def sql_ema(x: str, span: int) -> str:
    return sql_ewm(x, 2 / (span + 1), span // 2)


def mean(n: int) -> str:
    return f"({sql_rolling('avg', 'close', n, n // 2)})"


def typical() -> Column:
    return (C("high") + C("low") + C("close")) / 3


def positive(x: Column) -> Column:
    return F.nullif(x, F.lit(0.0))


ROC = {"1m": 21, "3m": 63, "6m": 126, "12m": 252}
LOW14, HIGH14 = sql_rolling("min", "low", 14, 7), sql_rolling("max", "high", 14, 7)
MID, SD = sql_rolling("avg", "close", 20, 10), sql_rolling("stddev_samp", "close", 20, 10)
PEAK, HIGH52, LOW52 = sql_rolling("max", "close", 252, 21), sql_rolling("max", "high", 252, 21), sql_rolling("min", "low", 252, 21)
VWAP = (sql_rolling("sum", "((high + low + close) / 3 * volume)", 20, 10), sql_rolling("sum", "CAST(volume AS DOUBLE)", 20, 10))

over_bars("core_sma", {f"trend_sma_{n}": mean(n) for n in (20, 50, 200)}, lambda: {f"trend_sma_{n}": fw.sma(C("close"), n) for n in (20, 50, 200)})
over_bars("core_ema", {f"trend_ema_{n}": sql_ema("close", n) for n in (12, 26, 50)}, lambda: {f"trend_ema_{n}": fw.ema(C("close"), n) for n in (12, 26, 50)})
over_bars("core_rma", {"rma_14": sql_ewm("close", 1 / 14, 14)}, lambda: {"rma_14": fw.rma(C("close"), 14)})
over_bars(
    "trend_price_vs_sma",
    {f"trend_price_vs_sma{n}": f"(close - {mean(n)}) / {mean(n)}" for n in (20, 50, 200)},
    lambda: {f"trend_price_vs_sma{n}": (C("close") - fw.sma(C("close"), n)) / fw.sma(C("close"), n) for n in (20, 50, 200)},
)
over_bars("trend_macd", {"trend_macd": f"{sql_ema('close', 12)} - {sql_ema('close', 26)}"}, lambda: {"trend_macd": fw.ema(C("close"), 12) - fw.ema(C("close"), 26)})
over_bars(
    "momentum_roc",
    {f"momentum_roc_{k}": f"(close / lag(close, {n}) {LAG} - 1) * 100" for k, n in ROC.items()},
    lambda: {f"momentum_roc_{k}": (C("close") / F.lag("close", n).over(by_symbol()) - 1) * 100 for k, n in ROC.items()},
)
over_bars(
    "momentum_stoch_k",
    {"momentum_stoch_k": f"100 * (close - ({LOW14})) / nullif(({HIGH14}) - ({LOW14}), 0)"},
    lambda: {"momentum_stoch_k": 100 * (C("close") - fw.rolling(F.min, C("low"), 14, 7)) / positive(fw.rolling(F.max, C("high"), 14, 7) - fw.rolling(F.min, C("low"), 14, 7))},
)
over_bars(
    "volatility_bollinger",
    {"volatility_bb_mid": MID, "volatility_bb_upper": f"({MID}) + 2 * ({SD})", "volatility_bb_lower": f"({MID}) - 2 * ({SD})"},
    lambda: (lambda m, s: {"volatility_bb_mid": m, "volatility_bb_upper": m + 2 * s, "volatility_bb_lower": m - 2 * s})(fw.rolling(F.avg, C("close"), 20, 10), fw.rolling(F.stddev_samp, C("close"), 20, 10)),
)
over_bars("typical_price", {"typical_price": "(high + low + close) / 3"}, lambda: {"typical_price": typical()})
over_bars(
    "volume_vwap_20",
    {"volume_vwap_20": f"({VWAP[0]}) / ({VWAP[1]})"},
    lambda: {"volume_vwap_20": fw.rolling(F.sum, typical() * C("volume"), 20, 10) / fw.rolling(F.sum, C("volume").cast("double"), 20, 10)},
)
over_bars("volume_ratio", {"volume_ratio": f"volume / nullif({sql_rolling('avg', 'volume', 20, 5)}, 0)"}, lambda: {"volume_ratio": C("volume") / positive(fw.rolling(F.avg, C("volume"), 20, 5))})
over_bars("regime_drawdown", {"regime_drawdown": f"(close - ({PEAK})) / ({PEAK})"}, lambda: {"regime_drawdown": (lambda p: (C("close") - p) / p)(fw.rolling(F.max, C("close"), 252, 21))})
over_bars(
    "regime_52w_position",
    {"regime_52w_position": f"(close - ({LOW52})) / nullif(({HIGH52}) - ({LOW52}), 0)"},
    lambda: {"regime_52w_position": (lambda h, x: (C("close") - x) / positive(h - x))(fw.rolling(F.max, C("high"), 252, 21), fw.rolling(F.min, C("low"), 252, 21))},
)
over_bars("fn_returns", {"simple_return": "close / prev_close - 1", "log_return": "ln(close / prev_close)"}, lambda: {"simple_return": C("close") / C("prev_close") - 1, "log_return": F.ln(C("close") / C("prev_close"))})
@query(
    "win_xs_rank",
    f"""{bars_sql()}, r AS (SELECT symbol, date, close / prev_close - 1 AS r FROM bars), k AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY r NULLS LAST) AS k,
      count(*) OVER (PARTITION BY date, r) AS ties, count(r) OVER (PARTITION BY date) AS n, count(*) OVER (PARTITION BY date) AS m FROM r)
    SELECT symbol, date, round(CASE WHEN m >= 20 AND r IS NOT NULL THEN (k + (ties - 1) / 2.0) / n END, 8) AS return_xs FROM k""",
)
def win_xs_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars(spark, sf_dir).withColumn("r", C("close") / C("prev_close") - 1)
    return rows.select("symbol", "date", F.round(fw.rank_pct(C("r"), "date", 20, "symbol"), 8).alias("return_xs"))


@query(
    "screen_momentum",
    f"""{GATED}, m AS (SELECT symbol, date, close, (close / lag(close, 4) OVER (PARTITION BY symbol ORDER BY date) - 1) * 100 AS roc,
      row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS r FROM ok)
    SELECT symbol, date, close, roc FROM m WHERE r = 1 AND roc IS NOT NULL ORDER BY roc DESC, symbol LIMIT 10""",
)
def screen_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the gate's accepted bars, four-period momentum, the latest bar of each symbol, the best ten."""
    newest = Window.partitionBy("symbol").orderBy(F.desc("date"))
    rows = accepted(spark, sf_dir).withColumn("roc", (C("close") / F.lag("close", 4).over(by_symbol()) - 1) * 100)
    rows = rows.withColumn("r", F.row_number().over(newest)).where("r = 1 AND roc IS NOT NULL")
    return rows.select("symbol", "date", "close", "roc").orderBy(F.desc("roc"), "symbol").limit(10)


# Scores against labels: calibration

SCORED = "s AS (SELECT doc_id, quality AS y, ((doc_id * 37) % 100) / 100.0 AS p FROM labels)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").select("doc_id", C("quality").alias("y"), ((C("doc_id") * 37) % 100 / 100.0).alias("p"))


query("cal_brier", f"WITH {SCORED} SELECT round(avg((p - y) * (p - y)), 8) AS brier FROM s")(lambda s, d: scored(s, d).agg(F.round(F.avg((C("p") - C("y")) * (C("p") - C("y"))), 8).alias("brier")))
_bin = "(CASE WHEN p > 0.1 THEN 1 ELSE 0 END" + "".join(f" + CASE WHEN p > {k / 10} THEN 1 ELSE 0 END" for k in range(2, 10)) + ")"
query("cal_reliability", f"WITH {SCORED} SELECT CAST({_bin} AS INTEGER) AS bin, round(avg(p), 8) AS predicted, round(avg(y), 8) AS observed, count(*) AS n FROM s GROUP BY 1 HAVING count(*) >= 20")(
    lambda s, d: scored(s, d).groupBy(F.expr(_bin).cast("int").alias("bin")).agg(F.round(F.avg("p"), 8).alias("predicted"), F.round(F.avg("y"), 8).alias("observed"), F.count("*").alias("n")).where("n >= 20")
)
query("bt_position", f"WITH {SCORED} SELECT doc_id, CASE WHEN p >= 0.55 THEN 1 WHEN p <= 0.45 THEN -1 ELSE 0 END AS position FROM s")(
    lambda s, d: scored(s, d).select("doc_id", F.when(C("p") >= 0.55, 1).when(C("p") <= 0.45, -1).otherwise(0).alias("position"))
)

# Return metrics of each symbol

RETURNS = f"{bars_sql(DAY)}, r AS (SELECT symbol, close / prev_close - 1 AS r FROM bars WHERE prev_close IS NOT NULL)"
METRICS = {
    "sharpe": "CASE WHEN count(r) < 2 OR stddev_pop(r) < 1e-15 THEN 0.0 ELSE avg(r) / stddev_pop(r) * sqrt(252) END",
    "win_rate": "avg(CASE WHEN r > 0 THEN 1.0D ELSE 0.0D END)",
    "profit_factor": "sum(CASE WHEN r > 0 THEN r ELSE 0 END) / nullif(abs(sum(CASE WHEN r < 0 THEN r ELSE 0 END)), 0)",
    "total_return": "exp(sum(ln(1 + r))) - 1",
    "sortino": "CASE WHEN sum(CASE WHEN r < 0 THEN 1 ELSE 0 END) < 2 OR stddev_pop(CASE WHEN r < 0 THEN r END) < 1e-15 THEN 0.0 ELSE avg(r) / stddev_pop(CASE WHEN r < 0 THEN r END) * sqrt(252) END",
    "cagr": "pow(exp(sum(ln(1 + r))), 252.0D / count(r)) - 1",
    "volatility": "stddev_pop(r) * sqrt(252)",
}
query("met_all", f"{RETURNS} SELECT symbol, " + ", ".join(f"round({x.replace('0D', '0')}, 8) AS {k}" for k, x in METRICS.items()) + " FROM r GROUP BY symbol")(
    lambda s, d: bars(s, d, DAY).where("prev_close IS NOT NULL").select("symbol", F.expr("close / prev_close - 1").alias("r")).groupBy("symbol").agg(*(F.round(F.expr(x), 8).alias(k) for k, x in METRICS.items()))
)
