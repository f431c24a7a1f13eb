"""The quality gate as a whole: rules of a file, a row, a day and a history; who is held, what a day's verdict is, replay.

A file is one period of ``dirty_bars``. Row rules run in their order, and the first that a row breaks owns it; all later
rules see accepted rows only. The SQL is written apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantlake.plans.market import BATCH_RULES, GATED, PARSED_SQL, ROW_RULES, C, accepted, dirty_sql, gated, history, price_actions, query
from quantlake.sources.bars import DAY, bars, bars_sql, by_symbol, dirty_bars

# Columns of a canonical bar, severities, thresholds.
CANONICAL = ("date", "symbol", "series", "open", "high", "low", "close", "prev_close", "volume", "turnover", "trades", "delivery_qty", "delivery_pct", "isin")
SEVERITY = dict.fromkeys(("T1_structural_schema", "T1_structural_non_empty", "T1_structural_date_match", *ROW_RULES), "FATAL") | {
    "T2_validity_turnover_reconciles": "ERROR",
    "T3_completeness_trading_day": "WARNING",
    "T3_completeness_row_count": "ERROR",
    "T3_completeness_missing_symbols": "WARNING",
    "T3_completeness_expected_constituents": "ERROR",
    "T4_continuity_prev_close": "ERROR",
    "T5_plausibility_circuit_breach": "WARNING",
    "T5_plausibility_return_sigma": "WARNING",
    "T5_plausibility_staleness": "INFO",
    "T5_plausibility_zero_volume_move": "WARNING",
    "T5_plausibility_volume_spike": "WARNING",
    "T6_cross_source_close_agreement": "WARNING",
}
TOLERANCE, CIRCUIT, SIGMA, SPIKE = 0.005, 20, 6, 50
HISTORY = "OVER (PARTITION BY symbol ORDER BY date RANGE BETWEEN INTERVAL 120 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)"
BEFORE = "OVER (PARTITION BY symbol ORDER BY date)"
FIVE = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"

# T1: columns, rows and dates of a file. Every 149th row of a symbol was put in the file of the week before.


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirty_bars(spark, sf_dir).withColumn("file_date", F.when(C("t") % 149 == 7, F.date_sub("date", 7)).otherwise(C("date")))


FILES = f"{dirty_sql()}, files AS (SELECT *, CASE WHEN t % 149 = 7 THEN date - 7 ELSE date END AS file_date FROM dirty)"


def missing_columns(rows: DataFrame) -> list[str]:
    return [c for c in CANONICAL if c not in rows.columns]


query(
    "T1_structural_non_empty",
    f"""{bars_sql(DAY)}, one AS (SELECT date FROM bars WHERE symbol = 'Brand#11'), days AS (SELECT CAST(unnest(generate_series((SELECT min(date) FROM one), (SELECT max(date) FROM one), INTERVAL 1 DAY)) AS DATE) AS date)
    SELECT date FROM days WHERE isodow(date) <= 5 AND date NOT IN (SELECT date FROM one)""",
)(
    lambda s, d: (lambda one: one.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(F.explode(F.sequence("a", "b")).alias("date")).where(F.weekday("date") < 5).join(one, "date", "left_anti"))(
        bars(s, d, DAY).where("symbol = 'Brand#11'").select("date")
    )
)
query("T1_structural_date_match", f"{FILES} SELECT file_date, count(*) FILTER (date <> file_date) AS others FROM files GROUP BY file_date HAVING count(*) FILTER (date <> file_date) > 0")(
    lambda s, d: files(s, d).groupBy("file_date").agg(F.count_if(C("date") != C("file_date")).alias("others")).where("others > 0")
)

# T3: who is not there. Read from each symbol's own next day, without a join of two days.


def missing_symbols(rows: DataFrame, actions: DataFrame) -> DataFrame:
    """Symbols of a market day that the next market day lacks, unless an action that changes prices falls on that day."""
    days = rows.select("date").distinct().withColumn("following", F.lead("date").over(Window.orderBy("date")))  # one row a day
    rows = rows.select("symbol", "date", F.lead("date").over(by_symbol()).alias("own")).join(days, "date")
    gone = rows.where("following IS NOT NULL AND (own IS NULL OR own > following)").select("symbol", C("following").alias("date"))
    return gone.join(actions.select("symbol", C("ex_date").alias("date")), ["symbol", "date"], "left_anti")


def missing_constituents(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """(date, symbol) of the ``expected`` symbols that a day lacks; their number times the days is what is compared."""
    whole = F.broadcast(expected.agg(F.sort_array(F.collect_set("symbol")).alias("all")))
    seen = rows.groupBy("date").agg(F.collect_set("symbol").alias("seen"))
    return seen.join(whole, how="cross").select("date", F.explode(F.array_except("all", "seen")).alias("symbol"))


query(
    "T3_completeness_missing_symbols",
    f"""{bars_sql(DAY)}, {PARSED_SQL}, d AS (SELECT date, lead(date) OVER (ORDER BY date) AS following FROM (SELECT DISTINCT date FROM bars))
    SELECT symbol, following AS date FROM bars JOIN d USING (date) WHERE following IS NOT NULL AND NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = bars.symbol AND b.date = following)
      AND NOT EXISTS (SELECT 1 FROM act WHERE act.symbol = bars.symbol AND act.ex_date = following)""",
)(lambda s, d: missing_symbols(bars(s, d, DAY), price_actions(s)))
#: The constituents that the market is expected to have: symbols with more than 1,000 bars, or at the smallest scale 200.
query(
    "T3_completeness_expected_constituents",
    f"{bars_sql(DAY)}, e AS (SELECT symbol FROM bars GROUP BY symbol HAVING count(*) > 200) SELECT d.date, e.symbol FROM (SELECT DISTINCT date FROM bars) d CROSS JOIN e WHERE (d.date, e.symbol) NOT IN (SELECT (date, symbol) FROM bars)",
)(lambda s, d: (lambda b: missing_constituents(b, b.groupBy("symbol").count().where("count > 200")))(bars(s, d, DAY)))

# T4 and T5 on accepted rows, less what an action of the day explains


def with_actions(rows: DataFrame, actions: DataFrame) -> DataFrame:
    return rows.join(actions.withColumnRenamed("ex_date", "date"), ["symbol", "date"], "left")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted bars with a boolean column for each rule that sees them: one order by symbol, one small join."""
    rows = accepted(spark, sf_dir)
    returns = F.ln(C("close") / C("prev_close"))
    five = by_symbol().rowsBetween(-5, -1)
    rows = rows.withColumns(
        {
            "prior": F.lag("close").over(by_symbol()), "r": returns, "sd": F.stddev_samp(returns).over(history()),
            "median": F.percentile("volume", F.lit(0.5)).over(history()), "n5": F.count("close").over(five), "low5": F.min("close").over(five), "high5": F.max("close").over(five),
        }
    )
    rows = with_actions(rows, price_actions(spark))
    none, gap = C("ratio").isNull(), C("prev_close") / C("prior")
    flags: dict[str, Column] = {
        "T2_validity_turnover_reconciles": F.expr(BATCH_RULES["T2_validity_turnover_reconciles"]),
        "T4_continuity_prev_close": (F.abs(gap - 1) > TOLERANCE) & ~F.coalesce(F.abs(gap - C("ratio")) <= TOLERANCE, F.lit(False)),
        "T5_plausibility_circuit_breach": none & (C("prev_close") > 0) & (F.abs(C("close") / C("prev_close") - 1) * 100 > CIRCUIT),
        "T5_plausibility_return_sigma": none & (F.abs(C("r") / F.nullif(C("sd"), F.lit(0.0))) > SIGMA),
        "T5_plausibility_staleness": (C("n5") == 5) & (C("low5") == C("high5")),
        "T5_plausibility_zero_volume_move": F.expr(BATCH_RULES["T5_plausibility_zero_volume_move"]),
        "T5_plausibility_volume_spike": (C("median") > 0) & (C("volume") / C("median") > SPIKE),
    }
    return rows.select("symbol", "date", *(F.coalesce(x, F.lit(False)).alias(k) for k, x in flags.items()))


JUDGED = f"""{GATED}, {PARSED_SQL}, h AS (SELECT *, lag(close) {BEFORE} AS prior, ln(close / prev_close) AS r, count(close) {FIVE} AS n5, min(close) {FIVE} AS low5, max(close) {FIVE} AS high5, median(volume) {HISTORY} AS med FROM ok),
    g AS (SELECT *, stddev_samp(r) {HISTORY} AS sd FROM h),
    judged AS (SELECT g.symbol, g.date,
      volume > 0 AND turnover > 0 AND turnover / volume NOT BETWEEN low * 0.95 AND high * 1.05 AS T2_validity_turnover_reconciles,
      coalesce(abs(prev_close - prior) / prior > {TOLERANCE} AND NOT coalesce(abs(prev_close / prior - act.ratio) <= {TOLERANCE}, false), false) AS T4_continuity_prev_close,
      coalesce(act.ratio IS NULL AND prev_close > 0 AND abs(close / prev_close - 1) * 100 > {CIRCUIT}, false) AS T5_plausibility_circuit_breach,
      coalesce(act.ratio IS NULL AND sd > 0 AND abs(r) / sd > {SIGMA}, false) AS T5_plausibility_return_sigma,
      n5 = 5 AND low5 = high5 AS T5_plausibility_staleness, coalesce(volume = 0 AND close <> prev_close, false) AS T5_plausibility_zero_volume_move,
      coalesce(med > 0 AND volume / med > {SPIKE}, false) AS T5_plausibility_volume_spike
      FROM g LEFT JOIN act ON act.symbol = g.symbol AND act.ex_date = g.date)"""
for _name in ("T4_continuity_prev_close", "T5_plausibility_circuit_breach", "T5_plausibility_return_sigma", "T5_plausibility_staleness"):
    query(_name, f"{JUDGED} SELECT symbol, date FROM judged WHERE {_name}")(lambda s, d, name=_name: judged(s, d).where(name).select("symbol", "date"))
query("join_action_lookup", f"{GATED}, {PARSED_SQL} SELECT ok.symbol, date, ratio FROM ok JOIN act ON act.symbol = ok.symbol AND act.ex_date = ok.date")(
    lambda s, d: with_actions(accepted(s, d), price_actions(s)).where("ratio IS NOT NULL").select("symbol", "date", "ratio")
)

# Held rows by their place in the file


def offending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place in its file (from 0, by symbol), date, symbol and rule of each held row."""
    place = F.row_number().over(Window.partitionBy("date").orderBy("symbol")) - 1
    return gated(spark, sf_dir).withColumn("row_index", place).where("held_by IS NOT NULL").select("date", "row_index", "symbol", C("held_by").alias("rule"))


query(
    "gate_offending",
    f"{GATED}, o AS (SELECT date, CAST(row_number() OVER (PARTITION BY date ORDER BY symbol) - 1 AS INTEGER) AS row_index, symbol, held_by AS rule FROM gated) SELECT * FROM o WHERE rule IS NOT NULL",
)(offending)


# Replay: held rows meet the gate again, without the rules that have been relaxed. Released rows have no rule.


def replay(held: DataFrame, relaxed: tuple[str, ...]) -> DataFrame:
    rules = " ".join(f"WHEN {rule} THEN '{name}'" for name, rule in ROW_RULES.items() if name not in relaxed)
    return held.withColumn("now_held_by", F.expr(f"CASE {rules} END"))


RELAXED = ("T2_validity_delivery_bounds", "T2_validity_high_low")
_kept = " ".join(f"WHEN {rule} THEN '{name}'" for name, rule in ROW_RULES.items() if name not in RELAXED)
query("gate_replay", f"{GATED} SELECT symbol, date, held_by, CASE {_kept} END AS now_held_by FROM gated WHERE held_by IS NOT NULL")(
    lambda s, d: replay(gated(s, d).where("held_by IS NOT NULL"), RELAXED).select("symbol", "date", "held_by", "now_held_by")
)
