"""The gate of all rules over daily files: what each file fails, what is held, its verdict and its report.

A file is what came for one day. T1 looks at the file and, if it fails, nothing else does: all its rows are held and none counts
for later days. Else the first row rule that a row breaks holds it, and the other tiers see accepted rows only, in the file and
in the symbols' histories. Rows pass once: windows by file and by (symbol, accepted), then one aggregate a file with what each
rule objects to; a universe's symbols bound its arrays. What compares days runs over one row a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantlake.plans.gate import BEFORE, CIRCUIT, FIVE, HISTORY, SEVERITY, SIGMA, SPIKE, TOLERANCE, missing_columns
from quantlake.plans.market import BATCH_RULES, OWNER, PARSED_SQL, ROW_RULES, C, price_actions, query
from quantlake.sources.bars import DAY, bars, by_symbol, dirty_bars, dirty_sql

# Thresholds of rows and closes, days looked back, holidays (month and day), rows shown.
ROW_COUNT, CLOSES, LOOK_BACK, HISTORY_DAYS, SAMPLE, LATEST = 0.25, 1.0, 20, 120, 20, 50
HOLIDAYS = ("01-26", "05-01", "08-15", "10-02", "12-25")
EXPECTED_BARS = 200
ANNOTATING = [k for k in SEVERITY if k.startswith(("T2_validity_turnover", "T4", "T5", "T6"))]


def examined(rows: DataFrame, actions: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of files (file_date and canonical columns) with blocked (their file is rejected), held_by, ok and a boolean for each rule
    that annotates accepted rows. ``actions`` are price_actions(), ``other`` the closes of a second source (symbol, date, other)."""
    rows = rows.join(other, ["symbol", "date"], "left").join(actions.withColumnRenamed("ex_date", "date"), ["symbol", "date"], "left")
    rows = rows.withColumn("others", F.count_if(C("date") != C("file_date")).over(Window.partitionBy("file_date")))
    rows = rows.withColumn("blocked", C("others") > 0).withColumn("held_by", F.when(~C("blocked"), F.expr(OWNER)))
    rows = rows.withColumn("ok", ~C("blocked") & C("held_by").isNull())
    by = Window.partitionBy("symbol", "ok").orderBy("date")  # accepted rows see accepted rows
    past, five = Window.partitionBy("symbol", "ok").orderBy(F.unix_date("date")).rangeBetween(-HISTORY_DAYS, -1), by.rowsBetween(-5, -1)
    returns = F.when(C("ok"), F.ln(F.try_divide(C("close"), C("prev_close"))))
    rows = rows.withColumns(
        {
            "prior": F.lag("close").over(by), "r": returns, "sd": F.stddev_samp(returns).over(past), "median": F.percentile("volume", F.lit(0.5)).over(past),
            "n5": F.count("close").over(five), "low5": F.min("close").over(five), "high5": F.max("close").over(five),
        }
    )
    none, gap = C("ratio").isNull(), F.try_divide(C("prev_close"), C("prior"))
    flags: dict[str, Column] = {
        "T2_validity_turnover_reconciles": F.expr(BATCH_RULES["T2_validity_turnover_reconciles"]),
        "T4_continuity_prev_close": (F.abs(gap - 1) > TOLERANCE) & ~F.coalesce(F.abs(gap - C("ratio")) <= TOLERANCE, F.lit(False)),
        "T5_plausibility_circuit_breach": none & (C("prev_close") > 0) & (F.abs(F.try_divide(C("close"), C("prev_close")) - 1) * 100 > CIRCUIT),
        "T5_plausibility_return_sigma": none & (F.abs(F.try_divide(C("r"), C("sd"))) > SIGMA),
        "T5_plausibility_staleness": (C("n5") == 5) & (C("low5") == C("high5")),
        "T5_plausibility_zero_volume_move": F.expr(BATCH_RULES["T5_plausibility_zero_volume_move"]),
        "T5_plausibility_volume_spike": (C("median") > 0) & (F.try_divide(C("volume"), C("median")) > SPIKE),
        "T6_cross_source_close_agreement": F.try_divide(F.abs(C("close") - C("other")), C("other")) * 100 > CLOSES,
    }
    return rows.select("file_date", "date", "symbol", "others", "blocked", "held_by", "ok", *((C("ok") & F.coalesce(x, F.lit(False))).alias(k) for k, x in flags.items()))


def judged_files(seen: DataFrame, expected: DataFrame, actions: DataFrame, calendar: DataFrame, lacking: list[str]) -> DataFrame:
    """file_date, rows_in, rows_held, rejected and failures (an array of rule, n and symbols) of each file, and of each day of
    ``calendar`` (date) for which none came. ``expected`` are the symbols (symbol) that every day must have; ``lacking`` the canonical
    columns that the files do not have, which rejects them all."""
    held = {k: C("held_by") == k for k in ROW_RULES}
    per_row = {**held, **{k: C(k) for k in ANNOTATING}}
    facts = [F.count("*").alias("rows_in"), F.max("others").alias("others"), F.count("held_by").alias("held"), F.count_if("ok").alias("n_ok"), F.array_sort(F.collect_set(F.when(C("ok"), C("symbol")))).alias("symbols")]
    named = [F.struct(F.lit(k).alias("rule"), F.count_if(x).alias("n"), F.array_sort(F.collect_set(F.when(x, C("symbol")))).alias("symbols")) for k, x in per_row.items()]
    files = seen.groupBy("file_date").agg(*facts, F.array(*named).alias("by_row"))
    files = files.join(calendar.select(C("date").alias("file_date")).distinct(), "file_date", "full").na.fill(0, ["rows_in", "others", "held", "n_ok"])
    some = C("n_ok") > 0
    order = Window.orderBy("file_date")  # one row a file
    files = files.withColumn("previous", F.last(F.when(some, C("symbols")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    files = files.withColumn("usual", F.percentile(F.when(some, C("n_ok")), F.lit(0.5)).over(order.rowsBetween(-LOOK_BACK, -1)))
    acted = actions.groupBy(C("ex_date").alias("file_date")).agg(F.collect_set("symbol").alias("acted"))
    whole = expected.agg(F.array_sort(F.collect_set("symbol")).alias("wanted"))  # one row
    files = files.join(acted, "file_date", "left").join(F.broadcast(whole), how="cross")
    empty, no_symbols = C("rows_in") == 0, F.array().cast("array<string>")
    here = F.coalesce("symbols", no_symbols)
    gone = F.array_except(F.array_except(F.coalesce("previous", no_symbols), here), F.coalesce("acted", no_symbols))
    absent = F.array_except("wanted", here)
    closed = (F.weekday("file_date") >= 5) | F.date_format("file_date", "MM-dd").isin(*HOLIDAYS)
    rejected = empty | (C("others") > 0) | F.lit(bool(lacking))
    go_on = ~rejected
    first = {
        "T1_structural_schema": (F.lit(bool(lacking)), F.lit(len(lacking)).cast("long"), no_symbols),
        "T1_structural_non_empty": (empty, F.lit(0).cast("long"), no_symbols),
        "T1_structural_date_match": (C("others") > 0, C("others"), no_symbols),
        "T3_completeness_trading_day": (go_on & some & closed, C("n_ok"), no_symbols),
        "T3_completeness_row_count": (go_on & (C("usual") > 0) & (F.try_divide(F.abs(C("n_ok") - C("usual")), C("usual")) > ROW_COUNT), C("n_ok"), no_symbols),
        "T3_completeness_missing_symbols": (go_on & (F.size(gone) > 0), F.size(gone).cast("long"), gone),
        "T3_completeness_expected_constituents": (go_on & (F.size(absent) > 0), F.size(absent).cast("long"), absent),
    }
    of_file = F.array_compact(F.array(*(F.when(x, F.struct(F.lit(k).alias("rule"), n.alias("n"), s.alias("symbols"))) for k, (x, n, s) in first.items())))
    of_rows = F.when(go_on, F.filter("by_row", lambda x: x["n"] > 0)).otherwise(F.array())
    return files.select("file_date", "rows_in", F.when(rejected, C("rows_in")).otherwise(C("held")).alias("rows_held"), rejected.alias("rejected"), F.concat(of_file, of_rows).alias("failures"))


def severity(rule: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for k in SEVERITY.items() for x in k)), rule)


def reported(files: DataFrame) -> DataFrame:
    """date, rule, severity, affected_rows, symbols (all, sorted) and evidence (JSON with a sample of SAMPLE) of each failure."""
    rows = files.select(C("file_date").alias("date"), F.explode("failures").alias("f"))
    evidence = F.to_json(F.struct(C("f.n").alias("count"), F.slice("f.symbols", 1, SAMPLE).alias("sample")))
    return rows.select("date", "f.rule", severity(C("f.rule")).alias("severity"), C("f.n").alias("affected_rows"), F.array_join("f.symbols", ",").alias("symbols"), evidence.alias("evidence"))


def judged(files: DataFrame) -> DataFrame:
    """date, verdict, rows_in, rows_accepted, rows_quarantined and failures: REJECTED if T1 fails, else QUARANTINED if a row is held, else
    PASS_WITH_WARNINGS if any rule fails, else PASS."""
    verdict = F.when(C("rejected"), "REJECTED").when(C("rows_held") > 0, "QUARANTINED").when(F.size("failures") > 0, "PASS_WITH_WARNINGS").otherwise("PASS")
    kept = (C("rows_in") - C("rows_held")).alias("rows_accepted")
    return files.select(C("file_date").alias("date"), verdict.alias("verdict"), "rows_in", kept, C("rows_held").alias("rows_quarantined"), F.size("failures").cast("long").alias("failures"))


# The given tables as files: daily bars with defects; every 997th row of a symbol came in the file of the day before; every weekday
# is expected to have a file; a second source says another close of every 139th row.


def day_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dirty_bars(spark, sf_dir, DAY).withColumn("file_date", F.when(C("t") % 997 == 7, F.date_sub("date", 1)).otherwise(C("date")))
    return rows.withColumns({"series": F.lit("EQ"), "delivery_pct": F.try_divide(C("delivery_qty") * 100.0, C("volume")), "isin": F.concat(F.lit("IN"), F.md5("symbol"))})


def second_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars(spark, sf_dir, DAY).withColumn("t", F.row_number().over(by_symbol()))
    return rows.select("symbol", "date", F.when(C("t") % 139 == 25, C("close") * 1.02).otherwise(C("close")).alias("other"))


def seen_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return examined(day_files(spark, sf_dir), price_actions(spark), second_source(spark, sf_dir))


def all_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = day_files(spark, sf_dir)
    span = bars(spark, sf_dir, DAY).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    calendar = span.select(F.explode(F.sequence("a", "b")).alias("date")).where(F.weekday("date") < 5)
    expected = bars(spark, sf_dir, DAY).groupBy("symbol").count().where(C("count") > EXPECTED_BARS).select("symbol")
    return judged_files(examined(rows, price_actions(spark), second_source(spark, sf_dir)), expected, price_actions(spark), calendar, missing_columns(rows))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reported(all_files(spark, sf_dir))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(all_files(spark, sf_dir))


SEVERITY_SQL = "CASE rule " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEVERITY.items()) + " END"
SEEN = f"""{dirty_sql(DAY)}, {PARSED_SQL}, f0 AS (SELECT *, CASE WHEN t % 997 = 7 THEN date - 1 ELSE date END AS file_date FROM dirty),
    bad AS (SELECT file_date, count(*) AS n FROM f0 WHERE date <> file_date GROUP BY file_date),
    f1 AS (SELECT f0.*, bad.n IS NOT NULL AS blocked FROM f0 LEFT JOIN bad USING (file_date)), f2 AS (SELECT *, CASE WHEN NOT blocked THEN {OWNER} END AS held_by FROM f1), ok AS (SELECT * FROM f2 WHERE NOT blocked AND held_by IS NULL),
    src2 AS (SELECT symbol, date, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY date) % 139 = 25 THEN close * 1.02 ELSE close END AS other FROM bars),
    h AS (SELECT *, lag(close) {BEFORE} AS prior, ln(close / prev_close) AS r, count(close) {FIVE} AS n5, min(close) {FIVE} AS low5, max(close) {FIVE} AS high5, median(volume) {HISTORY} AS med FROM ok),
    g AS (SELECT *, stddev_samp(r) {HISTORY} AS sd FROM h),
    ju AS (SELECT g.symbol, g.file_date, volume > 0 AND turnover > 0 AND turnover / volume NOT BETWEEN low * 0.95 AND high * 1.05 AS T2_validity_turnover_reconciles,
      coalesce(abs(prev_close - prior) / prior > {TOLERANCE} AND NOT coalesce(abs(prev_close / prior - act.ratio) <= {TOLERANCE}, false), false) AS T4_continuity_prev_close,
      coalesce(act.ratio IS NULL AND prev_close > 0 AND abs(close / prev_close - 1) * 100 > {CIRCUIT}, false) AS T5_plausibility_circuit_breach,
      coalesce(act.ratio IS NULL AND sd > 0 AND abs(r) / sd > {SIGMA}, false) AS T5_plausibility_return_sigma, n5 = 5 AND low5 = high5 AS T5_plausibility_staleness,
      coalesce(volume = 0 AND close <> prev_close, false) AS T5_plausibility_zero_volume_move, coalesce(med > 0 AND volume / med > {SPIKE}, false) AS T5_plausibility_volume_spike,
      coalesce(abs(close - other) / other * 100 > {CLOSES}, false) AS T6_cross_source_close_agreement
      FROM g LEFT JOIN act ON act.symbol = g.symbol AND act.ex_date = g.date LEFT JOIN src2 ON src2.symbol = g.symbol AND src2.date = g.date)"""
FILES = f"""{SEEN}, wd AS (SELECT CAST(unnest(generate_series((SELECT min(date) FROM bars), (SELECT max(date) FROM bars), INTERVAL 1 DAY)) AS DATE) AS file_date),
    nf AS (SELECT file_date, count(*) AS rows_in, count(held_by) AS held, count(*) FILTER (NOT blocked AND held_by IS NULL) AS n_ok, bool_or(blocked) AS blocked FROM f2 GROUP BY file_date),
    fl AS (SELECT file_date, coalesce(rows_in, 0) AS rows_in, coalesce(held, 0) AS held, coalesce(n_ok, 0) AS n_ok, rows_in IS NULL OR blocked AS rejected FROM nf FULL JOIN (SELECT file_date FROM wd WHERE isodow(file_date) <= 5) c USING (file_date)),
    us AS (SELECT *, median(CASE WHEN n_ok > 0 THEN n_ok END) OVER (ORDER BY file_date ROWS BETWEEN {LOOK_BACK} PRECEDING AND 1 PRECEDING) AS usual FROM fl),
    pv AS (SELECT a.file_date, (SELECT max(b.file_date) FROM fl b WHERE b.n_ok > 0 AND b.file_date < a.file_date) AS before FROM fl a WHERE NOT rejected),
    gone AS (SELECT pv.file_date, p.symbol FROM pv JOIN ok p ON p.file_date = pv.before WHERE NOT EXISTS (SELECT 1 FROM ok q WHERE q.file_date = pv.file_date AND q.symbol = p.symbol) AND NOT EXISTS (SELECT 1 FROM act WHERE act.symbol = p.symbol AND act.ex_date = pv.file_date)),
    ex AS (SELECT symbol FROM bars GROUP BY symbol HAVING count(*) > {EXPECTED_BARS}), absent AS (SELECT fl.file_date, ex.symbol FROM fl, ex WHERE NOT rejected AND NOT EXISTS (SELECT 1 FROM ok q WHERE q.file_date = fl.file_date AND q.symbol = ex.symbol)),
    found AS (SELECT file_date, held_by AS rule, symbol FROM f2 WHERE held_by IS NOT NULL{"".join(f" UNION ALL SELECT file_date, '{k}', symbol FROM ju WHERE {k}" for k in ANNOTATING)}
      UNION ALL SELECT file_date, 'T3_completeness_missing_symbols', symbol FROM gone UNION ALL SELECT file_date, 'T3_completeness_expected_constituents', symbol FROM absent),
    k AS (SELECT file_date AS date, rule, count(*) AS n, list_sort(list_distinct(list(symbol))) AS l FROM found GROUP BY ALL
      UNION ALL SELECT file_date, 'T1_structural_non_empty', 0, [] FROM fl WHERE rows_in = 0 UNION ALL SELECT file_date, 'T1_structural_date_match', n, [] FROM bad
      UNION ALL SELECT file_date, 'T3_completeness_trading_day', n_ok, [] FROM fl WHERE NOT rejected AND n_ok > 0 AND (isodow(file_date) >= 6 OR strftime(file_date, '%m-%d') IN {HOLIDAYS})
      UNION ALL SELECT file_date, 'T3_completeness_row_count', n_ok, [] FROM us WHERE NOT rejected AND usual > 0 AND abs(n_ok - usual) / usual > {ROW_COUNT})"""
REPORT = f"""{FILES}, report AS (SELECT date, rule, {SEVERITY_SQL} AS severity, n AS affected_rows, array_to_string(l, ',') AS symbols,
      '{{"count":' || n || ',"sample":[' || CASE WHEN len(l) > 0 THEN '"' || array_to_string(l[1:{SAMPLE}], '","') || '"' ELSE '' END || ']}}' AS evidence FROM k)"""
_verdicts = """c AS (SELECT date, count(*) AS failures FROM k GROUP BY date), verdicts AS (SELECT file_date AS date, CASE WHEN rejected THEN 'REJECTED' WHEN held > 0 THEN 'QUARANTINED' WHEN failures > 0 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS verdict,
      rows_in, CASE WHEN rejected THEN 0 ELSE rows_in - held END AS rows_accepted, CASE WHEN rejected THEN rows_in ELSE held END AS rows_quarantined, coalesce(failures, 0) AS failures FROM fl LEFT JOIN c ON c.date = fl.file_date)"""
VERDICTS = f"{FILES}, {_verdicts}"
BOTH = f"{REPORT}, {_verdicts}"
query("gate_run", f"{SEEN} SELECT file_date, symbol, date, blocked, held_by FROM f2")(lambda s, d: seen_rows(s, d).select("file_date", "symbol", "date", "blocked", "held_by"))
query("gate_report", f"{REPORT} SELECT * FROM report")(report)
query("gate_row_rule", f"{REPORT} SELECT date, rule, affected_rows, symbols FROM report WHERE severity = 'FATAL'")(lambda s, d: report(s, d).where("severity = 'FATAL'").select("date", "rule", "affected_rows", "symbols"))
query("gate_failures", f"{REPORT} SELECT date, rule, severity, affected_rows FROM report ORDER BY date DESC, rule LIMIT {LATEST}")(
    lambda s, d: report(s, d).select("date", "rule", "severity", "affected_rows").orderBy(F.desc("date"), "rule").limit(LATEST)
)
query("gate_rules_failed", f"{REPORT} SELECT rule, severity, count(*) AS files, CAST(sum(affected_rows) AS BIGINT) AS affected_rows FROM report GROUP BY rule, severity")(
    lambda s, d: report(s, d).groupBy("rule", "severity").agg(F.count("*").alias("files"), F.sum("affected_rows").alias("affected_rows"))
)
query("fn_to_json", f"{REPORT} SELECT date, rule, evidence FROM report")(lambda s, d: report(s, d).select("date", "rule", "evidence"))
query("gate_verdict", f"{VERDICTS} SELECT * FROM verdicts")(verdicts)
query(
    "agg_verdict_counts",
    f"{VERDICTS} SELECT verdict, count(*) AS files, CAST(sum(rows_in) AS BIGINT) AS rows_in, CAST(sum(rows_accepted) AS BIGINT) AS rows_accepted, CAST(sum(rows_quarantined) AS BIGINT) AS rows_quarantined FROM verdicts GROUP BY verdict",
)(lambda s, d: verdicts(s, d).groupBy("verdict").agg(F.count("*").alias("files"), *(F.sum(x).alias(x) for x in ("rows_in", "rows_accepted", "rows_quarantined"))))
