"""Sources and sinks: day files and their addresses, the lake written, corrected and read back, what a run leaves behind."""

from __future__ import annotations

import io
import json
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantlake.plans.calendar import CLOSED
from quantlake.plans.daygate import BOTH, VERDICTS, all_files, judged, reported, verdicts
from quantlake.plans.market import ACTIONS, ADJUSTED_SQL, GATED, C, adjusted, gated, parse_purpose, query
from quantlake.plans.universe import AS_OF, REGISTRY, SCORES, market, registry, universe
from quantlake.sources import lake
from quantlake.sources.bars import DAY, bars, bars_sql
from quantlake.sources.dayfiles import read_days, write_days
from quantlake.sources.files import candidates, decode, delivery_url, equity_url, has_data, put, scratch, unified_url
from quantlake.sources.layouts import era

BASE = "https://archive.example"
#: 28 years later, the days of the market fall into both eras.
LATER, LATER_SQL = "add_months(date, 336)", "CAST(date + INTERVAL 336 MONTH AS DATE)"
DAYS = f"{bars_sql(DAY)}, days AS (SELECT DISTINCT {LATER_SQL} AS date FROM bars)"


def later_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir, DAY).select(F.expr(LATER).alias("date")).distinct()


query("nrm_era", f"{DAYS} SELECT date, CASE WHEN date >= DATE '2024-07-08' THEN 'unified' ELSE 'legacy' END AS era FROM days")(
    lambda s, d: later_days(s, d).select("date", era(C("date")).alias("era"))
)
query("src_candidates", f"{DAYS} SELECT date, CASE WHEN date >= DATE '2024-07-08' THEN 'unified,delivery' ELSE 'delivery,equity' END AS kinds FROM days")(
    lambda s, d: later_days(s, d).select("date", F.array_join(candidates(C("date")), ",").alias("kinds"))
)
_mon = "upper(strftime(date, '%b'))"
for _name, _sql, _f in (
    ("src_url_legacy_eq", f"'{BASE}/content/historical/EQUITIES/' || strftime(date, '%Y') || '/' || {_mon} || '/cm' || strftime(date, '%d') || {_mon} || strftime(date, '%Y') || 'bhav.csv.zip'", equity_url),
    ("src_url_legacy_dlv", f"'{BASE}/products/content/sec_bhavdata_full_' || strftime(date, '%d%m%Y') || '.csv'", delivery_url),
    ("src_url_unified", f"'{BASE}/content/cm/BhavCopy_NSE_CM_0_0_0_' || strftime(date, '%Y%m%d') || '_F_0000.csv.zip'", unified_url),
):
    query(_name, f"{DAYS} SELECT date, {_sql} AS url FROM days")(lambda s, d, f=_f: later_days(s, d).select("date", f(C("date"), BASE).alias("url")))

# Archives: a CSV file of each year, every other one in a zip, with a blank and a literal NA that is no null

TEXT = ["SYMBOL", "DATE", "CLOSE", "NOTE"]


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """year and content of one file a year of the weekly bars."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        year = int(group["year"].iloc[0])
        lines = [" SYMBOL ,DATE,CLOSE,NOTE", *(f"{s},{d},{c},{'NA' if d.day % 2 else ''}" for s, d, c in zip(group["symbol"], group["date"], group["close"], strict=True))]
        content = "\n".join(lines).encode()
        if year % 2:
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("readme.txt", "not this one")
                archive.writestr("day.CSV", content)
            content = held.getvalue()
        return pd.DataFrame({"year": [year], "content": [content]})

    rows = bars(spark, sf_dir).select("symbol", "date", C("close").cast("string").alias("close"), F.year("date").alias("year"))
    return rows.groupBy("year").applyInPandas(pack, "year int, content binary")


query("src_decode_csv", f"{bars_sql()} SELECT symbol, date, round(close, 8) AS close, CASE WHEN day(date) % 2 = 1 THEN 'NA' END AS note, year(date)::INTEGER AS year FROM bars")(
    lambda s, d: decode(archives(s, d), TEXT, ("year",)).select(C("SYMBOL").alias("symbol"), C("DATE").cast("date").alias("date"), F.round(C("CLOSE").try_cast("double"), 8).alias("close"), C("NOTE").alias("note"), "year")
)


def day_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a file of every day's bars, for some days of two kinds; each says what kind it is."""
    folder, rows = scratch(spark, "days"), bars(spark, sf_dir, DAY).select("date", C("symbol").alias("SYMBOL"), C("close").alias("CLOSE"))
    days = rows.select("date").distinct().withColumn("k", (F.row_number().over(Window.orderBy("date")) - 1) % 3)  # one row a day
    kinds = F.when(C("k") == 0, F.array(F.lit("delivery"), F.lit("equity"))).when(C("k") == 1, F.array(F.lit("delivery"))).otherwise(F.array(F.lit("equity")))
    files = rows.join(days.withColumn("kind", F.explode(kinds)).drop("k"), "date").withColumn("KIND_", C("kind"))
    write_days(files, folder, ["SYMBOL", "CLOSE", "KIND_"])
    return folder


def local_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_days(spark, day_folder(spark, sf_dir), daysPerPartition="100")
    return rows.select("date", "kind", C("row")["SYMBOL"].alias("symbol"), F.round(C("row")["CLOSE"].cast("double"), 8).alias("close"), C("row")["KIND_"].alias("said"))


query(
    "src_local_dir",
    f"{bars_sql(DAY)}, n AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k FROM (SELECT DISTINCT date FROM bars)), w AS (SELECT date, CASE WHEN k % 3 = 2 THEN 'equity' ELSE 'delivery' END AS kind FROM n) SELECT date, kind, symbol, round(close, 8) AS close, kind AS said FROM bars JOIN w USING (date)",
)(local_rows)


# Actions and holidays as files


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file of actions, parsed; headers are trimmed and in any case, symbols in any case."""
    rows = spark.read.csv(path, header=True)
    rows = rows.toDF(*(c.strip().lower() for c in rows.columns))
    if missing := {"symbol", "ex_date", "purpose"} - set(rows.columns):
        raise ValueError(f"columns missing: {sorted(missing)}, found: {rows.columns}")
    return parse_purpose(rows.select(F.upper(F.trim("symbol")).alias("symbol"), C("ex_date").cast("date").alias("ex_date"), "purpose"))


HOLIDAYS = {"1993": ["1993-03-08", "1993-11-15"], "1995": ["1995-03-27", "1995-10-24", "1995-12-26"], "1996": ["1996-03-05"]}


def holidays(spark: SparkSession) -> DataFrame:
    """year and date of a JSON file {year: [dates]}."""
    path = f"{scratch(spark, 'holidays')}/holidays.json"
    put(spark, path, json.dumps(HOLIDAYS).encode())
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, array<string>>").alias("m"))
    return rows.select(F.explode("m").alias("year", "dates")).select(C("year").cast("int").alias("year"), F.explode(F.transform("dates", lambda x: x.cast("date"))).alias("date"))


_listed = ", ".join(f"({y}, DATE '{x}')" for y, xs in HOLIDAYS.items() for x in xs)
query(
    "fn_is_holiday",
    f"{bars_sql(DAY)}, h AS (SELECT * FROM (VALUES {_listed}) AS v(year, date)) SELECT DISTINCT date, strftime(date, '%m-%d') IN {CLOSED} OR date IN (SELECT date FROM h) AS holiday, year(date) NOT IN (SELECT year FROM h) AS uncurated FROM bars",
)(
    lambda s, d: (lambda h: bars(s, d, DAY).select("date").distinct().join(h.select("date", F.lit(True).alias("_h")), "date", "left").withColumn("year", F.year("date")).join(h.select("year").distinct().withColumn("_y", F.lit(True)), "year", "left")
    .select("date", (F.date_format("date", "MM-dd").isin(*CLOSED) | C("_h").isNotNull()).alias("holiday"), C("_y").isNull().alias("uncurated")))(holidays(s))
)

# The lake: written by year, corrected, added to by day, read back


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir, DAY).select("symbol", F.lit("EQ").alias("series"), "date", "close", "volume")


def corrected(spark: SparkSession, sf_dir: str) -> str:
    """A lake whose days of June 1995 have been ingested again with other closes."""
    path = scratch(spark, "lake")
    rows = canonical(spark, sf_dir)
    lake.write_years(spark, rows, path)
    lake.write_years(spark, rows.where("date BETWEEN DATE '1995-06-01' AND DATE '1995-06-30'").withColumn("close", C("close") + 1), path)
    return path


WRITTEN = f"{bars_sql(DAY)}, l AS (SELECT symbol, 'EQ' AS series, date, close + CASE WHEN date BETWEEN DATE '1995-06-01' AND DATE '1995-06-30' THEN 1 ELSE 0 END AS close, volume, year(date)::INTEGER AS year FROM bars)"
query("snk_write_year", f"{WRITTEN} SELECT * FROM l")(lambda s, d: s.read.parquet(corrected(s, d)))
query("snk_group_by_year", f"{WRITTEN} SELECT year, count(*) AS n FROM l GROUP BY year")(lambda s, d: s.read.parquet(corrected(s, d)).groupBy("year").agg(F.count("*").alias("n")))
query("fn_by_year", f"{bars_sql(DAY)} SELECT year(date)::INTEGER AS year, min(date) AS first_day, max(date) AS last_day FROM bars GROUP BY 1")(
    lambda s, d: bars(s, d, DAY).groupBy(F.year("date").alias("year")).agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"))
)


def day_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lake of the days before 1998, to which two days are added, one of them twice."""
    path, rows = scratch(spark, "lake"), canonical(spark, sf_dir)
    lake.write_years(spark, rows.where("date < DATE '1998-01-01'"), path)
    for day, more in (("1998-01-05", 0), ("1998-01-06", 5), ("1998-01-06", 0)):
        lake.write_years(spark, rows.where(C("date") == day).withColumn("close", C("close") + more), path)
    return spark.read.parquet(path)


query("snk_append_day", f"{bars_sql(DAY)} SELECT symbol, 'EQ' AS series, date, close, volume, year(date)::INTEGER AS year FROM bars WHERE date < DATE '1998-01-01' OR date IN (DATE '1998-01-05', DATE '1998-01-06')")(day_by_day)
query("set_union_keep_last", f"{WRITTEN} SELECT symbol, series, date, close FROM l")(
    lambda s, d: lake.keep_last(canonical(s, d).withColumn("batch", F.lit(0)).unionByName(canonical(s, d).where("date BETWEEN DATE '1995-06-01' AND DATE '1995-06-30'").withColumns({"close": C("close") + 1, "batch": F.lit(1)}))).select("symbol", "series", "date", "close")
)


def snapshots(spark: SparkSession, rows: DataFrame, again: DataFrame, by: str) -> DataFrame:
    """``rows`` written by partition, then the partitions of ``again`` replaced."""
    path = scratch(spark, "snapshots")
    lake.write_partition(rows, path, by)
    lake.write_partition(again, path, by)
    return spark.read.parquet(path)


query("snk_write_partition", f"{bars_sql()} SELECT symbol, date, close * CASE WHEN year(date) = 1996 THEN 2 ELSE 1 END AS close, year(date)::INTEGER AS as_of FROM bars")(
    lambda s, d: (lambda b: snapshots(s, b, b.where("as_of = 1996").withColumn("close", C("close") * 2), "as_of"))(bars(s, d).select("symbol", "date", "close", F.year("date").alias("as_of")))
)
query("snk_registry", f"{REGISTRY} SELECT symbol, series, status, first_seen, last_seen, delisted_on, DATE '{AS_OF}' AS as_of FROM reg")(
    lambda s, d: (lambda r: snapshots(s, r, r, "as_of"))(registry(market(s, d)).drop("n_days").withColumn("as_of", F.lit(AS_OF).cast("date")))
)
query("snk_universe", f"{SCORES} SELECT as_of, symbol, reason IS NULL AS eligible, reason, score FROM uni")(
    lambda s, d: (lambda r: snapshots(s, r, r, "as_of"))(universe(market(s, d), AS_OF).select("symbol", "eligible", "reason", "score", "as_of"))
)


def universe_at(spark: SparkSession, path: str, as_of: str, strict: bool = True) -> DataFrame:
    """One day's universe from its partition; a day that was never written is an error, not an empty universe."""
    rows = spark.read.parquet(path).where(C("as_of") == F.lit(as_of).cast("date"))
    if strict and rows.isEmpty():
        raise ValueError(f"no universe as of {as_of}")
    return rows


def stored_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "universe")
    lake.write_partition(universe(market(spark, sf_dir), AS_OF).select("symbol", "eligible", "reason", "score", "as_of"), path, "as_of")
    return universe_at(spark, path, AS_OF)


query("src_universe_scan", f"{SCORES} SELECT symbol, reason IS NULL AS eligible, reason, score, as_of FROM uni")(stored_universe)
query("src_eligible", f"{SCORES} SELECT symbol FROM uni WHERE reason IS NULL ORDER BY symbol")(lambda s, d: stored_universe(s, d).where("eligible").select("symbol").orderBy("symbol"))
query("win_pit_symbols", f"{SCORES} SELECT symbol, count(*) AS n FROM m WHERE symbol IN (SELECT symbol FROM uni WHERE reason IS NULL) AND date <= DATE '{AS_OF}' GROUP BY symbol")(
    lambda s, d: market(s, d).where(C("date") <= AS_OF).join(F.broadcast(stored_universe(s, d).where("eligible").select("symbol")), "symbol", "left_semi").groupBy("symbol").agg(F.count("*").alias("n"))
)


def panel_scan(spark: SparkSession, adjusted_path: str, raw_path: str) -> DataFrame:
    """Adjusted bars of ordinary shares by day; where only raw ones are stored, an error rather than prices with jumps."""
    if not has_data(spark, adjusted_path):
        if has_data(spark, raw_path):
            raise ValueError("bars are stored but not adjusted: run the adjustment first")
        return spark.createDataFrame([], "symbol string, series string, date date, close double, year int")
    return spark.read.parquet(adjusted_path).where("series = 'EQ'").orderBy("date", "symbol")


def stored_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "adjusted")
    lake.write_years(spark, adjusted(spark, sf_dir).select("symbol", F.lit("EQ").alias("series"), "date", "close"), path)
    return panel_scan(spark, path, f"{path}-raw").select("symbol", "date", F.round("close", 6).alias("close"))


query("src_panel_scan", f"{ADJUSTED_SQL} SELECT symbol, date, round(close, 6) AS close FROM adj ORDER BY date, symbol")(stored_panel)

# What a run leaves: held rows, reports, the days done, a run's figures, models


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "held")
    held = gated(spark, sf_dir).where("held_by IS NOT NULL").select("symbol", "date", "held_by", F.concat(F.lit("run-"), F.year("date")).alias("run_id"), F.year("date").alias("year"))
    lake.write_partition(held, path, "year")
    return spark.read.parquet(path)


query("snk_quarantine", f"{GATED} SELECT symbol, date, held_by, 'run-' || year(date) AS run_id, year(date)::INTEGER AS year FROM gated WHERE held_by IS NOT NULL")(quarantine)


def stored_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of every file, with its verdict, written by year and read back; files are judged once and kept for both."""
    judged_path, path = scratch(spark, "judged"), scratch(spark, "reports")
    all_files(spark, sf_dir).write.parquet(judged_path)
    files = spark.read.parquet(judged_path)
    lake.write_partition(reported(files).join(judged(files).select("date", "verdict"), "date").withColumn("year", F.year("date")), path, "year")
    return spark.read.parquet(path)


query("snk_quality_report", f"{BOTH} SELECT report.*, verdict, year(date)::INTEGER AS year FROM report JOIN verdicts USING (date)")(stored_report)


def left_to_do(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market days that a table of completed days lacks: where an interrupted run goes on. No table: all of them."""
    path, days = scratch(spark, "done"), bars(spark, sf_dir, DAY).select("date").distinct()
    days.where("date < DATE '1996-01-01'").write.parquet(path)
    done = spark.read.parquet(path) if has_data(spark, path) else days.limit(0)
    return days.join(done, "date", "left_anti")


query("snk_resume_state", f"{bars_sql(DAY)} SELECT DISTINCT date FROM bars WHERE date >= DATE '1996-01-01'")(left_to_do)


def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's figures as JSON, written whatever its outcome, and read back."""
    path = scratch(spark, "run")
    totals = verdicts(spark, sf_dir).agg(*(F.sum(x).alias(x) for x in ("rows_in", "rows_accepted", "rows_quarantined")), F.count("*").alias("files"))
    totals.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return spark.read.schema("rows_in long, rows_accepted long, rows_quarantined long, files long").json(path)


query("snk_run_report", f"{VERDICTS} SELECT sum(rows_in)::BIGINT AS rows_in, sum(rows_accepted)::BIGINT AS rows_accepted, sum(rows_quarantined)::BIGINT AS rows_quarantined, count(*) AS files FROM verdicts")(run_report)

# The last day-frames of a run beside the lake: context for rules that look back


def recent(stored: DataFrame, buffered: DataFrame, days: int = 20) -> DataFrame:
    """``stored`` days and those not yet written, the last ``days`` of them; a day that is in both is read from the buffer."""
    both = stored.join(buffered.select("date").distinct(), "date", "left_anti").unionByName(buffered)
    last = both.select("date").distinct().withColumn("_r", F.row_number().over(Window.orderBy(F.desc("date")))).where(C("_r") <= days)
    return both.join(F.broadcast(last.select("date")), "date", "left_semi")


query(
    "set_recent_buffer",
    f"{bars_sql(DAY)}, b AS (SELECT symbol, date, close + CASE WHEN date >= DATE '1998-06-01' THEN 1 ELSE 0 END AS close FROM bars) SELECT symbol, date, close FROM b WHERE date IN (SELECT DISTINCT date FROM b ORDER BY date DESC LIMIT 20)",
)(lambda s, d: (lambda b: recent(b.where("date < DATE '1998-07-01'"), b.where("date >= DATE '1998-06-01'").withColumn("close", C("close") + 1)))(bars(s, d, DAY).select("symbol", "date", "close")))

# The registry of runs: appended, the newest row of a run holds

RUNS = "runs AS (SELECT doc_id % 40 AS run_id, 'T' || (doc_id % 3) AS ticker, (doc_id * 37) % 100 / 100.0 AS sharpe, doc_id AS logged FROM labels), newest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY logged DESC) = 1)"
METRICS = ("sharpe",)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").select((C("doc_id") % 40).alias("run_id"), F.concat(F.lit("T"), (C("doc_id") % 3).cast("string")).alias("ticker"), (C("doc_id") * 37 % 100 / 100.0).alias("sharpe"), C("doc_id").alias("logged"))
    return lake.keep_last(rows.withColumn("batch", C("logged")), ("run_id",))


def best_run(rows: DataFrame, metric: str) -> DataFrame:
    if metric not in METRICS:
        raise ValueError(f"no such metric: {metric}")
    return rows.orderBy(F.desc(metric), "run_id").limit(1)


query("top_best_run", f"WITH {RUNS} SELECT run_id, ticker, sharpe FROM newest ORDER BY sharpe DESC, run_id LIMIT 1")(lambda s, d: best_run(runs(s, d), "sharpe").select("run_id", "ticker", "sharpe"))
query("top_list_runs", f"WITH {RUNS} SELECT run_id, ticker, logged FROM newest WHERE ticker = 'T1' ORDER BY logged DESC LIMIT 20")(
    lambda s, d: runs(s, d).where("ticker = 'T1'").orderBy(F.desc("logged")).select("run_id", "ticker", "logged").limit(20)
)
