"""Small functions of a column, the joins of a day with what came before, and layouts by their header. The SQL is written apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantlake.plans.calendar import CLOSED, as_raw, days, expected
from quantlake.plans.market import GATED, SCORED, C, accepted, history, query, scored
from quantlake.plans.serving import direction
from quantlake.plans.store import LATER, LATER_SQL
from quantlake.plans.universe import MARKET, clean, market, saturating
from quantlake.sources.bars import DAY, bars, bars_sql, by_symbol
from quantlake.sources.layouts import EQUITY, cash_equity, normalise

# Series that have a meaning of their own.
SERIES = ("EQ", "BE", "BZ", "SM", "ST")

# Days

ALL_DAYS = f"{bars_sql(DAY)}, r AS (SELECT min(date) AS a, max(date) AS b FROM bars), d AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM r)"


def all_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir, DAY).agg(F.min("date").alias("a"), F.max("date").alias("b")).select(days(C("a"), C("b")))


query("fn_daterange", f"{ALL_DAYS} SELECT date FROM d")(all_days)
query("fn_is_weekend", f"{ALL_DAYS} SELECT date, isodow(date) IN (6, 7) AS weekend FROM d")(lambda s, d: all_days(s, d).select("date", (F.weekday("date") >= 5).alias("weekend")))
query("fn_expected_day", f"{ALL_DAYS} SELECT date, isodow(date) NOT IN (6, 7) AND strftime(date, '%m-%d') NOT IN {CLOSED} AS expected FROM d")(lambda s, d: all_days(s, d).select("date", expected("date").alias("expected")))


def expected_range(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Expected market days from ``start`` to ``end``, both included."""
    if start > end:
        raise ValueError(f"{start} is after {end}")
    return spark.range(1).select(days(F.lit(start).cast("date"), F.lit(end).cast("date"))).where(expected("date"))


query("nrm_as_date", f"{bars_sql(DAY)}, x AS (SELECT DISTINCT {LATER_SQL} AS date FROM bars) SELECT date, CAST(date AS VARCHAR) || ' 09:15:00' AS said, date AS read FROM x")(
    lambda s, d: bars(s, d, DAY).select(F.expr(LATER).alias("date")).distinct().withColumn("said", F.concat(C("date").cast("string"), F.lit(" 09:15:00"))).withColumn("read", F.to_date(C("said").try_cast("timestamp")))
)

# Text and types


def series(code: Column) -> Column:
    """A series code in upper case if it is known, else OTHER."""
    said = F.upper(F.trim(code))
    return F.when(said.isin(*SERIES), said).otherwise("OTHER")


CODES = "CASE t % 7 WHEN 0 THEN ' eq ' WHEN 1 THEN 'BE' WHEN 2 THEN 'n1' WHEN 3 THEN 'st' WHEN 4 THEN NULL WHEN 5 THEN '' ELSE 'BZ' END"
NUMBERED = f"{bars_sql()}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS t FROM bars)"


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).withColumn("t", F.row_number().over(by_symbol()))


query("nrm_series_coerce", f"{NUMBERED} SELECT symbol, date, CASE t % 7 WHEN 0 THEN 'EQ' WHEN 1 THEN 'BE' WHEN 3 THEN 'ST' WHEN 6 THEN 'BZ' ELSE 'OTHER' END AS series FROM n")(
    lambda s, d: numbered(s, d).select("symbol", "date", series(F.expr(CODES)).alias("series"))
)
SPOILT = "CASE WHEN t % 5 = 0 THEN 'n/a' WHEN t % 7 = 0 THEN ' ' ELSE CAST(volume AS STRING) END"
query("fn_cast_dtypes", f"{NUMBERED} SELECT symbol, date, CASE WHEN t % 5 <> 0 AND t % 7 <> 0 THEN CAST(volume AS DOUBLE) END AS volume FROM n")(
    lambda s, d: numbered(s, d).select("symbol", "date", F.expr(SPOILT).try_cast("double").alias("volume"))
)
query("nrm_cash_filter", f"{bars_sql()} SELECT symbol, date FROM bars WHERE day(date) % 5 <> 0 AND day(date) % 7 <> 0 AND day(date) % 11 <> 0 AND day(date) % 13 <> 0")(
    lambda s, d: cash_equity(
        bars(s, d).withColumns({
            "Sgmt": F.when(F.day("date") % 5 == 0, "FO").otherwise("cm "), "FinInstrmTp": F.when(F.day("date") % 11 == 0, "OPT").otherwise("STK"),
            "XpryDt": F.when(F.day("date") % 7 == 0, "2024-01-25").otherwise("-"), "OptnTp": F.when(F.day("date") % 13 == 0, "CE").otherwise("XX"),
        })
    ).select("symbol", "date")
)
query("nrm_finalise", f"{bars_sql()} SELECT upper(symbol) AS symbol, 'EQ' AS series, date, volume, CAST(NULL AS DOUBLE) AS delivery_pct, round(turnover, 2) AS turnover FROM bars")(
    lambda s, d: normalise(as_raw(s, d, EQUITY)).select("symbol", "series", "date", "volume", "delivery_pct", F.round("turnover", 2).alias("turnover"))
)
query("fn_arrow", f"{bars_sql(DAY)} SELECT symbol, date, CASE WHEN close > open THEN '▲' ELSE '▼' END AS arrow FROM bars")(
    lambda s, d: bars(s, d, DAY).select("symbol", "date", F.when(C("close") > C("open"), "▲").otherwise("▼").alias("arrow"))
)
query("fn_direction", f"{bars_sql(DAY)} SELECT symbol, date, CASE WHEN close / prev_close - 1 > 0.01 THEN 'up' WHEN close / prev_close - 1 < -0.01 THEN 'down' ELSE 'flat' END AS direction FROM bars")(
    lambda s, d: bars(s, d, DAY).select("symbol", "date", direction(C("close") / C("prev_close") - 1, 0.01).alias("direction"))
)

# Amounts in Indian grouping: 12,34,567.00, and in crore (cr), lakh (L) and thousand (k)


def rupees(x: Column, digits: int = 2) -> Column:
    plain = F.format_string(f"%.{digits}f", F.abs(x))
    whole = F.regexp_replace(F.substring_index(plain, ".", 1), r"(\d)(?=(\d\d)+\d$)", "$1,")
    return F.concat(F.when(x < 0, "-").otherwise(""), whole, F.concat(F.lit("."), F.substring_index(plain, ".", -1)) if digits else F.lit(""))


def compact_rupees(x: Column) -> Column:
    return F.when(F.abs(x) >= 1e7, F.format_string("₹%.2fcr", x / 1e7)).when(F.abs(x) >= 1e5, F.format_string("₹%.2fL", x / 1e5)).otherwise(F.concat(F.lit("₹"), rupees(x, 0)))


def compact_volume(x: Column) -> Column:
    out = F.when(F.abs(x) >= 1e7, F.format_string("%.2fcr", x / 1e7)).when(F.abs(x) >= 1e5, F.format_string("%.2fL", x / 1e5))
    return out.when(F.abs(x) >= 1e3, F.format_string("%.1fk", x / 1e3)).otherwise(F.round(x).cast("long").cast("string"))


#: Amounts of all sizes whose shown digits are no halves.
AMOUNTS = "CAST(doc_id * doc_id * 1013 % 900000007 AS DOUBLE) + 0.27"
_w, _a = "(w // 1000)", "doc_id, CAST(x AS BIGINT) AS w, x"
query(
    "fn_inr",
    f"""WITH a AS (SELECT doc_id, {AMOUNTS} AS x FROM labels), b AS (SELECT doc_id, x, CAST(floor(x) AS BIGINT) AS w FROM a)
    SELECT doc_id, CASE WHEN w < 1000 THEN CAST(w AS VARCHAR) WHEN {_w} < 100 THEN format('{{}},{{:03d}}', {_w}, w % 1000) WHEN {_w} < 10000 THEN format('{{}},{{:02d}},{{:03d}}', {_w} // 100, {_w} % 100, w % 1000) ELSE format('{{}},{{:02d}},{{:02d}},{{:03d}}', {_w} // 10000, {_w} // 100 % 100, {_w} % 100, w % 1000) END || '.27' AS inr,
      CASE WHEN x >= 1e7 THEN format('₹{{:.2f}}cr', x / 1e7) WHEN x >= 1e5 THEN format('₹{{:.2f}}L', x / 1e5) WHEN w < 1000 THEN '₹' || w ELSE format('₹{{}},{{:03d}}', {_w}, w % 1000) END AS compact,
      CASE WHEN x >= 1e7 THEN format('{{:.2f}}cr', x / 1e7) WHEN x >= 1e5 THEN format('{{:.2f}}L', x / 1e5) WHEN x >= 1e3 THEN format('{{:.1f}}k', x / 1e3) ELSE CAST(w AS VARCHAR) END AS volume FROM b""",
)(lambda s, d: s.read.parquet(f"{d}/labels.parquet").select("doc_id", F.expr(AMOUNTS.replace("0.27", "0.27e0")).alias("x")).select("doc_id", rupees(C("x")).alias("inr"), compact_rupees(C("x")).alias("compact"), compact_volume(C("x")).alias("volume")))

# Scores of one figure

query("fn_saturating", f"WITH {SCORED} SELECT doc_id, least(1, greatest(0, (p - 0.2) / 0.5)) AS share, 0.0 AS none FROM s")(
    lambda s, d: scored(s, d).select("doc_id", saturating(C("p") - 0.2, F.lit(0.5)).alias("share"), saturating(C("p"), F.lit(0)).alias("none"))
)
query("fn_clean_rate", f"WITH {SCORED} SELECT doc_id, greatest(0, 1 - (doc_id % 30) / 20.0) AS rate FROM s")(lambda s, d: scored(s, d).select("doc_id", clean(C("doc_id") % 30, F.lit(20)).alias("rate")))
query("fn_recency", f"WITH {SCORED} SELECT doc_id, CASE WHEN doc_id % 30 >= 20 THEN 0 ELSE 1 - (doc_id % 30) / 20.0 END AS recency FROM s")(
    lambda s, d: scored(s, d).select("doc_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - C("doc_id") % 30 / 20)).alias("recency"))
)


def gap_days(rows: DataFrame) -> DataFrame:
    """Market days after each symbol's last one; one row for each market day gives their places."""
    places = rows.select("date").distinct().withColumn("place", F.row_number().over(Window.orderBy("date")))
    last = rows.groupBy("symbol").agg(F.max("date").alias("date")).join(places, "date")
    return last.join(F.broadcast(places.agg(F.max("place").alias("last"))), how="cross").select("symbol", (C("last") - C("place")).alias("gap"))


query("agg_gap_days", f"{MARKET} SELECT symbol, (SELECT count(DISTINCT date) FROM m WHERE date > l) AS gap FROM (SELECT symbol, max(date) AS l FROM m GROUP BY symbol) AS s")(lambda s, d: gap_days(market(s, d)))

# A day's rows with what came before: the last close, the spread of returns, the usual volume, another feed

H = "OVER (PARTITION BY symbol ORDER BY date RANGE BETWEEN INTERVAL 120 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)"
query("join_prior_close", f"{GATED} SELECT symbol, date, prev_close, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prior FROM ok QUALIFY prior IS NOT NULL")(
    lambda s, d: accepted(s, d).select("symbol", "date", "prev_close", F.lag("close").over(by_symbol()).alias("prior")).where("prior IS NOT NULL")
)
query("join_sigma", f"{GATED}, r AS (SELECT symbol, date, ln(close / prev_close) AS r FROM ok) SELECT symbol, date, round(stddev_samp(r) {H}, 8) AS sigma FROM r")(
    lambda s, d: accepted(s, d).withColumn("r", F.ln(C("close") / C("prev_close"))).select("symbol", "date", F.round(F.stddev_samp("r").over(history()), 8).alias("sigma"))
)
query("join_median_volume", f"{GATED} SELECT symbol, date, median(volume) {H} AS usual FROM ok")(lambda s, d: accepted(s, d).select("symbol", "date", F.percentile("volume", F.lit(0.5)).over(history()).alias("usual")))
query("join_cross_source", f"{NUMBERED}, o AS (SELECT symbol, date, close * (1 + (t % 3) / 100.0) AS other FROM n WHERE t % 4 <> 0) SELECT symbol, date, round(abs(close - other) / other * 100, 6) AS apart FROM bars JOIN o USING (symbol, date)")(
    lambda s, d: (lambda n: n.join(n.where("t % 4 <> 0").select("symbol", "date", (C("close") * (1 + C("t") % 3 / 100)).alias("other")), ["symbol", "date"]))(numbered(s, d))
    .select("symbol", "date", F.round(F.abs(C("close") - C("other")) / C("other") * 100, 6).alias("apart"))
)
