"""Market calendar, raw layouts, top lists and stream windows, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantlake.plans.market import SCORED, C, query, scored
from quantlake.sources.bars import DAY, bars, bars_sql, read
from quantlake.sources.layouts import DELIVERY, EQUITY, UNIFIED, normalise
from quantlake.streaming.ingest import windowed

# Expected and observed days

CLOSED = ("01-26", "05-01", "08-15", "10-02", "12-25")


#: The market of these queries rests on a day of every month, so that there are missing days to find.
OPEN = "day(date) <> 13"


def days(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(start, end, F.expr("INTERVAL 1 DAY"))).alias("date")


def expected(day: str) -> Column:
    return (F.weekday(day) < 5) & ~F.date_format(day, "MM-dd").isin(*CLOSED)


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, observed and expected of every day from the first to the last observed one."""
    seen = bars(spark, sf_dir, DAY).where(OPEN).select("date").distinct().withColumn("seen", F.lit(True))
    whole = seen.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(days(C("a"), C("b")))
    return whole.join(seen, "date", "left").select("date", F.coalesce("seen", F.lit(False)).alias("observed"), expected("date").alias("expected"))


OBSERVED = f"""{bars_sql(DAY)}, o AS (SELECT DISTINCT date FROM bars WHERE {OPEN}), a AS (SELECT CAST(unnest(generate_series((SELECT min(date) FROM o), (SELECT max(date) FROM o), INTERVAL 1 DAY)) AS DATE) AS date),
    c AS (SELECT date, date IN (SELECT date FROM o) AS observed, isodow(date) <= 5 AND strftime(date, '%m-%d') NOT IN {CLOSED} AS expected FROM a)"""
query("fn_reconcile", f"{OBSERVED} SELECT date, observed, expected FROM c")(reconciled)
query("set_missing_days", f"{OBSERVED} SELECT date FROM c WHERE expected AND NOT observed")(lambda s, d: reconciled(s, d).where("expected AND NOT observed").select("date"))
query("set_unexpected_days", f"{OBSERVED} SELECT date FROM c WHERE observed AND NOT expected")(lambda s, d: reconciled(s, d).where("observed AND NOT expected").select("date"))
query("set_coverage", f"{OBSERVED} SELECT count(*) FILTER (observed AND expected) * 1.0 / count(*) FILTER (expected) AS coverage FROM c")(
    lambda s, d: reconciled(s, d).agg((F.count_if(C("observed") & C("expected")) / F.nullif(F.count_if("expected"), F.lit(0))).alias("coverage"))
)
query("fn_learn_holidays", f"{OBSERVED} SELECT date FROM c WHERE isodow(date) <= 5 AND NOT observed")(
    lambda s, d: reconciled(s, d).where((F.weekday("date") < 5) & ~C("observed")).select("date")
)

# Layouts: bars written as raw text of each layout, with derivatives and blanks, and read back

BACK = "upper(symbol) AS symbol, 'EQ' AS series, date, open, high, low, close, prev_close, volume"


def as_raw(spark: SparkSession, sf_dir: str, names: dict[str, str]) -> DataFrame:
    rows = bars(spark, sf_dir).withColumn("series", F.lit(" eq ")).withColumn("isin", F.lit(None).cast("string")).withColumn("delivery_pct", F.lit(" - "))
    if "TURNOVER_LACS" in names:
        rows = rows.withColumn("turnover", C("turnover") / 100_000).withColumn("delivery_qty", F.coalesce(C("delivery_qty").cast("string"), F.lit("-")))
    return rows.select("date", *(C(to).cast("string").alias(f" {source} ") for source, to in names.items()))


OUT = ("symbol", "series", "date", "open", "high", "low", "close", "prev_close", "volume", "trades", "delivery_qty")
for _name, _names in {"nrm_legacy_equity": EQUITY, "nrm_legacy_delivery": DELIVERY}.items():
    _delivered = "delivery_qty" if _names is DELIVERY else "CAST(NULL AS BIGINT) AS delivery_qty"
    query(_name, f"{bars_sql()} SELECT {BACK}, trades, {_delivered}, round(turnover, 2) AS turnover FROM bars")(
        lambda s, d, names=_names: normalise(as_raw(s, d, names)).select(*OUT, F.round("turnover", 2).alias("turnover"))
    )
query("nrm_unified", f"{bars_sql()} SELECT {BACK}, trades, CAST(NULL AS BIGINT) AS delivery_qty, round(turnover, 2) AS turnover FROM bars WHERE day(date) % 5 <> 0 AND day(date) % 7 <> 0")(
    lambda s, d: normalise(
        as_raw(s, d, UNIFIED).withColumn("Sgmt", F.when(F.day("date") % 5 == 0, "FO").otherwise("CM ")).withColumn("XpryDt", F.when(F.day("date") % 7 == 0, "2024-01-25").otherwise("-"))
    ).select(*OUT, F.round("turnover", 2).alias("turnover"))
)

# Top lists

query("top_tail_per_group", f"{bars_sql()} SELECT symbol, date, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 5")(
    lambda s, d: bars(s, d).withColumn("r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).where("r <= 5").select("symbol", "date", "close")
)
query("top_screen", f"WITH {SCORED} SELECT doc_id, p FROM s ORDER BY abs(p - 0.5) DESC, doc_id LIMIT 20")(lambda s, d: scored(s, d).orderBy(F.desc(F.abs(C("p") - 0.5)), "doc_id").select("doc_id", "p").limit(20))
query("stream_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")(lambda s, d: windowed(read(s, d, "events")))
