"""Streams as queries: the given tables arrive in several deliveries, each read by a run of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantlake.plans.market import C, query, sql_ema
from quantlake.sources.bars import DAY, bars, bars_sql, read
from quantlake.sources.files import scratch
from quantlake.streaming.state import carried_averages, once, run, sessions

SPANS, GAP_HOURS, LATE_HOURS = (12, 26, 50), 6, 24


def delivered(spark: SparkSession, rows: DataFrame, parts: list[Column], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream has put out after each of ``parts`` (conditions on ``rows``) was delivered and read."""
    source, target, checkpoint = (scratch(spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    for part in parts:
        rows.where(part).write.mode("append").parquet(source)
        run(spark, source, schema, step, target, checkpoint)
    return spark.read.parquet(target)


def stream_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages of the daily bars, which come in three deliveries; the second brings the last days of the first again."""
    rows = bars(spark, sf_dir, DAY).select("symbol", "date", "close")
    parts = [C("date") < "1994-05-17", (C("date") >= "1994-05-10") & (C("date") < "1996-12-31"), C("date") >= "1996-12-31"]
    found = delivered(spark, rows, parts, lambda s: carried_averages(s, SPANS))
    return found.select("symbol", "date", *(F.round(f"ema_{n}", 8).alias(f"trend_ema_{n}") for n in SPANS))


query("stream_ema", f"{bars_sql(DAY)}, t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS t FROM bars) SELECT symbol, date, {', '.join(f'round({sql_ema("close", n)}, 8) AS trend_ema_{n}' for n in SPANS)} FROM t")(stream_ema)


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    parts = [C("ts") < "2024-01-12", (C("ts") >= "2024-01-12") & (C("ts") < "2024-01-20 12:00:00"), C("ts") >= "2024-01-20 12:00:00"]
    found = delivered(spark, rows, parts, lambda s: sessions(s, f"{GAP_HOURS} hours", f"{LATE_HOURS} hours"))
    return found.select("user_id", "start", "finish", "n", F.round("total", 6).alias("total"))


query(
    "stream_sessions",
    f"""WITH e AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events), g AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL {GAP_HOURS} HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e),
    s AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL {GAP_HOURS} HOUR AS finish, count(*) AS n, round(sum(value), 6) AS total FROM g GROUP BY user_id, k)
    SELECT * FROM s WHERE finish <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL {LATE_HOURS} HOUR FROM events)""",
)(stream_sessions)


def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which the last day of each delivery comes again with the next."""
    rows = read(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    parts = [C("ts") < "2024-01-12", (C("ts") >= "2024-01-11") & (C("ts") < "2024-01-21"), C("ts") >= "2024-01-20"]
    found = delivered(spark, rows, parts, once)
    return found.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"), F.round(F.sum("value"), 4).alias("total"))


query("stream_once", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids, round(sum(value), 4) AS total FROM events GROUP BY event_type")(stream_once)
