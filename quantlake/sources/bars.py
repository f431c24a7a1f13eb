"""Canonical bars: one security, one period. Derived here from trade-like tables; raw layouts are in sources/layouts.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: The period of a bar, as date_trunc names it.
WEEK, DAY = "week", "day"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, price, quantity, value, returned and the order of trades, which is total within a period."""
    items = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_returnflag"
    )
    parts = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    place = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return items.join(parts, items["l_partkey"] == parts["p_partkey"]).select(
        "symbol",
        F.col("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("value"),
        (F.col("l_returnflag") == "N").alias("delivered"),
        place.alias("place"),
    )


def from_trades(rows: DataFrame, period: str) -> DataFrame:
    """One shuffle by (symbol, date); open and close by the order of trades. prev_close reuses the symbol's order."""
    bars = rows.groupBy("symbol", F.to_date(F.date_trunc(period, "ts")).alias("date")).agg(
        F.min_by("price", "place").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "place").alias("close"),
        F.sum("quantity").cast("long").alias("volume"),
        F.sum("value").cast("double").alias("turnover"),
        F.count("*").alias("trades"),
        F.sum(F.when(F.col("delivered"), F.col("quantity"))).cast("long").alias("delivery_qty"),
    )
    return bars.withColumn("prev_close", F.lag("close").over(by_symbol()))


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("date")


def bars(spark: SparkSession, sf_dir: str, period: str = WEEK) -> DataFrame:
    return from_trades(trades(spark, sf_dir), period)


def bars_sql(period: str = WEEK) -> str:
    """The same as CTE ``bars``."""
    return f"""WITH tr AS (SELECT p_brand AS symbol, CAST(date_trunc('{period}', l_shipdate) AS DATE) AS date,
        l_extendedprice / l_quantity AS price, l_quantity AS q, CAST(l_extendedprice AS DECIMAL(18,2)) AS v, l_returnflag AS f,
        row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS place
      FROM lineitem JOIN part ON l_partkey = p_partkey),
    b0 AS (SELECT symbol, date, arg_min(price, place) AS open, max(price) AS high, min(price) AS low,
        arg_max(price, place) AS close, CAST(sum(q) AS BIGINT) AS volume, CAST(sum(v) AS DOUBLE) AS turnover,
        count(*) AS trades, CAST(sum(q) FILTER (f = 'N') AS BIGINT) AS delivery_qty FROM tr GROUP BY symbol, date),
    bars AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev_close FROM b0)"""


#: Defects: (which rows, by position t in a symbol's history, column, SQL for the new value); of two for one column the first
#: holds. Fixed so that every rule of the gate has rows that break it, and one gap in prev_close that actions explain.
DEFECTS = (
    ("t % 97 = 5", "low", "high + 1"),
    ("t % 101 = 7", "close", "0.0"),
    ("t % 103 = 9", "volume", "-1"),
    ("t % 107 = 11", "delivery_qty", "volume + 1"),
    ("t % 109 = 13", "turnover", "turnover * 100000"),
    ("symbol = 'Brand#11' AND date = DATE '1996-03-04'", "prev_close", "prev_close * 0.25"),
    ("t % 113 = 17", "prev_close", "prev_close * 0.5"),
    ("t % 127 = 19", "open", "NULL"),
    ("t % 131 = 21", "volume", "volume * 1000"),
    ("t % 137 = 23", "volume", "0"),
    ("t % 139 = 27", "open", "high + 1"),
    *(("t % 151 BETWEEN 40 AND 46", c, "1500e0") for c in ("open", "high", "low", "close")),
)


def dirty_select() -> str:
    """The columns of bars with DEFECTS put in; the same text in both dialects."""
    by_column: dict[str, list[str]] = {}
    for which, column, value in DEFECTS:
        by_column.setdefault(column, []).append(f"WHEN {which} THEN {value}")
    names = "symbol date open high low close volume turnover trades delivery_qty prev_close".split()
    return ", ".join(f"CASE {' '.join(by_column[c])} ELSE {c} END AS {c}" if c in by_column else c for c in names) + ", t"


def dirty_bars(spark: SparkSession, sf_dir: str, period: str = WEEK) -> DataFrame:
    numbered = bars(spark, sf_dir, period).withColumn("t", F.row_number().over(by_symbol()))
    return numbered.selectExpr(*dirty_select().split(", "))


def dirty_sql(period: str = WEEK) -> str:
    return f"""{bars_sql(period)}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS t FROM bars),
    dirty AS (SELECT {dirty_select()} FROM n)"""
