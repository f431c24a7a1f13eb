"""Raw exchange layouts to canonical bars: column names, units and text that is not a number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Source column to canonical column of each layout, and the date of the change of format.
UNIFIED_FROM = "2024-07-08"
EQUITY = {
    "SYMBOL": "symbol", "SERIES": "series", "OPEN": "open", "HIGH": "high", "LOW": "low", "CLOSE": "close",
    "PREVCLOSE": "prev_close", "TOTTRDQTY": "volume", "TOTTRDVAL": "turnover", "TOTALTRADES": "trades", "ISIN": "isin",
}
DELIVERY = {
    "SYMBOL": "symbol", "SERIES": "series", "OPEN_PRICE": "open", "HIGH_PRICE": "high", "LOW_PRICE": "low", "CLOSE_PRICE": "close",
    "PREV_CLOSE": "prev_close", "TTL_TRD_QNTY": "volume", "TURNOVER_LACS": "turnover", "NO_OF_TRADES": "trades",
    "DELIV_QTY": "delivery_qty", "DELIV_PER": "delivery_pct",
}
UNIFIED = {
    "TckrSymb": "symbol", "SctySrs": "series", "OpnPric": "open", "HghPric": "high", "LwPric": "low", "ClsPric": "close",
    "PrvsClsgPric": "prev_close", "TtlTradgVol": "volume", "TtlTrfVal": "turnover", "TtlNbOfTxsExctd": "trades", "ISIN": "isin",
}
LAKH = 100_000
TEXT, WHOLE = ("symbol", "series", "isin"), ("volume", "trades", "delivery_qty")
CANONICAL = ("symbol", "series", "date", "open", "high", "low", "close", "prev_close", "volume", "turnover", "trades", "delivery_qty", "delivery_pct", "isin")


def era(date: Column) -> Column:
    return F.when(date >= F.lit(UNIFIED_FROM).cast("date"), "unified").otherwise("legacy")


def finalise(raw: DataFrame, names: dict[str, str], layout: str) -> DataFrame:
    """Canonical columns in their order: text trimmed and in upper case, numbers or null, a missing volume is 0."""
    if missing := sorted(names.keys() - set(raw.columns)):
        raise ValueError(f"{layout}: columns missing: {missing}; found: {sorted(raw.columns)}")
    by_name = {canonical: F.trim(F.col(source).cast("string")) for source, canonical in names.items()}

    def column(name: str) -> Column:
        if name == "date":
            return F.col("date").cast("date").alias(name)
        value = by_name.get(name, F.lit(None).cast("string"))
        if name in TEXT:
            return F.upper(value).alias(name)
        number = value.try_cast("double")
        if name == "turnover" and layout == "delivery":
            number = number * LAKH
        if name in WHOLE:
            number = number.cast("long")
        return (F.coalesce(number, F.lit(0)) if name == "volume" else number).alias(name)

    return raw.select(*(column(name) for name in CANONICAL))


def normalise(raw: DataFrame) -> DataFrame:
    """Legacy equity, legacy delivery (turnover in lakhs, '-' for none) or unified rows, told by their header, with a date."""
    raw = raw.toDF(*(c if c == "date" else c.strip() for c in raw.columns))
    if "TckrSymb" in raw.columns:
        return finalise(cash_equity(raw), UNIFIED, "unified")
    raw = raw.toDF(*(c if c == "date" else c.upper() for c in raw.columns))
    return finalise(raw, DELIVERY, "delivery") if "TURNOVER_LACS" in raw.columns else finalise(raw, EQUITY, "equity")


def cash_equity(raw: DataFrame) -> DataFrame:
    """Cash rows of a unified file; a test whose column is missing does not apply."""
    said = lambda c: F.upper(F.trim(F.col(c).cast("string")))
    none = lambda c, *more: F.coalesce(said(c), F.lit("")).isin("", "-", *more)
    tests = {"Sgmt": said("Sgmt") == "CM", "FinInstrmTp": said("FinInstrmTp").isin("STK", "EQ", "IDX"), "XpryDt": none("XpryDt"), "OptnTp": none("OptnTp", "XX")}
    for name, test in tests.items():
        raw = raw.where(test) if name in raw.columns else raw
    return raw
