"""Who could be traded on a day: registry, scores, eligibility with its reason, and the screens made of them.

Everything is computed from bars up to the day asked for. The SQL is written apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantlake.plans.calendar import OBSERVED, OPEN, reconciled
from quantlake.plans.market import C, query
from quantlake.sources.bars import DAY, bars, bars_sql, by_symbol

# Window, silence, floors, ceilings, weights and texts.
WINDOW, SILENCE = 1890, 60
LEAST_DAYS, LEAST_RECENCY, LEAST_TURNOVER, LEAST_SCORE = 756, 0.5, 1e7, 0.85
FULL_DAYS, FULL_TURNOVER, GAP, TOLERANCE = 1260, 5e8, 20, 0.005
WEIGHTS = {"completeness": 0.25, "validity": 0.20, "continuity": 0.30, "liquidity": 0.15, "recency": 0.10}
GROUPS = {
    "has not traded recently": "Delisted or suspended",
    "trading days of history": "Insufficient history",
    "data quality score": "Quality score below floor",
    "liquidity floor": "Below the liquidity floor",
}
AS_OF = "1998-06-30"

#: The market with symbols that stop, start late, trade little or have bad bars: 5,000 times the turnover, but 50 times for those
#: that end in 3; those that end in 1 stop in 1996, in 2 start in 1997; every other high of those that end in 4 is below the low.
LISTED = "NOT (symbol LIKE '%1' AND date > DATE '1996-12-31') AND NOT (symbol LIKE '%2' AND date < DATE '1997-01-01')"
TRADED = "turnover * CASE WHEN symbol LIKE '%3' THEN 50 ELSE 5000 END"
MISPRINTED = "CASE WHEN symbol LIKE '%4' AND day(date) % 2 = 0 THEN low - 1 ELSE high END"


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir, DAY).where(LISTED).withColumns({"turnover": F.expr(TRADED), "high": F.expr(MISPRINTED), "series": F.lit("EQ")})


MARKET = f"{bars_sql(DAY)}, m AS (SELECT * REPLACE ({TRADED} AS turnover, {MISPRINTED} AS high) FROM bars WHERE {LISTED})"


def registry(rows: DataFrame, as_of: Column | None = None) -> DataFrame:
    """One row a symbol: first and last day, status, and when it left, if it has been silent for SILENCE days before ``as_of``
    (the last day of the market by default)."""
    spans = rows.groupBy("symbol").agg(F.max_by("series", "date").alias("series"), F.min("date").alias("first_seen"), F.max("date").alias("last_seen"), F.count("*").alias("n_days"))
    day = F.max("last_seen").over(Window.partitionBy()) if as_of is None else as_of
    gone = C("last_seen") < F.date_sub(day, SILENCE)
    return spans.select("symbol", "series", F.when(gone, "delisted").otherwise("listed").alias("status"), "first_seen", "last_seen", F.when(gone, C("last_seen")).alias("delisted_on"), "n_days")


REGISTRY = f"""{MARKET}, s AS (SELECT symbol, 'EQ' AS series, min(date) AS first_seen, max(date) AS last_seen, count(*) AS n_days FROM m GROUP BY symbol),
    reg AS (SELECT symbol, series, CASE WHEN last_seen < (SELECT max(date) FROM m) - {SILENCE} THEN 'delisted' ELSE 'listed' END AS status, first_seen, last_seen,
      CASE WHEN last_seen < (SELECT max(date) FROM m) - {SILENCE} THEN last_seen END AS delisted_on, n_days FROM s)"""
query("agg_registry", f"{REGISTRY} SELECT * FROM reg")(lambda s, d: registry(market(s, d)))
query("agg_delisted", f"{REGISTRY} SELECT symbol, delisted_on FROM reg WHERE status = 'delisted' ORDER BY symbol")(
    lambda s, d: registry(market(s, d)).where("status = 'delisted'").select("symbol", "delisted_on").orderBy("symbol")
)


def clean(bad: Column, n: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - bad / n)


def saturating(x: Column, ceiling: Column) -> Column:
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x / F.nullif(ceiling.cast("double"), F.lit(0.0)))), F.lit(0.0))


def scores(rows: DataFrame, as_of: str) -> DataFrame:
    """Quality of every symbol over the WINDOW days up to ``as_of``. Places of days come from one row for each market day."""
    rows = rows.where((C("series") == "EQ") & C("date").between(F.date_sub(F.lit(as_of).cast("date"), WINDOW), F.lit(as_of).cast("date")))
    days = rows.select("date").distinct().withColumn("place", F.row_number().over(Window.orderBy("date")))
    rows = rows.withColumn("prior", F.lag("close").over(by_symbol())).join(days.withColumn("days", F.count("*").over(Window.partitionBy())), "date")
    bad = F.count_if((C("high") < C("low")) | (C("close") <= 0))
    breaks = F.count_if(F.abs(C("prev_close") / C("prior") - 1) > TOLERANCE)
    out = rows.groupBy("symbol").agg(
        F.count("*").alias("history_days"), F.max("date").alias("last_seen"), F.median("turnover").alias("median_turnover"),
        bad.alias("bad"), breaks.alias("breaks"), (F.max("days") - F.max("place")).alias("gap"), F.max("days").alias("days"),
    )
    n = C("history_days")
    parts = {
        "completeness": saturating(n, F.least("days", F.lit(FULL_DAYS))), "validity": clean(C("bad"), n), "continuity": clean(C("breaks"), n),
        "liquidity": saturating(C("median_turnover"), F.lit(FULL_TURNOVER)), "recency": F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - C("gap") / GAP)),
    }
    out = out.withColumns(parts)
    return out.withColumn("score", F.round(sum((C(k) * w for k, w in WEIGHTS.items()), F.lit(0.0)), 6))


def universe(rows: DataFrame, as_of: str) -> DataFrame:
    """scores() with as_of, eligible and the reason of a refusal: the most specific floor that was missed."""
    reason = (
        F.when(C("history_days") < LEAST_DAYS, F.format_string(f"only %d trading days of history (need {LEAST_DAYS})", "history_days"))
        .when(C("recency") < LEAST_RECENCY, "has not traded recently — the listing looks delisted or suspended")
        .when(C("median_turnover") < LEAST_TURNOVER, F.concat(F.lit("median daily turnover Rs "), F.format_number("median_turnover", 0), F.lit(f" is below the Rs {LEAST_TURNOVER:,.0f} liquidity floor")))
        .when(C("score") < LEAST_SCORE, F.format_string(f"data quality score %.2f is below {LEAST_SCORE:.2f}", "score"))
    )
    return scores(rows, as_of).withColumns({"as_of": F.lit(as_of).cast("date"), "reason": reason}).withColumn("eligible", C("reason").isNull())


SCORES = f"""{MARKET}, w AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prior, dense_rank() OVER (ORDER BY date) AS place FROM m WHERE date BETWEEN DATE '{AS_OF}' - {WINDOW} AND DATE '{AS_OF}'),
    a AS (SELECT symbol, count(*) AS history_days, max(date) AS last_seen, median(turnover) AS median_turnover, count(*) FILTER (high < low OR close <= 0) AS bad,
      count(*) FILTER (abs(prev_close / prior - 1) > {TOLERANCE}) AS breaks, (SELECT max(place) FROM w) - max(place) AS gap, (SELECT max(place) FROM w) AS days FROM w GROUP BY symbol),
    q AS (SELECT *, least(1.0, history_days / CAST(least(days, {FULL_DAYS}) AS DOUBLE)) AS completeness, greatest(0.0, 1 - bad / CAST(history_days AS DOUBLE)) AS validity, greatest(0.0, 1 - breaks / CAST(history_days AS DOUBLE)) AS continuity,
      least(1.0, median_turnover / {FULL_TURNOVER!r}) AS liquidity, greatest(0.0, least(1.0, 1 - gap / {GAP}.0)) AS recency FROM a),
    sc AS (SELECT *, round({" + ".join(f"{w} * {k}" for k, w in WEIGHTS.items())}, 6) AS score FROM q),
    uni AS (SELECT *, DATE '{AS_OF}' AS as_of, CASE WHEN history_days < {LEAST_DAYS} THEN 'only ' || history_days || ' trading days of history (need {LEAST_DAYS})' WHEN recency < {LEAST_RECENCY} THEN 'has not traded recently — the listing looks delisted or suspended'
      WHEN median_turnover < {LEAST_TURNOVER!r} THEN format('median daily turnover Rs {{:,}} is below the Rs {LEAST_TURNOVER:,.0f} liquidity floor', CAST(round_even(median_turnover, 0) AS BIGINT)) WHEN score < {LEAST_SCORE} THEN format('data quality score {{:.2f}} is below {LEAST_SCORE:.2f}', score) END AS reason FROM sc)"""
_parts = ", ".join(f"round({k}, 6) AS {k}" for k in WEIGHTS)
query("agg_quality_score", f"{SCORES} SELECT symbol, history_days, last_seen, round(median_turnover, 2) AS median_turnover, {_parts}, score FROM sc")(
    lambda s, d: scores(market(s, d), AS_OF).select("symbol", "history_days", "last_seen", F.round("median_turnover", 2).alias("median_turnover"), *(F.round(k, 6).alias(k) for k in WEIGHTS), "score")
)
query("agg_universe_as_of", f"{SCORES} SELECT as_of, symbol, reason IS NULL AS eligible, reason, score FROM uni")(lambda s, d: universe(market(s, d), AS_OF).select("as_of", "symbol", "eligible", "reason", "score"))
query("gate_eligibility", f"{SCORES} SELECT symbol, reason IS NULL AS eligible, reason FROM uni")(lambda s, d: universe(market(s, d), AS_OF).select("symbol", "eligible", "reason"))
query("agg_universe", f"{SCORES} SELECT as_of, count(*) AS seen, count(*) FILTER (reason IS NULL) AS eligible, array_to_string(list_sort(list(symbol) FILTER (reason IS NULL)), ',') AS symbols FROM uni GROUP BY as_of")(
    lambda s, d: universe(market(s, d), AS_OF).groupBy("as_of").agg(F.count("*").alias("seen"), F.count_if("eligible").alias("eligible"), F.array_join(F.sort_array(F.collect_set(F.when(C("eligible"), C("symbol")))), ",").alias("symbols"))
)
query("top_universe_cap", f"{SCORES} SELECT symbol FROM uni WHERE reason IS NULL ORDER BY symbol LIMIT 10")(lambda s, d: universe(market(s, d), AS_OF).where("eligible").select("symbol").orderBy("symbol").limit(10))


def group_of(reason: Column) -> Column:
    out = F.lit("Other")
    for needle, label in reversed(GROUPS.items()):
        out = F.when(reason.contains(needle), label).otherwise(out)
    return out


def exclusion_groups(rows: DataFrame) -> DataFrame:
    """Refusals of universe() by group, most first, with up to three examples."""
    groups = rows.where("NOT eligible").groupBy(group_of(C("reason")).alias("reason"))
    out = groups.agg(F.count("*").alias("n"), F.array_join(F.slice(F.sort_array(F.collect_set("symbol")), 1, 3), ",").alias("examples"))
    return out.orderBy(F.desc("n"), "reason")


GROUP_SQL = "CASE " + " ".join(f"WHEN contains(reason, '{k}') THEN '{v}'" for k, v in GROUPS.items()) + " ELSE 'Other' END"
query("agg_exclusion_groups", f"{SCORES} SELECT {GROUP_SQL} AS reason, count(*) AS n, array_to_string(list_sort(list(symbol))[1:3], ',') AS examples FROM uni WHERE reason IS NOT NULL GROUP BY 1 ORDER BY n DESC, reason")(
    lambda s, d: exclusion_groups(universe(market(s, d), AS_OF))
)
query(
    "cmp_universe_detail",
    f"{SCORES} SELECT DATE '{AS_OF}' AS as_of, count(*) AS seen, count(*) FILTER (reason IS NULL) AS eligible, count(reason) AS excluded, round(count(*) FILTER (reason IS NULL) / count(*), 6) AS ratio, count(DISTINCT CASE WHEN reason IS NOT NULL THEN {GROUP_SQL} END) AS groups FROM uni",
)(
    lambda s, d: universe(market(s, d), AS_OF).agg(
        F.lit(AS_OF).cast("date").alias("as_of"), F.count("*").alias("seen"), F.count_if("eligible").alias("eligible"), F.count("reason").alias("excluded"),
        F.round(F.count_if("eligible") / F.count("*"), 6).alias("ratio"), F.countDistinct(F.when(C("reason").isNotNull(), group_of(C("reason")))).alias("groups"),
    )
)


def search(rows: DataFrame, text: str, limit: int = 12, others: int = 3) -> DataFrame:
    """Eligible symbols that match, those that begin with ``text`` first, and up to ``others`` that are refused, with the reason."""
    wanted = text.strip().upper()
    tier = F.when(C("symbol").startswith(wanted), 0).when(C("symbol").contains(wanted), 1)
    found = rows.withColumn("symbol", F.upper("symbol")).withColumn("tier", tier).where("tier IS NOT NULL").select("symbol", "eligible", "tier", "reason")
    first = lambda which, n: found.where(C("eligible") == which).orderBy("tier", "symbol").limit(n)
    return first(True, limit).unionByName(first(False, others))


query(
    "top_search",
    f"""{SCORES}, u AS (SELECT upper(symbol) AS symbol, reason IS NULL AS eligible, CASE WHEN starts_with(upper(symbol), 'BRAND#3') THEN 0 ELSE 1 END AS tier, reason FROM uni WHERE contains(upper(symbol), '3'))
    SELECT * FROM (SELECT symbol, eligible, 1 AS tier, reason FROM u WHERE eligible ORDER BY symbol LIMIT 12) UNION ALL SELECT * FROM (SELECT symbol, eligible, 1, reason FROM u WHERE NOT eligible ORDER BY symbol LIMIT 3)""",
)(lambda s, d: search(universe(market(s, d), AS_OF), " 3"))

# Screens: rows that join what the parts say


def chain_rail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days, coverage and eligible share, as the rail on every screen shows them."""
    days = bars(spark, sf_dir, DAY).where(OPEN).agg(F.countDistinct("date").alias("trading_days"), F.max("date").alias("last_date"))
    gate = reconciled(spark, sf_dir).agg(
        F.count_if(C("observed") & C("expected")).alias("hits"), F.count_if("expected").alias("expected"), F.count_if(C("expected") & ~C("observed")).alias("missing"),
    )
    uni = universe(market(spark, sf_dir), AS_OF).agg(F.count("*").alias("seen"), F.count_if("eligible").alias("eligible"))
    one = days.join(F.broadcast(gate), how="cross").join(F.broadcast(uni), how="cross")  # one row each
    return one.select("trading_days", "last_date", F.round(width(C("hits") / C("expected")), 4).alias("gate_fill"), "missing", "seen", "eligible", F.round(width(C("eligible") / C("seen")), 4).alias("universe_fill"))


def width(share: Column) -> Column:
    """A share as 0 to 100, 0 for null."""
    return F.coalesce(F.least(F.lit(100.0), F.greatest(F.lit(0.0), share * 100)), F.lit(0.0))


query(
    "cmp_chain",
    f"""{SCORES}, {OBSERVED.removeprefix(bars_sql(DAY) + ", ").replace("a AS (", "all_days AS (").replace("FROM a)", "FROM all_days)")}
    SELECT (SELECT count(*) FROM o) AS trading_days, (SELECT max(date) FROM o) AS last_date, (SELECT round(100.0 * count(*) FILTER (observed AND expected) / count(*) FILTER (expected), 4) FROM c) AS gate_fill,
      (SELECT count(*) FROM c WHERE expected AND NOT observed) AS missing, count(*) AS seen, count(*) FILTER (reason IS NULL) AS eligible, round(100.0 * count(*) FILTER (reason IS NULL) / count(*), 4) AS universe_fill FROM uni""",
)(chain_rail)
query("fn_pct_width", f"{SCORES} SELECT symbol, round(least(100, greatest(0, 100 * (score * 2 - 0.9))), 4) AS width FROM uni")(
    lambda s, d: scores(market(s, d), AS_OF).select("symbol", F.round(width(C("score") * 2 - 0.9), 4).alias("width"))
)
query(
    "cmp_gate",
    f"{OBSERVED} SELECT count(*) FILTER (observed) AS observed, count(*) FILTER (expected) AS expected, count(*) FILTER (expected AND NOT observed) AS missing, count(*) FILTER (observed AND NOT expected) AS unexpected, count(DISTINCT year(date)) AS uncurated_years, min(date) FILTER (observed) AS first_date, max(date) FILTER (observed) AS last_date FROM c",
)(
    lambda s, d: reconciled(s, d).agg(
        F.count_if("observed").alias("observed"), F.count_if("expected").alias("expected"), F.count_if(C("expected") & ~C("observed")).alias("missing"), F.count_if(C("observed") & ~C("expected")).alias("unexpected"),
        F.countDistinct(F.year("date")).alias("uncurated_years"), F.min(F.when(C("observed"), C("date"))).alias("first_date"), F.max(F.when(C("observed"), C("date"))).alias("last_date"),
    )
)
LABELS = {"completeness": "History completeness", "validity": "Validity clean rate", "continuity": "Continuity clean rate", "liquidity": "Liquidity adequacy", "recency": "Recency"}


def provenance(rows: DataFrame, as_of: str) -> DataFrame:
    """A row for each symbol and part of its score, in the order of the weights, with its listing."""
    parts = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(label).alias("label"), F.round(k, 6).alias("value")) for i, (k, label) in enumerate(LABELS.items())))
    out = scores(rows, as_of).select("symbol", F.explode(parts).alias("p")).select("symbol", "p.*")
    return out.join(registry(rows).select("symbol", "status", "first_seen"), "symbol", "left")


query(
    "cmp_provenance",
    f"{SCORES}, {REGISTRY.removeprefix(MARKET + ', ')}, p AS ({' UNION ALL '.join(f'SELECT symbol, {i} AS place, {chr(39)}{label}{chr(39)} AS label, round({k}, 6) AS value FROM sc' for i, (k, label) in enumerate(LABELS.items()))}) SELECT p.*, status, first_seen FROM p JOIN reg USING (symbol)",
)(lambda s, d: provenance(market(s, d), AS_OF))
