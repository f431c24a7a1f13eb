"""What a screen shows of a prediction: signals, sizes, drivers and their text, chart rows, narrative. The SQL is written apart.

Predictions stand in for a model's: a probability of each scored document and of each bar, by arithmetic on its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantlake.plans.market import SCORED, C, query, scored
from quantlake.plans.panel import FEATURES, FEATURES_SQL, LAST, MODEL, with_features
from quantlake.sources.bars import DAY, bars, bars_sql

# Thresholds of signals and sizes.
BUY, SELL, STRONG, MODERATE, FLAT_MARKET, UNSTEADY, STEADY = 0.55, 0.45, 0.70, 0.60, 20, 0.4, 0.6
KELLY_SHARE, TARGET_VOLATILITY, MOST, WIN, LOSS = 0.5, 0.20, 0.10, 0.15, 0.10
COIN_FLIP, HIGH_CONVICTION, LOW_CONVICTION, LEAST_SHARE, DRIVERS = 0.04, 0.60, 0.45, 1e-4, 3
CRORE, LAKH = 10_000_000, 100_000
# Texts.
HEADLINE = {
    ("BUY", "strong"): "{symbol} looks clearly positive over the next {horizon}.",
    ("BUY", "moderate"): "{symbol} looks moderately positive over the next {horizon}.",
    ("BUY", "weak"): "{symbol} leans slightly positive over the next {horizon}, but only slightly.",
    ("SELL", "strong"): "{symbol} looks clearly negative over the next {horizon}.",
    ("SELL", "moderate"): "{symbol} looks moderately negative over the next {horizon}.",
    ("SELL", "weak"): "{symbol} leans slightly negative over the next {horizon}, but only slightly.",
    ("HOLD", "strong"): "{symbol} looks genuinely balanced over the next {horizon}.",
    ("HOLD", "moderate"): "{symbol} looks balanced over the next {horizon} — no clear direction either way.",
    ("HOLD", "weak"): "We do not have a clear read on {symbol} over the next {horizon}.",
}
PROBABILITY = "The model puts the chance of {symbol} being higher in {horizon} at {pct}%. That is not a promise: out of every 100 calls like this one, roughly {misses} went the other way."
COIN = "This is close to a coin flip. The model is not finding much to separate {symbol} from an even chance right now, and saying so is more useful than manufacturing a view."
REGIME = {
    "bull": "The wider market is in an uptrend, which is consistent with this signal.",
    "bear": "The wider market is in a downtrend, which works against this signal.",
    "ranging": "The wider market is directionless right now, which makes any single-stock call less reliable.",
}
CONFLICT = "Note the tension: this is a {signal} signal while the wider market is in a {regime} phase. Signals that fight the market resolve less often."
CONVICTION = {
    "high": "A second model, which only judges whether calls like this one tend to be correct, rates this one above average.",
    "low": "A second model, which only judges whether calls like this one tend to be correct, is not convinced by this one — which is a reason to size it small or skip it.",
}
HONESTY = "Across its whole test history this model's edge was {standing}. See the model page for the full evidence."
STANDING = {True: "statistically distinguishable from chance", False: "NOT statistically distinguishable from chance", None: "never formally tested"}
NOT_ADVICE = "This is a research output, not investment advice, and not a recommendation to buy or sell anything."
HORIZON = {1: "month", 3: "3 months", 6: "6 months", 12: "a year", 24: "two years"}
NOTES = {
    "aligned": "Signal not aligned with current market regime.",
    "buy_flat": "ADX < 20 — weak/ranging market, trend may not sustain.",
    "buy_unsteady": "Low trend consistency — fewer than 40% of recent days were up.",
    "sell_flat": "ADX < 20 — weak/ranging market.",
    "sell_steady": "High trend consistency — downside may be limited.",
}
#: Names, units, factors and digits of the features that people see most; compact: in crore and lakh.
DISPLAY = {
    "momentum_roc_1m": ("1-month price change", "%", 1.0, 1),
    "momentum_roc_3m": ("3-month price change", "%", 1.0, 1),
    "momentum_roc_6m": ("6-month price change", "%", 1.0, 1),
    "momentum_roc_12m": ("12-month price change", "%", 1.0, 1),
    "momentum_rsi_14": ("14-day RSI (overbought/oversold)", "", 1.0, 0),
    "momentum_rsi_28": ("28-day RSI", "", 1.0, 0),
    "trend_sma_50": ("50-day average price", "", 1.0, 0),
    "trend_sma_200": ("200-day average price", "", 1.0, 0),
    "trend_ema_50": ("50-day weighted average price", "", 1.0, 0),
    "trend_macd": ("MACD (trend momentum)", "", 1.0, 2),
    "trend_price_vs_sma20": ("distance from the 20-day average", "%", 100.0, 1),
    "trend_price_vs_sma50": ("distance from the 50-day average", "%", 100.0, 1),
    "trend_price_vs_sma200": ("distance from the 200-day average", "%", 100.0, 1),
    "volatility_atr_14": ("typical daily range", "", 1.0, 2),
    "volatility_atr_21": ("typical daily range (21-day)", "", 1.0, 2),
    "volatility_rv_63": ("recent price swings", "%", 100.0, 1),
    "volatility_bb_pct_b": ("position within its trading band", "", 1.0, 2),
    "volume_obv": ("cumulative buying vs selling pressure", "compact", 1.0, 1),
    "volume_ratio": ("trading volume vs normal", "", 1.0, 2),
    "regime_adx": ("trend strength", "", 1.0, 0),
    "regime_drawdown": ("fall from its recent peak", "%", 100.0, 1),
    "regime_52w_position": ("position in its 52-week range", "", 1.0, 2),
    "regime_trend_consistency_63": ("how steady the trend has been", "", 1.0, 2),
}
SUFFIXES = {"_xs": " (vs the rest of the market)", "_sect": " (vs its sector)"}
PREFIXES = ("momentum_", "trend_", "volatility_", "volume_", "regime_", "fundamental_")

# Signals


def filled(template: str, **values: Column) -> Column:
    """A template as a Column: the names in braces are replaced by columns."""
    parts: list[Column] = []
    for piece in template.replace("{", "\0{").replace("}", "}\0").split("\0"):
        parts.append(values[piece[1:-1]] if piece.startswith("{") else F.lit(piece))
    return F.concat(*parts)


def filled_sql(template: str, **values: str) -> str:
    out = "'" + template.replace("'", "''") + "'"
    for name, x in values.items():
        out = out.replace("{" + name + "}", f"' || {x} || '")
    return out


def signal(p: Column) -> Column:
    return F.when(p >= BUY, "BUY").when(p <= SELL, "SELL").otherwise("HOLD")


def strength(confidence: Column) -> Column:
    return F.when(confidence >= STRONG, "strong").when(confidence >= MODERATE, "moderate").otherwise("weak")


def generate(rows: DataFrame) -> DataFrame:
    """``rows`` (p, adx, consistency) with signal, confidence (highest at even odds for HOLD), strength, and whether the regime
    agrees, with notes."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), C("p")))
    sig = signal(p)
    confidence = F.when(sig == "BUY", p).when(sig == "SELL", 1 - p).otherwise(1 - 2 * F.abs(p - 0.5))
    flat, low, high = C("adx") < FLAT_MARKET, C("consistency") < UNSTEADY, C("consistency") > STEADY
    against = F.coalesce(((sig == "BUY") & (F.coalesce(flat, F.lit(False)) | F.coalesce(low, F.lit(False)))) | ((sig == "SELL") & flat), F.lit(False))
    notes = F.array_compact(F.array(
        F.when(against, NOTES["aligned"]), F.when((sig == "BUY") & flat, NOTES["buy_flat"]), F.when((sig == "BUY") & low, NOTES["buy_unsteady"]),
        F.when((sig == "SELL") & flat, NOTES["sell_flat"]), F.when((sig == "SELL") & high, NOTES["sell_steady"]),
    ))
    return rows.select("*", sig.alias("sig"), F.round(confidence, 4).alias("confidence"), strength(confidence).alias("strength"), (~against).alias("aligned"), F.array_join(notes, " ").alias("notes"))


def scored_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored documents, with odds beyond 0 and 1, and a regime by arithmetic, missing for some."""
    rows = scored(spark, sf_dir)
    return rows.select("doc_id", "y", (C("p") * 1.1 - 0.05).alias("p"), F.when(C("doc_id") % 7 != 0, C("doc_id") * 13 % 40).cast("double").alias("adx"), F.when(C("doc_id") % 5 != 0, C("doc_id") * 29 % 100 / 100.0).alias("consistency"))


REGIMES = f"WITH {SCORED}, r AS (SELECT doc_id, y, p * 1.1 - 0.05 AS p, CASE WHEN doc_id % 7 <> 0 THEN CAST(doc_id * 13 % 40 AS DOUBLE) END AS adx, CASE WHEN doc_id % 5 <> 0 THEN doc_id * 29 % 100 / 100.0 END AS consistency FROM s)"
SIG = f"CASE WHEN c >= {BUY} THEN 'BUY' WHEN c <= {SELL} THEN 'SELL' ELSE 'HOLD' END"
STRENGTH_SQL = f"CASE WHEN confidence >= {STRONG} THEN 'strong' WHEN confidence >= {MODERATE} THEN 'moderate' ELSE 'weak' END"
GENERATED = f"""{REGIMES}, c AS (SELECT *, least(1.0, greatest(0.0, p)) AS c FROM r), g AS (SELECT *, {SIG} AS sig FROM c), k AS (SELECT *, CASE sig WHEN 'BUY' THEN c WHEN 'SELL' THEN 1 - c ELSE 1 - 2 * abs(c - 0.5) END AS confidence FROM g),
    n AS (SELECT *, list_filter([CASE WHEN sig = 'BUY' AND adx < 20 THEN '{NOTES["buy_flat"]}' END, CASE WHEN sig = 'BUY' AND consistency < 0.4 THEN '{NOTES["buy_unsteady"]}' END, CASE WHEN sig = 'SELL' AND adx < 20 THEN '{NOTES["sell_flat"]}' END], lambda x: x IS NOT NULL) AS bad,
      CASE WHEN sig = 'SELL' AND consistency > 0.6 THEN ['{NOTES["sell_steady"]}'] ELSE [] END AS remark FROM k)
    SELECT doc_id, sig, round(confidence, 4) AS confidence, {STRENGTH_SQL} AS strength, len(bad) = 0 AS aligned, array_to_string(list_concat(CASE WHEN len(bad) > 0 THEN ['{NOTES["aligned"]}'] ELSE [] END, bad, remark), ' ') AS notes FROM n"""
query("sig_generate", GENERATED)(lambda s, d: generate(scored_regimes(s, d)).select("doc_id", "sig", "confidence", "strength", "aligned", "notes"))
query("sig_strength", f"WITH {SCORED}, k AS (SELECT doc_id, greatest(p, 1 - p) AS confidence FROM s) SELECT doc_id, {STRENGTH_SQL} AS strength FROM k")(
    lambda s, d: scored(s, d).select("doc_id", strength(F.greatest(C("p"), 1 - C("p"))).alias("strength"))
)
MEMBERS, MEMBER_WEIGHTS = ("p", "1 - p", "p * p", "sqrt(p)"), (3.0, 1.0, 2.0, 2.0)


def ensemble(probabilities: Column, weights: Column) -> Column:
    """The weighted mean of an array of probabilities; weights need not add up to 1, and lengths must agree."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    same = (F.size(probabilities) == F.size(weights)) & (F.size(probabilities) > 0)
    mean = total(F.zip_with(probabilities, weights, lambda p, w: p * w)) / total(weights)
    return F.when(same, mean).otherwise(F.raise_error(F.lit("probabilities and weights differ in number, or there are none")).cast("double"))


query("sig_ensemble", f"WITH {SCORED}, e AS (SELECT doc_id, ({' + '.join(f'{w} * ({p})' for p, w in zip(MEMBERS, MEMBER_WEIGHTS, strict=True))}) / {sum(MEMBER_WEIGHTS)} AS c FROM s) SELECT doc_id, round(c, 6) AS p, {SIG} AS sig FROM e")(
    lambda s, d: scored(s, d).withColumn("e", ensemble(F.array(*map(F.expr, MEMBERS)), F.array(*map(F.lit, MEMBER_WEIGHTS)))).select("doc_id", F.round("e", 6).alias("p"), signal(C("e")).alias("sig"))
)

# Sizes: half of Kelly's share, less for a volatile stock, at most MOST


def kelly(p: Column, win: float = WIN, loss: float = LOSS) -> Column:
    ratio = win / loss
    return F.when((p > 0) & (p < 1), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ratio * p - (1 - p)) / ratio))).otherwise(0.0)


def sizes(rows: DataFrame) -> DataFrame:
    """``rows`` (p, volatility) with kelly, recommended and the rationale."""
    full, scale = kelly(C("p")), F.least(F.lit(1.0), TARGET_VOLATILITY / F.greatest(C("volatility"), F.lit(0.01)))
    final = F.greatest(F.lit(0.0), F.least(F.abs(full * KELLY_SHARE * scale), F.lit(MOST)))
    slow = F.when(scale < 1, F.format_string("Vol-scaled by %.2f (stock vol %.0f%% > target 20%%).", scale, C("volatility") * 100))
    capped = F.when(full > MOST / KELLY_SHARE, F.format_string("Kelly suggested %.1f%% but capped at 10%%.", full * 100))
    notes = F.array_join(F.array_compact(F.array(slow, capped)), " ")
    below = C("p") < BUY
    rationale = F.when(below, F.format_string("Confidence %.1f%% below threshold 55.0%%.", C("p") * 100)).when(notes == "", "Standard 50%-Kelly sizing.").otherwise(notes)
    zero = lambda x: F.round(F.when(below, 0.0).otherwise(x), 4)
    return rows.select("*", zero(full).alias("kelly"), zero(final).alias("recommended"), rationale.alias("rationale"))


#: Odds and volatilities of which no share lies on a half in the last digit shown.
SIZED = f"WITH {SCORED}, v AS (SELECT doc_id, p + 0.001234 AS p, 0.1037 + doc_id % 40 / 100.0 AS volatility FROM s)"
query("siz_kelly", f"{SIZED} SELECT doc_id, round(CASE WHEN p > 0 AND p < 1 THEN greatest(-1, least(1, (1.5 * p - (1 - p)) / 1.5)) ELSE 0 END, 6) AS kelly FROM v")(
    lambda s, d: scored(s, d).select("doc_id", F.round(kelly(C("p") + 0.001234), 6).alias("kelly"))
)
query(
    "siz_recommended",
    f"""{SIZED}, k AS (SELECT *, greatest(-1, least(1, (1.5 * p - (1 - p)) / 1.5)) AS f, least(1.0, 0.2 / volatility) AS scale FROM v)
    SELECT doc_id, CASE WHEN p < 0.55 THEN 0.0 ELSE round(f, 4) END AS kelly, CASE WHEN p < 0.55 THEN 0.0 ELSE round(greatest(0, least(abs(f * 0.5 * scale), 0.1)), 4) END AS recommended,
      CASE WHEN p < 0.55 THEN format('Confidence {{:.1f}}% below threshold 55.0%.', p * 100) WHEN scale >= 1 AND f <= 0.2 THEN 'Standard 50%-Kelly sizing.'
        ELSE trim(CASE WHEN scale < 1 THEN format('Vol-scaled by {{:.2f}} (stock vol {{:.0f}}% > target 20%). ', scale, volatility * 100) ELSE '' END || CASE WHEN f > 0.2 THEN format('Kelly suggested {{:.1f}}% but capped at 10%.', f * 100) ELSE '' END) END AS rationale FROM k""",
)(lambda s, d: sizes(scored(s, d).select("doc_id", (C("p") + 0.001234).alias("p"), (0.1037 + C("doc_id") % 40 / 100.0).alias("volatility"))).select("doc_id", "kelly", "recommended", "rationale"))

# Chart rows: direction in four ways, so that none rests on colour alone


def direction(x: Column, threshold: float = 1e-9) -> Column:
    return F.when(F.isnan(x) | x.isNull(), "flat").when(x > threshold, "up").when(x < -threshold, "down").otherwise("flat")


def encoded(x: Column, threshold: float = 1e-9) -> list[Column]:
    way = direction(x, threshold)
    glyph = F.when(way == "up", "▲").when(way == "down", "▼").otherwise("■")
    return [way.alias("direction"), glyph.alias("glyph"), F.initcap(way).alias("label"), F.concat(F.lit("--dir-"), way).alias("color_var")]


def encoded_sql(x: str, threshold: float = 1e-9) -> str:
    cases = [f"CASE WHEN {x} > {threshold} THEN '{up}' WHEN {x} < -{threshold} THEN '{down}' ELSE '{flat}' END" for up, down, flat in (("up", "down", "flat"), ("▲", "▼", "■"), ("Up", "Down", "Flat"), ("--dir-up", "--dir-down", "--dir-flat"))]
    return ", ".join(f"{c} AS {k}" for c, k in zip(cases, ("direction", "glyph", "label", "color_var"), strict=True))


query("fn_encode", f"{bars_sql(DAY)} SELECT symbol, date, {encoded_sql('(close - prev_close)')} FROM bars")(lambda s, d: bars(s, d, DAY).select("symbol", "date", *encoded(C("close") - C("prev_close"))))
query("pay_volume", f"{bars_sql(DAY)} SELECT symbol, CAST(date AS VARCHAR) AS time, CAST(volume AS DOUBLE) AS value, {encoded_sql('(close - open)')} FROM bars")(
    lambda s, d: bars(s, d, DAY).select("symbol", C("date").cast("string").alias("time"), C("volume").cast("double").alias("value"), *encoded(C("close") - C("open")))
)
query("pay_candles", f"{bars_sql(DAY)} SELECT symbol, CAST(date AS VARCHAR) AS time, open, high, low, close, {encoded_sql('(close - open)')} FROM bars")(
    lambda s, d: bars(s, d, DAY).select("symbol", C("date").cast("string").alias("time"), "open", "high", "low", "close", *encoded(C("close") - C("open")))
)
query("pay_return_bars", f"WITH {SCORED} SELECT doc_id, (p - 0.5) * 200 AS value, format('{{:+.2f}}%', (p - 0.5) * 200) AS display_value, {encoded_sql('((p - 0.5) * 200)')} FROM s WHERE p <> 0.5")(
    lambda s, d: scored(s, d).where("p <> 0.5").withColumn("value", (C("p") - 0.5) * 200).select("doc_id", "value", F.format_string("%+.2f%%", "value").alias("display_value"), *encoded(C("value")))
)
query("pay_verdict", f"WITH {SCORED} SELECT doc_id, round(least(1, 2 * abs(p - 0.5)), 6) AS magnitude, p > 0.5 AS extends_right, {encoded_sql('(p - 0.5)', 0.005)} FROM s")(
    lambda s, d: scored(s, d).select("doc_id", F.round(F.least(F.lit(1.0), 2 * F.abs(C("p") - 0.5)), 6).alias("magnitude"), (C("p") > 0.5).alias("extends_right"), *encoded(C("p") - 0.5, 0.005))
)


def reliability(rows: DataFrame, least: int = 20) -> DataFrame:
    """Ten equal bins, closed on the right: predicted, observed, n, gap and its direction."""
    edge = sum((F.when(C("p") > k / 10, 1).otherwise(0) for k in range(1, 10)), F.lit(0))
    bins = rows.groupBy(edge.alias("bin")).agg(F.avg("p").alias("predicted"), F.avg("y").alias("observed"), F.count("*").alias("n")).where(C("n") >= least)
    return bins.withColumn("gap", C("observed") - C("predicted"))


RELIABLE = f"WITH {SCORED}, b AS (SELECT CAST(greatest(0, ceil(round(p * 100) / 10) - 1) AS INTEGER) AS bin, avg(p) AS predicted, avg(y) AS observed, count(*) AS n FROM s GROUP BY 1 HAVING count(*) >= 20), g AS (SELECT *, observed - predicted AS gap FROM b)"
query("pay_reliability", f"{RELIABLE} SELECT bin, round(predicted, 6) AS predicted, round(observed, 6) AS observed, n, round(gap, 6) AS gap, {encoded_sql('gap', 0.02)} FROM g")(
    lambda s, d: reliability(scored(s, d)).select("bin", F.round("predicted", 6).alias("predicted"), F.round("observed", 6).alias("observed"), "n", F.round("gap", 6).alias("gap"), *encoded(C("gap"), 0.02))
)
query("cal_frame", f"{RELIABLE} SELECT bin, round(gap, 6) AS gap, n FROM g")(lambda s, d: reliability(scored(s, d)).select("bin", F.round("gap", 6).alias("gap"), "n"))


def calibration(rows: DataFrame) -> DataFrame:
    """brier, bss, ece (over all bins), base_rate and n in one row."""
    bins = reliability(rows, 1).agg((F.sum(C("n") * F.abs("gap")) / F.sum("n")).alias("ece"))
    whole = rows.agg(F.avg((C("p") - C("y")) * (C("p") - C("y"))).alias("brier"), F.var_pop("y").alias("ref"), F.avg("y").alias("base_rate"), F.count("*").alias("n"))
    whole = whole.withColumn("bss", 1 - C("brier") / F.nullif(C("ref"), F.lit(0.0)))
    return whole.join(F.broadcast(bins), how="cross")  # one row each


query(
    "cal_report",
    f"""WITH {SCORED}, b AS (SELECT greatest(0, ceil(round(p * 100) / 10) - 1) AS bin, abs(avg(y) - avg(p)) AS gap, count(*) AS n FROM s GROUP BY 1)
    SELECT round(avg((p - y) * (p - y)), 6) AS brier, round(1 - avg((p - y) * (p - y)) / nullif(var_pop(y), 0), 6) AS bss, (SELECT round(sum(n * gap) / sum(n), 6) FROM b) AS ece, round(avg(y), 6) AS base_rate, count(*) AS n FROM s""",
)(lambda s, d: calibration(scored(s, d)).select(*(F.round(x, 6).alias(x) for x in ("brier", "bss", "ece", "base_rate")), "n"))

# Names and values of features as text


def compact(x: Column) -> Column:
    """Indian numbering: crore and lakh, sign kept."""
    sign, n = F.when(x < 0, "-").otherwise(""), F.abs(x)
    short = F.when(n >= CRORE, F.format_string("%.1f crore", n / CRORE)).when(n >= LAKH, F.format_string("%.1f lakh", n / LAKH)).otherwise(F.format_number(n, 0))
    return F.concat(sign, short)


def base_of(feature: Column) -> Column:
    return F.regexp_replace(feature, "(_xs|_sect)$", "")


def described(feature: Column) -> Column:
    """The name that people see: from DISPLAY, else the feature without its prefix and underscores, and what it is compared with."""
    base = base_of(feature)
    name = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, v in DISPLAY.items() for x in (k, v[0]))), base), F.trim(F.regexp_replace(F.regexp_replace(base, f"^({'|'.join(PREFIXES)})", ""), "_+", " ")))
    suffix = F.when(feature.endswith("_xs"), SUFFIXES["_xs"]).when(feature.endswith("_sect"), SUFFIXES["_sect"]).otherwise("")
    return F.concat(name, suffix)


def percentile_text(x: Column) -> Column:
    pct = F.bround(x * 100).cast("int")
    text = F.concat(pct.cast("string"), F.lit("th percentile"))
    return F.when(x.isNull() | F.isnan(x), "unavailable").when(pct >= 90, F.concat(text, F.lit(" — near the top of the market"))).when(pct <= 10, F.concat(text, F.lit(" — near the bottom of the market"))).otherwise(text)


def value_text(feature: Column, x: Column) -> Column:
    out = F.format_string("%.2f", x)
    for digits in (0, 1, 2):
        plain = [k for k, v in DISPLAY.items() if v[1] == "" and v[3] == digits]
        if plain:
            out = F.when(feature.isin(plain), F.format_string(f"%.{digits}f", x)).otherwise(out)
    for scale in (1.0, 100.0):
        out = F.when(feature.isin([k for k, v in DISPLAY.items() if v[1] == "%" and v[2] == scale]), F.format_string("%+.1f%%", x * scale)).otherwise(out)
    out = F.when(feature.isin([k for k, v in DISPLAY.items() if v[1] == "compact"]), compact(x)).otherwise(out)
    out = F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), "unavailable").otherwise(out)
    return F.when(feature.rlike("(_xs|_sect)$"), percentile_text(x)).otherwise(out)


_label = {k: v[0] for k, v in DISPLAY.items()}
_plain = lambda x: next((x[len(p) :] for p in PREFIXES if x.startswith(p)), x).replace("__", "_").replace("_", " ")
query(
    "fn_feature_format",
    f"""{FEATURES_SQL} SELECT symbol, date, CASE WHEN momentum_roc_1m IS NULL THEN 'unavailable' ELSE format('{{:+.1f}}%', momentum_roc_1m) END AS roc, CASE WHEN volatility_atr_14 IS NULL THEN 'unavailable' ELSE format('{{:.2f}}', volatility_atr_14) END AS atr,
      CASE WHEN trend_price_vs_sma20 IS NULL THEN 'unavailable' ELSE format('{{:+.1f}}%', trend_price_vs_sma20 * 100) END AS vs_sma FROM {LAST}""",
)(
    lambda s, d: with_features(bars(s, d, DAY)).select(
        "symbol", "date", value_text(F.lit("momentum_roc_1m"), C("momentum_roc_1m")).alias("roc"), value_text(F.lit("volatility_atr_14"), C("volatility_atr_14")).alias("atr"), value_text(F.lit("trend_price_vs_sma20"), C("trend_price_vs_sma20")).alias("vs_sma")
    )
)
query("fn_percentile_format", f"WITH {SCORED} SELECT doc_id, CAST(round(p * 100) AS INTEGER) || 'th percentile' || CASE WHEN p >= 0.895 THEN ' — near the top of the market' WHEN p < 0.105 THEN ' — near the bottom of the market' ELSE '' END AS text FROM s")(
    lambda s, d: scored(s, d).select("doc_id", percentile_text(C("p")).alias("text"))
)
query(
    "fn_compact",
    f"{bars_sql()} SELECT symbol, date, CASE WHEN close < prev_close THEN '-' ELSE '' END || CASE WHEN turnover >= 1e7 THEN format('{{:.1f}} crore', turnover / 1e7) WHEN turnover >= 1e5 THEN format('{{:.1f}} lakh', turnover / 1e5) ELSE format('{{:,}}', CAST(floor(turnover) AS BIGINT)) END AS compact FROM bars",
)(lambda s, d: bars(s, d).select("symbol", "date", compact(F.floor("turnover") * F.when(C("close") < C("prev_close"), -1).otherwise(1)).alias("compact")))


def horizon_text(months: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in HORIZON.items() for x in kv)), months), F.concat(months.cast("string"), F.lit(" months")))



# Drivers: shares of a linear model, coefficient times distance from the mean, for the newest bar of each symbol

COEFFICIENTS = dict(zip(MODEL, (0.03, 4.0, -1.5, 0.2, 2.5), strict=True))


def newest(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).where("_r = 1").drop("_r")


def attributions(rows: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """symbol, date, feature, value and share (exact for a linear model) of each row; means over all ``rows``, whose number is
    that of the symbols."""
    means = rows.agg(*(F.avg(k).alias(f"_{k}") for k in coefficients))
    one = rows.join(F.broadcast(means), how="cross")  # one row of means
    facts = F.array(*(F.struct(F.lit(k).alias("feature"), C(k).alias("value"), (F.coalesce(C(k) - C(f"_{k}"), F.lit(0.0)) * w).alias("share")) for k, w in coefficients.items()))
    return one.select("symbol", "date", F.explode(facts).alias("f")).select("symbol", "date", "f.*")


def facts(rows: DataFrame, most: int = DRIVERS) -> DataFrame:
    """The strongest shares of each symbol, ranked, with their text; those below LEAST_SHARE are no drivers."""
    order = Window.partitionBy("symbol").orderBy(F.desc(F.abs("share")), "feature")
    rows = rows.where(F.abs("share") >= LEAST_SHARE).withColumn("rank", F.row_number().over(order)).where(C("rank") <= most)
    way = F.when(C("share") > 0, "supports_up").otherwise("supports_down")
    return rows.select("symbol", "rank", "feature", described(C("feature")).alias("name"), value_text(C("feature"), C("value")).alias("display_value"), way.alias("direction"), "share")


FACTS = f"""{FEATURES_SQL}, nw AS (SELECT * FROM {LAST} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1),
    att AS ({" UNION ALL ".join(f"SELECT symbol, date, '{k}' AS feature, {k} AS value, coalesce({k} - (SELECT avg({k}) FROM nw), 0) * {w} AS share FROM nw" for k, w in COEFFICIENTS.items())}),
    facts AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY abs(share) DESC, feature) AS rank, feature, CASE feature {" ".join(f"WHEN '{k}' THEN '{_label.get(k, _plain(k))}'" for k in COEFFICIENTS)} END AS name,
      CASE WHEN value IS NULL THEN 'unavailable' WHEN feature = 'momentum_roc_1m' THEN format('{{:+.1f}}%', value) WHEN feature IN ('trend_price_vs_sma50', 'regime_drawdown') THEN format('{{:+.1f}}%', value * 100) ELSE format('{{:.2f}}', value) END AS display_value,
      CASE WHEN share > 0 THEN 'supports_up' ELSE 'supports_down' END AS direction, share FROM att WHERE abs(share) >= {LEAST_SHARE} QUALIFY rank <= {DRIVERS})"""


def driver_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(attributions(newest(with_features(bars(spark, sf_dir, DAY))), COEFFICIENTS))


query("exp_shap", f"{FACTS} SELECT symbol, feature, round(share, 6) AS share FROM att")(
    lambda s, d: attributions(newest(with_features(bars(s, d, DAY))), COEFFICIENTS).select("symbol", "feature", F.round("share", 6).alias("share"))
)
query("top_facts", f"{FACTS} SELECT symbol, CAST(rank AS INTEGER) AS rank, feature, name, display_value, direction, round(share, 6) AS share FROM facts")(
    lambda s, d: driver_facts(s, d).select("symbol", "rank", "feature", "name", "display_value", "direction", F.round("share", 6).alias("share"))
)


def split(rows: DataFrame) -> DataFrame:
    """Lines of the drivers that push up and of those that hold back, in the order of their rank."""
    line = F.concat(F.when(C("direction") == "supports_up", "▲").otherwise("▼"), F.lit(" "), C("name"), F.lit(" is "), C("display_value"))
    lines = rows.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("rank", "direction", line.alias("line")))).alias("all"))
    side = lambda way: F.array_join(F.transform(F.filter("all", lambda x: x["direction"] == way), lambda x: x["line"]), "; ")
    return lines.select("symbol", side("supports_up").alias("supports"), side("supports_down").alias("opposes"))


SPLIT = f"""{FACTS}, lines AS (SELECT symbol, rank, direction, CASE WHEN direction = 'supports_up' THEN '▲ ' ELSE '▼ ' END || name || ' is ' || display_value AS line FROM facts),
    split AS (SELECT symbol, coalesce(string_agg(line, '; ' ORDER BY rank) FILTER (direction = 'supports_up'), '') AS supports, coalesce(string_agg(line, '; ' ORDER BY rank) FILTER (direction = 'supports_down'), '') AS opposes FROM lines GROUP BY symbol)"""
query("exp_split", f"{SPLIT} SELECT * FROM split")(lambda s, d: split(driver_facts(s, d)))

# Narrative: a probability is never stated without what it means when it is wrong


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest bar of each symbol with odds, conviction and regime by arithmetic on the symbol's number."""
    k = F.substring("symbol", 7, 2).cast("int")
    rows = newest(bars(spark, sf_dir, DAY)).select("symbol", "date", (k * 37 % 100 / 100.0).alias("p"), F.when(k % 4 != 0, k * 7 % 100 / 100.0).alias("conviction"), F.element_at(F.array(F.lit("bull"), F.lit("bear"), F.lit("ranging"), F.lit(None).cast("string")), k % 4 + 1).alias("regime"), F.element_at(F.array(*map(F.lit, (1, 6, 9, 12))), k % 4 + 1).alias("months"))
    return rows.withColumns({"sig": signal(C("p")), "strength": strength(F.greatest(C("p"), 1 - C("p")))})


PREDICTIONS = f"""{bars_sql(DAY)}, k AS (SELECT symbol, max(date) AS date, CAST(substr(symbol, 7, 2) AS INTEGER) AS k FROM bars GROUP BY symbol),
    pr AS (SELECT symbol, date, k * 37 % 100 / 100.0 AS p, CASE WHEN k % 4 <> 0 THEN k * 7 % 100 / 100.0 END AS conviction, ['bull', 'bear', 'ranging', NULL][k % 4 + 1] AS regime, [1, 6, 9, 12][k % 4 + 1] AS months FROM k),
    pd AS (SELECT *, p AS c, greatest(p, 1 - p) AS confidence, ['month', '6 months', '9 months', 'a year'][list_position([1, 6, 9, 12], months)] AS horizon FROM pr), pred AS (SELECT *, {SIG} AS sig, {STRENGTH_SQL} AS strength FROM pd)"""


def narrative(rows: DataFrame, significant: bool | None) -> DataFrame:
    """headline, probability, regime_text, conviction_text and caveats of every row of predictions()."""
    horizon, symbol = horizon_text(C("months")), C("symbol")
    headline = F.lit(None)
    for (sig, how), text in HEADLINE.items():
        headline = F.when((C("sig") == sig) & (C("strength") == how), filled(text, symbol=symbol, horizon=horizon)).otherwise(headline)
    pct = F.bround(C("p") * 100).cast("int")
    odds = F.when(F.abs(C("p") - 0.5) < COIN_FLIP, filled(COIN, symbol=symbol)).otherwise(filled(PROBABILITY, symbol=symbol, horizon=horizon, pct=pct.cast("string"), misses=(100 - pct).cast("string")))
    against = ((C("sig") == "BUY") & (C("regime") == "bear")) | ((C("sig") == "SELL") & (C("regime") == "bull"))
    regime = F.when(against, filled(CONFLICT, signal=C("sig"), regime=C("regime"))).otherwise(F.element_at(F.create_map(*(F.lit(x) for kv in REGIME.items() for x in kv)), C("regime")))
    conviction = F.when(C("conviction") >= HIGH_CONVICTION, CONVICTION["high"]).when(C("conviction") <= LOW_CONVICTION, CONVICTION["low"])
    caveats = F.lit(HONESTY.replace("{standing}", STANDING[significant]) + " " + NOT_ADVICE)
    return rows.select("symbol", headline.alias("headline"), odds.alias("probability"), regime.alias("regime_text"), conviction.alias("conviction_text"), caveats.alias("caveats"))


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_headline = "CASE sig || ' ' || strength " + " ".join(f"WHEN '{a} {b}' THEN {filled_sql(t, symbol='symbol', horizon='horizon')}" for (a, b), t in HEADLINE.items()) + " END"
_odds = f"CASE WHEN abs(p - 0.5) < {COIN_FLIP} THEN {filled_sql(COIN, symbol='symbol')} ELSE {filled_sql(PROBABILITY, symbol='symbol', horizon='horizon', pct='CAST(round(p * 100) AS INTEGER)', misses='CAST(100 - round(p * 100) AS INTEGER)')} END"
_regime = f"CASE WHEN (sig = 'BUY' AND regime = 'bear') OR (sig = 'SELL' AND regime = 'bull') THEN {filled_sql(CONFLICT, signal='sig', regime='regime')} {' '.join(f'WHEN regime = {q(k)} THEN {q(v)}' for k, v in REGIME.items())} END"
_conviction = f"CASE WHEN conviction >= {HIGH_CONVICTION} THEN {q(CONVICTION['high'])} WHEN conviction <= {LOW_CONVICTION} THEN {q(CONVICTION['low'])} END"
_caveats = q(HONESTY.replace("{standing}", STANDING[False]) + " " + NOT_ADVICE)
for _name, _columns in {"nar_probability": {"probability": _odds}, "nar_regime": {"regime_text": _regime, "conviction_text": _conviction, "caveats": _caveats}, "nar_headline": {"headline": _headline}}.items():
    query(_name, f"{PREDICTIONS} SELECT symbol, {', '.join(f'{x} AS {k}' for k, x in _columns.items())} FROM pred")(
        lambda s, d, names=tuple(_columns): narrative(predictions(s, d), False).select("symbol", *names)
    )
query(
    "nar_render",
    f"{SPLIT}, {PREDICTIONS.removeprefix(bars_sql(DAY) + ', ')} SELECT symbol, {_headline} AS headline, {_odds} AS probability, supports, opposes, {_regime} AS regime_text, {_caveats} AS caveats FROM pred JOIN split USING (symbol)",
)(lambda s, d: narrative(predictions(s, d), False).join(split(driver_facts(s, d)), "symbol").select("symbol", "headline", "probability", "supports", "opposes", "regime_text", "caveats"))
query(
    "cmp_screen",
    f"{PREDICTIONS} SELECT symbol, p, sig, strength, round((p - 0.5) * 200, 4) AS value, format('{{:+.2f}}%', round((p - 0.5) * 200, 4)) AS display_value FROM pred ORDER BY p DESC, symbol LIMIT 25",
)(
    lambda s, d: predictions(s, d).withColumn("value", F.round((C("p") - 0.5) * 200, 4)).orderBy(F.desc("p"), "symbol").limit(25)
    .select("symbol", "p", "sig", "strength", "value", F.format_string("%+.2f%%", "value").alias("display_value"))
)


def stock(spark: SparkSession, sf_dir: str, symbol: str) -> DataFrame:
    """Candles of one symbol's last 2,000 bars with its prediction beside them: a chart without a prediction still shows."""
    latest = bars(spark, sf_dir, DAY).where(C("symbol") == symbol).orderBy(F.desc("date")).limit(2000)
    said = F.broadcast(predictions(spark, sf_dir).where(C("symbol") == symbol).select("symbol", "p", "sig"))
    return latest.join(said, "symbol", "left").select("symbol", "date", "open", "high", "low", "close", direction(C("close") - C("open")).alias("direction"), "p", "sig")


query("cmp_stock", f"{PREDICTIONS} SELECT * FROM (SELECT symbol, b.date, open, high, low, close, CASE WHEN close > open THEN 'up' WHEN close < open THEN 'down' ELSE 'flat' END AS direction, p, sig FROM bars b LEFT JOIN pred USING (symbol) WHERE symbol = 'Brand#12' ORDER BY b.date DESC LIMIT 2000)")(
    lambda s, d: stock(s, d, "Brand#12")
)
query("prj_history", f"{bars_sql(DAY)} SELECT * FROM (SELECT date, open, high, low, close, volume FROM bars WHERE symbol = 'Brand#12' ORDER BY date DESC LIMIT 2000) ORDER BY date")(
    lambda s, d: bars(s, d, DAY).where("symbol = 'Brand#12'").orderBy(F.desc("date")).limit(2000).select("date", "open", "high", "low", "close", "volume").orderBy("date")
)
query("join_screen_compose", f"{PREDICTIONS}, v AS (SELECT symbol, count(*) AS n_days, max(close) AS top FROM bars GROUP BY symbol) SELECT symbol, p, sig, n_days, top FROM pred LEFT JOIN v USING (symbol)")(
    lambda s, d: predictions(s, d).join(bars(s, d, DAY).groupBy("symbol").agg(F.count("*").alias("n_days"), F.max("close").alias("top")), "symbol", "left").select("symbol", "p", "sig", "n_days", "top")
)
query("cmp_market", f"{PREDICTIONS} SELECT coalesce(regime, 'unknown') AS regime, count(*) AS n, count(*) = max(count(*)) OVER () AS majority, round(sum(count(regime)) OVER () * 1.0 / sum(count(*)) OVER (), 6) AS reporting FROM pred GROUP BY regime")(
    lambda s, d: (lambda g: g.select("regime", "n", (C("n") == F.max("n").over(Window.partitionBy())).alias("majority"), F.round(F.sum("told").over(Window.partitionBy()) / F.sum("n").over(Window.partitionBy()), 6).alias("reporting")))(
        predictions(s, d).groupBy(F.coalesce("regime", F.lit("unknown")).alias("regime")).agg(F.count("*").alias("n"), F.count("regime").alias("told"))
    )
)
