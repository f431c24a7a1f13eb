"""Labels by triple barrier, sample weights, folds by date, and scores of shuffled labels. The SQL is written apart: range joins
where the Spark side has windows and prefix sums."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantlake.functions import windows as fw
from quantlake.plans.chains import PLACED, placed
from quantlake.plans.market import C, query
from quantlake.sources.bars import DAY, bars, bars_sql, by_symbol

HORIZON, BARRIER, VOLATILITY, LEAST_VOLATILITY = 126, 2.0, 63, 1e-6


def triple_barrier(rows: DataFrame, horizon: int = HORIZON, barrier: float = BARRIER, window: int = VOLATILITY) -> DataFrame:
    """symbol, date, t, sigma, label, exit_t and ret of each bar: 1 or -1 by which of +-barrier * sigma the log return passes
    first within ``horizon`` bars (ties count as profit), 0 if none; null without a whole horizon or a volatility."""
    rows = rows.select("symbol", "date", "close", (F.row_number().over(by_symbol()) - 1).alias("t"), F.ln(C("close") / F.lag("close").over(by_symbol())).alias("lr"))
    rows = rows.withColumn("sigma", fw.rolling(F.stddev_samp, C("lr"), window, window))
    rows = rows.withColumn("path", F.collect_list("close").over(by_symbol().rowsBetween(1, horizon)))
    open_ = (F.size("path") == horizon) & (C("sigma") >= LEAST_VOLATILITY) & (C("close") > 0)
    rows = rows.withColumn("path", F.when(open_, F.transform("path", lambda p: F.ln(p / C("close")))))
    first = lambda hit: F.array_position(F.transform("path", hit), True)  # noqa: E731  0: never
    rows = rows.withColumn("up", first(lambda x: x >= barrier * C("sigma"))).withColumn("down", first(lambda x: x <= -barrier * C("sigma")))
    profit = (C("up") > 0) & ((C("down") == 0) | (C("up") <= C("down")))
    rows = rows.withColumn("label", F.when(C("path").isNull(), None).when(profit, 1).when(C("down") > 0, -1).otherwise(0))
    steps = F.when(C("label") == 1, C("up")).when(C("label") == -1, C("down")).when(C("label") == 0, horizon).cast("int")
    return rows.select("symbol", "date", "t", "sigma", "label", (C("t") + steps).cast("int").alias("exit_t"), F.element_at("path", steps).alias("ret"))


LABELLED = f"""{bars_sql(DAY)}, p AS (SELECT symbol, date, close, CAST(row_number() OVER w - 1 AS INTEGER) AS t, ln(close / lag(close) OVER w) AS lr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
    q AS (SELECT *, CASE WHEN count(lr) OVER v >= {VOLATILITY} THEN stddev_samp(lr) OVER v END AS sigma, max(t) OVER (PARTITION BY symbol) AS final FROM p
      WINDOW v AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN {VOLATILITY - 1} PRECEDING AND CURRENT ROW)),
    h AS (SELECT a.symbol, a.t, min(CASE WHEN ln(b.close / a.close) >= {BARRIER} * a.sigma THEN b.t END) AS up, min(CASE WHEN ln(b.close / a.close) <= -{BARRIER} * a.sigma THEN b.t END) AS down
      FROM q a JOIN q b ON a.symbol = b.symbol AND b.t > a.t AND b.t <= a.t + {HORIZON} WHERE a.t + {HORIZON} <= a.final AND a.sigma >= {LEAST_VOLATILITY} GROUP BY a.symbol, a.t),
    l AS (SELECT q.symbol, q.date, q.t, q.sigma, q.close, CASE WHEN h.t IS NULL THEN NULL WHEN up <= coalesce(down, up) THEN 1 WHEN down IS NOT NULL THEN -1 ELSE 0 END AS label,
      CASE WHEN h.t IS NOT NULL THEN coalesce(least(up, down), q.t + {HORIZON}) END AS exit_t FROM q LEFT JOIN h ON q.symbol = h.symbol AND q.t = h.t),
    lab AS (SELECT l.symbol, l.date, l.t, l.sigma, l.label, l.exit_t, ln(b.close / l.close) AS ret FROM l LEFT JOIN q b ON b.symbol = l.symbol AND b.t = l.exit_t)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triple_barrier(bars(spark, sf_dir, DAY))


query("lab_triple_barrier", f"{LABELLED} SELECT symbol, date, t, round(sigma, 8) AS sigma, label, exit_t, round(ret, 8) AS ret FROM lab")(
    lambda s, d: labelled(s, d).select("symbol", "date", "t", F.round("sigma", 8).alias("sigma"), "label", "exit_t", F.round("ret", 8).alias("ret"))
)
query("lab_binary_side", f"{LABELLED} SELECT symbol, date, CASE WHEN label > 0 THEN 1 WHEN label <= 0 THEN 0 END AS side FROM lab")(
    lambda s, d: labelled(s, d).select("symbol", "date", F.when(C("label") > 0, 1).when(C("label") <= 0, 0).alias("side"))
)


def weighted(rows: DataFrame, last_weight: float = 0.5) -> DataFrame:
    """live (labels whose span covers the bar), uniqueness, attribution (mean 1 a symbol) and decay of each labelled bar.

    Spans become differences of running sums, read at the exit by one equi-join: no range join."""
    ends = rows.where("label IS NOT NULL").groupBy("symbol", (C("exit_t") + 1).alias("t")).agg(F.count("*").alias("ended"))
    rows = rows.join(ends, ["symbol", "t"], "left").withColumn("live", F.sum(F.when(C("label").isNotNull(), 1).otherwise(0) - F.coalesce("ended", F.lit(0))).over(fw.so_far()))
    rows = rows.withColumn("share", F.when(C("live") > 0, 1 / C("live")).otherwise(0.0)).withColumn("part", F.coalesce(C("ret") * C("share"), F.lit(0.0)))
    rows = rows.withColumn("shares", F.sum("share").over(fw.so_far())).withColumn("parts", F.sum("part").over(fw.so_far()))
    at_exit = rows.select("symbol", C("t").alias("exit_t"), C("shares").alias("shares_"), C("parts").alias("parts_"))
    rows = rows.where("label IS NOT NULL").join(at_exit, ["symbol", "exit_t"])
    span = C("exit_t") - C("t") + 1
    rows = rows.withColumn("uniqueness", (C("shares_") - C("shares") + C("share")) / span).withColumn("raw", F.abs(C("parts_") - C("parts") + C("part")))
    whole = Window.partitionBy("symbol")
    rows = rows.withColumn("attribution", C("raw") / F.avg("raw").over(whole))
    slope = (1 - last_weight) / F.sum("uniqueness").over(whole)
    return rows.withColumn("decay", last_weight + slope * F.sum("uniqueness").over(fw.so_far()))


WEIGHTED = f"""{LABELLED}, con AS (SELECT a.symbol, a.t, any_value(a.ret) AS ret, count(b.t) AS live FROM lab a LEFT JOIN lab b ON a.symbol = b.symbol AND a.t >= b.t AND a.t <= b.exit_t GROUP BY a.symbol, a.t),
    u AS (SELECT l.symbol, l.date, l.t, avg(1.0 / c.live) AS uniqueness, abs(sum(coalesce(c.ret, 0) / c.live)) AS raw FROM lab l JOIN con c ON c.symbol = l.symbol AND c.t >= l.t AND c.t <= l.exit_t GROUP BY l.symbol, l.date, l.t),
    w AS (SELECT *, raw / avg(raw) OVER (PARTITION BY symbol) AS attribution, 0.5 + 0.5 * sum(uniqueness) OVER (PARTITION BY symbol ORDER BY t) / sum(uniqueness) OVER (PARTITION BY symbol) AS decay FROM u)"""
WEIGHTS = ("uniqueness", "attribution", "decay")
query("wgt_concurrency", f"{WEIGHTED} SELECT symbol, t, live FROM con JOIN lab USING (symbol, t) WHERE label IS NOT NULL")(
    lambda s, d: weighted(labelled(s, d)).select("symbol", "t", "live")
)
query("wgt_compute", f"{WEIGHTED} SELECT symbol, date, {', '.join(f'round({x}, 6) AS {x}' for x in WEIGHTS)} FROM w")(
    lambda s, d: weighted(labelled(s, d)).select("symbol", "date", *(F.round(x, 6).alias(x) for x in WEIGHTS))
)
query("agg_ess", f"{WEIGHTED} SELECT symbol, round(sum(uniqueness) * sum(uniqueness) / sum(uniqueness * uniqueness), 6) AS ess FROM w GROUP BY symbol")(
    lambda s, d: weighted(labelled(s, d)).groupBy("symbol").agg(F.round(F.expr("sum(uniqueness) * sum(uniqueness) / sum(uniqueness * uniqueness)"), 6).alias("ess"))
)

# Folds: roles are decided for each market day, of which there are few, and joined to the rows by date.

SPLITS, LEAST_TRAIN, PURGE, EMBARGO = 5, 252, 21, 5


def purged_panel(days: DataFrame, splits: int = SPLITS, least: int = LEAST_TRAIN, purge: int = PURGE, embargo: int = EMBARGO, expanding: bool = True) -> DataFrame:
    """fold and role (train, test, purged, embargoed, unused) of each day of ``days`` (pos from 0, n_days)."""
    size = F.floor((C("n_days") - least) / splits)
    days = days.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))).withColumn("start", least + C("fold") * size)
    days = days.withColumn("end", F.when(C("fold") == splits - 1, C("n_days") - 1).otherwise(C("start") + size - 1))
    pos = C("pos")
    role = F.when(pos.between(C("start"), C("end")), "test").when((pos >= C("start") - purge) & (pos < C("start")), "purged")
    if expanding:
        return days.withColumn("role", role.when(pos < C("start"), "train").otherwise("unused"))
    return days.withColumn("role", role.when((pos > C("end")) & (pos <= C("end") + embargo), "embargoed").otherwise("train"))


def dated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = placed(spark, sf_dir).select("symbol", "date", (C("place") - 1).alias("pos"), "n_days")
    return rows, rows.select("date", "pos", "n_days").distinct()


def fold_sizes(rows: DataFrame, days: DataFrame) -> DataFrame:
    sizes = rows.join(days.where("role <> 'unused'").select("date", "fold", "role"), "date").groupBy("fold", "role")
    return sizes.agg(F.count("*").alias("n"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


ROLES = f"""{PLACED}, f AS (SELECT symbol, date, place - 1 AS pos, n_days, fold, {LEAST_TRAIN} + fold * ((n_days - {LEAST_TRAIN}) // {SPLITS}) AS a FROM placed, range({SPLITS}) AS r(fold)),
    g AS (SELECT *, CASE WHEN fold = {SPLITS - 1} THEN n_days - 1 ELSE a + (n_days - {LEAST_TRAIN}) // {SPLITS} - 1 END AS b FROM f)"""
SIZES = "SELECT CAST(fold AS INTEGER) AS fold, role, count(*) AS n, min(date) AS first_day, max(date) AS last_day FROM r WHERE role <> 'unused' GROUP BY ALL"
_head = f"CASE WHEN pos >= a AND pos <= b THEN 'test' WHEN pos < a AND pos >= a - {PURGE} THEN 'purged'"
for _name, _rest in {"cv_purged_panel": "WHEN pos < a THEN 'train' ELSE 'unused' END", "cv_purged_kfold": f"WHEN pos > b AND pos <= b + {EMBARGO} THEN 'embargoed' ELSE 'train' END"}.items():
    query(_name, f"{ROLES}, r AS (SELECT *, {_head} {_rest} AS role FROM g) {SIZES}")(
        lambda s, d, expanding=_name == "cv_purged_panel": (lambda x: fold_sizes(x[0], purged_panel(x[1], expanding=expanding)))(dated(s, d))
    )

GROUPS, TESTED = 6, 2
COMBINATIONS = list(combinations(range(GROUPS), TESTED))


def combinatorial(days: DataFrame, purge: int = PURGE, embargo: int = EMBARGO) -> DataFrame:
    """Role of each day in every choice of TESTED among GROUPS equal groups of days."""
    chosen = F.array(*(F.struct(F.lit(i).alias("fold"), F.array(*map(F.lit, gs)).alias("groups")) for i, gs in enumerate(COMBINATIONS)))
    days = days.withColumn("c", F.explode(chosen)).withColumn("fold", C("c.fold"))
    low = lambda g: F.floor(C("n_days") * g / GROUPS)
    inside = F.exists("c.groups", lambda g: (C("pos") >= low(g)) & (C("pos") < low(g + 1)))
    near = F.exists("c.groups", lambda g: ((C("pos") >= low(g) - purge) & (C("pos") < low(g))) | ((C("pos") >= low(g + 1)) & (C("pos") < low(g + 1) + embargo)))
    return days.withColumn("role", F.when(inside, "test").when(near, "purged").otherwise("train"))


query(
    "cv_cpcv",
    f"""{PLACED}, k AS (SELECT row_number() OVER (ORDER BY x, y) - 1 AS fold, x, y FROM range({GROUPS}) a(x), range({GROUPS}) b(y) WHERE x < y),
    e AS (SELECT place - 1 AS pos, n_days, date, fold, n_days * x // {GROUPS} AS a1, n_days * (x + 1) // {GROUPS} AS b1, n_days * y // {GROUPS} AS a2, n_days * (y + 1) // {GROUPS} AS b2 FROM placed, k),
    r AS (SELECT *, CASE WHEN (pos >= a1 AND pos < b1) OR (pos >= a2 AND pos < b2) THEN 'test' WHEN (pos >= a1 - {PURGE} AND pos < a1) OR (pos >= b1 AND pos < b1 + {EMBARGO})
      OR (pos >= a2 - {PURGE} AND pos < a2) OR (pos >= b2 AND pos < b2 + {EMBARGO}) THEN 'purged' ELSE 'train' END AS role FROM e) {SIZES}""",
)(lambda s, d: (lambda x: fold_sizes(x[0], combinatorial(x[1])))(dated(s, d)))

TRAIN, TEST = 504, 63
query(
    "cv_walk_forward",
    f"""{PLACED}, d AS (SELECT DISTINCT date, place - 1 AS pos, n_days FROM placed), s AS (SELECT fold, {TRAIN} + fold * {TEST + EMBARGO} AS a FROM range(10000) r(fold)),
    f AS (SELECT * FROM d JOIN s ON a + {TEST} <= n_days)
    SELECT CAST(fold AS INTEGER) AS fold, count(*) FILTER (pos < a - {PURGE}) AS n_train, max(date) FILTER (pos < a - {PURGE}) AS train_end,
      min(date) FILTER (pos >= a) AS test_start, max(date) FILTER (pos < a + {TEST}) AS test_end FROM f GROUP BY fold""",
)(
    lambda s, d: dated(s, d)[1]
    .withColumn("fold", F.explode(F.when(C("n_days") >= TRAIN + TEST, F.sequence(F.lit(0), F.floor((C("n_days") - TRAIN - TEST) / (TEST + EMBARGO)).cast("int")))))
    .withColumn("a", TRAIN + C("fold") * (TEST + EMBARGO)).groupBy("fold")
    .agg(F.count_if(C("pos") < C("a") - PURGE).alias("n_train"), *(F.expr(x) for x in (f"max(date) FILTER (WHERE pos < a - {PURGE}) AS train_end", "min(date) FILTER (WHERE pos >= a) AS test_start", f"max(date) FILTER (WHERE pos < a + {TEST}) AS test_end")))
)
