"""The log of runs, and panels kept by market day, as queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantlake.plans.market import C, query
from quantlake.plans.refit import DESIGN, design
from quantlake.plans.chains import placed
from quantlake.sources.files import scratch
from quantlake.sources.versions import RunLog, Snapshots


def history(spark: SparkSession, sf_dir: str, upto: int, compacted: bool = False) -> RunLog:
    """A run for each labelled document, and the first ``upto`` of five batches of changes: logged; scored, some with a column that
    may not be set; evaluated; deleted; logged again."""
    log = RunLog(spark, scratch(spark, "runs"))
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.concat(F.lit("run-"), C("doc_id")).alias("run_id"), F.concat(F.lit("T"), C("doc_id") % 3).alias("ticker"))
    facts = {"model_type": F.lit("linear"), "n_samples": C("doc_id") * 10, "hyperparams": F.to_json(F.struct((C("doc_id") % 7).alias("depth"), F.lit(0.05).alias("rate")))}
    made = rows.withColumns(facts | {"feature_list": F.to_json(F.when(C("doc_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))))})
    batches = [
        lambda: log.log(made),
        lambda: log.update(made.where("doc_id % 3 = 0").select("run_id", (C("doc_id") * 37 % 100 / 100.0).alias("oos_sharpe"), F.lit("no").alias("ticker"))),
        lambda: log.update(made.where("doc_id % 5 = 0").select("run_id", F.lit("evaluated").alias("status"), F.when(C("doc_id") % 2 == 0, 2.5).alias("oos_sharpe"))),
        lambda: log.delete(made.where("doc_id % 7 = 0")),
        lambda: log.log(made.where("doc_id % 14 = 0").withColumn("ticker", F.lit("again"))),
    ]
    for k, batch in enumerate(batches[:upto]):
        batch()
        if compacted and k % 2:
            log.compact()
    return log


RUNS = """WITH r AS (SELECT doc_id, 'run-' || doc_id AS run_id, 'T' || (doc_id % 3) AS ticker, doc_id * 10 AS n_samples, doc_id % 7 AS depth, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS n_names,
    CASE WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 2.5 END WHEN doc_id % 3 = 0 THEN doc_id * 37 % 100 / 100.0 END AS sharpe, CASE WHEN doc_id % 5 = 0 THEN 'evaluated' ELSE 'trained' END AS status FROM labels)"""
COLUMNS = ("run_id", "ticker", "n_samples", "oos_sharpe", "status")
query("regi_log_run", f"{RUNS} SELECT run_id, ticker, n_samples, 'trained' AS status, n_names, CAST(depth AS VARCHAR) AS depth FROM r")(
    lambda s, d: history(s, d, 1).runs().select("run_id", "ticker", "n_samples", "status", F.size(F.from_json("feature_list", "array<string>")).alias("n_names"), F.from_json("hyperparams", "map<string,string>")["depth"].alias("depth"))
)
query("regi_update_run", f"{RUNS} SELECT run_id, ticker, n_samples, sharpe AS oos_sharpe, status FROM r")(lambda s, d: history(s, d, 3, compacted=True).runs().select(*COLUMNS))
LIVE = "l AS (SELECT * FROM r WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id, run_id, 'again', n_samples, depth, n_names, NULL, 'trained' FROM r WHERE doc_id % 14 = 0)"
query("regi_delete_run", f"{RUNS}, {LIVE} SELECT run_id, ticker, n_samples, sharpe AS oos_sharpe, status FROM l")(lambda s, d: history(s, d, 5, compacted=True).runs().select(*COLUMNS))
query("regi_count", f"{RUNS}, {LIVE} SELECT ticker, count(*) AS n FROM l GROUP BY ticker")(lambda s, d: history(s, d, 5).runs().groupBy("ticker").agg(F.count("*").alias("n")))


def regi_get_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest run of the table, by id, with its JSON columns read back."""
    log = history(spark, sf_dir, 5, compacted=True)
    last = spark.read.parquet(f"{sf_dir}/labels.parquet").where("doc_id % 14 = 0").agg(F.max("doc_id")).first()[0]
    return log.get(f"run-{last}").select(*COLUMNS, C("hyperparams")["depth"].alias("depth"), F.array_join("feature_list", ",").alias("names"))


query("regi_get_run", f"{RUNS}, {LIVE} SELECT run_id, ticker, n_samples, sharpe AS oos_sharpe, status, CAST(depth AS VARCHAR) AS depth, 'a,b' AS names FROM l WHERE doc_id = (SELECT max(doc_id) FROM labels WHERE doc_id % 14 = 0)")(regi_get_run)

# Panels by market day: the second request of a day reads the snapshot, a new day makes a new one


def kept_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """step, hit, rows and the latest date of five requests: a day's panel twice, the next day's, a part of the symbols, the day again."""
    cache, rows = Snapshots(spark, scratch(spark, "panels"), most=2), design(placed(spark, sf_dir))
    days = [r["date"] for r in rows.select("date").distinct().orderBy(F.desc("date")).limit(2).collect()]
    out = []
    for key, day in (("all", days[1]), ("all", days[1]), ("all", days[0]), ("few", days[0]), ("all", days[0])):
        before = cache.hits
        asked = rows.where(C("date") <= F.lit(day)).where("symbol < 'Brand#2'" if key == "few" else "true")
        got = cache.get(key, str(day), lambda asked=asked: asked).agg(F.count("*").alias("n"), F.max("date").alias("last")).first()
        out.append((len(out), key, cache.hits > before, got["n"], got["last"]))
    return spark.createDataFrame(out, "step int, key string, hit boolean, n long, last date")


PANELS = f"""{DESIGN}, t AS (SELECT max(date) AS d0, (SELECT max(date) FROM d WHERE date < (SELECT max(date) FROM d)) AS d1 FROM d), q(step, key, hit) AS (VALUES (0, 'all', false), (1, 'all', true), (2, 'all', false), (3, 'few', false), (4, 'all', true))
    SELECT step, key, hit, count(*) AS n, max(date) AS last FROM q, t, d WHERE date <= CASE WHEN step < 2 THEN d1 ELSE d0 END AND (key = 'all' OR symbol < 'Brand#2') GROUP BY step, key, hit"""
query("srv_panel_cache", PANELS)(kept_panels)


def cch_trading_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest day's bars, read through the cache after another day's had been kept under the same key."""
    cache, rows = Snapshots(spark, scratch(spark, "days")), placed(spark, sf_dir).select("symbol", "date", "close", "place", "n_days")
    for back in (1, 0, 0):
        day = rows.where(C("place") == C("n_days") - back)
        last = cache.get("bars", f"{back} days back", lambda day=day: day)
    return last.withColumn("hits", F.lit(cache.hits)).withColumn("misses", F.lit(cache.misses)).drop("place", "n_days")


query("cch_trading_day", f"{DESIGN.split(', d0 AS')[0]} SELECT symbol, date, close, 1 AS hits, 2 AS misses FROM placed WHERE place = n_days")(cch_trading_day)
