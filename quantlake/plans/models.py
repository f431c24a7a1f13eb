"""Out-of-fold model scores, statistics of Sharpe ratios, renamed symbols and symbols that go missing.

Queries without SQL: mdl_oof and mdl_meta_scores (iterative fits).
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantlake.functions import windows as fw
from quantlake.operators.descent import Descent
from quantlake.plans.labels import purged_panel
from quantlake.plans.market import QUERIES, C, query
from quantlake.sources.bars import bars, bars_sql, by_symbol
from quantlake.sources.files import scratch

# Out-of-fold scores: every fold's models see only days before its test days, less the purged ones

FEATURES = ("roc", "range", "volume_ratio", "vs_sma")
SPLITS, LEAST_TRAIN, PURGE = 3, 150, 4
#: Rows of a part of what a fit reads. Each of its many jobs sends the driver a result from every part.
PART_ROWS = 200_000


def features_of(rows: DataFrame) -> DataFrame:
    """symbol, date, FEATURES and y (whether the close is higher four bars on)."""
    return rows.select(
        "symbol", "date", (C("close") / F.lag("close", 4).over(by_symbol()) - 1).alias("roc"), ((C("high") - C("low")) / C("close")).alias("range"),
        (C("volume") / fw.rolling(F.avg, C("volume"), 20, 5)).alias("volume_ratio"), (C("close") / fw.sma(C("close"), 20) - 1).alias("vs_sma"),
        (F.lead("close", 4).over(by_symbol()) > C("close")).cast("double").alias("y"),
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features_of(bars(spark, sf_dir)).dropna(subset=[*FEATURES, "y"])


def roles(rows: DataFrame) -> DataFrame:
    days = rows.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)
    days = days.withColumn("n_days", F.count("*").over(Window.partitionBy()))
    return purged_panel(days, SPLITS, LEAST_TRAIN, PURGE).where("role IN ('train', 'test')").select("date", "fold", "role")


def learners() -> dict:
    return {
        "linear": LogisticRegression(featuresCol="x", labelCol="y", regParam=0.01, elasticNetParam=0.15),
        "forest": RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=20, maxDepth=6, minInstancesPerNode=50, seed=1),
        "network": MultilayerPerceptronClassifier(featuresCol="x", labelCol="y", layers=[len(FEATURES), 32, 16, 2], maxIter=15, seed=1),
        "descent": Descent(featuresCol="x", labelCol="y", maxIter=15, stepSize=1.0),
        "boosted": GBTClassifier(featuresCol="x", labelCol="y", maxDepth=4, maxIter=10, stepSize=0.05, seed=1),
    }


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a table of their own, so that later passes do not go back to the trades."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def prepared(rows: DataFrame, names: list[str]):
    """``names`` assembled and standardised, as x."""
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="x0"), StandardScaler(inputCol="x0", outputCol="x", withMean=True)]).fit(rows)


def in_parts(rows: DataFrame, n: int) -> DataFrame:
    """x and y of ``n`` rows (symbol, date, x, y), in as many parts as they need and in an order of their own: seeded learners see
    the same rows in the same places however the trades were read."""
    spread = rows.select("symbol", "date", "x", "y").repartition(max(1, math.ceil(n / PART_ROWS)), "symbol", "date")
    return spread.sortWithinPartitions("symbol", "date").select("x", "y")


def out_of_fold(rows: DataFrame, folds: DataFrame, least_rows: int = 500, chosen: dict | None = None) -> DataFrame:
    """symbol, date, fold, y and one column a learner of ``chosen`` (all by default). A fold with too few rows or one class is left
    out. The scores are written out, so nothing stays in memory. ``rows`` are read once for each fold: see written()."""
    out, chosen = None, chosen or learners()
    placed = rows.join(folds, "date")
    sizes = placed.where("role = 'train'").groupBy("fold").agg(F.count("*").alias("n"), F.countDistinct("y").alias("kinds")).collect()
    for fold, n in sorted((r["fold"], r["n"]) for r in sizes if r["n"] >= least_rows and r["kinds"] == 2):
        part = placed.where(C("fold") == fold)
        train, test = part.where("role = 'train'"), part.where("role = 'test'")
        ready = prepared(train, list(FEATURES))
        scored = ready.transform(test).select("symbol", "date", "fold", "y", "x")
        known = in_parts(ready.transform(train), n).persist()
        for name, learner in chosen.items():
            scored = learner.fit(known).transform(scored).withColumn(name, vector_second("probability")).drop("probability", "rawPrediction", "prediction")
        known.unpersist()
        out = scored.drop("x") if out is None else out.unionByName(scored.drop("x"))
    if out is None:
        return rows.where("false").selectExpr("symbol", "date", "0 AS fold", "y", *(f"0e0 AS {name}" for name in chosen))
    return written(out, "out-of-fold")


def vector_second(name: str) -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col(name))[1]


def mdl_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(panel(spark, sf_dir), "panel")
    return out_of_fold(rows, written(roles(rows), "roles"))


def mdl_meta_scores(spark: SparkSession, sf_dir: str, oof: DataFrame | None = None) -> DataFrame:
    """A logistic stack over the out-of-fold scores; like the scores' own level it is fitted in sample, hence the name."""
    scored = VectorAssembler(inputCols=list(learners()), outputCol="x").transform(mdl_oof(spark, sf_dir) if oof is None else oof)
    model = LogisticRegression(featuresCol="x", labelCol="y", probabilityCol="p").fit(scored)
    return model.transform(scored).select("symbol", "date", "fold", "y", vector_second("p").alias("meta_in_sample"))


# Sharpe ratios: whether they exceed a benchmark, given length, skew and tails

EULER, BENCHMARK, CONFIDENCE = 0.5772156649015329, 0.0, 0.95
Z = NormalDist().inv_cdf(CONFIDENCE)
MOMENTS = f"""{bars_sql()}, r AS (SELECT symbol, ln(close / prev_close) AS r FROM bars WHERE prev_close IS NOT NULL), a AS (SELECT *, avg(r) OVER (PARTITION BY symbol) AS m, stddev_pop(r) OVER (PARTITION BY symbol) AS sd FROM r),
    k AS (SELECT symbol, count(*) AS n, avg(r) / stddev_samp(r) AS sr, avg(pow((r - m) / sd, 3)) AS skew, avg(pow((r - m) / sd, 4)) AS kurt FROM a GROUP BY symbol)"""


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars(spark, sf_dir).where("prev_close IS NOT NULL").select("symbol", F.ln(C("close") / C("prev_close")).alias("r")).groupBy("symbol")
    return rows.agg(F.count("*").alias("n"), (F.avg("r") / F.stddev_samp("r")).alias("sr"), F.skewness("r").alias("skew"), (F.kurtosis("r") + 3).alias("kurt"))


def spread() -> Column:
    return 1 - C("skew") * C("sr") + (C("kurt") - 1) / 4 * C("sr") * C("sr")


query("st_moments", f"{MOMENTS} SELECT symbol, n, round(sr, 8) AS sr, round(skew, 6) AS skew, round(kurt, 6) AS kurt FROM k")(
    lambda s, d: moments(s, d).select("symbol", "n", F.round("sr", 8).alias("sr"), F.round("skew", 6).alias("skew"), F.round("kurt", 6).alias("kurt"))
)
query("st_min_trl", f"{MOMENTS} SELECT symbol, CASE WHEN sr <= {BENCHMARK} THEN NULL ELSE ceil(1 + (1 - skew * sr + (kurt - 1) / 4 * sr * sr) * pow({Z!r} / (sr - {BENCHMARK}), 2)) END AS least_length FROM k")(
    lambda s, d: moments(s, d).select("symbol", F.when(C("sr") > BENCHMARK, F.ceil(1 + spread() * F.pow(Z / (C("sr") - BENCHMARK), F.lit(2))).cast("double")).alias("least_length"))
)
QUERIES |= {"mdl_oof": mdl_oof, "mdl_meta_scores": mdl_meta_scores}

# Renamed symbols: the earliest edge of a symbol in force counts; a chain of renames ends where it would come back

AS_OF = "2000-01-01"
RENAMES = (("Brand#1", "Brand#2N", "1996-01-01"), ("Brand#2N", "Brand#3N", "1997-01-01"), ("Brand#3N", "Brand#4N", "2001-01-01"), ("Brand#5", "Brand#6N", "1998-01-01"), ("Brand#6N", "Brand#5", "1999-01-01"))
EDGES = f"""edges AS (SELECT old, new FROM (SELECT old, new, row_number() OVER (PARTITION BY old ORDER BY effective) AS r FROM (VALUES {", ".join(f"('{a}', '{b}', DATE '{c}')" for a, b, c in RENAMES)}) AS v(old, new, effective)
      WHERE effective <= DATE '{AS_OF}') AS x WHERE r = 1)"""


def current_names(spark: SparkSession) -> DataFrame:
    """old and its present name; the table of renames is small, and a chain has at most as many steps as it has rows."""
    edges = spark.createDataFrame(RENAMES, "old string, new string, effective string").where(C("effective") <= AS_OF)
    edges = edges.groupBy("old").agg(F.min_by("new", "effective").alias("new"))
    found = edges.select("old", "new", F.array("old", "new").alias("path"))
    step = edges.select(C("old").alias("from"), C("new").alias("to"))
    for _ in range(len(RENAMES) - 1):
        onward = C("to").isNotNull() & ~F.array_contains("path", C("to"))
        found = found.join(step, C("new") == C("from"), "left").select("old", F.when(onward, C("to")).otherwise(C("new")).alias("new"), F.when(onward, F.array_append("path", C("to"))).otherwise(C("path")).alias("path"))
    return found.select("old", "new")


NAMES = f"WITH RECURSIVE {EDGES}, c(old, new, path) AS (SELECT old, new, [old, new] FROM edges UNION ALL SELECT c.old, e.new, list_append(c.path, e.new) FROM c JOIN edges e ON e.old = c.new WHERE NOT list_contains(c.path, e.new)), names AS (SELECT old, arg_max(new, len(path)) AS new FROM c GROUP BY old)"
query("join_apply_map", f"{NAMES}, {bars_sql().removeprefix('WITH ')} SELECT coalesce(new, symbol) AS symbol, symbol AS original_symbol, date, close FROM bars LEFT JOIN names ON old = symbol")(
    lambda s, d: bars(s, d).join(current_names(s), C("symbol") == C("old"), "left").select(F.coalesce("new", "symbol").alias("symbol"), C("symbol").alias("original_symbol"), "date", "close")
)
