"""The lake: Parquet datasets partitioned by year or by day, rewritten partition by partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ("symbol", "series", "date")


def keep_last(rows: DataFrame, key: tuple[str, ...] = KEY, order: str = "batch") -> DataFrame:
    """One row a key: that of the latest ``order``."""
    newest = Window.partitionBy(*key).orderBy(F.desc(order))
    return rows.withColumn("_place", F.row_number().over(newest)).where("_place = 1").drop("_place", order)


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def _overwrite(rows: DataFrame, path: str, by: str) -> None:
    """Only the partitions that ``rows`` has are replaced, when the job commits; others stay. Rows are brought together by
    partition, and one that is large is split over tasks at run time."""
    writer = rows.hint("rebalance", F.col(by)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.option("compression", "zstd").partitionBy(by).parquet(path)


def write_years(spark: SparkSession, rows: DataFrame, path: str, key: tuple[str, ...] = KEY) -> None:
    """Merge ``rows`` with the years they touch; of rows with one key the new one stays, so ingesting again changes nothing."""
    new = rows.withColumn("year", F.year("date"))
    years = [r["year"] for r in new.select("year").distinct().collect()]
    if not years:
        raise ValueError("no rows to write")
    merged = new.withColumn("batch", F.lit(1))
    if _exists(spark, path):
        old = spark.read.parquet(path).where(F.col("year").isin(years)).withColumn("batch", F.lit(0))
        merged = merged.unionByName(old, allowMissingColumns=True)
    _overwrite(keep_last(merged, key), path, "year")


def write_partition(rows: DataFrame, path: str, by: str = "as_of") -> None:
    """Replace the partitions of ``by`` that ``rows`` has."""
    _overwrite(rows, path, by)


def read_prices(spark: SparkSession, path: str, symbols: list[str] | None = None, start: str | None = None, end: str | None = None, series: tuple[str, ...] = ("EQ",)) -> DataFrame:
    """Bars in a range of dates (both ends included); the range also prunes the years' folders."""
    rows = spark.read.parquet(path).where(F.col("series").isin(*series))
    if symbols is not None:
        rows = rows.where(F.col("symbol").isin(symbols))
    if start is not None:
        rows = rows.where((F.col("date") >= F.lit(start).cast("date")) & (F.col("year") >= int(start[:4])))
    if end is not None:
        rows = rows.where((F.col("date") <= F.lit(end).cast("date")) & (F.col("year") <= int(end[:4])))
    return rows
