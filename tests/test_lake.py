"""The lake, layouts and streams: merging again changes nothing, other partitions stay, streams equal batches."""

import pytest
from pyspark.sql import functions as F

from quantlake.sources import lake, layouts
from quantlake.sources.bars import bars, dirty_bars, read
from quantlake.streaming.ingest import ingest, windowed
from tests.helpers import DATA


def some(spark):
    return bars(spark, DATA).withColumn("series", F.lit("EQ"))


def test_write_years_is_idempotent_and_keeps_the_last(spark, tmp_path):
    path, rows = str(tmp_path / "lake"), some(spark)
    lake.write_years(spark, rows, path)
    n = spark.read.parquet(path).count()
    changed = rows.where("year(date) = 1998").withColumn("close", F.lit(1.0))
    for _ in range(2):
        lake.write_years(spark, changed, path)
    after = spark.read.parquet(path)
    assert after.count() == n == rows.count()
    assert after.where("year = 1998 AND close <> 1").count() == 0 and after.where("year <> 1998 AND close = 1").count() == rows.where("year(date) <> 1998 AND close = 1").count()
    with pytest.raises(ValueError):
        lake.write_years(spark, rows.limit(0), path)
    got = lake.read_prices(spark, path, ["Brand#11"], "1997-03-01", "1998-02-28")
    assert got.count() == rows.where("symbol = 'Brand#11' AND date BETWEEN '1997-03-01' AND '1998-02-28'").count()
    assert "PartitionFilters: [isnotnull(year" in got._jdf.queryExecution().toString()


def test_layout_without_its_columns(spark):
    with pytest.raises(ValueError, match="columns missing"):
        layouts.normalise(spark.createDataFrame([("A", "EQ")], "SYMBOL string, SERIES string"))


def test_stream_of_windows_equals_batch(spark, tmp_path):
    events = read(spark, DATA, "events")
    events.write.parquet(str(tmp_path / "in"))
    stream = windowed(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), late="400 days")
    stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, windowed(events).collect()))


def test_ingest_reads_new_files_once(spark, tmp_path):
    at = {k: str(tmp_path / k) for k in ("in", "lake", "held", "checkpoint")}
    rows = dirty_bars(spark, DATA).withColumn("series", F.lit("EQ"))
    for years in ("year(date) < 1998", "year(date) >= 1998"):
        rows.where(years).write.mode("append").parquet(at["in"])
        ingest(spark, at["in"], rows.schema, at["lake"], at["held"], at["checkpoint"])
    good, bad = spark.read.parquet(at["lake"]).count(), spark.read.parquet(at["held"])
    assert good + bad.count() == rows.count() and bad.count() > 0 and bad.select("batch").distinct().count() == 2
