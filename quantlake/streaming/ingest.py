"""Streams: windowed counts of events, and bars that arrive by day, checked and merged into the lake."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantlake.plans.market import OWNER
from quantlake.sources import lake


def windowed(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """start, event_type and n of tumbling windows; on a stream, events later than ``late`` are dropped by the watermark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    counts = rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def ingest(spark: SparkSession, source: str, schema: str, target: str, held: str, checkpoint: str) -> None:
    """Read the files of ``source`` that no run has read, hold back rows that break a row rule, merge the rest.

    The checkpoint is the bookmark. A batch that runs twice gives the same lake; its held rows are a partition of their own.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        checked = batch.withColumn("held_by", F.expr(OWNER)).persist()
        good = checked.where("held_by IS NULL").drop("held_by")
        if not good.isEmpty():
            lake.write_years(spark, good, target)
        bad = checked.where("held_by IS NOT NULL").withColumn("batch", F.lit(batch_id))
        if not bad.isEmpty():
            lake.write_partition(bad, held, "batch")
        checked.unpersist()

    rows = spark.readStream.schema(schema).parquet(source)
    rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
