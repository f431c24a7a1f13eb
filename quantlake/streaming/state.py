"""Streams with state: averages carried from batch to batch, sessions of events, and events delivered more than once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Averages(StatefulProcessor):
    """Exponential averages of a symbol's closes. The state is the last date, the closes counted and the averages so far."""

    def __init__(self, spans: tuple[int, ...]) -> None:
        self.spans = spans

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "last date, n long, " + ", ".join(f"a{s} double" for s in self.spans))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("date", kind="stable").drop_duplicates("date")
        last, n, *averages = self.seen.get() if self.seen.exists() else (None, 0, *[None] * len(self.spans))
        batch = batch if last is None else batch[batch["date"] > last]
        if not len(batch):
            return
        out = {f"ema_{s}": [] for s in self.spans}
        for close in batch["close"]:
            n += 1
            for k, s in enumerate(self.spans):
                a = 2 / (s + 1)
                averages[k] = float(close) if averages[k] is None else a * float(close) + (1 - a) * averages[k]
                out[f"ema_{s}"].append(averages[k] if n >= s // 2 else None)
        self.seen.update((batch["date"].iloc[-1], n, *averages))
        yield pd.DataFrame({"symbol": key[0], "date": batch["date"].to_numpy(), "close": batch["close"].to_numpy(float)} | {c: pd.array(v, "Float64") for c, v in out.items()})

    def close(self) -> None:
        pass


def carried_averages(bars: DataFrame, spans: tuple[int, ...] = (12, 26, 50)) -> DataFrame:
    """symbol, date, close and an ema of each span of a stream of bars (symbol, date, close).

    Days may be cut into batches anywhere, but come in order: a bar that is not later than its symbol's last is taken for one that was
    delivered before, and dropped. Null closes are left out. State has the size of the symbols.
    """
    schema = "symbol string, date date, close double, " + ", ".join(f"ema_{s} double" for s in spans)
    rows = bars.select("symbol", "date", "close").where("close IS NOT NULL AND date IS NOT NULL AND symbol IS NOT NULL").groupBy("symbol")
    return rows.transformWithStateInPandas(statefulProcessor=Averages(spans), outputStructType=schema, outputMode="Append", timeMode="None")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """user_id, start, finish (last event plus gap), n and total of each session; on a stream those that the watermark has closed."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    found = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("finish"), "n", "total")


def once(events: DataFrame, key: str = "event_id", late: str = "2 days") -> DataFrame:
    """Events without those delivered again within the watermark; ids are forgotten after it."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return (rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else rows.dropDuplicates([key])).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@contextmanager
def _rocks(spark: SparkSession):
    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, old)


def run(spark: SparkSession, source: str, schema: str, step: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> None:
    """Put what ``step`` makes of the new files of ``source`` into ``target``; state and bookmark are in ``checkpoint``, so each run
    goes on where the last one stopped."""
    with _rocks(spark):
        rows = step(spark.readStream.schema(schema).parquet(source))
        rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
