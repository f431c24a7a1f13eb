"""What several of these operators need: shared intermediate tables, token hashes, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: documents can be long, so a batch is small.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20
#: Bytes that a task holds of an intermediate table before it writes them.
BLOCK_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


class Workspace:
    """Intermediate tables in the folder that all executors share (``spark.checkpoint.dir``).

    A written table cuts the lineage: a lost executor costs the running step, not the steps before it.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = os.path.join(tempfile.gettempdir(), "checkpoints")
        self.spark, self.root = spark, f"{base}/{name}-{uuid.uuid4().hex}"
        self.saved: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        path = self.path(f"{name}-{uuid.uuid4().hex[:8]}")
        df.write.option("parquet.block.size", BLOCK_BYTES).option("compression", compression).parquet(path)
        self.saved[path] = out = self.spark.read.schema(df.schema).parquet(path)
        return out

    def save_by(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """Like save(), in buckets of ``key``: later joins on it move the other side alone."""
        path, n = self.path(f"{name}-{uuid.uuid4().hex[:8]}"), int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"saved_{uuid.uuid4().hex}"
        spread = df.repartition(n, key).write.option("parquet.block.size", BLOCK_BYTES).option("compression", "zstd")
        spread.bucketBy(n, key).option("path", path).format("parquet").saveAsTable(table)
        self.saved[path] = out = self.spark.table(table)
        return out

    def keep(self, *tables: DataFrame) -> None:
        """Delete the tables that save() returned, but for ``tables``: those that a lazy result still reads."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in [p for p, df in self.saved.items() if not any(df is t for t in tables)]:
            del self.saved[path]
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


#: Spark then deletes the shuffle files of a query when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it, what a written table has shuffled is deleted once the table is there."""
    old = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, old)


#: A null doc_id comes after all others: its row has this bit, and the largest long for an id.
NO_ID, LARGEST_ID = 1 << 62, (1 << 63) - 1


def numbered(docs: DataFrame) -> DataFrame:
    """(row, doc, data): a number of each row's own, the order of its doc_id, and the bytes of its text (null: empty).

    Rows are ordered by doc and then row; so rows that share or lack a doc_id have places of their own. Write the result before
    it is read twice.
    """
    id_ = F.col("doc_id").cast("long")
    row = F.monotonically_increasing_id() + F.when(id_.isNull(), F.lit(NO_ID)).otherwise(F.lit(0))
    return docs.select(row.alias("row"), F.coalesce(id_, F.lit(LARGEST_ID)).alias("doc"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))


def id_text() -> Column:
    """doc_id as text: pandas would round large ids to doubles where some are null. Cast what comes back with as_long()."""
    return F.col("doc_id").cast("long").cast("string").alias("doc_id")


def as_long(rows: DataFrame) -> DataFrame:
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def doc_id() -> Column:
    """The doc_id of a row that numbered() made."""
    return F.when(F.col("row") < NO_ID, F.col("doc")).alias("doc_id")


def id_bucket(col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % modulus


class WordHashes(dict):
    """word bytes -> 64-bit hash; forgets all when it holds ``limit`` words."""

    def __init__(self, limit: int = 400_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit integers (xor-shift and odd multiplications)."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n word hashes; empty if there are fewer."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = hashes[: len(hashes) - n + 1].copy()
    for i in range(1, n):
        out *= _ODD
        out += hashes[i : len(hashes) - n + 1 + i]
    return mix(out)


def added_up(parts: DataFrame, size: int, tasks: int = 32) -> np.ndarray:
    """The sum of the arrays of ``size`` doubles in ``parts`` (one binary column, v). They are added up in ``tasks`` tasks, so the
    driver gets so many arrays however many there were."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for batch in batches:
            for v in batch["v"]:
                total += np.frombuffer(zlib.decompress(v))
        yield pd.DataFrame({"v": [packed(total)]})

    total = np.zeros(size)
    for row in parts.repartition(tasks).mapInPandas(add, "v binary").toLocalIterator():
        total += np.frombuffer(zlib.decompress(row["v"]))
    return total


def packed(total: np.ndarray) -> bytes:
    return zlib.compress(total.astype(float).tobytes(), 1)


def components(spark: SparkSession, work: Workspace, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of ``edges`` (a, b long, any direction).

    Alternating large-star and small-star steps, each written out. A node's minimum is a map-side combined
    aggregate; it is written before the join back, so the join can split a hub's rows over tasks.
    """
    e = work.save(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    state = None
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = work.save(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "low")
        e = work.save(
            both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large"
        )
        low = work.save(e.groupBy("a").agg(F.min("b").alias("m")), "low")
        near = e.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = work.save(near.union(low.select("a", F.col("m").alias("b"))).distinct(), "small")
        now = e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
        if now == state:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = now
