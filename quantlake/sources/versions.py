"""Tables that change while they are read: a log of runs with updates and deletions, and snapshots kept by market day.

Data files are never rewritten. What holds is named by a small pointer file that is replaced in one rename, so a reader sees
the state before a change or after it; files that no pointer names any more go only when they are vacuumed.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Pointer:
    """A JSON value in a file that is replaced whole."""

    spark: SparkSession
    path: str

    def _paths(self, *names: str):
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        paths = [jvm.org.apache.hadoop.fs.Path(n) for n in names]
        return jvm, conf, paths

    def read(self) -> dict | None:
        jvm, conf, (at,) = self._paths(self.path)
        fs = at.getFileSystem(conf)
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def replace(self, value: dict) -> None:
        jvm, conf, (at, new) = self._paths(self.path, f"{self.path}.{uuid.uuid4().hex}")
        stream = new.getFileSystem(conf).create(new)
        stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        stream.close()
        how = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf).rename(new, at, how)

    def delete(self, *folders: str) -> None:
        _, conf, paths = self._paths(*folders)
        for p in paths:
            p.getFileSystem(conf).delete(p, True)


# The columns of a run, and those that an update may set.
RUN = {
    "ticker": "string", "model_type": "string", "created_at": "string", "data_start": "string", "data_end": "string", "n_samples": "long", "n_features": "long", "horizon_days": "long",
    "label_threshold": "double", "hyperparams": "string", "feature_list": "string",
}
WRITABLE = {
    "oos_sharpe": "double", "oos_sortino": "double", "oos_max_dd": "double", "oos_turnover": "double", "cost_adjusted_sharpe": "double", "accuracy": "double", "precision": "double", "recall": "double",
    "model_artifact": "string", "status": "string", "evaluation_freq": "string", "permutation_p_value": "double", "n_permutations": "long", "null_sharpe_mean": "double", "null_sharpe_std": "double", "null_sharpe_95pct": "double",
}
FIELDS = RUN | WRITABLE


class RunLog:
    """Runs as a log of changes: each write is a batch with the next sequence number, and of a run's changes the newest of each column
    holds. A deletion hides what came before it. Batches are folders of their own, so writers never touch each other's files; a
    compaction folds them into one table, which the pointer then names.

    A read lists the batches once and names them, so it stays as it is whatever is written or compacted meanwhile. Two writers
    that start at once may share a sequence number; ties go to the later batch name. An update of an unknown run does nothing.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.pointer = spark, path, Pointer(spark, f"{path}/current")

    @property
    def schema(self) -> str:
        return "run_id string, sequence long, kind string, set array<string>, " + ", ".join(f"{k} {t}" for k, t in FIELDS.items())

    def _batches(self) -> list[tuple[int, str]]:
        """(sequence, folder) of each committed batch; a writer's folder counts once its job has left _SUCCESS."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        found = jvm.org.apache.hadoop.fs.Path(f"{self.path}/changes/*/_SUCCESS")
        listed = found.getFileSystem(conf).globStatus(found) or []
        folders = [s.getPath().getParent().toString() for s in listed]
        return sorted((int(f.rsplit("/", 1)[1].split("-")[0]), f) for f in folders)

    def _append(self, rows: DataFrame, kind: str, columns: list[str]) -> int:
        seen = [s for s, _ in self._batches()] + [(self.pointer.read() or {}).get("upto", 0)]
        sequence = max(seen) + 1
        full = rows.select(
            F.col("run_id").cast("string").alias("run_id"), F.lit(sequence).cast("long").alias("sequence"), F.lit(kind).alias("kind"), F.array(*map(F.lit, columns)).cast("array<string>").alias("set"),
            *((F.col(k).cast(t) if k in columns else F.lit(None).cast(t)).alias(k) for k, t in FIELDS.items()),
        )
        full.write.parquet(f"{self.path}/changes/{sequence:012d}-{uuid.uuid4().hex}")
        return sequence

    def log(self, rows: DataFrame) -> int:
        """Add runs (run_id and any of RUN; dicts and lists as JSON); status is trained. Returns the sequence number."""
        status = rows.withColumn("status", F.lit("trained"))
        return self._append(status, "log", [*(k for k in RUN if k in rows.columns), "status"])

    def update(self, rows: DataFrame) -> int | None:
        """Set the columns of ``rows`` that are WRITABLE; others are left as they are, and without any nothing is written."""
        columns = [k for k in rows.columns if k in WRITABLE]
        return self._append(rows, "update", columns) if columns else None

    def delete(self, rows: DataFrame) -> int:
        return self._append(rows, "delete", [])

    def changes(self) -> DataFrame:
        now = self.pointer.read() or {"upto": 0, "base": None}
        folders = [f for s, f in self._batches() if s > now["upto"]] + ([now["base"]] if now["base"] else [])
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def runs(self) -> DataFrame:
        """The newest state of every run that is not deleted."""
        return folded(self.changes()).drop("sequence")

    def get(self, run_id: str) -> DataFrame:
        """One run, with hyperparams as a map and feature_list as an array."""
        rows = folded(self.changes().where(F.col("run_id") == run_id)).drop("sequence")
        return rows.withColumn("hyperparams", F.from_json("hyperparams", "map<string,string>")).withColumn("feature_list", F.from_json("feature_list", "array<string>"))

    def count(self, ticker: str | None = None) -> int:
        rows = self.runs()
        return (rows if ticker is None else rows.where(F.col("ticker") == ticker)).count()

    def compact(self) -> None:
        """Fold what has been written into one table. Batches stay on disk until vacuum()."""
        batches = self._batches()
        if not batches:
            return
        upto = batches[-1][0]
        base = f"{self.path}/base/{uuid.uuid4().hex}"
        state = folded(self.changes().where(F.col("sequence") <= upto))
        full = state.select("run_id", "sequence", F.lit("log").alias("kind"), F.array(*map(F.lit, FIELDS)).alias("set"), *FIELDS)
        full.write.parquet(base)
        self.pointer.replace({"upto": upto, "base": base})

    def vacuum(self) -> None:
        """Delete batches that the present table holds; do so when nobody reads them any more."""
        now = self.pointer.read()
        if now:
            self.pointer.delete(*(f for s, f in self._batches() if s <= now["upto"]))


def folded(changes: DataFrame) -> DataFrame:
    """run_id, sequence and FIELDS of each run, from its changes since it was last deleted."""
    gone = F.max(F.when(F.col("kind") == "delete", F.col("sequence"))).over(Window.partitionBy("run_id"))
    live = changes.withColumn("_gone", F.coalesce(gone, F.lit(0))).where(F.col("sequence") > F.col("_gone"))

    def newest(k: str) -> Column:
        return F.max_by(k, F.when(F.array_contains("set", k), F.col("sequence"))).alias(k)

    out = live.groupBy("run_id").agg(F.max("sequence").alias("sequence"), F.max(F.col("kind") == "log").alias("_logged"), *map(newest, FIELDS))
    return out.where("_logged").drop("_logged")


@dataclass
class Snapshots:
    """Results kept as Parquet by key, each good for one market day and for ``ttl`` seconds.

    A new day or an old age means a new snapshot; beyond ``most`` keys the expired go first, else the oldest. The table of keys is a
    pointer, so it outlives the session and several sessions share it. A reader of a dropped snapshot keeps its files until vacuum().
    """

    spark: SparkSession
    path: str
    ttl: float = 900.0
    most: int = 5000
    hits: int = 0
    misses: int = 0
    clock: Callable[[], float] = field(default=time.time)

    @property
    def _pointer(self) -> Pointer:
        return Pointer(self.spark, f"{self.path}/current")

    def entries(self) -> dict[str, dict]:
        return self._pointer.read() or {}

    def get(self, key: str, day: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The snapshot of ``key`` as of market day ``day``; ``build`` makes it if there is none that holds."""
        entry = self.entries().get(key)
        if entry and entry["day"] == day and self.clock() - entry["at"] <= self.ttl:
            self.hits += 1
            return self.spark.read.parquet(entry["path"])
        self.misses += 1
        path = f"{self.path}/data/{uuid.uuid4().hex}"
        build().write.parquet(path)
        kept = self._evicted({k: e for k, e in self.entries().items() if k != key})
        self._pointer.replace(kept | {key: {"path": path, "day": day, "at": self.clock()}})
        return self.spark.read.parquet(path)

    def _evicted(self, entries: dict[str, dict]) -> dict[str, dict]:
        if len(entries) < self.most:
            return entries
        fresh = {k: e for k, e in entries.items() if self.clock() - e["at"] <= self.ttl}
        if len(fresh) < len(entries):
            return fresh
        oldest = min(entries, key=lambda k: entries[k]["at"])
        return {k: e for k, e in entries.items() if k != oldest}

    def invalidate(self, key: str) -> bool:
        entries = self.entries()
        if key not in entries:
            return False
        self._pointer.replace({k: e for k, e in entries.items() if k != key})
        return True

    def clear(self) -> None:
        self._pointer.replace({})

    def stats(self) -> dict[str, float]:
        asked = self.hits + self.misses
        return {"size": len(self.entries()), "hits": self.hits, "misses": self.misses, "hit_rate": round(self.hits / asked, 4) if asked else 0.0, "ttl_seconds": self.ttl, "max_entries": self.most}

    def vacuum(self) -> None:
        """Delete snapshots that no key names."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        if folder.getFileSystem(conf).exists(folder):
            named = {e["path"].rsplit("/", 1)[1] for e in self.entries().values()}
            listed = [s.getPath() for s in folder.getFileSystem(conf).listStatus(folder)]
            self._pointer.delete(*(p.toString() for p in listed if p.getName() not in named))
