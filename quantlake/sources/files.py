"""Files as they come: names and addresses by day, archives of text, and a folder of day files read by preference."""

from __future__ import annotations

import csv
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The first day of the unified layout, and the names of day files.
UNIFIED_FROM = "2024-07-08"
PREFERENCE = {"unified": ("unified", "delivery"), "legacy": ("delivery", "equity")}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share; a machine's own only on a local master."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "scratch")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def month(day: Column) -> Column:
    return F.upper(F.date_format(day, "MMM"))


def equity_url(day: Column, base: str) -> Column:
    return F.concat(F.lit(f"{base}/content/historical/EQUITIES/"), F.date_format(day, "yyyy"), F.lit("/"), month(day), F.lit("/cm"), F.date_format(day, "dd"), month(day), F.date_format(day, "yyyy"), F.lit("bhav.csv.zip"))


def delivery_url(day: Column, base: str) -> Column:
    return F.concat(F.lit(f"{base}/products/content/sec_bhavdata_full_"), F.date_format(day, "ddMMyyyy"), F.lit(".csv"))


def unified_url(day: Column, base: str) -> Column:
    return F.concat(F.lit(f"{base}/content/cm/BhavCopy_NSE_CM_0_0_0_"), F.date_format(day, "yyyyMMdd"), F.lit("_F_0000.csv.zip"))


def candidates(day: Column) -> Column:
    """Kinds of file to try for a day, richest first."""
    kinds = {k: F.array(*map(F.lit, v)) for k, v in PREFERENCE.items()}
    return F.when(day >= F.lit(UNIFIED_FROM).cast("date"), kinds["unified"]).otherwise(kinds["legacy"])


def decoded(content: bytes) -> tuple[list[str], list[list[str | None]]]:
    """Header and rows of a CSV file, or of the first one in a zip archive. All values are text; only an empty one is null."""
    if content[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            content = archive.read(next(n for n in archive.namelist() if n.lower().endswith(".csv")))
    rows = csv.reader(io.StringIO(content.decode()))
    header = next(rows, [])
    return header, [[x if x != "" else None for x in row] for row in rows]


def decode(files: DataFrame, columns: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``files`` (content) as text ``columns``, with the columns ``keep`` of the file; a column it lacks is null."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, content in enumerate(batch["content"]):
                header, rows = decoded(content)
                frame = pd.DataFrame(rows, columns=[h.strip() for h in header], dtype=object).reindex(columns=columns)
                yield frame.assign(**{c: batch[c].iloc[k] for c in keep})

    kinds = dict(files.dtypes)
    schema = ", ".join([*(f"`{c}` string" for c in columns), *(f"`{c}` {kinds[c]}" for c in keep)])
    return files.select(*keep, "content").mapInPandas(work, schema)


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """Write one small file to any file system that Spark reaches."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    stream.write(bytearray(content))
    stream.close()


def has_data(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds a Parquet file at any depth."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return False
    files = system.listFiles(folder, True)
    while files.hasNext():
        if files.next().getPath().getName().endswith(".parquet"):
            return True
    return False
