"""A folder of day files as a data source, ``spark.read.format("day_files")``: a partition a day or some days, for batches and streams.

Which of a day's files is read is settled when the read is planned: the first kind in the order of preference that is there. Files are
reached by pyarrow's file systems, so the folder can be in any store that those know.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quantlake.sources.files import PREFERENCE, UNIFIED_FROM, decoded

# Names of day files, with the format of the day in them.
NAMES = {"unified": (r"BhavCopy_.*_(\d{8})_F_0000\.csv", "%Y%m%d"), "delivery": (r"sec_bhavdata_full_(\d{8})\.csv", "%d%m%Y"), "equity": (r"cm(\d{2}[A-Z]{3}\d{4})bhav\.csv", "%d%b%Y")}


def name_of(kind: str, day: datetime.date) -> str:
    """The name of a day's file of a kind."""
    if kind == "unified":
        return f"BhavCopy_NSE_CM_0_0_0_{day:%Y%m%d}_F_0000.csv"
    return f"sec_bhavdata_full_{day:%d%m%Y}.csv" if kind == "delivery" else f"cm{day:%d}{day.strftime('%b').upper()}{day:%Y}bhav.csv"


def what(name: str) -> tuple[datetime.date, str] | None:
    """Day and kind of a file by its name (with .zip or not); None if it is no day file."""
    for kind, (pattern, form) in NAMES.items():
        if found := re.fullmatch(pattern + r"(\.zip)?", name):
            try:
                return datetime.datetime.strptime(found[1].title(), form).date(), kind
            except ValueError:
                return None
    return None


def preferred(day: datetime.date) -> tuple[str, ...]:
    return PREFERENCE["unified" if day.isoformat() >= UNIFIED_FROM else "legacy"]


def system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path)


@dataclass
class Day:
    day: datetime.date
    kind: str
    path: str


@dataclass
class Days(InputPartition):
    """Days that one task reads."""

    days: list[Day]


def dealt(days: list[Day], size: int) -> list[Days]:
    return [Days(days[i : i + size]) for i in range(0, len(days), size)]


def days_in(folder: str, after: str = "", upto: str = "9999") -> list[Day]:
    """The preferred file of each day after ``after`` up to ``upto`` (ISO dates); days with none of their kinds are left out."""
    fs, root = system(folder)
    found: dict[datetime.date, dict[str, str]] = {}
    for info in fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True)):
        if info.type == pyarrow.fs.FileType.File and (known := what(info.base_name)) and after < known[0].isoformat() <= upto:
            found.setdefault(known[0], {})[known[1]] = info.path
    best = ((day, next((k for k in preferred(day) if k in kinds), None), kinds) for day, kinds in sorted(found.items()))
    return [Day(day, kind, kinds[kind]) for day, kind, kinds in best if kind]


class _Rows:
    folder: str
    size: int

    def read(self, partition: Days | None) -> Iterator[tuple]:
        fs, _ = system(self.folder)
        for one in partition.days if partition else []:
            with fs.open_input_stream(one.path, compression=None) as stream:
                header, rows = decoded(stream.read())
            header = [h.strip() for h in header]
            for row in rows:
                yield one.day, one.kind, dict(zip(header, row, strict=False))


class DayReader(_Rows, DataSourceReader):
    def __init__(self, folder: str, size: int, after: str, upto: str) -> None:
        self.folder, self.size, self.after, self.upto = folder, size, after, upto

    def partitions(self) -> list[Days]:
        return dealt(days_in(self.folder, self.after, self.upto), self.size)


class DayStream(_Rows, DataSourceStreamReader):
    """Offsets are days: a batch holds the days after the last one read. A file that comes late for an earlier day is not read."""

    def __init__(self, folder: str, size: int) -> None:
        self.folder, self.size = folder, size

    def initialOffset(self) -> dict:
        return {"day": ""}

    def latestOffset(self) -> dict:
        days = days_in(self.folder)
        return {"day": days[-1].day.isoformat() if days else ""}

    def partitions(self, start: dict, end: dict) -> list[Days]:
        return dealt(days_in(self.folder, start["day"], end["day"]), self.size)

    def commit(self, end: dict) -> None:
        pass


class DayFiles(DataSource):
    """date, kind and row (column to text) of the day files in ``path``; the options after and upto (ISO dates) bound the days,
    and daysPerPartition (1) says how many of them a task reads."""

    @classmethod
    def name(cls) -> str:
        return "day_files"

    def schema(self) -> str:
        return "date date, kind string, row map<string,string>"

    def reader(self, schema) -> DayReader:
        return DayReader(self.options["path"], self._size(), self.options.get("after", ""), self.options.get("upto", "9999"))

    def streamReader(self, schema) -> DayStream:
        return DayStream(self.options["path"], self._size())

    def _size(self) -> int:
        return int(self.options.get("daysPerPartition", "1"))


def read_days(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    spark.dataSource.register(DayFiles)
    return spark.read.format("day_files").options(**options).load(folder)


def stream_days(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(DayFiles)
    return spark.readStream.format("day_files").load(folder)


def write_days(rows: DataFrame, folder: str, columns: list[str]) -> int:
    """Write ``rows`` (date, kind, columns) as one CSV file a day and kind, each by the task that has it; returns how many. Writing again
    replaces a file by the same."""

    def work(group):
        import pandas as pd

        day, kind = group["date"].iloc[0], group["kind"].iloc[0]
        fs, root = system(folder)
        fs.create_dir(root, recursive=True)
        lines = group.sort_values(columns)[columns].to_csv(index=False)
        with fs.open_output_stream(f"{root}/{name_of(kind, day)}") as out:
            out.write(lines.encode())
        return pd.DataFrame({"n": [1]})

    return rows.select("date", "kind", *(F.col(c).cast("string").alias(c) for c in columns)).groupBy("date", "kind").applyInPandas(work, "n int").count()
