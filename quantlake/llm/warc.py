"""Web archives: WARC records with revisits, read back into one index in the order of URL key and time."""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterable, Iterator
from typing import BinaryIO
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantlake.llm.common import Workspace, small_batches

END = "\r\n\r\n"
RECORDS_PER_FILE = 4000
#: Payload bytes of a file, about, and index entries that a task merges.
FILE_BYTES, ENTRIES = 128 << 20, 100_000
SHORTEST_REVISIT = 1000
#: Captures are dated by their page_id, modulo so many seconds from the start of 2024.
FIRST_SECOND, SECONDS = 1_704_067_200, 1_000_000_000
INDEX = (
    "urlkey string, captured string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, "
    "file string, offset long, length long, intact boolean"
)


def records(pages: DataFrame, work: Workspace) -> DataFrame:
    """One column, record: the text of a WARC record for every row of ``pages`` (page_id, url, html)."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("n", F.octet_length("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = F.when(F.col("n") >= SHORTEST_REVISIT, F.col("digest"))
    tops = rows.select(large.alias("_digest"), "page_id").where("_digest is not null").groupBy("_digest").agg(F.max("page_id").alias("top"), F.count("*").alias("c"))
    tops = work.save(tops.where("c > 1").drop("c"), "repeated")
    rows = rows.withColumn("_digest", large)
    small = rows.where("_digest is null").drop("_digest").withColumn("top", F.lit(None).cast("long"))
    rows = rows.where("_digest is not null").join(tops, "_digest", "left").drop("_digest").unionByName(small)
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n"), F.lit(END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")
    captured = F.date_format(F.timestamp_seconds(F.lit(FIRST_SECOND) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(SECONDS))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    head: list[str | Column] = [
        "WARC/1.1\r\nWARC-Type: ", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), "\r\nWARC-Record-ID: ", name(F.col("page_id")),
        "\r\nWARC-Date: ", captured, "\r\nWARC-Target-URI: ", uri, "\r\nWARC-Payload-Digest: sha1:", F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("top")))).otherwise(F.lit("")),
        "\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: ", F.octet_length(block), END, block,
    ]
    return rows.select(F.concat(*(F.lit(x) if isinstance(x, str) else x for x in head)).alias("record"))


def write(pages: DataFrame, path: str, work: Workspace) -> None:
    """Write gzip-compressed WARC files of at most RECORDS_PER_FILE records to a new folder ``path``.

    Of the rows with equal payloads of at least SHORTEST_REVISIT bytes those with the largest page_id are responses, the
    others revisits that refer to it. A null html is an empty payload, a null url an empty URI, and a null page_id is
    never the largest. Repeated rows are records of their own. Spark's text writer ends a record as WARC asks.
    """
    size, n = pages.agg(F.sum(F.octet_length("html")), F.count("*")).first()
    per_file = max(1, min(RECORDS_PER_FILE, FILE_BYTES * n // max(size or 1, 1)))
    out = records(pages, work).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file)
    out.text(path)


def url_key(url: str) -> str:
    """Host from the top domain down, then path and sorted query, in lower case."""
    try:
        parts = urlsplit(url.strip().lower())
        host = parts.hostname or ""
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return url.lower()
    host = ",".join(reversed(host.removeprefix("www.").split(".")))
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{host}{port}){parts.path or '/'}" + (f"?{query}" if query else "")


def parse(stream: BinaryIO) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and block of each record of an uncompressed archive; lengths are taken from the headers, and
    one record is held at a time."""
    at = 0
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        size, headers = len(first), {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            size += len(line)
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            headers[name] = value
        block = stream.read(int(headers["Content-Length"]))
        size += 2 + len(block) + len(stream.read(4))
        yield at, size, headers, block
        at += size


def index_entry(file: str, offset: int, length: int, headers: dict[str, str], block: bytes) -> tuple:
    def number(name: str) -> int | None:
        text = headers.get(name, "")[len("<urn:page:") : -1]
        return int(text) if text else None

    http, _, payload = block.partition(END.encode())
    stated = int(http.rpartition(b"Content-Length: ")[2])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = headers["WARC-Type"]
    intact = kind == "revisit" or (len(payload) == stated and hashlib.sha1(payload).hexdigest() == digest)
    uri = headers.get("WARC-Target-URI", "")
    return url_key(uri), headers["WARC-Date"], number("WARC-Record-ID"), kind, number("WARC-Refers-To"), stated, digest, file, offset, length, intact


def order_of(entry: tuple) -> tuple:
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0, entry[7], entry[8]


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The index entries (INDEX) of the archives in ``path``, those of each file sorted by URL key and time."""
    small_batches(spark)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                found = [index_entry(file.as_py(), *record) for record in parse(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())))]
                yield frame(sorted(found, key=order_of))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(work, INDEX)


def frame(entries: list[tuple]) -> pa.RecordBatch:
    """Entries as a batch of INDEX; ids stay whole numbers where some are null."""
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [c.split() for c in INDEX.split(", ")]
    columns = zip(*entries, strict=True) if entries else [()] * len(fields)
    return pa.record_batch([pa.array(x, kinds[kind]) for x, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


def merged(sources: Iterable[list[tuple]]) -> Iterator[tuple]:
    """k-way merge by a loser tree: each inner node holds the loser of its match, so a next entry costs log k matches."""
    lists = [x for x in sources if x]
    k = len(lists)
    if not k:
        return
    last = (1,)
    at = [0] * k
    keys = [(0, order_of(x[0]), i) for i, x in enumerate(lists)]
    losers = [-1] * k

    def play(i: int) -> int:
        node = (i + k) // 2
        while node:
            j = losers[node]
            if j == -1:
                losers[node] = i
                return -1
            if keys[j] < keys[i]:
                losers[node], i = i, j
            node //= 2
        return i

    winner = -1
    for i in range(k):
        winner = max(winner, play(i))
    while keys[winner] != last:
        run = lists[winner]
        yield run[at[winner]]
        at[winner] += 1
        keys[winner] = (0, order_of(run[at[winner]]), winner) if at[winner] < len(run) else last
        winner = play(winner)


def merge_runs(index: DataFrame) -> DataFrame:
    """All entries in one order of URL key and time: ranges of the keys, of about ENTRIES each, are dealt to tasks, each of
    which merges the runs' parts.

    A range ends between captures, not between URLs, so one URL's history may span tasks. Nothing is sorted again: a run's
    entries arrive in their order, and where the shuffle brings a run in several pieces, each piece is a run for the tree.
    """
    ranges = max(1, -(-index.count() // ENTRIES))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list[list[tuple]]] = {}
        for batch in batches:
            for entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pieces = parts.setdefault(entry[7], [[]])
                if pieces[-1] and order_of(entry) < order_of(pieces[-1][-1]):
                    pieces.append([])
                pieces[-1].append(entry)
        block: list[tuple] = []
        for entry in merged(piece for pieces in parts.values() for piece in pieces):
            block.append(entry)
            if len(block) == 5000:
                yield frame(block)
                block = []
        yield frame(block)

    return index.repartitionByRange(ranges, "urlkey", "captured", "page_id", "file", "offset").mapInArrow(work, INDEX)


def capture_history(spark: SparkSession, pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives to ``path``, read them back and merge their indexes (INDEX).

    See write() for nulls, ties and repeated rows. Times are the page_id's second from 2024 on, modulo SECONDS, as the table has
    none; so ids of any size and sign have a date of four digits, and text order is time order. A very
    long page is held by itself in the task that reads it; long pages make files of fewer records. An empty table gives an
    empty index; other columns are left out.
    """
    work = Workspace(spark, "warc")
    path = path or work.path("archives")
    write(pages, path, work)
    return merge_runs(work.save(runs(spark, path), "runs"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = capture_history(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
    broken = F.when(~F.col("intact"), F.raise_error(F.lit("a payload differs from its digest")))
    return history.select("page_id", "payload_bytes", F.coalesce(broken.cast("string"), "payload_digest").alias("payload_digest"), "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
     q AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d) END AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top <> page_id THEN top END AS refers_to
FROM q
"""
