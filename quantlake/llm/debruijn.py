"""Removal of repeated passages of words, by a De Bruijn graph of token k-mers and its nonbranching paths.

An edge of the graph is a window of K words; an edge that occurs again is to be removed at all its places but the first.

1. Edges. Consecutive windows that share their least Q-gram (its minimizer) are dealt as one run. Runs go to the
   hash of their minimizer; equal windows have equal minimizers, so they meet. Q-grams that many documents have come last
   in the order of minimizers, so that a window goes to one of them only if it has no other. What repeats within a task is
   settled there: a frequent run travels once a task.
2. Branches. All places of a run but the first point to the first. Where runs with the same minimizer differ, their edges
   branch: the windows of the first places become rows, are joined with the least place of each window, and point there.
3. Paths. Pointers of a document that lead on to consecutive places of one document are a nonbranching path: they are
   compacted to one row with its coordinates there and at the source.
4. Verification. The words of each path are compared with those at its source by joins on both coordinates.

The table of texts is kept in buckets of its row, so the joins of steps 2 and 4 and the removal move coordinates, not texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantlake.llm.common import WordHashes, Workspace, doc_id, mix, ngram_hashes, numbered, small_batches

K, Q = 20, 8
#: Q-grams that at least COMMON of some SAMPLE documents have are common, the MOST_COMMON first. This settles where windows
#: travel, not what is found.
SAMPLE, COMMON, MOST_COMMON = 4000, 8, 1 << 16
#: Runs that a task settles at a time, and rows that it looks at together after the shuffle.
CHUNK, BLOCK = 400_000, 100_000
#: Words of a text for which one row asks.
PART = 1 << 16
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
RUN = np.dtype([("h", "u8"), ("c", "u8"), ("doc", "i8"), ("row", "i8"), ("at", "i8")])


class Spans:
    """Hashes of spans of a text's words, from sums of word hashes times powers of an odd number, modulo 2^64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(words):
            n = 2 * len(words) + 1
            power = lambda base: np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)], dtype=np.uint64)
            self.up, self.down = power(_BASE), power(_INVERSE)
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * self.up[: len(words)], out=sums[1:])
        return mix((sums[end] - sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))


def runs(words: np.ndarray, k: int, common: np.ndarray, spans: Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, windows, minimizer and hash of the words of each run of a text with ``words`` (hashes)."""
    grams = ngram_hashes(words, Q)
    order = grams >> np.uint64(1)
    if len(common):
        order |= (common[np.minimum(np.searchsorted(common, grams), len(common) - 1)] == grams).astype(np.uint64) << np.uint64(63)
    least = np.lib.stride_tricks.sliding_window_view(order, k - Q + 1).argmin(1) + np.arange(len(words) - k + 1)
    begin = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    end = np.r_[begin[1:], len(least)]
    return begin, end - begin, grams[least[begin]], spans.of(words, begin, end + k - 1)


def common_grams(texts: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Sorted hashes of the Q-grams that COMMON documents of a sample have."""

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            for data in batch["data"]:
                yield pd.DataFrame({"g": np.unique(ngram_hashes(hashes.of(data.split()), Q)).view(np.int64)})

    n = texts.count()
    some = texts.select("data").sample(min(1.0, sample / max(n, 1)), 7).mapInPandas(grams, "g long")
    found = some.groupBy("g").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "g").limit(MOST_COMMON).collect()
    return np.sort(np.array([r["g"] for r in found], np.int64).view(np.uint64))


def settle(some: np.ndarray, k_bits: int) -> np.ndarray:
    """Of runs that are equal here only the first stays open; the others become settled rows that point to it.

    A settled row has bit 0 of ``at`` set, the place it points to in (c, doc), and a key of its own in h.
    """
    order = np.lexsort((some["at"], some["row"], some["doc"], some["c"], some["h"]))
    some = some[order]
    first = np.ones(len(some), bool)
    first[1:] = (some["h"][1:] != some["h"][:-1]) | (some["c"][1:] != some["c"][:-1])
    head = np.maximum.accumulate(np.where(first, np.arange(len(some)), 0))
    out = some.copy()
    again = ~first
    out["c"][again], out["doc"][again] = some["row"][head[again]].view(np.uint64), some["at"][head[again]] >> k_bits
    out["h"][again] = mix(some["row"][again].view(np.uint64) * np.uint64(_BASE) + some["at"][again].view(np.uint64))
    out["at"] = (some["at"] << 1) | again
    return out


def deal(texts: DataFrame, k: int, common: np.ndarray, bits: int, chunk: int = CHUNK) -> DataFrame:
    """Runs of all texts, those that repeat in a chunk settled: (h, c, doc, row, at)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, spans, held, count = WordHashes(), Spans(), [], 0
        for batch in batches:
            for row, doc, data in zip(batch["row"], batch["doc"], batch["data"], strict=True):
                words = data.split()
                if len(words) < k:
                    continue
                begin, n, h, c = runs(hashes.of(words), k, common, spans)
                some = np.empty(len(begin), RUN)
                some["h"], some["c"], some["doc"], some["row"], some["at"] = h, c, doc, row, (begin << bits) | n
                held.append(some)
                count += len(some)
            if count > chunk:
                yield from sent(held)
                held, count = [], 0
        if held:
            yield from sent(held)

    def sent(held: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        out = settle(np.concatenate(held), bits)
        for at in range(0, len(out), BLOCK):
            some = out[at : at + BLOCK]
            yield pd.DataFrame({c: some[c].view(np.int64) for c in RUN.names})

    return texts.mapInPandas(work, ", ".join(f"{c} long" for c in RUN.names))


def pointers(dealt: DataFrame, bits: int, block: int = BLOCK) -> DataFrame:
    """(row, at, n, src_row, src_at): n windows from at on that occur before at the source. Runs whose minimizer other runs have
    too come, at their first place, with a null source."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None  # the last run seen: h, c, its first place, and whether it was told to branch
        for batch in blocks(batches, block):
            done = batch[batch["at"] % 2 == 1]
            if len(done):
                at = done["at"].to_numpy() >> 1
                yield told(done["row"], at >> bits, at & (1 << bits) - 1, done["c"], done["doc"])
            rest = batch[batch["at"] % 2 == 0]
            if not len(rest):
                continue
            h, c, row, at = (rest[x].to_numpy() for x in ("h", "c", "row", "at"))
            if state is not None:
                h, c, row, at = (np.r_[s, x] for s, x in zip(state[:4], (h, c, row, at), strict=True))
            first = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]
            head = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
            place, n = at >> (bits + 1), (at >> 1) & (1 << bits) - 1
            again = ~first
            yield told(row[again], place[again], n[again], row[head[again]], place[head[again]])
            f = np.flatnonzero(first)
            same = h[f][1:] == h[f][:-1]
            branches = np.r_[False, same] | np.r_[same, False]
            known = state is not None and state[4]
            ask = f[branches & ~((f == 0) & known)]
            yield told(row[ask], place[ask], n[ask], None, None)
            last = f[-1]
            state = (h[last], c[last], row[last], at[last], bool(branches[-1]) or (last == 0 and known))

    def told(row, at, n, src_row, src_at) -> pd.DataFrame:
        none = pd.array([pd.NA] * len(row), "Int64")
        src = {"src_row": none if src_row is None else pd.array(src_row, "Int64"), "src_at": none if src_at is None else pd.array(src_at, "Int64")}
        return pd.DataFrame({"row": np.asarray(row), "at": np.asarray(at), "n": np.asarray(n)} | src)

    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = dealt.repartition(parts, "h").sortWithinPartitions(*RUN.names)
    return spread.mapInPandas(work, "row long, at long, n long, src_row long, src_at long")


def blocks(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += len(batch)
        if count >= size:
            yield pd.concat(held, ignore_index=True)
            held, count = [], 0
    if count:
        yield pd.concat(held, ignore_index=True)


def branches(work: Workspace, texts: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Pointers of single windows, of the runs (row, at, n) ``asked`` for."""

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, spans = WordHashes(), Spans()
        for batch in batches:
            for row, doc, data, ats, ns in zip(batch["row"], batch["doc"], batch["data"], batch["ats"], batch["ns"], strict=True):
                words, begin = data.split(), ats
                if (ns + k - 1).sum() < len(words):  # only the words of these runs, one run after the other
                    words = [w for a, n in zip(ats.tolist(), ns.tolist(), strict=True) for w in words[a : a + n + k - 1]]
                    begin = np.cumsum(ns + k - 1) - (ns + k - 1)
                words, step = hashes.of(words), np.arange(ns.sum()) - np.repeat(np.cumsum(ns) - ns, ns)
                at = np.repeat(begin, ns) + step
                first = spans.of(words, at, at + k).view(np.int64)
                yield pd.DataFrame({"w1": first, "w2": ngram_hashes(words, k)[at].view(np.int64), "doc": doc, "row": row, "at": np.repeat(ats, ns) + step})

    asked = asked.groupBy("row").agg(F.collect_list("at").alias("ats"), F.collect_list("n").alias("ns"))
    found = texts.join(asked, "row").select("row", "doc", "data", "ats", "ns").mapInPandas(windows, "w1 long, w2 long, doc long, row long, at long")
    found = work.save(found, "windows")
    least = found.groupBy("w1", "w2").agg(F.count("*").alias("places"), F.min(F.struct("doc", "row", "at")).alias("src")).where("places > 1")
    least = work.save(least.select("w1", "w2", F.col("src.row").alias("src_row"), F.col("src.at").alias("src_at")), "least")
    joined = found.join(least, ["w1", "w2"]).where("row <> src_row or at <> src_at")
    return joined.select("row", "at", F.lit(1).cast("long").alias("n"), "src_row", "src_at")


def paths(marks: DataFrame) -> DataFrame:
    """Pointers that follow each other in a text and at one source, as one row: (row, at, n, src_row, src_at)."""
    in_text = Window.partitionBy("row").orderBy("at")
    before = lambda c: F.lag(c).over(in_text)
    goes_on = (before(F.col("at") + F.col("n")) == F.col("at")) & (before("src_row") == F.col("src_row")) & (before(F.col("src_at") + F.col("n")) == F.col("src_at"))
    starts = marks.withColumn("starts", F.when(goes_on, 0).otherwise(1))
    named = starts.withColumn("path", F.sum("starts").over(in_text.rowsBetween(Window.unboundedPreceding, 0)))
    ends = [F.min("at").alias("at"), F.sum("n").alias("n"), F.min("src_row").alias("src_row"), F.min("src_at").alias("src_at")]
    return named.groupBy("row", "path").agg(*ends).drop("path")


def verified(work: Workspace, texts: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The paths whose words are those at their source."""

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, data, ats, ns in zip(batch["row"], batch["data"], batch["ats"], batch["ns"], strict=True):
                words = data.split()
                out += [(row, a, n, xxhash.xxh3_128_digest(b" ".join(words[a : a + n + k - 1]))) for a, n in zip(ats.tolist(), ns.tolist(), strict=True)]
            yield pd.DataFrame(out, columns=["row", "at", "n", "words"])

    asked = found.select("row", "at", "n").union(found.select("src_row", "src_at", "n")).distinct()
    asked = asked.groupBy("row", F.floor(F.col("at") / PART).alias("part")).agg(F.collect_list("at").alias("ats"), F.collect_list("n").alias("ns"))
    read = texts.join(asked, "row").select("row", "data", "ats", "ns").mapInPandas(digests, "row long, at long, n long, words binary")
    read = work.save(read, "digests")
    source = read.select(F.col("row").alias("src_row"), F.col("at").alias("src_at"), "n", F.col("words").alias("src_words"))
    both = found.join(read, ["row", "at", "n"]).join(source, ["src_row", "src_at", "n"])
    return both.where("words = src_words").select(*found.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, *, k: int = K, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the other words, joined by one space) and spans (first word and number of words of each
    repeated path; paths can overlap) of every row of ``docs``, which has doc_id and text.

    A word goes if a window of ``k`` words covers it that starts earlier too: in a row with a smaller doc_id, or before in the same
    row. A null doc_id comes after all others; rows that share or lack one come in the order in which they are read. Null texts
    are empty, and a text of less than k words stays. Texts are taken whole; a very long one costs memory in proportion to it in
    the task that reads it. An empty table gives an empty result; other columns are left out.
    """
    if k < Q:
        raise ValueError(f"windows have {Q} words at least")
    small_batches(spark)
    work = Workspace(spark, "debruijn")
    bits = (k - Q + 1).bit_length()
    texts = work.save_by(numbered(docs), "texts", "row")
    found = work.save(pointers(deal(texts, k, common_grams(texts), bits, chunk), bits, block), "pointers")
    single = branches(work, texts, found.where("src_row is null").select("row", "at", "n"), k)
    found = work.save(paths(found.where("src_row is not null").union(single)), "paths")
    work.keep(texts, found)
    good = verified(work, texts, found, k)
    spans = good.groupBy("row").agg(F.collect_list("at").alias("ats"), F.collect_list("n").alias("ns"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, doc, data, ats, ns in zip(batch["row"], batch["doc"], batch["data"], batch["ats"], batch["ns"], strict=True):
                words = data.split()
                keep = np.ones(len(words) + 1, bool)
                if ats is not None:
                    ns = ns + k - 1  # words
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, ats, 1)
                    np.subtract.at(cover, ats + ns, 1)
                    keep = np.cumsum(cover) == 0
                kept = [w for w, stays in zip(words, keep, strict=False) if stays]
                out.append((row, doc, len(words), len(words) - len(kept), b" ".join(kept).decode(), ats if ats is not None else [], ns if ats is not None else []))
            yield pd.DataFrame(out, columns=["row", "doc", "n_words", "n_removed", "kept", "at", "n"])

    done = texts.join(spans, "row", "left").select("row", "doc", "data", "ats", "ns")
    done = done.mapInPandas(cut, "row long, doc long, n_words long, n_removed long, kept string, at array<long>, n array<long>")
    return done.select(doc_id(), "n_words", "n_removed", "kept", F.arrays_zip("at", "n").alias("spans"))


def op12_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept", "spans")


OP12_SQL = f"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, s, sha256(array_to_string(w[s:s + {K - 1}], ' ')) AS h FROM t, unnest(range(1, len(w) - {K - 2})) AS u(s)),
r AS (SELECT doc_id, s FROM g QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, s) > 1),
c AS (SELECT DISTINCT doc_id, s + i AS p FROM r, unnest(range(0, {K})) AS u(i)),
x AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id),
k AS (SELECT t.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, w, gone FROM t LEFT JOIN x USING (doc_id)),
p AS (SELECT t.doc_id, string_agg(w[i], ' ' ORDER BY i) AS kept
      FROM t, unnest(range(1, len(w) + 1)) AS u(i) LEFT JOIN c ON c.doc_id = t.doc_id AND c.p = i WHERE c.p IS NULL GROUP BY t.doc_id)
SELECT k.doc_id, n_words, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k LEFT JOIN p USING (doc_id)
"""
