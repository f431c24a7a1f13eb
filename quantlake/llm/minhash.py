"""Near-duplicate documents by circulant MinHash, banding and an exact check of the Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantlake.llm.common import WordHashes, Workspace, as_long, components, id_text, mix, ngram_hashes, small_batches

WORDS, SIZE, PERCENT = 5, 60, 75
#: Coordinates of the signature that make a band: runs of three, and ten more that reach across. A pair of exactly 75 %
#: shares none of them with probability 7e-8.
BANDS = [(3 * k, 3 * k + 1, 3 * k + 2) for k in range(20)] + [(k, k + 20, k + 40) for k in range(10)]
#: Shingles are counted in so many parts of the hash space to bound what two classes share.
PARTS = 64
#: Comparisons with one class that a task makes; the text of a class with more is sent to several.
FAN = 256


def shingles(text: str | None, words: WordHashes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles (of the whole sequence if it is shorter); empty without words."""
    hashes = words.of((text or "").encode().lower().split())
    if 0 < len(hashes) < n:
        return mix(ngram_hashes(hashes, len(hashes)) + np.uint64(len(hashes)))
    return np.unique(ngram_hashes(hashes, n))


def signature(found: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Circulant MinHash over the ring of 32-bit integers: one permutation places a shingle, coordinate k shifts the place
    by k and takes the least value under the second permutation."""
    out = np.full(size, np.iinfo(np.uint32).max, np.uint32)
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    places = permuted((found >> np.uint64(32)).astype(np.uint32), 0x6A09E667)
    for at in range(0, len(places), 512):
        out = np.minimum(out, permuted(places[at : at + 512] + shifts, 0xBB67AE85).min(1))
    return out.view(np.int32)


def permuted(x: np.ndarray, key: int) -> np.ndarray:
    """A permutation of 32-bit integers: xor-shifts and odd multiplications."""
    x = x ^ np.uint32(key)
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def sketches(spark: SparkSession, docs: DataFrame, n: int = WORDS) -> DataFrame:
    """doc_id, tag (hash of the text), n_shingles, set_id (128-bit digest of the shingle set, null if empty) and sig, the
    signature."""
    small_batches(spark)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for batch in batches:
            out = []
            for text in batch["text"]:
                found = shingles(text, words, n)
                if len(found):
                    out.append((len(found), xxhash.xxh128_digest(found.tobytes()), signature(found)))
                else:
                    out.append((0, None, None))
            rows = pd.DataFrame(out, columns=["n_shingles", "set_id", "sig"])
            yield rows.assign(doc_id=batch["doc_id"], tag=batch["tag"])

    rows = docs.select(id_text(), F.xxhash64("text").alias("tag"), "text")
    return as_long(rows.mapInPandas(work, "n_shingles long, set_id binary, sig array<int>, doc_id string, tag long"))


def compared(spark: SparkSession, work: Workspace, pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """``pairs`` (a, b) with na, nb and both: the sizes of their full shingle sets and of what these share.

    Many a may be compared with one b; its text then goes to a task for every FAN of them.
    """

    @F.pandas_udf("na long, nb long, both long")
    def sizes(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for left, right in batches:
            last, out, y = None, [], np.empty(0, np.uint64)
            for p, q in zip(left, right, strict=True):
                x = shingles(p, words, n)
                if q != last:
                    last, y = q, shingles(q, words, n)
                out.append((len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))))
            yield pd.DataFrame(out, columns=["na", "nb", "both"])

    pairs = work.save(pairs, "asked")
    fans = pairs.groupBy("b").agg(F.ceil(F.count("*") / FAN).cast("int").alias("fans")).where("fans > 1")
    fans = work.save(fans, "fans")  # few, so that a written table is joined without moving the pairs
    rows = pairs.join(fans, "b", "left").withColumn("fan", F.coalesce(F.pmod(F.xxhash64("a"), F.col("fans")).cast("int"), F.lit(0))).drop("fans")
    rows = rows.join(texts.select(F.col("node").alias("a"), F.col("text").alias("_p")), "a")
    others = texts.select(F.col("node").alias("b"), F.col("text").alias("_q")).join(fans, "b", "left")
    others = others.withColumn("fan", F.explode(F.sequence(F.lit(0), F.coalesce("fans", F.lit(1)) - 1))).drop("fans")
    rows = rows.join(others, ["b", "fan"])
    return rows.select("a", "b", sizes("_p", "_q").alias("_s")).select("a", "b", "_s.*")


def linked(compared: DataFrame, percent: int) -> DataFrame:
    return compared.where(F.col("both") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def unordered(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))


def without(pairs: DataFrame, done: DataFrame) -> DataFrame:
    """``pairs`` that ``done`` lacks in either direction."""
    return unordered(pairs).join(unordered(done).select("low", "high"), ["low", "high"], "left_anti").drop("low", "high")


def near_duplicates(spark: SparkSession, docs: DataFrame, *, percent: int = PERCENT, n: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text).

    Documents with the same shingle set are one class; classes that share a band are candidates. A class is first compared
    with the most central class of each band it is in, the one with most candidates, so a large group costs as many
    comparisons as it has members; what does not link there likewise. Then the classes of a band that these links have not
    yet joined are compared, if the similarity is possible: two classes share at most the fewer of the shingles that
    either shares with the band's centre, and the fewer of those that it has in common with any other open class; and in
    each of PARTS parts of the hash space at most the fewer of those that either has in common with any other, which tells
    copies apart that were changed in different places. These bounds are exact, so no candidate is lost to them.

    Null and empty texts, and texts without words, have no shingles and link with nothing, nor do rows without doc_id
    (their component_id is null and they are kept). Rows that repeat a doc_id with the same text belong to one class
    and are all kept; the texts of a doc_id that has several count as linked, and each links with its own near copies. Of
    equally central classes one is taken, which changes no result. An empty table gives an empty result; a very long text
    costs memory in proportion to it in the task that reads it. Other columns are left out.
    """
    work = Workspace(spark, "minhash")
    rows = work.save(sketches(spark, docs, n), "sketches")
    full = rows.where("set_id is not null and doc_id is not null")
    named = full.groupBy("set_id").agg(F.min(F.struct("doc_id", "tag")).alias("low"), F.min("n_shingles").alias("size"), F.first("sig").alias("sig"))
    classes = work.save(named.select("set_id", "low.*", "size", "sig", F.monotonically_increasing_id().alias("node")), "classes")

    bands = F.array(*(F.xxhash64(F.lit(i), *(F.col("sig")[k] for k in band)) for i, band in enumerate(BANDS)))
    members = classes.select("node", "size", F.explode(bands).alias("band"))
    shared = work.save(members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    members = work.save(members.join(shared, "band"), "members")
    central = work.save(members.groupBy("node").agg(F.sum("n").alias("central")), "central")
    members = work.save(members.drop("n").join(central, "node"), "members")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), "text")
    texts = texts.join(classes.join(central, "node", "left_semi").select("doc_id", "tag", "node"), ["doc_id", "tag"])
    texts = work.save(texts.groupBy("node").agg(F.first("text").alias("text")), "texts")  # of a repeated row, one

    ids = full.join(classes.select("set_id", "node"), "set_id").select("doc_id", "node")
    several = ids.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("top")).where("a <> top").drop("top")
    twice = work.save(ids.join(several, "doc_id").where("a <> node").select("a", F.col("node").alias("b")).distinct(), "twice")

    members = work.save(members.join(hubs(members), "band"), "hubs")
    work.keep(rows, classes, texts, twice, members)
    pairs = work.save(compared(spark, work, pairs_with(members), texts, n), "pairs")
    links = linked(pairs, percent)
    outside = members.where("node <> hub").select("band", F.col("node").alias("a"), F.col("hub").alias("b"), "size", "central")
    outside = work.save(without(outside, links).select("band", F.col("a").alias("node"), "size", "central"), "outside")
    more = without(pairs_with(outside.join(hubs(outside), "band")), pairs)
    more = work.save(compared(spark, work, more, texts, n), "pairs")
    links = work.save(twice.union(links).union(linked(more, percent)), "links")

    found = work.save(components(spark, work, links), "found")
    now = members.join(found, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    now = work.save(now, "labelled")
    work.keep(rows, classes, texts, pairs, more, found, now)
    groups = now.groupBy("band", "c").agg(F.count("*").alias("n"))
    most = groups.groupBy("band").agg(F.max(F.struct("n", "c")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    most = work.save(most.select("band", F.col("top.c").alias("top_c")), "open")
    open_ = work.save(now.join(most, "band"), "open_members")
    common = work.save(shared_shingles(spark, texts.join(open_.select("node").distinct(), "node", "left_semi"), n), "common")
    of_hub = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("hub"), "both"), F.struct(F.col("b").alias("node"), F.col("a").alias("hub"), "both"))).alias("p")).select("p.*")
    open_ = open_.join(common, "node").join(of_hub, ["node", "hub"], "left")
    open_ = work.save(open_.withColumn("core", F.coalesce("both", "size")).where(100 * F.col("common") >= percent * F.col("size")), "open_members")
    sides = ("node", "c", "size", "common", "core", "parts")
    left = open_.where("c <> top_c").select("band", *(F.col(x).alias(f"{x}_a") for x in sides))
    right = open_.select("band", "top_c", *(F.col(x).alias(f"{x}_b") for x in sides))
    most_shared = F.least("core_a", "core_b") + F.least(F.col("common_a") - F.col("core_a"), F.col("common_b") - F.col("core_b"))
    in_parts = F.aggregate(F.zip_with("parts_a", "parts_b", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    match = (
        (F.col("c_a") != F.col("c_b"))
        & ((F.col("c_b") == F.col("top_c")) | (F.col("node_a") < F.col("node_b")))
        & (100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b"))
        & (100 * most_shared >= percent * (F.col("size_a") + F.col("size_b") - most_shared))
        & (100 * in_parts >= percent * (F.col("size_a") + F.col("size_b") - in_parts))
    )
    rest = left.join(right, "band").where(match).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    rest = without(without(rest.distinct(), pairs), more)
    last = work.save(linked(compared(spark, work, rest, texts, n), percent), "links")

    # What the first links joined is one node each for the last ones.
    name = lambda c: classes.select("node").join(found, "node", "left").select(F.col("node").alias(c), F.coalesce("component", "node").alias(f"_{c}"))
    over = components(spark, work, last.join(name("a"), "a").join(name("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    named = classes.join(found, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    named = named.join(over.select(F.col("node").alias("c"), "component"), "c", "left").select("set_id", "doc_id", F.coalesce("component", "c").alias("c"))
    lowest = named.groupBy("c").agg(F.min("doc_id").alias("lowest"))
    named = work.save(named.join(lowest, "c").select("set_id", "lowest"), "named")
    work.keep(rows, named)
    out = rows.join(named, "set_id", "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("lowest", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def hubs(members: DataFrame) -> DataFrame:
    """band and hub, the node of the band with most candidates."""
    top = members.groupBy("band").agg(F.max(F.struct("central", (-F.col("node")).alias("minus"))).alias("top"))
    return top.select("band", (-F.col("top.minus")).alias("hub"))


def pairs_with(members: DataFrame) -> DataFrame:
    """Each node (a) with the hubs (b) of its bands; of two hubs of each other's bands, once."""
    rows = unordered(members.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    once = rows.groupBy("low", "high").agg(F.max("b").alias("b"))
    return once.select(F.when(F.col("b") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("a"), "b")


def shared_shingles(spark: SparkSession, texts: DataFrame, n: int) -> DataFrame:
    """node, parts and common: how many shingles of each of ``texts`` (node, text) occur in another of them, in each part
    of the hash space and in all."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for batch in batches:
            for node, text in zip(batch["node"], batch["text"], strict=True):
                yield pd.DataFrame({"node": node, "shingle": shingles(text, words, n).view(np.int64)})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for batch in batches:
            parts = [np.bincount((shingles(t, words, n) % np.uint64(PARTS)).astype(np.int64), minlength=PARTS) for t in batch["text"]]
            yield pd.DataFrame({"node": batch["node"], "all": parts})

    one = texts.mapInPandas(emit, "node long, shingle long").groupBy("shingle").agg(F.count("*").alias("k"), F.min("node").alias("node"))
    part = F.col("shingle").bitwiseAND(F.lit(PARTS - 1)).cast("int")
    own = one.where("k = 1").groupBy("node", part.alias("part")).agg(F.count("*").cast("int").alias("own"))
    own = own.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("part", "own"))).alias("own"))
    rows = texts.mapInPandas(count, "node long, all array<int>").join(own, "node", "left")
    alone = lambda i: F.coalesce(F.try_element_at("own", i), F.lit(0))
    rows = rows.select("node", F.transform("all", lambda x, i: x - alone(i)).alias("parts"))
    return rows.withColumn("common", F.aggregate("parts", F.lit(0), lambda s, x: s + x))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
WITH RECURSIVE t AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM t, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS u(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, CASE WHEN r.b = e.a THEN e.b ELSE e.a END FROM r JOIN e ON r.b = e.a OR r.b = e.b),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""
