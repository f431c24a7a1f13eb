"""Mixing sources to target weights by a low-discrepancy schedule over shuffled equal-token blocks."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quantlake.llm.common import Workspace

WORD = r"[^\x20\x09-\x0D]+"
#: Points of the base-2 van der Corput sequence and cumulative weights are fractions of 2^BITS.
BITS = 40
#: The cumulative weights are looked up by the first bits of a point.
CELL_BITS = 10
MOST_BROADCAST = 100_000


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null. A word starts wherever a blank, or the start of the text, comes before it."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[int], total: Fraction, most: int = 2) -> list[Fraction]:
    """Split ``total`` by weight; no target exceeds ``most`` times its size, what is over is reshared among the rest."""
    out = [Fraction(0)] * len(sizes)
    free, left = [i for i, s in enumerate(sizes) if s > 0], min(total, Fraction(most * sum(sizes)))
    while free:
        share = left / sum(weights[i] for i in free)
        full = [i for i in free if share * weights[i] > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = share * weights[i]
            break
        for i in full:
            out[i] = Fraction(most * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in set(full)]
    return out


def terms(x: int) -> list[tuple[int, int]]:
    """(t, residue) of each set bit of x: the points below x / 2^BITS are those of these residues modulo 2^t."""
    if x >= 1 << BITS:
        return [(0, 0)]
    out, head = [], 0
    for t in range(1, BITS + 1):
        if x >> (BITS - t) & 1:
            out.append((t, head))
            head |= 1 << (t - 1)
    return out


def points_below(n: int, x: int) -> int:
    """How many of the first n van der Corput points lie below x / 2^BITS."""
    return sum((n - residue + (1 << t) - 1) >> t for t, residue in terms(x))


def points_below_column(n: Column, parts: Column) -> Column:
    """points_below() for a column of terms(): a closed form, without a window or a shuffle."""

    def add(s: Column, part: Column) -> Column:
        t = part["t"]
        return s + F.call_function("shiftright", n - part["residue"] + F.call_function("shiftleft", F.lit(1).cast("long"), t) - 1, t)

    return F.aggregate(parts, F.lit(0).cast("long"), add)


def van_der_corput(slot: Column) -> Column:
    """The slot's point, times 2^BITS: its bits in reverse."""
    return F.conv(F.reverse(F.lpad(F.bin(slot), BITS, "0")), 2, 10).cast("long")


def mix(spark: SparkSession, docs: DataFrame, *, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes, repeats counted) of every row of ``docs``
    (doc_id, text, source): the sums over the blocks of mixture(), which see."""
    placed, parts = mixture(spark, docs, keep=keep, **options)
    key = ["k", "start", "doc_id", *keep, "copy", "size", "source_size", "target"]
    every = placed.select(*key, F.lit(0).cast("long").alias("taken")).unionByName(parts.select(*key, F.col("length").alias("taken")))
    return every.groupBy(*key).agg(F.sum("taken").alias("taken")).select("doc_id", *keep, "size", "source_size", "target", "taken")


def mixture(
    spark: SparkSession,
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = (3, 1, 2),
    share: Fraction = Fraction(3, 2),
    most: int = 2,
    block: int = 1024,
    seed: int = 11,
    rows_per_bucket: int = 64,
    keep: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """The documents with their places in their source's stream, and the mix itself: a row for each part of a document that a
    slot takes (slot, place in it, doc_id, ``keep``, copy, first word, length), which ordered by slot and place is the mixed stream.

    Each source's documents are shuffled by a keyed hash and laid end to end; ``block`` words make a block. Slot i of the
    schedule goes to the source in whose part of the cumulative weights the i-th van der Corput point falls; the r-th slot
    of a source takes its r-th block, beginning anew after the last. The closed form of the rank needs no window, so no
    source gathers in a task. The slot that reaches a source's target takes only the start of its block, so a source
    takes its target rounded down, and no document more than ``most`` times its size.

    Sources are ordered by code point, null last. Null and empty texts have size 0 and are never taken; a very long text is
    many blocks. Repeated rows are documents of their own, side by side in the stream, which ``copy`` numbers from 0; they
    travel as one row with their count until each has its place. An empty table gives an empty result; reruns agree. Other columns are left out unless named in ``keep``. The table of sources, one row for each, is
    held on the driver; up to MOST_BROADCAST rows it is broadcast.
    """
    work = Workspace(spark, "mixing")
    own = [F.lit(seed), F.col("doc_id"), *map(F.col, keep)]
    sized = docs.select("doc_id", *keep, "source", n_words(F.col("text")).alias("size"), "text")
    sized = sized.withColumn("h", F.when(F.col("size") > 0, F.xxhash64(*own, F.col("text"))).otherwise(F.xxhash64(*own)))
    sized = work.save(sized.groupBy("doc_id", *keep, "source", "size", "h").agg(F.count("*").alias("copies")), "sizes")

    words = F.col("size") * F.col("copies")
    totals = sized.groupBy("source").agg(F.sum(words).alias("size"), F.count("*").alias("n")).collect()
    totals.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["size"] for r in totals]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes), most)
    quotas, everything = [int(t) for t in wanted], sum(wanted)
    edges, below = [0], Fraction(0)
    for t in wanted:
        below += t
        edges.append(round(below / everything * (1 << BITS)) if everything else 0)
    blocks = [-(-s // block) for s in sizes]
    needed = [(q // s) * b + -(-(q % s) // block) if s else 0 for q, s, b in zip(quotas, sizes, blocks, strict=True)]
    slots = sum(needed)
    while any(points_below(slots, edges[i + 1]) - points_below(slots, edges[i]) < need for i, need in enumerate(needed)):
        slots += max(1, slots // 256)

    columns = "source string, k int, source_size long, target double, quota long, blocks long, buckets long, low long, high long, "
    columns += "below array<struct<t: int, residue: long>>, upto array<struct<t: int, residue: long>>"
    table = [
        (r["source"], i, sizes[i], float(wanted[i]), quotas[i], blocks[i], -(-r["n"] // rows_per_bucket), edges[i], edges[i + 1], terms(edges[i]), terms(edges[i + 1]))
        for i, r in enumerate(totals)
    ]
    small = (lambda df: F.broadcast(df)) if len(table) <= MOST_BROADCAST else (lambda df: df)
    sources = spark.createDataFrame(table, columns)

    # Places in a source's stream: buckets of hash ranges hold a bounded number of rows; their sums are added up first.
    facts = sources.select(F.col("source").alias("_source"), "k", "source_size", "target", "buckets")
    placed = sized.join(small(facts), F.col("source").eqNullSafe(F.col("_source"))).drop("source", "_source")
    rank = F.shiftrightunsigned(F.col("h"), 32)
    placed = placed.withColumn("bucket", F.shiftright(rank * F.col("buckets"), 32))
    sums = placed.groupBy("k", "bucket").agg(F.sum(words).alias("size"))
    offsets = work.save(running(sums), "offsets")
    inside = W.Window.partitionBy("k", "bucket").orderBy("h", "doc_id", *keep).rowsBetween(W.Window.unboundedPreceding, -1)
    placed = placed.join(offsets, ["k", "bucket"])
    placed = placed.withColumn("start", F.col("before") + F.coalesce(F.sum(words).over(inside), F.lit(0)))
    units = work.save(placed.select("doc_id", *keep, "h", "copies", "size", "k", "source_size", "target", "start"), "units")
    placed = each_copy(units).withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
    placed = work.save(placed.select("doc_id", *keep, "copy", "size", "k", "source_size", "target", "start"), "placed")

    slot = F.col("id")
    schedule = spark.range(slots).withColumn("point", van_der_corput(slot))
    cell = lambda x: F.shiftright(x, BITS - CELL_BITS)
    parts = sources.where("low < high").withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high") - 1))))
    schedule = schedule.withColumn("cell", cell(F.col("point"))).join(small(parts), "cell").where("point >= low and point < high")
    schedule = schedule.withColumn("rank", points_below_column(slot, F.col("upto")) - points_below_column(slot, F.col("below")))
    b = F.col("rank") % F.col("blocks")
    epoch = F.floor(F.col("rank") / F.col("blocks"))
    before = epoch * F.col("source_size") + b * block
    length = F.least(F.lit(block), F.col("source_size") - b * block)
    take = F.least(length, F.col("quota") - before)
    schedule = schedule.select("k", b.alias("block"), slot.alias("slot"), take.alias("take")).where("take > 0")  # at most ``most`` of a block

    pieces = placed.where("size > 0").select(
        "*", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block")
    )
    left = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    right = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    length = F.least("take", right) - left
    parts = pieces.join(schedule, ["k", "block"]).withColumns({"length": length, "place": left, "first": F.col("block") * block + left - F.col("start")})
    return placed, parts.where("length > 0").select("slot", "place", "k", "start", "doc_id", *keep, "copy", "size", "source_size", "target", "first", "length")


def each_copy(rows: DataFrame, most: int = 1000) -> DataFrame:
    """A row for each of the ``copies`` of a row, numbered by ``copy``; a task makes at most ``most`` of a row's."""
    groups = rows.withColumn("_group", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / most))))
    many = groups.where(F.col("copies") > most).repartition("h", "_group")
    groups = groups.where(F.col("copies") <= most).unionByName(many)
    first = F.col("_group") * most
    return groups.withColumn("copy", F.explode(F.sequence(first, F.least(first + most, F.col("copies")) - 1))).drop("_group")


def running(sums: DataFrame, width: int = 1024) -> DataFrame:
    """k, bucket and before: the sizes of the earlier buckets of the same k, in two levels of at most some ``width`` rows."""
    groups = sums.withColumn("g", F.floor(F.col("bucket") / width))
    level = groups.groupBy("k", "g").agg(F.sum("size").alias("size"))
    earlier = W.Window.partitionBy("k").orderBy("g").rowsBetween(W.Window.unboundedPreceding, -1)
    level = level.select("k", "g", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("base"))
    inside = W.Window.partitionBy("k", "g").orderBy("bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    groups = groups.withColumn("rest", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return groups.join(level, ["k", "g"]).select("k", "bucket", (F.col("base") + F.col("rest")).alias("before"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
