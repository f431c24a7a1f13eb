"""Removal of passages that repeat across documents, by bucket-pointer refinement of the suffixes around sampled anchors.

A passage of LENGTH bytes contains the least q-gram hash of its LENGTH - Q + 1 q-grams; wherever the passage occurs, the
same q-grams (its anchors) are chosen. So only suffixes at anchors are put in buckets, some 6 % of all:

1. Anchors go to buckets by their q-gram. Within a bucket, anchors with the same context (all bytes of the passages that
   can contain the anchor) are one class, and all but the smallest document of a class are settled: their passages repeat.
   A passage reaches HALF bytes beyond the q-gram on one side at least, so a class stays open only if another one has the
   same bytes there.
2. Buckets with open classes are refined with their contexts: identifiers of q-grams at all offsets of the
   contexts, refined by sorting on the pairs (own identifier, identifier at the later offset), doubling the length and
   reusing the new identifiers, until they tell apart passages of LENGTH bytes. A passage is repeated in the smallest
   document of a class if a smaller document has the same identifier. A bucket of more than HOT contexts is not refined in
   one task but halved: passages with at most so many bytes before the q-gram share more bytes after it, the others more
   before it, so each half falls into smaller buckets by these bytes. Contexts with the same bytes in all passages of a half
   are one class again, settled by its least document. Buckets of a half with up to HOT contexts are refined, the others
   halved again, HALVINGS times. What then is left is dealt to tasks by SHARE contexts, each marks what it sees repeated, and
   only the passages of the least document that it has seen become rows, whose least document is an aggregate.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantlake.llm.common import NO_ID, Workspace, doc_id, mix, numbered, small_batches

LENGTH, Q, START = 50, 16, 8
WINDOW = LENGTH - Q + 1
#: Bytes before an anchor, and in all, that the passages containing it can cover.
BEFORE, CONTEXT = LENGTH - Q, 2 * LENGTH - Q
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.iinfo(np.int64).max
HALF = (LENGTH - Q) // 2
#: Contexts of a q-gram that one task refines, and bytes of text of a bucket.
HOT, BUCKET_BYTES = 4096, 8 << 20
#: Times that the passages of a hot q-gram are halved; after three a half has five passages at most.
HALVINGS = 3
#: Contexts of a hot q-gram that go to one task together, and contexts whose passages a task compares at once.
SHARE, TOGETHER = 1024, 4096
ENTRY = np.dtype([("h", "u8"), ("c", "u8"), ("left", "u2"), ("right", "u2"), ("doc", "i8"), ("row", "i8"), ("at", "u4")])


def rolling(x: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` bytes, from hashes of runs of powers of two."""
    out, done, h, size, power = None, 0, x, 1, int(_BASE)
    rest = length
    while rest:
        factor = np.uint64(power)
        if rest & 1:
            if out is None:
                out, done = h, size
            else:
                n = len(x) - done - size + 1
                out = out[:n] * factor + h[done : done + n]
                done += size
        rest >>= 1
        if rest:
            n = len(h) - size
            h = h[:n] * factor + h[size : size + n]
            power = power * power & (1 << 64) - 1
            size *= 2
    return out[: len(x) - length + 1]


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the q-grams that are the least of a passage; of equals all are chosen."""
    x = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    h = mix(rolling(x, Q))
    low, k = h, 1
    while 2 * k <= WINDOW:
        low = np.minimum(low[:-k], low[k:])
        k *= 2
    if k < WINDOW:
        low = np.minimum(low[: len(low) - (WINDOW - k)], low[WINDOW - k :])
    # A q-gram is an anchor if it equals the least of any window that contains it.
    pad = np.full(WINDOW - 1, 0, np.uint64)
    top, k = np.concatenate([pad, low, pad]), 1
    while 2 * k <= WINDOW:
        top = np.maximum(top[:-k], top[k:])
        k *= 2
    if k < WINDOW:
        top = np.maximum(top[: len(top) - (WINDOW - k)], top[WINDOW - k :])
    at = np.flatnonzero(top == h)
    return at, h[at]


def context_hashes(data: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each anchor's context, and of its q-gram with the HALF bytes to the left and to the right."""
    x = np.zeros(len(data) + 2 * CONTEXT, np.uint64)
    x[CONTEXT : CONTEXT + len(data)] = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    whole, side = rolling(x, CONTEXT), rolling(x, Q + HALF)
    return mix(whole[at + CONTEXT - BEFORE]), mix(side[at + CONTEXT - HALF]), mix(side[at + CONTEXT])


def settle(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Split anchors into those of a class (h, c) that a smaller document has too, and those of its smallest document."""
    order = np.lexsort((entries["row"] >= NO_ID, entries["doc"], entries["c"], entries["h"]))
    entries = entries[order]
    first = np.ones(len(entries), bool)
    first[1:] = (entries["h"][1:] != entries["h"][:-1]) | (entries["c"][1:] != entries["c"][:-1])
    least = entries[first][np.cumsum(first) - 1]
    own = (entries["doc"] == least["doc"]) & ((entries["row"] >= NO_ID) == (least["row"] >= NO_ID))
    return entries[~own], entries[own]


def pack(entries: np.ndarray) -> bytes:
    """Columns one after the other, compressed."""
    raw = b"".join(np.ascontiguousarray(entries[name]).tobytes() for name in ENTRY.names)
    return len(entries).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    raw = pa.decompress(data[4:], decompressed_size=n * ENTRY.itemsize, codec="zstd", asbytes=True)
    out, at = np.empty(n, ENTRY), 0
    for name in ENTRY.names:
        size = ENTRY[name].itemsize * n
        out[name] = np.frombuffer(raw[at : at + size], ENTRY[name])
        at += size
    return out


def refine(rows: np.ndarray, docs: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Bit o of an element: the passage that starts o bytes into its context occurs in a smaller document of its group.

    ``rows`` are contexts. Buckets of START-grams are refined by their identifiers at later offsets, doubling the length.
    """
    group = np.unique(groups, return_inverse=True)[1].reshape(-1, 1)
    grams = np.zeros((len(rows), CONTEXT - START + 1), np.uint64)
    for k in range(START):
        grams = (grams << np.uint64(8)) | (rows[:, k : CONTEXT - START + 1 + k] & 255).astype(np.uint64)
    ids, size = ranks(grams), START
    ids = ranks(ids * (group.max() + 1) + group)
    while size < LENGTH:
        step = min(size, LENGTH - size)
        ids = ranks(ids[:, :-step] * (ids.max() + 1) + ids[:, step:])
        size += step
    reach = np.concatenate([np.zeros((len(rows), 1), int), np.cumsum(rows != 256, 1)], 1)
    full = reach[:, LENGTH:] - reach[:, :-LENGTH] == LENGTH
    least = np.full(ids.max() + 1, _NONE)
    np.minimum.at(least, ids[full], np.broadcast_to(docs[:, None], ids.shape)[full])
    return (((least[ids] < docs[:, None]) & full) * (1 << np.arange(ids.shape[1], dtype=np.int64))).sum(1)


def ranks(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].reshape(values.shape).astype(np.int64)


#: A context as a row: of an anchor at a place of a text of that size.
CUTS = "h long, doc long, row long, at int, size int, context binary"
CUT = [c.split()[0] for c in CUTS.split(", ")]
_ALL = (1 << (CONTEXT - LENGTH + 1)) - 1


def deal(docs: DataFrame, buckets: int, chunk: int = 400_000) -> DataFrame:
    """Anchors by bucket of their q-gram: (bucket, settled, blob). Each task settles what it can before it sends them."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        for batch in batches:
            for row, doc, data in zip(batch["row"], batch["doc"], batch["data"], strict=True):
                if len(data) < LENGTH:
                    continue
                at, h = anchors(data)
                some = np.empty(len(at), ENTRY)
                c, left, right = context_hashes(data, at)
                some["h"], some["c"], some["left"], some["right"] = h, c, left >> np.uint64(48), right >> np.uint64(48)
                some["doc"], some["row"], some["at"] = doc, row, at
                held.append(some)
            if sum(map(len, held)) > chunk:
                yield send(held)
                held = []
        if held:
            yield send(held)

    def send(held: list[np.ndarray]) -> pd.DataFrame:
        settled, entries = settle(np.concatenate(held))
        done = [settled[i : i + 50_000] for i in range(0, len(settled), 50_000)]  # these go anywhere
        out = [(int(some["row"][0] * 31 + some["at"][0]) % buckets, True, pack(some)) for some in done]
        where = entries["h"] % np.uint64(buckets)
        order = np.argsort(where, kind="stable")
        entries, where = entries[order], where[order]
        first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]][: len(where)])
        out += [(int(where[a]), False, pack(entries[a:b])) for a, b in zip(first, np.r_[first[1:], len(where)], strict=True)]
        return pd.DataFrame(out, columns=["bucket", "settled", "blob"])

    return docs.mapInPandas(work, "bucket int, settled boolean, blob binary")


def classes(dealt: DataFrame, buckets: int) -> DataFrame:
    """Settled anchors by document, and of those that stay open the ones whose bucket has several classes.

    (doc, row, at, h, bits): bits is _ALL for settled anchors and 0 for open ones.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, open_ = None, []

        def finish() -> Iterator[pd.DataFrame]:
            if open_:
                settled, own = settle(np.concatenate(open_))
                many = np.zeros(len(own), bool)
                for side in ("left", "right"):
                    key = (own["h"] << np.uint64(16)) | own[side]
                    order = np.argsort(key, kind="stable")  # classes of a bucket stay together
                    first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]][: len(own)])
                    if len(first):
                        c = own["c"][order]
                        several = np.minimum.reduceat(c, first) != np.maximum.reduceat(c, first)
                        many[order] |= np.repeat(several, np.diff(np.r_[first, len(own)]))
                yield from rows(settled, _ALL)
                yield from rows(own[many], 0)

        for batch in batches:
            for bucket, settled, blob in zip(batch["bucket"], batch["settled"], batch["blob"], strict=True):
                if bucket != last:
                    yield from finish()
                    last, open_ = bucket, []
                if settled:
                    yield from rows(unpack(blob), _ALL)
                else:
                    open_.append(unpack(blob))
        yield from finish()

    def rows(entries: np.ndarray, bits: int) -> Iterator[pd.DataFrame]:
        for at in range(0, len(entries), 50_000):
            some = entries[at : at + 50_000]
            yield pd.DataFrame({"doc": some["doc"], "row": some["row"], "at": some["at"].astype(np.int32), "h": some["h"].astype(np.int64), "bits": np.full(len(some), bits, np.int64)})

    spread = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return spread.mapInPandas(work, "doc long, row long, at int, h long, bits long")


def repeated(spark: SparkSession, work: Workspace, docs: DataFrame, buckets: int) -> DataFrame:
    """(doc, row, ats, bits): bit o of an element of bits says that the passage from at - BEFORE + o is repeated."""
    dealt = deal(docs, buckets)
    found = work.save(classes(dealt, buckets), "classes")

    asked = found.where("bits = 0").groupBy("row").agg(F.collect_list("at").alias("ats"), F.collect_list("h").alias("hs"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = batch["ats"].map(len).to_numpy()
            around = []
            for data, at in zip(batch["data"], batch["ats"], strict=True):
                padded = b"\0" * CONTEXT + data + b"\0" * CONTEXT
                around += [padded[i : i + CONTEXT] for i in (at + (CONTEXT - BEFORE)).tolist()]
            out = {"h": np.concatenate(batch["hs"].tolist()), "doc": np.repeat(batch["doc"].to_numpy(), counts), "row": np.repeat(batch["row"].to_numpy(), counts)}
            sizes = np.repeat(batch["data"].map(len).to_numpy(), counts)
            yield pd.DataFrame(out | {"at": np.concatenate(batch["ats"].tolist()), "size": sizes, "context": around})

    texts = docs.join(asked, "row").select("doc", "row", "data", "ats", "hs")
    cuts = texts.mapInPandas(cut, CUTS)
    cuts = work.save(cuts, "cuts")
    order = F.struct("doc", (F.col("row") >= NO_ID).alias("unnamed"))

    def crowded(contexts: DataFrame) -> DataFrame:
        many = (F.min("doc") < F.max("doc")) | F.max(F.col("row") >= NO_ID)  # else of one document, which repeats none before it
        return work.save(contexts.groupBy("h").agg(F.count("*").alias("n"), many.alias("many")).where(F.col("n") > HOT), "hot")

    def refined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            ready = batch["h"] != batch["h"].iloc[-1]
            rest = batch[~ready]
            if ready.any():
                yield answer(batch[ready])
        if rest is not None and len(rest):
            yield answer(rest)

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        rows = np.frombuffer(b"".join(group["context"]), np.uint8).reshape(-1, CONTEXT).astype(np.uint16)
        place = (group["at"].to_numpy() - BEFORE)[:, None] + np.arange(CONTEXT)
        rows[(place < 0) | (place >= group["size"].to_numpy()[:, None])] = 256
        bits = refine(rows, order_of(group["doc"], group["row"]), group["h"].to_numpy())
        return group[["row", "at"]].assign(bits=bits)[bits != 0]

    def refine_all(contexts: DataFrame) -> DataFrame:
        spread = contexts.select(*CUT).repartition(buckets, "h").sortWithinPartitions("h")
        return work.save(spread.mapInPandas(refined, "row long, at int, bits long"), "answers")

    hot = crowded(found.where("bits = 0"))
    answers, again = [refine_all(cuts.join(hot, "h", "left_anti"))], []
    open_ = cuts.select(*CUT, F.lit(0).alias("low"), F.lit(BEFORE).alias("high"))
    for _ in range(HALVINGS):
        if hot.where("many").isEmpty():
            break
        halves = open_.join(hot.where("many").select("h"), "h").select(*CUT, "low", "high")
        halves = work.save(halves.mapInPandas(halved, f"{CUTS}, low int, high int, p1 long, p2 long, bits long"), "halves")
        several = halves.groupBy("low", "p1", "p2").agg(F.min(order).alias("least"), F.max(order).alias("most")).where("least < most").drop("most")
        several = work.save(several, "several")  # so that its size is known: where it is small, no context moves
        halves = halves.join(several, ["low", "p1", "p2"], "left").withColumn("again", F.coalesce(order > F.col("least"), F.lit(False)))
        halves = work.save(halves.select(*CUT, "low", "high", "bits", "again"), "settled")
        open_ = halves.where("not again").select(*CUT, "low", "high")
        hot = crowded(open_)
        again.append(halves.where("again").select("row", "at", "bits"))
        answers.append(refine_all(open_.join(hot, "h", "left_anti")))
    dense = hot.where("many").select("h", "n")
    if not dense.isEmpty():
        again += shared(work, open_.join(dense, "h"), buckets)
    if again:
        answers.append(work.save(reduce(DataFrame.union, again), "again"))
    work.keep(docs, found, *answers)
    marks = reduce(DataFrame.union, answers, found.where("bits <> 0").select("row", "at", "bits"))
    return marks.groupBy("row").agg(F.collect_list("at").alias("ats"), F.collect_list("bits").alias("bits"))


def shared(work: Workspace, dense: DataFrame, buckets: int) -> list[DataFrame]:
    """(row, at, bits) of contexts of ``n`` that share a q-gram, more than a task refines."""
    share = F.pmod(F.xxhash64("row", "at"), F.ceil(F.col("n") / SHARE)).alias("share")
    dense = dense.select("h", share, "doc", "row", "at", "size", "context", "low", "high").repartition(buckets, "h", "share").sortWithinPartitions("h", "share")
    passages = work.save(dense.mapInPandas(passages_of, "p1 long, p2 long, doc long, row long, at int, o int, bits long"), "passages")
    open_ = passages.where("bits = 0").withColumn("order", F.struct("doc", (F.col("row") >= NO_ID).alias("unnamed")))
    first = open_.groupBy("p1", "p2").agg(F.min("order").alias("low"), F.max("order").alias("high")).where("low < high")
    first = work.save(first, "first")  # so that its size is known: where it is small, no hot passage moves
    again = open_.join(first, ["p1", "p2"]).where("order > low").groupBy("row", "at").agg(F.bit_or(F.expr("shiftleft(1L, o)")).alias("bits"))
    return [again, passages.where("bits <> 0").select("row", "at", "bits")]


def halved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contexts for the passages with ``low`` to ``high`` bytes before the q-gram, once for each half of these that lies inside the text.

    h becomes a hash of the bytes that all passages of the half share; p1 and p2 are hashes of those that any of them has, beyond the
    text as a sign of its own; bits are the passages inside the text.
    """
    for batch in batches:
        for (low, high), at in batch.groupby(["low", "high"]).indices.items():
            some, middle = batch.iloc[at], (low + high) // 2
            x = np.frombuffer(b"".join(some["context"]), np.uint8).reshape(-1, CONTEXT).astype(np.uint64) + np.uint64(1)
            start = some["at"].to_numpy() - BEFORE
            place = start[:, None] + np.arange(CONTEXT)
            x[(place < 0) | (place >= some["size"].to_numpy()[:, None])] = 0
            of_row = np.arange(len(some)) * CONTEXT
            for a, b in ((low, middle), (middle + 1, high)):
                o = np.arange(BEFORE - b, BEFORE - a + 1)
                inside = (start[:, None] + o >= 0) & (start[:, None] + o + LENGTH <= some["size"].to_numpy()[:, None])
                bits = (inside * (np.int64(1) << o)).sum(1)
                keep = bits != 0
                if keep.any():
                    all_, common = of_row[keep] + BEFORE - b, of_row[keep] + BEFORE - a
                    p1, p2 = (rolling(y, LENGTH + b - a)[all_].view(np.int64) for y in (x.ravel(), mix(x.ravel())))
                    h = mix(rolling(x.ravel(), LENGTH - b + a)[common] * _BASE + np.uint64(a)).view(np.int64)
                    yield some[keep].assign(h=h, low=np.int32(a), high=np.int32(b), p1=p1, p2=p2, bits=bits[keep])


def order_of(doc: pd.Series, row: pd.Series) -> np.ndarray:
    """Numbers that order rows by doc_id, null last."""
    return np.unique(doc.to_numpy(), return_inverse=True)[1] * 2 + (row.to_numpy() >= NO_ID)


def passages_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The passages inside a text of each context, by two 64-bit hashes: (p1, p2, doc, row, at, o, bits). Of TOGETHER contexts those that a
    smaller document has too become bits of their context (o is 0 there, as are p1 and p2), those of the least document rows with
    bits 0."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= TOGETHER:
            yield from compared(pd.concat(held, ignore_index=True))
            held = []
    if held:
        yield from compared(pd.concat(held, ignore_index=True))


def compared(some: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """passages_of() these contexts."""
    count = CONTEXT - LENGTH + 1
    bytes_ = np.frombuffer(b"".join(some["context"]), np.uint8).astype(np.uint64) + np.uint64(1)
    start = (np.arange(len(some)) * CONTEXT)[:, None] + np.arange(count)
    place = (some["at"].to_numpy() - BEFORE)[:, None] + np.arange(count)
    inside = (place >= 0) & (place + LENGTH <= some["size"].to_numpy()[:, None])
    if "low" in some:  # bytes before the q-gram
        before = BEFORE - np.arange(count)
        inside &= (before >= some["low"].to_numpy()[:, None]) & (before <= some["high"].to_numpy()[:, None])
    r, o = np.nonzero(inside)
    if not len(r):
        return
    p1, p2 = (rolling(x, LENGTH)[start[r, o]].view(np.int64) for x in (bytes_, mix(bytes_)))
    number = order_of(some["doc"], some["row"])[r]
    order = np.lexsort((number, p2, p1))
    r, o, p1, p2, number = r[order], o[order], p1[order], p2[order], number[order]
    first = np.r_[True, (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])]
    later = number > number[first][np.cumsum(first) - 1]
    bits = np.zeros(len(some), np.int64)
    np.bitwise_or.at(bits, r[later], np.int64(1) << o[later])
    mine = ["doc", "row", "at"]
    done = some.loc[bits != 0, mine]
    yield pd.DataFrame({"p1": 0, "p2": 0, **{c: done[c].to_numpy() for c in mine}, "o": np.int32(0), "bits": bits[bits != 0]}, columns=["p1", "p2", *mine, "o", "bits"])
    rest = ~later
    yield pd.DataFrame({"p1": p1[rest], "p2": p2[rest], **{c: some[c].to_numpy()[r[rest]] for c in mine}, "o": o[rest].astype(np.int32), "bits": np.int64(0)})


def removed(data: bytes, at: np.ndarray | None, bits: np.ndarray | None) -> np.ndarray:
    """Which bytes of a text the repeated passages cover."""
    n = len(data)
    cover = np.zeros(n + 1, np.int64)
    if at is not None:
        starts = (at.astype(np.int64) - BEFORE)[:, None] + np.arange(CONTEXT - LENGTH + 1)
        starts = starts[(bits[:, None] >> np.arange(CONTEXT - LENGTH + 1)) & 1 == 1]
        starts = np.unique(starts[(starts >= 0) & (starts + LENGTH <= n)])
        cover[starts] += 1
        cover[starts + LENGTH] -= 1
    return np.cumsum(cover[:-1]) > 0


def without_repeats(spark: SparkSession, docs: DataFrame, *, digest: bool = False, buckets: int | None = None) -> DataFrame:
    """Remove from each text the bytes covered by a LENGTH-byte passage that a document with a smaller doc_id has too.

    Returns doc_id, n_bytes, n_removed, n_spans and kept (the other bytes in UTF-8, decoded; where a removal cuts a
    character, its remaining bytes are left out) or, with ``digest``, kept_sha256 of the kept bytes as they are.

    Null texts are empty. A null doc_id is larger than all others, and rows that share a doc_id do not count for each
    other. Passages are judged on the input. A very long text costs memory in proportion to it in the task that reads it. An
    empty table gives an empty result; other columns are left out.
    """
    work = Workspace(spark, "suffixes")
    rows = work.save_by(numbered(docs), "texts", "row")  # joins on the row do not move texts
    done = cut(spark, work, rows, digest=digest, buckets=buckets)
    return done.select(doc_id(), "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept")


def cut(spark: SparkSession, work: Workspace, rows: DataFrame, *, keep: tuple[str, ...] = (), digest: bool = False, buckets: int | None = None) -> DataFrame:
    """row, doc, ``keep``, n_bytes, n_removed, n_spans and kept or kept_sha256, as without_repeats(), of ``rows`` (row, a number of its own;
    doc, its order; data), which ``work`` has saved by row."""
    small_batches(spark)
    if buckets is None:  # of BUCKET_BYTES; in a very large corpus of more, so that a task sends fewer parts
        size = rows.agg(F.sum(F.octet_length("data"))).first()[0] or 0
        buckets = max(1, math.ceil(size / max(BUCKET_BYTES, 30 * math.sqrt(size))))
    marks = work.save(repeated(spark, work, rows, buckets), "marks")
    work.keep(rows, marks)
    out = "kept_sha256 string" if digest else "kept string"

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for row, doc, data, at, bits in zip(batch["row"], batch["doc"], batch["data"], batch["ats"], batch["bits"], strict=True):
                gone = removed(data, at, bits)
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                found.append((row, doc, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "ignore")))
            yield pd.DataFrame(found, columns=["row", "doc", "n_bytes", "n_removed", "n_spans", out.split()[0]])

    done = rows.join(marks, "row", "left").select("row", "doc", "data", "ats", "bits")
    done = done.mapInPandas(finish, f"row long, doc long, n_bytes long, n_removed long, n_spans long, {out}")
    return done.join(rows.select("row", *keep), "row") if keep else done


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)


OP5_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
     g AS (SELECT doc_id, s, substr(x, 2 * s - 1, 100) AS k FROM t, unnest(range(1, (length(x) // 2) - 48)) AS u(s)),
     m AS (SELECT doc_id, s, doc_id > min(doc_id) OVER (PARTITION BY k) AS again FROM g),
     r AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM m WHERE again),
     c AS (SELECT doc_id, s, sum(CASE WHEN p IS NULL OR s > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM r),
     spans AS (SELECT doc_id, span, min(s) AS a, max(s) + 49 AS b FROM c GROUP BY ALL),
     edges AS (SELECT doc_id, b + 1 AS a, lead(a, 1) OVER (PARTITION BY doc_id ORDER BY a) - 1 AS b FROM spans
               UNION ALL SELECT doc_id, 1, min(a) - 1 FROM spans GROUP BY doc_id),
     rest AS (SELECT t.doc_id, string_agg(substr(x, 2 * e.a - 1, 2 * (coalesce(e.b, length(x) // 2) - e.a + 1)), '' ORDER BY e.a) AS kept
              FROM t JOIN edges e USING (doc_id) GROUP BY t.doc_id),
     n AS (SELECT doc_id, sum(b - a + 1) AS gone, count(*) AS spans FROM spans GROUP BY doc_id)
SELECT t.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN rest USING (doc_id)
"""
