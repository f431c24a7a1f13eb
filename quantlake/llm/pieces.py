"""Byte-pair pieces of a SentencePiece vocabulary, with seeded merge-dropout and lossless decoding."""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantlake.llm.common import as_long, id_text, mix, small_batches

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_MARK = 0x2581
_MASK = (1 << 64) - 1
_START, _END, _MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Characters that are merged side by side at once; a longer text is cut between units.
CHUNK = 1 << 18
#: Units beyond this length are merged one by one with a heap, the others side by side.
SHORT = 48
_NEVER = np.int64(1 << 62)
_CUT = re.compile(rf"(?<! ) |[\n{SPACE}]")


class Pieces:
    """Encodes and decodes with the pieces and scores of a SentencePiece BPE model that has all 256 byte pieces.

    Of the candidate merges on a unit's agenda the best score (then the leftmost) comes first. A candidate is skipped if a
    hash keyed by seed, document, place of the unit and span in it falls below ``dropout``; a later merge next to it makes a
    new candidate. Every occurrence of a unit is drawn anew. Units are a run of spaces with what follows, line feeds, and
    U+2581 of the text itself, since no piece joins them. The agendas of many units advance side by side: a round takes the
    first candidate of each.
    """

    def __init__(self, path: str, dropout: float = 0.0, seed: int = 0, short: int = SHORT) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.byte_ids, raw = np.zeros(256, np.int32), [b""] * n
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                raw[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece], self.rank[piece] = i, -sp.get_score(i)
                raw[i] = piece.replace(SPACE, " ").encode()
        inner = [p for p in self.ids if len(p) > 1]
        if any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in inner):
            raise ValueError("a piece of this vocabulary crosses the units that are encoded apart")
        self.below, self.seed, self.short, self.n = int(dropout * (1 << 32)), seed, short, n
        self.blob = np.frombuffer(b"".join(raw), np.uint8)
        self.sizes = np.array([len(x) for x in raw], np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes

        # Symbols are the pieces, then characters that only occur inside pieces, then one for all other characters.
        symbols = dict(self.ids)
        for piece in inner:
            for char in piece:
                symbols.setdefault(char, n + len(symbols) - len(self.ids))
        self.other = n + len(symbols) - len(self.ids)
        self.of_char = np.full(0x110000, self.other, np.int32)
        for symbol, i in symbols.items():
            if len(symbol) == 1:
                self.of_char[ord(symbol)] = i
        self.length = np.zeros(self.other + 1, np.int64)
        self.order = np.zeros(self.other + 1, np.int64)
        place = {r: k for k, r in enumerate(sorted(set(self.rank.values())))}
        for piece, i in self.ids.items():
            self.length[i], self.order[i] = len(piece), place[self.rank[piece]]
        pairs = [(symbols[p[:k]], symbols[p[k:]], self.ids[p]) for p in inner for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        self.hash_pairs(np.array(pairs, np.int64).reshape(-1, 3))

    def hash_pairs(self, pairs: np.ndarray) -> None:
        """An open-addressed table of the pairs of symbols that a merge joins."""
        self.bits = max(10, int(len(pairs) * 8).bit_length())
        self.pair = np.full(1 << self.bits, -1, np.int64)
        self.joined = np.full(1 << self.bits, -1, np.int32)
        keys, values = pairs[:, 0] << 32 | pairs[:, 1], pairs[:, 2]
        slots = self.slots(keys)
        while len(keys):
            free = self.pair[slots] == -1
            self.pair[slots[free]] = keys[free]
            put = self.pair[slots] == keys
            self.joined[slots[put]] = values[put]
            keys, values, slots = keys[~put], values[~put], (slots[~put] + 1) & (1 << self.bits) - 1

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(_START)) >> np.uint64(64 - self.bits)).view(np.int64)

    def merge_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, or -1."""
        keys = left.astype(np.int64) << 32 | right
        slots = self.slots(keys)
        found = self.pair[slots]
        out = np.where(found == keys, self.joined[slots], -1)
        rest = np.flatnonzero((found != keys) & (found != -1))
        while len(rest):
            slots[rest] = (slots[rest] + 1) & (1 << self.bits) - 1
            found = self.pair[slots[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.joined[slots[rest[hit]]]
            rest = rest[~hit & (found != -1)]
        return out

    def skipped(self, keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = keys + start.astype(np.uint64) * np.uint64(_START) + end.astype(np.uint64) * np.uint64(_END)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(_MIX)
        return (x >> np.uint64(32)) < np.uint64(self.below)

    def skips(self, key: int, start: int, end: int) -> bool:
        x = (key + start * _START + end * _END) & _MASK
        x = ((x ^ (x >> 29)) * _MIX) & _MASK
        return (x >> 32) < self.below

    def agenda(self, unit: str, key: int) -> list[int]:
        """Ends of the parts of one unit, by a heap: n log n, for units of any length."""
        n = len(unit)
        ends, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            j = ends[i]
            if j < n and (r := self.rank.get(unit[i : ends[j]])) is not None:
                heapq.heappush(heap, (r, i, j, ends[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, end = heapq.heappop(heap)
            if not alive[i] or ends[i] != j or not alive[j] or ends[j] != end:
                continue
            if self.below and self.skips(key, i, end):
                continue
            alive[j], ends[i] = False, end
            if end < n:
                before[end] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ends[i])
            i = ends[i]
        return out

    def merge(self, symbol: np.ndarray, begin: np.ndarray, end: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Merge the units [begin, end) of ``symbol`` in place, side by side; returns which places stay."""
        alive = np.ones(len(symbol), bool)
        size = end - begin
        first = np.cumsum(size) - size
        unit = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(unit)) - np.repeat(first - begin, size)
        own = symbol[at]
        joined = np.full(len(at), -1, np.int32)
        inner = np.flatnonzero(unit[:-1] == unit[1:])
        joined[inner] = self.merge_of(own[inner], own[inner + 1])
        rank = np.where(joined >= 0, self.order[joined], _NEVER >> 24)
        while len(first):
            best = np.minimum.reduceat((rank << 24) | np.arange(len(rank)), first)
            going = best < _NEVER
            pick = best[going] & (1 << 24) - 1
            owner = unit[pick]
            start = at[pick] - begin[owner]
            if self.below:
                skip = self.skipped(keys[owner], start, start + self.length[joined[pick]])
                rank[pick[skip]] = _NEVER >> 24
                pick = pick[~skip]
            own[pick] = joined[pick]
            symbol[at[pick]] = own[pick]
            alive[at[pick + 1]] = False
            keep = np.repeat(going, size)
            keep[pick + 1] = False
            size = np.add.reduceat(keep, first, dtype=np.int64)[going]
            moved = np.cumsum(keep) - 1
            pick = moved[pick]
            unit, at, own, joined, rank = unit[keep], at[keep], own[keep], joined[keep], rank[keep]
            first = np.cumsum(size) - size
            left = pick[pick > 0] - 1
            changed = np.concatenate([pick, left[unit[left] == unit[left + 1]]])
            joined[changed], rank[changed] = -1, _NEVER >> 24
            changed = changed[changed + 1 < len(unit)]
            changed = changed[unit[changed] == unit[changed + 1]]
            found = self.merge_of(own[changed], own[changed + 1])
            joined[changed] = found
            rank[changed] = np.where(found >= 0, self.order[found], _NEVER >> 24)
        return alive

    def encode_chunk(self, texts: Sequence[str], heads: np.ndarray, keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of ``texts`` in one array, how many each has, and how many units; ``heads`` says which begin a document, ``places``
        how many units of the document come before."""
        sizes = np.array([len(t) for t in texts], np.int64) + heads
        joined = "".join(f" {t}" if h else t for t, h in zip(texts, heads.tolist(), strict=True))
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        if not len(code):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        space, alone = code == 32, (code == 10) | (code == _MARK)
        starts = alone | space
        starts[1:] = alone[1:] | alone[:-1] | (space[1:] & ~space[:-1])
        begins = (np.cumsum(sizes) - sizes)[sizes > 0]
        starts[begins] = True
        begin = np.flatnonzero(starts)
        end = np.append(begin[1:], len(code))
        text = np.repeat(np.arange(len(texts)), sizes)[begin]
        units = np.bincount(text, minlength=len(texts))
        place = np.arange(len(begin)) - (np.cumsum(units) - units)[text] + places[text]
        unit_keys = self.unit_keys(keys[text], place)
        symbol = self.of_char[code]
        symbol[space] = self.of_char[_MARK]
        symbol[code == _MARK] = self.other  # U+2581 of the text becomes byte pieces, so it decodes to itself
        alive = np.ones(len(code), bool)
        short = (end - begin > 1) & (end - begin <= self.short)
        if short.any():
            alive = self.merge(symbol, begin[short], end[short], unit_keys[short])
        for k in np.flatnonzero(end - begin > self.short).tolist():
            a, b = int(begin[k]), int(end[k])
            unit = joined[a:b].replace(" ", SPACE)
            cuts = self.agenda(unit, int(unit_keys[k]))
            alive[a:b] = False
            for i, j in zip([0, *cuts[:-1]], cuts, strict=True):
                alive[a + i] = True
                if j - i > 1:
                    symbol[a + i] = self.ids[unit[i:j]]
        owner = np.repeat(np.arange(len(texts)), sizes)[alive]
        ids, code = symbol[alive], code[alive]
        odd = np.flatnonzero(ids >= self.n)
        if len(odd):
            raw = {c: chr(c).encode() for c in set(code[odd].tolist())}
            counts = np.ones(len(ids), np.int64)
            counts[odd] = [len(raw[c]) for c in code[odd].tolist()]
            at = (np.cumsum(counts) - counts)[odd]
            ids, owner = np.repeat(ids, counts), np.repeat(owner, counts)
            fill = np.repeat(at - np.cumsum(counts[odd]) + counts[odd], counts[odd]) + np.arange(counts[odd].sum())
            ids[fill] = self.byte_ids[np.frombuffer(b"".join(raw[c] for c in code[odd].tolist()), np.uint8)]
        return ids.astype(np.int32), np.bincount(owner, minlength=len(texts)), units

    def unit_keys(self, keys: np.ndarray, places: np.ndarray) -> np.ndarray:
        order = (places.astype(np.uint64) + np.uint64(1)) * np.uint64(_START)
        return mix(order + keys + np.uint64(self.seed * 0xD6E8FEB86659FD93 & _MASK))

    def encode_all(self, texts: Sequence[str], keys: np.ndarray) -> list[np.ndarray]:
        """Ids of each text; ``keys`` (of the documents) and the place of a unit key the skips in it."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, str, int, int]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if held:
                which, some, heads, places = zip(*held, strict=True)
                ids, counts, units = self.encode_chunk(some, np.array(heads), keys[list(which)], np.array(places))
                for k, part in zip(which, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                    out[k].append(part)
                seen[which[-1]] = places[-1] + int(units[-1])
            held.clear()
            size = 0

        seen: dict[int, int] = {}
        for k, text in enumerate(texts):
            a = 0
            while True:
                cut = _CUT.search(text, a + CHUNK) if len(text) - a > CHUNK else None
                b = cut.start() if cut else len(text)
                if size + b - a > CHUNK:
                    flush()
                held.append((k, text[a:b], int(a == 0), seen.get(k, 0)))
                size += b - a
                if b == len(text):
                    break
                flush()
                a = b
        flush()
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]

    def encode(self, text: str, key: int = 0) -> np.ndarray:
        return self.encode_all([text], np.array([key], np.uint64))[0]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The text in UTF-8, without the space put before every text."""
        out = []
        for at in range(0, len(ids), CHUNK):
            some = ids[at : at + CHUNK]
            sizes = self.sizes[some]
            places = np.repeat(self.offsets[some] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            out.append(self.blob[places].tobytes())
        return b"".join(out)[1:]

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(np.asarray(ids)).decode()


@functools.lru_cache(maxsize=4)
def coder(path: str, dropout: float, seed: int) -> Pieces:
    """One for each worker process, so its tables are read once and not in every task."""
    return Pieces(path, dropout, seed)


def keyed(doc_id: int | None, text: str, number: int, seed: int) -> int:
    own = b"-" + text.encode() if doc_id is None else doc_id.to_bytes(8, "little", signed=True)
    return xxhash.xxh64_intdigest(number.to_bytes(8, "little", signed=True) + own, seed)


def encode(
    spark: SparkSession, docs: DataFrame, *, vocabulary: str = VOCABULARY, dropout: float = 0.1, seed: int = 17, digest: bool = False, copy: str | None = None
) -> DataFrame:
    """doc_id, n_pieces, lossless and ids (or, with ``digest``, ids_sha and decoded_sha instead of ids) of every whole text.

    Null texts give null ids, n_pieces and shas, and lossless true; an empty text gives the one piece of the leading space.
    Texts of any length are cut between units, so what is held besides the text and its ids has the size of CHUNK or of
    the longest run without a blank. Reruns agree: what is skipped depends on seed, doc_id (the text where that is null),
    the number in the column ``copy``, if one is named, and place alone, so repeated rows are encoded alike and copies
    under other ids or numbers differently. An empty table gives an empty result; other columns are left out.
    """
    small_batches(spark)
    schema = "doc_id string, n_pieces int, lossless boolean, " + ("ids_sha string, decoded_sha string" if digest else "ids array<int>")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = coder(vocabulary, dropout, seed)
        for batch in batches:
            ids = batch["doc_id"].tolist()
            texts, numbers = batch["text"].tolist(), batch["copy"].tolist()
            keys = np.array([keyed(None if i is None else int(i), t or "", n, seed) for i, t, n in zip(ids, texts, numbers, strict=True)], np.uint64)
            out = []
            for doc_id, text, found in zip(ids, texts, pieces.encode_all([t or "" for t in texts], keys), strict=True):
                if text is None:
                    out.append((doc_id, None, True, *[None] * (1 + digest)))
                    continue
                back = pieces.decode_bytes(found)
                real = (hashlib.sha1(found.tobytes()).hexdigest(), hashlib.sha1(back).hexdigest()) if digest else (found,)
                out.append((doc_id, len(found), back == text.encode(), *real))
            columns = ["doc_id", "n_pieces", "lossless", *(["ids_sha", "decoded_sha"] if digest else ["ids"])]
            yield pd.DataFrame(out, columns=columns).astype({"n_pieces": "Int32"})

    number = F.coalesce(F.col(copy).cast("long"), F.lit(0)) if copy else F.lit(0).cast("long")
    return as_long(docs.select(id_text(), "text", number.alias("copy")).mapInPandas(work, schema))


def decode(spark: SparkSession, encoded: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and text of every row of ``encoded`` (doc_id, ids), whatever dropout it was encoded with; null ids give null."""
    small_batches(spark)

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        pieces = coder(vocabulary, 0.0, 0)
        return ids.map(lambda x: None if x is None else pieces.decode(np.asarray(x)))

    return encoded.select("doc_id", text("ids").alias("text"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
