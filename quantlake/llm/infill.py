"""Fill-in-middle transformation of whole texts, with cuts between units found by a table-driven automaton over bytes.

A unit is a run of letters A-Z and a-z, or any other single character. The automaton's states tell where a byte stands: in a
run of letters, in a character of several bytes, and how much of a sentinel has been read. The table is built from
these rules for any sentinels. One scan of a batch of texts emits a code a transition (a unit begins, a character begins, a
sentinel ends), and the codes are counted by text; a second pass over the codes locates the cuts, once the number of
units has settled where they fall.

A state depends on the last few bytes alone. So a batch is scanned in many blocks side by side, each of which first reads
as many bytes before its own as it takes for all states to agree.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantlake.llm.common import small_batches

#: What a transition emits.
UNIT, CHARACTER, SENTINEL = 1, 2, 4
#: Stands between texts; no byte of UTF-8.
GAP = 0xFF
FOUND = "n long, marked boolean, first long, second long, prefix_chars long, middle_chars long"


@dataclass(frozen=True)
class Sentinels:
    """Marks of the prefix, the suffix and the middle. Each starts with a character that is nowhere else in them, so that a mark
    next to a text never makes another mark."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = self.all
        if len(set(marks)) < 3 or any(not m or any(m[0] in other[1:] for other in marks) for m in marks):
            raise ValueError("sentinels must differ and start with a character that is nowhere else in them")

    @property
    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


@dataclass(frozen=True)
class Automaton:
    """``step[state, byte]`` is the next state, ``emit[state, byte]`` the code of the transition; state 0 is the start of a text."""

    sentinels: Sentinels = field(default_factory=Sentinels)

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        marks = [m.encode() for m in self.sentinels.all]
        heads = {m[:i] for m in marks for i in range(len(m) + 1)}

        def after(state: tuple[bytes, str], byte: int) -> tuple[tuple[bytes, str], int]:
            read, kind = state
            if byte == GAP:
                return (b"", "other"), 0
            read += bytes([byte])
            ended = any(read.endswith(m) for m in marks)
            while read not in heads:
                read = read[1:]
            code = SENTINEL if ended else 0
            if 0x80 <= byte < 0xC0 and kind.isdigit():  # the character goes on
                return (read, str(int(kind) - 1) if int(kind) > 1 else "other"), code
            if bytes([byte]).isalpha():
                return (read, "letter"), code | CHARACTER | (0 if kind == "letter" else UNIT)
            rest = 3 if byte >= 0xF0 else 2 if byte >= 0xE0 else 1 if byte >= 0xC0 else 0
            return (read, str(rest) if rest else "other"), code | CHARACTER | UNIT

        states, step, emit = {(b"", "other"): 0}, [], []
        todo = list(states)
        for state in todo:  # grows as states are met
            found = [after(state, byte) for byte in range(256)]
            for nxt, _ in found:
                if nxt not in states:
                    states[nxt] = len(states)
                    todo.append(nxt)
            step.append([states[nxt] for nxt, _ in found])
            emit.append([code for _, code in found])
        return np.array(step, np.int32), np.array(emit, np.uint8)

    @cached_property
    def memory(self) -> int:
        """After so many bytes the state is the same whatever it was before them."""
        step, _ = self.table
        apart, n = {frozenset(p) for p in combinations(range(len(step)), 2)}, 0
        while apart:
            apart = {p for a, b in map(tuple, apart) for p in map(frozenset, zip(step[a].tolist(), step[b].tolist(), strict=True)) if len(p) == 2}
            n += 1
        return n

    def scan(self, data: bytes) -> np.ndarray:
        """The code that each byte of ``data`` emits, texts in it being separated by GAP."""
        step, emit = (t.reshape(-1) for t in self.table)
        width = max(self.memory, 16, math.isqrt(len(data) // 4))
        blocks = -(-len(data) // width)
        x = np.full((blocks + 1) * width, GAP, np.uint8)  # a block of gaps goes before the first
        x[width : width + len(data)] = np.frombuffer(data, np.uint8)
        by_place = np.ascontiguousarray(x.reshape(-1, width).T).astype(np.int32)
        state, codes = np.zeros(blocks, np.int32), np.empty((width, blocks), np.uint8)
        for place in range(width - self.memory, width):
            state = step[state * 256 + by_place[place, :-1]]
        for place in range(width):
            at = state * 256 + by_place[place, 1:]
            codes[place] = emit[at]
            state = step[at]
        return codes.T.reshape(-1)[: len(data)]


@lru_cache(maxsize=4)
def automaton(sentinels: Sentinels) -> Automaton:
    return Automaton(sentinels)


def cuts(texts: list[bytes], h1: np.ndarray, h2: np.ndarray, sentinels: Sentinels) -> pd.DataFrame:
    """The columns of FOUND: units, whether there is a sentinel, byte offsets of both cuts, characters of prefix and middle."""
    if not texts:
        return pd.DataFrame({c.split()[0]: [] for c in FOUND.split(", ")})
    codes = automaton(sentinels).scan(b"".join(t + b"\xff" for t in texts))
    sizes = np.array([len(t) + 1 for t in texts])
    begin = np.cumsum(sizes) - sizes
    counted = {c: np.add.reduceat((codes & c) > 0, begin, dtype=np.int64) for c in (UNIT, SENTINEL)}
    n = counted[UNIT]
    places = np.flatnonzero(codes & UNIT)  # of all units; those of a text start at its first
    first_unit = np.cumsum(n) - n
    chars = np.concatenate([[0], np.cumsum((codes & CHARACTER) > 0, dtype=np.int64)])

    def offset(cut: np.ndarray) -> np.ndarray:
        inside = places[np.minimum(first_unit + cut, max(len(places) - 1, 0))] if len(places) else begin
        return np.where(cut < n, inside, begin + sizes - 1)

    a, b = h1 % (n + 1), h2 % (n + 1)
    low, high = offset(np.minimum(a, b)), offset(np.maximum(a, b))
    return pd.DataFrame({
        "n": n, "marked": counted[SENTINEL] > 0, "first": low - begin, "second": high - begin,
        "prefix_chars": chars[low] - chars[begin], "middle_chars": chars[high] - chars[low],
    })


def transform(docs: DataFrame, *, seed: int = 1, sentinels: Sentinels | None = None, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of each row of ``docs``, which has doc_id and text.

    Cuts and form are drawn from the SHA-256 of the seed and the doc_id. A text is left plain if it is empty, contains a sentinel
    or is drawn to be; of the others ``spm_percent`` have the suffix first, the rest the prefix. A null text is empty; a null
    doc_id counts as empty text in the draw. Rows that share a doc_id draw the same numbers, each for its own units.
    Other columns are left out, and an empty table gives an empty result. A text is scanned whole in one task.
    """
    marks = sentinels or Sentinels()
    sha = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring("_sha", 8 * k + 1, 8), 16, 10).cast("long").alias(f"_h{k + 1}") for k in range(4)]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("_data"), sha.alias("_sha"))

    @F.pandas_udf(FOUND)
    def locate(data: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
        return cuts(data.tolist(), h1.to_numpy(), h2.to_numpy(), marks)

    cut = rows.select("doc_id", "_data", *drawn).withColumn("_cut", locate("_data", "_h1", "_h2"))
    plain = (F.col("_cut.n") == 0) | F.col("_cut.marked") | (F.col("_h3") % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(F.col("_h4") % 100 < spm_percent, "spm").otherwise("psm")
    text = lambda begin, length: F.expr(f"cast(substring(_data, {begin}, {length}) as string)")  # noqa: E731  by bytes
    prefix, middle = text("1", "cast(_cut.first as int)"), text("cast(_cut.first as int) + 1", "cast(_cut.second - _cut.first as int)")
    suffix = text("cast(_cut.second as int) + 1", "octet_length(_data)")
    p, s, m = map(F.lit, marks.all)
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle))
    unless_plain = lambda c: F.when(F.col("form") != "plain", F.col(f"_cut.{c}")).alias(c)
    named = cut.withColumn("form", form)
    return named.select("doc_id", F.col("_cut.n").alias("n"), "form", unless_plain("prefix_chars"), unless_plain("middle_chars"), F.coalesce(output, F.col("_data").cast("string")).alias("output"))


def restore(output: Column, form: Column, sentinels: Sentinels | None = None) -> Column:
    """The text that transform() made ``output`` of."""
    marks = sentinels or Sentinels()

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        a, b = F.locate(second, output), F.locate(marks.middle, output)
        one = F.substring(output, F.lit(len(first) + 1), a - len(first) - 1)
        two = F.substring(output, a + len(second), b - a - len(second))
        return one, two, F.substring(output, b + len(marks.middle), F.length(output))

    prefix, suffix, middle = parts(marks.prefix, marks.suffix)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(marks.suffix, marks.prefix)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = transform(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    restored = F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), restored)


OP11_SQL = """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents),
g AS (
    SELECT doc_id, x, u, len(u) AS n, ('0x' || substr(h, 1, 8))::UBIGINT AS h1, ('0x' || substr(h, 9, 8))::UBIGINT AS h2,
           ('0x' || substr(h, 17, 8))::UBIGINT AS h3, ('0x' || substr(h, 25, 8))::UBIGINT AS h4 FROM d),
c AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN n = 0 OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (
    SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END)
           AS output_sha256, sha256(x) AS restored_sha256
FROM p
"""
