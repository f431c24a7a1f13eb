"""A hidden Markov language model: Baum-Welch over all training texts, exact likelihood by the scaled forward recursion.

A latent state emits one of a bounded number of symbols: the most frequent words have symbols of their own, the others
share one by their ending. The word is then drawn from its symbol by its add-one frequency, so the probability of a text is
that of its symbols under the Markov chain, times that of each word given its symbol.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantlake.llm.common import Workspace, added_up, as_long, id_bucket, id_text, packed, small_batches, tidy

#: Hash that stands for the token at the end of a text; its symbol is 0.
END = 0
ENDINGS = 1024
#: Tokens of a text that are held as states; a longer one is taken in parts.
PART = 200_000


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def word_ids(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word as a signed integer that is not END."""
    ids = (np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) ^ np.uint64(1 << 63)).view(np.int64)
    ids[ids == END] = 1
    return ids


def endings(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh32_intdigest(w[-3:]) for w in words), np.int64, len(words)) % ENDINGS


def look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: int) -> np.ndarray:
    """The value of each wanted key; ``keys`` are distinct, in any order."""
    if not len(keys):
        return np.full(len(wanted), default, np.int64)
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


@dataclass
class Chain:
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray  # symbols x states

    @staticmethod
    def initial(states: int, frequency: np.ndarray, seed: int) -> Chain:
        rng = np.random.default_rng(seed)
        emit = frequency[:, None] * rng.uniform(0.2, 1.8, (len(frequency), states))
        step = np.full((states, states), 0.2 / states) + np.eye(states) * 0.8
        return Chain(np.full(states, 1 / states), step / step.sum(1, keepdims=True), emit / emit.sum(0))


class Lanes:
    """Texts side by side, longest first, so that step t has the first ``width[t]`` lanes; symbols in the order of t."""

    def __init__(self, texts: list[np.ndarray]) -> None:
        self.order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        sizes = np.array([len(texts[i]) for i in self.order])
        self.width = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
        self.at = np.concatenate([[0], np.cumsum(self.width)])
        flat = np.concatenate([texts[i] for i in self.order])
        place = np.concatenate([self.at[: len(texts[i])] + k for k, i in enumerate(self.order)])
        self.symbols = np.empty(len(flat), np.int64)
        self.symbols[place] = flat

    def lanes(self) -> np.ndarray:
        """The lane of each place."""
        return np.arange(self.at[-1]) - np.repeat(self.at[:-1], self.width)

    def before(self) -> np.ndarray:
        """The place one step earlier in the same lane, for each place after the first step."""
        return np.arange(self.at[1], self.at[-1]) - np.repeat(self.width[:-1], self.width[1:])


def forward(chain: Chain, lanes: Lanes, keep: bool, prior: np.ndarray | None = None) -> tuple[np.ndarray | None, ...]:
    """log10 likelihood of each text or, with ``keep``, in its place None and what expected() needs: scaled forward
    probabilities (states x places), their scales, and the emission of each place's symbol. ``prior`` is the distribution
    of the first states, if not the chain's start."""
    emitted = np.take(chain.emit.T, lanes.symbols, axis=1)
    alphas, scales = np.empty_like(emitted), np.empty(lanes.at[-1])
    step, at = np.ascontiguousarray(chain.step.T), lanes.at.tolist()
    for t, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        now = alphas[:, a:b]
        if t == 0:
            now[:] = (chain.start if prior is None else prior)[:, None]
        else:
            np.matmul(step, alphas[:, at[t - 1] : at[t - 1] + b - a], out=now)
        now *= emitted[:, a:b]
        now /= now.sum(0, out=scales[a:b])
    if keep:
        return None, alphas, scales, emitted
    out = np.empty(len(lanes.order))
    out[lanes.order] = np.bincount(lanes.lanes(), weights=np.log10(scales))
    return out, alphas, None, None


def expected(chain: Chain, lanes: Lanes, prior: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Expected counts of starts, steps and emissions, summed over the lanes, and the first place's emission times what
    follows. A part of a text that is one lane begins from ``prior`` and goes on with ``after``, that of the next part."""
    _, alphas, scales, ahead = forward(chain, lanes, True, prior)
    betas, at = np.ones_like(alphas), lanes.at.tolist()
    if after is not None:
        betas[:, -1] = chain.step @ after
    ahead /= scales
    for t in range(len(lanes.width) - 1, 0, -1):
        a, b = at[t], at[t + 1]
        ahead[:, a:b] *= betas[:, a:b]
        np.matmul(chain.step, ahead[:, a:b], out=betas[:, at[t - 1] : at[t - 1] + b - a])
    steps = (alphas[:, lanes.before()] @ ahead[:, at[1] :].T) * chain.step
    if after is not None:
        steps += np.outer(alphas[:, -1], after) * chain.step
    first = ahead[:, 0] * betas[:, 0]
    betas *= alphas
    emits = np.stack([np.bincount(lanes.symbols, weights=gamma, minlength=len(chain.emit)) for gamma in betas], 1)
    return betas[:, : at[1]].sum(1), steps, emits, first


def parts_of(chain: Chain, text: np.ndarray, size: int) -> Iterator[tuple[Lanes, np.ndarray, float]]:
    """Parts of a long text with the distribution of their first state and the log10 likelihood; only one is held."""
    prior = chain.start
    for at in range(0, len(text), size):
        lanes = Lanes([text[at : at + size]])
        log, alphas, _, _ = forward(chain, lanes, False, prior)
        yield lanes, prior, float(log[0])
        prior = chain.step.T @ alphas[:, -1]


def log_likelihoods(chain: Chain, texts: list[np.ndarray], size: int = PART) -> np.ndarray:
    """Texts side by side, and those of more than ``size`` tokens part by part."""
    out = np.zeros(len(texts))
    short = [i for i, x in enumerate(texts) if len(x) <= size]
    if short:
        out[short] = forward(chain, Lanes([texts[i] for i in short]), False)[0]
    for i in (i for i, x in enumerate(texts) if len(x) > size):
        out[i] = sum(log for _, _, log in parts_of(chain, texts[i], size))
    return out


def expected_counts(chain: Chain, texts: list[np.ndarray], size: int = PART) -> np.ndarray:
    """Expected starts, steps and emissions of all texts, as one array; long texts part by part, from the last one back."""
    states, symbols = len(chain.start), len(chain.emit)
    total = np.zeros(states + states * states + symbols * states)
    short = [x for x in texts if len(x) <= size]
    if short:
        total += np.concatenate([p.ravel() for p in expected(chain, Lanes(short))[:3]])
    for text in (x for x in texts if len(x) > size):
        priors, after = [prior for _, prior, _ in parts_of(chain, text, size)], None
        for k in reversed(range(len(priors))):
            starts, steps, emits, after = expected(chain, Lanes([text[k * size : (k + 1) * size]]), priors[k], after)
            total += np.concatenate([starts * (k == 0), steps.ravel(), emits.ravel()])
    return total


def batches_of(frames: Iterator[pd.DataFrame], most: int = 400_000) -> Iterator[pd.DataFrame]:
    """Frames with up to about ``most`` tokens."""
    held, size = [], 0
    for frame in frames:
        held.append(frame)
        size += int(frame["n_tokens"].sum())
        if size > most:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def train(coded: DataFrame, symbols: int, frequency: np.ndarray, *, states: int, rounds: int, seed: int) -> Chain:
    """Baum-Welch: every round each task adds up expected counts over its texts; their sums have the model's size."""
    chain = Chain.initial(states, frequency, seed)

    def round_(chain: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = states + states * states + symbols * states

        def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(size)
            for frame in batches_of(frames):
                total += expected_counts(chain, [np.frombuffer(x, np.int16).astype(np.int64) for x in frame["symbols"]])
            yield pd.DataFrame({"v": [packed(total)]})

        total = added_up(coded.select("n_tokens", "symbols").mapInPandas(count, "v binary"), size)
        return total[:states], total[states : states + states**2].reshape(states, states), total[states + states**2 :].reshape(symbols, states)

    for _ in range(rounds):
        start, step, emit = round_(chain)
        if not start.sum():
            break
        prior = frequency[:, None] * 20  # keeps every symbol possible in every state
        emit = emit + prior
        step = step + 0.1
        chain = Chain((start + 0.1) / (start + 0.1).sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))
    return chain


def score(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """See scored()."""
    with tidy(spark):
        return scored(spark, docs, **options)


def scored(
    spark: SparkSession, docs: DataFrame, *, states: int = 6, frequent: int = 2000, rounds: int = 3, seed: int = 1, chunk_bytes: int = 6 << 20
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs`` (doc_id, text,
    held_out); what is learned, and the counts, come from all rows that are not held out. Intermediate files go as it proceeds.

    A token is a word in lower case (A-Z only), or the end of a text. base_score sums log10((c + 1) / (N + V + 1)); score
    is the model's log10 probability. Words are known by a 64-bit hash. Texts are dealt to chunks by hash, and a chunk
    asks once for the count of each of its words, so neither the vocabulary nor a frequent word's texts meet in a task.

    Null and empty texts are one token, the end. Very long texts go through the recursions in parts of PART tokens. Repeated
    rows count and are scored each; of equally frequent words the smaller hash gets a symbol of its own first. A table
    without training rows gives counts of 0. An empty table gives an empty result; other columns are left out.
    """
    small_batches(spark)
    work = Workspace(spark, "hmm")
    rows = docs.select(id_text(), "text", F.col("held_out"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))

    def vocabulary(group: pd.DataFrame) -> pd.DataFrame:
        seen, learned = Counter(), Counter()
        for text, held_out in zip(group["text"], group["held_out"], strict=True):
            (seen if held_out else learned).update(tokens(text))
        texts = int((~group["held_out"]).sum())
        words = [*learned, *(w for w in seen if w not in learned)]
        n = np.zeros(len(words) + 1, np.int64)
        n[: len(learned) + 1] = [texts, *learned.values()]
        return pd.DataFrame({"chunk": group["chunk"].iloc[0], "word": np.r_[END, word_ids(words)], "ending": np.r_[0, endings(words)], "n": n})

    asked = work.save(rows.groupBy("chunk").applyInPandas(vocabulary, "chunk int, word long, ending int, n long"), "asked")
    counts = work.save(asked.groupBy("word").agg(F.sum("n").alias("c"), F.first("ending").alias("ending")), "counts")
    n, v = counts.where("c > 0").agg(F.sum("c"), F.count("*")).first()
    n, v = n or 0, v or 0
    top = counts.where(f"word <> {END} and c > 0").orderBy(F.desc("c"), "word").limit(frequent).collect()
    symbol_of = {END: 0} | {r["word"]: i + 1 for i, r in enumerate(top)}
    shared = 1 + len(top)  # symbols of endings come after those of frequent words
    marks = spark.createDataFrame([(w, s) for w, s in symbol_of.items()], "word long, own int")
    by_ending = counts.join(F.broadcast(marks), "word", "left_anti")
    by_ending = by_ending.where("c > 0").groupBy("ending").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    weight, kinds = np.zeros(shared + ENDINGS), np.zeros(shared + ENDINGS)
    for r in top:
        weight[symbol_of[r["word"]]] = r["c"]
    weight[0] = n - weight.sum() - sum(r["c"] for r in by_ending)
    for r in by_ending:
        weight[shared + r["ending"]], kinds[shared + r["ending"]] = r["c"], r["v"]
    frequency = (weight + 0.5) / (weight + 0.5).sum()

    own_words, own_symbols = np.array(list(symbol_of), np.int64), np.array(list(symbol_of.values()), np.int64)
    answers = asked.select("chunk", "word").join(counts.select("word", "c"), "word")

    def code(key: tuple, texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        known: dict[bytes | None, int] = defaultdict()  # a word's place among the chunk's distinct tokens
        known.default_factory = known.__len__
        places = [np.fromiter(map(known.__getitem__, [None, *tokens(text)]), np.int64) for text in texts["text"]]
        places = [np.roll(x, -1) for x in places]  # the end comes last; its place is 0
        distinct = list(known)[1:]
        ids = np.r_[END, word_ids(distinct)]
        c = look_up(words["word"].to_numpy(), words["c"].to_numpy(), ids, 0)
        symbol = look_up(own_words, own_symbols, ids, -1)
        rest = symbol < 0
        symbol[rest] = shared + np.r_[0, endings(distinct)][rest]
        own = np.where(rest, np.log10((c + 1) / (weight[symbol] + kinds[symbol] + 1)), 0.0)
        base, symbol = np.log10((c + 1) / (n + v + 1)), symbol.astype(np.int16)
        out = [
            (doc_id, held_out, len(at), int((c[at] > 0).sum()), float(base[at].sum()), float(own[at].sum()), symbol[at].tobytes())
            for doc_id, held_out, at in zip(texts["doc_id"], texts["held_out"], places, strict=True)
        ]
        return pd.DataFrame(out, columns=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "own", "symbols"])

    schema = "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, own double, symbols binary"
    coded = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(code, schema)
    coded = work.save(coded, "coded")
    work.keep(coded)
    learned = coded.where("not held_out")
    chain = train(learned, len(weight), frequency, states=states, rounds=rounds, seed=seed) if n else Chain.initial(states, frequency, seed)
    model = spark.sparkContext.broadcast(chain)

    def likelihood(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches_of(frames):
            logs = log_likelihoods(model.value, [np.frombuffer(x, np.int16).astype(np.int64) for x in frame["symbols"]])
            out = frame.drop(columns=["symbols", "own"])
            yield out.assign(score=np.round(logs + frame["own"], 6), base_score=np.round(out["base_score"], 9), train_tokens=n)

    schema = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return as_long(coded.mapInPandas(likelihood, schema))


def op6_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(spark, docs.select("doc_id", "text", (id_bucket("doc_id", 7) == 2).alias("held_out")))
