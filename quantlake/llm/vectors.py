"""Near-duplicate embeddings by an inverted multi-index over two codebooks, with an exact check of the cosine."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantlake.llm.common import Workspace, components, small_batches

#: Vectors that a codebook is fitted on: at least SAMPLE, and PER_CENTRE for each centre.
SAMPLE, PER_CENTRE = 8192, 32
#: Vectors in a cell of the product grid, on average, and the most centres of a codebook: finer grids cost more visits
#: than they save comparisons.
PER_CELL, MOST_CENTRES = 128, 2048
#: Draws from which the bound of a traversal is set, and the margin on it.
DRAWS, MARGIN = 32_768, 1.5


def k_means(points: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        nearest = (((centres**2).sum(1) - 2 * points @ centres.T)).argmin(1)
        for c in range(len(centres)):
            if (nearest == c).any():
                centres[c] = points[nearest == c].mean(0)
    return np.unique(centres, axis=0)


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


@dataclass
class Book:
    """The centres of one half of the vectors, and the distances between them."""

    centres: np.ndarray
    apart: np.ndarray

    @staticmethod
    def of(centres: np.ndarray) -> Book:
        squares = (centres**2).sum(1)
        return Book(centres, np.sqrt(np.maximum(squares[:, None] + squares - 2 * centres @ centres.T, 1e-30)))

    def bounds(self, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centre of each row, and for each centre the square of a lower bound of the distance from the row to
        any point whose nearest centre that is: the distance to the plane half way to the row's own centre."""
        d = (half**2).sum(1)[:, None] + (self.centres**2).sum(1) - 2 * half @ self.centres.T
        own = d.argmin(1)
        return own, (np.maximum(d - d.min(1, keepdims=True), 0) / (2 * self.apart[own])) ** 2


def codebooks(vectors: list[np.ndarray], centres: int, least: float, recall: float, seed: int = 3) -> dict[int, tuple[Book, Book, float]]:
    """dimension -> the codebooks of the first and the second half of its unit vectors, and the bound of a traversal."""
    out = {}
    for dim in {len(v) for v in vectors}:
        x = unit(np.array([v for v in vectors if len(v) == dim], float))
        books = Book.of(k_means(x[:, : dim // 2], centres, seed)), Book.of(k_means(x[:, dim // 2 :], centres, seed + 1))
        out[dim] = (*books, reach(x, books, least, recall, seed))
    return out


def reach(x: np.ndarray, books: tuple[Book, Book], least: float, recall: float, seed: int) -> float:
    """The bound up to which cells are visited: with a recall of 1 the squared radius of the cosine ``least``, beyond which no
    partner can lie. Else the share ``recall`` of partners at just that cosine, drawn in random directions around the
    vectors ``x``, lies in cells within it; closer partners are found more often."""
    radius = max(0.0, 2 - 2 * least) * (1 + 1e-9) + 1e-9
    if recall >= 1:
        return radius
    rng, half = np.random.default_rng(seed), x.shape[1] // 2
    sums = []
    for _ in range(-(-DRAWS // len(x))):
        away = rng.normal(size=x.shape)
        away -= (away * x).sum(1, keepdims=True) * x
        away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-30)
        partner = least * x + np.sqrt(1 - least**2) * away
        places = [book.bounds(part)[0] for book, part in zip(books, (partner[:, :half], partner[:, half:]), strict=True)]
        bounds = [book.bounds(part)[1] for book, part in zip(books, (x[:, :half], x[:, half:]), strict=True)]
        sums.append(sum(np.take_along_axis(low, at[:, None], 1)[:, 0] for low, at in zip(bounds, places, strict=True)))
    return min(radius, MARGIN * float(np.quantile(np.concatenate(sums), recall)) + 1e-9)


def traversal(first: np.ndarray, second: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multi-sequence traversal: the cells (row, i, j) of each row in ascending order of first[row, i] + second[row, j],
    up to ``most``. Of each first-half centre in order, so many second-half centres in order are reached."""
    order_i, order_j = first.argsort(1), second.argsort(1)
    sorted_i, sorted_j = np.take_along_axis(first, order_i, 1), np.take_along_axis(second, order_j, 1)
    reach = np.zeros(first.shape, np.int64)
    for row in range(len(first)):
        n = np.searchsorted(sorted_i[row], most, "right")
        reach[row, :n] = np.searchsorted(sorted_j[row], most - sorted_i[row, :n], "right")
    row, a = np.nonzero(reach)
    times = reach[row, a]
    b = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    row, a = np.repeat(row, times), np.repeat(a, times)
    turn = np.lexsort((sorted_i[row, a] + sorted_j[row, b], row))
    row, a, b = row[turn], a[turn], b[turn]
    return row, order_i[row, a], order_j[row, b]


def visits(vectors: np.ndarray, books: tuple[Book, Book, float]) -> tuple[np.ndarray, ...]:
    """Own cell (i, j) of each unit vector, and the cells to visit as (row, i, j), nearest first, until the target recall is
    reached. Of two vectors the one whose cell is first in order visits the other."""
    half = vectors.shape[1] // 2
    own_i, low_i = books[0].bounds(vectors[:, :half])
    own_j, low_j = books[1].bounds(vectors[:, half:])
    row, i, j = traversal(low_i, low_j, books[2])
    later = (i > own_i[row]) | ((i == own_i[row]) & (j >= own_j[row]))
    return own_i, own_j, row[later], i[later], j[later]


def linked_blocks(group: pd.DataFrame, least: float) -> pd.DataFrame:
    """Compare those who visit a cell with its members: links of each, weighted, and edges that keep the linked parts
    connected. Members visit their own cell too, and are counted as visitors there."""
    q, m = group[group["visit"] > 0], group[group["visit"] == 0]
    if not len(q) or not len(m):
        return pd.DataFrame({"k1": [], "k2": [], "n": [], "a": [], "b": []})
    x, y = (np.array(f["v"].tolist(), float) for f in (q, m))
    x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
    cosine = (x @ y.T) / np.sqrt((x * x).sum(1)[:, None] * (y * y).sum(1))
    near = cosine >= least
    near &= (q["k1"].to_numpy()[:, None] != m["k1"].to_numpy()) | (q["k2"].to_numpy()[:, None] != m["k2"].to_numpy())
    rows, columns = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
    near = near[np.ix_(rows, columns)]
    q, m = q.iloc[rows], m.iloc[columns]
    a, b = q["node"].to_numpy(), m["node"].to_numpy()
    low_a, low_b = a.copy(), b.copy()
    most = np.iinfo(np.int64).max
    while len(a):
        new_a = np.minimum(low_a, np.where(near, low_b[None], most).min(1))
        new_b = np.minimum(low_b, np.where(near, new_a[:, None], most).min(0))
        if (new_a == low_a).all() and (new_b == low_b).all():
            break
        low_a, low_b = new_a, new_b
    out = pd.DataFrame({"k1": q["k1"].to_numpy(), "k2": q["k2"].to_numpy(), "n": near @ m["weight"].to_numpy(), "a": a, "b": low_a})
    away = (q["visit"] == 2).to_numpy() * q["weight"].to_numpy()
    back = pd.DataFrame({"k1": m["k1"].to_numpy(), "k2": m["k2"].to_numpy(), "n": away @ near, "a": b, "b": low_b})
    return pd.concat([out, back[(back["n"] > 0) | (b != low_b)]])


def near_duplicates(spark: SparkSession, vectors: DataFrame, *, least: float = 0.98, recall: float = 0.9999, block: int = 512) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding, label).

    Rows with the same label and vector are one class, so copies are not compared with each other. The codebooks, whose size
    grows with the root of the rows, are fitted on a bounded number of classes, chosen by hash; every class is indexed under
    its cell of the product grid and visits cells, nearest first, until the target ``recall`` of partners at the cosine ``least``
    is reached (see reach(); a recall of 1 is exact). Only the
    members and the visitors of a cell are compared; they meet in blocks of at most about ``block`` rows each, which return
    counts and as many edges as rows, however many pairs are linked.

    Vectors that are null, empty or zero or hold null or non-finite components, and rows without label or vec_id, link
    with nothing; without vec_id component_id is null and kept true. Vectors of different lengths are not compared. Rows
    that repeat a vec_id count as vectors of their own, with one component_id. A tie between two cells goes to the centre
    first in order, which changes no result. An empty table gives an empty result; other columns are left out.
    """
    small_batches(spark)
    work = Workspace(spark, "vectors")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists("embedding", lambda x: x != 0)
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad & ~zero
    key = [F.when(F.coalesce(usable, F.lit(False)), F.xxhash64(F.lit(i), F.col("label"), F.col("embedding"))).alias(f"k{i}") for i in (1, 2)]
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").alias("v"), *key)
    classes = rows.where("k1 is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = work.save(classes, "classes")
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    centres = min(MOST_CENTRES, max(2, math.ceil(math.sqrt(10 * most / PER_CELL))))
    sample = classes.orderBy("k1", "k2").select("v").limit(max(SAMPLE, PER_CENTRE * centres))
    shared = spark.sparkContext.broadcast(codebooks([np.array(r["v"], float) for r in sample.toLocalIterator()], centres, least, recall))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            dims = batch["v"].map(len)
            for dim in dims.unique():
                part = batch[dims == dim].reset_index(drop=True)
                one = (Book.of(np.zeros((1, dim // 2))), Book.of(np.zeros((1, dim - dim // 2))), 1.0)
                for at in range(0, len(part), 256):
                    some = part.iloc[at : at + 256].reset_index(drop=True)
                    i, j, row, to_i, to_j = visits(unit(np.array(some["v"].tolist(), float)), shared.value.get(dim, one))
                    some = some[["k1", "k2", "label"]]
                    yield some.assign(dim=dim, i=i, j=j, visit=0)
                    own = (to_i == i[row]) & (to_j == j[row])
                    yield some.iloc[row].assign(dim=dim, i=to_i, j=to_j, visit=np.where(own, 1, 2))

    schema = f"k1 long, k2 long, label {dict(classes.dtypes)['label']}, dim int, i int, j int, visit int"
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    indexed = classes.select("k1", "k2", "label", "v").repartition(tasks).mapInPandas(index, schema)
    cell = ["label", "dim", "i", "j"]
    # Which cells are worth a visit is found without the vectors, which then go where somebody is at home.
    places = work.save(indexed, "places")
    sizes = places.groupBy(*cell).agg(F.count_if(F.col("visit") == 0).alias("members"), F.count_if(F.col("visit") != 0).alias("asks"))
    parts = lambda n: F.ceil(F.col(n) / block)
    sizes = work.save(sizes.where("members > 0 and asks > 0 and members + asks > 2").select(*cell, parts("members").alias("mb"), parts("asks").alias("qb")), "sizes")
    spread = F.pmod(F.xxhash64("k1", "k2", F.lit(7)), F.when(F.col("visit") == 0, F.col("mb")).otherwise(F.col("qb")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("visit") == 0, F.col("qb")).otherwise(F.col("mb")) - 1))
    dealt = places.join(sizes, cell).withColumn("own", spread).withColumn("other", other)
    dealt = dealt.withColumn("x", F.when(F.col("visit") == 0, F.col("own")).otherwise(F.col("other"))).withColumn("y", F.when(F.col("visit") == 0, F.col("other")).otherwise(F.col("own")))
    dealt = dealt.select(*cell, "x", "y", "k1", "k2", "visit").join(classes.select("k1", "k2", "node", "weight", "v"), ["k1", "k2"])
    found = dealt.groupBy(*cell, "x", "y").applyInPandas(lambda g: linked_blocks(g, least), "k1 long, k2 long, n long, a long, b long")
    found = work.save(found, "links")

    counts = found.where("n > 0").groupBy("k1", "k2").agg(F.sum("n").alias("n"))
    same = rows.join(classes.select("k1", "k2", "node"), ["k1", "k2"]).where("vec_id <> node")
    ids = same.join(classes.select(F.col("node").alias("vec_id")).distinct(), "vec_id").select(F.col("vec_id").alias("a"), F.col("node").alias("b"))
    joined = components(spark, work, found.where("a <> b").select("a", "b").union(ids))
    named = classes.join(counts, ["k1", "k2"], "left").join(joined, "node", "left")
    named = named.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("c"))
    out = rows.select("vec_id", "k1", "k2").join(named, ["k1", "k2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP2_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
n AS (SELECT vec_id, count(*) AS n FROM (SELECT a AS vec_id FROM e UNION ALL SELECT b FROM e) GROUP BY vec_id),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, CASE WHEN r.b = e.a THEN e.b ELSE e.a END FROM r JOIN e ON r.b = e.a OR r.b = e.b),
m AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN n USING (vec_id)
"""
