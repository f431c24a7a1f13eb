"""Lloyd's clustering of integer vectors by deltas: assignments and global sums persist from round to round.

A vector keeps its cluster and its distance. After an update only some centroids have moved, so a vector whose own centroid
stayed is compared with the moved ones alone; one whose own centroid moved is compared with all. Vectors that change hands
send signed transfers (minus from the old cluster, plus to the new one), which are added up as integers to the global sums;
nothing else is summed again. All arithmetic is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantlake.llm.common import Workspace, small_batches

DIM, K, ROUNDS, SCALE = 64, 16, 3, 64
#: Components beyond +-LARGEST are set to it: squared distances then fit a long. It is 2 million times the scale.
LARGEST = (1 << 27) - 1
#: Products of components up to this size add up exactly in double precision.
EXACT = 1 << 22
#: Ids are never null here (named tells), so that pandas keeps them as integers.
STATE = "vec_id long, named boolean, v binary, cluster int, was int, distance long"


def integers(values: pd.Series, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are kept (``dim`` components, none null or non-finite), and floor(scale * x) of those."""
    right = np.array([v is not None and len(v) == dim for v in values], bool)
    x = np.array(values[right].tolist(), float).reshape(-1, dim)  # null components become NaN
    finite = np.isfinite(x).all(1)
    right[right] = finite
    with np.errstate(over="ignore"):
        return right, np.clip(np.floor(x[finite] * scale), -LARGEST, LARGEST).astype(np.int32)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (vector, centroid)."""
    kind = float if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT else np.int64
    a, c = x.astype(kind), centroids.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)


def reassign(x: np.ndarray, cluster: np.ndarray, distance: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and distance of each vector after the centroids ``moved`` (numbers) have changed; -1 is no cluster yet."""
    cluster, distance = cluster.copy(), distance.copy()
    whole = (cluster < 0) | np.isin(cluster, moved)
    if whole.any():
        d = squared(x[whole], centroids)
        cluster[whole], distance[whole] = d.argmin(1), d.min(1)
    if not whole.all() and len(moved):
        d = squared(x[~whole], centroids[moved])  # moved is ascending, so of equals the smallest number is found
        to, at = moved[d.argmin(1)], d.min(1)
        better = (at < distance[~whole]) | ((at == distance[~whole]) & (to < cluster[~whole]))
        cluster[~whole] = np.where(better, to, cluster[~whole])
        distance[~whole] = np.where(better, at, distance[~whole])
    return cluster, distance


def vectors_of(batch: pd.DataFrame, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch["v"]), np.int32).reshape(-1, dim)


def seeds(rows: DataFrame, k: int, dim: int) -> np.ndarray:
    """The k vectors whose ids have the smallest SHA-256; a null id counts as empty text, ties go by the vector's bytes."""
    key = F.sha2(F.concat(F.lit("1:"), F.when(F.col("named"), F.col("vec_id").cast("string")).otherwise("")), 256)
    first = rows.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return np.frombuffer(b"".join(r["v"] for r in first), np.int32).reshape(-1, dim).astype(np.int64)


def transfers(state: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """What the vectors that changed hands since the last round add to the sums and the counts of the k clusters."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, dim + 1), np.int64)
        for batch in batches:
            x = np.c_[vectors_of(batch, dim), np.ones(len(batch))].astype(np.int64)
            np.add.at(total, batch["cluster"].to_numpy(), x)
            left = batch["was"].to_numpy()
            np.subtract.at(total, left[left >= 0], x[left >= 0])
        c, i = np.nonzero(total)
        yield pd.DataFrame({"c": c.astype(np.int32), "i": i.astype(np.int32), "n": total[c, i]})

    changed = state.where("cluster <> was").mapInPandas(add, "c int, i int, n long")
    out = np.zeros((k, dim + 1), np.int64)
    for c, i, n in changed.groupBy("c", "i").agg(F.sum("n")).collect():  # at most k * (dim + 1) numbers
        out[c, i] = n
    return out[:, :dim], out[:, dim]


def cluster(spark: SparkSession, vectors: DataFrame, *, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster and distance of every vector, with inertia of the cluster and of all, and the cluster's centroid.

    ``vectors`` has vec_id and embedding. Vectors that are null, have another number of components, or null or non-finite ones
    are left out. Rows that share or lack a vec_id are vectors of their own; equal ones get the same cluster. With fewer than k
    vectors there are as many centroids; an empty table gives an empty result. Other columns are left out. Components beyond
    +-LARGEST after scaling count as that. Sums hold up to 6 * 10^10 vectors of the largest components, more of usual ones;
    inertia beyond a long is set to the largest long.
    """
    small_batches(spark)
    work = Workspace(spark, "centroids")

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            right, x = integers(batch["embedding"], dim, scale)
            yield batch.loc[right, ["vec_id", "named"]].assign(v=[r.tobytes() for r in x], cluster=-1, was=-1, distance=0)

    vec_id = F.col("vec_id").cast("long")
    rows = vectors.select(F.coalesce(vec_id, F.lit(0)).alias("vec_id"), vec_id.isNotNull().alias("named"), "embedding")
    state = work.save(rows.mapInPandas(keep, STATE), "vectors")
    centroids = seeds(state, k, dim)
    k = len(centroids)
    sums, counts, moved = np.zeros((k, dim), np.int64), np.zeros(k, np.int64), np.arange(k)
    for turn in range(rounds + 1 if k else 0):

        def assign(batches: Iterator[pd.DataFrame], centroids: np.ndarray = centroids, moved: np.ndarray = moved) -> Iterator[pd.DataFrame]:
            for batch in batches:
                was = batch["cluster"].to_numpy()
                own, distance = reassign(vectors_of(batch, dim), was, batch["distance"].to_numpy(), centroids, moved)
                yield batch.assign(cluster=own.astype(np.int32), was=was, distance=distance)

        state = work.save(state.mapInPandas(assign, STATE), f"round{turn}")
        work.keep(state)
        if turn == rounds:
            break
        more, members = transfers(state, k, dim)
        sums, counts = sums + more, counts + members
        new = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)  # // is the exact floor
        moved = np.flatnonzero((new != centroids).any(1))
        centroids = new
        if not len(moved):
            break
    inertia = {r["cluster"]: int(r["n"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}
    most = np.iinfo(np.int64).max
    facts = [(c, min(inertia.get(c, 0), most), min(sum(inertia.values()), most), ",".join(map(str, centroids[c].tolist()))) for c in range(k)]
    told = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid string")  # one row a centroid
    found = state.select(F.when(F.col("named"), F.col("vec_id")).alias("vec_id"), "cluster", "distance")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("centroid_sha256", F.sha2("centroid", 256)).drop("centroid")


def _rounds() -> str:
    """The SQL of each round: a vector by component, its nearest centroid, and the floors of the means."""
    text = []
    for r in range(ROUNDS + 1):
        text.append(f"""a{r} AS (
    SELECT vec_id, c AS cluster, d FROM (
        SELECT v.vec_id, k.c, sum((v.x - k.x) * (v.x - k.x)) AS d FROM v JOIN k{r} k USING (i) GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)""")
        if r < ROUNDS:
            text.append(f"""m{r} AS (
    SELECT cluster AS c, i, sum(x) AS s, count(*) AS n FROM a{r} JOIN v USING (vec_id) GROUP BY ALL),
k{r + 1} AS (
    SELECT k.c, k.i, CASE WHEN n IS NULL THEN x WHEN s % n < 0 THEN s // n - 1 ELSE s // n END AS x FROM k{r} k LEFT JOIN m{r} USING (c, i))""")
    return ",\n".join(text)


OP13_SQL = f"""
WITH w AS (
    SELECT vec_id, embedding AS e FROM embeddings
    WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}),
v AS (SELECT vec_id, i, CAST(floor({SCALE} * CAST(e[i] AS DOUBLE)) AS HUGEINT) AS x FROM w, unnest(range(1, {DIM + 1})) AS u(i)),
s AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM w QUALIFY c < {K}),
k0 AS (SELECT c, i, x FROM s JOIN v USING (vec_id)),
{_rounds()},
h AS (SELECT c AS cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM k{ROUNDS} GROUP BY c)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN h USING (cluster)
"""
