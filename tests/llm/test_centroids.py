"""Delta Lloyd against plain Lloyd in Python integers."""

import hashlib
import math

import numpy as np
import pytest

from quantlake.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string"


def plain(rows, k=16, rounds=3, dim=64, scale=64):
    """rows (vec_id, embedding) -> sorted (vec_id, cluster, distance, cluster_inertia, inertia, sha256)."""
    kept = []
    for vec_id, e in rows:
        if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e):
            kept.append((vec_id, [max(-centroids.LARGEST, min(centroids.LARGEST, math.floor(scale * float(np.float32(x))))) for x in e]))
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], np.int32).tobytes())
    cs = [list(v) for _, v in sorted(kept, key=key)[:k]]
    for turn in range(rounds + 1):
        own = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(cs)) for _, v in kept]
        if turn < rounds:
            for i in range(len(cs)):
                if mine := [v for (_, v), (_, o) in zip(kept, own, strict=True) if o == i]:
                    cs[i] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    total = sum(d for d, _ in own)
    inertia = [sum(d for d, o in own if o == i) for i in range(len(cs))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted(((v, o, d, inertia[o], total, sha[o]) for (v, _), (d, o) in zip(kept, own, strict=True)), key=str)


def found(spark, rows, **how):
    df = spark.createDataFrame([(v, None if e is None else [None if x is None else float(x) for x in e], 1, "x") for v, e in rows], SCHEMA)
    out = centroids.cluster(spark, df.repartition(3), **how)
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, hashlib.sha256(r.centroid.encode()).hexdigest()) for r in out.collect()), key=str)


def test_centroids_with_nulls_ties_and_repeats(spark):
    rng = np.random.default_rng(5)
    base = np.round(rng.normal(size=(60, 64)), 2)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, base[0].tolist()) for i in range(40)]  # copies: ties between equal centroids too
    rows += [(None, base[1].tolist()), (None, base[2].tolist()), (7, base[3].tolist()), (2**63 - 1, base[4].tolist()), (-(2**63), base[5].tolist())]
    rows += [(200, None), (201, []), (202, [0.5] * 63), (203, [None] + [0.1] * 63), (204, [math.nan] * 64), (205, [math.inf] + [0.0] * 63)]
    rows += [(206, [0.0] * 64), (207, [-0.001] * 64)]
    assert found(spark, rows) == plain(rows)


def test_centroids_of_large_components(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=64) * 10.0 ** (i % 9)).tolist()) for i in range(40)] + [(99, [3e38] * 64)]
    assert found(spark, rows, k=5) == plain(rows, k=5)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.25] * 64)]])
def test_centroids_of_few_vectors(spark, rows):
    assert found(spark, rows) == plain(rows)


def test_delta_rounds_equal_whole_rounds():
    rng = np.random.default_rng(7)
    x, cs = rng.integers(-60, 60, (500, 64)).astype(np.int32), rng.integers(-60, 60, (9, 64))
    own, d = centroids.reassign(x, np.full(500, -1), np.zeros(500, np.int64), cs, np.arange(9))
    moved = np.array([2, 5])
    new = cs.copy()
    new[moved] += rng.integers(-30, 30, (2, 64))
    delta, whole = centroids.reassign(x, own, d, new, moved), centroids.squared(x, new)
    assert (delta[0] == whole.argmin(1)).all() and (delta[1] == whole.min(1)).all()
