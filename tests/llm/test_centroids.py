"""Clustering against comparing everything with everything, ties, and awkward vectors."""

import hashlib
import random

import numpy as np
import pytest

from retroscope.llm.centroids import LARGEST, cluster, nearest

SCHEMA = "vec_id bigint, embedding array<double>, cluster int, x int"


def brute(rows, k, rounds, size):
    kept = [(i, [int(np.floor(64 * c)) for c in v]) for i, v in rows if v is not None and len(v) == size and all(c is not None and np.isfinite(c) and abs(c) < LARGEST for c in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    centroids = [x for _, x in first[:k]]

    def assign():
        out = []
        for i, x in kept:
            d = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in centroids]
            out.append((i, x, d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        now = assign()
        for c in range(len(centroids)):
            own = [x for _, x, at, _ in now if at == c]
            if own:
                centroids[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    now = assign()
    inertia = [sum(d for *_, at, d in now if at == c) for c in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, at, d, inertia[at], sum(inertia), sha[at]) for i, _, at, d in now), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed, scale", [(1, 1.0), (2, 0.05), (3, 30.0)])
def test_equals_brute_force(spark, seed, scale):
    """Small scales leave few different vectors, so ties and empty clusters abound."""
    rng = np.random.default_rng(seed)
    rows = [(int(i), (rng.normal(size=8) * scale).tolist()) for i in range(300)] + [(7, [0.0] * 8), (7, [0.0] * 8)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(5)
    assert got(cluster(df, 9, 3, size=8)) == brute(rows, 9, 3, 8)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, []), (4, [1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [5.0, 5.0]), (8, [-1.0, -0.001]), (9, [float(LARGEST), 0.0]), (10, [LARGEST - 1.0, 1.0 - LARGEST])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    assert got(cluster(df, 16, 3, size=2)) == brute(rows, 16, 3, 2)
    assert cluster(df.limit(0), size=2).count() == 0
    assert cluster(df.where("vec_id is null"), size=2).count() == 0


def test_nearest_compares_what_lies_on_the_edge():
    """Points midway between centroids, at the edge of the annulus, go to the smaller number."""
    rng = random.Random(4)
    for _ in range(50):
        centroids = np.array([[rng.randint(-3, 3) for _ in range(3)] for _ in range(12)], np.int64)
        x = np.array([[rng.randint(-4, 4) for _ in range(3)] for _ in range(60)], np.int64)
        d = ((x[:, None] - centroids) ** 2).sum(axis=2)
        at, best = nearest(x, centroids)
        assert (at == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
