"""Centroid clustering with annulus search: exact assignment that compares few centroids, in whole numbers.

Centroids are sorted by norm. For each vector the distance to the centroid of the nearest norm is an upper bound u
of the smallest distance; by the triangle inequality a centroid at most that far away has a norm within u of the
vector's. The annulus of these norms is found by binary search, and what lies in it, both edges
included, is compared exactly. Rounds send the centroids (k rows) to all tasks and bring back sums of k
clusters, added up in the tasks first; vectors are never shuffled but for the starting ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retroscope.llm._common import release, store

#: Components are counted in units of 1 / UNIT.
UNIT = 64
#: Largest magnitude of a component: in 64 of them, squared differences up to (2 LARGEST UNIT)^2 add up within a long.
LARGEST = 1 << 21
#: Rows that are turned into a matrix at once.
ROWS = 20_000


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (of several, the smallest) and squared distance for each row of x; all int64."""
    best, at = np.full(x.shape[0], np.iinfo(np.int64).max), np.zeros(x.shape[0], np.int32)

    def compare(rows: np.ndarray, k: int) -> None:
        d = ((x[rows] - centroids[k]) ** 2).sum(axis=1)
        better = (d < best[rows]) | (d == best[rows]) & (k < at[rows])
        best[rows[better]], at[rows[better]] = d[better], k

    norms = np.sqrt((centroids.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(norms, kind="stable")
    norms, own = norms[order], np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    right = np.searchsorted(norms, own).clip(0, norms.size - 1)
    left = (right - 1).clip(0)
    guess = np.where(np.abs(norms[left] - own) <= np.abs(norms[right] - own), left, right)
    for j in np.unique(guess):
        compare(np.flatnonzero(guess == j), int(order[j]))
    # widened by more than the rounding of norms, so that ties on the edge stay inside
    bound = np.sqrt(best.astype(np.float64)) + 1e-9 * (1 + own)
    low, high = np.searchsorted(norms, own - bound), np.searchsorted(norms, own + bound, side="right")
    for j, k in enumerate(order):
        rows = np.flatnonzero((low <= j) & (j < high) & (guess != j))
        if rows.size:
            compare(rows, int(k))
    return at, best


def _matrices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            yield part.column("vec_id"), pc.list_flatten(part.column("x")).to_numpy().reshape(-1, size)


def _sums(centroids: np.ndarray) -> Callable:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, size = centroids.shape
        counts, totals = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for _, x in _matrices(batches, size):
            at, _ = nearest(x, centroids)
            counts += np.bincount(at, minlength=k)
            np.add.at(totals, at, x)
        some = np.flatnonzero(counts)
        if some.size:
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array(totals[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    return of


def _assign(centroids: np.ndarray) -> Callable:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _matrices(batches, centroids.shape[1]):
            at, d = nearest(x, centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(at), pa.array(d)], names=["vec_id", "cluster", "distance"])

    return of


def kept_vectors(vectors: DataFrame, size: int = UNIT) -> DataFrame:
    """(vec_id, x): vectors of exactly size components, all finite and below LARGEST in magnitude, as floor(UNIT * component)."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    return vectors.where((F.size("embedding") == size) & fine).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(v, lambda c: F.floor(c * UNIT)).alias("x"))


def starts(x: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose `seed:vec_id` has the smallest SHA-256, in that order; of equal ids, by components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = x.where("vec_id is not null").select(key.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, size: int = 64) -> DataFrame:
    """Lloyd's rounds over vectors (vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    One row per kept vector (`kept_vectors`): others, among them null ones and those with a null, NaN or infinite
    component, have no row. distance is squared, in units of 1 / UNIT squared; a centroid's components are floors
    of means. A row with a null vec_id is assigned and counts in means, but starts no cluster; rows that
    repeat a vec_id count each. With fewer than k vectors there are fewer clusters; without any vector that has an
    id the result is empty. Sums of components and of distances are added up as decimals; an inertia that fits in no
    long is null. Other columns are ignored.
    """
    spark = vectors.sparkSession
    x = store(kept_vectors(vectors, size), "vectors")
    centroids = starts(x, k, seed)
    if not centroids.size:
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    for _ in range(rounds):
        parts = x.mapInArrow(_sums(centroids), "cluster int, n bigint, total array<bigint>")
        sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[i].cast("decimal(38,0)")) for i in range(size))).alias("total"))
        for r in sums.collect():  # k rows
            centroids[r.cluster] = [int(t) // r.n for t in r.total]
    rows = store(x.mapInArrow(_assign(centroids), "vec_id bigint, cluster int, distance bigint"), "assigned")
    release(x)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    per = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda v: v if v < 1 << 63 else None
    table = spark.createDataFrame([(c, fits(s), fits(sum(per.values())), digests[c]) for c, s in per.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
