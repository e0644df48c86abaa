"""Centroid clustering in whole numbers, the nearest centroid found by a tournament of bisectors.

Of two centroids the plane halfway between them says which is nearer: the sign of a linear form with a whole normal and
threshold. Centroids meet one after another; the loser of a test is out, so k - 1 tests leave the nearest, and
the distance is worked out for that one only. Everything is exact: no order of rows or tasks changes a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.session import materialize

# Squared distances of vectors within this bound fit a long: 64 * (2 * 2**27)**2 = 2**62.
LARGEST = 1 << 27
_ROWS_AT_ONCE = 4096


class Bisectors:
    """Normals and thresholds of all pairs of centroids, made once for a set of centroids."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        squares = (centroids * centroids).sum(axis=1)
        self.normal = 2 * (centroids[None, :, :] - centroids[:, None, :])  # [i, j]: from i to j
        self.threshold = squares[None, :] - squares[:, None]

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        """Number of the nearest centroid of each row; the smaller number where two are equally near."""
        best = np.zeros(len(vectors), dtype=np.int64)
        for j in range(1, len(self.centroids)):
            # Above the threshold j is nearer than the best so far; on it the best stays, whose number is smaller.
            side = np.einsum("ij,ij->i", vectors, self.normal[best, j]) - self.threshold[best, j]
            best[side > 0] = j
        return best

    def distance(self, vectors: np.ndarray, to: np.ndarray) -> np.ndarray:
        apart = vectors - self.centroids[to]
        return (apart * apart).sum(axis=1)


def whole_vectors(vectors: DataFrame, dimension: int, scale: int) -> DataFrame:
    """(vec_id, whole): the vectors with ``dimension`` finite components, each as floor(scale * x)."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce((v * 0) == 0, F.lit(False)) & (F.abs(v * scale) < LARGEST))
    kept = vectors.where((F.size(x) == dimension) & finite)
    return kept.select(F.col("vec_id").cast("long"), F.transform(x, lambda v: F.floor(v * scale).cast("int")).alias("whole"))


def first_centroids(kept: DataFrame, k: int, prefix: str) -> np.ndarray:
    """The k vectors with the smallest hash of their id; k rows reach the driver."""
    key = F.sha2(F.concat(F.lit(prefix), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    return np.array([r["whole"] for r in kept.orderBy(key, "vec_id", "whole").limit(k).collect()], dtype=np.int64)


def _batches(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS_AT_ONCE):
            part = batch.slice(at, _ROWS_AT_ONCE)
            yield part.column(0), part.column(1).flatten().to_numpy().astype(np.int64).reshape(-1, dimension)


def summed(kept: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """By cluster, how many vectors are nearest to it and their componentwise sum: k rows per task and on the driver."""
    k, dimension = centroids.shape
    bisectors = Bisectors(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, dtype=np.int64), np.zeros((k, dimension), dtype=np.int64)
        for _, vectors in _batches(batches, dimension):
            near = bisectors.nearest(vectors)
            counts += np.bincount(near, minlength=k)
            np.add.at(sums, near, vectors)
        some = np.flatnonzero(counts)
        rows = [pa.array(some), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(rows, names=["cluster", "n", "sums"])

    parts = kept.mapInArrow(run, "cluster long, n long, sums array<long>")
    places = parts.select("cluster", "n", F.posexplode("sums").alias("place", "part"))
    total = places.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("part").alias("sum"))
    out: dict[int, tuple[int, list[int]]] = {}
    for cluster, _, n, part in total.orderBy("cluster", "place").collect():
        out.setdefault(cluster, (n, []))[1].append(part)
    return out


def cluster(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dimension: int = 64, scale: int = 64, prefix: str = "1:"
) -> DataFrame:
    """(vec_id, cluster int, distance, cluster_inertia, inertia, centroid_sha256) per kept vector of (vec_id, embedding).

    Kept are vectors of exactly ``dimension`` components, none null, infinite or not a number; those with a component
    of 2**27 / ``scale`` or more are left out too, since a long does not hold their squared distance. Components become
    floor(scale * x). The first centroids are the k kept vectors with the smallest sha256 of prefix and vec_id (equal
    ids by components; fewer than k vectors give fewer centroids). Each round assigns every vector to the nearest
    centroid, the smaller number if two are equally near, and moves every centroid that has vectors to the floor of their mean; then
    all are assigned once more. Rows that share an id are vectors of their own, a null id counts as the text null. No kept vector, no
    row. Other columns are ignored. Nothing is shuffled but k sums a task; only centroids go to tasks.
    """
    kept = whole_vectors(vectors, dimension, scale)
    kept = materialize(kept, "whole-vectors")
    schema = "vec_id long, cluster int, distance long"
    spark = vectors.sparkSession
    centroids = first_centroids(kept, k, prefix)
    if not len(centroids):
        return spark.createDataFrame([], f"{schema}, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        for at, (n, sums) in summed(kept, centroids).items():
            centroids[at] = [s // n for s in sums]
    bisectors = Bisectors(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in _batches(batches, dimension):
            near = bisectors.nearest(rows)
            columns = [ids, pa.array(near.astype(np.int32)), pa.array(bisectors.distance(rows, near))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    assigned = materialize(kept.mapInArrow(run, schema), "assigned")
    far = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("long")).collect()
    total = sum(d for _, d in far)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    known = spark.createDataFrame(
        [(c, d, total, digest[c]) for c, d in far], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", *known.columns[1:])
