"""Centroid clustering: plain Lloyd rounds over vectors of integers.

Components become ``floor(scale * x)``, so that every distance, sum and mean is an exact
integer and results do not depend on the order of rows or on partitions.  The vectors
are written once to the shared folder.  In each round the centroids are broadcast (k
times the components, whatever the number of vectors), ``mapInPandas`` takes the integer
squared differences to each centroid in numpy and the lowest index among the nearest,
and each partition hands on one sum a centroid; these merge through ``groupBy``, and k
rows come to the driver.

Defined results: a vector with another number of components than asked for, or with a null,
NaN or infinite one, is left out, as is a null vector; a null id counts as the empty text
where the first centroids are drawn; repeated rows each count, and ties of the draw go to
the lesser vector; with fewer than k vectors there are as many centroids as vectors; an
empty table gives an empty result; other columns are not carried.  Components may lie
anywhere in 64 bits: where a distance could leave them, Python's integers are used, and a
component, distance, sum or inertia that a long cannot hold is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, cut

#: Sums of a block of components below this stay within 64 bits.
_SMALL = 1 << 48
#: Vectors of which distances are taken at a time.
_ROWS = 4_096


def squared_distances(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows from one centroid."""
    difference = vectors - centroid
    return np.einsum("ij,ij->i", difference, difference) if difference.dtype != object else (difference * difference).sum(axis=1)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row; the lowest number among equally near ones."""
    size = vectors.shape[1] * max(1, int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0))) ** 2
    if size >= 1 << 60:  # four times that could leave 64 bits
        vectors, centroids = vectors.astype(object), centroids.astype(object)
    best, distance = np.zeros(len(vectors), dtype=np.int32), squared_distances(vectors, centroids[0])
    for k in range(1, len(centroids)):
        other = squared_distances(vectors, centroids[k])
        nearer = other < distance
        best[nearer] = k
        distance = np.where(nearer, other, distance)
    if distance.dtype == object and any(d >= 1 << 63 for d in distance):
        raise OverflowError("a squared distance does not fit in 64 bits")
    return best, distance.astype(np.int64)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64) if len(column) else np.zeros((0, 0), dtype=np.int64)


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for batch in batches:
        for low in range(0, len(batch), _ROWS):
            part = batch.iloc[low : low + _ROWS]
            yield part, _matrix(part["x"])


def _summing(centroids) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """One row for each component of each centroid that the partition has vectors of; component -1 counts them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k, size = centroids.value.shape
        sums, counts = np.zeros((k, size), dtype=object), np.zeros(k, dtype=np.int64)
        for _, x in _blocks(batches):
            cluster, _ = nearest(x, centroids.value)
            counts += np.bincount(cluster, minlength=k)
            wide = np.abs(x).max(initial=0) >= _SMALL
            for c in np.unique(cluster):
                sums[c] += (x[cluster == c].astype(object) if wide else x[cluster == c]).sum(axis=0).astype(object)
        at = np.flatnonzero(counts)
        whole = np.column_stack([counts[at].astype(object), sums[at]]) if len(at) else np.zeros((0, size + 1), dtype=object)
        yield pd.DataFrame({
            "cluster": np.repeat(at, size + 1).astype(np.int32), "component": np.tile(np.arange(-1, size, dtype=np.int32), len(at)), "total": whole.ravel().astype(np.int64),
        })

    return run


def _assigning(centroids) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, x in _blocks(batches):
            cluster, distance = nearest(x, centroids.value)
            yield pd.DataFrame({"vec_id": part["vec_id"], "cluster": cluster, "distance": distance})

    return run


def integer_vectors(vectors: DataFrame, size: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the vectors that have ``size`` finite components, as integers."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # only vectors that pass are turned into integers
    kept = F.when((F.size(x) == size) & finite, F.transform(x, lambda c: F.floor(c * scale).cast("long")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), kept.alias("x")).where("x is not null")


def first_centroids(table: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest digests of ``seed:id``, in the order of the digests."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = table.select(digest.alias("digest"), "x").orderBy("digest", "x").limit(k).collect()
    return np.array([r.x for r in rows], dtype=np.int64)


@dataclass(frozen=True)
class Clustering:
    """Centroids (one row each), and the vectors with their cluster and squared distance, written to the shared folder."""

    centroids: np.ndarray
    assigned: DataFrame


def lloyd(vectors: DataFrame, k: int, rounds: int, size: int, scale: int, seed: str, id_col: str = "vec_id", vector_col: str = "embedding") -> Clustering:
    """``rounds`` times: every vector to its nearest centroid, every centroid to the floor of its vectors' mean."""
    spark = vectors.sparkSession
    bound_batches(spark)
    table = cut(integer_vectors(vectors, size, scale, id_col, vector_col), "vectors")
    centroids = first_centroids(table, k, seed)
    empty = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return Clustering(centroids, spark.createDataFrame([], empty))
    for _ in range(rounds):
        centroids = _moved(spark, table, centroids)
    shared = spark.sparkContext.broadcast(centroids)
    return Clustering(centroids, cut(table.mapInPandas(_assigning(shared), empty), "assigned"))


def _moved(spark: SparkSession, table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the means; a centroid without vectors stays."""
    shared = spark.sparkContext.broadcast(centroids)
    sums = table.mapInPandas(_summing(shared), "cluster int, component int, total long")
    merged = sums.groupBy("cluster", "component").agg(F.sum("total").alias("total")).collect()
    shared.destroy()
    counts = {r.cluster: r.total for r in merged if r.component < 0}
    out = centroids.copy()
    for r in merged:
        if r.component >= 0:
            out[r.cluster, r.component] = r.total // counts[r.cluster]
    return out


def with_inertia(found: Clustering) -> DataFrame:
    """vec_id, cluster, distance, the inertia of the cluster and of all, and the digest of the cluster's centroid."""
    spark = found.assigned.sparkSession
    sums = {r.cluster: r.total for r in found.assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    rows = [(c, sums.get(c, 0), sum(sums.values()), d) for c, d in enumerate(digests)]
    clusters = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.assigned.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
