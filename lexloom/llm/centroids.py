"""Centroid clustering: k-means on integer vectors, nearest centroids by the threshold algorithm.

For every dimension the centroids are sorted by their component. A vector walks these lists outward
from its own value, one step in all dimensions at a time; a centroid that it meets for the first time
gets its exact squared distance. What no list has shown yet is at least as far away as the frontiers
together, so the walk ends when the sum of the squared frontier distances is strictly above the best
exact distance (a tie may still hide a smaller number), or when all centroids were met. Blocks of
vectors walk together as arrays.

A vector is kept if it has exactly ``dims`` components, none null, NaN or infinite; others have no row
in the result. Components become ``floor(scale * x)``; beyond 2^27 in size the squared distance would not
fit a long, and the job stops with an error. Null ids are kept and drawn as if their id were the empty
string. Repeated rows are vectors of their own; rows of one id draw alike and the smaller components
come first. With fewer vectors than ``k`` there are fewer centroids, without any the result is empty.
Extra columns are ignored.

Vectors stay in their partitions: a round moves one row of sums per task and cluster, and ``k`` rows of
``dims`` sums reach the driver, whatever the table's size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import cut_lineage

K, DIMS, ROUNDS, SCALE, SEED = 40, 64, 5, 256, 2
_BLOCK = 512
_LARGEST = 1 << 27
_EXACT = 1 << 20  # sums of squares of such differences are exact doubles


class Nearest:
    """The nearest of a few centroids (squared Euclidean distance, ties to the smaller number)."""

    def __init__(self, centroids: np.ndarray) -> None:
        k, dims = centroids.shape
        self.order = np.argsort(centroids, axis=0, kind="stable")
        self.centroids = np.ascontiguousarray(centroids, np.int64)
        # list d lies at place d, with a step beyond either end that belongs to no centroid
        self.place = (np.arange(dims, dtype=np.int32) * (k + 2))[None, :]
        name = np.full((dims, k + 2), k, np.int32)
        name[:, 1:-1] = self.order.T
        self.name = name.ravel()

    def of(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and distances for integer ``vectors`` of shape (n, dims)."""
        largest = max(np.abs(vectors).max(initial=0), np.abs(self.centroids).max(initial=0))
        kind = np.float64 if largest <= _EXACT else np.int64  # both exact, the first is faster
        centroids = self.centroids.astype(kind)
        lists = np.pad(np.take_along_axis(centroids, self.order, axis=0).T, ((0, 0), (1, 1)))
        lists[:, 0], lists[:, -1] = -8 * _LARGEST, 8 * _LARGEST
        number = np.zeros(len(vectors), np.int64)
        distance = np.zeros(len(vectors), np.int64)
        for at in range(0, len(vectors), _BLOCK):
            part = slice(at, at + _BLOCK)
            number[part], distance[part] = self._walk(vectors[part].astype(kind), centroids, lists)
        return number, distance

    def _walk(self, x: np.ndarray, centroids: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, k = len(x), len(centroids)
        best, number = np.zeros(n, x.dtype), np.zeros(n, np.int64)
        right = np.empty(x.shape, np.int32)
        for d, (values, mine) in enumerate(zip(lists, x.T.copy())):
            right[:, d] = np.searchsorted(values[1:-1], mine)
        right += self.place + 1
        left = right - 1
        values = lists.ravel()
        down, up = x - values[left], values[right] - x  # to the frontiers
        rows = np.arange(n)  # the vectors that still walk
        exact = np.full((n, k), 2.0**62 if x.dtype.kind == "f" else 1 << 62, x.dtype)
        met = np.zeros((n, k + 1), bool)
        met[:, k] = True
        while len(rows):
            to_left = down <= up
            known = met.copy()
            met[np.arange(len(rows))[:, None], self.name[np.where(to_left, left, right)]] = True
            row, new = np.nonzero(met & ~known)
            gap = x[row] - centroids[new]
            exact[row, new] = np.einsum("ij,ij->i", gap, gap)
            least = exact.min(axis=1)
            left = np.maximum(left - to_left, self.place)
            right = np.minimum(right + ~to_left, self.place + (k + 1))
            down, up = x - values[left], values[right] - x
            frontier = np.minimum(down, up)
            walks = ~met.all(axis=1) & (np.einsum("ij,ij->i", frontier, frontier) <= least)
            ends = ~walks
            best[rows[ends]], number[rows[ends]] = least[ends], exact[ends].argmin(axis=1)
            if ends.any():
                rows, x, left, right, down, up, met, exact = (a[walks] for a in (rows, x, left, right, down, up, met, exact))
        return number, best.astype(np.int64)


def _matrix(column, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def kept_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and the integer components of the vectors that are kept."""
    values = F.col("embedding").cast("array<double>")
    sound = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.filter((F.size(values) == dims) & sound)
    largest = F.array_max(F.transform(values, lambda x: F.abs(F.floor(x * scale))))
    whole = F.transform(values, lambda x: F.floor(x * scale).cast("int"))
    fits = F.when(largest <= _LARGEST, whole).otherwise(F.raise_error(F.lit(f"a component times {scale} is beyond 2^27")))
    return kept.select("vec_id", fits.cast("array<int>").alias("v"))


def first_centroids(kept: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The vectors with the ``k`` smallest digests of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    drawn = kept.select("v", digest.alias("digest")).orderBy("digest", "v").limit(k).collect()
    return np.array([r["v"] for r in drawn], np.int64)


def _sums(shared, dims: int):
    def run(batches):
        nearest = Nearest(shared.value)
        k = len(shared.value)
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v"), dims)
                number, _ = nearest.of(x)
                by_cluster = np.argsort(number, kind="stable")
                first = np.unique(number[by_cluster], return_index=True)[1]
                total[number[by_cluster[first]]] += np.add.reduceat(x[by_cluster], first)
                count += np.bincount(number, minlength=k)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(count[used]), *(pa.array(total[used, d]) for d in range(dims))],
            names=["cluster", "n", *(f"s{d}" for d in range(dims))],
        )

    return run


def moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: centroids replaced by the floored mean of their vectors; empty ones stay."""
    dims = centroids.shape[1]
    names = ["n", *(f"s{d}" for d in range(dims))]
    shared = kept.sparkSession.sparkContext.broadcast(centroids)  # k x dims numbers
    parts = kept.select("v").mapInArrow(_sums(shared, dims), "cluster int, " + ", ".join(f"{n} long" for n in names))
    new = centroids.copy()
    for r in parts.groupBy("cluster").agg(*(F.sum(n).alias(n) for n in names)).collect():  # at most k rows
        new[r["cluster"]] = [r[f"s{d}"] // r["n"] for d in range(dims)]
    shared.unpersist()
    return new


def _assigned(shared, dims: int):
    def run(batches):
        nearest = Nearest(shared.value)
        for batch in batches:
            if batch.num_rows:
                number, distance = nearest.of(_matrix(batch.column("v"), dims))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array(number, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"]
                )

    return run


def assigned(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of every vector."""
    shared = kept.sparkSession.sparkContext.broadcast(centroids)
    vec_id = kept.schema["vec_id"].dataType.simpleString()
    return kept.mapInArrow(_assigned(shared, centroids.shape[1]), f"vec_id {vec_id}, cluster int, distance long")


def clustered(
    vectors: DataFrame, k: int = K, dims: int = DIMS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and centroid of every kept vector."""
    spark = vectors.sparkSession
    kept = cut_lineage(kept_vectors(vectors, dims, scale))
    centroids = first_centroids(kept, k, seed)
    if len(centroids):
        for _ in range(rounds):
            centroids = moved(kept, centroids)
    else:
        centroids = np.zeros((0, dims), np.int64)
    placed = cut_lineage(assigned(kept, centroids))
    spent = {r["cluster"]: r["d"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    rows = [
        (c, spent.get(c, 0), sum(spent.values()), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest(), v)
        for c, v in enumerate(centroids.tolist())
    ]
    of_cluster = spark.createDataFrame(
        rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>"
    )
    joined = placed.join(F.broadcast(of_cluster), "cluster")  # k rows
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
