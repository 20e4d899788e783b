"""Centroid clustering with exact integers: Lloyd rounds whose nearest centroids are found by an equal-average
equal-variance search.

Centroids are sorted by the mean of their components. A vector starts where its own mean falls and looks outward on both
sides. With k components, means m and root deviations v (v * v is the sum of squared differences from the mean),
    distance >= k * (m_x - m_c) ** 2 + (v_x - v_c) ** 2,
so a side is closed once the first term alone exceeds the best distance, and a centroid is passed over where the sum
does. What is left is finished on 64-bit integers. Bounds are floats with a margin, and reject only what is farther for
certain, so that ties reach the exact finish and the smaller number wins.

Each round is one scan: a task adds up its own vectors by cluster and hands on one row a cluster, so the shuffle is
tasks times clusters and only clusters times components reach the driver, whatever number of vectors there is.

Defined results: vectors that are null, of another length, or with a null, NaN or infinite component are left out; so
are those with an integer component beyond 2 ** 27 either way, for which squared distances need not be longs. Equal
vectors are each counted, and equal ids too; of equal first hashes the smaller vector comes first, and a null id comes
last. With fewer vectors than clusters there are as many clusters as vectors. An empty table gives an empty result.
Columns other than the id and the vector are ignored. Texts play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import staged

#: Largest integer component: 64 * (2 * LARGEST) ** 2 is a long.
LARGEST = 2**27
#: Vectors that are compared at once.
AT_ONCE = 8192


def integer_components(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as double."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(scale * x))


def kept_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, q: ids and integer components of the vectors that count."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    sound = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) <= LARGEST))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), x.alias("x"))
    return rows.where((F.size("x") == dims) & F.coalesce(sound, F.lit(False))).select("vec_id", integer_components(F.col("x"), scale).alias("q"))


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the least sha256 of `seed:vec_id`."""
    hashed = vectors.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    rows = hashed.orderBy(F.asc_nulls_last("h"), "q").limit(clusters).select("q").collect()
    return np.array([r["q"] for r in rows], np.int64)


def _shape(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and root deviations."""
    mean = x.mean(axis=1)
    return mean, np.sqrt(((x - mean[:, None]) ** 2).sum(axis=1))


class Search:
    """Nearest centroids by means and deviations. `tested` counts full distances."""

    def __init__(self, centroids: np.ndarray):
        mean, deviation = _shape(centroids)
        self.number = np.lexsort((np.arange(len(centroids)), mean))
        self.centroids, self.mean, self.deviation = centroids[self.number], mean[self.number], deviation[self.number]
        self.largest = float(np.abs(centroids).max(initial=1))
        self.tested = 0

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each row's nearest centroid; ties have the smaller number."""
        n, k = x.shape
        mean, deviation = _shape(x)
        margin = 1e-11 * max(self.largest, float(np.abs(x).max(initial=1))) * k
        best, owner = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.mean))
        start = np.searchsorted(self.mean, mean)
        up, down = start.copy(), start - 1
        for turn in range(2 * len(self.mean) + 2):
            at, step = (up, 1) if turn % 2 == 0 else (down, -1)
            open_ = np.flatnonzero((at >= 0) & (at < len(self.mean)))
            if not len(open_):
                if not ((up < len(self.mean)) | (down >= 0)).any():
                    break
                continue
            c = at[open_]
            by_mean = k * np.maximum(np.abs(mean[open_] - self.mean[c]) - margin, 0) ** 2
            closed = by_mean > best[open_]
            at[open_[closed]] = len(self.mean) if step == 1 else -1
            open_, c, by_mean = open_[~closed], c[~closed], by_mean[~closed]
            near = by_mean + np.maximum(np.abs(deviation[open_] - self.deviation[c]) - margin, 0) ** 2 <= best[open_]
            rows, c = open_[near], c[near]
            self.tested += len(rows)
            d = ((x[rows] - self.centroids[c]) ** 2).sum(axis=1)
            number = self.number[c]
            better = (d < best[rows]) | ((d == best[rows]) & (number < owner[rows]))
            best[rows[better]], owner[rows[better]] = d[better], number[better]
            at[open_] += step
        return owner, best


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and rows of integer components, AT_ONCE at most."""
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(at, AT_ONCE)
            yield part.column(0), part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dims)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid replaced by the floored mean of its vectors; those without any stay."""
    k, dims = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, total, count = Search(centroids), np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for _, x in _blocks(batches, dims):
            owner, _ = search(x)
            order = np.argsort(owner, kind="stable")
            some, first = np.unique(owner[order], return_index=True)
            total[some] += np.add.reduceat(x[order], first, axis=0)
            count += np.bincount(owner, minlength=k)
        some = np.flatnonzero(count)
        yield pa.record_batch({"cluster": pa.array(some.astype(np.int32)), "n": pa.array(count[some]), "total": pa.array(total[some].tolist(), pa.list_(pa.int64()))})

    parts = vectors.mapInArrow(sums, "cluster int, n long, total array<long>")
    wide = parts.select("cluster", "n", F.posexplode("total").alias("i", "t"))
    sums_of = wide.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("t").cast("decimal(38,0)")).alias("t"))
    out = centroids.copy()
    for r in sums_of.collect():  # clusters times components
        out[r["cluster"], r["i"]] = int(r["t"]) // r["n"]
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for ids, x in _blocks(batches, dims):
            owner, best = search(x)
            yield pa.record_batch({"vec_id": ids, "cluster": pa.array(owner.astype(np.int32)), "distance": pa.array(best)})

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster_vectors(
    vectors: DataFrame, clusters: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, and centroid (its components)."""
    spark, rows = vectors.sparkSession, kept_vectors(vectors, dims, scale, id_col, vector_col)
    centroids = first_centroids(rows, clusters, seed)
    if not len(centroids):
        none = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>"
        return rows.select("vec_id").where("false").join(spark.createDataFrame([], none))
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    found = staged(assigned(rows, centroids), "assigned")
    inertia = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    told = [(i, inertia.get(i, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest(), c) for i, c in enumerate(centroids.tolist())]
    of_cluster = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    return found.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
