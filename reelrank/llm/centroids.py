"""Centroid clustering with exact integers; nearest centroids by the threshold algorithm.

Every dimension has a list of the centroids sorted by their component. A vector enters each list at its own component and
walks outward, always to the nearer of the two next entries. A centroid met for the first time gets its exact squared
distance. What no list has met yet is at least as far as the sum, over the lists, of the squared gaps to their next
entries (the frontier): a vector stops once that sum strictly exceeds its best exact distance, or when it has met all
centroids. Not stopping at equality keeps ties, which go to the smaller number. All vectors of a batch walk together in
numpy; those that stopped leave the batch.

A round is one pass over the stored integer vectors: each task returns one row of counts and sums for each centroid, so a
cluster that holds most of the rows costs no more than another, and k rows of sums reach the driver.

Vectors that are null, of another length, or with a null or non-finite component are not kept. Components are clamped to
+-2**27 after scaling, so that distances fit a long. Repeated rows count as often as they stand; equal start hashes (of
repeated ids) are ordered by their components, a null id counts as the empty text. With fewer kept vectors than k, all of
them start; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, store

K = 40
ROUNDS = 5
DIMENSIONS = 64
SCALE = 256
SEED = "2:"
LIMIT = 2**27
# Lists that walk one entry between two looks at the frontier.
STRIDE = 16
# Rows that walk together.
STEP = 1024


class SortedLists:
    """The centroids' components, one ascending list for each dimension."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable").T.copy()
        self.value = np.sort(centroids, axis=0).T.copy()

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid of each row (int64)."""
        at = np.zeros(len(x), np.int64)
        far = np.zeros(len(x), np.int64)
        for i in range(0, len(x), STEP):
            at[i: i + STEP], far[i: i + STEP] = self._walk(x[i: i + STEP])
        return at, far

    def _gap(self, x: np.ndarray, low: np.ndarray, high: np.ndarray, lists: slice) -> tuple[np.ndarray, np.ndarray]:
        """Distance to the next entry below and above in each of the lists; beyond an end, more than any real gap."""
        k, dims = len(self.centroids), np.arange(lists.start, lists.stop)[:, None]
        below = np.where(low >= 0, x - self.value[dims, np.maximum(low, 0)], 4 * LIMIT)
        above = np.where(high < k, self.value[dims, np.minimum(high, k - 1)] - x, 4 * LIMIT)
        return below, above

    def _walk(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The walk of all rows; lists are the first axis, so that a step works on contiguous slices."""
        (n, d), k = rows.shape, len(self.centroids)
        unmet = np.iinfo(np.int64).max
        exact = np.full((n, k), unmet, np.int64)
        x = np.ascontiguousarray(rows.T)
        high = np.stack([np.searchsorted(self.value[j], x[j]) for j in range(d)])
        low = high - 1
        below, above = self._gap(x, low, high, slice(0, d))
        gap = np.minimum(below, above) ** 2
        frontier = gap.sum(axis=0)
        act, on = np.arange(n), np.ones(n, bool)  # rows still in the arrays, and those of them that still walk
        first = 0
        while on.any():
            if on.sum() * 2 <= len(act):
                x, high, low, below, above, gap = (c[:, on] for c in (x, high, low, below, above, gap))
                frontier, act, on = frontier[on], act[on], on[on]
            lists = slice(first, min(first + STRIDE, d))
            first = lists.stop % d
            down = below[lists] <= above[lists]
            at = np.clip(np.where(down, low[lists], high[lists]), 0, k - 1)
            met = self.order[np.arange(lists.start, lists.stop)[:, None], at]
            low[lists] -= down
            high[lists] += ~down
            below[lists], above[lists] = self._gap(x[lists], low[lists], high[lists], lists)
            frontier -= gap[lists].sum(axis=0)
            gap[lists] = np.minimum(below[lists], above[lists]) ** 2
            frontier += gap[lists].sum(axis=0)
            new = np.zeros((len(act), k), bool)
            new[np.arange(len(act))[None, :], met] = True
            new &= on[:, None] & (exact[act] == unmet)
            row, c = np.nonzero(new)
            apart = rows[act[row]] - self.centroids[c]
            exact[act[row], c] = np.einsum("ij,ij->i", apart, apart)
            known = exact[act]
            on &= (known == unmet).any(axis=1) & (frontier <= known.min(axis=1))
        nearest = exact.argmin(axis=1)
        return nearest, exact[np.arange(n), nearest]


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the kept vectors as integers floor(scale * x)."""
    e = F.col(embedding)
    usable = e.isNotNull() & (F.size(e) == dimensions) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    scaled = F.transform(e, lambda x: F.floor(F.greatest(F.least(x.cast("double") * float(scale), F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int"))
    return vectors.where(F.coalesce(usable, F.lit(False))).select(F.col(vec_id).alias("vec_id"), scaled.alias("v"))


def _matrix(arr: pa.Array, dimensions: int) -> np.ndarray:
    return arr.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions).astype(np.int64)


def _sums(rows: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and component sums of each non-empty cluster: k rows."""
    bounded_batches(rows.sparkSession)
    k, d = centroids.shape
    lists = SortedLists(centroids)

    def run(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for b in batches:
            x = _matrix(b.column(0), d)
            at, _ = lists.nearest(x)
            order = np.argsort(at, kind="stable")
            cut = np.flatnonzero(np.diff(at[order], prepend=-1))
            if len(cut):
                own = at[order[cut]]
                total[own] += np.add.reduceat(x[order], cut, axis=0)
                count[own] += np.diff(np.append(cut, len(x)))
        full = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(count[full], pa.int64()),
                                          pa.array(total[full].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = rows.select("v").mapInArrow(run, "cluster int, n long, total array<long>")
    got = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[j]).alias(f"t{j}") for j in range(d)])
    return {r["cluster"]: (r["n"], [r[f"t{j}"] for j in range(d)]) for r in got.collect()}


def start_centroids(rows: DataFrame, k: int = K, seed: str = SEED) -> np.ndarray:
    """The k kept vectors with the smallest hash of seed + id, in ascending order (k x d values)."""
    hashed = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = rows.select(hashed.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in first], np.int64)


def fit(rows: DataFrame, k: int = K, rounds: int = ROUNDS, seed: str = SEED) -> np.ndarray:
    """Centroids (k x d int64) after `rounds` rounds over the integer vectors of `rows`."""
    centroids = start_centroids(rows, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        for c, (n, total) in _sums(rows, centroids).items():
            centroids[c] = [t // n for t in total]  # Python integers: exact, rounded down
    return centroids


def assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every row; none without a centroid."""
    bounded_batches(rows.sparkSession)
    lists = SortedLists(centroids) if len(centroids) else None
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            if b.num_rows and lists is not None:
                at, far = lists.nearest(_matrix(b.column(1), centroids.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.int32()), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"])

    return rows.select("vec_id", "v").mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def cluster(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, rounds: int = ROUNDS,
            dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(vec_id, cluster, distance) of every kept vector, and (cluster, size, cluster_inertia, centroid) of every centroid."""
    rows = store(integer_vectors(vectors, vec_id, embedding, dimensions, scale), "vectors")
    centroids = fit(rows, k, rounds, seed)
    found = store(assign(rows, centroids), "clusters")
    table = rows.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cluster int, centroid array<long>")
    sizes = found.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("distance").alias("cluster_inertia"))
    about = F.broadcast(table).join(sizes, "cluster", "left").na.fill(0, ["size", "cluster_inertia"])
    return found, about.select("cluster", "size", "cluster_inertia", "centroid")
