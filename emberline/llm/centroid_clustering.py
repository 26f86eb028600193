"""Clustering of integer vectors around centroids, with Ptolemaic lower bounds in place of most distances.

For four points Ptolemy's inequality says d(x,c) d(p,q) >= |d(x,p) d(c,q) - d(x,q) d(c,p)|. A few pivots are fixed
before the first round, so the distances of every vector to them are computed once and stored with it; a round
computes those of the centroids, and each pair of pivots (p,q) then bounds every distance from below without
touching a vector's components. The bounds are rounded down by more than their arithmetic can err. A vector's
exact integer distance is computed to the centroid of the least bound, and then to those only whose bound does
not exceed the best so far, so ties are never lost.

Vectors are integers floor(scale * x). Each round assigns every vector to its nearest centroid (squared Euclidean
distance, the smaller number on ties) and moves each centroid that has vectors to the floor of their mean; an
empty one stays. Sums are added up in tasks, then by Spark; the driver sees k x dims numbers a round. Rounds end
early only if no centroid moved, as later ones would change nothing.

Vectors that are null, of another length than ``dims``, or with a null or non-finite component are left out.
Components beyond 2^27 / scale count as that bound, sums of distances beyond a long as the largest long. Repeated rows count once each; rows
with a null vec_id are clustered like any other, and never start a cluster unless there are too few others. With fewer than
``k`` vectors there are as many clusters as vectors; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm import scratch, vectors

LIMIT = 1 << 27
#: Vectors of which pivots are chosen.
PIVOT_SAMPLE = 256
#: Relative error that is granted to a bound; its arithmetic errs by less than 2^-50.
SLACK = 2.0**-45


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` vectors of ``sample`` far from each other: the first one, then always the one farthest from those taken."""
    taken, near = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(taken) < n and near.max() > 0:
        taken.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[taken[-1]]) ** 2).sum(axis=1))
    return sample[taken]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances between the rows of ``a`` and of the few rows of ``b``."""
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1) if len(b) else np.zeros((len(a), 0), np.int64)


def lower_bounds(to_pivots: np.ndarray, pivots: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """A number for each vector and centroid that their squared distance cannot be less than."""
    of_centroids, apart = np.sqrt(distances(centroids, pivots)), np.sqrt(distances(pivots, pivots))
    best = np.zeros((len(to_pivots), len(centroids)))
    for p in range(len(pivots)):
        for q in range(p):
            if apart[p, q] > 0:
                left = to_pivots[:, p, None] * of_centroids[None, :, q]
                right = to_pivots[:, q, None] * of_centroids[None, :, p]
                np.maximum(best, (np.abs(left - right) - SLACK * (left + right)) / apart[p, q], out=best)
    return best * best * (1 - SLACK)


def nearest(v: np.ndarray, to_pivots: np.ndarray, pivots: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector, the squared distance, and how many exact distances that took."""
    bounds = lower_bounds(to_pivots, pivots, centroids)
    arg = bounds.argmin(axis=1)
    best = ((v - centroids[arg]) ** 2).sum(axis=1)
    first, exact = arg.copy(), len(v)
    for c in range(len(centroids)):
        at = np.flatnonzero((first != c) & (bounds[:, c] <= best))
        if len(at):
            d = ((v[at] - centroids[c]) ** 2).sum(axis=1)
            closer = (d < best[at]) | (d == best[at]) & (c < arg[at])
            best[at[closer]], arg[at[closer]] = d[closer], c
            exact += len(at)
    return arg, best, exact


def _batches(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    rows = max(1, vectors.BLOCK_BYTES // (8 * dims))
    for whole in batches:
        for lo in range(0, whole.num_rows, rows):
            batch = whole.slice(lo, rows)
            yield batch, vectors.matrix(batch.column("v"), dims)


def _with_pivot_distances(kept: DataFrame, pivots: np.ndarray, dims: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, v in _batches(batches, dims):
            d = np.sqrt(distances(v, pivots)).ravel()
            offsets = np.arange(len(v) + 1, dtype=np.int32) * len(pivots)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.ListArray.from_arrays(offsets, d)], names=["vec_id", "v", "p"])

    return kept.mapInArrow(run, "vec_id long, v array<int>, p array<double>")


def _assigned(batch: pa.RecordBatch, v: np.ndarray, pivots: np.ndarray, centroids: np.ndarray):
    p = batch.column("p").flatten().to_numpy(zero_copy_only=False).reshape(len(v), len(pivots))
    return nearest(v, p, pivots, centroids)


def _moved(table: DataFrame, pivots: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round over all vectors."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, dims + 1), np.int64)  # the last column counts
        for batch, v in _batches(batches, dims):
            arg = _assigned(batch, v, pivots, centroids)[0]
            for c in np.unique(arg):
                mine = v[arg == c]
                sums[c, :dims] += mine.sum(axis=0)
                sums[c, dims] += len(mine)
        c, i = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(i, pa.int32()), pa.array(sums[c, i])], names=["c", "i", "total"])

    made = table.mapInArrow(run, "c int, i int, total long").groupBy("c", "i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    total = np.zeros((k, dims + 1), object)
    for r in made.collect():  # k x (dims + 1) rows at most
        total[r["c"], r["i"]] = int(r["total"])
    return np.array([[t // row[dims] for t in row[:dims]] if row[dims] else old for row, old in zip(total, centroids.tolist())], np.int64)


def cluster(rows: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, dims: int = 64, seed: str = "3", pivots: int = 6) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector of ``rows(vec_id, embedding)``, and the final centroids.

    Centroids start as the ``k`` vectors with the smallest sha256 of ``seed:vec_id``; equal hashes are ordered by the vectors.
    """
    kept = rows.filter((F.size("embedding") == dims) & vectors.whole("embedding")).select("vec_id", vectors.integers("embedding", scale, LIMIT).alias("v"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    some = kept.orderBy(F.asc_nulls_last(digest), "v").limit(max(k, PIVOT_SAMPLE)).collect()
    if not some:
        return rows.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, dims), np.int64)
    sample = np.array([r["v"] for r in some], np.int64)
    centroids, fixed = sample[:k], choose_pivots(sample, pivots)
    table = scratch.materialize(_with_pivot_distances(vectors.spread(kept), fixed, dims), "vectors")
    for _ in range(rounds):
        before, centroids = centroids, _moved(table, fixed, centroids)
        if (before == centroids).all():
            break
    last = centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, v in _batches(batches, dims):
            arg, best, _ = _assigned(batch, v, fixed, last)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(arg, pa.int32()), pa.array(best)], names=["vec_id", "cluster", "distance"])

    return scratch.materialize(table.mapInArrow(run, "vec_id long, cluster int, distance long"), "clusters"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with cluster_inertia, inertia, and the digest of each cluster's centroid."""
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row for each centroid at most
    fits = lambda n: min(n, (1 << 63) - 1)
    total = sum(int(r["s"]) for r in sums)
    facts = [(r["cluster"], fits(int(r["s"])), fits(total), hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()) for r in sums]
    named = assigned.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
