"""Centroid clustering on whole numbers, with bounds from the geometry of moved centroids.

Each component x becomes floor(256 * x); distances are squared Euclidean ones in 64-bit integers, so results are exact. A
round assigns every vector to the nearest centroid, then moves each centroid to the floor of its vectors' mean.

A vector keeps a lower bound of its distance to all centroids but its own. When centroids move, all vectors of a cluster
lie in the sphere around its old centroid that reaches to the farthest of them. For another centroid c that moves by d,
the plane through the old centroid, c and its move shows how much nearer c can come to any place in that sphere: seen
from c, the sphere fills a cone, and a place at distance r under the angle a from the move gets nearer by
r - sqrt(r * r + d * d - 2 * r * d * cos(a)), which grows with r and falls with a. So the far edge of the cone that is
nearest to the move gives the most, usually much less than d, and below 0 where c moves away. A cluster's bounds are
loosened by the largest of these amounts. A vector whose own centroid is still nearer than its bound stays;
all others are compared with every centroid.

Each round reads the vectors with their state, writes them anew and removes the table before. Only centroids, their sums
and radii (`clusters` rows at most) meet in the driver.

Defined cases: vectors that are null, have another number of components, or a null or non-finite one, take no part; nor
does one with a component whose whole number is 2**27 or more in size, as its squared distances may not fit 64 bits. A
null vec_id takes part but never starts a centroid. Equal vectors have equal results; equal vec_ids start centroids in
the order of their components; with fewer vectors than `clusters` there are as many centroids; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

CLUSTERS, ROUNDS, SEED, SIZE, SCALE = 40, 5, 2, 64, 256
#: Whole numbers below this keep squared distances of 64 components within 64 bits.
LARGEST = 1 << 27
STATE = "vec_id long, x array<int>, cluster int, distance long, bound double, scanned boolean"


def whole_numbers(vectors: DataFrame, column: str = "embedding", size: int = SIZE) -> DataFrame:
    """vec_id and x, the whole numbers of each vector that takes part."""
    v = F.col(column).cast("array<double>")
    usable = (F.size(v) == size) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST / SCALE))
    x = F.transform(v, lambda c: F.floor(c * SCALE).cast("int"))
    return vectors.where(F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors with the least hashes of seed and vec_id, in the order of the hashes."""
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id is not null").withColumn("_code", code).orderBy("_code", "x").limit(clusters).collect()
    return np.array([r["x"] for r in rows], dtype=np.int64)


@dataclass
class Moved:
    """Centroids, and by how much each cluster's bounds are loosened; without `loosen` every vector is compared with all."""

    centroids: np.ndarray
    loosen: np.ndarray | None = None


def loosening(before: np.ndarray, after: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """By how much any other centroid can have come nearer to a vector of each cluster.

    `radius` is the largest distance of a cluster's vectors from its centroid before.
    """
    b, step = before.astype(float), (after - before).astype(float)
    moved = np.sqrt((step**2).sum(1))
    apart = b[:, None, :] - b[None, :, :]  # from centroid j to cluster i
    far = np.sqrt((apart**2).sum(2))
    with np.errstate(divide="ignore", invalid="ignore"):
        angle = np.nan_to_num(np.arccos(np.clip(np.einsum("ijk,jk->ij", apart, step) / (far * moved), -1, 1)))  # equal centroids: straight ahead
        cone = np.where(far > radius[:, None], np.arcsin(np.clip(radius[:, None] / far, 0, 1)), np.pi)
    least = np.maximum(angle - cone, 0)
    reach = far + radius[:, None]
    nearer = reach - np.sqrt(np.maximum(reach**2 + moved**2 - 2 * reach * moved * np.cos(least), 0))
    nearer = np.where(moved > 0, nearer, 0.0)
    np.fill_diagonal(nearer, -np.inf)
    return nearer.max(1) if len(before) > 1 else np.zeros(len(before))


def _squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to centroids; doubles where all that occurs fits their 53 bits."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    kind = np.float64 if largest < 1 << 20 else np.int64
    x, c = x.astype(kind), centroids.astype(kind)
    return ((x**2).sum(1)[:, None] - 2 * (x @ c.T) + (c**2).sum(1)).astype(np.int64)


def assign(x: np.ndarray, cluster: np.ndarray, bound: np.ndarray, moved: Moved) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """cluster, squared distance, bound, and whether the vector was compared with all centroids."""
    c = moved.centroids
    if moved.loosen is None or len(c) < 2:
        scan = np.ones(len(x), bool)
        own = np.zeros(len(x), np.int64)
    else:
        own = ((x - c[cluster]) ** 2).sum(1)
        bound = bound - moved.loosen[cluster]
        scan = np.sqrt(own.astype(float)) * (1 + 1e-9) + 1e-6 >= bound
    cluster, bound = cluster.copy(), bound.copy()
    if scan.any():
        d = _squared(x[scan], c)
        near = d.argmin(1)
        rows = np.arange(len(d))
        cluster[scan], own[scan] = near, d[rows, near]
        d[rows, near] = np.iinfo(np.int64).max
        bound[scan] = np.sqrt(d.min(1).astype(float)) * (1 - 1e-12) if len(c) > 1 else np.inf
    return cluster, own, bound, scan


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


def _round(state: DataFrame, moved: Moved) -> DataFrame:
    """The state of each vector after it is assigned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            old, bound = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 4))
            cluster, own, bound, scan = assign(_matrix(batch.column(1)), old, bound, moved)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(own), pa.array(bound), pa.array(scan)], names=["vec_id", "x", "cluster", "distance", "bound", "scanned"])

    return state.select("vec_id", "x", "cluster", "distance", "bound", "scanned").mapInArrow(run, STATE)


def _totals(state: DataFrame, size: int) -> list:
    """cluster, n, total (of each component) and farthest (the largest squared distance); tasks add up their own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            x, cluster, own = _matrix(batch.column(0)) if len(batch) else np.zeros((0, size), np.int64), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for k in np.unique(cluster).tolist():
                mine = cluster == k
                n, total, far = sums.get(k, (0, 0, 0))
                sums[k] = [n + int(mine.sum()), total + x[mine].sum(0), max(far, int(own[mine].max()))]
        rows = [{"cluster": k, "n": n, "total": total.tolist(), "farthest": far} for k, (n, total, far) in sums.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64())), ("farthest", pa.int64())]))

    parts = state.select("x", "cluster", "distance").mapInArrow(run, "cluster int, n long, total array<long>, farthest long")
    each = [F.sum(F.get("total", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("farthest").alias("farthest"), *each).collect()


def clusters(vectors: DataFrame, column: str = "embedding", size: int = SIZE, count: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """The state of each vector behind the last assignment (`scanned`: compared with all centroids then), and the centroids."""
    first = whole_numbers(vectors, column, size)
    blank = {"cluster": F.lit(0), "distance": F.lit(0).cast("long"), "bound": F.lit(0.0), "scanned": F.lit(False)}
    centroids = first_centroids(first, count, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], STATE), centroids.reshape(0, size)
    moved, state = Moved(centroids), first.withColumns(blank)
    for k in range(rounds + 1):
        done = materialize(_round(state, moved), "clusters")
        if k:
            discard(state)
        state = done
        if k < rounds:
            after, radius = moved.centroids.copy(), np.zeros(len(centroids))
            for r in _totals(state, size):
                after[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(size)]
                radius[r["cluster"]] = np.sqrt(float(r["farthest"])) * (1 + 1e-12)
            moved = Moved(after, loosening(moved.centroids, after, radius))
    return state, moved.centroids


def cluster(vectors: DataFrame, column: str = "embedding", size: int = SIZE, count: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and scanned of each vector."""
    state, centroids = clusters(vectors, column, size, count, rounds, seed)
    own = {r["cluster"]: int(r["d"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digest = lambda k: hashlib.sha256(",".join(map(str, centroids[k].tolist())).encode()).hexdigest()
    rows = [(k, d, sum(own.values()), digest(k)) for k, d in own.items()]  # a row for each cluster, at most `count`
    facts = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scanned")
