"""Centroid clustering of integer vectors by scalar lookup tables.

A round tabulates, for every dimension, the squared difference between each integer value that occurs there and each
centroid; the distance of a vector is then the sum of one table row per dimension. Tables are built inside the task for
the values of its own batch, so they never hold more rows than the batch has vectors.

What leaves a task in a round is one row of sums per centroid and dimension; the driver sees the centroids (their number
times the dimensions) and nothing else. Sums are exact integers, so results do not depend on the partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import written

DIMENSIONS = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
#: components beyond this have squared distances beyond 63 bits
LARGEST = 1 << 27
#: vectors looked up at once
BATCH = 4096


def quantised(x: DataFrame, id: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and v: the components as 32-bit integers floor(scale * x) in one binary value, for the vectors that are kept."""
    v = F.col(vector).cast("array<double>")
    ok = F.coalesce(F.size(v) == dimensions, F.lit(False)) & F.forall(
        v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float(LARGEST // scale)))
    x = x.where(ok).select(F.col(id).cast("long").alias("vec_id"), F.transform(v, lambda e: F.floor(e * float(scale)).cast("int")).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype("<i4")
            offs = np.arange(batch.num_rows + 1, dtype=np.int32) * np.int32(4 * dimensions)
            packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(a))])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), packed], ["vec_id", "v"])

    return x.mapInArrow(run, "vec_id long, v binary")


def vectors(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dimensions).astype(np.int64)


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller one of ties) and the squared distance to it."""
    total = np.zeros((len(v), len(centroids)), np.int64)
    for d in range(v.shape[1]):
        values, row = np.unique(v[:, d], return_inverse=True)
        table = (values[:, None] - centroids[None, :, d]) ** 2
        total += table[row.ravel()]
    best = np.argmin(total, axis=1)
    return best, total[np.arange(len(v)), best]


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                k, d = nearest(vectors(part.column("v"), centroids.shape[1]), centroids)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(k.astype(np.int32)), pa.array(d)], ["vec_id", "cluster", "distance"])
    return run


def _sums(centroids: np.ndarray):
    k, n = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, n), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                v = vectors(batch.slice(i, BATCH).column("v"), n)
                best, _ = nearest(v, centroids)
                order = np.argsort(best, kind="stable")
                used, at = np.unique(best[order], return_index=True)
                total[used] += np.add.reduceat(v[order], at, axis=0)
                count += np.bincount(best, minlength=k)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(list(total[some]), pa.list_(pa.int64()))],
                                         ["cluster", "n", "total"])
    return run


def start(x: DataFrame, salt: str, clusters: int, dimensions: int) -> np.ndarray:
    """The vectors with the smallest hash of `salt` and their id; rows of one id by their components."""
    h = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = x.select(h.alias("h"), "v").orderBy("h", "v").limit(clusters).toArrow()
    return vectors(rows.column("v").combine_chunks(), dimensions) if rows.num_rows else np.zeros((0, dimensions), np.int64)


def moved(x: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: the floor of the mean of their vectors; one without vectors stays."""
    t = x.select("v").mapInArrow(_sums(centroids), "cluster int, n long, total array<long>")
    t = t.select("cluster", "n", F.posexplode("total").alias("dim", "s"))
    t = t.groupBy("cluster", "dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()
    out = centroids.copy()
    for r in t:
        out[r["cluster"], r["dim"]] = int(r["s"]) // int(r["n"])
    return out


def digest(centroid: Column) -> Column:
    return F.sha2(F.array_join(F.transform(centroid, lambda c: c.cast("string")), ","), 256)


def cluster(x: DataFrame, id: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS,
            salt: str = "2:") -> DataFrame:
    """Clusters of vectors.

    Output per kept row: vec_id, cluster (int), distance (long, squared, to its centroid), centroid (array of long),
    cluster_inertia and inertia (sums of distance over the cluster and over all rows; null where a sum is beyond 63 bits).
    A vector is kept if it has exactly `dimensions` components, none of them null, not finite or of 2^27 / 256 and more
    (no 63-bit distance holds those). Repeated rows and ids count as often as they come; a null id is hashed as an empty
    one. With fewer rows than clusters every row starts a centroid; ties go to the smaller number; other columns are
    ignored; an empty table gives an empty result.
    """
    spark = x.sparkSession
    kept = written(quantised(x, id, vector, dimensions), "vectors")
    c = start(kept, salt, clusters, dimensions)
    for _ in range(rounds if len(c) else 0):
        c = moved(kept, c)
    out = written(kept.mapInArrow(_assigned(c), "vec_id long, cluster int, distance long"), "assigned")
    sums = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}
    total = sum(s for s in sums.values()) if None not in sums.values() else None
    total = total if total is not None and total < 1 << 63 else None
    table = spark.createDataFrame([(i, [int(y) for y in r], sums.get(i), total) for i, r in enumerate(c)],
                                  "cluster int, centroid array<long>, cluster_inertia long, inertia long")
    # at most `clusters` rows
    return out.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "centroid", "cluster_inertia", "inertia")
