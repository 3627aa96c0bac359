"""Centroid clustering by Lloyd's rounds on integer vectors, with partial-distance search.

Components are floored to integers after scaling, so that distances, sums and centroids are exact whatever the order of the rows. To find a row's
nearest centroid, squared differences are added over the components of the largest variance first: after the first block of components the most
promising centroid is finished, and each other one is abandoned as soon as its partial distance is strictly above the best so far. What survives has all
components added; equal distances go to the smaller number.

Vectors that are null, of another length or hold null or non-finite components are left out. Components beyond 131,072 in size are taken as that, so that
squared distances fit into a long. Rows are clustered one by one: repeated rows count as often as they stand, and a null id is kept as it is but never starts a
centroid. With fewer rows than centroids there are as many centroids as rows; without rows the result is empty.

The integer vectors are written to the shared folder once. A round reads them in parallel, and each task sends one row of sums for each centroid;
the driver holds the centroids alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored, text_batches

SCALE = 1024
#: Largest size of a component as an integer: 64 squares of twice that fit into a long.
LIMIT = 1 << 27
#: Components that are added before partial distances are compared again.
BLOCK = 8
#: Parts that the tasks' sums of a centroid are added in first.
PARTS = 64


def quantized(vectors: DataFrame, dims: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): the vectors of ``dims`` finite components as integers, floor(SCALE * component)."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    scaled = lambda x: F.greatest(F.lit(float(-LIMIT)), F.least(F.lit(float(LIMIT)), SCALE * x.cast("double")))
    return vectors.where((F.size(v) == dims) & finite).select(F.col(key).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(scaled(x)).cast("int")).alias("x"))


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of each row of ``x`` (int64), and how many components were compared for that."""
    xs, cs = x[:, order], centroids[:, order]
    n, dims, rows = len(xs), xs.shape[1], np.arange(len(xs))
    first = np.stack([((xs[:, :block] - c[:block]) ** 2).sum(axis=1) for c in cs], axis=1)
    cluster = first.argmin(axis=1)
    guess, best = cluster.copy(), first[rows, cluster] + ((xs[:, block:] - cs[cluster, block:]) ** 2).sum(axis=1)
    work = n * (len(cs) * min(block, dims) + max(0, dims - block))
    for c in range(len(cs)):
        alive = np.flatnonzero((first[:, c] <= best) & (guess != c))
        part = first[alive, c]
        for at in range(block, dims, block):
            if not len(alive):
                break
            d = xs[alive, at : at + block] - cs[c, at : at + block]
            part += (d**2).sum(axis=1)
            work += d.size
            stays = part <= best[alive]
            alive, part = alive[stays], part[stays]
        wins = (part < best[alive]) | ((part == best[alive]) & (c < cluster[alive]))
        best[alive[wins]], cluster[alive[wins]] = part[wins], c
    return cluster, best, work


def _matrix(batch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def _moved(rows: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floored mean of what each is nearest to; one that nothing is nearest to stays."""
    k, dims = centroids.shape

    def sums(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = _matrix(batch, dims)
            if not len(x):
                continue
            cluster, _, _ = nearest(x, centroids, order)
            by = np.argsort(cluster, kind="stable")
            found, at = np.unique(cluster[by], return_index=True)
            total[found] += np.add.reduceat(x[by], at, axis=0)
            count += np.bincount(cluster, minlength=k)
        has = np.flatnonzero(count)
        part = np.full(len(has), TaskContext.get().partitionId() % PARTS, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(part), pa.array(count[has]), pa.array(list(total[has]), pa.list_(pa.int64()))], names=["cluster", "part", "n", "s"])

    parts = rows.mapInArrow(sums, "cluster int, part int, n long, s array<long>")
    exact = [F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
    whole = parts.groupBy("cluster", "part").agg(F.sum("n").alias("n"), *exact).groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(dims)])
    out = centroids.copy()
    for r in whole.collect():  # a row for each centroid
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dims)]
    return out


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, seed: str = "3:", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that takes part.

    Centroids start as the ``k`` rows with the least sha256 of seed and id. An inertia that doesn't fit into a long is null.
    """
    spark = vectors.sparkSession
    text_batches(spark)
    rows = stored(quantized(vectors, dims, key, vector), "cluster-vectors")
    start = rows.where("vec_id is not null").orderBy(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256), "x").limit(k).select("x").collect()
    if not start:
        discard(rows)
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["x"] for r in start], np.int64)
    spread = rows.agg(*[F.var_pop(F.col("x")[i]).alias(f"v{i}") for i in range(dims)]).first()
    order = np.argsort([-v for v in spread], kind="stable")
    for _ in range(rounds):
        moved = _moved(rows, centroids, order)
        if np.array_equal(moved, centroids):  # further rounds change nothing
            break
        centroids = moved

    def assign(batches):
        import pyarrow as pa

        for batch in batches:
            c, d, _ = nearest(_matrix(batch, dims), centroids, order)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(c.astype(np.int32)), pa.array(d)], names=["vec_id", "cluster", "distance"])

    found = stored(rows.mapInArrow(assign, "vec_id long, cluster int, distance long"), "cluster-assigned")
    discard(rows)
    totals = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    fits = lambda x: x if x < 2**63 else None
    every = fits(sum(totals.values()))
    said = [(c, fits(d), every, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in totals.items()]
    about = spark.createDataFrame(said, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
