"""Centroid clustering of vectors: Lloyd's algorithm on distinct quantised vectors.

Components become integers.  Equal vectors are counted before anything is shuffled and
are one weighted vector from then on, so a vector that a third of all rows share costs
what any other does.  Each round assigns the distinct vectors to the nearest of K
centroids, which every task holds, and adds up weighted integers a task and cluster at a
time; only those sums meet.  All of it is exact: the result doesn't depend on how rows lie.
At the end the assignments are joined back to the rows on the vectors themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored

#: Dimensions of a vector, integer steps a unit, centroids, rounds, and the salt that draws the first centroids.
DIMENSIONS, SCALE, K, ROUNDS, SALT = 64, 64, 16, 3, "1"
#: A component must be less, so that a squared distance fits 64 bits.
LARGEST = 1 << 20


def quantised(vector: Column, dimensions: int = DIMENSIONS) -> Column:
    """floor(SCALE * x) of each component; null for what isn't kept: another length, a null or non-finite or too large component."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    whole = F.transform(doubles, lambda x: F.floor(x * SCALE).cast("int"))
    return F.when((F.size(vector) == dimensions) & fine, whole)


def first_centroids(rows: DataFrame, k: int = K) -> np.ndarray:
    """The vectors of the k rows (vec_id, v) of the least hashes of their ids, in that order; of equal ids the lesser vector first."""
    drawn = F.sha2(F.concat(F.lit(f"{SALT}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(drawn.alias("drawn"), "v").orderBy("drawn", "v").limit(k).collect()
    return np.array([r["v"] for r in first], np.int64)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each vector; of equally near centroids the first."""
    best = np.zeros(len(vectors), np.int32)
    least = np.full(len(vectors), np.iinfo(np.int64).max)
    for number, centroid in enumerate(centroids):
        away = ((vectors - centroid) ** 2).sum(axis=1)
        nearer = away < least
        best[nearer], least[nearer] = number, away[nearer]
    return best, least


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def _weighted_sum(vectors: np.ndarray, weights: np.ndarray) -> list[int]:
    """The exact sum of weights times vectors, by Python's integers where 64 bits might not hold it."""
    if int(np.abs(vectors).max()) * int(weights.sum(dtype=object)) >= 1 << 62:
        vectors, weights = vectors.astype(object), weights.astype(object)
    return [int(x) for x in weights @ vectors]


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round over ``distinct`` (v, n): floors of their vectors' means; empty ones stay."""
    dimensions = centroids.shape[1]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            vectors, weights = _matrix(batch["v"], dimensions), batch["n"].to_numpy()
            near, _ = nearest(vectors, centroids)
            for c in np.unique(near).tolist():
                own = near == c
                n, total = sums.get(c, (0, [0] * dimensions))
                added = _weighted_sum(vectors[own], weights[own])
                sums[c] = n + int(weights[own].sum()), [a + b for a, b in zip(total, added)]
        for c, (n, total) in sums.items():
            yield pa.RecordBatch.from_pydict(
                {"cluster": pa.array([c] * dimensions, pa.int32()), "d": pa.array(range(dimensions), pa.int32()), "n": [n] * dimensions, "x": pa.array(total, pa.decimal128(38))}
            )

    sums = distinct.mapInArrow(add_up, "cluster int, d int, n long, x decimal(38,0)")
    out = centroids.copy()
    # at most K times DIMENSIONS rows, whatever the input
    for r in sums.groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():
        out[r["cluster"], r["d"]] = int(r["x"]) // r["n"]
    return out


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``distinct`` (v, n) with cluster and distance."""
    dimensions = centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, away = nearest(_matrix(batch["v"], dimensions), centroids)
            yield pa.RecordBatch.from_arrays([batch["v"], batch["n"], pa.array(near), pa.array(away)], names=["v", "n", "cluster", "distance"])

    return distinct.mapInArrow(assign, "v array<int>, n long, cluster int, distance long")


def cluster(embeddings: DataFrame, dimensions: int = DIMENSIONS, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """One row for each kept row of ``embeddings``: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly ``dimensions`` components, none null, non-finite or of
    2**20 or more (whose squared distances 64 bits don't hold).  The first centroids are
    drawn by hash of vec_id, a null one as an empty text; fewer kept rows than ``k`` give
    as many centroids.  Ties go to the smaller cluster number.  Repeated rows count, and
    come out, as often as they are there.  Without a kept row the result is empty.  Sums
    of distances that 64 bits don't hold are null.  Other columns may have any names.
    """
    spark = embeddings.sparkSession
    rows = bounded_batches(embeddings).select("vec_id", quantised(F.col("embedding"), dimensions).alias("v")).where("v is not null")
    distinct = stored(rows.groupBy("v").agg(F.count("*").alias("n")), "centroids-distinct")
    centroids = first_centroids(rows, k).reshape(-1, dimensions)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(distinct, centroids)
    found = stored(assigned(distinct, centroids).where(F.lit(bool(len(centroids)))), "centroids-assigned")

    inertia = F.sum(F.col("distance").cast("decimal(38,0)") * F.col("n")).cast("decimal(38,0)")
    by_cluster = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(inertia.alias("s")).collect()}
    sums = [
        (c, str(by_cluster[c]), str(sum(by_cluster.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
        for c in sorted(by_cluster)
    ]
    told = spark.createDataFrame(sums, "cluster int, cluster_inertia string, inertia string, centroid_sha256 string")
    back = rows.join(found.drop("n"), "v").join(F.broadcast(told), "cluster")  # K rows
    return back.select(
        "vec_id", "cluster", "distance", F.col("cluster_inertia").try_cast("long").alias("cluster_inertia"), F.col("inertia").try_cast("long").alias("inertia"), "centroid_sha256"
    )
