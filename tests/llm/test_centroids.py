from __future__ import annotations

import hashlib
import math
import random

import pytest

from parley.llm import centroids

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k, dimensions, rounds):
    kept = []
    for vec_id, e in rows:
        if e is not None and len(e) == dimensions and all(x is not None and math.isfinite(x) and abs(x) < 1 << 20 for x in e):
            kept.append((vec_id, [math.floor(64 * x) for x in e]))
    drawn = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    own = [list(v) for _, v in drawn[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(own))

    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(own)):
            mine = [v for (_, v), c in zip(kept, at) if c == j]
            if mine:
                own[j] = [sum(x) // len(mine) for x in zip(*mine)]
    at = [near(v) for _, v in kept]
    of = [sum(d for d, c in at if c == j) for j in range(len(own))]
    return sorted(
        ((i, c, d, of[c], sum(of), hashlib.sha256(",".join(map(str, own[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, at)), key=str
    )


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("k,rounds", [(5, 3), (1, 2), (40, 1)])
def test_clusters_are_what_brute_force_says(spark, k, rounds):
    rng = random.Random(k)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(4)]) for i in range(60)]
    rows += [(100 + i, [0.5, -0.25, 1.0, 0.0]) for i in range(120)]  # more than half of all rows are one vector
    rows += [(7, [1.0, 1.0, 1.0, 1.0]), (7, [1.0, 1.0, 1.0, 1.0]), (7, [-1.0, 1.0, 1.0, 1.0])]  # a repeated row and a repeated id
    got = found(centroids.cluster(spark.createDataFrame(rows, SCHEMA), 4, k, rounds))
    assert got == brute(rows, k, 4, rounds)


def test_what_is_not_kept(spark):
    rows = [
        (1, [0.1, 0.2]),
        (2, None),
        (3, []),
        (4, [1.0]),
        (5, [1.0, None]),
        (6, [1.0, float("nan")]),
        (7, [float("inf"), 0.0]),
        (8, [1e30, 0.0]),
        (None, [-1000000.5, 1000000.25]),
        (9, [0.1, 0.2, 0.3]),
    ]
    df = spark.createDataFrame([(i, e, 1) for i, e in rows], SCHEMA + ", v int").selectExpr("*", "1 as n", "2 as cluster")
    assert found(centroids.cluster(df, 2)) == brute(rows, 16, 2, 3)
    assert {r[0] for r in found(centroids.cluster(df, 2))} == {1, None}


def test_no_kept_vector_has_no_cluster(spark):
    assert not centroids.cluster(spark.createDataFrame([(1, [1.0])], SCHEMA)).collect()
    assert not centroids.cluster(spark.createDataFrame([], SCHEMA)).collect()


def test_sums_are_exact_beyond_64_bits():
    import numpy as np

    vectors, weights = np.array([[1 << 26, -3], [-1, 5]]), np.array([1 << 40, 7])
    assert centroids._weighted_sum(vectors, weights) == [(1 << 66) - 7, -3 * (1 << 40) + 35]
