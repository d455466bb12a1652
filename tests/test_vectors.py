from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.functions import models
from parley.operators import search, vectors

VECTORS = "message_id long, model_version string, embedding array<float>"


@pytest.fixture(scope="module")
def stored(spark):
    rng = np.random.default_rng(0)
    middle = rng.normal(size=(12, 16))
    rows = [(k, f"v{k % 2}", (middle[k % 12] + 0.6 * rng.normal(size=16)).tolist()) for k in range(1500)]
    rows += [(5000, "v0", [0.0] * 16), (5001, "v0", rows[3][2]), (5002, "v0", rows[3][2])]
    return spark.createDataFrame(rows, VECTORS).persist(), rows


def brute(rows, k):
    ids = np.array([r[0] for r in rows])
    x = np.array([np.array(r[2], np.float32) for r in rows], float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    out = {}
    for at in np.flatnonzero(ids % 100 == 0):
        order = np.lexsort((ids, -np.round(x @ x[at], 12)))[:k]
        out[int(ids[at])] = ids[order].tolist()
    return out


@pytest.mark.parametrize("block", [4096, 100])
def test_exact_is_brute_force(stored, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    df, rows = stored
    found = vectors.exact(df, df.where("message_id % 100 = 0"), 5).orderBy("query", "rank").collect()
    got = {}
    for r in found:
        got.setdefault(r["query"], []).append(r["message_id"])
    want = brute(rows, 5)
    want.pop(5000), got.pop(5000)  # nothing is nearest to a zero vector
    assert got == want


def test_index_recall(stored):
    df, _ = stored
    asked = df.where("message_id % 100 = 0 and message_id < 5000")
    assert vectors.recall(vectors.indexed(df, asked, 10), vectors.exact(df, asked, 10)).first()["recall"] >= 0.9


def test_cells_and_full_cells(stored, monkeypatch):
    df, _ = stored
    asked = df.where("message_id % 100 = 0 and message_id < 5000")
    truth = vectors.exact(df, asked, 10)
    assert vectors.recall(vectors.indexed(df, asked, 10, cells=12, probes=4), truth).first()["recall"] >= 0.9
    monkeypatch.setattr(vectors, "BLOCK", 64)  # every cell is in several blocks
    one = vectors.indexed(df, asked, 10)
    assert vectors.recall(one, truth).first()["recall"] >= 0.95
    assert one.groupBy("query").count().where("count <> 10").count() == 0


def test_few_rows_are_searched_exactly(stored):
    df, _ = stored
    few = df.where("message_id < 900")
    asked = few.where("message_id % 100 = 0")
    both = [sorted((r.query, r.message_id) for r in f(few, asked, 7).collect()) for f in (vectors.indexed, vectors.exact)]
    assert both[0] == both[1]


def test_codes_without_structure(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(k, "v0", rng.normal(size=64).tolist()) for k in range(3000)], VECTORS).persist()
    asked = df.where("message_id % 100 = 0")
    assert vectors.recall(vectors.indexed(df, asked, 10), vectors.exact(df, asked, 10)).first()["recall"] >= 0.9
    assert vectors.share_read(3000, 64, 10) < 0.2
    df.unpersist()


def test_versions_and_lengths(spark, stored):
    df, rows = stored
    mixed = df.unionByName(spark.createDataFrame([(9, "v1", [1.0])], VECTORS))
    got = search.nearest(mixed, rows[7][2], 3, "v1").collect()
    assert got[0]["message_id"] == 7 and all(r["message_id"] % 2 for r in got) and len(got) == 3


def test_cache_hits_are_not_computed(spark):
    messages = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "message_id long, text string")
    cache = spark.createDataFrame([(1, "v1", [7.0]), (2, "v0", [8.0])], VECTORS)
    got = {r.message_id: r.embedding for r in models.embedded(messages, cache, "v1").collect()}
    assert got[1] == [7.0] and len(got[2]) == models.DIMENSIONS and got[3] is None
    assert np.linalg.norm(got[2]) == pytest.approx(1, abs=1e-5) and got[2] == pytest.approx(models.hashed_embedding("b"))


def test_page_blocks(spark):
    page = "<html><head><title>A &amp; B</title><script>var t='<p>';</script></head><body><p>one <b>two</b></p><!-- x --><div>three</div></body>"
    df = spark.createDataFrame([(page,), (None,), ("",)], "h string")
    assert [r[0] for r in df.select(models.html_pages(F.col("h"))).collect()] == [["A & B", "one two", "three"], None, []]
