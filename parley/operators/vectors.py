"""Vector search for many queries at once: exact, in blocks, and by an index of short codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import numbers

#: Vectors of a block; a task holds one block of queries and one of rows.
BLOCK = 4_096
#: Centroids that a task keeps, at most.
MOST_CELLS = 4_096
#: At most about so many vectors train the index's centroids.
SAMPLE = 20_000
#: Fewer rows than this are searched exactly; so many times as many as asked for are compared exactly.
EXACT_BELOW, WIDER = 1_000, 6

_PAIRS = "query long, message_id long, similarity double"


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _best(queries: np.ndarray, names: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """The k most similar rows of a block for each query, ties by the smaller id."""
    order = np.argsort(ids, kind="stable")
    similar = queries @ rows[order].T
    top = np.argsort(-similar, axis=1, kind="stable")[:, :k]
    return pd.DataFrame(
        {"query": np.repeat(names, top.shape[1]), "message_id": ids[order][top].ravel(), "similarity": np.take_along_axis(similar, top, 1).ravel()}
    )


def _merged(found: DataFrame, k: int) -> DataFrame:
    own = Window.partitionBy("query").orderBy(F.desc("similarity"), "message_id")
    return found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def _blocks(vectors: DataFrame, n: int, name: str) -> DataFrame:
    """One row for each of ``n`` blocks: its ids and vectors."""
    block = F.pmod(F.xxhash64("message_id"), F.lit(n)).alias(name)
    return vectors.groupBy(block).agg(F.collect_list(F.struct("message_id", "embedding")).alias(f"{name}_rows"))


def exact(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, message_id, similarity, rank): the k nearest rows of each query, over all rows.

    Every block of queries meets every block of rows, each pair in a task of its own
    with bounded memory; only k results a query and block pair leave it.
    """
    n, q = vectors.count(), queries.count()
    rows, asked = _blocks(vectors, max(1, -(-n // BLOCK)), "block"), _blocks(queries, max(1, -(-q // BLOCK)), "asked")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in zip(batch["asked_rows"], batch["block_rows"]):
                names, ids = (np.array([r["message_id"] for r in x], np.int64) for x in (a, b))
                yield _best(_unit([r["embedding"] for r in a]), names, _unit([r["embedding"] for r in b]), ids, k)

    pairs = asked.crossJoin(rows).repartition(max(1, -(-n // BLOCK) * -(-q // BLOCK)), "asked", "block")
    return _merged(pairs.select("asked_rows", "block_rows").mapInPandas(search, _PAIRS), k)


def centroids(vectors: DataFrame, n: int, rounds: int = 10) -> np.ndarray:
    """``n`` unit centroids of a bounded sample, by Lloyd's steps."""
    share = min(1.0, SAMPLE / max(1, vectors.count()))
    drawn = vectors.where(F.pmod(F.xxhash64("message_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy("message_id")
    x = _unit([r["embedding"] for r in drawn.select("embedding").collect()])
    at = x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)]
    for _ in range(rounds):
        nearest = (x @ at.T).argmax(axis=1)
        at = np.stack([x[nearest == c].mean(axis=0) if (nearest == c).any() else at[c] for c in range(len(at))])
        at /= np.maximum(np.linalg.norm(at, axis=1, keepdims=True), 1e-12)
    return at


def _assigned(vectors: DataFrame, at: np.ndarray, n: int) -> DataFrame:
    """``vectors`` (message_id, embedding) with a row for each of the ``n`` cells nearest to it."""
    sent = vectors.sparkSession.sparkContext.broadcast(at)  # cells by dimensions

    def cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                near = np.argsort(-(_unit(batch["embedding"].tolist()) @ sent.value.T), axis=1, kind="stable")[:, :n]
                yield pd.DataFrame({"message_id": batch["message_id"].repeat(near.shape[1]), "cell": near.ravel().astype(np.int32), "embedding": batch["embedding"].repeat(near.shape[1])})

    return vectors.select("message_id", "embedding").mapInPandas(cell, "message_id long, cell int, embedding array<float>")


def coded(vectors: DataFrame, at: np.ndarray | None = None) -> DataFrame:
    """The index of ``vectors``: (cell, message_id, code), half a byte for each component and four for a scale.

    Without centroids ``at`` there is one cell.
    """
    placed = vectors.withColumn("cell", F.lit(0)) if at is None else _assigned(vectors, at, 1)
    return placed.select("cell", "message_id", numbers.encode_int4(numbers.l2_normalize(F.col("embedding"))).alias("code"))


def _decoded(codes: list[bytes], dimensions: int) -> np.ndarray:
    """The vectors of codes of one length: each half byte is looked up in a table of its sixteen values."""
    rows = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    table = np.array([*range(8), *range(-8, 0)], np.float32)
    packed = rows[:, 4:]
    values = np.stack((table[packed & 15], table[packed >> 4]), axis=2).reshape(len(rows), -1)[:, :dimensions]
    return values * rows[:, :4].copy().view("<f4")


def short_lists(codes: DataFrame, queries: DataFrame, n: int, at: np.ndarray | None = None, probes: int | None = None) -> DataFrame:
    """(query, message_id, similarity, rank): the ``n`` rows of each query that are nearest by their codes.

    Rows of a cell are dealt to blocks by the cell's own count, queries by theirs, so a
    task holds a block of each however full a cell is.  Only codes are read, an eighth of
    the vectors' bytes and a little.
    """
    asked = queries.select("message_id", F.lit(0).alias("cell"), "embedding") if at is None else _assigned(queries, at, probes or len(at))

    def blocks(rows: DataFrame, value: str, name: str) -> DataFrame:
        counts = rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("salts"))
        salted = rows.join(F.broadcast(counts), "cell")  # a row for each cell, MOST_CELLS at most
        return salted.groupBy("cell", F.pmod(F.xxhash64("message_id"), F.col("salts")).alias(name)).agg(F.collect_list(F.struct("message_id", value)).alias(f"{name}_rows"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in zip(batch["asked_rows"], batch["block_rows"]):
                names, ids = (np.array([r["message_id"] for r in x], np.int64) for x in (a, b))
                own = _unit([r["embedding"] for r in a])
                yield _best(own, names, _decoded([r["code"] for r in b], own.shape[1]).astype(np.float64), ids, n)

    pairs = blocks(asked, "embedding", "asked").join(blocks(codes, "code", "block"), "cell")
    return _merged(pairs.select("asked_rows", "block_rows").mapInPandas(search, _PAIRS), n)


def indexed(vectors: DataFrame, queries: DataFrame, k: int, cells: int = 1, probes: int | None = None, codes: DataFrame | None = None) -> DataFrame:
    """(query, message_id, similarity, rank) like :func:`exact`, by codes and a short list; exact below EXACT_BELOW rows.

    All rows are indexed; ``codes`` is a stored :func:`coded` table, which without one is
    made.  A query's WIDER times ``k`` nearest rows by their codes are compared exactly.
    With ``cells`` a query looks only into its ``probes`` nearest ones, which saves more
    if the vectors have structure.
    """
    if vectors.limit(EXACT_BELOW).count() < EXACT_BELOW:
        return exact(vectors, queries, k)
    at = centroids(vectors, min(cells, MOST_CELLS)) if cells > 1 else None
    listed = short_lists(codes if codes is not None else coded(vectors, at), queries, WIDER * k, at, probes).select("query", "message_id")
    asked = queries.select(F.col("message_id").alias("query"), F.col("embedding").alias("asked"))
    near = listed.join(vectors.select("message_id", "embedding"), "message_id").join(asked, "query")
    return _merged(near.select("query", "message_id", numbers.cosine(F.col("asked"), F.col("embedding")).alias("similarity")), k)


def share_read(n: int, dimensions: int, k: int) -> float:
    """What a query reads by the index, as a share of all vectors' bytes: codes of ``n`` rows and a short list's vectors."""
    whole = 4 * dimensions
    return (n * (4 + -(-dimensions // 2)) + min(n, WIDER * k) * whole) / (n * whole)


def recall(approximate: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: the share of true results that the approximate ones have."""
    both = truth.select("query", "message_id").join(approximate.select("query", "message_id", F.lit(1).alias("hit")), ["query", "message_id"], "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"), F.count("*").alias("n"))
