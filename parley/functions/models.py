"""Model seams: what a host would install as embedders and extractors, with test doubles."""

from __future__ import annotations

import hashlib
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 384


def hashed_embedding(text: str, dimensions: int = DIMENSIONS) -> list[float]:
    """A deterministic unit vector, seeded by the text's digest."""
    seed = int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "little")
    v = np.random.default_rng(seed).standard_normal(dimensions)
    return (v / np.linalg.norm(v)).astype(np.float32).tolist()


@F.arrow_udf(T.ArrayType(T.FloatType()))
def mock_embedder(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else hashed_embedding(t) for t in text.to_pylist()], pa.list_(pa.float32()))


def embedded(messages: DataFrame, cache: DataFrame, version: str, embedder=mock_embedder) -> DataFrame:
    """(message_id, model_version, embedding): cached vectors of this version, others computed."""
    own = cache.where(F.col("model_version") == version).select("message_id", F.col("embedding").alias("cached"))
    joined = messages.select("message_id", "text").join(own, "message_id", "left")
    missing = embedder(F.when(F.col("cached").isNull(), F.col("text")))
    return joined.select("message_id", F.lit(version).alias("model_version"), F.coalesce("cached", missing).alias("embedding"))


_DROPPED = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->")
_BREAK = re.compile(r"(?i)</?(?:p|div|li|h[1-6]|tr|section|article|nav|br|title)\b[^>]*>")


@F.arrow_udf(T.ArrayType(T.StringType()))
def html_pages(source: pa.Array) -> pa.Array:
    """The text blocks of each document; explode them for one row a block."""

    def blocks(text: str | None) -> list[str] | None:
        if text is None:
            return None
        plain = re.sub(r"<[^>]*>", " ", _BREAK.sub("\n", _DROPPED.sub(" ", text)))
        lines = (" ".join(html.unescape(line).split()) for line in plain.split("\n"))
        return [line for line in lines if line]

    return pa.array([blocks(t) for t in source.to_pylist()], pa.list_(pa.string()))


def quantization(free_bytes: Column) -> Column:
    """int4 below 512 MiB of free storage, else int8."""
    return F.when(free_bytes < 512 * 1024 * 1024, "int4").otherwise("int8")


def may_warm(battery_percent: Column, charging: Column, thermal: Column, unmetered: Column) -> Column:
    """Whether a device may warm caches: powered, cool and on an unmetered network."""
    return (charging | (battery_percent >= 50)) & thermal.isin("nominal", "fair") & unmetered


def media_route(kind: Column, sink: Column) -> Column:
    """Thumbnails and media without a sink of their own go to the primary one."""
    return F.when((kind == "thumbnail") | sink.isNull() | (sink == ""), "primary_backend").otherwise(sink)
