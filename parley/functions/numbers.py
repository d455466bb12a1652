"""Column functions over sizes and vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KIB, MIB, GIB = 1 << 10, 1 << 20, 1 << 30
CHUNK = 16 * MIB
#: Padded sizes up to 1 GiB, each four times the one before.
SIZE_CLASSES = [KIB, 4 * KIB, 16 * KIB, 64 * KIB, 256 * KIB, MIB, 4 * MIB, 16 * MIB, 64 * MIB, 256 * MIB, GIB]


def size_class(size: Column) -> Column:
    """The least class that holds ``size`` and its 8-byte length; beyond the last, the next power of two."""
    need = size + 8
    found = F.pow(F.lit(2.0), F.ceil(F.log2(need.cast("double")))).cast("long")
    for limit in reversed(SIZE_CLASSES):
        found = F.when(need <= limit, F.lit(limit).cast("long")).otherwise(found)
    return found


def chunk_count(size: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(size / CHUNK)).cast("long")


def padding_count(real: Column) -> Column:
    return F.least(real * 2, F.lit(32))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 if either norm is below 1e-12; null if the lengths differ."""
    size = norm(a) * norm(b)
    value = F.when((norm(a) < 1e-12) | (norm(b) < 1e-12), F.lit(0.0)).otherwise(dot(a, b) / size)
    return F.when(F.size(a) == F.size(b), value)


def l2_normalize(a: Column) -> Column:
    return F.when(norm(a) < 1e-12, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / norm(a)))


def _round_away(x: Column) -> Column:
    """Halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def int8_scale(a: Column) -> Column:
    return F.array_max(F.transform(a, lambda x: F.abs(x.cast("double")))) / 127


def int8_codes(a: Column) -> Column:
    scale = int8_scale(a)
    code = F.transform(a, lambda x: F.greatest(F.least(_round_away(x.cast("double") / scale), F.lit(127.0)), F.lit(-127.0)).cast("int"))
    return F.when(scale > 0, code).otherwise(F.transform(a, lambda x: F.lit(0)))


def int8_decode(codes: Column, scale: Column) -> Column:
    return F.transform(codes, lambda c: c * scale)


@F.arrow_udf(T.BinaryType())
def encode_int4(vectors: pa.Array) -> pa.Array:
    """A little-endian float32 scale (largest magnitude / 7), then two codes a byte, the first in the low half."""

    def encode(values: list[float] | None) -> bytes | None:
        if values is None:
            return None
        v = np.array(values, np.float32)
        scale = np.float32(np.abs(v).max(initial=0) / 7)
        codes = np.zeros(len(v), np.int64) if scale == 0 else np.clip(np.sign(v) * np.floor(np.abs(v / scale) + 0.5), -7, 7).astype(np.int64)
        nibbles = np.append(codes, np.zeros(len(codes) % 2, np.int64)) & 15
        return np.array([scale], "<f4").tobytes() + (nibbles[::2] | nibbles[1::2] << 4).astype(np.uint8).tobytes()

    return pa.array([encode(v) for v in vectors.to_pylist()], pa.binary())


@F.arrow_udf(T.ArrayType(T.FloatType()))
def decode_int4(blobs: pa.Array) -> pa.Array:
    """The vector of an :func:`encode_int4` blob; a vector of odd length ends with a zero."""

    def decode(blob: bytes | None) -> list[float] | None:
        if blob is None:
            return None
        scale = np.frombuffer(blob[:4], "<f4")[0]
        packed = np.frombuffer(blob[4:], np.uint8).astype(np.int64)
        nibbles = np.stack([packed & 15, packed >> 4], axis=1).ravel()
        return (np.where(nibbles > 7, nibbles - 16, nibbles) * scale).astype(np.float32).tolist()

    return pa.array([decode(b) for b in blobs.to_pylist()], pa.list_(pa.float32()))
