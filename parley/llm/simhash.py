"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits.  Bit i belongs to class ``1 + i % 7`` of three binary
digits, and table v (1 to 7) keeps the bits whose class has an odd product with v.
For any two bits some v drops both classes, so every pair within two bits agrees on
all that some table keeps and collides there, by construction and not by chance.

What collides is verified: in a bucket of few fingerprints each pair by its differing
bits, so a fingerprint meets a bounded number of others; in a fuller one without
listing pairs, at points one dropped bit away, which have at most 65 members.  So no
bucket needs a cap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, numbered, stored
from .components import components

BITS, RADIUS, SHINGLE, SEED = 64, 2, 3, 42
TABLES = (1 << (RADIUS + 1)) - 1
#: Buckets of at most so many fingerprints are verified pair by pair.
PAIRED = 32


def kept_bits(table: int) -> list[int]:
    """The bit positions that a table (1..TABLES) keeps."""
    return [i for i in range(BITS) if bin((1 + i % TABLES) & table).count("1") % 2]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprint(text: str) -> int:
    """The fingerprint of one text as a signed 64-bit number; 0 without words."""
    words = text.encode().lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - SHINGLE + 1
    if n <= 1:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of unsigned 64-bit ``hashes`` as a signed number: bits that over half of them have; 0 without any."""
    packed = hashes.astype(">u8").view("u1").reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(packed), 4096):
        ones += np.unpackbits(packed[at : at + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return _signed(int.from_bytes(np.packbits(2 * ones > len(packed)).tobytes(), "big"))


@F.arrow_udf(T.LongType())
def fingerprints(text: pa.Array) -> pa.Array:
    """The fingerprint of each text, a null one as an empty one."""
    return pa.array([fingerprint(t.as_py() or "") for t in text], pa.int64())


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that connect whatever fingerprints ``fp`` of ``distinct`` are within RADIUS bits.

    Rows for an input row: one for each table, and for each table in which it collides
    up to PAIRED pairs, or up to BITS + 1 points for all full buckets.
    """
    tables = F.explode(
        F.array(
            *(
                F.struct(F.lit(v).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << i for i in kept_bits(v))))).alias("key"))
                for v in range(1, TABLES + 1)
            )
        )
    )
    hashed = distinct.select("fp", tables.alias("at")).select("fp", "at.table", "at.key")
    # stored, so that Spark may split the join where very many share a key
    full = stored(hashed.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-buckets")
    collided = stored(hashed.join(full, ["table", "key"]), "simhash-collided")
    few = collided.where(F.col("n") <= PAIRED).drop("n")
    pairs = few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), ["table", "key"])
    verified = pairs.where((F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)).select("a", "b")
    return verified.unionByName(_met(collided.where(F.col("n") > PAIRED))).distinct()


def _met(collided: DataFrame) -> DataFrame:
    """Links among the members (table, fp) of large buckets, found without pairs.

    A member is sent to itself and to what it becomes if one bit that its tables drop is
    turned.  What meets at a point differs in at most RADIUS bits, and any two of a
    bucket that are within RADIUS meet at one; a point has at most BITS + 1 members.
    """
    dropped = F.lit(0).cast("long")
    for v in range(1, TABLES + 1):
        kept = set(kept_bits(v))
        dropped = F.when(F.col("table") == v, F.lit(_signed(sum(1 << i for i in range(BITS) if i not in kept)))).otherwise(dropped)
    free = collided.groupBy("fp").agg(F.bit_or(dropped).alias("free"))
    bits = F.array(*(F.lit(_signed(1 << i)) for i in range(BITS)))
    turns = F.concat(F.array(F.lit(0).cast("long")), F.filter(bits, lambda bit: bit.bitwiseAND(F.col("free")) != 0))
    points = free.select("fp", F.explode(turns).alias("turn")).select("fp", F.col("fp").bitwiseXOR(F.col("turn")).alias("point"))
    met = points.groupBy("point").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("members")).where(F.size("members") > 1)
    return met.select(F.explode("members").alias("a"), "b").where("a <> b")


def classes(marked: DataFrame) -> DataFrame:
    """(fp, component_id, kept_row) for every fingerprint of the stored table ``marked`` (row, doc_id, fp).

    component_id is the least doc_id reachable by links; kept_row is the row that has
    it, the first one of several, or the first row of a class without any doc_id.
    """
    head = F.min_by(F.struct("doc_id", "row"), F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row")))
    own = stored(marked.groupBy("fp").agg(head.alias("head")), "simhash-distinct")
    roots = stored(components(links(own.select("fp"))), "simhash-roots")
    joined = own.join(roots, own["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "head")
    order = F.struct(F.col("head.doc_id").isNull(), F.col("head.doc_id"), F.col("head.row"))
    heads = joined.groupBy("root").agg(F.min_by("head", order).alias("first"))
    return joined.join(heads, "root").select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("kept_row"))


def mark(docs: DataFrame) -> DataFrame:
    """A stored table (row, doc_id, fp) of ``docs``."""
    own, row = numbered(bounded_batches(docs), "simhash-rows")
    return _marked(own, row)


def _marked(own: DataFrame, row: str) -> DataFrame:
    return stored(own.select(F.col(row).alias("row"), "doc_id", fingerprints(F.col("text")).alias("fp")), "simhash")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (hexadecimal), component_id.

    Null and empty texts have fingerprint zero and link like any other; whole texts
    count, however long.  Repeated rows give a row each.  A null doc_id is never a
    component_id unless its whole class has none.  An empty table gives no rows; columns
    other than doc_id and text may have any names.
    """
    marked = mark(docs)
    found = marked.join(classes(marked), "fp")
    return found.select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one of each class stays: that of the least doc_id, the first of several."""
    own, row = numbered(bounded_batches(docs), "simhash-rows")
    kept = classes(_marked(own, row)).select("kept_row").distinct()
    return own.join(kept, own[row] == kept["kept_row"], "left_semi").drop(row)
