"""Helpers that all training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.sources.shared import forget, shared_dir, shared_path, store, stored

__all__ = [
    "BATCH_ROWS", "bounded_batches", "give_back", "FOLDS", "HELD_OUT_FOLD", "drawn", "fold", "forget", "fresh", "held_out", "majority_labels", "numbered", "released", "shared_dir", "shared_path", "store", "stored", "table",
]

#: Rows of these folds are never learned from: crc32(doc_id as text) mod 3 is 1.
FOLDS, HELD_OUT_FOLD = 3, 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs`` with a row number, stored, so that the number is the same whenever it is read: (table, column).

    Only a plain scan of files numbers its rows alike each time without being stored;
    ``docs`` may be anything.
    """
    row = fresh(docs, "row")
    own = docs.withColumn(row, F.monotonically_increasing_id())
    return (own if _is_scan(docs) else stored(own, name)), row


def _is_scan(docs: DataFrame) -> bool:
    """Whether ``docs`` is files as they lie, whose partitions and order are the same each time."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() == "Project":
        plan = plan.child()
    return plan.nodeName() in ("LogicalRelation", "Relation", "DataSourceV2ScanRelation")


def fold(key: Column) -> Column:
    """The fold 0..FOLDS-1 of a row; rows without a key are in the fold of ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS


def held_out(key: Column) -> Column:
    return fold(key) == HELD_OUT_FOLD


#: Rows that a Python worker holds at once, at most.
BATCH_ROWS = 1_000


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``; its session's Arrow batches have at most BATCH_ROWS rows from now on.

    Texts and their sets can be long, and Spark's own 10,000 of them are held several
    times over in a worker and the executor beside it.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def give_back() -> None:
    """Hand the memory that a finished task freed back to the machine: its worker stays for later tasks, and beside the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def released(spark: SparkSession) -> None:
    """Let go of the plans and shuffle files of queries that ended and whose results are stored; Spark does so when its driver collects garbage."""
    for _ in range(2):  # the first tells the JVM what Python has let go of
        gc.collect()
        spark.sparkContext._jvm.System.gc()


#: Draws by hash are this fine.
_DRAWS = 1 << 62


def drawn(share: float, *keys: Column | str) -> Column:
    """Whether a row with these keys is in a sample of about ``share`` of all, at any size; at least one hash is."""
    return F.pmod(F.xxhash64(*keys), F.lit(_DRAWS)) < max(1, min(_DRAWS, int(share * _DRAWS)))


def majority_labels(labels: DataFrame, key: str, label: str) -> DataFrame:
    """One 0/1 label for each key: the majority of its rows, 1 on a tie; nulls count for nothing."""
    return (
        labels.select(F.col(key).alias("key"), F.col(label).cast("double").alias("label"))
        .where("key is not null and label is not null")
        .groupBy("key")
        .agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    )
