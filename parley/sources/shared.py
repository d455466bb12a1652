"""Tables for intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: By application: the temporary folder of one that names no shared folder, as in tests.
_temporary: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without one gets a temporary folder; a cluster's must be named.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = _temporary.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="parley-")
        _temporary[context.applicationId] = found
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session's JVM ends.

    It has a scheme, so that what isn't Spark resolves it as Spark does.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    at = files.makeQualified(at)
    files.deleteOnExit(at)
    return at.toString()


def modified(spark: SparkSession, path: str) -> tuple:
    """(name, length, time) of the files of a table as they are now."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files.listStatus(at)))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a path that :func:`shared_path` gave."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def store(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """Write ``df`` as a table in the shared folder, with the writer's ``options``, and read it back: (table, path).

    This cuts the lineage, and what was computed survives the loss of executors.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def released(spark: SparkSession) -> None:
    """Let go of the shuffle files of queries that ended and whose results are stored; Spark does so when its driver collects garbage."""
    for _ in range(2):  # the first tells the JVM what Python has let go of
        gc.collect()
        spark._jvm.System.gc()


@contextmanager
def pieces(spark: SparkSession, most: int) -> Iterator[None]:
    """Meanwhile files are read in pieces of ``most`` bytes at most, for rows that grow much once they are read."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    held = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)
    spark.conf.set(name, str(min(most, held)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    return store(df, name)[0]
