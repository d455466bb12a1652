"""The journal as a stream: incremental archiving, heads and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parley.functions import times
from parley.operators import analytics
from parley.sources import tables

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """The event files that arrive in ``path``, as they are."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(path)


def journal_stream(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """The journal of event files that arrive in ``path``; the query's checkpoint is the cursor."""
    return tables.journal_of(event_stream(spark, path, files_at_once))


def archive(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append events to month partitions; a batch that is run again replaces its own files."""

    def write(batch: DataFrame, epoch: int) -> None:
        own = batch.withColumn("time_bucket", times.month_bucket(F.col("created_at_ms"))).withColumn("batch", F.lit(epoch))
        own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "time_bucket").parquet(out)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def heads(events: DataFrame) -> DataFrame:
    """The newest received message of each conversation; late events never move it."""
    received = events.where("event_type = 'message_received'")
    return received.groupBy("conversation_id").agg(F.max_by("message_id", F.struct("created_at_ms", "event_seq")).alias("message_id"), F.max("created_at_ms").alias("created_at_ms"))


def counts_by_month(events: DataFrame) -> DataFrame:
    return events.groupBy(times.month_bucket(F.col("created_at_ms")).alias("time_bucket"), "event_type").count()


def to_table(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the changed rows of a streaming aggregate as the table ``path``, in a folder for each batch.

    Only rows that a batch changed are written, by the executors; a batch that is run
    again replaces its own.  :func:`latest` reads the result.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return changes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The whole result that :func:`to_table` keeps: the last version of each key's row."""
    kept = spark.read.parquet(path)
    columns = [c for c in kept.columns if c != "epoch"]
    return kept.groupBy(*keys).agg(F.max_by(F.struct(*columns), "epoch").alias("last")).select("last.*")


def dedup_counters(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep, for each batch of a stream of events (seq, kind, size_bytes, was_deduped), what it does to the counters.

    A batch's events count in order of seq, batches in order of arrival; a batch that is
    run again replaces its own rows.  :func:`counters` reads the result.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        analytics.counter_ranges(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counters(spark: SparkSession, path: str) -> DataFrame:
    """The counters after all batches that :func:`dedup_counters` keeps."""
    kept = spark.read.parquet(path)
    return analytics.counted(kept.withColumn("at", F.struct("epoch", "range")), "at")
