"""Deduplication counters, latency percentiles and budget violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.sources.shared import stored


def dedup_stats(blobs: DataFrame, digest: str, size: str) -> DataFrame:
    """One row: objects and bytes, in all and unique, the ratio in percent and the savings."""
    unique = blobs.groupBy(digest).agg(F.count("*").alias("n"), F.max(size).alias("size"), F.sum(size).alias("bytes"))
    sums = unique.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_objects"),
        F.count("*").alias("unique_objects"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("total_bytes"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("unique_bytes"),
    )
    return sums.select(
        "*",
        dedup_ratio(F.col("total_objects"), F.col("unique_objects")).alias("ratio_percent"),
        F.greatest(F.col("total_objects") - F.col("unique_objects"), F.lit(0)).alias("objects_saved"),
        F.greatest(F.col("total_bytes") - F.col("unique_bytes"), F.lit(0)).alias("bytes_saved"),
    )


def dedup_ratio(total: Column, unique: Column) -> Column:
    """Percent of objects that repeat others, 0 to 100; 0 without any."""
    return F.when(total == 0, F.lit(0.0)).otherwise(F.greatest(F.least((1 - unique / total) * 100, F.lit(100.0)), F.lit(0.0)))


def counter_ranges(events: DataFrame) -> DataFrame:
    """(range, and by counter moved_ and lowest_): what the events (seq, kind, size_bytes, was_deduped) of each range of seq come to.

    A total never falls below zero, at any event, so a deletion of nothing doesn't eat a
    later upload.  What a range does to a total is told by its sum and its lowest running
    sum, and two ranges' by theirs; see :func:`counted`.
    """
    order = ["seq", "kind", "size_bytes"]
    placed = stored(events.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "counter-ranges")
    running = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    up, new = F.col("kind") == "uploaded", (F.col("kind") == "uploaded") & ~F.col("was_deduped")
    sign = F.when(up, 1).when(F.col("kind") == "deleted", -1).otherwise(0)
    moved = placed.select("*", sign.cast("long").alias("o"), (sign * F.col("size_bytes")).cast("long").alias("b"))
    summed = moved.select("range", "o", "b", new.alias("new"), "size_bytes", F.sum("o").over(running).alias("ro"), F.sum("b").over(running).alias("rb"))
    return summed.groupBy("range").agg(
        F.sum("o").alias("moved_objects"),
        F.min("ro").alias("lowest_objects"),
        F.sum("b").alias("moved_bytes"),
        F.min("rb").alias("lowest_bytes"),
        F.sum(F.when(F.col("new"), 1).otherwise(0)).alias("unique_objects"),
        F.sum(F.when(F.col("new"), F.col("size_bytes")).otherwise(0)).alias("unique_bytes"),
    )


def counted(ranges: DataFrame, order: str = "range") -> DataFrame:
    """One row of counters out of the rows of :func:`counter_ranges` in their order: some hundreds, whatever the events."""
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    names = ("objects", "bytes")
    lowest = ranges.select("*", *((F.coalesce(F.sum(f"moved_{c}").over(before), F.lit(0)) + F.col(f"lowest_{c}")).alias(f"least_{c}") for c in names))
    zero = F.lit(0).cast("long")
    total = {c: F.coalesce(F.sum(f"moved_{c}") - F.least(F.min(f"least_{c}"), zero), zero).alias(f"total_{c}") for c in names}
    unique = {c: F.coalesce(F.sum(f"unique_{c}"), zero).alias(f"unique_{c}") for c in names}
    return lowest.agg(total["objects"], unique["objects"], total["bytes"], unique["bytes"])


def running_counters(events: DataFrame) -> DataFrame:
    """One row of counters of (seq, kind, size_bytes, was_deduped) in order of seq: deletions lower totals, to zero at most, never unique counts."""
    return counted(counter_ranges(events))


def recent_ring(events: DataFrame, size: int = 512) -> DataFrame:
    """The last ``size`` events by seq."""
    return events.orderBy(F.desc("seq")).limit(size)


def percentiles(traces: DataFrame) -> DataFrame:
    """Nearest-rank p50, p95 and p99, maximum, total and count by operation."""
    rank = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY duration)").alias(f"p{round(p * 100)}") for p in (0.5, 0.95, 0.99)]
    return traces.groupBy("operation").agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("duration").cast("decimal(18,4)")), 4).cast("double").alias("total"), F.max("duration").alias("longest"), *rank
    )


def violations(summaries: DataFrame, budgets: DataFrame) -> DataFrame:
    """Operations whose p95 is above their budget (operation, budget)."""
    return summaries.join(F.broadcast(budgets), "operation").where(F.col("p95") > F.col("budget")).select("operation", "p95", "budget")
