"""Event journals: cursor reads, month groups, tombstones and compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import times
from parley.operators.offload import running_before

DAY_MS = 86_400_000
#: Tier: (days a segment must be old, the tier it is merged into).
TIERS = {"daily": (7, "weekly"), "weekly": (30, "monthly")}
LEAST_GROUP = 2
ARCHIVE_DELETES = ("message_deleted", "conversation_deleted")


def after_cursor(events: DataFrame, cursor: int, limit: int) -> DataFrame:
    """The next ``limit`` events, in order."""
    return events.where(F.col("event_seq") > cursor).orderBy("event_seq").limit(limit)


def advanced(cursor: int, to: int) -> int:
    """The new cursor; it never goes back."""
    if to < cursor:
        raise ValueError(f"the cursor can't go back from {cursor} to {to}")
    return to


def appended(events: DataFrame, arriving: DataFrame) -> DataFrame:
    """The ``arriving`` events as they are appended: event_seq goes on from the last of ``events``, by time, conversation and message."""
    last = events.agg(F.coalesce(F.max("event_seq"), F.lit(0)).alias("last_seq"))  # one row
    own = arriving.withColumn("place", F.concat_ws("|", *(F.lpad(F.coalesce(F.col(c).cast("string"), F.lit("")), 40, " ") for c in ("conversation_id", "message_id", "event_type"))))
    ahead = running_before(own.withColumn("order", -F.col("created_at_ms")).withColumn("one", F.lit(1)), "order", "place", "one", "ahead")
    return ahead.crossJoin(F.broadcast(last)).select((F.col("last_seq") + F.col("ahead") + 1).cast("long").alias("event_seq"), *arriving.columns)


def by_bucket(events: DataFrame, bucket: Column | None = None) -> DataFrame:
    """One row for each conversation and month: how many events, the first and last."""
    own = times.month_bucket(F.col("created_at_ms")) if bucket is None else bucket
    return (
        events.withColumn("time_bucket", own)
        .groupBy("conversation_id", "time_bucket")
        .agg(F.count("*").alias("n_events"), F.min("event_seq").alias("first_seq"), F.max("event_seq").alias("last_seq"))
    )


def segments(events: DataFrame) -> DataFrame:
    """One row for each conversation and month with its ``events``, in order, as a segment holds them."""
    own = [c for c in events.columns if c != "conversation_id"]
    grouped = events.withColumn("time_bucket", times.month_bucket(F.col("created_at_ms"))).groupBy("conversation_id", "time_bucket")
    return grouped.agg(F.sort_array(F.collect_list(F.struct("event_seq", *(c for c in own if c != "event_seq")))).alias("events"))


#: What kinds of segments there are; the first is the backup's, the others the archive's.
SEGMENT_TYPES = ("events", "message_delta", "timeline_skeleton", "media_key_delta", "search_text_index", "search_vector_index", "media_index", "checkpoint")


def segment_side(kind: Column) -> Column:
    """``backup`` or ``archive``; null if there is no such kind of segment."""
    return F.when(kind == SEGMENT_TYPES[0], "backup").when(kind.isin(*SEGMENT_TYPES[1:]), "archive")


#: The types of events in the archive's journal and in the backup's.
ARCHIVE_TYPES = ("message_received", "message_edited", "message_deleted", "media_received", "conversation_created", "conversation_deleted")
BACKUP_TYPES = (*ARCHIVE_TYPES, "media_deleted")


def parsed_type(name: Column, journal: str = "backup") -> Column:
    """An event type by its exact name in the archive's or the backup's journal; null for any other text."""
    return F.when(name.isin(*(ARCHIVE_TYPES if journal == "archive" else BACKUP_TYPES)), name)


def segment_map(uploaded: DataFrame, kind: str, backend: str) -> DataFrame:
    """The map's rows for ``uploaded`` segments (conversation_id, time_bucket, blob_id, ...): their content's hash, uploaded and not yet verified."""
    own = F.sha2(F.concat_ws("|", F.col("conversation_id").cast("string"), "time_bucket", "blob_id"), 256)
    return uploaded.select(
        own.alias("segment_id"), "conversation_id", "time_bucket", F.lit(kind).alias("segment_type"), "blob_id",
        F.lit(backend).alias("storage_backend"), F.lit("archive_uploaded").alias("state"),
    )


def latest_manifest(manifests: DataFrame) -> DataFrame:
    """The manifest of the last generation of each chain."""
    return manifests.groupBy("chain").agg(F.max_by(F.struct(*manifests.columns), "generation").alias("m")).select("m.*")


def ledger_replaced(ledger: DataFrame, entries: DataFrame) -> DataFrame:
    """The ledger with all rows of the chains in ``entries`` replaced by these."""
    return ledger.join(entries.select("chain").distinct(), "chain", "left_anti").unionByName(entries)


def ledger_appended(ledger: DataFrame, entries: DataFrame) -> DataFrame:
    """The ledger with those ``entries`` added whose (chain, segment_id) isn't there yet."""
    return ledger.unionByName(entries.dropDuplicates(["chain", "segment_id"]).join(ledger, ["chain", "segment_id"], "left_anti"))


def archive_survivors(events: DataFrame) -> DataFrame:
    """Events left when deletions take all else of their message or conversation with them, whatever the order."""
    gone = events.where(F.col("event_type").isin(*ARCHIVE_DELETES))
    messages = gone.where("event_type = 'message_deleted'").select("conversation_id", "message_id").distinct()
    conversations = gone.where("event_type = 'conversation_deleted'").select("conversation_id").distinct()
    return (
        events.where(~F.col("event_type").isin(*ARCHIVE_DELETES))
        .join(messages, ["conversation_id", "message_id"], "left_anti")
        .join(conversations, "conversation_id", "left_anti")
        .select(*events.columns)
    )


def backup_survivors(events: DataFrame) -> DataFrame:
    """Events left of a backup: message deletions take received, edited and media events,
    media deletions take media events alone, conversation deletions take all; deletions go."""
    kind = F.col("event_type")
    deletes = ("message_deleted", "media_deleted", "conversation_deleted")
    key = ["conversation_id", "message_id"]
    marks = (
        events.where(kind.isin("message_deleted", "media_deleted"))
        .groupBy(*key)
        .agg(F.bool_or(kind == "message_deleted").alias("deleted"), F.bool_or(kind == "media_deleted").alias("media_deleted"))
    )
    conversations = events.where(kind == "conversation_deleted").select("conversation_id").distinct()
    content = kind.isin("message_received", "message_edited", "media_received")
    gone = (F.coalesce("deleted", F.lit(False)) & content) | (F.coalesce("media_deleted", F.lit(False)) & (kind == "media_received"))
    return (
        events.where(~kind.isin(*deletes))
        .join(conversations, "conversation_id", "left_anti")
        .join(marks, key, "left")
        .where(~gone)
        .select(*events.columns)
    )


def latest(events: DataFrame, key: list[str], order: str = "event_seq") -> DataFrame:
    """The last event of each key."""
    return events.groupBy(*key).agg(F.max_by(F.struct(*events.columns), order).alias("e")).select("e.*")


def compaction_plan(segments: DataFrame, now_ms: int) -> DataFrame:
    """(tier, window_start_ms, into, n_segments, n_events): groups of old segments to merge.

    Daily segments merge by week once 7 days old, weekly ones by 30 days once 30 days old.
    """
    age = F.lit(now_ms) - F.col("max_event_ms")
    start = F.when(F.col("tier") == "daily", times.week_start_ms(F.col("min_event_ms"))).otherwise(times.thirty_day_start_ms(F.col("min_event_ms")))
    old, into = F.lit(False), F.lit(None).cast("string")
    for tier, (days, target) in TIERS.items():
        old = old | ((F.col("tier") == tier) & (age >= days * DAY_MS))
        into = F.when(F.col("tier") == tier, target).otherwise(into)
    return (
        segments.where(old)
        .groupBy("tier", start.alias("window_start_ms"), into.alias("into"))
        .agg(F.count("*").alias("n_segments"), F.sum("event_count").alias("n_events"), F.sort_array(F.collect_list("segment_id")).alias("segment_ids"))
        .where(F.col("n_segments") >= LEAST_GROUP)
    )


def superseded(plan: DataFrame) -> DataFrame:
    return plan.select(F.explode("segment_ids").alias("segment_id"))


def compaction_counters(before: DataFrame, after: DataFrame) -> DataFrame:
    """Events inspected, kept and dropped, segments (by conversation and month) before and after, as one row."""
    month = times.month_bucket(F.col("created_at_ms"))

    def counted(events: DataFrame, n: str, segments: str) -> DataFrame:
        by = events.groupBy("conversation_id", month.alias("month")).agg(F.count("*").alias("n"))
        return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(n), F.count("*").alias(segments))

    counts = counted(before, "inspected", "superseded").crossJoin(counted(after, "kept", "emitted"))  # one row each
    return counts.withColumn("dropped", F.col("inspected") - F.col("kept"))


def daily_segments(events: DataFrame) -> DataFrame:
    """A segment for each day with events: segment_id, tier, min_event_ms, max_event_ms, event_count."""
    day = F.floor(F.col("created_at_ms") / DAY_MS).cast("long")
    return events.groupBy(day.alias("segment_id")).agg(
        F.lit("daily").alias("tier"),
        F.min("created_at_ms").alias("min_event_ms"),
        F.max("created_at_ms").alias("max_event_ms"),
        F.count("*").alias("event_count"),
    )


def chained(manifests: DataFrame) -> DataFrame:
    """Manifests with ``hash`` of their own content and the hash of the one before, by generation."""
    before = Window.partitionBy("chain").orderBy("generation")
    own = manifests.withColumn("hash", F.sha2(F.concat_ws("|", F.col("generation").cast("string"), "content"), 256))
    return own.withColumn("previous_hash", F.lag("hash").over(before))


def chain_faults(manifests: DataFrame) -> DataFrame:
    """Manifests whose generation isn't the next one or whose previous_hash isn't the one before's hash."""
    before = Window.partitionBy("chain").orderBy("generation")
    seen = manifests.withColumn("was", F.lag("generation").over(before)).withColumn("was_hash", F.lag("hash").over(before))
    gap = F.col("generation") != F.col("was") + 1
    return seen.where(F.col("was").isNotNull() & (gap | ~F.col("previous_hash").eqNullSafe(F.col("was_hash")))).drop("was", "was_hash")
