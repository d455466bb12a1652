"""Journal queries: cursors, tombstones, compaction, restore, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import journal, restore
from parley.plans.registry import query
from parley.plans.sql import JOURNAL
from parley.plans.retention import COUNTERS_SQL, blob_events
from parley.sources import tables
from parley.sources.shared import shared_path
from parley.streaming import journal as streams

_NOW = 1_706_745_600_000  # 2024-02-01
_ALL = "event_seq, event_type, conversation_id, message_id, created_at_ms"

_ARCHIVE = """kept AS (
  SELECT * FROM journal j WHERE event_type NOT IN ('message_deleted', 'conversation_deleted')
  AND NOT EXISTS (SELECT 1 FROM journal t WHERE t.event_type = 'message_deleted' AND t.conversation_id = j.conversation_id AND t.message_id = j.message_id)
  AND NOT EXISTS (SELECT 1 FROM journal t WHERE t.event_type = 'conversation_deleted' AND t.conversation_id = j.conversation_id))"""
_BACKUP = """kept AS (
  SELECT * FROM journal j WHERE event_type NOT IN ('message_deleted', 'conversation_deleted')
  AND NOT (event_type IN ('message_received', 'message_edited', 'media_received')
    AND EXISTS (SELECT 1 FROM journal t WHERE t.event_type = 'message_deleted' AND t.conversation_id = j.conversation_id AND t.message_id = j.message_id))
  AND NOT EXISTS (SELECT 1 FROM journal t WHERE t.event_type = 'conversation_deleted' AND t.conversation_id = j.conversation_id))"""
_DAILY = """seg AS (
  SELECT created_at_ms // 86400000 AS segment_id, min(created_at_ms) AS lo, max(created_at_ms) AS hi, count(*) AS n FROM journal GROUP BY 1)"""


@query(f"WITH {JOURNAL} SELECT {_ALL} FROM journal WHERE event_seq > 500 ORDER BY event_seq LIMIT 200")
def journal_after_cursor(spark: SparkSession, d: str) -> DataFrame:
    return journal.after_cursor(tables.journal(spark, d), 500, 200).select(*_ALL.split(", "))


@query(
    f"WITH {JOURNAL} SELECT conversation_id, strftime(make_timestamp(created_at_ms * 1000), '%Y-%m') AS time_bucket, count(*) AS n_events, "
    "min(event_seq) AS first_seq, max(event_seq) AS last_seq FROM journal GROUP BY 1, 2"
)
def journal_buckets(spark: SparkSession, d: str) -> DataFrame:
    return journal.by_bucket(tables.journal(spark, d))


@query(f"WITH {JOURNAL}, {_ARCHIVE} SELECT {_ALL} FROM kept")
def tombstone_archive(spark: SparkSession, d: str) -> DataFrame:
    return journal.archive_survivors(tables.journal(spark, d)).select(*_ALL.split(", "))


@query(f"WITH {JOURNAL}, {_BACKUP} SELECT {_ALL} FROM kept")
def tombstone_backup(spark: SparkSession, d: str) -> DataFrame:
    return journal.backup_survivors(tables.journal(spark, d)).select(*_ALL.split(", "))


@query(
    f"""WITH {JOURNAL}, {_DAILY} SELECT 'daily' AS tier, (lo - 345600000) // 604800000 * 604800000 + 345600000 AS window_start_ms, 'weekly' AS into,
count(*) AS n_segments, CAST(sum(n) AS BIGINT) AS n_events FROM seg WHERE {_NOW} - hi >= 604800000 GROUP BY 2 HAVING count(*) >= 2"""
)
def compaction_plan(spark: SparkSession, d: str) -> DataFrame:
    return journal.compaction_plan(journal.daily_segments(tables.journal(spark, d)), _NOW).drop("segment_ids")


@query(
    f"""WITH {JOURNAL}, {_DAILY}, old AS (SELECT *, (lo - 345600000) // 604800000 AS week FROM seg WHERE {_NOW} - hi >= 604800000)
SELECT segment_id FROM old WHERE week IN (SELECT week FROM old GROUP BY week HAVING count(*) >= 2)"""
)
def superseded_segments(spark: SparkSession, d: str) -> DataFrame:
    return journal.superseded(journal.compaction_plan(journal.daily_segments(tables.journal(spark, d)), _NOW))


_GROUPS = "(SELECT count(*) FROM (SELECT DISTINCT conversation_id, strftime(make_timestamp(created_at_ms * 1000), '%Y-%m') FROM {}))"


@query(
    f"WITH {JOURNAL}, {_ARCHIVE} SELECT (SELECT count(*) FROM journal) AS inspected, (SELECT count(*) FROM kept) AS kept, (SELECT count(*) FROM journal) - (SELECT count(*) FROM kept) AS dropped, "
    f"{_GROUPS.format('journal')} AS superseded, {_GROUPS.format('kept')} AS emitted"
)
def compaction_counters(spark: SparkSession, d: str) -> DataFrame:
    events = tables.journal(spark, d)
    return journal.compaction_counters(events, journal.archive_survivors(events))


@query(
    f"""WITH {JOURNAL} SELECT conversation_id, message_id, arg_max(event_type, event_seq) AS event_type, max(event_seq) AS event_seq
FROM journal GROUP BY conversation_id, message_id"""
)
def journal_latest(spark: SparkSession, d: str) -> DataFrame:
    return journal.latest(tables.journal(spark, d), ["conversation_id", "message_id"]).select("conversation_id", "message_id", "event_type", "event_seq")


def _manifests(spark: SparkSession, d: str) -> DataFrame:
    segments = journal.daily_segments(tables.journal(spark, d))
    made = segments.select((F.col("segment_id") % 3).alias("chain"), F.floor(F.col("segment_id") / 3).alias("generation"), F.col("event_count").cast("string").alias("content"))
    return journal.chained(made)


@query(
    f"""WITH {JOURNAL}, {_DAILY}, own AS (SELECT segment_id % 3 AS chain, segment_id // 3 AS generation, sha256(concat_ws('|', segment_id // 3, n)) AS hash FROM seg)
SELECT chain, generation, hash, lag(hash) OVER (PARTITION BY chain ORDER BY generation) AS previous_hash FROM own"""
)
def manifest_chain(spark: SparkSession, d: str) -> DataFrame:
    return _manifests(spark, d).select("chain", "generation", "hash", "previous_hash")


@query(
    f"""WITH {JOURNAL}, {_DAILY}, own AS (SELECT segment_id % 3 AS chain, segment_id // 3 AS generation FROM seg),
kept AS (SELECT * FROM own WHERE generation % 4 <> 1), prev AS (SELECT *, lag(generation) OVER (PARTITION BY chain ORDER BY generation) AS was FROM kept)
SELECT chain, generation FROM prev WHERE was IS NOT NULL AND generation <> was + 1"""
)
def manifest_faults(spark: SparkSession, d: str) -> DataFrame:
    holes = _manifests(spark, d).where("generation % 4 <> 1")
    return journal.chain_faults(holes).select("chain", "generation")


_SKELETON = "skel AS (SELECT conversation_id, message_id, min(created_at_ms) AS created_at_ms FROM {} WHERE event_type = 'message_received' GROUP BY 1, 2)"


@query(f"WITH {JOURNAL}, {_SKELETON.format('journal')} SELECT *, 'remote_archive_only' AS body_state FROM skel")
def restore_skeletons(spark: SparkSession, d: str) -> DataFrame:
    return restore.skeletons(tables.journal(spark, d))


@query(f"WITH {JOURNAL}, {_SKELETON.format('journal')} SELECT *, 'local_plain_available' AS body_state FROM skel WHERE created_at_ms >= {_NOW - 10 * 86_400_000}")
def restore_recent(spark: SparkSession, d: str) -> DataFrame:
    return restore.recent(restore.skeletons(tables.journal(spark, d)), _NOW, 10 * 86_400_000)


@query(f"WITH {JOURNAL} SELECT DISTINCT conversation_id FROM journal")
def restore_conversations(spark: SparkSession, d: str) -> DataFrame:
    return restore.conversations(tables.journal(spark, d))


@query(
    f"WITH {JOURNAL}, {_BACKUP}, {_SKELETON.format('kept')} SELECT conversation_id, message_id, created_at_ms, "
    f"CASE WHEN created_at_ms >= {_NOW - 10 * 86_400_000} THEN 'local_plain_available' ELSE 'remote_archive_only' END AS body_state FROM skel"
)
def restore_full(spark: SparkSession, d: str) -> DataFrame:
    return restore.restored(tables.journal(spark, d), _NOW, 10 * 86_400_000)


@query(
    f"""WITH {JOURNAL} SELECT strftime(make_timestamp(created_at_ms * 1000), '%Y-%m') AS time_bucket, event_type, count(*) AS count FROM journal GROUP BY 1, 2"""
)
def stream_month_counts(spark: SparkSession, d: str) -> DataFrame:
    """The journal read as a stream of files, counted by month and type."""
    return _streamed(spark, d, streams.counts_by_month, ["time_bucket", "event_type"])


@query(
    f"""WITH {JOURNAL} SELECT conversation_id, arg_max(message_id, created_at_ms * 1000000 + event_seq) AS message_id, max(created_at_ms) AS created_at_ms
FROM journal WHERE event_type = 'message_received' GROUP BY conversation_id"""
)
def stream_heads(spark: SparkSession, d: str) -> DataFrame:
    return _streamed(spark, d, streams.heads, ["conversation_id"])


@query(COUNTERS_SQL)
def stream_dedup_counters(spark: SparkSession, d: str) -> DataFrame:
    """The deduplication counters of events read as a stream."""
    source = streams.event_stream(spark, f"{d}/events.parquet*", files_at_once=1)
    out = shared_path(spark, "stream")
    streams.dedup_counters(blob_events(source), f"{out}/table", f"{out}/cursor").awaitTermination()
    return streams.counters(spark, f"{out}/table")


def _streamed(spark: SparkSession, d: str, change, keys: list[str]) -> DataFrame:
    # a stream reads folders; the table is one file or a folder of them
    source = streams.event_stream(spark, f"{d}/events.parquet*")
    made = change(tables.journal_of(source))
    out = shared_path(spark, "stream")
    streams.to_table(made, f"{out}/table", f"{out}/cursor").awaitTermination()
    return streams.latest(spark, f"{out}/table", keys)
