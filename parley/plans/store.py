"""Store queries: timelines, ingest, edits, deletions, life cycles, queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import numbers, text
from parley.operators import store
from parley.plans.registry import query
from parley.plans.sql import CONV, MSG
from parley.sources import tables

_T0 = 1_704_067_200_000


@query(
    f"WITH {MSG} SELECT message_id, sender_id, created_at_ms, text FROM msg WHERE conversation_id = 7 AND created_at_ms < {_T0 + 7 * 86_400_000 + 240_000} "
    "ORDER BY created_at_ms DESC, message_id LIMIT 3"
)
def timeline_page(spark: SparkSession, d: str) -> DataFrame:
    page = store.timeline(tables.messages(spark, d), 7, _T0 + 7 * 86_400_000 + 240_000, 3)
    return page.select("message_id", "sender_id", "created_at_ms", "text")


@query(f"WITH {MSG}, {CONV} SELECT conversation_id, pinned, scope, tenant_id, last_activity_ms, last_message_id FROM conv")
def conversation_list(spark: SparkSession, d: str) -> DataFrame:
    listed = store.conversation_list(tables.conversations(spark, d))
    return listed.select("conversation_id", "pinned", "scope", "tenant_id", "last_activity_ms", "last_message_id")


@query(f"WITH {MSG} SELECT message_id, kind, body_state, text FROM msg WHERE message_id = 7001")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return tables.messages(spark, d).where("message_id = 7001").select("message_id", "kind", "body_state", "text")


@query(
    f"""WITH {MSG}, arriving AS (
  SELECT message_id, CASE WHEN message_id % 11 = 0 THEN '' ELSE sender_id END AS sender_id FROM msg),
old AS (SELECT message_id FROM msg WHERE conversation_id % 2 = 0)
SELECT count(DISTINCT CASE WHEN sender_id <> '' AND message_id NOT IN (SELECT message_id FROM old) THEN message_id END) AS new,
       count(CASE WHEN sender_id <> '' AND message_id IN (SELECT message_id FROM old) THEN 1 END) AS duplicate,
       count(CASE WHEN sender_id = '' THEN 1 END) AS rejected FROM arriving"""
)
def ingest_report(spark: SparkSession, d: str) -> DataFrame:
    messages = tables.messages(spark, d)
    arriving = messages.withColumn("sender_id", F.when(F.col("message_id") % 11 == 0, "").otherwise(F.col("sender_id")))
    return store.ingest_report(messages.where("conversation_id % 2 = 0"), arriving)


@query(f"WITH {MSG} SELECT message_id, conversation_id FROM msg WHERE conversation_id % 2 = 1 AND message_id % 11 <> 0")
def ingest_new(spark: SparkSession, d: str) -> DataFrame:
    messages = tables.messages(spark, d)
    arriving = messages.withColumn("sender_id", F.when(F.col("message_id") % 11 == 0, "").otherwise(F.col("sender_id")))
    fresh = store.ingested(messages.where("conversation_id % 2 = 0"), arriving.unionByName(arriving))
    return fresh.select("message_id", "conversation_id")


@query(
    f"WITH {MSG} SELECT message_id, CASE WHEN message_id % 3 = 0 THEN 'edited twice' ELSE text END AS text, "
    "CASE WHEN message_id % 3 = 0 THEN created_at_ms + 2000 ELSE 0 END AS edited_at_ms FROM msg"
)
def edit_latest(spark: SparkSession, d: str) -> DataFrame:
    messages = tables.messages(spark, d)
    some = messages.where("message_id % 3 = 0")
    once, twice = (
        some.select("message_id", F.lit(t).alias("new_text"), (F.col("created_at_ms") + 1000 * k).alias("edited_at_ms"), F.lit(k).alias("seq"))
        for k, t in ((1, "edited once"), (2, "edited twice"))
    )
    return store.edited(messages, twice.unionByName(once)).select("message_id", "text", F.coalesce("edited_at_ms", F.lit(0)).alias("edited_at_ms"))


@query(
    f"""WITH {MSG}, gone AS (SELECT message_id FROM msg WHERE conversation_id = 4)
SELECT 'messages' AS part, count(*) AS n FROM msg WHERE conversation_id <> 4
UNION ALL SELECT 'vectors', count(*) FROM embeddings WHERE vec_id * 1000 NOT IN (SELECT message_id FROM gone)
UNION ALL SELECT 'conversations', count(DISTINCT conversation_id) FROM msg WHERE conversation_id <> 4"""
)
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    vectors = tables.vectors(spark, d).withColumn("message_id", F.col("message_id") * 1000)
    left = store.cascade({"messages": tables.messages(spark, d), "vectors": vectors, "conversations": tables.conversations(spark, d)}, 4)
    counts = [df.agg(F.lit(name).alias("part"), F.count("*").alias("n")) for name, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(
    f"""WITH {MSG}, {CONV}, late AS (
  SELECT conversation_id, message_id + 500 AS m, created_at_ms + CASE WHEN conversation_id % 2 = 0 THEN 86400000 ELSE -86400000 END AS moved_at
  FROM msg WHERE message_id % 1000 = 0)
SELECT conversation_id, CASE WHEN moved_at >= last_activity_ms THEN m ELSE last_message_id END AS last_message_id,
       CASE WHEN moved_at >= last_activity_ms THEN moved_at ELSE last_activity_ms END AS last_activity_ms
FROM conv LEFT JOIN late USING (conversation_id)"""
)
def late_head_update(spark: SparkSession, d: str) -> DataFrame:
    shift = F.when(F.col("conversation_id") % 2 == 0, 86_400_000).otherwise(-86_400_000)
    late = tables.messages(spark, d).where("message_id % 1000 = 0")
    events = late.select("conversation_id", (F.col("message_id") + 500).alias("message_id"), (F.col("created_at_ms") + shift).alias("created_at_ms"))
    return store.heads(tables.conversations(spark, d), events).select("conversation_id", "last_message_id", "last_activity_ms")


@query(
    f"""WITH {MSG} SELECT message_id, CASE WHEN came THEN 'fetched' ELSE text END AS text, CASE WHEN came THEN 'local_plain_available' ELSE body_state END AS body_state FROM (
  SELECT *, conversation_id % 2 = 0 AND body_state IN ('remote_archive_only', 'delivery_store_only') AS came FROM (
    SELECT message_id, conversation_id, text, CASE WHEN message_id % 7 = 0 THEN 'deleted_for_everyone' WHEN message_id % 5 = 0 THEN 'unavailable' ELSE body_state END AS body_state FROM msg))"""
)
def rehydrate(spark: SparkSession, d: str) -> DataFrame:
    """Bodies fetched for half of all conversations, and for ids that aren't there: deleted, unavailable and local ones stay."""
    m = F.col("message_id")
    state = F.when(m % 7 == 0, "deleted_for_everyone").when(m % 5 == 0, "unavailable").otherwise(F.col("body_state"))
    messages = tables.messages(spark, d).withColumn("body_state", state)
    known = messages.where("conversation_id % 2 = 0").select("message_id", F.lit("fetched").alias("text"))
    fetched = known.unionByName(known.withColumn("message_id", -1 - m)).unionByName(known)
    return store.rehydrated(messages.select("message_id", "text", "body_state"), fetched)


_REQUESTS = """req AS (
  SELECT message_id, CASE message_id % 5 WHEN 0 THEN 'opportunistic_fill' WHEN 1 THEN 'visible_viewport' WHEN 2 THEN 'media_full_screen' WHEN 3 THEN 'background_restore' ELSE 'adjacent_prefetch' END AS reason, created_at_ms AS asked_at FROM msg
  UNION ALL SELECT message_id, 'search_result_tap', created_at_ms + 5 FROM msg WHERE message_id % 3 = 0),
urgent AS (SELECT *, CASE reason WHEN 'search_result_tap' THEN 0 WHEN 'media_full_screen' THEN 1 WHEN 'visible_viewport' THEN 2 WHEN 'adjacent_prefetch' THEN 3 WHEN 'background_restore' THEN 4 ELSE 5 END AS urgency FROM req),
best AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY urgency, asked_at) AS nth FROM urgent)"""


@query(f"WITH {MSG}, {_REQUESTS} SELECT message_id, reason, asked_at AS requested_at_ms FROM best WHERE nth = 1")
def hydration_queue(spark: SparkSession, d: str) -> DataFrame:
    m = tables.messages(spark, d)
    named = ("opportunistic_fill", "visible_viewport", "media_full_screen", "background_restore", "adjacent_prefetch")
    reason = F.element_at(F.array(*map(F.lit, named)), (F.col("message_id") % 5 + 1).cast("int"))
    first = m.select("message_id", reason.alias("reason"), F.col("created_at_ms").alias("requested_at_ms"))
    second = m.where("message_id % 3 = 0").select("message_id", F.lit("search_result_tap").alias("reason"), (F.col("created_at_ms") + 5).alias("requested_at_ms"))
    return store.hydration_queue(first.unionByName(second)).select("message_id", "reason", "requested_at_ms")


_CLASS = "CASE " + " ".join(f"WHEN need <= {n} THEN {n}" for n in numbers.SIZE_CLASSES) + " ELSE CAST(pow(2, ceil(log2(need))) AS BIGINT) END"


@query(
    f"""SELECT page_id, {_CLASS} AS size_class, CAST(greatest(1, ceil(size / 16777216.0)) AS BIGINT) AS chunks, least(2 * (page_id % 40), 32) AS padding
FROM (SELECT page_id, size, size + 8 AS need FROM (SELECT page_id, octet_length(encode(html)) * (1 + page_id * page_id) AS size FROM pages))"""
)
def size_class(spark: SparkSession, d: str) -> DataFrame:
    size = F.octet_length("html") * (1 + F.col("page_id") * F.col("page_id"))
    pages = tables.read(spark, d, "pages").select("page_id", size.alias("size"))
    return pages.select(
        "page_id",
        numbers.size_class(F.col("size")).alias("size_class"),
        numbers.chunk_count(F.col("size")).alias("chunks"),
        numbers.padding_count(F.col("page_id") % 40).alias("padding"),
    )


@query(
    """SELECT page_id, regexp_matches(mime, '^[A-Za-z0-9+\\-._]+/[A-Za-z0-9+\\-._]+$') AS valid,
CASE WHEN starts_with(mime, 'image/') THEN 'image' WHEN starts_with(mime, 'video/') THEN 'video' WHEN starts_with(mime, 'audio/') THEN 'audio' ELSE 'document' END AS kind
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'text/html' WHEN 2 THEN 'not a type' ELSE 'audio/ogg' END AS mime FROM pages)"""
)
def mime_kinds(spark: SparkSession, d: str) -> DataFrame:
    rest = F.col("page_id") % 4
    mime = F.when(rest == 0, "image/png").when(rest == 1, "text/html").when(rest == 2, "not a type").otherwise("audio/ogg")
    return tables.read(spark, d, "pages").select("page_id", text.valid_mime(mime).alias("valid"), text.content_kind(mime).alias("kind"))


@query(
    """SELECT page_id, coalesce(nullif(trim(trim(trim(regexp_replace(nfc_normalize(url), '[/\\\\:*?"<>|\\x00-\\x1F\\x7F-\\x{9F}]', '', 'g')), '.')), ''), 'unnamed') AS name,
trim(regexp_replace(nfc_normalize(url), '\\s+', ' ', 'g')) AS caption FROM pages"""
)
def filenames(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "pages").select("page_id", text.sanitize_filename(F.col("url")).alias("name"), text.normalize_caption(F.col("url")).alias("caption"))
