"""Changes of state, gates, requests and reports that the other modules don't register."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import models, text, times
from parley.operators import analytics, cold, offload, search, store
from parley.plans.registry import query
from parley.plans.retention import _AGE, _CANDIDATE, _NOW
from parley.plans.sql import ASSET, CONV, MSG, fuzzy, grams
from parley.sources import tables


@query(
    f"""WITH {MSG}, bad AS (
  SELECT CASE WHEN message_id % 11 = 0 THEN 'no sender' WHEN message_id % 13 = 0 THEN 'no time'
              WHEN message_id % 7 = 0 AND kind <> 'media' THEN 'no content' ELSE 'none' END AS rejected FROM msg)
SELECT rejected, count(*) AS n FROM bad GROUP BY rejected"""
)
def rejected_messages(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("message_id")
    arriving = (
        tables.messages(spark, d)
        .withColumn("sender_id", F.when(m % 11 == 0, " ").otherwise(F.col("sender_id")))
        .withColumn("created_at_ms", F.when(m % 13 == 0, 0).otherwise(F.col("created_at_ms")))
        .withColumn("text", F.when(m % 7 == 0, "").otherwise(F.col("text")))
    )
    return store.validated(arriving).groupBy(F.coalesce("rejected", F.lit("none")).alias("rejected")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {MSG}, m AS (SELECT message_id, text, body_state, message_id % 2 = 0 AND body_state = 'local_plain_available' AS done, message_id % 2 = 0 AS asked FROM msg)
SELECT message_id, CASE WHEN done AND message_id % 4 = 0 THEN NULL ELSE text END AS text,
CASE WHEN done AND message_id % 4 = 0 THEN 'deleted_for_everyone' WHEN done THEN 'deleted_for_me' ELSE body_state END AS body_state,
CASE WHEN done THEN {_NOW} WHEN (message_id % 1000) % 6 = 5 THEN 1704067200000 + (message_id // 1000) * 86400000 ELSE 0 END AS deleted_at_ms, asked AND NOT done AS refused FROM m"""
)
def deleted_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Every second message deleted for oneself, every fourth for everyone too; what isn't local can't be."""
    messages = tables.messages(spark, d)
    own = messages.where("message_id % 2 = 0").select("message_id", F.lit(False).alias("for_everyone"))
    everyone = messages.where("message_id % 4 = 0").select("message_id", F.lit(True).alias("for_everyone"))
    return store.deleted(messages, own.unionByName(everyone), _NOW).select("message_id", "text", "body_state", F.coalesce("deleted_at_ms", F.lit(0)).alias("deleted_at_ms"), "refused")


@query(
    f"""WITH {MSG} SELECT 'message_deleted' AS event_type, conversation_id, message_id, {_NOW} AS created_at_ms,
CASE WHEN message_id % 4 = 0 THEN 'for_everyone' ELSE 'for_me' END AS scope FROM msg WHERE message_id % 2 = 0 AND body_state = 'local_plain_available'"""
)
def deletion_events(spark: SparkSession, d: str) -> DataFrame:
    messages = tables.messages(spark, d)
    asked = messages.where("message_id % 2 = 0").select("message_id", (F.col("message_id") % 4 == 0).alias("for_everyone"))
    return store.deletion_events(messages, asked, _NOW)


@query("SELECT vec_id AS message_id, 'v' || (label % 2) AS model_version FROM embeddings WHERE vec_id % 5 <> 0")
def vectors_after_edit(spark: SparkSession, d: str) -> DataFrame:
    """An edited message's vectors go."""
    vectors = tables.vectors(spark, d)
    edits = vectors.where("message_id % 5 = 0").select("message_id")
    return store.without_deleted(vectors, edits).select("message_id", "model_version")


@query(f"WITH {MSG}, {CONV} SELECT conversation_id, CASE WHEN conversation_id % 2 = 0 THEN true ELSE pinned END AS pinned FROM conv")
def pin_updates(spark: SparkSession, d: str) -> DataFrame:
    conversations = tables.conversations(spark, d)
    even = conversations.where("conversation_id % 2 = 0").select("conversation_id")
    updates = even.select("*", F.lit(True).alias("pinned"), F.lit(2).alias("seq")).unionByName(even.select("*", F.lit(False).alias("pinned"), F.lit(1).alias("seq")))
    return store.pinned(conversations, updates).select("conversation_id", "pinned")


@query(
    f"""WITH {ASSET} SELECT message_id, min(asset_id) AS first_asset_id, count(*) AS assets, CAST(sum(bytes_local) AS BIGINT) AS bytes,
CAST(sum(greatest(1, ceil(bytes_local / 16777216.0))) AS BIGINT) AS chunks FROM asset GROUP BY message_id"""
)
def media_by_message(spark: SparkSession, d: str) -> DataFrame:
    return store.media_summary(tables.assets(spark, d))


@query(
    f"""WITH {ASSET}, {_CANDIDATE} SELECT asset_id, kind FROM cand
ORDER BY CASE kind WHEN 'video' THEN 1 WHEN 'document' THEN 2 WHEN 'image' THEN 3 WHEN 'audio' THEN 4 ELSE 5 END, created_at_ms, asset_id LIMIT 100"""
)
def eviction_priority(spark: SparkSession, d: str) -> DataFrame:
    return offload.by_priority(offload.candidates(tables.assets(spark, d), _NOW, _AGE), 100).select("asset_id", "kind")


@query(
    f"""WITH {ASSET}, outcome AS (
  SELECT CASE WHEN message_id % 3 = 0 THEN 'missing' WHEN message_id % 3 = 1 THEN 'already' ELSE 'moved' END AS outcome, bytes_local
  FROM asset WHERE storage_sink = 'cloud')
SELECT outcome, count(*) AS n, CAST(sum(bytes_local) AS BIGINT) AS bytes FROM outcome GROUP BY outcome"""
)
def migration_report(spark: SparkSession, d: str) -> DataFrame:
    """A plan run again after a third of its assets moved and a third went."""
    assets = tables.assets(spark, d)
    plan = offload.migration_plan(assets, "cloud", "primary_backend")
    rest = F.col("message_id") % 3
    now = assets.where(rest != 0).withColumn("storage_sink", F.when((rest == 1) & (F.col("storage_sink") == "cloud"), "primary_backend").otherwise(F.col("storage_sink")))
    return offload.migration_outcomes(now, plan).groupBy("outcome").agg(F.count("*").alias("n"), F.sum("bytes_local").alias("bytes"))


@query(f"WITH {ASSET} SELECT CASE storage_sink WHEN 'cloud' THEN 'primary_backend' ELSE storage_sink END AS storage_sink, count(*) AS n FROM asset GROUP BY 1")
def migrated_sinks(spark: SparkSession, d: str) -> DataFrame:
    assets = tables.assets(spark, d)
    after = offload.migrated(assets, offload.migration_plan(assets, "cloud", "primary_backend"))
    return after.groupBy("storage_sink").agg(F.count("*").alias("n"))


@query(
    f"""WITH {MSG}, own AS (SELECT * FROM msg WHERE conversation_id = 6),
older AS (SELECT * FROM own WHERE message_id < 6001 ORDER BY message_id DESC LIMIT 3), newer AS (SELECT * FROM own WHERE message_id > 6001 ORDER BY message_id LIMIT 3)
SELECT message_id, 'adjacent_prefetch' AS reason, {_NOW} AS requested_at_ms FROM (SELECT * FROM older UNION ALL SELECT * FROM newer) WHERE body_state = 'remote_archive_only'"""
)
def prefetch_requests(spark: SparkSession, d: str) -> DataFrame:
    return store.prefetch_window(tables.messages(spark, d), 6, [6001], 3, _NOW)


_COLD_WORDS = "CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'thre') AS INT)"


@query(
    f"""WITH {MSG}, cold AS (SELECT * FROM msg WHERE body_state = 'remote_archive_only'),
{grams('q', "(SELECT 0 AS message_id, 'the thre' AS text)")}, {grams('cg', 'cold')}, {fuzzy('cf', 'cg', 'q')}
SELECT strftime(make_timestamp(created_at_ms * 1000), '%Y-%m') AS time_bucket, count(*) AS hits
FROM cold LEFT JOIN cf USING (message_id) WHERE ({_COLD_WORDS} > 0 OR fuzzy IS NOT NULL) AND message_id % 2 = 1 GROUP BY 1"""
)
def cold_new_hits(spark: SparkSession, d: str) -> DataFrame:
    """What the cold months add to results that have every even message."""
    messages = tables.messages(spark, d)
    months = messages.where("body_state = 'remote_archive_only'").withColumn("time_bucket", times.month_bucket(F.col("created_at_ms")))
    return cold.new_hits(messages.where("message_id % 2 = 0"), months, search.SearchQuery("the thre"))


@query(
    f"""WITH {MSG} SELECT message_id, CAST((created_at_ms - 345600000) // 604800000 * 604800000 + 345600000 AS BIGINT) AS week_ms,
CAST(created_at_ms // 2592000000 * 2592000000 AS BIGINT) AS thirty_day_ms,
epoch_ms(CAST(date_trunc('month', make_timestamp(created_at_ms * 1000)) AS TIMESTAMP)) AS month_from_ms,
epoch_ms(CAST(date_trunc('month', make_timestamp(created_at_ms * 1000)) + INTERVAL 1 MONTH AS TIMESTAMP)) AS month_to_ms FROM msg"""
)
def period_starts(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("created_at_ms")
    month = times.month_bucket(at)
    return tables.messages(spark, d).select(
        "message_id",
        times.week_start_ms(at).alias("week_ms"),
        times.thirty_day_start_ms(at).alias("thirty_day_ms"),
        times.bucket_start_ms(month).alias("month_from_ms"),
        times.bucket_end_ms(month).alias("month_to_ms"),
    )


@query(
    """SELECT c_custkey, (c_custkey % 2 = 0 OR c_custkey % 100 >= 50) AND c_custkey % 4 IN (0, 1) AND c_custkey % 3 = 0 AS may_warm,
CASE WHEN c_custkey < 100 THEN 'int4' ELSE 'int8' END AS quantization,
CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN 'primary_backend' ELSE 'cloud' END AS route FROM customer"""
)
def device_gates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    heat = F.element_at(F.array(*map(F.lit, ("nominal", "fair", "serious", "critical"))), (k % 4 + 1).cast("int"))
    return tables.read(spark, d, "customer").select(
        "c_custkey",
        models.may_warm(k % 100, k % 2 == 0, heat, k % 3 == 0).alias("may_warm"),
        models.quantization(F.when(k < 100, 1 << 20).otherwise(1 << 30)).alias("quantization"),
        models.media_route(F.when(k % 5 == 0, "thumbnail").otherwise("image"), F.when(k % 7 == 0, "").otherwise("cloud")).alias("route"),
    )


@query("SELECT page_id, replace(replace(rtrim(to_base64(encode(url)), '='), '+', '-'), '/', '_') AS token FROM pages")
def url_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "pages").select("page_id", text.base64_url(F.col("url").cast("binary")).alias("token"))


@query("SELECT event_id AS seq, event_type AS kind FROM events ORDER BY event_id DESC LIMIT 512")
def recent_events(spark: SparkSession, d: str) -> DataFrame:
    events = tables.read(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("kind"))
    return analytics.recent_ring(events)
