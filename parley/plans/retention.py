"""Retention and analytics queries: usage, pressure, eviction, deduplication, latency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import analytics, offload, search
from parley.plans.registry import query
from parley.plans.sql import ASSET, MSG, grams
from parley.sources import tables

_NOW = 1_735_689_600_000  # 2025-01-01
_AGE = 30 * 86_400_000
_BUDGET = 1 << 40
_TARGET = 20 * (1 << 30)

_USAGE = f"""WITH {MSG}, {ASSET}, {grams('g', 'msg')}, part AS (
  SELECT (SELECT CAST(coalesce(sum(length(text)), 0) AS BIGINT) FROM msg) AS body, (SELECT count(*) * 256 FROM msg) AS skeleton,
         (SELECT CAST(coalesce(sum(bytes_local), 0) AS BIGINT) FROM asset) AS media, (SELECT CAST(coalesce(sum(length(token) + 8), 0) AS BIGINT) FROM g) AS fuzzy,
         (SELECT CAST(coalesce(sum(len(embedding) * 4), 0) AS BIGINT) FROM embeddings) AS vec, (SELECT CAST(coalesce(sum(length(html)), 0) AS BIGINT) FROM pages) AS pages),
usage AS (
  SELECT body + skeleton AS message_bytes, media AS media_bytes, body + fuzzy + vec + pages AS index_bytes, CAST(0 AS BIGINT) AS cache_bytes,
         body + skeleton + media + body + fuzzy + vec + pages AS total_bytes FROM part)"""


def _usage(spark: SparkSession, d: str) -> DataFrame:
    messages = tables.messages(spark, d)
    return offload.usage(tables.assets(spark, d), messages, search.gram_bytes(messages, offload.GRAM_BYTES), tables.vectors(spark, d), tables.media_index(spark, d))


@query(f"{_USAGE} SELECT * FROM usage")
def storage_usage(spark: SparkSession, d: str) -> DataFrame:
    return _usage(spark, d)


@query(
    f"""{_USAGE}, total AS (SELECT total_bytes AS t FROM usage)
SELECT CASE WHEN t > {_BUDGET} THEN 'extreme' WHEN t > {_BUDGET * 90 // 100} THEN 'critical' WHEN t > {_BUDGET * 75 // 100} THEN 'warning' ELSE 'normal' END AS level,
CASE WHEN t > {_BUDGET} THEN t - {_BUDGET} WHEN t > {_BUDGET * 90 // 100} THEN t - {_BUDGET * 90 // 100} WHEN t > {_BUDGET * 75 // 100} THEN t - {_BUDGET * 75 // 100} ELSE 0 END AS target_bytes,
greatest({_BUDGET} - t, 0) AS headroom FROM total"""
)
def pressure_level(spark: SparkSession, d: str) -> DataFrame:
    total = F.col("total_bytes")
    leveled = _usage(spark, d).withColumn("level", offload.pressure(total, _BUDGET))
    return leveled.select("level", offload.eviction_target(total, F.col("level"), _BUDGET).alias("target_bytes"), offload.headroom(total, _BUDGET).alias("headroom"))


_CANDIDATE = f"cand AS (SELECT * FROM asset WHERE NOT pinned AND archive_state = 'archive_verified' AND media_state = 'original_local' AND bytes_local > 0 AND {_NOW} - created_at_ms >= {_AGE})"
_SCORE = f"""scored AS (
  SELECT *, CASE kind WHEN 'video' THEN 1.0 WHEN 'document' THEN 0.9 WHEN 'image' THEN 0.7 WHEN 'audio' THEN 0.5 ELSE 0.1 END
    + 0.5 * (1 - pow(0.5, greatest({_NOW} - created_at_ms, 0) / 2592000000.0)) + 0.1 * bytes_local / 16777216.0 AS score FROM cand)"""


def _found(spark: SparkSession, d: str) -> DataFrame:
    return offload.scored(offload.candidates(tables.assets(spark, d), _NOW, _AGE), _NOW)


@query(f"WITH {ASSET}, {_CANDIDATE} SELECT asset_id, message_id, conversation_id, kind, bytes_local, storage_sink FROM cand")
def eviction_candidates(spark: SparkSession, d: str) -> DataFrame:
    return offload.candidates(tables.assets(spark, d), _NOW, _AGE).select("asset_id", "message_id", "conversation_id", "kind", "bytes_local", "storage_sink")


@query(f"WITH {ASSET}, {_CANDIDATE}, {_SCORE} SELECT asset_id, round(score, 6) AS score FROM scored")
def eviction_score(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).select("asset_id", F.round("score", 6).alias("score"))


def _rounded(spark: SparkSession, d: str) -> DataFrame:
    """Scores rounded, so that both engines order ties alike."""
    return _found(spark, d).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {ASSET}, {_CANDIDATE}, {_SCORE},
run AS (SELECT *, coalesce(sum(bytes_local) OVER (ORDER BY round(score, 6) DESC, asset_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM scored WHERE kind IN ('video', 'document', 'image', 'audio', 'thumbnail'))
SELECT asset_id, bytes_local, CAST(before_ AS BIGINT) AS taken_before FROM run WHERE before_ < {_TARGET}"""
)
def eviction_greedy(spark: SparkSession, d: str) -> DataFrame:
    return offload.greedy(_rounded(spark, d), _TARGET, "critical").select("asset_id", "bytes_local", "taken_before")


def _pool(name: str, where: str, target: str) -> str:
    return f"""{name} AS (SELECT asset_id, bytes_local, before_ FROM (
  SELECT *, coalesce(sum(bytes_local) OVER (ORDER BY round(score, 6) DESC, asset_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_
  FROM scored WHERE {where}) WHERE before_ < {target})"""


@query(
    f"""WITH {ASSET}, {_CANDIDATE}, {_SCORE}, {_pool('a', "storage_sink = 'cloud'", str(_TARGET * 8))},
{_pool('b', "storage_sink <> 'cloud'", f"greatest(0, {_TARGET * 8} - coalesce((SELECT sum(bytes_local) FROM a), 0))")}
SELECT asset_id, bytes_local, 'cloud_offload' AS plan FROM a UNION ALL SELECT asset_id, bytes_local, 'full_eviction' FROM b"""
)
def eviction_tiered(spark: SparkSession, d: str) -> DataFrame:
    return offload.tiered(_rounded(spark, d), _TARGET * 8).select("asset_id", "bytes_local", "plan")


@query(
    f"""WITH {ASSET}, {_CANDIDATE}, {_SCORE}, {_pool('a', "kind IN ('video', 'document', 'image', 'audio')", str(_TARGET))}
SELECT CASE WHEN asset_id IN (SELECT asset_id FROM a) THEN 'evicted' ELSE media_state END AS media_state, count(*) AS n,
       CAST(sum(CASE WHEN asset_id IN (SELECT asset_id FROM a) THEN 0 ELSE bytes_local END) AS BIGINT) AS bytes_local FROM asset GROUP BY 1"""
)
def eviction_applied(spark: SparkSession, d: str) -> DataFrame:
    # ids alone are looked at afterwards
    plan = offload.greedy(_rounded(spark, d).select("asset_id", "kind", "bytes_local", "score"), _TARGET, "warning")
    after = offload.evicted(tables.assets(spark, d), plan)
    return after.groupBy("media_state").agg(F.count("*").alias("n"), F.sum("bytes_local").alias("bytes_local"))


@query(
    f"""WITH {MSG}, e AS (SELECT message_id, octet_length(encode(text)) AS size, created_at_ms FROM msg),
run AS (SELECT *, sum(size) OVER (ORDER BY created_at_ms DESC, message_id ROWS UNBOUNDED PRECEDING) AS kept FROM e) SELECT message_id FROM run WHERE kept > 200000"""
)
def cache_lru(spark: SparkSession, d: str) -> DataFrame:
    entries = tables.messages(spark, d).select(F.col("message_id").alias("key"), F.octet_length("text").alias("size"), F.col("created_at_ms").alias("last_used"))
    return offload.least_recent(entries, 200_000).select(F.col("key").alias("message_id"))


@query(f"WITH {ASSET} SELECT asset_id, 'cloud' AS source_sink, 'primary_backend' AS target_sink, bytes_local FROM asset WHERE storage_sink = 'cloud'")
def migration_plan(spark: SparkSession, d: str) -> DataFrame:
    return offload.migration_plan(tables.assets(spark, d), "cloud", "primary_backend")


_DEDUP = """u AS (SELECT sha256(text) AS h, count(*) AS n, max(octet_length(encode(text))) AS size, sum(octet_length(encode(text))) AS bytes FROM documents GROUP BY 1),
s AS (SELECT CAST(sum(n) AS BIGINT) AS total_objects, count(*) AS unique_objects, CAST(sum(bytes) AS BIGINT) AS total_bytes, CAST(sum(size) AS BIGINT) AS unique_bytes FROM u)"""


def _blobs(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "documents").select(F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("size"))


@query(f"WITH {_DEDUP} SELECT total_objects, unique_objects, total_bytes, unique_bytes, round((1 - unique_objects / total_objects) * 100, 6) AS ratio_percent FROM s")
def dedup_stats(spark: SparkSession, d: str) -> DataFrame:
    found = analytics.dedup_stats(_blobs(spark, d), "digest", "size")
    return found.select("total_objects", "unique_objects", "total_bytes", "unique_bytes", F.round("ratio_percent", 6).alias("ratio_percent"))


@query(f"WITH {_DEDUP} SELECT total_objects - unique_objects AS objects_saved, total_bytes - unique_bytes AS bytes_saved FROM s")
def storage_savings(spark: SparkSession, d: str) -> DataFrame:
    return analytics.dedup_stats(_blobs(spark, d), "digest", "size").select("objects_saved", "bytes_saved")


#: Event by event: a total never falls below zero.
COUNTERS_SQL = """WITH e AS (
  SELECT event_id AS seq, CASE WHEN event_type IN ('error', 'view', 'click') THEN -1 ELSE 1 END AS o, CAST(value * 100 AS BIGINT) AS size, user_id % 2 = 0 AS dup FROM events)
SELECT CAST(list_reduce(list_prepend(0, list(o ORDER BY seq)), lambda a, x: greatest(0, a + x)) AS BIGINT) AS total_objects,
CAST(sum(CASE WHEN o = 1 AND NOT dup THEN 1 ELSE 0 END) AS BIGINT) AS unique_objects,
CAST(list_reduce(list_prepend(0, list(o * size ORDER BY seq)), lambda a, x: greatest(0, a + x)) AS BIGINT) AS total_bytes,
CAST(sum(CASE WHEN o = 1 AND NOT dup THEN size ELSE 0 END) AS BIGINT) AS unique_bytes FROM e"""


def blob_events(events: DataFrame) -> DataFrame:
    """Upload and deletion events (seq, kind, size_bytes, was_deduped) out of rows of ``events``, batch or streaming."""
    return events.select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type").isin("error", "view", "click"), "deleted").otherwise("uploaded").alias("kind"),
        F.round(F.col("value") * 100).cast("long").alias("size_bytes"),
        (F.col("user_id") % 2 == 0).alias("was_deduped"),
    )


@query(COUNTERS_SQL)
def dedup_counters(spark: SparkSession, d: str) -> DataFrame:
    return analytics.running_counters(blob_events(tables.read(spark, d, "events")))


_PERF = """perf AS (SELECT event_type AS operation, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) AS total, max(value) AS longest,
quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1)"""


@query(f"WITH {_PERF} SELECT operation, n, round(total, 4) AS total, longest, p50, p95, p99 FROM perf")
def perf_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return analytics.percentiles(tables.traces(spark, d))


@query(f"WITH {_PERF} SELECT operation, p95, budget FROM perf JOIN (VALUES ('click', 10.0::DOUBLE), ('view', 1000.0::DOUBLE), ('error', 20.0::DOUBLE)) b(operation, budget) USING (operation) WHERE p95 > budget")
def budget_violations(spark: SparkSession, d: str) -> DataFrame:
    budgets = spark.createDataFrame([("click", 10.0), ("view", 1000.0), ("error", 20.0)], "operation string, budget double")
    return analytics.violations(analytics.percentiles(tables.traces(spark, d)), budgets)
