"""Queries of appends, outboxes, queues, ledgers, replays and media fetches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text
from parley.operators import index, journal, offload, restore, search, store
from parley.plans.registry import query
from parley.plans.search import stored_index
from parley.plans.sql import ASSET, CONV, JOURNAL, MSG, WORDS, grams
from parley.sources import tables
from parley.sources.shared import stored

_NOW = 1_735_689_600_000  # 2025-01-01


@query(f"WITH {MSG}, {CONV} SELECT conversation_id, scope, tenant_id, last_activity_ms FROM conv WHERE conversation_id = 7")
def conversation_lookup(spark: SparkSession, d: str) -> DataFrame:
    return tables.conversations(spark, d).where("conversation_id = 7").select("conversation_id", "scope", "tenant_id", "last_activity_ms")


@query(f"WITH {MSG} SELECT message_id, text FROM msg WHERE message_id = 7001")
def indexed_text(spark: SparkSession, d: str) -> DataFrame:
    """The text that full text search has of one message."""
    return tables.messages(spark, d).where("message_id = 7001").select("message_id", "text")


@query(
    f"WITH {MSG} SELECT word, message_id, string_agg(place, ',' ORDER BY place) AS positions, any_value(n) AS len FROM (SELECT message_id, len(w) AS n, unnest(w) AS word, "
    f"unnest(range(len(w))) AS place FROM (SELECT message_id, {WORDS} AS w FROM msg)) GROUP BY word, message_id"
)
def word_postings(spark: SparkSession, d: str) -> DataFrame:
    """The stored postings of words."""
    return stored_index(spark, d).words.select("word", "message_id", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"), F.col("len").cast("long").alias("len"))


@query(f"WITH {MSG}, {grams('g', 'msg')} SELECT message_id, script, token FROM g")
def gram_postings(spark: SparkSession, d: str) -> DataFrame:
    """The stored postings of n-grams."""
    return stored_index(spark, d).grams.select("message_id", "script", "token")


@query(f"WITH {MSG} SELECT message_id, 'local_plain_available' AS body_state, 'not_archived' AS archive_state FROM msg WHERE text <> ''")
def outbound_rows(spark: SparkSession, d: str) -> DataFrame:
    """Own messages as they are stored before they are sent."""
    rows, _ = store.outbound(tables.messages(spark, d).where("text <> ''"), _NOW)
    return rows.select("message_id", "body_state", "archive_state")


_LAST = "(SELECT max(event_seq) FROM journal)"


@query(
    f"""WITH {JOURNAL}, {MSG}, own AS (SELECT * FROM msg WHERE conversation_id % 5 = 0 AND text <> '')
SELECT {_LAST} + row_number() OVER (ORDER BY lpad(CAST(conversation_id AS VARCHAR), 40, ' '), lpad(CAST(message_id AS VARCHAR), 40, ' ')) AS event_seq,
'message_received' AS event_type, conversation_id, message_id, {_NOW} AS created_at_ms FROM own"""
)
def journal_append(spark: SparkSession, d: str) -> DataFrame:
    """The events of own messages, numbered on from the journal's last."""
    own = tables.messages(spark, d).where("conversation_id % 5 = 0 and text <> ''")
    _, events = store.outbound(own, _NOW)
    return journal.appended(tables.journal(spark, d), events).select("event_seq", "event_type", "conversation_id", "message_id", "created_at_ms")


@query(f"WITH {MSG} SELECT 'outbox_sent' AS event_type, conversation_id, message_id, {_NOW} AS created_at_ms FROM msg WHERE message_id % 3 = 0")
def sent_marks(spark: SparkSession, d: str) -> DataFrame:
    """Every third message is sent, each told twice, and one that isn't stored."""
    messages = tables.messages(spark, d)
    some = messages.where("message_id % 3 = 0").select("message_id")
    none = spark.range(1).select(F.lit(-1).cast("long").alias("message_id"))
    return store.sent_events(messages, some.unionByName(some).unionByName(none), _NOW)


@query("SELECT page_id AS asset_id, 'caption' AS kind, html AS text FROM pages WHERE page_id % 2 = 1")
def new_media_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the media index that arrive twice, half of them known."""
    own = tables.media_index(spark, d)
    return store.new_media_rows(own.where("asset_id % 2 = 0"), own.unionByName(own)).select("asset_id", "kind", "text")


@query(
    f"""WITH {MSG} SELECT message_id, CASE WHEN message_id % 2 = 0 THEN body_state ELSE 'remote_archive_only' END AS body_state,
CASE WHEN message_id % 2 = 0 THEN text END AS text FROM msg"""
)
def archive_skeletons(spark: SparkSession, d: str) -> DataFrame:
    """Skeletons out of an archive join the stored messages, and change none of them."""
    messages = tables.messages(spark, d)
    merged = store.with_skeletons(messages.where("message_id % 2 = 0"), messages.drop("text", "body_state"))
    return merged.select("message_id", "body_state", "text")


@query(f"WITH {MSG} SELECT message_id, CASE WHEN message_id % 4 = 0 THEN created_at_ms + 9 ELSE 0 END AS deleted_at_ms FROM msg")
def deleted_stamps(spark: SparkSession, d: str) -> DataFrame:
    messages = tables.messages(spark, d).withColumn("deleted_at_ms", F.lit(None).cast("long"))
    marks = messages.where("message_id % 4 = 0").select("message_id", F.explode(F.array(F.col("created_at_ms") + 9, F.col("created_at_ms") + 5)).alias("at_ms"))
    return store.stamped(messages, marks, "deleted_at_ms").select("message_id", F.coalesce("deleted_at_ms", F.lit(0)).alias("deleted_at_ms"))


@query(f"WITH {MSG}, {CONV} SELECT conversation_id, conversation_id % 3 = 0 AS muted FROM conv")
def mute_updates(spark: SparkSession, d: str) -> DataFrame:
    conversations = tables.conversations(spark, d).withColumn("muted", F.lit(False))
    updates = conversations.where("conversation_id % 3 = 0").select("conversation_id", F.lit(True).alias("muted"), F.lit(1).alias("seq"))
    return store.muted(conversations, updates).select("conversation_id", "muted")


@query(
    f"""WITH {JOURNAL}, seg AS (
  SELECT conversation_id, strftime(make_timestamp(created_at_ms * 1000), '%Y-%m') AS time_bucket, event_seq, event_type FROM journal)
SELECT conversation_id, time_bucket, string_agg(event_seq, ',' ORDER BY event_seq) AS seqs, string_agg(event_type, ',' ORDER BY event_seq) AS types FROM seg GROUP BY 1, 2"""
)
def segment_events(spark: SparkSession, d: str) -> DataFrame:
    """Each segment's events, in order."""
    found = journal.segments(tables.journal(spark, d))
    return found.select("conversation_id", "time_bucket", F.array_join(F.col("events.event_seq").cast("array<string>"), ",").alias("seqs"), F.array_join("events.event_type", ",").alias("types"))


@query(
    f"""WITH {JOURNAL}, seg AS (SELECT DISTINCT conversation_id, strftime(make_timestamp(created_at_ms * 1000), '%Y-%m') AS time_bucket FROM journal)
SELECT sha256(concat_ws('|', CAST(conversation_id AS VARCHAR), time_bucket, 'blob-' || conversation_id)) AS segment_id, conversation_id, time_bucket,
'events' AS segment_type, 'blob-' || conversation_id AS blob_id, 'primary_backend' AS storage_backend, 'archive_uploaded' AS state FROM seg"""
)
def segment_map(spark: SparkSession, d: str) -> DataFrame:
    uploaded = journal.by_bucket(tables.journal(spark, d)).withColumn("blob_id", F.concat(F.lit("blob-"), F.col("conversation_id").cast("string")))
    return journal.segment_map(uploaded, "events", "primary_backend")


@query(
    """SELECT page_id, kind, CASE kind WHEN 'events' THEN 'backup' WHEN 'checkpoint' THEN 'archive' WHEN 'media_index' THEN 'archive' END AS side
FROM (SELECT page_id, ['events', 'checkpoint', 'media_index', 'nothing'][page_id % 4 + 1] AS kind FROM pages)"""
)
def segment_sides(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("events", "checkpoint", "media_index", "nothing"))), (F.col("page_id") % 4 + 1).cast("int"))
    return tables.read(spark, d, "pages").select("page_id", kind.alias("kind")).withColumn("side", journal.segment_side(F.col("kind")))


_LEDGER = """old AS (SELECT o_orderkey % 7 AS chain, o_orderkey AS segment_id, 'old' AS state FROM orders WHERE o_orderkey % 2 = 0),
new AS (SELECT o_orderkey % 7 AS chain, o_orderkey AS segment_id, 'new' AS state FROM orders WHERE o_orderkey % 7 IN (1, 2) AND o_orderkey % 3 = 0)"""


def _ledgers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    key = F.col("o_orderkey")
    orders = tables.read(spark, d, "orders")
    rows = lambda kept, state: kept.select((key % 7).alias("chain"), key.alias("segment_id"), F.lit(state).alias("state"))
    return rows(orders.where(key % 2 == 0), "old"), rows(orders.where((key % 7).isin(1, 2) & (key % 3 == 0)), "new")


@query(f"WITH {_LEDGER} SELECT * FROM old WHERE chain NOT IN (SELECT chain FROM new) UNION ALL SELECT * FROM new")
def ledger_replaced(spark: SparkSession, d: str) -> DataFrame:
    return journal.ledger_replaced(*_ledgers(spark, d))


@query(f"WITH {_LEDGER} SELECT * FROM old UNION ALL SELECT * FROM new WHERE segment_id NOT IN (SELECT segment_id FROM old)")
def ledger_appended(spark: SparkSession, d: str) -> DataFrame:
    old, new = _ledgers(spark, d)
    return journal.ledger_appended(old, new.unionByName(new))


@query("SELECT o_custkey AS chain, max(o_orderkey) AS generation FROM orders GROUP BY 1")
def manifest_latest(spark: SparkSession, d: str) -> DataFrame:
    made = tables.read(spark, d, "orders").select(F.col("o_custkey").alias("chain"), F.col("o_orderkey").alias("generation"))
    return journal.latest_manifest(made)


def _cold_results(spark: SparkSession, d: str) -> DataFrame:
    return tables.messages(spark, d).select("message_id", "conversation_id", (F.col("body_state") == "remote_archive_only").alias("is_cold"))


@query(f"WITH {MSG} SELECT message_id, conversation_id, 'search_result_tap' AS reason, {_NOW} AS requested_at_ms FROM msg WHERE body_state = 'remote_archive_only'")
def cold_requests(spark: SparkSession, d: str) -> DataFrame:
    """Cold search results ask for their bodies."""
    return store.cold_requests(_cold_results(spark, d), _NOW)


@query(
    f"""WITH {MSG}, req AS (
  SELECT message_id, 0 AS urgency, {_NOW} AS asked_at FROM msg WHERE body_state = 'remote_archive_only'
  UNION ALL SELECT message_id, 2, created_at_ms FROM msg WHERE message_id % 2 = 0 AND body_state <> 'remote_archive_only'),
ranked AS (SELECT *, row_number() OVER (ORDER BY urgency, asked_at, message_id) AS nth FROM req)
SELECT message_id, nth <= 10 AS taken FROM ranked WHERE message_id % 9 <> 0 OR nth <= 10"""
)
def queue_taken(spark: SparkSession, d: str) -> DataFrame:
    """Ten requests are taken off a queue of visible and tapped messages, tapped ones first, and every ninth of the rest is removed."""
    visible = tables.messages(spark, d).where("message_id % 2 = 0").select("message_id", F.lit("visible_viewport").alias("reason"), F.col("created_at_ms").alias("requested_at_ms"))
    queue = store.enqueued(visible, store.cold_requests(_cold_results(spark, d), _NOW).select("message_id", "reason", "requested_at_ms"))
    taken, left = store.dequeued(queue, 10)
    left = store.removed(left, left.where("message_id % 9 = 0"))
    return taken.select("message_id", F.lit(True).alias("taken")).unionByName(left.select("message_id", F.lit(False).alias("taken")))


@query("SELECT o_custkey AS key, CAST(max(o_orderkey) AS BIGINT) AS last_used, CAST(arg_max(o_orderkey % 1000, o_orderkey) AS BIGINT) AS size FROM orders GROUP BY 1")
def cache_touch(spark: SparkSession, d: str) -> DataFrame:
    """Entries inserted and used again."""
    key = F.col("o_orderkey")
    uses = tables.read(spark, d, "orders").select(F.col("o_custkey").alias("key"), (key % 1000).cast("long").alias("size"), key.cast("long").alias("last_used"))
    return store.touched(uses.where(key % 2 == 0), uses.where(key % 2 == 1))


@query(
    f"""WITH {MSG}, {grams('g', 'msg')} SELECT 'text' AS index_type, (SELECT count(*) FROM msg WHERE message_id % 2 = 1) AS rows_new, (SELECT count(*) FROM msg) AS rows_inserted
UNION ALL SELECT 'fuzzy', (SELECT count(*) FROM g WHERE message_id % 2 = 1), (SELECT count(*) FROM g) UNION ALL SELECT 'vector', 0, 0"""
)
def replay_shards(spark: SparkSession, d: str) -> DataFrame:
    """Shards replayed into indexes that have half of them; vectors count as none."""
    texts = tables.messages(spark, d).select("message_id", "text")
    fuzzy = stored(search.fuzzy_grams(tables.messages(spark, d)), "replay-grams")  # cut once
    shards = {"text": texts, "fuzzy": fuzzy, "vector": tables.vectors(spark, d)}
    half = {kind: df.where("message_id % 2 = 0") for kind, df in shards.items()}
    after = restore.replayed(half, shards, {"text": ["message_id"], "fuzzy": ["message_id", "script", "token"]})
    grown = [after[k].agg(F.lit(k).alias("index_type"), F.count("*").alias("now")).crossJoin(half[k].agg(F.count("*").alias("was"))) for k in shards]
    new = grown[0].unionByName(grown[1]).unionByName(grown[2]).select("index_type", (F.col("now") - F.col("was")).alias("rows_new"))
    return restore.replay_summary(shards).join(new, "index_type")


_STATES = "CASE message_id % 5 WHEN 0 THEN 'evicted' WHEN 1 THEN 'remote_original' WHEN 2 THEN 'original_local' WHEN 3 THEN 'deleted' ELSE 'evicted' END"


def _media(spark: SparkSession, d: str) -> DataFrame:
    """Assets in all states; of every fifth message they have no root."""
    own = tables.assets(spark, d)
    root = F.when(F.col("message_id") % 5 != 4, F.unhex(F.sha2("asset_id", 256)))
    path = F.when(F.col("message_id") % 3 == 0, F.concat(F.lit("had/"), F.col("asset_id")))
    return own.withColumns({"media_state": F.expr(_STATES), "merkle_root": root, "bytes_total": F.col("bytes_local"), "local_path": path})


@query(
    f"""WITH {ASSET}, s AS (SELECT * EXCLUDE (media_state), {_STATES} AS media_state FROM asset)
SELECT asset_id, media_state AS from_state, CAST(greatest(1, ceil(bytes_local / 16777216.0)) AS BIGINT) AS chunks,
CASE WHEN media_state = 'original_local' THEN 'already local' WHEN media_state = 'deleted' THEN 'not fetchable' WHEN message_id % 5 = 4 THEN 'no root' END AS refused FROM s"""
)
def rehydration_plan(spark: SparkSession, d: str) -> DataFrame:
    assets = _media(spark, d)
    return store.rehydration_plan(assets, assets.select("asset_id"))


@query(
    f"""WITH {ASSET}, s AS (SELECT * EXCLUDE (media_state), {_STATES} AS media_state FROM asset)
SELECT asset_id, CASE WHEN media_state IN ('evicted', 'remote_original') AND message_id % 2 = 0 THEN 'original_local' ELSE media_state END AS media_state,
CASE WHEN media_state IN ('evicted', 'remote_original') AND message_id % 2 = 0 THEN 'at/' || asset_id WHEN message_id % 3 = 0 THEN 'had/' || asset_id END AS local_path FROM s"""
)
def rehydrated_media(spark: SparkSession, d: str) -> DataFrame:
    assets = _media(spark, d)
    fetched = assets.where("message_id % 2 = 0").select("asset_id", F.concat(F.lit("at/"), F.col("asset_id")).alias("local_path"))
    return store.rehydrated_media(assets, fetched).select("asset_id", "media_state", "local_path")


@query(f"WITH {ASSET} SELECT asset_id, 'cloud' AS source_sink, 'primary_backend' AS target_sink, bytes_local FROM asset WHERE storage_sink = 'cloud' AND message_id % 5 <> 4")
def migration_roots(spark: SparkSession, d: str) -> DataFrame:
    """Assets without a root stay where they are."""
    return offload.migration_plan(_media(spark, d), "cloud", "primary_backend")


@query(
    """SELECT page_id, page_id % 3 = 0 OR page_id % 3 = 1 AS supported, CASE WHEN page_id % 4 = 0 THEN 'message_received' WHEN page_id % 4 = 1 THEN 'media_deleted' END AS parsed, CASE WHEN page_id % 4 = 0 THEN 'message_received' END AS archived FROM pages"""
)
def known_names(spark: SparkSession, d: str) -> DataFrame:
    """Documents that can be read, and names of event types; others are unknown."""
    k = F.col("page_id")
    mime = F.when(k % 3 == 0, "application/pdf").when(k % 3 == 1, text.DOCUMENT_MIMES[1]).otherwise("text/html")
    name = F.when(k % 4 == 0, "message_received").when(k % 4 == 1, "media_deleted").when(k % 4 == 2, "Message_Received").otherwise("")
    return tables.read(spark, d, "pages").select("page_id", text.supported_document(mime).alias("supported"), journal.parsed_type(name).alias("parsed"), journal.parsed_type(name, "archive").alias("archived"))


@query(
    f"""WITH {MSG}, {ASSET}, gone AS (SELECT message_id FROM msg WHERE conversation_id = 4), lost AS (SELECT asset_id FROM asset WHERE message_id IN (SELECT message_id FROM gone))
SELECT 'messages' AS part, count(*) AS n FROM msg WHERE conversation_id <> 4 UNION ALL SELECT 'assets', count(*) FROM asset WHERE conversation_id <> 4
UNION ALL SELECT 'grams', count(*) FROM msg WHERE message_id NOT IN (SELECT message_id FROM gone)
UNION ALL SELECT 'media_index', count(*) FROM asset WHERE asset_id NOT IN (SELECT asset_id FROM lost) UNION ALL SELECT 'regions', count(*) FROM region"""
)
def cascade_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables owned by conversation, message or asset, and one that is owned by none."""
    messages, assets = tables.messages(spark, d), tables.assets(spark, d)
    own = {"messages": messages, "assets": assets, "grams": messages.select("message_id"), "media_index": assets.select("asset_id"), "regions": tables.read(spark, d, "region")}
    counts = [df.agg(F.lit(name).alias("part"), F.count("*").alias("n")) for name, df in store.cascade(own, 4).items()]
    out = counts[0]
    for one in counts[1:]:
        out = out.unionByName(one)
    return out


@query(f"WITH {MSG} SELECT count(*) AS n, CAST(sum(len({WORDS})) AS BIGINT) AS words FROM msg")
def index_growth(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of an index to which half of the messages were added later."""
    from parley.sources.shared import shared_path

    messages = tables.messages(spark, d)
    grown = index.build(messages.where("message_id % 2 = 0"), shared_path(spark, "index-growth"))
    grown = index.added(grown, messages.where("message_id % 2 = 1"))
    counts = grown.words.agg(F.sum(F.size("positions")).alias("words"))
    return grown.stats.select("n").crossJoin(counts)
