"""Files and what is in them: the cold source, verified segments, migrations, streamed ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import blobs, cold, index, offload
from parley.operators.search import SearchQuery
from parley.plans.registry import query
from parley.plans.search import six
from parley.plans.sql import MSG, bm25
from parley.sources import cold_tier, tables
from parley.sources.shared import shared_path
from parley.streaming.ingest import Sink

_MONTH = "strftime(make_timestamp(created_at_ms * 1000), '%Y-%m')"


def _spoil(spark: SparkSession, path: str) -> None:
    """A file that is no Parquet file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(at)
    out.write(bytearray(b"no parquet"))
    out.close()


@query(
    f"""WITH {MSG} SELECT {_MONTH} AS time_bucket, count(*) AS messages, 0 AS unreadable FROM msg WHERE body_state = 'remote_archive_only' AND {_MONTH} >= '2024-02' GROUP BY 1
UNION ALL SELECT '2024-02', 0, 1 UNION ALL SELECT '2099-12', 0, 1"""
)
def cold_source(spark: SparkSession, d: str) -> DataFrame:
    """Months of the cold tier read by its own source; of three files that are none, one is in a month that isn't asked for."""
    archived = tables.messages(spark, d).where("body_state = 'remote_archive_only'")
    path = shared_path(spark, "cold-tier")
    cold.write(archived, path)
    for month in ("2024-01", "2024-02", "2099-12"):
        _spoil(spark, f"{path}/time_bucket={month}/broken.parquet")
    rows = cold_tier.load(spark, path, archived.schema).where("time_bucket >= '2024-02'")
    counts = rows.groupBy("time_bucket", F.col("error").isNotNull().alias("broken")).agg(F.count("*").alias("n"))
    return counts.select("time_bucket", F.when(F.col("broken"), 0).otherwise(F.col("n")).cast("long").alias("messages"), F.when(F.col("broken"), F.col("n")).otherwise(0).cast("int").alias("unreadable"))


@query(f"WITH {MSG} SELECT message_id, text FROM msg WHERE body_state = 'remote_archive_only' AND {_MONTH} BETWEEN '2024-02' AND '2024-12' AND {_MONTH} <> '2024-04' AND {_MONTH} <> '2024-06'")
def verified_segments(spark: SparkSession, d: str) -> DataFrame:
    """What a search of some months reads of segments: neither what was never verified nor what has changed since."""
    archived = tables.messages(spark, d).where("body_state = 'remote_archive_only'")
    path = shared_path(spark, "segments")
    made = blobs.write_segments(archived, path, "primary_backend")
    # another hash in the map is what another content would have
    wrong = F.when(F.col("time_bucket") == "2024-04", F.sha2("file", 256)).otherwise(F.col("content_hash"))
    held = blobs.verified(made.withColumn("content_hash", wrong), path)
    changed = F.when(F.col("time_bucket") == "2024-06", F.sha2("file", 256)).otherwise(F.col("content_hash"))
    first, last = (1_706_745_600_000, 1_735_603_200_000)  # February to December of 2024
    wanted = SearchQuery(date_from=first, date_to=last)
    found = blobs.read_segments(held.withColumn("content_hash", changed), wanted, {"primary_backend": path}, archived.schema)
    return found.select("message_id", "text")


@query("SELECT page_id, lower(sha256('\\x00'::BLOB || encode(coalesce(html, '')))) AS root FROM pages")
def merkle_roots(spark: SparkSession, d: str) -> DataFrame:
    """Roots of pages' contents, each of one chunk."""
    content = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return tables.read(spark, d, "pages").select("page_id", F.lower(F.hex(blobs.merkle_root(blobs.chunk_hashes(content)))).alias("root"))


_KEY = b"tenant 7"
_PADS = ["".join(f"\\x{b ^ pad:02X}" for b in _KEY.ljust(64, b"\0")) for pad in (0x36, 0x5C)]


@query(
    f"SELECT page_id, sha256(encode(coalesce(html, ''))) AS content_hash, "
    f"sha256('{_PADS[1]}'::BLOB || unhex(sha256('{_PADS[0]}'::BLOB || encode(coalesce(html, ''))))) AS keyed_hash FROM pages"
)
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of pages, by content alone and under a tenant's key."""
    content = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return tables.read(spark, d, "pages").select("page_id", F.sha2(content, 256).alias("content_hash"), F.lower(F.hex(blobs.keyed_hash(content, _KEY))).alias("keyed_hash"))


@query(
    """SELECT CASE WHEN page_id % 5 = 0 THEN 'already' WHEN page_id % 7 = 0 THEN 'not read back' WHEN page_id % 11 = 0 THEN 'other content' ELSE 'migrated' END AS outcome,
count(*) AS n, count(*) FILTER (page_id % 5 = 0 OR (page_id % 7 <> 0 AND page_id % 11 <> 0)) AS on_target FROM pages GROUP BY 1"""
)
def media_migration(spark: SparkSession, d: str) -> DataFrame:
    """Pages moved between sinks in chunks of 4 KiB: some are there, some were lost, some have another content than their root says."""
    pages = tables.read(spark, d, "pages")
    name, page = F.col("page_id").cast("string").alias("asset_id"), F.col("page_id")
    content = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rightly = blobs.merkle_root(blobs.chunk_hashes(content, 4096))
    root = F.when(page % 11 == 0, F.unhex(F.sha2(content, 256))).otherwise(rightly)
    sink = F.when(page % 5 == 0, "primary_backend").otherwise("cloud")
    assets = pages.select(name, sink.alias("storage_sink"), F.octet_length(content).cast("long").alias("bytes_local"), root.alias("merkle_root"))
    source, target = shared_path(spark, "sink"), shared_path(spark, "sink")
    blobs.write_chunks(pages.where("page_id % 7 <> 0").select(name, content.alias("content")), source, 4096)
    every = offload.migration_plan(assets.withColumn("storage_sink", F.lit("cloud")), "cloud", "primary_backend")
    outcomes = blobs.migrate(assets, every, source, target)
    after = blobs.after_migration(assets, outcomes).select("asset_id", (F.col("storage_sink") == "primary_backend").cast("long").alias("there"))
    return outcomes.join(after, "asset_id").groupBy("outcome").agg(F.count("*").alias("n"), F.sum("there").alias("on_target"))


_ARRIVED = "message_id long, conversation_id long, sender_id string, created_at_ms long, kind string, text string"


def _ingested(spark: SparkSession, d: str) -> tuple[Sink, int]:
    """Half of the messages, then all of them, taken in as a stream of files."""
    folder = shared_path(spark, "ingest")
    own = tables.messages(spark, d).select("message_id", "conversation_id", "sender_id", "created_at_ms", "kind", "text")
    own.where("message_id % 2 = 0").write.parquet(f"{folder}/in/1")
    own.write.parquet(f"{folder}/in/2")
    # older files come first, so the first batch is the first folder, in as many files as its table has tasks
    files = len(spark.read.parquet(f"{folder}/in/1").inputFiles())
    arriving = spark.readStream.schema(_ARRIVED).option("maxFilesPerTrigger", files).parquet(f"{folder}/in/*")
    sink = Sink(spark, folder, _ARRIVED)
    sink.start(arriving, f"{folder}/cursor").awaitTermination()
    return sink, sink.epochs


_VALID = f"{MSG}, valid AS (SELECT * FROM msg WHERE length(trim(sender_id)) > 0 AND created_at_ms > 0 AND (length(text) > 0 OR kind = 'media'))"


@query(f"""WITH {_VALID}, {bm25('b', 'valid', ['the', 'thre'], "list_contains(w, 'the') AND list_contains(w, 'thre')")} SELECT message_id, round(bm25, 6) AS bm25 FROM b""")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Matches by the index that a stream keeps, to which most messages came twice."""
    sink, epoch = _ingested(spark, d)
    return index.full_text(sink.index(epoch), "the thre").select("message_id", six("bm25"))


@query(
    f"""WITH {_VALID} SELECT conversation_id, arg_max(message_id, created_at_ms * 1000 + message_id % 1000) AS last_message_id, max(created_at_ms) AS last_activity_ms,
count(*) AS messages, count(*) AS events FROM valid GROUP BY conversation_id"""
)
def stream_ingest_heads(spark: SparkSession, d: str) -> DataFrame:
    """Heads, messages and events of each conversation after a streamed ingest."""
    sink, _ = _ingested(spark, d)
    counts = sink.messages.groupBy("conversation_id").agg(F.count("*").alias("messages"))
    events = sink.journal.groupBy("conversation_id").agg(F.count("*").alias("events"))
    return sink.heads.join(counts, "conversation_id").join(events, "conversation_id")
