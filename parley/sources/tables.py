"""Tables of the conversation model, read from a folder of Parquet files.

The model's tables are views of the folder's: messages and conversations of
``conversations``, the event journal of ``events``, media assets of ``lineitem``,
``orders`` and ``customer``, vectors of ``embeddings``, the media index of ``pages``.
Every adapter is a projection, so filters on its columns reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_MS = 1_704_067_200_000
DAY_MS = 86_400_000


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """message_id, conversation_id, sender_id, created_at_ms, kind, body_state, text."""
    turn = F.col("turn")
    return read(spark, folder, "conversations").select(
        (F.col("conv_id") * 1000 + turn).alias("message_id"),
        F.col("conv_id").alias("conversation_id"),
        F.col("role").alias("sender_id"),
        (F.lit(EPOCH_MS) + F.col("conv_id") * DAY_MS + turn * 60_000).alias("created_at_ms"),
        F.when(turn % 5 == 4, "media").otherwise("text").alias("kind"),
        F.when(turn % 3 == 2, "remote_archive_only").otherwise("local_plain_available").alias("body_state"),
        F.when(turn % 6 == 5, F.lit(EPOCH_MS) + F.col("conv_id") * DAY_MS).alias("deleted_at_ms"),
        "text",
    )


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    """conversation_id, pinned, scope, tenant_id, community_id, domain_id, last_activity_ms, last_message_id."""
    c = F.col("conversation_id")
    heads = (
        messages(spark, folder)
        .groupBy("conversation_id")
        .agg(F.max("created_at_ms").alias("last_activity_ms"), F.max_by("message_id", "created_at_ms").alias("last_message_id"))
    )
    return heads.select(
        c,
        (c % 7 == 0).alias("pinned"),
        F.when(c % 3 == 0, "b2b").otherwise("b2c").alias("scope"),
        F.concat(F.lit("t"), (c % 4).cast("string")).alias("tenant_id"),
        (c % 10).alias("community_id"),
        (c % 5).alias("domain_id"),
        "last_activity_ms",
        "last_message_id",
    )


def journal(spark: SparkSession, folder: str) -> DataFrame:
    """event_seq, event_type, conversation_id, message_id, created_at_ms."""
    return journal_of(read(spark, folder, "events"))


def journal_of(events: DataFrame) -> DataFrame:
    """The journal view of rows of ``events``, batch or streaming."""
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("event_seq"),
        F.when((kind == "signup") & (k == 0), "conversation_deleted")
        .when(kind == "signup", "conversation_created")
        .when(kind == "click", "message_received")
        .when(kind == "view", "message_edited")
        .when(kind == "error", "message_deleted")
        .when(kind == "purchase", "media_received")
        .alias("event_type"),
        F.col("user_id").alias("conversation_id"),
        k.alias("message_id"),
        # the file's times have no zone: milliseconds as if in UTC
        (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 1000).cast("long").alias("created_at_ms"),
    )


def assets(spark: SparkSession, folder: str) -> DataFrame:
    """asset_id, message_id, conversation_id, mime_type, bytes_local, media_state, archive_state, storage_sink, created_at_ms, pinned."""
    line, orders, customer = (read(spark, folder, t) for t in ("lineitem", "orders", "customer"))
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date"))
    number = F.col("l_linenumber") % 5
    own = line.select(
        F.concat_ws(
            "-",
            *(F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")),
            F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"),
            days.cast("string"),
        ).alias("asset_id"),
        F.col("l_orderkey").alias("message_id"),
        F.when(number == 0, "video/mp4")
        .when(number == 1, "image/jpeg")
        .when(number == 2, "audio/ogg")
        .when(number == 3, "application/pdf")
        .otherwise("image/png")
        .alias("mime_type"),
        (F.col("l_quantity") * 1_048_576).cast("long").alias("bytes_local"),
        F.when(F.col("l_orderkey") % 8 == 0, "download_in_progress")
        .when(F.col("l_orderkey") % 8 == 1, "thumbnail_only")
        .otherwise("original_local")
        .alias("media_state"),
        F.when(F.col("l_returnflag") == "A", "primary_backend").when(F.col("l_returnflag") == "N", "cloud").otherwise("").alias("storage_sink"),
        (days.cast("long") * DAY_MS).alias("created_at_ms"),
    )
    skeleton = orders.select(
        F.col("o_orderkey").alias("message_id"),
        F.col("o_custkey").alias("conversation_id"),
        F.when(F.col("o_orderstatus") == "F", "archive_verified").otherwise("archive_pending").alias("archive_state"),
    )
    heads = customer.select(F.col("c_custkey").alias("conversation_id"), (F.col("c_mktsegment") == "BUILDING").alias("pinned"))
    # messages meet conversations first, so that the assets, of which there are most, are shuffled once
    known = skeleton.join(heads, "conversation_id")
    rest = [c for c in own.columns if c != "message_id"]
    return own.join(known, "message_id").select("conversation_id", "message_id", *rest, "archive_state", "pinned")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """message_id, model_version, embedding."""
    return read(spark, folder, "embeddings").select(
        F.col("vec_id").alias("message_id"), F.concat(F.lit("v"), (F.col("label") % 2).cast("string")).alias("model_version"), "embedding"
    )


def media_index(spark: SparkSession, folder: str) -> DataFrame:
    """asset_id, kind, text."""
    return read(spark, folder, "pages").select(F.col("page_id").alias("asset_id"), F.lit("caption").alias("kind"), F.col("html").alias("text"))


def traces(spark: SparkSession, folder: str) -> DataFrame:
    """operation, duration."""
    return read(spark, folder, "events").select(F.col("event_type").alias("operation"), F.col("value").alias("duration"))
