"""Reads and changes of the message tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions.numbers import chunk_count

#: The legal changes of each life cycle.
TRANSITIONS = {
    "body": [
        ("local_plain_available", "local_encrypted_available"),
        ("local_encrypted_available", "local_plain_available"),
        ("local_plain_available", "remote_archive_only"),
        ("remote_archive_only", "local_plain_available"),
        ("local_plain_available", "deleted_for_me"),
        ("local_plain_available", "deleted_for_everyone"),
        ("delivery_store_only", "local_plain_available"),
        ("remote_archive_only", "unavailable"),
    ],
    "media": [
        ("thumbnail_only", "original_local"),
        ("thumbnail_only", "remote_original"),
        ("original_local", "evicted"),
        ("original_local", "deleted"),
        ("evicted", "download_in_progress"),
        ("remote_original", "download_in_progress"),
        ("download_in_progress", "original_local"),
    ],
    "archive": [
        ("not_archived", "archive_pending"),
        ("archive_pending", "archive_uploaded"),
        ("archive_uploaded", "archive_verified"),
        ("archive_verified", "archive_compacted"),
    ],
    "backup": [
        ("not_backed_up", "backup_pending"),
        ("backup_pending", "backup_uploaded"),
        ("backup_uploaded", "backup_manifest_committed"),
        ("backup_manifest_committed", "backup_expired"),
    ],
    "restore": [
        ("identity_restored", "root_keys_unwrapped"),
        ("root_keys_unwrapped", "manifest_verified"),
        ("manifest_verified", "skeleton_restored"),
        ("skeleton_restored", "search_restored"),
        ("search_restored", "recent_messages_restored"),
        ("recent_messages_restored", "media_lazy_restore_enabled"),
        ("media_lazy_restore_enabled", "full_restore_complete"),
    ],
}
#: Why a body is hydrated, most urgent first.
REASONS = ("search_result_tap", "media_full_screen", "visible_viewport", "adjacent_prefetch", "background_restore", "opportunistic_fill")


def timeline(messages: DataFrame, conversation: object, before_ms: int | None, limit: int, after_id: object = None) -> DataFrame:
    """A page of a conversation, newest first, older than ``before_ms`` if given.

    With ``after_id`` too, messages of exactly ``before_ms`` with larger ids belong to the
    page, so that those that tie with the last one of a page come with the next.
    """
    own = messages.where(F.col("conversation_id") == F.lit(conversation))
    if before_ms is not None:
        older = F.col("created_at_ms") < before_ms
        own = own.where(older if after_id is None else older | ((F.col("created_at_ms") == before_ms) & (F.col("message_id") > F.lit(after_id))))
    return own.orderBy(F.desc("created_at_ms"), "message_id").limit(limit)


def conversation_list(conversations: DataFrame) -> DataFrame:
    return conversations.orderBy(F.desc("pinned"), F.desc("last_activity_ms"), "conversation_id")


def validated(messages: DataFrame) -> DataFrame:
    """Messages with ``rejected``: why one can't be taken in, or null."""
    reason = (
        F.when(F.col("message_id").isNull() | F.col("conversation_id").isNull(), "no id")
        .when(F.coalesce(F.length(F.trim("sender_id")), F.lit(0)) == 0, "no sender")
        .when(F.coalesce(F.col("created_at_ms"), F.lit(0)) <= 0, "no time")
        .when((F.coalesce(F.length("text"), F.lit(0)) == 0) & (F.col("kind") != "media"), "no content")
    )
    return messages.withColumn("rejected", reason)


def ingested(existing: DataFrame, arriving: DataFrame) -> DataFrame:
    """Valid arriving messages that aren't stored yet, each id once, the earliest."""
    valid = validated(arriving).where("rejected is null").drop("rejected")
    first = valid.groupBy("message_id").agg(F.min_by(F.struct(*valid.columns), F.struct("created_at_ms", "conversation_id")).alias("m")).select("m.*")
    return first.join(existing.select("message_id"), "message_id", "left_anti").select(*arriving.columns)


def ingest_report(existing: DataFrame, arriving: DataFrame) -> DataFrame:
    """One row: how many arriving messages are new, duplicate or rejected."""
    judged = validated(arriving).join(existing.select("message_id", F.lit(True).alias("known")).distinct(), "message_id", "left")
    ok = F.col("rejected").isNull()
    return judged.agg(
        F.count_distinct(F.when(ok & F.col("known").isNull(), F.col("message_id"))).alias("new"),
        F.count(F.when(ok & F.col("known").isNotNull(), 1)).alias("duplicate"),
        F.count(F.when(~ok, 1)).alias("rejected"),
    )


def edited(messages: DataFrame, edits: DataFrame) -> DataFrame:
    """Messages after the last of their ``edits`` (message_id, new_text, edited_at_ms, seq)."""
    last = edits.groupBy("message_id").agg(F.max_by(F.struct("new_text", "edited_at_ms"), "seq").alias("e"))
    joined = messages.join(last, "message_id", "left")
    return joined.withColumn("text", F.coalesce("e.new_text", "text")).withColumn("edited_at_ms", F.col("e.edited_at_ms")).drop("e")


def without_deleted(rows: DataFrame, tombstones: DataFrame, key: str = "message_id") -> DataFrame:
    return rows.join(tombstones.select(key).distinct(), key, "left_anti")


def stamped(messages: DataFrame, marks: DataFrame, column: str) -> DataFrame:
    """``messages`` with the latest of ``marks`` (message_id, at_ms) in ``column``, edited_at_ms or deleted_at_ms; it never goes back."""
    last = marks.groupBy("message_id").agg(F.max("at_ms").alias("mark_at_ms"))
    joined = messages.join(last, "message_id", "left")
    return joined.withColumn(column, F.greatest(F.col(column), F.col("mark_at_ms"))).drop("mark_at_ms")


def with_skeletons(messages: DataFrame, arriving: DataFrame) -> DataFrame:
    """``messages`` and those ``arriving`` skeletons whose id isn't stored, each once, without bodies; stored ones stay as they are."""
    first = arriving.groupBy("message_id").agg(F.min_by(F.struct(*arriving.columns), F.struct("created_at_ms", "conversation_id")).alias("m")).select("m.*")
    new = first.join(messages.select("message_id"), "message_id", "left_anti").withColumn("body_state", F.lit("remote_archive_only"))
    return messages.unionByName(new, allowMissingColumns=True)


def new_media_rows(index: DataFrame, arriving: DataFrame) -> DataFrame:
    """The ``arriving`` rows of the media index whose (asset_id, kind, text) isn't there yet, each once."""
    key = ["asset_id", "kind", "text"]
    return arriving.dropDuplicates(key).join(index.select(*key), key, "left_anti")


def outbound(messages: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(rows, events) to append for own ``messages``: valid ones as local and not archived, and a journal event each."""
    valid = validated(messages).where("rejected is null").drop("rejected").dropDuplicates(["message_id"])
    rows = valid.withColumn("body_state", F.lit("local_plain_available")).withColumn("archive_state", F.lit("not_archived"))
    return rows, valid.select(F.lit("message_received").alias("event_type"), "conversation_id", "message_id", F.lit(now_ms).cast("long").alias("created_at_ms"))


def sent_events(messages: DataFrame, sent: DataFrame, now_ms: int) -> DataFrame:
    """A journal event outbox_sent for each of the ``sent`` ids (message_id) that is stored; a body's state doesn't change."""
    known = messages.join(sent.select("message_id").distinct(), "message_id", "left_semi")
    return known.select(F.lit("outbox_sent").alias("event_type"), "conversation_id", "message_id", F.lit(now_ms).cast("long").alias("created_at_ms"))


#: Columns by which a table belongs to conversations, messages or assets.
OWNERS = ("conversation_id", "message_id", "asset_id")


def cascade(tables: dict[str, DataFrame], conversation: object) -> dict[str, DataFrame]:
    """Every table without a conversation's rows, those of its messages and of their assets.

    A table without a column of OWNERS stays as it is.  ``messages`` must be there;
    ``assets``, if there, says which assets are a message's.
    """
    messages = tables["messages"].where(F.col("conversation_id") == F.lit(conversation)).select("message_id")
    assets = tables["assets"].join(messages, "message_id", "left_semi").select("asset_id") if "assets" in tables else None
    out = {}
    for name, df in tables.items():
        if "conversation_id" in df.columns:
            out[name] = df.where(~F.col("conversation_id").eqNullSafe(F.lit(conversation)))
        elif "message_id" in df.columns:
            out[name] = df.join(messages, "message_id", "left_anti")
        elif "asset_id" in df.columns and assets is not None:
            out[name] = df.join(assets, "asset_id", "left_anti")
        else:
            out[name] = df
    return out


def heads(conversations: DataFrame, events: DataFrame) -> DataFrame:
    """Conversation heads after ``events`` (conversation_id, message_id, created_at_ms); late ones move nothing."""
    last = events.groupBy("conversation_id").agg(F.max_by("message_id", F.struct("created_at_ms", "message_id")).alias("m"), F.max("created_at_ms").alias("at"))
    joined = conversations.join(last, "conversation_id", "left")
    moves = F.col("at") >= F.coalesce(F.col("last_activity_ms"), F.lit(0))
    return (
        joined.withColumn("last_message_id", F.when(moves, F.col("m")).otherwise(F.col("last_message_id")))
        .withColumn("last_activity_ms", F.when(moves, F.col("at")).otherwise(F.col("last_activity_ms")))
        .drop("m", "at")
    )


def rehydrated(bodies: DataFrame, fetched: DataFrame) -> DataFrame:
    """Bodies with fetched ones (message_id, text) in their place, local.

    Only bodies that may become local do: one that was deleted doesn't come back, and one
    that is local stays.  Ids that aren't stored add nothing; :func:`unknown` tells them.
    Of several texts for an id the greatest counts.
    """
    one = fetched.where("text is not null").groupBy("message_id").agg(F.max("text").alias("new_text"))
    may = [a for a, b in TRANSITIONS["body"] if b == "local_plain_available" and a != "local_encrypted_available"]
    joined = bodies.join(one, "message_id", "left")
    came = F.col("new_text").isNotNull() & F.col("body_state").isin(may)
    return joined.select(
        "message_id", F.when(came, F.col("new_text")).otherwise(F.col("text")).alias("text"), F.when(came, "local_plain_available").otherwise(F.col("body_state")).alias("body_state")
    )


def unknown(rows: DataFrame, asked: DataFrame, key: str = "message_id") -> DataFrame:
    """The different keys of ``asked`` that ``rows`` doesn't have."""
    return asked.select(key).distinct().join(rows.select(key), key, "left_anti")


def transitions(spark: SparkSession) -> DataFrame:
    rows = [(m, a, b) for m, pairs in TRANSITIONS.items() for a, b in pairs]
    return spark.createDataFrame(rows, "machine string, from_state string, to_state string")


def illegal(changes: DataFrame) -> DataFrame:
    """Changes (machine, from_state, to_state, ...) that no life cycle allows."""
    return changes.join(F.broadcast(transitions(changes.sparkSession)), ["machine", "from_state", "to_state"], "left_anti")


def hydration_queue(requests: DataFrame) -> DataFrame:
    """Requests (message_id, reason, requested_at_ms): each message once with its most urgent reason, most urgent first."""
    urgency = F.lit(len(REASONS))
    for k, reason in enumerate(REASONS):
        urgency = F.when(F.col("reason") == reason, k).otherwise(urgency)
    own = requests.withColumn("urgency", urgency)
    best = Window.partitionBy("message_id").orderBy("urgency", "requested_at_ms")
    first = own.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")
    return first.orderBy("urgency", "requested_at_ms", "message_id")


def cold_requests(results: DataFrame, now_ms: int, reason: str = REASONS[0]) -> DataFrame:
    """A hydration request for each of the search ``results`` that is cold."""
    cold = results.where("is_cold")
    return cold.select("message_id", "conversation_id", F.lit(reason).alias("reason"), F.lit(now_ms).cast("long").alias("requested_at_ms"))


def enqueued(queue: DataFrame, requests: DataFrame) -> DataFrame:
    """The queue after further ``requests``: each message once, with its most urgent reason."""
    return hydration_queue(queue.unionByName(requests, allowMissingColumns=True))


def dequeued(queue: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(taken, left): the ``n`` most urgent requests of a queue, and the queue without them."""
    taken = queue.orderBy("urgency", "requested_at_ms", "message_id").limit(n)
    return taken, removed(queue, taken)


def removed(queue: DataFrame, gone: DataFrame) -> DataFrame:
    return queue.join(gone.select("message_id").distinct(), "message_id", "left_anti")


def touched(entries: DataFrame, uses: DataFrame) -> DataFrame:
    """Cache entries (key, size, last_used) after ``uses`` of the same columns: inserted or used again, the last use counts."""
    both = entries.unionByName(uses)
    return both.groupBy("key").agg(F.max_by("size", "last_used").alias("size"), F.max("last_used").alias("last_used"))


def _deletions(messages: DataFrame, deletions: DataFrame) -> DataFrame:
    """``messages`` with ``to_state``, what ``deletions`` ask for, and whether that is ``bad``."""
    everywhere = F.bool_or(F.coalesce("for_everyone", F.lit(False)))
    state = F.when(everywhere, "deleted_for_everyone").otherwise("deleted_for_me")
    return _asked(messages, deletions.groupBy("message_id").agg(state.alias("to_state")), "message_id", "body_state", "body")


def deleted(messages: DataFrame, deletions: DataFrame, now_ms: int) -> DataFrame:
    """Messages after ``deletions`` (message_id, for_everyone), with ``refused``: whether one was asked for that the body's life cycle forbids.

    A deletion for oneself keeps the body, one for everyone drops it; both stamp
    deleted_at_ms.  Of several deletions of a message in a batch the stronger one holds; a
    null counts as one's own.
    """
    joined = _deletions(messages, deletions)
    done = F.col("to_state").isNotNull() & ~F.col("bad")
    changes = {
        "text": F.when(done & (F.col("to_state") == "deleted_for_everyone"), F.lit(None)).otherwise(F.col("text")),
        "deleted_at_ms": F.when(done, F.lit(now_ms).cast("long")).otherwise(F.col("deleted_at_ms")),
        "body_state": F.when(done, F.col("to_state")).otherwise(F.col("body_state")),
    }
    return joined.withColumns(changes).select(*messages.columns, F.col("bad").alias("refused"))


def deletion_events(messages: DataFrame, deletions: DataFrame, now_ms: int) -> DataFrame:
    """The journal's events of those ``deletions`` that :func:`deleted` makes, with their scope."""
    done = _deletions(messages, deletions).where("to_state is not null and not bad")
    scope = F.when(F.col("to_state") == "deleted_for_everyone", "for_everyone").otherwise("for_me")
    return done.select(
        F.lit("message_deleted").alias("event_type"), "conversation_id", "message_id", F.lit(now_ms).cast("long").alias("created_at_ms"), scope.alias("scope")
    )


def pinned(conversations: DataFrame, updates: DataFrame, flag: str = "pinned") -> DataFrame:
    """Conversations after ``updates`` (conversation_id, pinned or muted, seq) of that ``flag``; the last of each holds."""
    last = updates.groupBy("conversation_id").agg(F.max_by(flag, "seq").alias("new_flag"))
    joined = conversations.join(last, "conversation_id", "left")
    return joined.withColumn(flag, F.coalesce("new_flag", flag)).drop("new_flag")


def muted(conversations: DataFrame, updates: DataFrame) -> DataFrame:
    return pinned(conversations, updates, "muted")


def judged(changes: DataFrame) -> DataFrame:
    """``changes`` (machine, from_state, to_state, ...) with ``legal``, whether the life cycle allows each."""
    allowed = transitions(changes.sparkSession).withColumn("legal", F.lit(True))
    joined = changes.join(F.broadcast(allowed), ["machine", "from_state", "to_state"], "left")
    return joined.withColumn("legal", F.coalesce("legal", F.lit(False)))


def _asked(rows: DataFrame, changes: DataFrame, key: str, state: str, machine: str) -> DataFrame:
    """``rows`` with ``to_state``, if asked for, and ``bad``, whether the life cycle forbids it or a batch asks for several states of one row."""
    asked = changes.groupBy(key).agg(F.min("to_state").alias("to_state"), (F.min("to_state") != F.max("to_state")).alias("several"))
    legal = transitions(rows.sparkSession).where(F.col("machine") == machine).select(F.col("from_state").alias(state), "to_state", F.lit(True).alias("legal"))
    joined = rows.join(asked, key, "left").join(F.broadcast(legal), [state, "to_state"], "left")
    return joined.withColumn("bad", F.col("to_state").isNotNull() & (F.col("legal").isNull() | F.col("several"))).drop("legal", "several")


def moved(rows: DataFrame, changes: DataFrame, key: str, state: str, machine: str) -> DataFrame:
    """``rows`` with ``changes`` (key, to_state) of one life cycle, all of them or, if any is illegal, none."""
    joined = _asked(rows, changes, key, state, machine)
    verdict = joined.agg(F.count(F.when(F.col("bad"), 1)).alias("illegal_changes"))  # one row
    applied = F.when(F.col("illegal_changes") == 0, F.coalesce("to_state", state)).otherwise(F.col(state))
    return joined.crossJoin(F.broadcast(verdict)).withColumn(state, applied).select(*rows.columns)


def moved_singly(rows: DataFrame, changes: DataFrame, key: str, state: str, machine: str) -> DataFrame:
    """``rows`` with each legal one of ``changes`` (key, to_state) made; ``refused`` says which rows stay for an illegal one."""
    joined = _asked(rows, changes, key, state, machine)
    return joined.withColumn(state, F.when(F.col("bad"), F.col(state)).otherwise(F.coalesce("to_state", state))).select(*rows.columns, F.col("bad").alias("refused"))


def media_summary(assets: DataFrame) -> DataFrame:
    """For each message with media: its first asset by id, how many it has, and their bytes and chunks."""
    return assets.groupBy("message_id").agg(
        F.min("asset_id").alias("first_asset_id"),
        F.count("*").alias("assets"),
        F.sum("bytes_local").alias("bytes"),
        F.sum(chunk_count(F.col("bytes_local"))).alias("chunks"),
    )


#: States in which an original can be fetched.
FETCHABLE = ("evicted", "remote_original")
ROOT_BYTES = 32


def rehydration_plan(assets: DataFrame, wanted: DataFrame) -> DataFrame:
    """What to fetch for the ``wanted`` assets (asset_id): asset_id, from_state, chunks, and ``refused``, why it can't be, or null."""
    # whether there is a root is all that the shuffle takes of it
    rooted = F.coalesce(F.octet_length("merkle_root") == ROOT_BYTES, F.lit(False))
    known = wanted.select("asset_id").distinct().join(assets.select("asset_id", "media_state", "bytes_total", rooted.alias("rooted")), "asset_id", "left")
    refused = (
        F.when(F.col("media_state").isNull(), "no such asset")
        .when(F.col("media_state") == "original_local", "already local")
        .when(~F.col("media_state").isin(*FETCHABLE), "not fetchable")
        .when(~F.coalesce("rooted", F.lit(False)), "no root")
    )
    return known.select("asset_id", F.col("media_state").alias("from_state"), chunk_count(F.col("bytes_total")).alias("chunks"), refused.alias("refused"))


def rehydrated_media(assets: DataFrame, fetched: DataFrame) -> DataFrame:
    """Assets after ``fetched`` ones (asset_id, local_path) came: local originals with all their bytes."""
    joined = assets.join(fetched.select("asset_id", F.col("local_path").alias("new_path")), "asset_id", "left")
    came = F.col("new_path").isNotNull() & F.col("media_state").isin(*FETCHABLE, "download_in_progress")
    return (
        joined.withColumn("bytes_local", F.when(came, F.col("bytes_total")).otherwise(F.col("bytes_local")))
        .withColumn("local_path", F.when(came, F.col("new_path")).otherwise(F.col("local_path")))
        .withColumn("media_state", F.when(came, "original_local").otherwise(F.col("media_state")))
        .drop("new_path")
    )


def prefetch_window(messages: DataFrame, conversation: object, visible: list, size: int, now_ms: int) -> DataFrame:
    """Hydration requests for the remote ones of the ``size`` messages before and after the ``visible`` ones."""
    own = messages.where(F.col("conversation_id") == F.lit(conversation))
    place = F.struct("created_at_ms", "message_id")
    bounds = own.where(F.col("message_id").isin(visible)).agg(F.min(place).alias("low"), F.max(place).alias("high"))
    placed = own.crossJoin(F.broadcast(bounds))  # one row
    older = placed.where(place < F.col("low")).orderBy(F.desc("created_at_ms"), F.desc("message_id")).limit(size)
    newer = placed.where(place > F.col("high")).orderBy("created_at_ms", "message_id").limit(size)
    near = older.unionByName(newer).where("body_state = 'remote_archive_only'")
    return near.select("message_id", F.lit("adjacent_prefetch").alias("reason"), F.lit(now_ms).cast("long").alias("requested_at_ms"))
