"""Restore: skeletons, recent bodies and conversations out of backup events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.operators import journal, store

DAY_MS = 86_400_000


def skeletons(events: DataFrame) -> DataFrame:
    """One remote skeleton for each received message with both ids."""
    received = events.where("event_type = 'message_received' and conversation_id is not null and message_id is not null")
    first = received.groupBy("conversation_id", "message_id").agg(F.min("created_at_ms").alias("created_at_ms"))
    return first.withColumn("body_state", F.lit("remote_archive_only"))


def recent(found: DataFrame, now_ms: int, window_ms: int) -> DataFrame:
    """Skeletons inside the window, whose bodies are restored at once."""
    return found.where(F.col("created_at_ms") >= now_ms - window_ms).withColumn("body_state", F.lit("local_plain_available"))


def conversations(events: DataFrame) -> DataFrame:
    return events.where("conversation_id is not null").select("conversation_id").distinct()


def timeline(*segments: DataFrame) -> DataFrame:
    """The events of all segments by time, then sequence."""
    out = segments[0]
    for one in segments[1:]:
        out = out.unionByName(one)
    return out.orderBy("created_at_ms", "event_seq")


def restored(events: DataFrame, now_ms: int, window_ms: int, compat: bool = False) -> DataFrame:
    """Skeletons after tombstones, recent ones with local bodies; ``compat`` skips the tombstones."""
    own = skeletons(events if compat else journal.backup_survivors(events))
    state = F.when(F.col("created_at_ms") >= now_ms - window_ms, "local_plain_available").otherwise(F.col("body_state"))
    return own.withColumn("body_state", state)


#: Kinds of index shards whose rows are replayed; those of vectors, media and bloom filters count as none.
REPLAYED = ("text", "fuzzy")


def replayed(indexes: dict[str, DataFrame], shards: dict[str, DataFrame], keys: dict[str, list[str]]) -> dict[str, DataFrame]:
    """The ``indexes`` with the rows of ``shards`` of the same kind that aren't there by their ``keys``, each once."""
    out = dict(indexes)
    for kind, rows in shards.items():
        if kind in REPLAYED:
            new = rows.dropDuplicates(keys[kind]).join(indexes[kind].select(*keys[kind]), keys[kind], "left_anti")
            out[kind] = indexes[kind].unionByName(new)
    return out


def replay_summary(shards: dict[str, DataFrame]) -> DataFrame:
    """(index_type, rows_inserted) of a replay."""
    counts = [df.agg(F.lit(kind).alias("index_type"), (F.count("*") if kind in REPLAYED else F.lit(0).cast("long")).alias("rows_inserted")) for kind, df in shards.items()]
    out = counts[0]
    for one in counts[1:]:
        out = out.unionByName(one)
    return out


FIRST_STATE = "identity_restored"


def progress(steps: DataFrame) -> DataFrame:
    """(run, state, refused) of the ``steps`` (run, seq, to_state) that each restore run asks for, in order.

    A run begins with identity_restored and each step must be a legal change; the first
    illegal one ends it, and that and all later ones are refused.  A run that begins
    wrongly has no state.
    """
    before = Window.partitionBy("run").orderBy("seq")
    seen = steps.withColumn("from_state", F.lag("to_state").over(before)).withColumn("machine", F.lit("restore"))
    first = F.col("from_state").isNull() & (F.col("to_state") == FIRST_STATE)
    judged = store.judged(seen).withColumn("ok", first | F.col("legal"))
    bounds = judged.groupBy("run").agg(F.min(F.when(~F.col("ok"), F.col("seq"))).alias("first_bad"))
    joined = judged.join(bounds, "run")
    done = F.col("first_bad").isNull() | (F.col("seq") < F.col("first_bad"))
    return joined.groupBy("run").agg(
        F.max_by(F.when(done, F.col("to_state")), F.when(done, F.col("seq"))).alias("state"), F.count(F.when(~done, 1)).alias("refused")
    )
