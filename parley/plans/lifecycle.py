"""Life-cycle queries: which changes each of the five machines allows, and what applying them does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.operators import restore, store
from parley.plans.registry import query
from parley.plans.sql import MSG
from parley.sources import tables

#: Each machine's states, and its legal changes as SQL pairs, as the checks state them.
_STATES = {
    "body": "local_plain_available local_encrypted_available remote_archive_only delivery_store_only deleted_for_me deleted_for_everyone unavailable",
    "media": "thumbnail_only original_local remote_original download_in_progress evicted deleted",
    "archive": "not_archived archive_pending archive_uploaded archive_verified archive_compacted",
    "backup": "not_backed_up backup_pending backup_uploaded backup_manifest_committed backup_expired",
    "restore": "identity_restored root_keys_unwrapped manifest_verified skeleton_restored search_restored recent_messages_restored media_lazy_restore_enabled full_restore_complete",
}
_LEGAL = {
    "body": """('local_plain_available', 'local_encrypted_available'), ('local_encrypted_available', 'local_plain_available'),
('local_plain_available', 'remote_archive_only'), ('remote_archive_only', 'local_plain_available'), ('remote_archive_only', 'unavailable'),
('delivery_store_only', 'local_plain_available'), ('local_plain_available', 'deleted_for_me'), ('local_plain_available', 'deleted_for_everyone')""",
    "media": """('thumbnail_only', 'original_local'), ('thumbnail_only', 'remote_original'), ('original_local', 'evicted'), ('original_local', 'deleted'),
('evicted', 'download_in_progress'), ('remote_original', 'download_in_progress'), ('download_in_progress', 'original_local')""",
    "archive": """('not_archived', 'archive_pending'), ('archive_pending', 'archive_uploaded'), ('archive_uploaded', 'archive_verified'),
('archive_verified', 'archive_compacted')""",
    "backup": """('not_backed_up', 'backup_pending'), ('backup_pending', 'backup_uploaded'), ('backup_uploaded', 'backup_manifest_committed'),
('backup_manifest_committed', 'backup_expired')""",
    "restore": """('identity_restored', 'root_keys_unwrapped'), ('root_keys_unwrapped', 'manifest_verified'), ('manifest_verified', 'skeleton_restored'),
('skeleton_restored', 'search_restored'), ('search_restored', 'recent_messages_restored'), ('recent_messages_restored', 'media_lazy_restore_enabled'),
('media_lazy_restore_enabled', 'full_restore_complete')""",
}


def _machine(machine: str) -> None:
    states = _STATES[machine].split()
    n = len(states)

    def changes(spark: SparkSession, d: str) -> DataFrame:
        """Every pair of the machine's states, dealt to the orders by key."""
        names = F.array(*map(F.lit, states))
        key = F.col("o_orderkey")
        asked = tables.read(spark, d, "orders").select(
            key,
            F.lit(machine).alias("machine"),
            F.element_at(names, (key % n + 1).cast("int")).alias("from_state"),
            F.element_at(names, (F.floor(key / n) % n + 1).cast("int")).alias("to_state"),
        )
        return store.judged(asked).select("o_orderkey", "from_state", "to_state", "legal")

    changes.__name__ = f"{machine}_changes"
    listed = "[" + ", ".join(f"'{s}'" for s in states) + "]"
    query(
        f"""SELECT o_orderkey, from_state, to_state, (from_state, to_state) IN ({_LEGAL[machine]}) AS legal
FROM (SELECT o_orderkey, {listed}[o_orderkey % {n} + 1] AS from_state, {listed}[(o_orderkey // {n}) % {n} + 1] AS to_state FROM orders)"""
    )(changes)


for _name in _STATES:
    _machine(_name)


@query(f"WITH {MSG} SELECT message_id, body_state AS from_state FROM msg WHERE body_state <> 'remote_archive_only'")
def illegal_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Only what is archived remotely can become unavailable."""
    changes = tables.messages(spark, d).select(
        "message_id", F.lit("body").alias("machine"), F.col("body_state").alias("from_state"), F.lit("unavailable").alias("to_state")
    )
    return store.illegal(changes).select("message_id", "from_state")


@query(
    "SELECT o_orderkey AS message_id, CASE WHEN o_orderstatus = 'F' THEN 'archive_verified' ELSE 'archive_uploaded' END AS state, o_orderstatus = 'F' AS refused FROM orders"
)
def archive_states(spark: SparkSession, d: str) -> DataFrame:
    """A batch of legal changes is applied; one with an illegal change isn't."""
    state = F.when(F.col("o_orderstatus") == "F", "archive_verified").otherwise("archive_pending")
    rows = tables.read(spark, d, "orders").select(F.col("o_orderkey").alias("message_id"), state.alias("state"))
    pending, verified = rows.where("state = 'archive_pending'"), rows.where("state = 'archive_verified'")
    asked = rows.select("message_id", F.lit("archive_uploaded").alias("to_state"))
    applied = store.moved(pending, asked, "message_id", "state", "archive")
    refused = store.moved(verified, asked, "message_id", "state", "archive")
    return applied.withColumn("refused", F.lit(False)).unionByName(refused.withColumn("refused", F.lit(True)))


@query(
    """SELECT o_orderkey AS asset_id, CASE WHEN o_orderkey % 3 = 0 THEN 'download_in_progress' ELSE was END AS media_state, o_orderkey % 3 = 0 AND was <> 'evicted' AS refused_was
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'evicted' ELSE 'deleted' END AS was FROM orders)
WHERE NOT (o_orderkey % 3 = 0 AND was = 'deleted')
UNION ALL SELECT o_orderkey, 'deleted', true FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 1"""
)
def media_states(spark: SparkSession, d: str) -> DataFrame:
    """Each asset's own change: evicted ones begin to download, deleted ones can't."""
    key = F.col("o_orderkey")
    rows = tables.read(spark, d, "orders").select(key.alias("asset_id"), F.when(key % 2 == 0, "evicted").otherwise("deleted").alias("media_state"))
    asked = rows.where("asset_id % 3 = 0").select("asset_id", F.lit("download_in_progress").alias("to_state"))
    return store.moved_singly(rows, asked, "asset_id", "media_state", "media").withColumnRenamed("refused", "refused_was")


@query(
    """WITH step AS (SELECT o_custkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq FROM orders),
bad AS (SELECT run, min(CASE WHEN run % 4 = 0 AND seq = 3 THEN seq WHEN seq > 8 THEN seq END) AS first_bad FROM step GROUP BY run)
SELECT run, ['identity_restored', 'root_keys_unwrapped', 'manifest_verified', 'skeleton_restored', 'search_restored', 'recent_messages_restored', 'media_lazy_restore_enabled',
'full_restore_complete'][max(seq) FILTER (seq < coalesce(first_bad, 1000000))] AS state, CAST(count(*) FILTER (seq >= coalesce(first_bad, 1000000)) AS BIGINT) AS refused
FROM step JOIN bad USING (run) GROUP BY run"""
)
def restore_states(spark: SparkSession, d: str) -> DataFrame:
    """How far restore runs get, each step in turn; every fourth run skips one, and none goes on after the last."""
    names = F.array(*map(F.lit, _STATES["restore"].split()))
    orders = tables.read(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("at"))
    place = F.row_number().over(Window.partitionBy("run").orderBy("at"))
    skipped = F.when((F.col("run") % 4 == 0) & (F.col("seq") == 3), F.lit(5)).otherwise(F.least("seq", F.lit(8)))
    steps = orders.withColumn("seq", place).select("run", "seq", F.element_at(names, skipped).alias("to_state"))
    return restore.progress(steps).select("run", "state", "refused")
