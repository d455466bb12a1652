"""A facade over the tables of one folder."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import times
from parley.operators import cold, index, journal, offload, restore, search, store
from parley.operators.cold import Policy
from parley.operators.search import SearchQuery
from parley.sources import tables
from parley.sources.shared import stored as stored_table


DEFAULT_POLICY = Policy()


class Engine:
    """Search, timelines, retention and restore over a folder of Parquet tables.

    Every method returns a DataFrame and starts no job unless it says so.  With a stored
    ``index`` local searches read its postings instead of the texts, and the changes of
    :meth:`take_in`, :meth:`change` and :meth:`drop` reach it.
    """

    def __init__(self, spark: SparkSession, folder: str, cold_path: str | None = None, stored: index.Index | None = None) -> None:
        self.spark, self.folder, self.cold_path, self.index = spark, folder, cold_path, stored

    def build_index(self, path: str) -> None:
        """Index the messages in a folder; runs jobs."""
        self.index = index.build(self.messages.select("message_id", "text"), path)

    @cached_property
    def messages(self) -> DataFrame:
        return tables.messages(self.spark, self.folder)

    @cached_property
    def conversations(self) -> DataFrame:
        return tables.conversations(self.spark, self.folder)

    @cached_property
    def cold(self) -> DataFrame:
        """The cold tier: month partitions if a path was given, else the archived messages."""
        if self.cold_path:
            return cold.read(self.spark, self.cold_path)
        own = self.messages.where("body_state = 'remote_archive_only'")
        return own.withColumn("time_bucket", times.month_bucket(F.col("created_at_ms")))

    def search(
        self,
        query: SearchQuery,
        limit: int = 200,
        include_cold: bool = False,
        policy: Policy = DEFAULT_POLICY,
        resolver: dict[str, DataFrame] | None = None,
        vector: list[float] | None = None,
    ) -> DataFrame:
        """Ranked messages; a target's conversations bound both tiers, a vector adds meaning."""
        allowed = search.target_conversations(self.conversations, query.target, resolver)
        hot = search.in_target(self.messages, allowed)
        if vector is not None and include_cold:
            local = hot.where("body_state = 'local_plain_available'")
            return cold.with_semantic(local, search.in_target(self.cold, allowed), tables.vectors(self.spark, self.folder), query, vector, policy, limit)
        if vector is not None:
            hits = index.lexical(self.index, search.filtered(hot, query), query.text) if self.index else None
            return search.with_semantic(hot, tables.vectors(self.spark, self.folder), query, vector, limit, hits)
        if include_cold and query.text.strip():
            return cold.hot_and_cold(hot.where("body_state = 'local_plain_available'"), search.in_target(self.cold, allowed), query, policy, limit)
        return index.hybrid(self.index, hot, query, limit) if self.index else search.hybrid(hot, query, limit)

    def take_in(self, arriving: DataFrame) -> None:
        """Add what :meth:`ingest` takes of ``arriving`` to the messages and the index; runs jobs."""
        new = stored_table(self.ingest(arriving), "engine-new")
        self._become(self.messages.unionByName(new, allowMissingColumns=True), new.where(F.lit(False)), new)

    def change(self, edits: DataFrame) -> None:
        """Make ``edits`` in the messages and the index; runs jobs."""
        asked = edits.select("message_id").distinct()
        after = stored_table(self.edit(edits), "engine-edited")
        self._become(after, self.messages.join(asked, "message_id", "left_semi"), after.join(asked, "message_id", "left_semi"))

    def drop(self, deletions: DataFrame, now_ms: int) -> None:
        """Make ``deletions`` in the messages, and take those that were made from the index; runs jobs."""
        judged = stored_table(self.delete(deletions, now_ms), "engine-deleted")
        asked = deletions.select("message_id").distinct()
        gone = self.messages.join(judged.where("not refused").join(asked, "message_id", "left_semi"), "message_id", "left_semi")
        self._become(judged.drop("refused"), gone, gone.where(F.lit(False)))

    def _become(self, messages: DataFrame, before: DataFrame, after: DataFrame) -> None:
        if self.index:
            own = ("message_id", "text")
            self.index = index.changed(self.index, before.select(*own), after.select(*own))
        self.messages = messages

    def search_progressively(self, query: SearchQuery, policy: Policy = DEFAULT_POLICY, limit: int = 200) -> Iterator[tuple[str, DataFrame]]:
        """Local results, each cold month's and the merged ones; lists the months with one job."""
        return cold.progressive(self.messages.where("body_state = 'local_plain_available'"), self.cold, query, policy, limit)

    def get_message(self, message_id: object) -> DataFrame:
        return self.messages.where(F.col("message_id") == F.lit(message_id))

    def get_conversation(self, conversation: object) -> DataFrame:
        return self.conversations.where(F.col("conversation_id") == F.lit(conversation))

    def timeline(self, conversation: object, before_ms: int | None = None, limit: int = 50, after_id: object = None) -> DataFrame:
        return store.timeline(self.messages, conversation, before_ms, limit, after_id)

    def edit(self, edits: DataFrame) -> DataFrame:
        """The messages after ``edits``; their vectors are to be dropped."""
        return store.edited(self.messages, edits)

    def delete(self, deletions: DataFrame, now_ms: int) -> DataFrame:
        """The messages after ``deletions``; see :func:`.store.deletion_events` for the journal's part."""
        return store.deleted(self.messages, deletions, now_ms)

    def pin(self, updates: DataFrame) -> DataFrame:
        return store.pinned(self.conversations, updates)

    def hydrate(self, results: DataFrame, now_ms: int) -> DataFrame:
        """The hydration queue for the cold ones of search ``results``."""
        return store.hydration_queue(store.cold_requests(results, now_ms))

    def compaction_plan(self, now_ms: int) -> DataFrame:
        return journal.compaction_plan(journal.daily_segments(tables.journal(self.spark, self.folder)), now_ms)

    def list_conversations(self) -> DataFrame:
        return store.conversation_list(self.conversations)

    def ingest(self, arriving: DataFrame) -> DataFrame:
        """The arriving messages to append."""
        return store.ingested(self.messages, arriving)

    def without_conversation(self, conversation: object) -> dict[str, DataFrame]:
        return store.cascade({"messages": self.messages, "conversations": self.conversations}, conversation)

    def storage_usage(self) -> DataFrame:
        own = (tables.assets, tables.vectors, tables.media_index)
        assets, vectors, media = (read(self.spark, self.folder) for read in own)
        return offload.usage(assets, self.messages, search.gram_bytes(self.messages, offload.GRAM_BYTES), vectors, media)

    def eviction_plan(self, target_bytes: int, now_ms: int, least_age_ms: int, level: str = "extreme") -> DataFrame:
        """What to evict, cloud pool first; runs jobs for the score ranges and the first pool's bytes."""
        found = offload.candidates(tables.assets(self.spark, self.folder), now_ms, least_age_ms)
        return offload.tiered(offload.scored(found, now_ms), target_bytes, level)

    def restore(self, now_ms: int, window_ms: int, compat: bool = False) -> DataFrame:
        return restore.restored(tables.journal(self.spark, self.folder), now_ms, window_ms, compat)
