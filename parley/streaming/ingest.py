"""Messages that arrive as a stream: stored once each, with their events, their conversations' heads and the search index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parley.operators import index, store

#: How long the stream itself remembers an id; what came before is found in the table.
REMEMBERED = "7 days"


def deduplicated(arriving: DataFrame, remembered: str = REMEMBERED) -> DataFrame:
    """A stream of messages without those whose id came within ``remembered``; state is let go after that."""
    timed = arriving.withColumn("event_time", F.timestamp_millis("created_at_ms")).withWatermark("event_time", remembered)
    return timed.dropDuplicatesWithinWatermark(["message_id"]).drop("event_time")


class Sink:
    """Tables of one folder, each in a folder a batch; a batch that is run again changes nothing.

    A batch sees what the batches before it wrote, never its own files, and its index
    generation and manifest are named by its number, so a second run writes the same again.
    """

    def __init__(self, spark: SparkSession, folder: str, columns: str) -> None:
        self.spark, self.folder, self.columns = spark, folder, columns

    def _before(self, name: str, columns: str, epoch: int | None) -> DataFrame:
        """A table's rows of the batches before ``epoch``, or of all."""
        if epoch == 0:
            return self.spark.createDataFrame([], columns)
        rows = self.spark.read.schema(f"{columns}, epoch int").parquet(f"{self.folder}/{name}")
        return (rows if epoch is None else rows.where(F.col("epoch") < epoch)).drop("epoch")

    def write(self, batch: DataFrame, epoch: int) -> None:
        new = store.ingested(self._before("messages", self.columns, epoch), batch)
        self._put(new, "messages", epoch)
        own = self.spark.read.schema(self.columns).parquet(f"{self.folder}/messages/epoch={epoch}")
        events = own.select(F.lit("message_received").alias("event_type"), "conversation_id", "message_id", "created_at_ms")
        self._put(events, "journal", epoch)
        # a batch tells only the heads that it moves
        heads = own.groupBy("conversation_id").agg(F.max_by("message_id", F.struct("created_at_ms", "message_id")).alias("last_message_id"), F.max("created_at_ms").alias("last_activity_ms"))
        self._put(heads, "heads", epoch)
        texts = own.select("message_id", "text")
        if epoch == 0:
            index.build(texts, f"{self.folder}/index")
        else:
            index.added(index.Index(self.spark, f"{self.folder}/index", epoch - 1), texts)

    def _put(self, rows: DataFrame, name: str, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/epoch={epoch}")

    def start(self, arriving: DataFrame, checkpoint: str) -> StreamingQuery:
        """Take in what there is of a stream; batches are numbered from 0 by its checkpoint."""
        own = deduplicated(arriving)
        return own.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    # --- reading

    @property
    def messages(self) -> DataFrame:
        return self._before("messages", self.columns, None)

    @property
    def journal(self) -> DataFrame:
        return self._before("journal", "event_type string, conversation_id long, message_id long, created_at_ms long", None)

    @property
    def heads(self) -> DataFrame:
        """(conversation_id, last_message_id, last_activity_ms): the newest message of each conversation, whenever it came."""
        moved = self._before("heads", "conversation_id long, last_message_id long, last_activity_ms long", None)
        newest = F.struct("last_activity_ms", "last_message_id")
        return moved.groupBy("conversation_id").agg(F.max(newest).alias("h")).select("conversation_id", "h.last_message_id", "h.last_activity_ms")

    def index(self, epoch: int) -> index.Index:
        """The search index after batch ``epoch``."""
        return index.Index(self.spark, f"{self.folder}/index", epoch)

    @property
    def epochs(self) -> int:
        return self.spark.read.parquet(f"{self.folder}/messages").agg(F.max("epoch")).first()[0]
