"""Storage budgets: usage, pressure, eviction candidates and greedy plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import content_kind
from parley.sources.shared import stored

MIB = 1 << 20
HALF_LIFE_MS = 30 * 86_400_000
#: How readily a kind is evicted.
KIND_WEIGHTS = {"video": 1.0, "document": 0.9, "image": 0.7, "audio": 0.5, "thumbnail": 0.3, "text": 0.1}
#: Percent of the budget above which a level begins.
LEVELS = (("extreme", 100), ("critical", 90), ("warning", 75))
#: Kinds that may be evicted at a level; under no pressure none may.
ELIGIBLE = {
    "warning": ("video", "document", "image", "audio"),
    "critical": ("video", "document", "image", "audio", "thumbnail"),
    "extreme": ("video", "document", "image", "audio", "thumbnail", "text"),
}


#: About so many rows of a running sum are sorted by one task.
RANGE_ROWS = 1_000_000


#: Bytes counted for a message's skeleton, and beside each n-gram of the index.
SKELETON_BYTES, GRAM_BYTES = 256, 8


def usage(assets: DataFrame, messages: DataFrame, grams: DataFrame, vectors: DataFrame, media_index: DataFrame) -> DataFrame:
    """One row of byte sums: messages (bodies and skeletons), media, index (texts, n-grams, vectors, media texts), cache, total.

    ``grams`` is what :func:`parley.operators.search.gram_bytes` gives with GRAM_BYTES.
    Lengths of texts are in characters and of vectors in bytes of 32-bit numbers; an
    empty table counts 0, and nothing is cached outside Spark.
    """

    def total(df: DataFrame, size: Column, name: str) -> DataFrame:
        return df.agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias(name))

    body = F.length("text").cast("long")
    # one row each
    sums = messages.agg(F.coalesce(F.sum(body), F.lit(0)).cast("long").alias("body_bytes"), (F.count("*") * SKELETON_BYTES).alias("skeleton_bytes"))
    for part in (
        total(assets, F.col("bytes_local"), "media_bytes"),
        total(grams, F.col("bytes"), "fuzzy_bytes"),
        total(vectors, 4 * F.array_size("embedding"), "vector_bytes"),
        total(media_index, F.length("text"), "media_text_bytes"),
    ):
        sums = sums.crossJoin(part)
    message = F.col("body_bytes") + F.col("skeleton_bytes")
    index = F.col("body_bytes") + F.col("fuzzy_bytes") + F.col("vector_bytes") + F.col("media_text_bytes")
    return sums.select(
        (message + F.col("media_bytes") + index).alias("total_bytes"),
        message.alias("message_bytes"),
        "media_bytes",
        index.alias("index_bytes"),
        F.lit(0).cast("long").alias("cache_bytes"),
    )


def threshold(level: str, budget: int) -> int:
    return budget * dict(LEVELS)[level] // 100


def pressure(total: Column, budget: int) -> Column:
    """The highest level whose threshold the total is strictly above, else normal."""
    found = F.lit("normal")
    for level, _ in reversed(LEVELS):
        found = F.when(total > threshold(level, budget), level).otherwise(found)
    return found


def eviction_target(total: Column, level: Column, budget: int) -> Column:
    """Bytes above the level's threshold."""
    found = F.lit(0).cast("long")
    for name, _ in LEVELS:
        found = F.when(level == name, F.greatest(total - threshold(name, budget), F.lit(0))).otherwise(found)
    return found


def headroom(total: Column, budget: int) -> Column:
    return F.greatest(F.lit(budget) - total, F.lit(0))


def candidates(assets: DataFrame, now_ms: int, least_age_ms: int) -> DataFrame:
    """Verified, unpinned assets whose original is local and that are old enough, with their content kind; half-loaded ones don't go."""
    old = F.lit(now_ms) - F.col("created_at_ms") >= least_age_ms
    kept = assets.where(~F.col("pinned") & (F.col("archive_state") == "archive_verified") & (F.col("media_state") == "original_local") & (F.col("bytes_local") > 0) & old)
    return kept.withColumn("kind", content_kind(F.col("mime_type")))


def score(kind: Column, created_at_ms: Column, size: Column, pinned: Column, now_ms: int) -> Column:
    """Kind weight + half of what age has decayed + a tenth for each 16 MiB; pinned ones minus infinity."""
    weight = F.lit(0.1)
    for name, value in KIND_WEIGHTS.items():
        weight = F.when(kind == name, value).otherwise(weight)
    age = F.greatest(F.lit(now_ms) - created_at_ms, F.lit(0)) / HALF_LIFE_MS
    value = weight + 0.5 * (1 - F.pow(F.lit(0.5), age)) + 0.1 * size / (16 * MIB)
    return F.when(pinned, F.lit(float("-inf"))).otherwise(value)


def scored(found: DataFrame, now_ms: int) -> DataFrame:
    return found.withColumn("score", score(F.col("kind"), F.col("created_at_ms"), F.col("bytes_local"), F.col("pinned"), now_ms))


def eligible(kind: Column, level: str) -> Column:
    return kind.isin(*ELIGIBLE.get(level, ()))


def tier(sink: Column) -> Column:
    """What a sink allows: full eviction from the primary one or none, else offload to the cloud."""
    return F.when(sink.isNull() | sink.isin("", "primary_backend"), "full_eviction").otherwise("cloud_offload")


def greedy(found: DataFrame, target: int, level: str = "extreme", pool: str | None = None) -> DataFrame:
    """Candidates by score, then id, taken until their bytes reach ``target``, the crossing one included."""
    own = found.where(eligible(F.col("kind"), level))
    if pool:
        own = own.where(tier(F.col("storage_sink")) == pool)
    return running_before(own, "score", "asset_id", "bytes_local", "taken_before").where(F.col("taken_before") < target)


def running_before(rows: DataFrame, order: str, key: str, size: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``size`` over those ahead: larger ``order`` first, then by ``key``.

    The rows are stored once and then sorted into ranges of (order, key), so that equal
    values of ``order`` part too; a range has about RANGE_ROWS rows however many there
    are.  A sum for each range tells it what is ahead.
    """
    own = stored(rows, "running-rows")
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-own.count() // RANGE_ROWS))
    ranged = stored(own.repartitionByRange(n, F.desc(order), F.col(key)).withColumn("part", F.spark_partition_id()), "running-ranges")
    sums = ranged.groupBy("part").agg(F.sum(size).alias("own"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a sum for each range
    before = sums.select("part", F.coalesce(F.sum("own").over(ahead), F.lit(0)).alias("part_before"))
    within = Window.partitionBy("part").orderBy(F.desc(order), key).rowsBetween(Window.unboundedPreceding, -1)
    summed = F.col("part_before") + F.coalesce(F.sum(size).over(within), F.lit(0))
    return ranged.join(F.broadcast(before), "part").withColumn(name, summed).drop("part", "part_before")


def tiered(found: DataFrame, target: int, level: str = "extreme") -> DataFrame:
    """The cloud pool first, and what it leaves of the target from the other; ``plan`` names the pool."""
    found = stored(found, "eviction-candidates")
    cloud = greedy(found, target, level, "cloud_offload")
    freed = cloud.agg(F.coalesce(F.sum("bytes_local"), F.lit(0))).first()[0]
    rest = greedy(found, max(0, target - freed), level, "full_eviction")
    return cloud.withColumn("plan", F.lit("cloud_offload")).unionByName(rest.withColumn("plan", F.lit("full_eviction")))


def evicted(assets: DataFrame, plan: DataFrame) -> DataFrame:
    """Assets after a plan ran: its own have state evicted and no local bytes, the others stay as they are."""
    # stored, so that Spark knows its size: a plan goes by its target, not by the assets, which then aren't shuffled
    named = stored(plan.select("asset_id").distinct(), "eviction-plan")
    hit = assets.join(named.withColumn("hit", F.lit(True)), "asset_id", "left")
    gone = F.coalesce(F.col("hit"), F.lit(False))
    return hit.withColumn("media_state", F.when(gone, "evicted").otherwise(F.col("media_state"))).withColumn("bytes_local", F.when(gone, 0).otherwise(F.col("bytes_local"))).drop("hit")


def least_recent(entries: DataFrame, budget: int) -> DataFrame:
    """Cache entries (key, size, last_used) that go: the least recent, until the rest is within ``budget``."""
    newer = running_before(entries, "last_used", "key", "size", "newer_bytes")
    return newer.where(F.col("newer_bytes") + F.col("size") > budget).drop("newer_bytes")


def migration_plan(assets: DataFrame, source: str, target: str) -> DataFrame:
    """Assets on ``source`` to move, by id; none if source and target are the same.

    An asset whose merkle_root isn't 32 bytes can't be verified and isn't moved; a table
    without such a column has no roots to look at.
    """
    own = assets.where((F.col("storage_sink") == source) & F.lit(source != target))
    if "merkle_root" in assets.columns:
        own = own.where(F.octet_length("merkle_root") == 32)
    return own.select("asset_id", F.lit(source).alias("source_sink"), F.lit(target).alias("target_sink"), "bytes_local").orderBy("asset_id")


def by_priority(found: DataFrame, limit: int) -> DataFrame:
    """The first candidates, heavier kinds first and then older ones."""
    weight = F.lit(0.1)
    for name, value in KIND_WEIGHTS.items():
        weight = F.when(F.col("kind") == name, value).otherwise(weight)
    return found.orderBy(weight.desc(), "created_at_ms", "asset_id").limit(limit)


def migration_outcomes(assets: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with an ``outcome``: moved, or already on the target, elsewhere or missing.  A second run moves nothing."""
    here = assets.select("asset_id", F.coalesce("storage_sink", F.lit("")).alias("sink_now"))
    outcome = (
        F.when(F.col("sink_now").isNull(), "missing")
        .when(F.col("sink_now") == F.col("target_sink"), "already")
        .when(F.col("sink_now") == F.col("source_sink"), "moved")
        .otherwise("elsewhere")
    )
    return plan.join(here, "asset_id", "left").withColumn("outcome", outcome).drop("sink_now")


def migrated(assets: DataFrame, plan: DataFrame) -> DataFrame:
    """Assets after a migration ran: what it moved has the target as its sink."""
    done = migration_outcomes(assets, plan).where("outcome = 'moved'").select("asset_id", "target_sink")
    joined = assets.join(done, "asset_id", "left")
    return joined.withColumn("storage_sink", F.coalesce("target_sink", "storage_sink")).drop("target_sink")
