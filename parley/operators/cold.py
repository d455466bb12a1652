"""The cold tier: month partitions, pruning, bloom filters and the cold scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parley.functions import text as fn
from parley.functions import times
from parley.operators import search
from parley.sources import cold_tier
from parley.sources.shared import stored

BITS_PER_WORD, LEAST_BITS, HASHES = 12, 64, 3


@dataclass(frozen=True)
class Policy:
    """What a tenant may search: no global searches, so many months, only months with a bloom filter."""

    forbid_global: bool = False
    most_buckets: int = 50
    require_bloom: bool = False


def write(messages: DataFrame, path: str) -> None:
    """Write the cold tier as Parquet, a folder for each month; Spark splits large months between tasks."""
    own = messages.withColumn("time_bucket", times.month_bucket(F.col("created_at_ms"))).hint("rebalance", "time_bucket")
    ordered = own.sortWithinPartitions("time_bucket", "conversation_id", "created_at_ms")
    ordered.write.mode("overwrite").partitionBy("time_bucket").parquet(path)


def read(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The cold tier; unreadable files are skipped, as an unreachable month would be.  :func:`unreadable` names them.

    Without a ``schema`` one of the files gives it, and that one must be readable.
    """
    reader = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").option("basePath", path)
    return (reader if schema is None else reader.schema(schema)).parquet(path)


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """(time_bucket, file) of the cold tier's files that aren't whole Parquet files, which :func:`read` skips; of each its footer alone is read."""
    options = {"pathGlobFilter": "*.parquet", "recursiveFileLookup": "true"}
    listed = spark.read.format("binaryFile").options(**options).load(path).select("path")

    def broken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [file for file in batch["path"].to_pylist() if not cold_tier.whole(file)]
            yield pa.RecordBatch.from_pydict({"file": pa.array(found, pa.string())})

    month = F.regexp_extract("file", r"time_bucket=([^/]*)/", 1)
    return listed.mapInArrow(broken, "file string").select(month.alias("time_bucket"), "file")


def pruned(cold: DataFrame, query: search.SearchQuery) -> DataFrame:
    """Only months that meet the query's dates; the test is on the partition column alone."""
    return cold.where(times.bucket_overlaps(F.col("time_bucket").cast("string"), query.date_from, query.date_to))


def newest_buckets(cold: DataFrame, most: int) -> list[str]:
    """The newest months, a list that ``most`` bounds."""
    rows = cold.select(F.col("time_bucket").cast("string").alias("time_bucket")).distinct().orderBy(F.desc("time_bucket")).limit(most)
    return [r["time_bucket"] for r in rows.collect()]


def query_words(query: str) -> list[str]:
    """Distinct lower-case parts between ASCII white space and punctuation."""
    out, word = [], ""
    for c in query.lower() + " ":
        if c.isascii() and not c.isalnum():
            out.append(word)
            word = ""
        else:
            word += c
    return [w for w in dict.fromkeys(out) if w]


def substring_score(text: Column, query: str) -> Column:
    """How many distinct query words are substrings of the text, case apart."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a + b, (low.contains(w).cast("double") for w in query_words(query)), F.lit(0.0))


# --- bloom filters ---------------------------------------------------------------


def _slot(word: Column, k: int, bits: Column) -> Column:
    return F.pmod(F.xxhash64(word, F.lit(k)), bits)


def bloom_table(words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bits, bitmap): a bloom filter for each group of ``word`` rows, a bit a slot in 64-bit numbers."""
    distinct = words.select(*keys, "word").distinct()
    sized = distinct.groupBy(*keys).agg(F.greatest(F.lit(LEAST_BITS), F.ceil(F.count("*") * BITS_PER_WORD / 8) * 8).cast("long").alias("bits"))
    spots = distinct.join(sized, keys).select(*keys, "bits", F.explode(F.array(*(_slot(F.col("word"), k, F.col("bits")) for k in range(HASHES)))).alias("slot"))
    parts = spots.groupBy(*keys, "bits", F.floor(F.col("slot") / 64).cast("int").alias("part")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("own"))
    held = parts.groupBy(*keys, "bits").agg(F.map_from_entries(F.collect_list(F.struct("part", "own"))).alias("held"))
    filled = F.transform(F.sequence(F.lit(0), F.ceil(F.col("bits") / 64).cast("int") - 1), lambda i: F.coalesce(F.element_at("held", i), F.lit(0).cast("long")))
    return held.select(*keys, "bits", filled.alias("bitmap"))


GROUP = ["conversation_id", "time_bucket"]


def write_blooms(messages: DataFrame, path: str) -> DataFrame:
    """Store the bloom filters of each conversation and month beside the cold tier, when it is written: (conversation_id, time_bucket, bits, bitmap)."""
    own = messages.withColumn("time_bucket", times.month_bucket(F.col("created_at_ms")))
    words = own.select(*GROUP, F.explode(fn.words(F.col("text"))).alias("word"))
    bloom_table(words, GROUP).write.mode("overwrite").parquet(path)
    return messages.sparkSession.read.parquet(path)


def maybe_contains(word: str | Column) -> Column:
    """Whether a filter of :func:`bloom_table` may hold the word; never wrong about one it holds."""
    own = F.lit(word) if isinstance(word, str) else word

    def held(k: int) -> Column:
        slot = _slot(own, k, F.col("bits"))
        return F.bit_get(F.get("bitmap", F.floor(slot / 64).cast("int")), (slot % 64).cast("int")) == 1

    return reduce(lambda a, b: a & b, map(held, range(HASHES)))


def bloom_prune(cold: DataFrame, blooms: DataFrame, query: str, require: bool = False) -> DataFrame:
    """Cold rows of (conversation, month) groups that may hold some query word; without a filter kept unless ``require``."""
    keys = GROUP
    may = reduce(lambda a, b: a | b, (maybe_contains(w) for w in query_words(query)), F.lit(False))
    judged = blooms.select(*keys, may.alias("may"))
    return cold.join(judged, keys, "left").where(F.coalesce(F.col("may"), F.lit(not require))).drop("may")


# --- search ----------------------------------------------------------------------


def cold_hits(cold: DataFrame, query: search.SearchQuery) -> DataFrame:
    """Cold rows with ``base`` = words found + n-gram overlap, of those with any."""
    kept = search.filtered(cold, query)
    near = search.fuzzy_scan(kept, query.text)
    scored = kept.join(near, "message_id", "left").withColumn("words_found", substring_score(F.col("text"), query.text))
    return scored.where("words_found > 0 or fuzzy is not null").withColumn("base", F.col("words_found") + F.coalesce("fuzzy", F.lit(0.0))).drop("words_found", "fuzzy")


def allowed(query: search.SearchQuery, policy: Policy) -> bool:
    """Whether the cold tier is searched at all."""
    if not query.text.strip() or search.STORED_KIND.get(query.kind or "any") == "media":
        return False
    return not (policy.forbid_global and query.target is None and query.conversation is None)


def scope(cold: DataFrame, query: search.SearchQuery, policy: Policy = Policy(), blooms: DataFrame | None = None) -> DataFrame:
    """The cold rows that a search looks at: months that meet its dates, the newest the policy allows, and groups whose filter may hold a word."""
    own = pruned(cold, query)
    own = own.where(F.col("time_bucket").cast("string").isin(newest_buckets(own, policy.most_buckets)))
    if blooms is not None:
        return bloom_prune(own.withColumn("time_bucket", F.col("time_bucket").cast("string")), blooms, query.text, policy.require_bloom)
    return own.where(F.lit(False)) if policy.require_bloom else own


def coverage(cold: DataFrame, query: search.SearchQuery, policy: Policy = Policy(), blooms: DataFrame | None = None) -> DataFrame:
    """(time_bucket, outcome, groups): how many conversations of each month a search fetches or skips, and why.

    An outcome is fetched, or skipped for its date, the cap of months, the bloom filter,
    or a filter that the policy requires and that isn't there.
    """
    month = F.col("time_bucket").cast("string")
    groups = cold.select("conversation_id", month.alias("time_bucket")).distinct()
    meets = times.bucket_overlaps(F.col("time_bucket"), query.date_from, query.date_to)
    allowed_months = newest_buckets(pruned(cold, query), policy.most_buckets)
    if blooms is not None:
        may = reduce(lambda a, b: a | b, (maybe_contains(w) for w in query_words(query.text)), F.lit(False))
        groups = groups.join(blooms.select(*GROUP, may.alias("may")), GROUP, "left")
    else:
        groups = groups.withColumn("may", F.lit(None).cast("boolean"))
    outcome = (
        F.when(~meets, "date").when(~F.col("time_bucket").isin(allowed_months), "cap").when(F.col("may").isNull() & F.lit(policy.require_bloom), "no filter")
        .when(~F.coalesce("may", F.lit(True)), "filter").otherwise("fetched")
    )
    return groups.groupBy("time_bucket", outcome.alias("outcome")).agg(F.count("*").alias("groups"))


def merged(hot: DataFrame, cold: DataFrame, query: search.SearchQuery, policy: Policy = Policy(), blooms: DataFrame | None = None, local: DataFrame | None = None) -> DataFrame:
    """All hot results with cold ones: a row found in both gets the raw cold score added, others decay.

    ``local`` are the hot lexical hits (messages with ``base``), if an index has found them.
    """
    hits = search.lexical(search.filtered(hot, query), query.text) if local is None else local
    local = search.decayed(hits)
    local = local.select("message_id", "conversation_id", "sender_id", "created_at_ms", "rank_score", (F.col("body_state") == "remote_archive_only").alias("is_cold"))
    if not allowed(query, policy):
        return local
    found = cold_hits(scope(cold, query, policy, blooms), query).select(
        "message_id", *(F.col(c).alias(f"cold_{c}") for c in ("conversation_id", "sender_id", "created_at_ms", "base"))
    )
    both = local.join(found, "message_id", "full")
    created = F.coalesce("created_at_ms", "cold_created_at_ms")
    newest = F.broadcast(both.agg(F.max(created).alias("now")))
    cold_score = F.coalesce("cold_base", F.lit(0.0))
    score = F.when(F.col("rank_score").isNotNull(), F.col("rank_score") + cold_score).otherwise(cold_score * search.recency(created, F.col("now")))
    return both.crossJoin(newest).select(
        "message_id",
        F.coalesce("conversation_id", "cold_conversation_id").alias("conversation_id"),
        F.coalesce("sender_id", "cold_sender_id").alias("sender_id"),
        created.alias("created_at_ms"),
        score.alias("rank_score"),
        F.coalesce("is_cold", F.lit(True)).alias("is_cold"),
    )


def hot_and_cold(
    hot: DataFrame, cold: DataFrame, query: search.SearchQuery, policy: Policy = Policy(), limit: int = 200, blooms: DataFrame | None = None
) -> DataFrame:
    """The first of :func:`merged` by rank."""
    return search.ranked(merged(hot, cold, query, policy, blooms), limit)


def with_semantic(
    hot: DataFrame, cold: DataFrame, vectors: DataFrame, query: search.SearchQuery, vector: list[float], policy: Policy = Policy(), limit: int = 200
) -> DataFrame:
    """Both tiers' results with 1.5 cosine: undecayed for those found by words, decayed for others of either tier."""
    found = merged(hot, cold, query, policy)
    columns = ["message_id", "conversation_id", "sender_id", "created_at_ms", "kind"]
    own = search.filtered(hot, query).select(*columns, (F.col("body_state") == "remote_archive_only").alias("is_cold"))
    if allowed(query, policy):
        far = search.filtered(scope(cold, query, policy), query).select(*columns, F.lit(True).alias("is_cold"))
        own = own.unionByName(far.join(own.select("message_id"), "message_id", "left_anti"))
    lexically = found.select("message_id", F.col("rank_score").alias("lexical"))
    return search.ranked(search.semantic(own, lexically, search.similar(vectors, vector)), limit)


def progressive(hot: DataFrame, cold: DataFrame, query: search.SearchQuery, policy: Policy = Policy(), limit: int = 200) -> Iterator[tuple[str, DataFrame]]:
    """('local', rows), then (month, new rows) for each cold month, newest first, then ('complete', rows)."""
    local = search.hybrid(hot, query, limit)
    yield "local", local
    if allowed(query, policy):
        own = pruned(cold, query)
        for month in newest_buckets(own, policy.most_buckets):
            hits = cold_hits(own.where(F.col("time_bucket").cast("string") == month), query)
            yield month, hits.join(local.select("message_id"), "message_id", "left_anti")
    yield "complete", hot_and_cold(hot, cold, query, policy, limit)


def stopping(
    hot: DataFrame, cold: DataFrame, query: search.SearchQuery, policy: Policy = Policy(), limit: int = 200, blooms: DataFrame | None = None, local: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rows, months): the rows of :func:`hot_and_cold`, and (time_bucket, outcome), which months were fetched for them and which not.

    Months come newest first, one, two, four and so on at a time.  A cold row's score is at
    most its words, and one for its n-grams, decayed from the newest hit to its month's
    newest message; as soon as the ``limit``-th score so far beats that for the next month,
    the rest is skipped.  A month that may have a newer hit than any so far is never
    skipped.  No message may be in both tiers.  Runs a job for each step; months are as
    many as the policy allows, and each step tells the driver ``limit`` scores at most.
    """
    hits = search.lexical(search.filtered(hot, query), query.text) if local is None else local
    columns = ["message_id", "conversation_id", "sender_id", "created_at_ms"]
    scored = search.decayed(hits)
    found = stored(scored.select(*columns, "rank_score", (F.col("body_state") == "remote_archive_only").alias("is_cold")), "cold-local")
    none = hot.sparkSession.createDataFrame([], "time_bucket string, outcome string")
    if not allowed(query, policy):
        return search.ranked(found, limit), none
    own = scope(cold, query, policy, blooms).withColumn("time_bucket", F.col("time_bucket").cast("string"))
    newest = {r["time_bucket"]: r["newest"] for r in own.groupBy("time_bucket").agg(F.max("created_at_ms").alias("newest")).collect()}
    months = sorted(newest, key=lambda m: (-newest[m], m))
    most = len(query_words(query.text)) + 1
    far, step, at = None, 1, 0
    now = found.agg(F.max("created_at_ms")).first()[0]

    def rows(now: int | None) -> DataFrame:
        if far is None:
            return found
        decayed = F.col("base") * search.recency(F.col("created_at_ms"), F.lit(now))
        return found.unionByName(far.select(*columns, decayed.alias("rank_score"), F.lit(True).alias("is_cold")))

    while at < len(months):
        if now is not None and newest[months[at]] <= now:
            best = [r["rank_score"] for r in rows(now).select("rank_score").orderBy(F.desc("rank_score")).limit(limit).collect()]
            age = max(0, now - newest[months[at]]) / search.DAY_MS
            bound = most * (search.RECENCY_FLOOR + (1 - search.RECENCY_FLOOR) * 2 ** (-age / search.HALF_LIFE_DAYS))
            if len(best) == limit and best[-1] > bound + 1e-9:
                break
        some = months[at : at + step]
        more = stored(cold_hits(own.where(F.col("time_bucket").isin(some)), query).select(*columns, "base"), "cold-found")
        far = more if far is None else far.unionByName(more)
        now = max((t for t in (now, more.agg(F.max("created_at_ms")).first()[0]) if t is not None), default=None)
        at, step = at + step, step * 2
    told = [(m, "fetched" if k < at else "skipped") for k, m in enumerate(months)]
    return search.ranked(rows(now), limit), hot.sparkSession.createDataFrame(told, none.schema)


def new_hits(local: DataFrame, cold: DataFrame, query: search.SearchQuery) -> DataFrame:
    """(time_bucket, hits): how many rows each cold month adds to the ``local`` results, all months in one job."""
    found = cold_hits(pruned(cold, query), query).join(local.select("message_id"), "message_id", "left_anti")
    return found.groupBy(F.col("time_bucket").cast("string").alias("time_bucket")).agg(F.count("*").alias("hits"))
