"""Contents of files: hashes, Merkle roots of chunks, verified writes and migrations.

Nothing counts as written until what was written has been read back and its hash is what
it ought to be; reads take only files that the map says are verified and that still are.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import times
from parley.operators import search
from parley.sources.shared import stored

#: Bytes of a chunk.
CHUNK = 16 * 1024 * 1024
_LEAF, _NODE = b"\x00", b"\x01"


def chunk_hashes(content: Column, size: int = CHUNK) -> Column:
    """SHA-256 of each chunk of a binary column, marked as leaves; nothing has one empty chunk."""
    count = F.greatest(F.ceil(F.octet_length(content) / size), F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.substring(content, k * size + 1, F.lit(size)))
    return F.transform(cut, lambda c: F.unhex(F.sha2(F.concat(F.lit(_LEAF), c), 256)))


def merkle_root(hashes: Column) -> Column:
    """The root over chunks' hashes: pairs are hashed level by level, an odd one goes up as it is.  32 bytes.

    A blob of 2**31 bytes has 128 chunks of 16 MiB; 31 levels are enough for any array.
    """

    def level(own: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.floor((F.size(own) - 1) / 2).cast("int"))

        def joined(k: Column) -> Column:
            a, b = F.get(own, 2 * k), F.get(own, 2 * k + 1)
            return F.when(b.isNull(), a).otherwise(F.unhex(F.sha2(F.concat(F.lit(_NODE), a, b), 256)))

        return F.when(F.size(own) > 1, F.transform(pairs, joined)).otherwise(own)

    levels = F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(F.size(hashes))), F.lit(1)).cast("int"))
    return F.get(F.aggregate(levels, hashes, lambda own, _: level(own)), F.lit(0))


def keyed_hash(content: Column, key: bytes) -> Column:
    """HMAC-SHA-256 of a binary column, 32 bytes: the same content has another hash under another key."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in block) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(F.lit(inner), content), 256))
    return F.unhex(F.sha2(F.concat(F.lit(outer), first), 256))


# --- a sink: blobs in chunks -----------------------------------------------------


def write_chunks(blobs: DataFrame, path: str, size: int = CHUNK) -> None:
    """Write ``blobs`` (asset_id, content) to a sink: a row for each chunk, in folders by a hash of the asset.

    Writing an asset again replaces it with its folder's other new ones: give each run a path of its own.
    """
    count = F.greatest(F.ceil(F.octet_length("content") / size), F.lit(1)).cast("int")
    each = blobs.select("asset_id", "content", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk"))
    each.select("asset_id", "chunk", F.substring("content", F.col("chunk") * size + 1, F.lit(size)).alias("content")).write.mode("overwrite").parquet(path)


def roots(spark: SparkSession, path: str) -> DataFrame:
    """(asset_id, root, bytes, chunks) of what a sink's folder holds, read from it; chunk by chunk, so no blob is put together.

    A missing chunk leaves a gap, and so another root.
    """
    hashed = spark.read.schema("asset_id string, chunk int, content binary").parquet(path)
    leaf = F.unhex(F.sha2(F.concat(F.lit(_LEAF), F.col("content")), 256))
    own = hashed.select("asset_id", "chunk", leaf.alias("leaf"), F.octet_length("content").cast("long").alias("size"))
    one = own.groupBy("asset_id", "chunk").agg(F.min("leaf").alias("leaf"), F.max("size").alias("size"))
    listed = one.groupBy("asset_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "leaf"))).alias("c"), F.sum("size").alias("bytes"), F.count("*").alias("chunks"), F.max("chunk").alias("last"))
    whole = F.col("last") == F.col("chunks") - 1
    return listed.select("asset_id", F.when(whole, merkle_root(F.col("c.leaf"))).alias("root"), "bytes", "chunks")


def migrate(assets: DataFrame, plan: DataFrame, source: str, target: str) -> DataFrame:
    """A stored table (asset_id, outcome): migrated, already, or why it failed.

    ``plan`` is that of :func:`parley.operators.offload.migration_plan`; ``assets`` has each
    asset's sink and merkle_root.  Chunks of the planned assets that are still on the
    source are copied from the folder ``source`` to ``target``, read back there, and
    their roots are compared with the asset's own.  A second run finds assets on the
    target and does nothing.
    """
    spark = assets.sparkSession
    here = plan.select("asset_id", "source_sink", "target_sink").join(assets.select("asset_id", "storage_sink", "merkle_root"), "asset_id", "left")
    todo = stored(here, "migration")
    moving = todo.where("storage_sink = source_sink").select("asset_id")
    chunks = spark.read.schema("asset_id string, chunk int, content binary").parquet(source)
    chunks.join(moving, "asset_id", "left_semi").write.mode("overwrite").parquet(target)
    read = roots(spark, target).select("asset_id", "root")
    judged = todo.join(read, "asset_id", "left")
    outcome = (
        F.when(F.col("storage_sink").isNull(), "missing")
        .when(F.col("storage_sink") == F.col("target_sink"), "already")
        .when(F.col("storage_sink") != F.col("source_sink"), "elsewhere")
        .when(F.col("root").isNull(), "not read back")
        .when(F.col("root") != F.col("merkle_root"), "other content")
        .otherwise("migrated")
    )
    return stored(judged.select("asset_id", "target_sink", outcome.alias("outcome")), "migration-outcomes")


def after_migration(assets: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``assets`` with the new sink of those that were migrated."""
    done = outcomes.where("outcome = 'migrated'").select("asset_id", "target_sink")
    return assets.join(done, "asset_id", "left").withColumn("storage_sink", F.coalesce("target_sink", "storage_sink")).drop("target_sink")


# --- segments --------------------------------------------------------------------


def _files(spark: SparkSession, path: str, skip_broken: bool = False) -> DataFrame:
    """(file, time_bucket, content_hash) of a folder's files, by their bytes."""
    options = {"pathGlobFilter": "*.parquet", "recursiveFileLookup": "true", "ignoreMissingFiles": str(skip_broken).lower(), "ignoreCorruptFiles": str(skip_broken).lower()}
    read = spark.read.format("binaryFile").options(**options).load(path)
    return read.select(F.col("path").alias("file"), F.regexp_extract("path", r"time_bucket=([^/]*)/", 1).alias("time_bucket"), F.sha2("content", 256).alias("content_hash"))


def write_segments(messages: DataFrame, path: str, backend: str) -> DataFrame:
    """Write ``messages`` as segments, files of one month each, and give the map's stored rows for them: uploaded, not yet verified.

    (segment_id, file, time_bucket, content_hash, storage_backend, state); a segment's id is the hash of its content.
    """
    own = messages.withColumn("time_bucket", times.month_bucket(F.col("created_at_ms"))).hint("rebalance", "time_bucket")
    own.sortWithinPartitions("time_bucket", "conversation_id", "created_at_ms").write.mode("overwrite").partitionBy("time_bucket").parquet(path)
    rows = _files(messages.sparkSession, path).select(
        F.col("content_hash").alias("segment_id"), "file", "time_bucket", "content_hash", F.lit(backend).alias("storage_backend"), F.lit("archive_uploaded").alias("state")
    )
    return stored(rows, "segment-map")


def verified(segment_map: DataFrame, path: str) -> DataFrame:
    """The map after its files were read back: those whose content has the map's hash are verified, others stay as they were."""
    spark = segment_map.sparkSession
    now = _files(spark, path, skip_broken=True).select("file", F.col("content_hash").alias("now"))
    joined = segment_map.join(now, "file", "left")
    same = (F.col("now") == F.col("content_hash")) & (F.col("state") == "archive_uploaded")
    return stored(joined.withColumn("state", F.when(same, "archive_verified").otherwise(F.col("state"))).select(*segment_map.columns), "segment-map")


def planned(segment_map: DataFrame, query: search.SearchQuery, backend: str | None = None) -> DataFrame:
    """The map's rows that a read needs: verified, on the backend if one is named, and of months that meet the query's dates."""
    own = segment_map.where(F.col("state").isin("archive_verified", "archive_compacted") & times.bucket_overlaps(F.col("time_bucket"), query.date_from, query.date_to))
    return own if backend is None else own.where(F.col("storage_backend") == backend)


def read_segments(segment_map: DataFrame, query: search.SearchQuery, backends: dict[str, str], schema) -> DataFrame:
    """The messages of the planned segments, each file only if its content still has the map's hash.

    ``backends`` has by name the folder of each.  What the plan names is listed by the
    driver, as any scan's files are; contents are hashed by the executors.
    """
    spark, out = segment_map.sparkSession, None
    for name, path in backends.items():
        wanted = planned(segment_map, query, name)
        whole = wanted.join(_files(spark, path, skip_broken=True).select("file", "content_hash"), ["file", "content_hash"], "left_semi")
        files = [r["file"] for r in whole.select("file").collect()]
        own = spark.read.schema(schema).option("basePath", path).parquet(*files) if files else spark.createDataFrame([], schema)
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out
