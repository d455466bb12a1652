from __future__ import annotations

import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from parley.operators import blobs, offload
from parley.operators.search import SearchQuery

DAY = 86_400_000
ASSETS = "asset_id string, storage_sink string, bytes_local long, merkle_root binary"


def root(content: bytes, size: int) -> bytes:
    own = [hashlib.sha256(b"\0" + content[k : k + size]).digest() for k in range(0, max(1, len(content)), size)]
    while len(own) > 1:
        own = [hashlib.sha256(b"\1" + own[k] + own[k + 1]).digest() if k + 1 < len(own) else own[k] for k in range(0, len(own), 2)]
    return own[0]


@pytest.fixture(scope="module")
def contents():
    rng = random.Random(6)
    return {f"a{k}": rng.randbytes(n) for k, n in enumerate((0, 1, 7, 8, 9, 40, 63, 64, 65, 500))}


def test_roots(spark, contents, tmp_path):
    df = spark.createDataFrame([(k, bytearray(c)) for k, c in contents.items()], "asset_id string, content binary")
    got = {r.asset_id: bytes(r.r) for r in df.select("asset_id", blobs.merkle_root(blobs.chunk_hashes(F.col("content"), 8)).alias("r")).collect()}
    want = {k: root(c, 8) for k, c in contents.items()}
    assert got == want
    blobs.write_chunks(df, f"file:{tmp_path}/sink", 8)
    read = {r.asset_id: (bytes(r.root), r.bytes) for r in blobs.roots(spark, f"file:{tmp_path}/sink").collect()}
    assert read == {k: (want[k], len(contents[k])) for k in contents}


def test_a_migration_moves_what_reads_back_alike_and_only_once(spark, contents, tmp_path):
    df = spark.createDataFrame([(k, bytearray(c)) for k, c in contents.items()], "asset_id string, content binary")
    source, target = f"file:{tmp_path}/source", f"file:{tmp_path}/target"
    blobs.write_chunks(df.where("asset_id <> 'a4'"), source, 8)  # a4 was lost
    rows = [(k, "cloud", len(c), bytearray(root(c if k != "a5" else b"other", 8))) for k, c in contents.items()] + [("b", "primary_backend", 1, bytearray(32))]
    assets = spark.createDataFrame(rows, ASSETS)
    plan = offload.migration_plan(assets, "cloud", "primary_backend").unionByName(
        spark.createDataFrame([("b", "cloud", "primary_backend", 1), ("nothing", "cloud", "primary_backend", 1)], "asset_id string, source_sink string, target_sink string, bytes_local long")
    )
    outcomes = blobs.migrate(assets, plan, source, target)
    got = {r.asset_id: r.outcome for r in outcomes.collect()}
    assert got == {**dict.fromkeys(contents, "migrated"), "a4": "not read back", "a5": "other content", "b": "already", "nothing": "missing"}
    after = blobs.after_migration(assets, outcomes)
    assert {r.asset_id for r in after.where("storage_sink = 'cloud'").collect()} == {"a4", "a5"}
    again = {r.asset_id: r.outcome for r in blobs.migrate(after, plan, source, f"file:{tmp_path}/again").collect()}
    assert again == {**dict.fromkeys(contents, "already"), "a4": "not read back", "a5": "other content", "b": "already", "nothing": "missing"}


def test_a_missing_chunk_is_no_root(spark, tmp_path):
    rows = [("a", 0, bytearray(b"x")), ("a", 2, bytearray(b"z"))]
    spark.createDataFrame(rows, "asset_id string, chunk int, content binary").write.parquet(f"file:{tmp_path}/s")
    assert blobs.roots(spark, f"file:{tmp_path}/s").first()["root"] is None


def test_only_verified_and_whole_segments_are_read(spark, tmp_path):
    kind = "message_id long, conversation_id long, created_at_ms long, text string"
    rows = [(k, k % 3, 1_704_067_200_000 + k * 10 * DAY, f"body {k}") for k in range(30)]
    own = spark.createDataFrame(rows, kind)
    path = f"file:{tmp_path}/segments"
    made = blobs.write_segments(own, path, "primary")
    every = SearchQuery()

    def read(segment_map, query=every):
        return sorted(r.message_id for r in blobs.read_segments(segment_map, query, {"primary": path}, own.schema).collect())

    assert read(made) == []  # uploaded isn't verified
    files = sorted(Path(tmp_path, "segments").glob("*/*.parquet"))
    files[0].write_bytes(files[0].read_bytes()[:-20])  # broken before it was verified
    good = blobs.verified(made, path)
    states = {r.time_bucket: r.state for r in good.collect()}
    first = files[0].parent.name.split("=")[1]
    assert states.pop(first) == "archive_uploaded" and set(states.values()) == {"archive_verified"}
    left = [k for k, _, at, _ in rows if at >= 1_704_067_200_000 + 31 * DAY]
    assert read(good) == left
    dated = SearchQuery(date_from=1_704_067_200_000 + 60 * DAY, date_to=1_704_067_200_000 + 90 * DAY)
    assert read(good, dated) == [k for k in range(30) if 6 <= k <= 12][: len(read(good, dated))] and 6 in read(good, dated)
    files[1].write_bytes(files[1].read_bytes()[:-20])  # broken since
    second = files[1].parent.name.split("=")[1]
    gone = {r.message_id for r in own.where(F.date_format(F.timestamp_millis("created_at_ms"), "yyyy-MM") == second).collect()}
    assert gone and read(good) == [k for k in left if k not in gone]
    assert blobs.read_segments(good, every, {"other": path}, own.schema).count() == 0


@pytest.mark.parametrize("key", [b"", b"k", b"x" * 64, b"y" * 100])
def test_keyed_hashes(spark, contents, key):
    import hmac

    df = spark.createDataFrame([(bytearray(c),) for c in contents.values()], "c binary")
    got = sorted(bytes(r[0]) for r in df.select(blobs.keyed_hash(F.col("c"), key)).collect())
    assert got == sorted(hmac.new(key, c, hashlib.sha256).digest() for c in contents.values())
