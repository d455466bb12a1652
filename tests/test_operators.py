from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from parley.engine import Engine
from parley.functions import numbers, text, times
from parley.operators import analytics, journal, offload, restore, store
from parley.operators.search import SearchQuery
from parley.sources import tables
from parley.streaming import journal as streams

DAY = 86_400_000
EVENT = "event_seq long, event_type string, conversation_id long, message_id long, created_at_ms long"


def test_archive_tombstones_whatever_the_order(spark):
    rows = [(1, "message_deleted", 1, 10, 5), (2, "message_received", 1, 10, 6), (3, "message_received", 1, 11, 7), (4, "conversation_deleted", 2, None, 8), (5, "message_edited", 2, 20, 9), (6, "conversation_created", 1, None, 9)]
    left = journal.archive_survivors(spark.createDataFrame(rows, EVENT))
    assert sorted(r.event_seq for r in left.collect()) == [3, 6]


def test_backup_tombstones(spark):
    rows = [(1, "message_received", 1, 1, 1), (2, "media_received", 1, 1, 1), (3, "media_deleted", 1, 1, 1), (4, "message_received", 1, 2, 1), (5, "media_received", 1, 2, 1), (6, "message_deleted", 1, 2, 1), (7, "message_received", 2, 1, 1)]
    left = journal.backup_survivors(spark.createDataFrame(rows, EVENT))
    assert sorted(r.event_seq for r in left.collect()) == [1, 7]


def test_cursor():
    assert journal.advanced(3, 5) == 5
    with pytest.raises(ValueError):
        journal.advanced(5, 3)


def test_buckets(spark):
    df = spark.createDataFrame([(1_777_000_000_000,), (0,)], "ms long")
    assert [tuple(r) for r in df.select(times.month_bucket(F.col("ms")), times.approximate_bucket(F.col("ms"))).collect()] == [("2026-04", "2026-05"), ("1970-01", "1970-01")]
    labels = spark.createDataFrame([("2024-02",), ("broken",), ("2024-03",)], "b string")
    hit = labels.where(times.bucket_overlaps(F.col("b"), 1_709_164_800_000, 1_709_251_199_999))  # 29 February
    assert [r.b for r in hit.collect()] == ["2024-02", "broken"]


def test_weeks_start_on_monday(spark):
    row = spark.createDataFrame([(1_704_067_200_000 + 3 * DAY,)], "ms long").select(times.week_start_ms(F.col("ms"))).first()
    assert row[0] == 1_704_067_200_000


def test_int4_round_trip(spark):
    df = spark.createDataFrame([([0.55, -0.3, 1.0],), ([0.0, 0.0],), ([],), (None,)], "v array<float>")
    got = [r[0] for r in df.select(numbers.decode_int4(numbers.encode_int4(F.col("v")))).collect()]
    assert got[0] == pytest.approx([4 / 7, -2 / 7, 1.0, 0.0]) and got[1:] == [[0.0, 0.0], [], None]


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0], [1.0, 2.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(numbers.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, None, pytest.approx(1.0)]


def test_size_classes(spark):
    df = spark.createDataFrame([(0,), (1016,), (1017,), (2**30,), (2**30 - 8,)], "n long")
    assert [r[0] for r in df.select(numbers.size_class(F.col("n"))).collect()] == [1024, 1024, 4096, 2**31, 2**30]


def test_names(spark):
    df = spark.createDataFrame([("a/b:c?.txt. ",), ("...",), ("é" * 200 + ".pdf",), (None,)], "n string")
    got = [r[0] for r in df.select(text.sanitize_filename(F.col("n"))).collect()]
    assert got[:2] == ["abc.txt", "unnamed"] and got[2].endswith(".pdf") and len(got[2].encode()) <= 255 and got[3] is None
    caption = spark.createDataFrame([("  é  x\n",)], "t string").select(text.normalize_caption(F.col("t"))).first()[0]
    assert caption == "é x"
    assert spark.range(1).select(text.base64_url(F.lit(b"\xfb\xff"))).first()[0] == "-_8"


def assets(spark, rows):
    return spark.createDataFrame(rows, "asset_id string, mime_type string, bytes_local long, archive_state string, storage_sink string, created_at_ms long, pinned boolean")


def test_pinned_and_unverified_stay(spark):
    rows = [("a", "video/mp4", 10, "archive_verified", "", 0, True), ("b", "video/mp4", 10, "archive_pending", "", 0, False), ("c", "video/mp4", 10, "archive_verified", "", 0, False), ("d", "text/x", 0, "archive_verified", "", 0, False)]
    own = assets(spark, rows + [("e", "video/mp4", 10, "archive_verified", "", 0, False)])
    state = F.when(F.col("asset_id") == "e", "download_in_progress").otherwise("original_local")  # half-loaded
    assert [r.asset_id for r in offload.candidates(own.withColumn("media_state", state), 10, 5).collect()] == ["c"]


def test_greedy_takes_the_crossing_row(spark):
    rows = [(f"a{k:03}", 10, float(k % 7), "video", "cloud" if k % 2 else "") for k in range(200)]
    df = spark.createDataFrame(rows, "asset_id string, bytes_local long, score double, kind string, storage_sink string")
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    assert sorted(r.asset_id for r in offload.greedy(df, 95).collect()) == sorted(r[0] for r in order[:10])
    assert offload.greedy(df, 0).collect() == [] and offload.greedy(df.where("false"), 5).collect() == []
    plan = offload.tiered(df, 1055).collect()
    assert sum(r.plan == "cloud_offload" for r in plan) == 100 and sum(r.plan == "full_eviction" for r in plan) == 6
    assert offload.greedy(df, 95, "normal").collect() == []


def test_equal_scores_are_summed_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(offload, "RANGE_ROWS", 50)
    rows = [(f"a{k:04}", 1, 1.0 if k % 3 else float(k % 5)) for k in range(1000)]
    df = spark.createDataFrame(rows, "asset_id string, bytes_local long, score double")
    got = {r.asset_id: r.ahead for r in offload.running_before(df, "score", "asset_id", "bytes_local", "ahead").collect()}
    assert got == {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])))}


def test_ties_are_on_the_next_page(spark):
    df = spark.createDataFrame([(k, 1, 100 - k // 3) for k in range(10)], "message_id long, conversation_id long, created_at_ms long")
    seen, before, after = [], None, None
    while page := store.timeline(df, 1, before, 2, after).collect():
        seen += [r.message_id for r in page]
        before, after = page[-1].created_at_ms, page[-1].message_id
    assert seen == list(range(10))


def test_streamed_results_are_tables(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = "id event_id", "timestamp_ntz'2024-01-31 23:00:00' + make_dt_interval(0, int(id)) ts", "id % 3 user_id", "if(id % 5 = 0, 'error', 'click') event_type", "2D value", "'{\"k\": 4}' props"
    for n in range(3):  # each run goes on from the one before
        spark.range(10 * n, 10 * n + 10).selectExpr(*rows).write.mode("append").parquet(source)
        heads = streams.heads(streams.journal_stream(spark, source))
        streams.to_table(heads, f"{out}/heads", f"{out}/cursor").awaitTermination()
    got = {r.conversation_id: r.created_at_ms for r in streams.latest(spark, f"{out}/heads", ["conversation_id"]).collect()}
    want = tables.journal_of(spark.range(30).selectExpr(*rows)).where("event_type = 'message_received'").groupBy("conversation_id").agg(F.max("created_at_ms").alias("m"))
    assert got == {r.conversation_id: r.m for r in want.collect()}


def test_pressure(spark):
    df = spark.createDataFrame([(100,), (101,), (91,), (90,), (76,), (75,)], "t long")
    assert [r[0] for r in df.select(offload.pressure(F.col("t"), 100)).collect()] == ["critical", "extreme", "critical", "warning", "warning", "normal"]


def test_percentiles_are_nearest_rank(spark):
    df = spark.createDataFrame([("x", float(v)) for v in range(1, 101)] + [("y", 7.0)], "operation string, duration double")
    got = {r.operation: (r.p50, r.p95, r.p99, r.n) for r in analytics.percentiles(df).collect()}
    assert got == {"x": (50.0, 95.0, 99.0, 100), "y": (7.0, 7.0, 7.0, 1)}


def test_dedup_of_nothing(spark):
    row = analytics.dedup_stats(spark.createDataFrame([], "d string, s long"), "d", "s").first()
    assert row.total_objects == 0 and row.ratio_percent == 0 and row.bytes_saved == 0


def test_restore(spark):
    rows = [(1, "message_received", 1, 1, 100), (2, "message_received", 1, 2, 200), (3, "message_deleted", 1, 2, 300), (4, "message_received", 1, None, 300)]
    events = spark.createDataFrame(rows, EVENT)
    assert [(r.message_id, r.body_state) for r in restore.restored(events, 150, 60).collect()] == [(1, "local_plain_available")]
    assert restore.restored(events, 250, 100, compat=True).count() == 2


def test_chain(spark):
    made = journal.chained(spark.createDataFrame([(0, g, f"c{g}") for g in range(5)], "chain int, generation int, content string"))
    assert journal.chain_faults(made).count() == 0
    broken = made.withColumn("previous_hash", F.when(F.col("generation") == 3, "x").otherwise(F.col("previous_hash")))
    assert [r.generation for r in journal.chain_faults(broken).collect()] == [3]


def test_queue_and_transitions(spark):
    tap, viewport = "search_result_tap", "visible_viewport"
    rows = [(1, "adjacent_prefetch", 5), (1, viewport, 9), (2, tap, 10), (3, viewport, 2), (4, "opportunistic_fill", 0), (5, "background_restore", 0), (6, "media_full_screen", 99)]
    queue = store.hydration_queue(spark.createDataFrame(rows, "message_id long, reason string, requested_at_ms long"))
    assert [r.message_id for r in queue.collect()] == [2, 6, 3, 1, 5, 4]
    local, gone = "local_plain_available", "deleted_for_me"
    changes = spark.createDataFrame([("body", local, gone), ("body", gone, local), ("media", local, gone)], "machine string, from_state string, to_state string")
    assert sorted((r.machine, r.from_state) for r in store.illegal(changes).collect()) == [("body", gone), ("media", local)]


def test_restore_progress(spark):
    order = [b for _, b in store.TRANSITIONS["restore"]]
    rows = [(1, 1, "identity_restored"), (1, 2, order[0]), (1, 3, order[2]), (1, 4, order[1]), (2, 1, order[0]), (3, 1, "identity_restored")]
    got = {r.run: (r.state, r.refused) for r in restore.progress(spark.createDataFrame(rows, "run int, seq int, to_state string")).collect()}
    assert got == {1: ("root_keys_unwrapped", 2), 2: (None, 1), 3: ("identity_restored", 0)}


def test_eligibility(spark):
    kinds = ["video", "document", "image", "audio", "thumbnail", "text"]
    df = spark.createDataFrame([(k,) for k in kinds], "kind string")
    allowed = {level: [r.kind for r in df.where(offload.eligible(F.col("kind"), level)).collect()] for level in ("normal", "warning", "critical", "extreme")}
    assert allowed == {"normal": [], "warning": kinds[:4], "critical": kinds[:5], "extreme": kinds}


def test_late_events_move_no_head(spark):
    conv = spark.createDataFrame([(1, 100, 10), (2, None, None)], "conversation_id long, last_activity_ms long, last_message_id long")
    events = spark.createDataFrame([(1, 11, 50), (2, 20, 5)], "conversation_id long, message_id long, created_at_ms long")
    assert sorted((r.conversation_id, r.last_message_id) for r in store.heads(conv, events).collect()) == [(1, 10), (2, 20)]


def test_streamed_archive_is_exactly_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    made = spark.range(4).selectExpr(
        "id event_id", "timestamp_ntz'2024-01-31 23:00:00' + make_dt_interval(0, int(id)) ts", "id % 3 user_id", "'click' event_type", "1D value", "'{\"k\": 4}' props"
    )
    made.write.parquet(source)
    for _ in range(2):  # the second run finds nothing new
        streams.archive(streams.journal_stream(spark, source), out, str(tmp_path / "cursor")).awaitTermination()
    made.withColumn("event_id", F.col("event_id") + 10).write.mode("append").parquet(source)
    streams.archive(streams.journal_stream(spark, source), out, str(tmp_path / "cursor")).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 8 and {r.time_bucket for r in got.select(F.col("time_bucket").cast("string").alias("time_bucket")).collect()} == {"2024-01", "2024-02"}


def test_engine(spark):
    engine = Engine(spark, "/root/testdata/sf0.001")
    assert engine.search(SearchQuery("the"), 5).count() <= 5
    assert engine.search(SearchQuery("the"), 5, include_cold=True).columns[0] == "message_id"
    assert engine.list_conversations().count() == engine.conversations.count()
    assert engine.timeline(0, limit=2).count() == 2 and engine.get_message(0).count() == 1
    assert engine.ingest(engine.messages).count() == 0
    assert tables.media_index(spark, engine.folder).columns == ["asset_id", "kind", "text"]


def test_counters_never_fall_below_zero(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice(("uploaded", "deleted", "deleted")), rng.randint(0, 50), rng.random() < 0.5) for k in range(500)]
    totals = [0, 0]
    for _, kind, size, _ in rows:
        sign = 1 if kind == "uploaded" else -1
        totals = [max(0, totals[0] + sign), max(0, totals[1] + sign * size)]
    new = [r for r in rows if r[1] == "uploaded" and not r[3]]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges
    try:
        df = spark.createDataFrame(rows, "seq long, kind string, size_bytes long, was_deduped boolean")
        ranges = analytics.counter_ranges(df)
        assert ranges.count() > 1
        got = analytics.counted(ranges).first()
        assert (got.total_objects, got.total_bytes, got.unique_objects, got.unique_bytes) == (*totals, len(new), sum(r[2] for r in new))
        one = spark.createDataFrame([(1, "deleted", 5, False), (2, "uploaded", 3, False)], df.schema)
        assert tuple(analytics.running_counters(one).first()) == (1, 1, 3, 3)
        assert tuple(analytics.running_counters(df.where("false")).first()) == (0, 0, 0, 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_deletions_and_bodies_follow_the_life_cycle(spark):
    rows = [(1, 1, "a", "local_plain_available", None), (2, 1, "b", "local_plain_available", None), (3, 1, None, "remote_archive_only", None), (4, 1, None, "deleted_for_everyone", 5)]
    messages = spark.createDataFrame(rows, "message_id long, conversation_id long, text string, body_state string, deleted_at_ms long")
    asked = spark.createDataFrame([(1, False), (2, True), (2, None), (3, True), (4, False), (9, True)], "message_id long, for_everyone boolean")
    got = {r.message_id: (r.text, r.body_state, r.deleted_at_ms, r.refused) for r in store.deleted(messages, asked, 77).collect()}
    assert got == {
        1: ("a", "deleted_for_me", 77, False),
        2: (None, "deleted_for_everyone", 77, False),
        3: (None, "remote_archive_only", None, True),
        4: (None, "deleted_for_everyone", 5, True),
    }
    assert sorted((r.message_id, r.scope) for r in store.deletion_events(messages, asked, 77).collect()) == [(1, "for_me"), (2, "for_everyone")]
    fetched = spark.createDataFrame([(3, "came"), (3, "came"), (4, "came"), (1, "came"), (9, "came"), (2, None)], "message_id long, text string")
    bodies = {r.message_id: (r.text, r.body_state) for r in store.rehydrated(messages.select("message_id", "text", "body_state"), fetched).collect()}
    assert bodies == {1: ("a", "local_plain_available"), 2: ("b", "local_plain_available"), 3: ("came", "local_plain_available"), 4: (None, "deleted_for_everyone")}
    assert [r.message_id for r in store.unknown(messages, fetched).collect()] == [9]


def test_a_row_takes_one_change_of_a_batch(spark):
    rows = spark.createDataFrame([(1, "original_local"), (2, "original_local")], "asset_id long, media_state string")
    changes = spark.createDataFrame([(1, "evicted"), (1, "deleted"), (2, "evicted"), (2, "evicted")], "asset_id long, to_state string")
    got = {r.asset_id: (r.media_state, r.refused) for r in store.moved_singly(rows, changes, "asset_id", "media_state", "media").collect()}
    assert got == {1: ("original_local", True), 2: ("evicted", False)}


def test_eviction_and_rehydration_leave_other_assets_alone(spark):
    kind = "asset_id long, media_state string, bytes_local long, bytes_total long, local_path string"
    rows = [(1, "original_local", 5, 5, "/a"), (2, "deleted", 0, 7, None), (3, "download_in_progress", 2, 9, "/c"), (4, None, 1, 1, "/d"), (5, "evicted", 0, 4, None)]
    assets = spark.createDataFrame(rows, kind)
    plan = spark.createDataFrame([(1,), (1,)], "asset_id long")
    assert {r.asset_id: (r.media_state, r.bytes_local) for r in offload.evicted(assets, plan).collect()} == {
        1: ("evicted", 0), 2: ("deleted", 0), 3: ("download_in_progress", 2), 4: (None, 1), 5: ("evicted", 0),
    }
    came = spark.createDataFrame([(5, "/e")], "asset_id long, local_path string")
    assert {r.asset_id: (r.media_state, r.local_path) for r in store.rehydrated_media(assets, came).collect()} == {
        1: ("original_local", "/a"), 2: ("deleted", None), 3: ("download_in_progress", "/c"), 4: (None, "/d"), 5: ("original_local", "/e"),
    }


def test_messages_meet_conversations_before_assets_are_shuffled(spark):
    plan = tables.assets(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() == "Project":
        plan = plan.child()
    assert plan.nodeName() == "Join"
    # of the two sides one is the assets' own table, which no other join has met
    sides = [plan.children().apply(k) for k in range(2)]
    assert sorted("Join" in side.toString() for side in sides) == [False, True]
