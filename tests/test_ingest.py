from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from parley.engine import Engine
from parley.operators import index, search
from parley.operators.search import SearchQuery
from parley.streaming.ingest import Sink

KIND = "message_id long, conversation_id long, sender_id string, created_at_ms long, kind string, text string"
T0 = 1_700_000_000_000


def rows(ids, text="hello {}"):
    return [(k, k % 3, "ann", T0 + 1000 * k, "text", text.format(k)) for k in ids]


def state(sink, epoch):
    return (
        sorted(map(tuple, sink.messages.collect())),
        sorted(map(tuple, sink.journal.collect())),
        sorted(map(tuple, sink.heads.collect())),
        sorted((r.message_id, round(r.bm25, 9)) for r in index.full_text(sink.index(epoch), "hello").collect()),
    )


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    sink = Sink(spark, f"file:{tmp_path}", KIND)
    batches = [rows(range(5)), rows([7, 3, 4, 7]) + [(8, 1, " ", T0, "text", "no sender")], rows([2, 6], "late hello {}")]
    for epoch, own in enumerate(batches):
        sink.write(spark.createDataFrame(own, KIND), epoch)
    once = state(sink, 2)
    assert [r[0] for r in once[0]] == [0, 1, 2, 3, 4, 6, 7] and len(once[1]) == 7
    assert {r[0]: r[1] for r in once[2]} == {0: 6, 1: 7, 2: 2}
    assert [r[0] for r in once[3]] == [0, 1, 2, 3, 4, 6, 7]
    for epoch in (2, 1, 2):
        sink.write(spark.createDataFrame(batches[epoch], KIND), epoch)
    assert state(sink, 2) == once


def test_a_stream_takes_each_message_once(spark, tmp_path):
    for name, own in (("1", rows(range(6))), ("2", rows(range(3, 9)) + rows([8]))):
        spark.createDataFrame(own, KIND).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    sink = Sink(spark, f"file:{tmp_path}/out", KIND)
    arriving = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    for _ in range(2):  # started again there is nothing new
        sink.start(arriving, f"{tmp_path}/cursor").awaitTermination()
    assert sorted(r.message_id for r in sink.messages.collect()) == list(range(9))
    assert sorted(r.message_id for r in index.full_text(sink.index(sink.epochs), "hello").collect()) == list(range(9))


@pytest.fixture
def engine(spark, tmp_path):
    found = Engine(spark, "/root/testdata/sf0.001")
    found.build_index(f"file:{tmp_path}/engine")
    return found


def test_the_engine_searches_its_index_as_it_changes(engine, spark):
    def agree(query):
        own = [(r.message_id, round(r.rank_score, 6)) for r in engine.search(SearchQuery(query), 30).collect()]
        scanned = search.hybrid(engine.messages, SearchQuery(query), 30).collect()
        assert own == [(r.message_id, round(r.rank_score, 6)) for r in scanned], query
        return [m for m, _ in own]

    plan = engine.search(SearchQuery("the thre"), 30)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan  # no text is split
    before = agree("the thre")
    assert before
    ids = [r.message_id for r in engine.messages.where("body_state = 'local_plain_available'").orderBy("message_id").limit(4).collect()]
    edits = spark.createDataFrame([(ids[0], "zyzzyva one", T0, 1), (ids[1], "zyzzyva two", T0, 1)], "message_id long, new_text string, edited_at_ms long, seq long")
    engine.change(edits)
    assert set(agree("zyzzyva")) == set(ids[:2])
    engine.take_in(spark.createDataFrame([(999_999_001, 1, "ann", T0, "text", "zyzzyva three")], KIND))
    assert set(agree("zyzzyva")) == {*ids[:2], 999_999_001}
    remote = engine.messages.where("body_state = 'remote_archive_only'").orderBy("message_id").first().message_id
    engine.drop(spark.createDataFrame([(ids[0], True), (remote, True)], "message_id long, for_everyone boolean"), T0)
    assert {r.message_id for r in index.full_text(engine.index, "zyzzyva").collect()} == {ids[1], 999_999_001}
    assert engine.messages.where(F.col("message_id") == ids[0]).first().body_state == "deleted_for_everyone"
    assert engine.index.n == engine.messages.count() - 1
