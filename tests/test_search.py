from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from parley.functions import text
from parley.operators import cold, index, match, search
from parley.operators.search import SearchQuery
from parley.sources import shared

T0 = 1_700_000_000_000
DAY = 86_400_000
BODIES = [
    "hello lighthouse keeper", "Привет, маяк светит", "你好世界朋友", "こんにちは世界", "مرحبا بالعالم", "lighthouse lighthouse at dawn", "hello мир 世界", "hello there",
]


@pytest.fixture(scope="module")
def messages(spark):
    rows = [(k, k % 3, ("ann", "bob")[k % 2], T0 + k * 1000, "text", "local_plain_available", b) for k, b in enumerate(BODIES)]
    return spark.createDataFrame(rows, "message_id long, conversation_id long, sender_id string, created_at_ms long, kind string, body_state string, text string")


def ids(df):
    return [r.message_id for r in df.collect()]


@pytest.mark.parametrize(
    "query, want",
    [
        ("hello", {0, 6, 7}), ("hello there", {7}), ("light*", {0, 5}), ('"lighthouse at"', {5}), ("hello NOT there", {0, 6}), ("there OR dawn", {5, 7}),
        ("AND hello", set()), ("hello AND", set()), ("keeper NEAR hello", {0}), ("Привет", {1}), ("", set()), ("NOT", set()),
    ],
)
def test_match(messages, query, want):
    found = messages.select("message_id", text.words(F.col("text")).alias("w")).where(match.predicate(F.col("w"), query))
    assert set(ids(found)) == want


def test_accents_and_widths_are_folded(spark):
    df = spark.createDataFrame([(1, "Un Café noir"), (2, "cafe\u0301"), (3, "ＣＡＦＥ １２"), (4, "Straße Łódź"), (5, "кафе й")], "message_id int, t string")
    split = df.select("message_id", text.words(F.col("t")).alias("w")).persist()
    assert [r.w for r in split.orderBy("message_id").collect()] == [["un", "cafe", "noir"], ["cafe"], ["cafe", "12"], ["straße", "łodz"], ["кафе", "й"]]
    for query in ("cafe", "CAFÉ", "ｃａｆｅ", "caf*"):
        assert set(ids(split.where(match.predicate(F.col("w"), query)))) == {1, 2, 3}
    split.unpersist()


@pytest.mark.parametrize("query", ["helo", "世界 hello", "-- 12 привет", "", "a", "é世界x"])
def test_query_grams_are_the_columns_grams(spark, query):
    found = search.fuzzy_grams(spark.createDataFrame([(0, query)], "message_id long, text string")).collect()
    want = {s: sorted(r.token for r in found if r.script == s) for s in sorted({r.script for r in found})}
    assert text.query_grams(query) == want


def test_the_index_is_the_scan(spark, messages, tmp_path):
    path = f"file:{tmp_path}/index"
    built = index.build(messages.where("message_id < 5"), path)
    built = index.added(built, messages.where("message_id >= 5"))
    for query in ("hello", "hello there", "light*", '"lighthouse at"', "hello NOT there", "there OR dawn", "keeper NEAR hello", "NOT", "", "世界", "привет"):
        by_words = search.full_text(messages, built.lexicon.query(query), built.words_of)
        for by_index, by_scan in ((index.full_text(built, query), by_words), (index.fuzzy(built, query), search.fuzzy_scan(messages, query))):
            near = [{r.message_id: round(r[1], 9) for r in df.collect()} for df in (by_index, by_scan)]
            assert near[0] == near[1], query
    assert set(ids(index.full_text(built, "世界"))) == {2, 3, 6}  # inside what is written without spaces
    plan = index.full_text(built, "hello there")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "part#" in plan and "ats:" not in plan and "text" not in plan


def test_near_is_bounded(spark):
    far = " ".join(["hello", *["x"] * 11, "keeper"])
    near = " ".join(["hello", *["x"] * 10, "keeper"])
    df = spark.createDataFrame([(0, far), (1, near)], "message_id int, t string").select("message_id", text.words(F.col("t")).alias("w"))
    assert ids(df.where(match.predicate(F.col("w"), "keeper NEAR hello"))) == [1]


def test_script_runs(spark):
    df = spark.createDataFrame([("--ab 世界, cd Привет!",), (None,), ("123",)], "t string")
    assert [r[0] for r in df.select(text.script_runs(F.col("t"))).collect()] == [["--ab ", "世界, ", "cd ", "Привет!"], [], []]


@pytest.mark.parametrize("body", ["é" + "word " * 200_000, "世界和平" * 80_000, "Привет " * 100_000, "abc é 世界 Привет! " * 40_000, "é" * 1_000_000])
def test_long_texts(spark, body):
    """A megabyte takes no stack for each character, nor time for each pair of them."""
    df = spark.createDataFrame([(1, body)], "message_id long, text string")
    short = spark.createDataFrame([(1, body[:2000])], "message_id long, text string")
    tokens = [{(r.script, r.token) for r in search.fuzzy_grams(x).collect()} for x in (df, short)]
    assert tokens[1] <= tokens[0] and len(tokens[0]) <= len(tokens[1]) + 3
    assert search.fuzzy_scan(df, body[:12]).count() == 1


def test_long_segments_have_the_same_grams(spark):
    df = spark.createDataFrame([("ab" * 40,), ("世界" * 40,), ("x" * 64,), ("x" * 65,)], "s string")
    for n in (2, 3):
        got = [r[0] for r in df.select(text.grams(F.col("s"), F.lit(n))).collect()]
        assert got == [[s[i : i + n] for i in range(len(s) - n + 1)] for (s,) in df.collect()]


def test_grams_by_script(messages):
    got = {(r.message_id, r.script, r.token) for r in search.fuzzy_grams(messages).collect()}
    assert {(2, "Han", "你好"), (2, "Han", "世界"), (3, "Hiragana", "こん"), (1, "Cyrillic", "при"), (0, "Latin", "hel")} <= got
    assert not any(len(t) != (2 if s in ("Han", "Hiragana", "Katakana") else 3) for _, s, t in got)


def test_fuzzy_scores(messages):
    grams = search.fuzzy_grams(messages)
    got = {r.message_id: r.fuzzy for r in search.fuzzy(grams, "helo").collect()}
    assert got == {0: 0.5, 6: 0.5, 7: 0.5}
    assert search.fuzzy(grams, "hexyzq").collect() == [] and search.fuzzy(grams, "a").collect() == []
    assert {r.message_id for r in search.fuzzy(grams, "世界").collect()} == {2, 3, 6}


@pytest.mark.parametrize("query", ["helo", "hexyzq", "a", "世界", "привет world", "hello 世界 мир", "—…", ""])
def test_scan_is_the_index(messages, query):
    by_index = search.fuzzy(search.fuzzy_grams(messages), query)
    assert sorted(map(tuple, search.fuzzy_scan(messages, query).collect())) == sorted(map(tuple, by_index.collect()))


def test_exact_before_fuzzy_and_each_once(messages):
    found = ids(search.hybrid(messages, SearchQuery("lighthouse"), 10))
    assert set(found) == {0, 5} and len(found) == 2
    mixed = search.hybrid(messages, SearchQuery("hello"), 10)
    assert ids(mixed) == ids(mixed) and set(ids(mixed)) == {0, 6, 7}


def test_recent_and_text_first(spark, messages):
    rows = [(1, 0, "a", T0, "text", "local_plain_available", "same words"), (2, 0, "a", T0 - 90 * DAY, "text", "local_plain_available", "same words"), (3, 0, "a", T0, "media", "local_plain_available", "same words")]
    found = search.hybrid(spark.createDataFrame(rows, messages.schema), SearchQuery("same words"), 10)
    assert ids(found) == [1, 3, 2]


def test_bounds_are_inclusive(messages):
    found = search.filtered(messages, SearchQuery(date_from=T0 + 1000, date_to=T0 + 3000))
    assert sorted(ids(found)) == [1, 2, 3]
    assert ids(search.hybrid(messages, SearchQuery(sender="bob"), 2)) == [7, 5]


def test_targets(spark, messages):
    conv = spark.createDataFrame([(0, "t0"), (1, "t1")], "conversation_id long, tenant_id string")
    assert search.target_conversations(conv, None) is None
    assert sorted(ids(search.in_target(messages, search.target_conversations(conv, ("tenant", "t1"))))) == [1, 4, 7]
    assert ids(search.in_target(messages, search.target_conversations(conv, ("unread", None)))) == []
    with pytest.raises(ValueError):
        search.target_conversations(conv, ("planet", 1))


def test_snippet(spark):
    df = spark.createDataFrame([("one two Three, four",), (None,)], "t string")
    assert [r[0] for r in df.select(search.snippet(F.col("t"), "three")).collect()] == ["one two <b>Three,</b> four", ""]


@pytest.fixture(scope="module")
def tiers(spark, messages, tmp_path_factory):
    rows = [(100, 0, "ann", T0 - 60 * DAY, "text", "remote_archive_only", "the old lighthouse"), (101, 1, "bob", T0 - 120 * DAY, "text", "remote_archive_only", "a lighthouse, older"), (5, 2, "bob", T0 + 5000, "text", "remote_archive_only", BODIES[5])]
    path = str(tmp_path_factory.mktemp("cold"))
    cold.write(spark.createDataFrame(rows, messages.schema), path)
    return messages, cold.read(spark, path), path


def test_cold_search(tiers):
    hot, stored, _ = tiers
    found = {r.message_id: r for r in cold.hot_and_cold(hot, stored, SearchQuery("lighthouse")).collect()}
    assert set(found) == {0, 5, 100, 101} and found[100].is_cold and not found[0].is_cold and not found[5].is_cold
    assert found[100].rank_score > found[101].rank_score
    assert len(cold.hot_and_cold(hot, stored, SearchQuery("lighthouse"), cold.Policy(most_buckets=1)).collect()) < 4
    local = cold.hot_and_cold(hot, stored, SearchQuery("lighthouse"), cold.Policy(forbid_global=True))
    assert set(ids(local)) == {0, 5}


def test_unreadable_months_are_named(tiers, spark, tmp_path):
    import glob
    import os
    import shutil

    _, stored, path = tiers
    own = str(tmp_path / "cold")
    shutil.copytree(path, own)
    assert cold.unreadable(spark, own).collect() == []
    broken = sorted(glob.glob(f"{own}/time_bucket=*/*.parquet"))[0]
    with open(broken, "wb") as f:
        f.write(b"PAR1 not whole")
    os.remove(os.path.join(os.path.dirname(broken), f".{os.path.basename(broken)}.crc"))
    month = broken.split("time_bucket=")[1][:7]
    assert [r.time_bucket for r in cold.unreadable(spark, own).collect()] == [month]
    assert month not in {r.m for r in cold.read(spark, own, stored.schema).select(F.col("time_bucket").cast("string").alias("m")).collect()}


def test_filters_and_coverage(tiers, spark, tmp_path):
    hot, stored, _ = tiers
    blooms = cold.write_blooms(stored.drop("time_bucket"), str(tmp_path / "blooms"))
    query, need = SearchQuery("lighthouse"), cold.Policy(require_bloom=True)
    whole = sorted(map(tuple, cold.hot_and_cold(hot, stored, query).collect()))
    assert sorted(map(tuple, cold.hot_and_cold(hot, stored, query, need, blooms=blooms).collect())) == whole
    assert set(ids(cold.hot_and_cold(hot, stored, query, need))) == {0, 5}  # a filter is required, and there is none
    assert {r.outcome for r in cold.coverage(stored, query, need).collect()} == {"no filter"}
    seen = cold.coverage(stored, SearchQuery("zebra", date_from=T0 - 70 * DAY), cold.Policy(most_buckets=1), blooms).collect()
    assert sum(r.groups for r in seen) == 3 and {r.outcome for r in seen} <= {"date", "cap", "filter", "fetched"} and {"date", "cap"} <= {r.outcome for r in seen}


def test_meaning_over_both_tiers(tiers, spark):
    hot, stored, _ = tiers
    vectors = spark.createDataFrame([(101, "v1", [1.0, 0.0]), (7, "v1", [0.8, 0.6]), (100, "v1", [0.0, 1.0])], "message_id long, model_version string, embedding array<float>")
    words = {r.message_id: r.rank_score for r in cold.hot_and_cold(hot, stored, SearchQuery("lighthouse")).collect()}
    both = {r.message_id: r.rank_score for r in cold.with_semantic(hot, stored, vectors, SearchQuery("lighthouse"), [1.0, 0.0]).collect()}
    assert set(both) == set(words) | {7} and both[101] == pytest.approx(words[101] + 1.5) and both[100] == pytest.approx(words[100])


def test_months_are_pruned_at_the_scan(tiers):
    _, stored, _ = tiers
    plan = cold.pruned(stored, SearchQuery(date_from=T0 - 70 * DAY, date_to=T0 - 50 * DAY))
    assert {r.message_id for r in plan.collect()} == {100}
    assert "PartitionFilters: [" in plan._jdf.queryExecution().executedPlan().toString()


def test_progress(tiers):
    hot, stored, _ = tiers
    events = list(cold.progressive(hot, stored, SearchQuery("lighthouse")))
    assert [e[0] for e in events][0] == "local" and events[-1][0] == "complete" and len(events) == 5
    found = [{r.message_id for r in df.collect()} for _, df in events]
    assert found[0] | found[1] | found[2] | found[3] == found[4]


def test_bloom(spark):
    """No word is missed, few others are held, and a word takes less than two bytes."""
    rows = [(k % 5, f"word{k}") for k in range(2000)]
    words = spark.createDataFrame(rows, "conversation_id int, word string")
    blooms = cold.bloom_table(words, ["conversation_id"]).persist()
    pairs = words.join(blooms, "conversation_id").select(cold.maybe_contains(F.col("word")).alias("may"))
    assert pairs.where("not may").count() == 0
    absent = spark.createDataFrame([(k % 5, f"absent{k}") for k in range(2000)], words.schema).join(blooms, "conversation_id")
    assert absent.where(cold.maybe_contains(F.col("word"))).count() / 2000 < 0.05
    blooms.unpersist()


@pytest.fixture(scope="module")
def corpus(spark):
    """Messages enough for many blocks; words differ much in how often they are."""
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    rows = [(k, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 60)))) for k in range(1500)]
    return spark.createDataFrame(rows, "message_id long, text string").persist()


def scores(df):
    return {r.message_id: round(r.bm25, 9) for r in df.collect()}


def test_an_index_follows_additions_edits_and_deletions(spark, corpus, tmp_path):
    first, second = corpus.where("message_id % 3 <> 0"), corpus.where("message_id % 3 = 0")
    built = index.added(index.build(first, f"file:{tmp_path}/i"), second)
    edited = corpus.where("message_id % 5 = 0")
    after = edited.withColumn("text", F.concat(F.lit("w59 new "), F.col("text")))
    built = index.changed(built, edited, after)
    now = corpus.where("message_id % 5 <> 0").unionByName(after)
    gone = now.where("message_id % 7 = 0")
    built = index.changed(built, gone, gone.where("false"))
    again = after.where("message_id % 7 <> 0 and message_id % 10 = 0")  # edited once more, back to what they were
    built = index.changed(built, again, edited.join(again.select("message_id"), "message_id", "left_semi"))
    now = now.where("message_id % 7 <> 0 and not (message_id % 5 = 0 and message_id % 10 = 0)").unionByName(edited.where("message_id % 7 <> 0 and message_id % 10 = 0"))
    now = now.persist()
    compact = index.compacted(built)
    for query in ("new", "w59 w1", '"w59 new"', "w5* NOT w3", "w50 OR w40", "w30 NEAR w2"):
        want = scores(search.full_text(now, query))
        assert scores(index.full_text(built, query)) == want, query
        assert scores(index.full_text(compact, query)) == want, query
    counts = {r.word: r.n for r in now.select(F.explode(F.array_distinct(text.words(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    for held in (built, compact):
        assert {r.word: r.df for r in index.terms(held, ["w5*", "new"]).collect()} == {w: n for w, n in counts.items() if w.startswith("w5") or w == "new"}
        assert held.n == now.count()
    assert sorted(index.fuzzy(built, "new").collect()) == sorted(search.fuzzy_scan(now, "new").collect())


def test_the_best_are_found_without_all_blocks(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 8)
    monkeypatch.setattr(index, "FIRST", 4)
    built = index.build(corpus, f"file:{tmp_path}/b")
    for query, k in (("w0 w1", 5), ("w40", 3), ("w0 OR w20", 10), ("w2 NOT w0", 5), ("w55 w56 w57", 5), ("w4*", 5), ('"w1 w0"', 5)):
        want = sorted(scores(search.full_text(corpus, query)).items(), key=lambda r: (-r[1], r[0]))[:k]
        assert sorted(scores(index.best(built, query, k)).items(), key=lambda r: (-r[1], r[0]))[:k] == want, query
    few, every = index.best(built, "w0 w1", 5), index.full_text(built, "w0 w1")
    assert few.count() < every.count()


def test_a_prefix_reads_the_ranges_of_its_terms(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "PART_MESSAGES", 100)
    built = index.build(corpus, f"file:{tmp_path}/p")
    of = {name: {p for _, n, p, _, _ in built.fences if n == name} for name in ("blocks", "terms")}
    assert len(of["blocks"]) > 4
    read = {r.part for r in built.table("blocks", wanted=index._bounds(["w5*"])).select("part").distinct().collect()}
    assert read and len(read) < len(of["blocks"])
    assert scores(index.full_text(built, "w5*")) == scores(search.full_text(corpus, "w5*"))


def test_an_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "message_id long, text string")
    built = index.build(none, f"file:{tmp_path}/n")
    assert built.n == 0 and not index.full_text(built, "a").collect() and not index.best(built, "a", 3).collect() and not index.fuzzy(built, "abc").collect()
    built = index.added(built, spark.createDataFrame([(1, "a b"), (2, None)], none.schema))
    assert built.n == 2 and [r.message_id for r in index.full_text(built, "a").collect()] == [1]


def test_a_search_of_the_cold_tier_stops(spark):
    rng = random.Random(2)
    rows = []
    for k in range(400):
        cold_one = k % 2 == 1
        body = "light house" if k % 40 == 1 else rng.choice(["hello light", "light", "house of cards", "nothing"])
        rows.append((k, k % 5, "ann", T0 + (k if cold_one else 400) * 2 * DAY, "text", "remote_archive_only" if cold_one else "local_plain_available", body if cold_one else body * 2))
    messages = spark.createDataFrame(rows, "message_id long, conversation_id long, sender_id string, created_at_ms long, kind string, body_state string, text string")
    hot = messages.where("body_state = 'local_plain_available'")
    far = messages.where("body_state <> 'local_plain_available'").withColumn("time_bucket", F.date_format(F.timestamp_millis("created_at_ms"), "yyyy-MM"))
    policy, skipped = cold.Policy(most_buckets=1000), {}
    for query, limit in (("light house", 2), ("light", 3), ("house", 500), ("zzz", 5)):
        want = cold.hot_and_cold(hot, far, SearchQuery(query), policy, limit)
        got, months = cold.stopping(hot, far, SearchQuery(query), policy, limit)
        near = [[(r.message_id, round(r.rank_score, 9), r.is_cold) for r in df.collect()] for df in (got, want)]
        assert near[0] == near[1], query
        skipped[query] = sum(r.outcome == "skipped" for r in months.collect())
    assert skipped["house"] == skipped["zzz"] == 0 and skipped["light"] + skipped["light house"] > 0, skipped
    nothing, none = cold.stopping(hot.where("false"), far, SearchQuery("light"), policy, 3)
    assert nothing.count() == 3 and none.where("outcome = 'fetched'").count() > 0


def test_ranges_grow_with_the_words_of_few_long_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "PART_WORDS", 400)
    texts = [(k, " ".join(f"w{(k * 7 + i) % 90}" for i in range(200))) for k in range(40)]
    own = spark.createDataFrame(texts, "message_id long, text string")
    built = index.build(own, f"file:{tmp_path}/long")
    assert built.generations[0].parts == 20
    blocks = built.table("blocks").groupBy("part").agg(F.sum("n").alias("n")).collect()
    assert len(blocks) > 10 and max(r.n for r in blocks) <= 1000
    grown = index.changed(built, own.where("message_id % 2 = 0"), own.where("false"))
    assert grown.generations[1].parts == 10  # what is taken away has words, too
    packed = index.compacted(grown)
    assert packed.generations[0].parts == 10
    assert scores(index.full_text(packed, "w5 w6")) == scores(search.full_text(own.where("message_id % 2 = 1"), "w5 w6"))


def test_word_places(spark):
    bodies = ["", "a", "b a b  a c", "é e E É x", None, " ".join(f"w{k % 7}" for k in range(500))]
    split = spark.createDataFrame(list(enumerate(bodies)), "message_id int, text string").select("message_id", text.words(F.col("text")).alias("words"))
    for r in split.select("message_id", "words", text.word_places(F.col("words")).alias("posts")).collect():
        want = {w: [i for i, v in enumerate(r.words) if v == w] for w in r.words}
        assert {p.word: p.places for p in r.posts} == want and len(r.posts) == len(want), r.message_id


def test_a_build_moves_postings_once_and_leaves_nothing_else(spark, corpus, tmp_path):
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(folder.glob("index-*"))
    built = index.build(corpus, f"file:{tmp_path}/once")
    index.compacted(index.changed(built, corpus.where("message_id < 9"), corpus.where("message_id < 5")))
    assert set(folder.glob("index-*")) == before
    split, _ = index._split(built, corpus)
    blocks = index._blocks(index.word_postings(split, index._bucket(split)[0]), 4)
    assert blocks.count() == built.table("blocks").count()
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan


def test_an_index_of_words_alone(spark, corpus, tmp_path):
    path = f"{tmp_path}/words"
    built = index.build(corpus.where("message_id % 2 = 0"), f"file:{path}")
    built = index.build(corpus.where("message_id % 2 = 0"), f"file:{path}", grams=False)
    built = index.added(built, corpus.where("message_id % 2 = 1"))
    gone = corpus.where("message_id % 9 = 0")
    built = index.changed(built, gone, gone.where("false"))
    packed, now = index.compacted(built), corpus.where("message_id % 9 <> 0")
    for query in ("w3 w1", '"w1 w0"', "w5* NOT w3"):
        want = scores(search.full_text(now, query))
        assert scores(index.full_text(built, query)) == scores(index.full_text(packed, query)) == want, query
    for held in (built, packed):
        assert not list(Path(path).glob("gen-*/grams"))
        with pytest.raises(ValueError, match="words alone"):
            index.fuzzy(held, "abc")


def test_what_grows_is_read_in_pieces(spark, corpus, tmp_path, monkeypatch):
    """A task of a build shuffles a bounded piece of the stored words, whatever their files; then the setting is as it was."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    monkeypatch.setattr(index, "PIECE", 20_000)
    monkeypatch.setitem(index._STORED, "parquet.block.size", "20000")
    split, _ = index._split(index.build(corpus, f"file:{tmp_path}/pieces", grams=False), corpus.coalesce(1))
    with shared.pieces(spark, index.PIECE):
        assert spark.read.schema(split.schema).parquet(*split.inputFiles()).rdd.getNumPartitions() > 1
    assert spark.read.schema(split.schema).parquet(*split.inputFiles()).rdd.getNumPartitions() == 1
    with pytest.raises(ZeroDivisionError), shared.pieces(spark, 1 << 50):
        assert spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) < 1 << 50  # never larger
        1 / 0  # noqa: B018
    assert spark.conf.get(name) == before


def test_an_index_is_built_in_rounds(spark, corpus, tmp_path, monkeypatch):
    """Only some of the postings are shuffled at a time, and the index is the same."""
    monkeypatch.setattr(index, "ROUND", 1)
    built = index.build(corpus.repartition(3), f"file:{tmp_path}/rounds", grams=False)
    blocks = built.table("blocks")
    assert blocks.select("part").distinct().count() == 12
    assert blocks.groupBy("bucket").agg(F.max(F.floor(F.col("part") / 4)).alias("a"), F.min(F.floor(F.col("part") / 4)).alias("b")).where("a <> b").count() == 0
    for query in ("w3 w1", '"w1 w0"', "w5* NOT w3"):
        assert scores(index.full_text(built, query)) == scores(search.full_text(corpus, query)), query
    want = sorted(scores(search.full_text(corpus, "w0 OR w20")).items(), key=lambda r: (-r[1], r[0]))[:10]
    assert sorted(scores(index.best(built, "w0 OR w20", 10)).items(), key=lambda r: (-r[1], r[0]))[:10] == want
