from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parley.functions import text
from parley.operators import index, lexicon

#: Words that the texts are made of, which the table has to find.
HAN = ["会议", "明天", "改期", "北京", "大学生", "我", "在", "去", "电话", "时间"]


def brute(texts, least, cohesion):
    counts = Counter()
    for t in texts:
        for run in lexicon._PIECES.findall(t or ""):
            if lexicon.UNSPACED.match(run):
                for k in range(len(run)):
                    for size in range(1, lexicon.LONGEST + 1):
                        if k + size <= len(run):
                            counts[run[k : k + size]] += 1
    total = sum(n for w, n in counts.items() if len(w) == 1)
    kept = {}
    for w, n in counts.items():
        ties = [n / counts[w[:k]] * total / counts[w[k:]] for k in range(1, len(w))]
        if len(w) == 1 or n >= least and min(ties) >= cohesion:
            kept[w] = n
    return kept


def brute_cost(found, run):
    """The least cost over all ways to cut a run."""
    if not run:
        return 0.0
    ways = []
    for size in range(1, min(found.longest, len(run)) + 1):
        cost = found.costs.get(run[:size], found.unknown if size == 1 else None)
        if cost is not None:
            ways.append(cost + brute_cost(found, run[size:]))
    return min(ways)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    return ["".join(rng.choice(HAN) for _ in range(rng.randint(3, 9))) + rng.choice(["", "。ok", " Café"]) for _ in range(300)] + [None, "", "plain words"]


@pytest.fixture(scope="module")
def known(spark, texts):
    return lexicon.read(lexicon.learned(spark.createDataFrame([(t,) for t in texts], "text string"), 3))


def test_the_table_is_what_brute_force_counts(texts, known):
    assert dict(known.rows) == brute(texts, 3, lexicon.COHESION)
    assert set(HAN) - {"我", "在", "去"} <= set(known.costs)


def test_a_cut_has_the_least_cost(known):
    rng = random.Random(10)
    for _ in range(50):
        run = "".join(rng.choice([*HAN, "龙"]) for _ in range(rng.randint(1, 5)))
        own = known.cut(run)
        assert "".join(own) == run
        assert sum(known.costs.get(w, known.unknown) for w in own) == pytest.approx(brute_cost(known, run))
    assert known.cut("明天在北京会议") == ["明天", "在", "北京", "会议"]


def test_words_of_mixed_texts(spark, known):
    bodies = ["明天会议 OK", "ＡＢＣ ﾃｽﾄ Café", "", None, "plain Words", "会议-北京"]
    df = spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "k int, t string")
    got = [r.w for r in df.select("k", known.column()(F.col("t")).alias("w")).orderBy("k").collect()]
    assert got[0] == ["明天", "会议", "ok"] and got[2] == [] and got[4] == ["plain", "words"] and got[5] == ["会议", "北京"]
    assert got[1][0] == "abc" and got[1][-1] == "cafe" and "".join(got[1][1:-1]) == "テスト"
    assert got[3] == []
    assert known.query('meet 明天会议 "北京会议 now" x*') == 'meet "明天 会议" "北京 会议 now" x*'


def test_a_word_inside_a_run_is_found(spark, texts, tmp_path):
    rows = [(k, t) for k, t in enumerate(texts)]
    built = index.build(spark.createDataFrame(rows, "message_id long, text string"), f"file:{tmp_path}/i")
    cut = built.lexicon
    for query in ("会议", "明天会议", "大学生 NOT 我", "北京 OR plain"):
        got = {r.message_id for r in index.full_text(built, query).collect()}
        words = {k: cut.words(t) for k, t in rows}

        def has(k, *run):
            return any(words[k][i : i + len(run)] == list(run) for i in range(len(words[k])))

        want = {
            "会议": {k for k in words if has(k, "会议")},
            "明天会议": {k for k in words if has(k, "明天", "会议")},
            "大学生 NOT 我": {k for k in words if has(k, "大学生") and not has(k, "我")},
            "北京 OR plain": {k for k in words if has(k, "北京") or has(k, "plain")},
        }[query]
        assert got == want and want, query
    built = index.added(built, spark.createDataFrame([(9000, "我们明天会议")], "message_id long, text string"))
    assert 9000 in {r.message_id for r in index.best(built, "会议", 200).collect()}


def test_other_scripts_need_no_lexicon(spark, tmp_path):
    built = index.build(spark.createDataFrame([(1, "hello there")], "message_id long, text string"), f"file:{tmp_path}/n")
    assert built.lexicon is None and text.fold_query("Ａ") == "a"
