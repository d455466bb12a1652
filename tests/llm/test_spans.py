from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parley.llm import span_dedup, word_hashes

from .conftest import syllables

COLUMNS = {
    "doc_id": "doc.doc_id",
    "n_words": "cut.n_words",
    "n_removed": "cut.n_removed",
    "kept": "cut.kept",
}


def brute(rows):
    split = [(doc_id, (text or "").encode().split()) for doc_id, text in rows]
    least = {}
    for doc_id, own in split:
        if doc_id is not None:
            for s in range(len(own) - 12):
                run = tuple(own[s : s + 13])
                least[run] = min(least.get(run, doc_id), doc_id)
    out = []
    for doc_id, own in split:
        gone = set()
        if doc_id is not None:
            for s in range(len(own) - 12):
                if least[tuple(own[s : s + 13])] < doc_id:
                    gone.update(range(s, s + 13))
        kept = [w for k, w in enumerate(own) if k not in gone]
        out.append((doc_id, len(own), len(gone), b" ".join(kept).decode()))
    return sorted(out, key=str)


def found(docs):
    df = span_dedup.cut_spans(docs.select("doc_id", "text"), {n: F.col(c) for n, c in COLUMNS.items()})
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_spans_are_what_brute_force_says(make_docs):
    rng = random.Random(3)
    few = [f"w{k}" for k in range(3)]  # so that documents repeat within themselves
    passage, other = syllables(rng, 70).split(), syllables(rng, 40).split()
    rows = [(k, " ".join(rng.choice(few) for _ in range(rng.randint(0, 60)))) for k in range(20)]
    for k in range(100, 140):  # a third of all words are one passage, in pieces, with words changed
        own = passage[rng.randint(0, 30) : rng.randint(35, 70)]
        own[rng.randrange(len(own))] = rng.choice(few)
        rows.append((k, syllables(rng, 15) + "\n" + " ".join(own) + "\t\x0b " + " ".join(other[rng.randint(0, 9) :])))
    rows += [(k, " ".join(passage + other)) for k in range(200, 215)]  # copies
    rows += [(300, "x " * 40), (301, "x " * 60), (99, "y " * 30)]
    docs = make_docs(rows)
    assert found(docs) == brute(rows)


def test_edge_rows(make_docs, edge_rows):
    rows = [*edge_rows, (None, edge_rows[7][1]), (6, "One two THREE"), (20, " ".join(["same"] * 13)), (21, " ".join(["same"] * 12))]
    got = found(make_docs(rows))
    assert got == brute(rows)
    assert found(make_docs(rows, clash=True)) == got


def test_rows_of_one_id_keep_what_they_share(make_docs, rng):
    passage = syllables(rng, 30)
    rows = [(5, passage), (5, passage), (5, "other words before " + passage), (9, passage)]
    got = found(make_docs(rows))
    assert got == brute(rows)
    assert [r[2] for r in got] == [0, 0, 0, 30]


def test_dedup_gives_back_all_columns(make_docs, rng):
    passage = syllables(rng, 20)
    docs = make_docs([(1, passage), (2, "before\n\n" + passage + "\n after"), (3, "  left  as it is ")], clash=True)
    out = span_dedup.dedup_spans(docs)
    assert out.columns == docs.columns
    assert [r.text for r in out.orderBy("doc_id").collect()] == [passage, "before after", "  left  as it is "]


def test_empty_table(make_docs):
    assert found(make_docs([])) == []


def test_a_span_that_differs_from_its_source_is_told(spark):
    words = [f"w{k}" for k in range(40)]
    docs = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(words)), (2, " ".join(words[:39] + ["else"]))], "row long, text string")
    own = docs.select("row", F.struct(F.col("row").alias("doc_id"), "text").alias("doc"))
    claimed = spark.createDataFrame([(1, 3, 20, 0, 3), (2, 3, 25, 0, 3), (2, 0, 2, 0, 0)], "row long, start int, n int, src_row long, src_start int")
    cut = span_dedup._with_cuts(own, claimed, {"n_removed": F.col("cut.n_removed")})
    assert [(r.row, r.start) for r in span_dedup._wrong(cut).collect()] == [(2, 3)]


def test_paths_end_where_edges_branch(spark):
    # 1-2-3 goes on to 4-5 and to 14; all are in the same source
    edges = [(1, 2, 0), (2, 3, 1), (3, 4, 2), (4, 5, 3), (3, 14, 9)]
    rows = [(u, v, 1, most, 7, pos) for u, v, pos in edges for most in (1, 8)]
    got = span_dedup.paths(spark.createDataFrame(rows, "u long, v long, least long, most long, src_row long, src_pos int"))
    assert sorted((r.src_pos, r.path) for r in got.collect()) == [(0, 0), (1, 0), (2, 2), (3, 2), (9, 9)]


@pytest.mark.parametrize("limit", [1, 7, 1 << 22])
def test_words_are_hashed_alike_wherever_they_are(monkeypatch, limit):
    monkeypatch.setattr(word_hashes, "BYTES", limit)
    texts = ["a b\ta", None, "", "  \n", "ab\x0bé日本 a", "b"]
    hashes, doc = word_hashes.words(pa.array(["skip", *texts]).slice(1))
    own = [(k, w) for k, t in enumerate(texts) for w in (t or "").encode().split()]
    assert doc.tolist() == [k for k, _ in own]
    by_word = {}
    for (_, w), h in zip(own, hashes.tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word) == 4
    assert np.array_equal(word_hashes.runs(hashes, 2), word_hashes.runs(np.concatenate((hashes[:1], hashes)), 2)[1:])
