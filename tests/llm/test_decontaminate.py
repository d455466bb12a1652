from __future__ import annotations

import random
import re
from collections import Counter

from parley.llm import decontaminate

from .conftest import syllables


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


def brute(docs, items):
    out = Counter()
    for doc_id, text in docs:
        own, hit, ids = words(text), set(), set()
        for item_id, body in items:
            item = words(body)
            m = min(13, len(item))
            windows = {tuple(item[s : s + m]) for s in range(len(item) - m + 1)} if m else set()
            found = [s for s in range(len(own) - m + 1) if m and tuple(own[s : s + m]) in windows]
            hit |= {s + k for s in found for k in range(m)}
            if found and item_id is not None:
                ids.add(str(item_id))
        out[doc_id, len(own), len(hit), tuple(sorted(ids)), len(hit) > 0 and 20 * len(hit) >= len(own)] += 1
    return out


def got(spark, docs, items, clash=False):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    return Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in decontaminate.judge(docs, benchmark).collect())


def test_against_brute_force(spark, make_docs, edge_rows, monkeypatch):
    rng = random.Random(6)
    items = [(k, syllables(rng, rng.randint(14, 40), "to be or not")) for k in range(25)]
    items += [(3, items[3][1]), (100, "One, two; three!"), (101, None), (102, ""), (None, "a a a a a a a"), (103, "Ünïcode STRASSE straße"), (9, "ΣΑΣ 日本語")]
    rows = list(edge_rows)
    for k in range(60):
        text = syllables(rng, rng.randint(0, 80), "to be or not")
        if k % 3 == 0:
            body = items[k % 25][1].split()
            cut = rng.randint(0, len(body) - 13)
            text += " ... " + "  ".join(body[cut : cut + rng.randint(12, 16)]).upper() + ". " + syllables(rng, 10)
        rows.append((50 + k, text))
    want = brute(rows, items)
    docs = make_docs(rows, clash=True)
    assert got(spark, docs, items) == want
    assert sum(k[2] > 0 for k in want) > 10  # some passages are of 12 words
    monkeypatch.setattr(decontaminate, "MOST_SLOTS", 1 << 10)  # many places are joined in vain
    assert got(spark, docs, items) == want


def test_many_anchors_and_a_long_item(spark, make_docs):
    """Over 20,000 windows with a shingle of their own, and an item of 10,000 words."""
    rng = random.Random(8)
    long = " ".join(f"w{rng.randint(0, 30_000)}" for _ in range(10_000))
    items = [(k, " ".join(f"i{k}x{j}" for j in range(13))) for k in range(21_000)] + [(50_000, long)]
    rows = [(1, "so it says " + items[17][1]), (2, " ".join(long.split()[5_000:5_013])), (3, long + " " + items[20_999][1]), (4, " ".join(long.split()[:12])), (5, long * 3)]
    few = [items[17], items[20_999], items[-1]]  # nothing else is in the rows
    assert got(spark, make_docs(rows), items) == brute(rows, few)


def test_only_common_words(spark, make_docs):
    """A window has no rare word, and a document repeats it."""
    item = " ".join(["the"] * 20)
    rows = [(1, " ".join(["the"] * 300)), (2, " ".join(["the"] * 12)), (3, "the " * 13 + "end")]
    assert got(spark, make_docs(rows), [(1, item)]) == brute(rows, [(1, item)])


def test_empty_tables(spark, make_docs, edge_rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.judge(make_docs([]), none).collect() == []
    judged = decontaminate.judge(make_docs(edge_rows), none).collect()
    assert len(judged) == len(edge_rows) and not any(r.n_hit or r["items"] for r in judged)
    assert decontaminate.judge(make_docs([]), spark.createDataFrame([(1, "a b")], none.schema)).collect() == []


def test_clean_documents_stay(spark, make_docs):
    rng = random.Random(7)
    item = syllables(rng, 30)
    rows = [(1, item), (2, syllables(rng, 50)), (3, syllables(rng, 600) + " " + item), (4, None)]
    docs = make_docs(rows, clash=True)
    kept = decontaminate.keep_clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]  # 30 of 630 words are under a twentieth


def test_native(spark, make_docs):
    found = decontaminate.judge(make_docs([(1, "a b")]), spark.createDataFrame([(1, "a b")], "item_id long, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_no_plan_spells_out_the_map(spark, make_docs, monkeypatch):
    """The map has 64 bytes for each of some 2,000 shingles, and was two digits a byte in every plan of the texts."""
    rng = random.Random(15)
    items = [(k, syllables(rng, 60)) for k in range(40)]
    docs = [(1, items[7][1]), (2, syllables(rng, 90)), (3, None)]
    lengths, one = [], decontaminate.stored

    def told(df, name):
        lengths.append(len(df._jdf.queryExecution().toString()))
        return one(df, name)

    monkeypatch.setattr(decontaminate, "stored", told)
    assert got(spark, docs=make_docs(docs), items=items) == brute(docs, items)
    assert max(lengths) < 50_000
