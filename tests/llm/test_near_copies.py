from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import corpus_pipeline
from parley.llm import near_copies

from .conftest import syllables


def brute_groups(texts):
    """The group of each text: what pairs of five-word Jaccard 0.8 or more connect."""
    sets = []
    for t in texts:
        words = (t or "").lower().split()
        sets.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set()))
    group = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        x, y = sets[a], sets[b]
        if group[a] != group[b] and 5 * len(x & y) >= 4 * len(x | y):
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    return group


def changed(rng, text, n):
    words = text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = f"changed{rng.random()}"
    return " ".join(words)


def sample(rng, chains: int = 3):
    texts = [syllables(rng, rng.randint(1, 300)) for _ in range(40)] + [None, "", "one two", "one two"]
    for base in [syllables(rng, 200) for _ in range(30)]:
        texts += [base] + [changed(rng, base, n) for n in (1, 2, 4, 5, 9)]
    hub = syllables(rng, 200)
    texts += [hub] + [changed(rng, hub, rng.randint(1, 6)) for _ in range(80)]  # one large group
    for _ in range(chains):
        texts.append(hub)
        for _ in range(6):
            texts.append(changed(rng, texts[-1], 4))
    rng.shuffle(texts)
    return texts


def test_the_pipeline_keeps_one_of_each_group(spark, make_docs):
    rng = random.Random(21)
    texts = sample(rng)
    docs = make_docs([(k, t) for k, t in enumerate(texts)], clash=True)
    got = corpus_pipeline.dedup_documents(spark, docs, "")
    group = brute_groups(texts)
    least = {}
    for k, g in enumerate(group):
        least.setdefault(g, k)
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter(least.values())


def test_leaders_and_crossings_link_what_all_pairs_do(make_docs, monkeypatch):
    texts = sample(random.Random(22), 8)
    docs = make_docs([(k, t) for k, t in enumerate(texts)])
    want = sorted(r.doc_id for r in near_copies.keep_one(docs).collect())
    monkeypatch.setattr(near_copies, "PAIRS", 1)  # leaders until hardly any are left
    monkeypatch.setattr(near_copies, "LEADERS", 1)
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == want


def test_rounds_are_few_where_many_share_keys_and_none_is_near(make_docs, monkeypatch):
    rng = random.Random(23)
    clauses = [[syllables(rng, 8), syllables(rng, 8)] for _ in range(24)]
    texts = [" ".join(rng.choice(c) for c in clauses) for _ in range(300)]
    led, one = [], near_copies._led

    def counted(full, sets, leaders):
        led.append(leaders)
        return one(full, sets, leaders)

    monkeypatch.setattr(near_copies, "_led", counted)
    got = near_copies.keep_one(make_docs([(k, t) for k, t in enumerate(texts)])).collect()
    assert len(got) == len(set(brute_groups(texts)))
    assert led == [2, 8, 32] or led == [2, 8, 32, 128]


def test_nothing_and_no_ids(make_docs):
    assert near_copies.keep_one(make_docs([])).collect() == []
    assert near_copies.keep_one(make_docs([(None, "x y z"), (None, "x y z")])).count() == 1
