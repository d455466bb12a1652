from __future__ import annotations

import random
from collections import Counter

import numpy as np

import corpus_pipeline
from parley.llm import covered_copies, simhash

from .conftest import syllables
from .test_near_copies import brute_groups, changed, sample


def kept(texts):
    first = {}
    for k, g in enumerate(brute_groups(texts)):
        first.setdefault(g, k)
    return sorted(first.values())


def test_the_pipeline_uses_the_covering_hashing_and_loses_nothing(spark, make_docs, monkeypatch):
    texts = sample(random.Random(31))
    found, one = [], simhash.links

    def counted(distinct):
        out = one(distinct)
        found.append(out.count())
        return out

    monkeypatch.setattr(simhash, "links", counted)
    got = corpus_pipeline.dedup_documents(spark, make_docs([(k, t) for k, t in enumerate(texts)]), "").collect()
    assert sorted(r.doc_id for r in got) == kept(texts)
    assert len(found) == 1 and found[0] > 0


def test_blocks_find_what_whole_groups_do(make_docs, monkeypatch):
    texts = sample(random.Random(32), 8)
    monkeypatch.setattr(covered_copies, "BLOCK", 9)
    monkeypatch.setattr(covered_copies, "TIMES", 3)
    got = covered_copies.keep_one(make_docs([(k, t) for k, t in enumerate(texts)])).collect()
    assert sorted(r.doc_id for r in got) == kept(texts)


def test_pairs_grow_with_the_texts_of_a_group_not_their_square(make_docs, monkeypatch):
    rng = random.Random(33)
    base = syllables(rng, 200)
    clauses = [[syllables(rng, 8), syllables(rng, 8)] for _ in range(24)]
    texts = [changed(rng, base, rng.randint(1, 6)) for _ in range(150)]
    texts += [" ".join(rng.choice(c) for c in clauses) for _ in range(150)]  # they share keys and aren't near
    pairs, one = [], covered_copies.checked

    def counted(of, sets):
        pairs.append(of.count())
        return one(of, sets)

    monkeypatch.setattr(covered_copies, "checked", counted)
    got = covered_copies.keep_one(make_docs([(k, t) for k, t in enumerate(texts)])).collect()
    assert sorted(r.doc_id for r in got) == kept(texts)
    assert sum(pairs) < 20 * len(texts)


def test_parities_never_differ_in_more_than_the_sets():
    rng = np.random.default_rng(34)
    for n, m, common in ((3, 3, 2), (250, 260, 240), (250, 260, 100), (3000, 3300, 2900), (90_000, 80_000, 79_000)):
        every = np.unique(rng.integers(0, 1 << 63, n + m - common, dtype=np.uint64))
        rng.shuffle(every)
        bits = [np.frombuffer(covered_copies.parities(x), "<u8").reshape(1, -1) for x in (every[:n], every[n - common :])]
        while bits[0].size != bits[1].size:
            large = int(bits[1].size > bits[0].size)
            bits[large] = covered_copies._folded(bits[large])
        apart = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
        assert apart <= n + m - 2 * common
        assert n > 80_000 or apart > min(0.5 * (n + m - 2 * common), (n + m) / 9)


def test_proposals_are_a_forest_then_more_and_never_the_refused():
    rng = np.random.default_rng(35)
    base = np.unique(rng.integers(0, 1 << 63, 220, dtype=np.uint64))
    sets = [np.concatenate([base, rng.integers(0, 1 << 63, 9, dtype=np.uint64)]) for _ in range(40)]
    node, n = np.arange(100, 140), np.array([len(s) for s in sets])
    bits, none = [covered_copies.parities(s) for s in sets], [set() for _ in sets]
    forest = covered_copies.proposals(node, node.copy(), n, bits, none, 1)
    assert len(forest) == 39 and all(a > b for a, b in forest)
    roots = np.where(node < 120, 100, 120)
    assert len(covered_copies.proposals(node, roots, n, bits, none, 1)) == 1
    some = covered_copies.proposals(node, roots, n, bits, none, 8)
    assert len(some) == 8
    refused = [set() for _ in sets]
    for a, b in some:
        refused[a - 100].add(b)
    assert not set(some) & set(covered_copies.proposals(node, roots, n, bits, refused, 500))
    assert len(covered_copies.proposals(node, roots, n, bits, refused, 500)) == 20 * 20 - 8
    assert covered_copies.proposals(node, np.full(40, 100), n, bits, none, 8) == []


def test_empty_tables_ids_and_clashing_columns(make_docs, edge_rows):
    assert covered_copies.keep_one(make_docs([])).collect() == []
    assert covered_copies.keep_one(make_docs([(None, "x y z"), (None, "x y z")])).count() == 1
    docs = make_docs(edge_rows, clash=True)
    out = covered_copies.keep_one(docs)
    # 1 to 3 have no word, 4 and 5 are copies, and so are the passages, of which the one with an id stays
    assert out.columns == docs.columns and Counter(r.doc_id for r in out.collect()) == Counter([1, 4, 6, 7, 8, 9, 10, 11])
