from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from parley.llm import line_dedup, simhash
from parley.llm.common import store
from parley.llm.components import components

from .conftest import syllables


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=2):
    """doc ids by fingerprint, one list for each group."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(fps)), 2):
        if bin(fps[a] ^ fps[b]).count("1") <= radius:
            parent[find(a)] = find(b)
    return [find(k) for k in range(len(fps))]


def test_every_pair_within_the_radius_collides():
    kept = [set(simhash.kept_bits(v)) for v in range(1, simhash.TABLES + 1)]
    for pair in combinations(range(64), 2):
        assert any(not own & set(pair) for own in kept)


def test_fingerprint(edge_rows):
    for _, text in edge_rows:
        if text is None or len(text) < 5000:
            assert simhash.fingerprint(text or "") & (2**64 - 1) == brute_fingerprint(text)


def test_links_join_exactly_those_within_two_bits(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for fp in base:
        for n in (1, 2, 2, 3, 4):
            near = fp
            for bit in rng.sample(range(64), n):
                near ^= 1 << bit
            fps.add(near)
    hub = rng.getrandbits(64)
    fps |= {hub ^ (1 << a) ^ (1 << b) for a, b in combinations(range(0, 40, 2), 2)}  # one large group
    fps = sorted(fps)
    signed = [simhash._signed(f) for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    for e in edges:
        assert bin((e.a ^ e.b) & (2**64 - 1)).count("1") <= 2
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute_components(fps)
    groups, seen = {}, {}
    for f, g in zip(signed, want):
        groups.setdefault(g, set()).add(f)
        seen.setdefault(roots.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, seen.values()))


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 60)] + [(200, 201)], [(3, 9), (9, 3), (9, 5)]])
def test_components(spark, edges):
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    parent = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            if a != b:
                parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent


def test_stars_are_not_contracted_again(spark, monkeypatch):
    """One table is stored for edges that are stars, where a contraction of eight stages found that nothing changed."""
    kept, one = [], store
    monkeypatch.setattr("parley.llm.components.store", lambda df, name: kept.append(name) or one(df, name))
    edges = [(1, k) for k in range(2, 40)] + [(50, 51), (52, 50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 40)} | {k: 50 for k in (50, 51, 52)}
    assert len(kept) == 1


def test_near_duplicates(make_docs, edge_rows):
    docs = make_docs(edge_rows, clash=True)
    got = simhash.near_duplicates(docs).collect()
    fps = [brute_fingerprint(t) if t is None or len(t) < 5000 else simhash.fingerprint(t) & (2**64 - 1) for _, t in edge_rows]
    group = brute_components(fps)
    least = {}
    for (doc_id, _), g in zip(edge_rows, group):
        if doc_id is not None:
            least[g] = min(doc_id, least.get(g, doc_id))
    want = Counter((d, f"{fp:016x}", least.get(g)) for (d, _), fp, g in zip(edge_rows, fps, group))
    assert Counter(tuple(r) for r in got) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(least[g] for g in set(group))
    assert simhash.near_duplicates(make_docs([])).collect() == [] and simhash.keep_one(make_docs([])).collect() == []


def test_rows_without_ids(make_docs):
    docs = make_docs([(None, "x y z w"), (None, "x y z w")])
    assert simhash.keep_one(docs).count() == 1 and {r.component_id for r in simhash.near_duplicates(docs).collect()} == {None}


def brute_lines(rows):
    """Texts without later windows; rows in scan order."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k))
    seen, out = set(), {}
    for k in order:
        lines = (rows[k][1] or "").split("\n")
        gone = set()
        for s in range(len(lines) - 2):
            window = tuple(lines[s : s + 3])
            if window in seen:
                gone |= {s, s + 1, s + 2}
            seen.add(window)
        out[k] = "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else rows[k][1]
    return [(rows[k][0], out[k]) for k in range(len(rows))]


def test_line_dedup(make_docs, edge_rows):
    rng = random.Random(4)
    few = [syllables(rng, 3) for _ in range(4)]
    rows = edge_rows + [(20 + k, "\n".join(rng.choice(few) for _ in range(rng.randint(0, 12)))) for k in range(60)]
    docs = make_docs(rows, clash=True)
    out = line_dedup.dedup_lines(docs, removed="n_removed")
    got = out.collect()
    assert out.columns == [*docs.columns, "n_removed"]
    want = Counter(brute_lines([(r.doc_id, r.text) for r in docs.collect()]))
    assert Counter((r.doc_id, r.text) for r in got) == want
    assert sum(r.n_removed for r in got) > 20
    assert line_dedup.dedup_lines(make_docs([])).collect() == []


def test_a_long_passage_stays_once(make_docs):
    rng = random.Random(8)
    passage = "\n".join(syllables(rng, 20) for _ in range(4))
    docs = make_docs([(k, f"{syllables(rng, 15)}\n{passage}\n{syllables(rng, 15)}") for k in range(30)])
    texts = [r.text for r in line_dedup.dedup_lines(docs).orderBy("doc_id").collect()]
    assert passage in texts[0] and all(passage not in t and t.count("\n") == 1 for t in texts[1:])


def test_native(make_docs):
    plan = line_dedup.dedup_lines(make_docs([(1, "a\nb\nc")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert F is not None
