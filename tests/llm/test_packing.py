from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from parley.llm import packing


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(packing.tokenizer_path())


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(packing.tokenizer_path())


def expected(whole, rows, capacity):
    out = Counter()
    for doc_id, text in rows:
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for k, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            out[doc_id, k, start, len(part), zlib.crc32(part.tobytes())] += 1
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x24F), st.sampled_from("'stredvmll .,!?\x85\xa0\u2028\u3000éÀß𝒳Σ")), max_size=60))
def test_ids_are_the_tokenizers(encoder, whole, text):
    assert np.frombuffer(encoder(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for length in sorted(lengths, reverse=True):
        fits = [g for g in range(len(gaps)) if gaps[g] >= length]
        if fits:
            gaps[min(fits, key=gaps.__getitem__)] -= length
        else:
            gaps.append(capacity - length)
    return len(gaps)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=150), st.integers(40, 60))
def test_plan_is_best_fit_decreasing(lengths, capacity):
    counts = Counter(lengths)
    plan = packing.best_fit_plan(counts, capacity)
    placed = Counter()
    used = Counter()
    spans = set()
    for length, first, n, sequence, offset in plan:
        for k in range(n):
            placed[length, first + k] += 1
            used[sequence + k] += length
            spans.add((sequence + k, offset, offset + length))
    assert set(placed) == {(length, k) for length, n in counts.items() for k in range(n)} and set(placed.values()) <= {1}
    assert all(v <= capacity for v in used.values())
    by = {}
    for s, a, b in spans:
        by.setdefault(s, []).append((a, b))
    for own in by.values():
        own.sort()
        assert own[0][0] == 0 and all(x[1] == y[0] for x, y in zip(own, own[1:]))
    assert len(used) == best_fit_decreasing(lengths, capacity)


def check(rows, packed, whole, capacity):
    got = packed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected(whole, rows, capacity)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(n for _, n in own) <= capacity
    assert len(sequences) == best_fit_decreasing([r.length for r in got], capacity)


def test_edges(make_docs, edge_rows, whole):
    docs = make_docs(edge_rows, clash=True)
    check(edge_rows, packing.pack_documents(docs, capacity=64), whole, 64)


def test_many_alike(make_docs, whole):
    rng = random.Random(5)
    rows = [(k, "the same words again" if k % 3 else " ".join(rng.choice(["to", "be", "or"]) for _ in range(rng.randint(0, 90)))) for k in range(600)]
    check(rows, packing.pack_documents(make_docs(rows), capacity=50), whole, 50)


def test_ids_are_kept(make_docs, whole):
    row = packing.pack_documents(make_docs([(1, "hello world")]), keep_ids=True).first()
    assert row["length"] == 3 and row["sequence_id"] == 0


def test_empty(make_docs):
    assert packing.pack_documents(make_docs([])).collect() == []


def test_a_piece_must_fit():
    with pytest.raises(ValueError):
        packing.best_fit_plan({5: 1}, 4)
