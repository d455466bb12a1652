from __future__ import annotations

import random
import re
from math import comb

import pytest

from parley.llm import risk_rules, rule_quality
from parley.llm.text_stats import COUNTS, measure

from .conftest import syllables


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    dup = sum(line in lines[:k] for k, line in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_base_counts(edge_rows):
    rng = random.Random(1)
    texts = [t for _, t in edge_rows if t is None or len(t) < 5000] + ["\n".join(syllables(rng, rng.randint(0, 9), "a b") for _ in range(9)) for _ in range(40)]
    for text in texts:
        assert measure(text or "")[:5] == brute(text), text


def test_binomial_tail():
    for n, k, p in ((10, 0, 0.1), (10, 3, 0.2), (25, 24, 0.5), (7, 7, 0.1)):
        assert risk_rules.binomial_tail(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_certified_rungs():
    # of 1,000 good documents none is rejected at rung 0, 5 at rung 1, 60 more at rung 2
    tallies = [(0, 0, 0, 50), (0, 1, 0, 80), (0, 1, 1, 5), (0, 2, 0, 5000), (0, 2, 1, 60), (0, 3, 1, 935)]
    assert risk_rules.certify(tallies, 3, risk=0.02, error=0.05) == {0: 1}
    assert risk_rules.certify(tallies, 3, risk=0.2, error=0.05) == {0: 2}
    assert risk_rules.certify([(0, 0, 0, 9), (0, 3, 1, 20)], 3, risk=0.02, error=0.05) == {0: -1}  # too few to be sure
    assert risk_rules.certify([(0, 0, 0, 9)], 3, risk=0.02, error=0.05) == {0: -1}


@pytest.fixture(scope="module")
def labelled(spark, make_docs):
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(900):
        bad = k % 4 == 0
        words = syllables(rng, 130).split()
        rows.append((k, " ".join(w + "%%%" if bad else w for w in words)))
        labels.append((k, 0 if bad else 1, 0))
    labels += [(5, None, None), (None, 1, 0), (7, 1, 0), (7, 1, 1)]
    return make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_rules_reject_bad_and_keep_good(labelled):
    docs, labels, rows = labelled
    judged = {r.doc_id: r for r in risk_rules.judge(docs, labels).collect()}
    assert len(judged) == len(rows)
    assert all(judged[k].kept == (k % 4 != 0) for k, _ in rows)
    kept = risk_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, r in judged.items() if r.kept}


def test_classifier_on_held_out(labelled):
    docs, labels, rows = labelled
    got = rule_quality.classify(docs, labels).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out]
    assert len(held) > 200 and all(r.predicted == (r.doc_id % 4 != 0) and 0 <= r.score <= 1 for r in held)
    assert max(r.n_rules for r in got) < 60


def test_edges(spark, make_docs, edge_rows, labelled):
    docs, (_, labels, _) = make_docs(edge_rows, clash=True), labelled
    judged = risk_rules.judge(docs, labels).collect()
    assert len(judged) == len(edge_rows)
    for r in judged:
        text = next(t for k, t in edge_rows if k == r.doc_id)
        if text is None or len(text) < 5000:
            assert tuple(r.counts)[:5] == brute(text)
        n, repeated = r.counts.n_words, r.counts.n_repeat_words
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n) and not (r.base_failed and r.kept)
    scored = rule_quality.classify(docs, labels).collect()
    assert len(scored) == len(edge_rows) and all(0 <= r.score <= 1 for r in scored)
    assert set(risk_rules.keep_good(docs, labels).columns) == set(docs.columns)
    none = labels.where("false")
    assert {r.score for r in rule_quality.classify(docs, none).collect()} == {0.5}
    assert risk_rules.judge(docs, none).where("kept").count() == risk_rules.judge(docs, none).where("not base_failed").count()
    assert rule_quality.classify(make_docs([]), labels).collect() == [] and risk_rules.judge(make_docs([]), labels).collect() == []


def test_counts_are_named():
    assert list(COUNTS)[:5] == ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
