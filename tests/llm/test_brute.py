"""Whole operators against plain Python: verdicts of the rules, scores of learned models, and the pipeline."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parley.llm import language_id, packing, risk_rules, rule_quality, toxicity
from parley.llm.text_stats import COUNTS, measure

from .conftest import syllables
from .test_decontaminate import brute as contaminated_by
from .test_near_copies import brute_groups, changed
from .test_packing import best_fit_decreasing


def statistics(text):
    c = dict(zip(COUNTS, measure(text or "")))

    def share(a, b):
        return c[a] / max(1, c[b])

    return {
        "log_words": math.log1p(c["n_words"]), "word_length": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "word_chars"),
        "repeat_share": share("n_repeat_words", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines"), "distinct_share": share("n_distinct", "n_words"),
        "upper_share": share("n_upper", "n_letters"), "digit_share": share("n_digits", "word_chars"), "mark_share": share("n_marks", "word_chars"),
        "stop_share": share("n_stops", "word_chars"), "wide_share": share("n_wide", "word_chars"), "line_words": share("n_words", "n_lines"),
    }


def level(text):
    own, rungs = statistics(text), max(map(len, risk_rules.LADDERS.values()))
    return min([k for name, cuts in risk_rules.LADDERS.items() for k, cut in enumerate(cuts) if own[name] > cut], default=rungs)


def stratum(text):
    n = measure(text or "")[0]
    return max(k for k, bound in enumerate(risk_rules.STRATA) if n >= bound)


def keeps(rows, labels):
    """The rows (doc_id, text) that the rules keep, by exact binomial sums over the labelled documents."""
    good = {}
    for doc_id in {k for k, *_ in labels if k is not None}:
        votes = [q for k, q, *_ in labels if k == doc_id and q is not None]
        if votes:
            good[doc_id] = 2 * sum(votes) >= len(votes)
    draws = defaultdict(list)
    for doc_id, text in rows:
        if doc_id in good:
            draws[doc_id].append((level(text), stratum(text)))
    by = defaultdict(list)
    for doc_id, own in draws.items():
        at, group = min(own)
        by[group].append((at, good[doc_id]))
    limit = {}
    for group, own in by.items():
        n, best = sum(g for _, g in own), 0
        limit[group] = -1
        for rung in range(max(map(len, risk_rules.LADDERS.values()))):
            wrong, right = sum(at <= rung and g for at, g in own), sum(at <= rung and not g for at, g in own)
            tail = sum(comb(n, i) * risk_rules.RISK**i * (1 - risk_rules.RISK) ** (n - i) for i in range(wrong + 1))
            if not n or tail > risk_rules.ERROR / len(by):
                break
            if right - risk_rules.GOOD_WEIGHT * wrong > best:
                best, limit[group] = right - risk_rules.GOOD_WEIGHT * wrong, rung
    kept = []
    for doc_id, text in rows:
        words, _, _, _, repeated, *_ = measure(text or "")
        failed = words < 50 or 100 * repeated > 50 * words
        kept.append(not failed and level(text) > limit.get(stratum(text), -1))
    return kept


@pytest.fixture(scope="module")
def graded(spark, make_docs):
    """Texts of three lengths, of which the worse have more marks; toxic ones have insults."""
    rng = random.Random(31)
    rows, labels = [], []
    for k in range(1400):
        bad, toxic = k % 4 == 0, k % 5 == 1
        words = syllables(rng, rng.choice([30, 80, 150, 450]), "an the er ion to re" if k % 2 else "der und ung sch ein zu").split()
        words = [w + "%!"[rng.randrange(2)] * (rng.random() < (0.5 if bad else 0.03)) for w in words]
        words += [rng.choice(["vermin", "idiotic"])] * (rng.randint(1, 5) if toxic else 0)
        rows.append((k, " ".join(words), "en" if k % 2 else "de"))
        labels.append((k, int(not bad), int(toxic)))
    labels += [(5, 0, 0), (5, 0, 0), (6, None, None), (None, 0, 1)]
    rows += [(8, rows[8][1], "en"), (8, "too short", None), (2000, None, None), (2001, "", "en"), (2002, "² ½ Ⅷ ①", "en"), (None, rows[9][1], "en")]
    return make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, labels


def test_kept_by_the_rules(graded):
    docs, labels, rows, listed = graded
    want = Counter((r[0], keep) for r, keep in zip(rows, keeps([r[:2] for r in rows], listed)))
    assert Counter((r.doc_id, r.kept) for r in risk_rules.judge(docs, labels).collect()) == want
    assert Counter(r.doc_id for r in risk_rules.keep_good(docs, labels).collect()) == Counter({k: n for (k, keep), n in want.items() if keep})
    assert len({keep for _, keep in want}) == 2


def recorded(monkeypatch, module):
    """The model that the next call of ``module.fit`` gives."""
    models, fit = [], module.fit
    monkeypatch.setattr(module, "fit", lambda *a, **k: models.append(fit(*a, **k)) or models[-1])
    return models


def near(got, want):
    assert Counter(k for k, _ in got) == Counter(k for k, _ in want)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert [v for _, v in sorted(got, key=key)] == pytest.approx([v for _, v in sorted(want, key=key)], abs=1e-9)


def test_quality_scores(graded, monkeypatch):
    docs, labels, rows, _ = graded
    models = recorded(monkeypatch, rule_quality)
    got = rule_quality.classify(docs, labels).collect()
    rules, intercept = models[0].rules, models[0].intercept
    assert rules

    def score(text):
        own = statistics(text)
        held = (w for rule, w in rules if all((own[name] > cut) == above for name, above, cut in rule))
        return 1 / (1 + math.exp(-intercept - sum(held)))

    near([(r.doc_id, r.score) for r in got], [(k, score(t)) for k, t, _ in rows])
    assert all(r.predicted == (r.score >= 0.5) for r in got)


def test_toxicity_scores(graded, monkeypatch):
    docs, labels, rows, _ = graded
    models = recorded(monkeypatch, toxicity)
    got = toxicity.grade(docs, labels).collect()
    model = models[0]

    def reached(text):
        total, counts = 0.0, Counter()
        for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
            names = [word] + [word[:n] + "*" for n in toxicity.BEGINNINGS if len(word) > n]
            counts.update(name for name in names if name in model.words)
        for name, n in counts.items():
            total += model.weights[model.words[name]] * math.log1p(n)
        return [1 / (1 + math.exp(-(total - cut))) for cut in model.thresholds]

    assert list(model.thresholds) == sorted(model.thresholds)
    plain = [r for r in rows if r[0] != 2002]  # signs that are digits to one and letters to the other
    near([(r.doc_id, r.score) for r in got if r.doc_id != 2002], [(k, reached(t)[0]) for k, t, _ in plain])
    near([(r.doc_id, r.expected_severity) for r in got if r.doc_id != 2002], [(k, sum(reached(t))) for k, t, _ in plain])


def test_languages(graded, monkeypatch):
    docs, _, rows, _ = graded
    models = recorded(monkeypatch, language_id)
    got = language_id.identify(docs).collect()
    model = models[0]

    def predicted(text):
        if not text or not any(c.isalpha() for c in text):
            return "und"
        x = np.append(language_id.ngram_counts(text), 1)
        languages = model.families[int(np.argmax(x @ model.to_family))]
        votes = Counter({lang: 0.0 for lang in languages})
        for (a, b), weights in model.pairs.items():
            if a in languages and b in languages:
                votes[a if x @ weights >= 0 else b] += 1
        return max(languages, key=lambda lang: votes[lang])

    assert Counter((r.doc_id, r.lang_pred) for r in got) == Counter((k, predicted(t)) for k, t, _ in rows)
    assert {r.lang_pred for r in got if r.doc_id in (2000, 2001, 2002)} == {"und"}


# --- the pipeline ------------------------------------------------------------------


def without_repeats(rows):
    """(doc_id, text) with the lines of repeated three-line windows taken out."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k))
    seen, out = set(), [None] * len(rows)
    for k in order:
        doc_id, text = rows[k]
        lines, gone = (text or "").split("\n"), set()
        for s in range(len(lines) - 2):
            window = tuple(lines[s : s + 3])
            if window in seen:
                gone |= {s, s + 1, s + 2}
            seen.add(window)
        out[k] = (doc_id, text if not gone else "\n".join(line for s, line in enumerate(lines) if s not in gone))
    return out


def brute_pipeline(rows, labels, items):
    rows = [r for r, keep in zip(rows, keeps(rows, labels)) if keep]
    rows = without_repeats(rows)
    group, first = brute_groups([t for _, t in rows]), {}
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k)):
        first.setdefault(group[k], k)
    rows = [rows[k] for k in sorted(first.values())]
    bad = {doc_id for (doc_id, *_, contaminated) in contaminated_by(rows, items) if contaminated}
    return [r for r in rows if r[0] not in bad]


def test_the_pipeline_is_its_stages_in_plain_python(spark, make_docs, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(41)
    rows, labels = [], []
    items = [(k, syllables(rng, 30)) for k in range(3)]
    passage = "\n".join(syllables(rng, 20) for _ in range(4))
    for k in range(400):
        words = syllables(rng, rng.choice([40, 90, 160])).split()
        rows.append((k, " ".join(w + "%%" * (k % 4 == 0) for w in words)))
        labels.append((k, int(k % 4 != 0), 0))
    rows += [(500 + k, f"{syllables(rng, 90)}\n{passage}\n{syllables(rng, 9)}") for k in range(5)]
    rows += [(600 + k, changed(rng, rows[1][1], 2)) for k in range(4)] + [(610, rows[2][1]), (2, rows[2][1])]
    rows += [(700 + k, f"{syllables(rng, 60)} {items[k][1]} {syllables(rng, 20)}") for k in range(3)]
    rows += [(800, None), (801, ""), (802, syllables(rng, 9000)), (803, "é " * 300)]
    folder = tmp_path
    make_docs(rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(folder)).collect()

    import zlib

    whole, want = Tokenizer.from_file(packing.tokenizer_path()), Counter()
    for doc_id, text in brute_pipeline(rows, labels, items):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        for at in range(0, len(ids), packing.CAPACITY):
            part = ids[at : at + packing.CAPACITY]
            want[doc_id, at // packing.CAPACITY, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want and len(want) > 200
    assert len({r.sequence_id for r in got}) == best_fit_decreasing([r.length for r in got], packing.CAPACITY)
    assert not {800, 801, 610, 700} & {r.doc_id for r in got} and 802 in {r.doc_id for r in got}


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_the_pipeline_with_an_empty_table_and_clashing_columns(spark, make_docs, edge_rows, tmp_path, empty):
    rng = random.Random(42)
    rows = [(100 + k, syllables(rng, 80)) for k in range(20)] + [r for r in edge_rows if r[1] is None or len(r[1]) < 5000]
    frames = {
        "documents": make_docs(rows, clash=True),
        "labels": spark.createDataFrame([(100 + k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, syllables(rng, 20))], "item_id long, text string"),
    }
    for name, df in frames.items():
        (df.where(F.lit(False)) if name == empty else df).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got >= set(range(100, 120)) if empty != "documents" else got == set()
