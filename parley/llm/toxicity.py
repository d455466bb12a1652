"""Toxicity: cumulative-link ordinal regression over sparse text features.

The labels say toxic or not; the grades of toxic texts, 1 to 3, are thirds of the
damped count of telling words.  These are words of labelled texts, or beginnings of
words, whose log odds of being in a toxic one stand out.  A proportional-odds model, one
weight a feature and ordered thresholds for the grades, then gives every text P(grade >= k) for each k; their sum
is the expected severity, and the first of them is the score.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, drawn, held_out, majority_labels
from .linear import logistic

#: About so many labelled rows at most are learned from.
TRAIN_ROWS = 20_000
#: At most so many words and word beginnings are features; one must be in so many labelled texts.
VOCABULARY, LEAST_TEXTS = 2_000, 4
#: Letters of the beginnings of longer words, which stand for forms that no labelled text has.
BEGINNINGS = (4, 5)
#: A feature tells of toxicity if its log odds are so many standard errors above none.
TELLING = 4.0
GRADES = 3
ROUNDS, PENALTY, RATE = 400, 1e-5, 0.1

_words = re.compile(r"[^\W\d_]+").findall


@dataclass
class CumulativeLink:
    """P(grade >= k) = logistic(weights . features - thresholds[k - 1])."""

    words: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, text: str) -> np.ndarray:
        found = features(text, self.words)
        total = sum(self.weights[k] * v for k, v in found.items())
        return logistic(total - self.thresholds)


def features(text: str, words: dict[str, int]) -> dict[int, float]:
    """Damped counts of known words, and of beginnings (known as ``begi*``), by their number."""
    seen = _words(text.lower())
    known: dict[str, list[int]] = {}
    for word in set(seen):
        found = [words[word]] if word in words else []
        found += [words[b] for n in BEGINNINGS if len(word) > n and (b := word[:n] + "*") in words]
        if found:
            known[word] = found
    if not known:
        return {}
    counts: Counter[int] = Counter()
    for word in seen:
        counts.update(known.get(word, ()))
    return {k: float(np.log1p(n)) for k, n in counts.items()}


def _feature_names(text: Column) -> Column:
    """The different words and beginnings of a text, as :func:`features` names them."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1)))
    begun = [F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*"))) for n in BEGINNINGS]  # noqa: B023
    return F.array_distinct(F.concat(words, *begun))


def fit_cumulative(rows: list[dict[int, float]], grades: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by full-batch gradient steps (Adam) on the likelihood.

    Grade 0 and the others together weigh alike, so that rare toxic texts count.
    """
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.array([k for r in rows for k in r], np.int64)
    value = np.array([v for r in rows for v in r.values()], np.float64)
    levels = int(grades.max(initial=1))
    params = np.concatenate([np.zeros(size), [1.0], np.zeros(levels - 1)])  # thresholds: the first, then log gaps
    mean, square = np.zeros_like(params), np.zeros_like(params)
    share = np.where(grades == 0, 0.5 / max(1, (grades == 0).sum()), 0.5 / max(1, (grades > 0).sum()))
    for step in range(1, ROUNDS + 1):
        weights, first, gaps = params[:size], params[size], np.exp(params[size + 1 :])
        cuts = np.concatenate([[-np.inf], first + np.concatenate([[0.0], np.cumsum(gaps)]), [np.inf]])
        f = np.bincount(owner, weights[column] * value, len(rows))
        low, high = logistic(np.clip(f - cuts[grades], -40, 40)), logistic(np.clip(f - cuts[grades + 1], -40, 40))
        low, high = np.where(grades == 0, 1.0, low), np.where(grades == levels, 0.0, high)
        p = np.maximum(low - high, 1e-9)
        d_low, d_high = low * (1 - low) / p, high * (1 - high) / p
        d_f = -(d_low - d_high) * share
        d_cut = np.zeros(levels + 2)
        np.add.at(d_cut, grades, d_low * share)
        np.add.at(d_cut, grades + 1, -d_high * share)
        d_cut = d_cut[1:-1]
        tail = np.cumsum(d_cut[::-1])[::-1]
        gradient = np.concatenate([np.bincount(column, d_f[owner] * value, size) + 2 * PENALTY * weights, [tail[0]], tail[1:] * gaps])
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        params = params - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    cuts = params[size] + np.concatenate([[0.0], np.cumsum(np.exp(params[size + 1 :]))])
    return params[:size], cuts


def _log_odds(table: DataFrame, toxic: int, clean: int) -> DataFrame:
    """(word, z): how many standard errors a word's log odds of toxic texts are above none."""
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(a / (toxic + 1 - a)) - F.log(b / (clean + 1 - b))
    return table.select("word", (odds / F.sqrt(1 / a + 1 / b)).alias("z"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> CumulativeLink | None:
    """Learn from labelled documents outside the held-out fold; None without both labels."""
    known = majority_labels(labels, "doc_id", "toxic").withColumnRenamed("key", "doc_id").where(~held_out(F.col("doc_id")))
    share = min(1.0, rows / max(1, known.count()))
    wanted = drawn(share, "doc_id")
    chosen = F.broadcast(known.where(wanted))  # about rows labels at most, so no text is shuffled
    sample = docs.select("doc_id", "text").where(wanted & F.col("text").isNotNull()).join(chosen, "doc_id")
    seen = (
        sample.select("label", F.explode(_feature_names(F.col("text"))).alias("word"))
        .groupBy("word")
        .agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    )
    total = sample.agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")).first()
    if not total["toxic"] or not total["clean"]:
        return None
    scored = _log_odds(seen.where(F.col("toxic") + F.col("clean") >= LEAST_TEXTS), total["toxic"], total["clean"])
    top = scored.orderBy(F.desc(F.abs("z")), "word").limit(VOCABULARY).collect()
    if not top:
        return None
    numbers = {r["word"]: k for k, r in enumerate(top)}
    telling = {k for k, r in enumerate(top) if r["z"] > TELLING}

    @F.arrow_udf(T.StructType([T.StructField("k", T.ArrayType(T.IntegerType())), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("amount", T.DoubleType())]))
    def sparse(text: pa.Array) -> pa.Array:
        rows = [features(t.as_py() or "", numbers) for t in text]
        amount = [sum(v for k, v in r.items() if k in telling) for r in rows]
        return pa.StructArray.from_arrays(
            [
                pa.array([list(r) for r in rows], pa.list_(pa.int32())),
                pa.array([list(r.values()) for r in rows], pa.list_(pa.float64())),
                pa.array(amount, pa.float64()),
            ],
            names=["k", "v", "amount"],
        )

    # bounded by rows x VOCABULARY numbers
    drawn_rows = sample.select("label", sparse(F.col("text")).alias("x")).select("label", "x.*").toArrow().to_pylist()
    label = np.array([r["label"] for r in drawn_rows])
    amount = np.array([r["amount"] for r in drawn_rows], float)
    cuts = np.quantile(amount[label == 1], [k / GRADES for k in range(1, GRADES)])
    grade = np.where(label == 1, 1 + np.searchsorted(cuts, amount, "left"), 0)
    grade = np.unique(grade, return_inverse=True)[1]  # without empty grades
    weights, thresholds = fit_cumulative([dict(zip(r["k"], r["v"])) for r in drawn_rows], grade, len(numbers))
    return CumulativeLink(numbers, weights, thresholds)


def grade(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted, expected_severity, severity.

    ``score`` is P(grade >= 1), ``predicted`` says whether it is at least 0.5,
    ``expected_severity`` is 0 to GRADES and ``severity`` the likeliest grade, the lowest
    of several.  A null text counts as empty, and whole texts count, however long.  A
    score of 0.5 predicts 1.  Repeated rows are graded alike.  With nothing to learn from,
    all are 0; an empty table gives no rows; columns other than doc_id and text may have
    any names.
    """
    model = fit(bounded_batches(docs), labels, rows)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # VOCABULARY words

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def reached(text: pa.Array) -> pa.Array:
        link = sent.value
        zero = [0.0] * GRADES
        return pa.array([zero if link is None else link.probabilities(t.as_py() or "").tolist() for t in text], pa.list_(pa.float64()))

    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), reached(F.col("text")).alias("p"))
    expected = F.aggregate("p", F.lit(0.0), lambda a, b: a + b)
    return scored.select(
        "doc_id",
        "held_out",
        F.get("p", F.lit(0)).alias("score"),
        (F.get("p", F.lit(0)) >= 0.5).cast("int").alias("predicted"),
        expected.alias("expected_severity"),
        likeliest(F.col("p")).alias("severity"),
    )


def likeliest(p: Column) -> Column:
    """The grade with the largest P(grade >= k) - P(grade >= k + 1), the lowest of several."""
    reached = F.concat(F.array(F.lit(1.0)), p)
    own = F.transform(reached, lambda x, i: x - F.coalesce(F.get(reached, i + 1), F.lit(0.0)))
    return (F.array_position(own, F.array_max(own)) - 1).cast("int")
