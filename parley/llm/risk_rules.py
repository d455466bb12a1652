"""Quality rules whose cutoffs limit false rejection, by stratum.

Every rule has a ladder of cutoffs from lenient to strict.  A document's level is
the most lenient rung at which some rule rejects it, and configuration k rejects
what has a level up to k.  On labelled documents of a stratum, configurations are
tested in that fixed order: k is certified if the exact (Clopper-Pearson) upper
bound of the share of good documents it rejects is at most ``risk``, and testing
stops at the first failure.  Within a stratum a fixed sequence needs no correction;
between strata the error probability is divided by their number (Bonferroni), so
with probability ``1 - error`` all selected cutoffs reject at most ``risk`` of the
good documents of their stratum.  The bound assumes that labelled documents are
drawn independently.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, majority_labels, numbered, stored
from .text_stats import COUNTS, features, text_counts

RISK, ERROR = 0.02, 0.05
#: A rejected good document weighs as much as so many rejected bad ones.
GOOD_WEIGHT = 10
#: Least words and largest percentage of repeated words of the base rule.
LEAST_WORDS, MOST_REPEATED = 50, 50

_SHARES = [0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01]
#: Rule: cutoffs, lenient first; a document beyond a cutoff is rejected.
LADDERS: dict[str, list[float]] = {
    "symbol_share": _SHARES,
    "mark_share": _SHARES,
    "repeat_share": [0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5, 0.45, 0.4, 0.35, 0.3],
    "upper_share": [0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5, 0.45, 0.4, 0.35, 0.3],
}
#: First words of the length classes that are the strata.
STRATA = (0, 100, 400)


def stratum(n_words: Column, bounds: tuple[int, ...] = STRATA) -> Column:
    return F.greatest(*(F.when(n_words >= b, F.lit(k)).otherwise(F.lit(0)) for k, b in enumerate(bounds)), F.lit(0))


def level(counts: Column | str, ladders: dict[str, list[float]] = LADDERS) -> Column:
    """The most lenient rung that rejects, from 0; the number of rungs if none does."""
    own = features(counts)
    rungs = max(map(len, ladders.values()))
    found = [
        F.when(own[rule] > cut, F.lit(k)).otherwise(F.lit(rungs)) for rule, ladder in ladders.items() for k, cut in enumerate(ladder)
    ]
    return F.least(*found, F.lit(rungs))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial X: at most ``error`` just if the exact upper bound is at most ``p``."""
    if k >= n:
        return 1.0
    logs = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        for i in range(k + 1)
    ]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def certify(tallies: list[tuple[int, int, int, int]], rungs: int, risk: float, error: float) -> dict[int, int]:
    """Stratum: selected rung, from (stratum, level, label, documents); -1 if none is certified."""
    by: dict[int, dict[int, dict[int, int]]] = defaultdict(lambda: {0: defaultdict(int), 1: defaultdict(int)})
    for group, at, label, n in tallies:
        by[group][label][at] += n
    chosen = {}
    for group, labels in by.items():
        good, bad, n = 0, 0, sum(labels[1].values())
        best, chosen[group] = 0, -1
        for rung in range(rungs):
            good, bad = good + labels[1][rung], bad + labels[0][rung]
            if not n or binomial_tail(good, n, risk) > error / len(by):
                break
            if bad - GOOD_WEIGHT * good > best:
                best, chosen[group] = bad - GOOD_WEIGHT * good, rung
    return chosen


def fit(counted: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> dict[int, int]:
    """The selected rung of each stratum.

    ``counted`` has doc_id and counts; ``labels`` doc_id and quality (1: good).  A
    doc_id is one draw however many rows have it, that of the most lenient rung.  What
    reaches the driver is one count for each stratum, level and label.
    """
    rungs = max(map(len, LADDERS.values()))
    known = majority_labels(labels, "doc_id", "quality")
    own = counted.select("doc_id", stratum(F.col("counts.n_words")).alias("stratum"), level("counts").alias("level"))
    tallies = (
        own.join(known.withColumnRenamed("key", "doc_id"), "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min(F.struct("level", "stratum")).alias("draw"))
        .select("label", "draw.*")
        .groupBy("stratum", "level", "label")
        .count()
        .collect()
    )
    return certify([tuple(r) for r in tallies], rungs, risk, error)


def base_failed(counts: Column) -> Column:
    words, repeated = counts["n_words"], counts["n_repeat_words"]
    return (words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * words)


def rejected(counts: Column, chosen: dict[int, int]) -> Column:
    own = stratum(counts["n_words"])
    limit = F.lit(-1)
    for group, rung in sorted(chosen.items()):
        limit = F.when(own == group, F.lit(rung)).otherwise(limit)
    return level(counts) <= limit


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """One row for each row of ``docs``: doc_id, counts, stratum, base_failed, kept.

    Null and empty texts have no words and so fail the base rule; whole texts count,
    however long.  Without labels nothing is certified, and only the base rule rejects.
    A document labelled more than once counts by majority; a null label counts for
    nothing.  Repeated rows are judged alike, a row each.  An empty table gives no rows;
    columns other than doc_id and text may have any names.
    """
    counted = stored(bounded_batches(docs).select("doc_id", text_counts(F.col("text")).alias("counts")), "rule-counts")
    chosen = fit(counted, labels, risk, error)
    counts = F.col("counts")
    failed = base_failed(counts)
    return counted.select(
        "doc_id",
        "counts",
        stratum(counts["n_words"]).alias("stratum"),
        failed.alias("base_failed"),
        (~failed & ~rejected(counts, chosen)).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; see :func:`judge`.

    Texts are counted once; the rows that go are a stored list of numbers, which Spark
    broadcasts if its files are small, and joins by sorting otherwise.
    """
    own, row = numbered(bounded_batches(docs), "rule-rows")
    counted = stored(own.select(F.col(row).alias("row"), "doc_id", text_counts(F.col("text")).alias("counts")), "rule-counts")
    chosen = fit(counted, labels, risk, error)
    counts = F.col("counts")
    gone = stored(counted.where(base_failed(counts) | rejected(counts, chosen)).select(F.col("row").alias("gone_row")), "rule-gone")
    return own.join(gone, own[row] == gone["gone_row"], "left_anti").drop(row)


__all__ = ["COUNTS", "judge", "keep_good", "fit", "certify", "binomial_tail", "level", "stratum"]
