"""Quality classifier: a sparse rule ensemble compiled into Spark column expressions.

A small forest is grown over length-free statistics of labelled texts.  Every path
from a root to a node is a conjunctive rule; a lasso-penalised logistic regression
gives the rules weights, most of them zero, and the rest becomes one Column.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, drawn, held_out, majority_labels, stored
from .text_stats import features, text_counts

#: At most about so many labelled rows are learned from, chosen by a hash.
TRAIN_ROWS = 20_000
TREES, DEPTH, PENALTY, STEPS = 6, 3, 0.002, 40
#: The training sample is bounded, and so are its partitions.
TRAIN_PARTITIONS = 4

#: (statistic, above: true for >, cutoff)
Condition = tuple[str, bool, float]


@dataclass(frozen=True)
class RuleModel:
    """Weighted conjunctive rules and an intercept; the score is their logistic sum."""

    intercept: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def score(self, statistics: dict[str, Column]) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(holds(rule, statistics), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def holds(rule: tuple[Condition, ...], statistics: dict[str, Column]) -> Column:
    found = F.lit(True)
    for name, above, cutoff in rule:
        found = found & ((statistics[name] > cutoff) if above else (statistics[name] <= cutoff))
    return found


def tree_rules(root, names: list[str]) -> set[tuple[Condition, ...]]:
    """Every path of a tree as a rule: for each statistic its narrowest conditions."""
    rules, open_nodes = set(), [(root, {})]
    while open_nodes:
        node, path = open_nodes.pop()
        if path:
            rules.add(tuple(sorted((name, above, cutoff) for (name, above), cutoff in path.items())))
        if node.subtreeDepth():
            split = node.split()
            name, cutoff = names[split.featureIndex()], split.threshold()
            for above, child in ((False, node.leftChild()), (True, node.rightChild())):
                was = path.get((name, above), cutoff)
                open_nodes.append((child, path | {(name, above): max(was, cutoff) if above else min(was, cutoff)}))
    return rules


def fit(train: DataFrame, seed: int = 7) -> RuleModel:
    """Learn from ``train``: label (0 or 1) and a column for each statistic.

    With one label only, or none, the model is a constant: 1, 0, or 0.5.
    """
    names = [c for c in train.columns if c != "label"]
    seen = {r["label"] for r in train.select("label").distinct().collect()}
    if len(seen) < 2:
        return RuleModel({0: -20.0, 1: 20.0}.get(next(iter(seen), None), 0.0), ())
    vectors = VectorAssembler(inputCols=names, outputCol="statistics").transform(train).select("label", "statistics", *names)
    forest = RandomForestClassifier(
        featuresCol="statistics", labelCol="label", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", seed=seed
    ).fit(vectors)
    rules = sorted(set().union(*(tree_rules(tree._java_obj.rootNode(), names) for tree in forest.trees)))
    if not rules:
        share = train.agg(F.avg("label")).first()[0]
        return RuleModel(float(math.log(share / (1 - share))), ())
    own = {name: F.col(name) for name in names}
    held = train.select("label", *(holds(rule, own).cast("double").alias(f"rule{k}") for k, rule in enumerate(rules)))
    matrix = VectorAssembler(inputCols=[f"rule{k}" for k in range(len(rules))], outputCol="rules").transform(held)
    lasso = LogisticRegression(
        featuresCol="rules", labelCol="label", elasticNetParam=1.0, regParam=PENALTY, standardization=False, maxIter=STEPS
    ).fit(matrix.select("label", "rules"))
    weights = [(rule, float(w)) for rule, w in zip(rules, lasso.coefficients.toArray()) if abs(w) > 1e-6]
    return RuleModel(float(lasso.intercept), tuple(weights))


def training_rows(counted: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Statistics and labels of labelled documents outside the held-out fold, about ``rows`` at most."""
    known = majority_labels(labels, "doc_id", "quality").withColumnRenamed("key", "doc_id")
    share = min(1.0, rows / max(1, known.count()))
    return (
        counted.where(~held_out(F.col("doc_id")))
        .join(known.where(drawn(share, "doc_id")), "doc_id")
        .select("label", *(c.alias(name) for name, c in features("counts").items()))
        .coalesce(TRAIN_PARTITIONS)
    )


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted, n_rules.

    The score uses statistics of the whole text alone, however long; null and blank
    texts count as empty and get the score of one.  A score of 0.5 predicts 1.  Repeated
    rows get equal scores, and other columns of ``docs``, whatever their names, are not
    looked at.  Of several labels of a document the majority counts, 1 on a tie; null
    labels don't.  An empty ``docs`` gives no rows; without labels every score is 0.5,
    with one kind of label all are that one.
    """
    counted = stored(bounded_batches(docs).select("doc_id", text_counts(F.col("text")).alias("counts")), "quality-counts")
    model = fit(stored(training_rows(counted, labels, rows), "quality-train"))
    scored = counted.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score(features("counts")).alias("score"))
    return scored.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.lit(len(model.rules)).alias("n_rules"))
