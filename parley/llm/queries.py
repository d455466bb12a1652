"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontaminate, language_id, line_dedup, oracles, packing, prefix_trie, risk_rules, rule_quality, simhash, span_dedup, toxicity, url_filter, warc
from .common import table


def op1_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document; see :func:`.rule_quality.classify`."""
    return rule_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores and severities of every document; see :func:`.toxicity.grade`."""
    return toxicity.grade(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every document; see :func:`.risk_rules.judge`."""
    judged = risk_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *(F.col(f"counts.{c}") for c in counts), "base_failed", "kept", "stratum")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words and items in every document; see :func:`.decontaminate.hits`."""
    judged = decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select(
        "doc_id",
        F.col("n_words").cast("long"),
        F.col("n_hit").cast("long"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece's place in a sequence; see :func:`.packing.pack_documents`."""
    packed = packing.pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and classes of every document; see :func:`.simhash.near_duplicates`."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without repeated windows of lines; see :func:`.line_dedup.dedup_lines`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    deduped = line_dedup.dedup_lines(docs, removed="n_removed")
    return deduped.select("doc_id", F.col("n_removed").cast("long"), "text")


def op8_url_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on every page's URL; see :func:`.url_filter.judge`."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back; see :func:`.warc.round_trip`."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of every document; see :func:`.language_id.identify`."""
    return language_id.identify(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations; see :func:`.prefix_trie.nodes`."""
    return prefix_trie.nodes(table(spark, sf_dir, "conversations"))


def op12_debruijn_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without repeated spans of words; see :func:`.span_dedup.cut_spans`."""
    digest = F.sha2(F.col("cut.kept").cast("binary"), 256)
    columns = {"doc_id": F.col("doc.doc_id"), "n_words": F.col("cut.n_words"), "n_removed": F.col("cut.n_removed"), "kept_sha256": digest}
    return span_dedup.cut_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), columns)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster; see :func:`.centroids.cluster`."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_rule_quality": op1_rule_quality,
    "op2_ordinal_toxicity": op2_ordinal_toxicity,
    "op3_risk_rules": op3_risk_rules,
    "op4_decontaminate": op4_decontaminate,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_simhash": op6_simhash,
    "op7_line_dedup": op7_line_dedup,
    "op8_url_ratio": op8_url_ratio,
    "op9_warc": op9_warc,
    "op10_language_id": op10_language_id,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_debruijn_spans": op12_debruijn_spans,
    "op13_centroids": op13_centroids,
}

#: SQL can't express the others' models, tokenizer, hashes or reachability.
ORACLE_SQL: dict[str, str] = {
    "op4_decontaminate": oracles.OP4,
    "op7_line_dedup": oracles.OP7,
    "op9_warc": oracles.OP9,
    "op11_prefix_trie": oracles.OP11,
    "op12_debruijn_spans": oracles.OP12,
    "op13_centroids": oracles.OP13,
}
