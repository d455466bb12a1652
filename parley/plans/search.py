"""Search queries: filters, full text, n-grams, vectors, cold tier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import models, numbers, text, times
from parley.operators import cold, index, search, vectors
from parley.plans.registry import query
from parley.plans.sql import CONV, MSG, WORDS, bm25, fuzzy, grams
from parley.sources import tables
from parley.sources.shared import modified, shared_path

#: What the registered queries look for.
TERMS, TYPO = "the anatwh hereti", "therheanon"
DATES = (1_704_067_200_000 + 10 * 86_400_000, 1_704_067_200_000 + 60 * 86_400_000)
VECTOR = [((7 * k) % 11 - 5) / 10 for k in range(64)]
_VECTOR_SQL = "[" + ", ".join(f"{x}::DOUBLE" for x in VECTOR) + "]"


#: By application and table's files: the index that was built of them.
_indexes: dict[tuple, index.Index] = {}


def stored_index(spark: SparkSession, d: str, table: str = "messages") -> index.Index:
    """The search index of a folder's messages, or of its documents' words, built once in an application and kept in the shared folder."""
    key = (spark.sparkContext.applicationId, table, modified(spark, f"{d}/{'conversations' if table == 'messages' else table}.parquet"))
    if key not in _indexes:
        own = tables.messages(spark, d) if table == "messages" else tables.read(spark, d, table).select(F.col("doc_id").alias("message_id"), "text")
        # no query looks for n-grams of documents
        _indexes[key] = index.build(own, shared_path(spark, f"index-{table}"), grams=table == "messages")
    return _indexes[key]


def six(name: str):
    return F.round(F.col(name), 6).alias(name)


_SHORT = "message_id, conversation_id, sender_id, created_at_ms"
_SHORT_COLUMNS = _SHORT.split(", ")


@query(f"WITH {MSG} SELECT {_SHORT} FROM msg WHERE sender_id = 'user' AND created_at_ms BETWEEN {DATES[0]} AND {DATES[1]} AND kind = 'text'")
def filter_sender_date_kind(spark: SparkSession, d: str) -> DataFrame:
    wanted = search.SearchQuery(sender="user", date_from=DATES[0], date_to=DATES[1], kind="text")
    return search.filtered(tables.messages(spark, d), wanted).select(*_SHORT_COLUMNS)


@query(f"WITH {MSG} SELECT {_SHORT} FROM msg WHERE kind = 'media' ORDER BY created_at_ms DESC, message_id LIMIT 50")
def structured_only(spark: SparkSession, d: str) -> DataFrame:
    return search.hybrid(tables.messages(spark, d), search.SearchQuery(kind="image"), 50).select(*_SHORT_COLUMNS)


def _scope(name: str, where: str, target: tuple[str, object]) -> None:
    def scoped(spark: SparkSession, d: str) -> DataFrame:
        allowed = search.target_conversations(tables.conversations(spark, d), target)
        return search.in_target(tables.messages(spark, d), allowed).select(*_SHORT_COLUMNS)

    scoped.__name__ = name
    query(f"WITH {MSG}, {CONV} SELECT {_SHORT} FROM msg WHERE conversation_id IN (SELECT conversation_id FROM conv WHERE {where})")(scoped)


_scope("scope_community", "community_id = 3", ("community", 3))
_scope("scope_tenant", "tenant_id = 't1'", ("tenant", "t1"))
_scope("scope_domain", "domain_id = 2", ("domain", 2))
_scope("scope_b2c", "scope = 'b2c'", ("scope", "b2c"))
_scope("scope_channel", "conversation_id = 5", ("channel", 5))
_scope("scope_empty", "community_id = -1", ("community", -1))


@query(f"WITH {MSG}, {CONV} SELECT {_SHORT} FROM msg WHERE conversation_id IN (SELECT conversation_id FROM conv WHERE pinned)")
def scope_starred(spark: SparkSession, d: str) -> DataFrame:
    starred = tables.conversations(spark, d).where("pinned").select("conversation_id")
    allowed = search.target_conversations(tables.conversations(spark, d), ("starred", None), {"starred": starred})
    return search.in_target(tables.messages(spark, d), allowed).select(*_SHORT_COLUMNS)


@query(f"WITH {MSG}, {grams('g', 'msg')} SELECT message_id, script, token FROM g")
def fuzzy_grams(spark: SparkSession, d: str) -> DataFrame:
    return search.fuzzy_grams(tables.messages(spark, d))


_ASKED = "asked_text AS (SELECT 0 AS message_id, '{}' AS text)"


@query(
    f"WITH {MSG}, {grams('g', 'msg')}, {_ASKED.format(TYPO)}, {grams('q', 'asked_text')}, {fuzzy('f', 'g', 'q')} "
    "SELECT message_id, round(fuzzy, 6) AS fuzzy FROM f"
)
def fuzzy_search(spark: SparkSession, d: str) -> DataFrame:
    """By the stored n-grams."""
    return index.fuzzy(stored_index(spark, d), TYPO).select("message_id", six("fuzzy"))


@query(
    f"WITH {MSG}, {grams('g', 'msg')}, {_ASKED.format(TYPO)}, {grams('q', 'asked_text')}, {fuzzy('f', 'g', 'q')} "
    "SELECT message_id, round(fuzzy, 6) AS fuzzy FROM f"
)
def fuzzy_scan(spark: SparkSession, d: str) -> DataFrame:
    """The same rows without an index."""
    return search.fuzzy_scan(tables.messages(spark, d), TYPO).select("message_id", six("fuzzy"))


def _match(words: list[str], matches: str) -> str:
    return f"WITH {MSG}, {bm25('b', 'msg', words, matches)} SELECT message_id, round(bm25, 6) AS bm25 FROM b"


def _full_text(spark: SparkSession, d: str, terms: str) -> DataFrame:
    return index.full_text(stored_index(spark, d), terms).select("message_id", six("bm25"))


@query(_match(["the", "thre"], "list_contains(w, 'the') AND list_contains(w, 'thre')"))
def fts_terms_and(spark: SparkSession, d: str) -> DataFrame:
    return _full_text(spark, d, "the thre")


@query(_match(["thre", "der"], "(list_contains(w, 'thre') AND NOT list_contains(w, 'ther')) OR list_contains(w, 'der')"))
def fts_or_not(spark: SparkSession, d: str) -> DataFrame:
    return _full_text(spark, d, "thre NOT ther OR der")


@query(_match(["thtion*"], "len(list_filter(w, lambda x: starts_with(x, 'thtion'))) > 0"))
def fts_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _full_text(spark, d, "thtion*")


@query(_match(["of", "the"], "contains(' ' || array_to_string(w, ' ') || ' ', ' of the ')"))
def fts_phrase(spark: SparkSession, d: str) -> DataFrame:
    return _full_text(spark, d, '"of the"')


_NEAR = (
    "len(list_filter(range(0, len(w)), lambda i: w[i + 1] = 'thre' AND "
    "list_contains(w[greatest(i - 10, 1):i + 12], 'ther'))) > 0"
)


@query(_match(["thre", "ther"], _NEAR))
def fts_near(spark: SparkSession, d: str) -> DataFrame:
    return _full_text(spark, d, "thre NEAR ther")


@query(_match(["and", "the"], "list_contains(w, 'and') AND list_contains(w, 'the')"))
def fts_orphan_operator(spark: SparkSession, d: str) -> DataFrame:
    return _full_text(spark, d, "AND the")


@query(_match(["the", "thre"], "list_contains(w, 'the') AND list_contains(w, 'thre')"))
def fts_scan(spark: SparkSession, d: str) -> DataFrame:
    """Without an index."""
    return search.full_text(tables.messages(spark, d), "the thre").select("message_id", six("bm25"))


_DOCS = "docs AS (SELECT doc_id AS message_id, text FROM documents)"


_BOTH = bm25("b", "docs", ["the", "for"], "list_contains(w, 'the') AND list_contains(w, 'for')")


@query(f"WITH {_DOCS}, {_BOTH} SELECT message_id, round(bm25, 6) AS bm25 FROM b ORDER BY round(bm25, 6) DESC, message_id LIMIT 20")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """By the stored index, without the blocks that can't hold one of the best."""
    return index.best(stored_index(spark, d, "documents"), "the for", 20).select("message_id", six("bm25")).orderBy(F.desc("bm25"), "message_id").limit(20)


def _lexical(source: str) -> str:
    """CTEs ending in ``ranked``: hits of "the thre" in ``source``."""
    return f"""{bm25('b', source, ['the', 'thre'], "list_contains(w, 'the') AND list_contains(w, 'thre')")},
{grams('g', source)}, {_ASKED.format('the thre')}, {grams('q', 'asked_text')}, {fuzzy('f', 'g', 'q')},
hits AS (SELECT message_id, sum(part) AS base FROM (SELECT message_id, 2 * bm25 AS part FROM b UNION ALL SELECT message_id, fuzzy FROM f) GROUP BY message_id),
lex AS (SELECT {source}.*, base FROM {source} JOIN hits USING (message_id)),
ranked AS (
  SELECT *, base * (0.5 + 0.5 * exp(-ln(2) * greatest((SELECT max(created_at_ms) FROM lex) - created_at_ms, 0) / 86400000.0 / 30))
            * CASE WHEN kind = 'media' THEN 0.8 ELSE 1.0 END AS rank_score FROM lex)"""


_LEXICAL = _lexical("msg")


_HYBRID = (
    f"WITH {MSG}, {_LEXICAL} SELECT message_id, conversation_id, created_at_ms, kind, round(rank_score, 6) AS rank_score "
    "FROM ranked ORDER BY ranked.rank_score DESC, created_at_ms DESC, message_id LIMIT 50"
)


def _ranked(found: DataFrame) -> DataFrame:
    return found.select("message_id", "conversation_id", "created_at_ms", "kind", six("rank_score"))


@query(_HYBRID)
def hybrid_rank(spark: SparkSession, d: str) -> DataFrame:
    """By the stored index."""
    return _ranked(index.hybrid(stored_index(spark, d), tables.messages(spark, d), search.SearchQuery("the thre"), 50))


@query(_HYBRID)
def hybrid_scan(spark: SparkSession, d: str) -> DataFrame:
    """The same rows without an index."""
    return _ranked(search.hybrid(tables.messages(spark, d), search.SearchQuery("the thre"), 50))


@query(
    f"WITH {MSG}, {CONV}, {_LEXICAL} SELECT message_id, conversation_id, created_at_ms, kind, round(total, 6) AS rank_score FROM ("
    "SELECT *, base * (0.5 + 0.5 * exp(-ln(2) * greatest(max(created_at_ms) OVER () - created_at_ms, 0) / 86400000.0 / 30)) * CASE WHEN kind = 'media' THEN 0.8 ELSE 1.0 END AS total "
    "FROM lex WHERE conversation_id IN (SELECT conversation_id FROM conv WHERE tenant_id = 't1')) ORDER BY total DESC, created_at_ms DESC, message_id LIMIT 50"
)
def hybrid_target(spark: SparkSession, d: str) -> DataFrame:
    """Ranked within one tenant's conversations."""
    allowed = search.target_conversations(tables.conversations(spark, d), ("tenant", "t1"))
    own = search.in_target(tables.messages(spark, d), allowed)
    return _ranked(index.hybrid(stored_index(spark, d), own, search.SearchQuery("the thre"), 50))


@query(
    f"WITH {MSG} SELECT message_id, round(0.5 + 0.5 * exp(-ln(2) * ((SELECT max(created_at_ms) FROM msg) - created_at_ms) / 86400000.0 / 30), 9) AS recency, "
    "CASE WHEN kind = 'media' THEN 0.8 ELSE 1.0 END AS weight FROM msg"
)
def recency_decay(spark: SparkSession, d: str) -> DataFrame:
    messages = tables.messages(spark, d)
    newest = F.broadcast(messages.agg(F.max("created_at_ms").alias("now")))
    return messages.crossJoin(newest).select(
        "message_id",
        F.round(search.recency(F.col("created_at_ms"), F.col("now")), 9).alias("recency"),
        search.kind_weight(F.col("kind")).alias("weight"),
    )


_COSINE = (
    "list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * q[i])) / "
    "(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q, lambda x: x * x))))"
)
_SIMILAR = f"sim AS (SELECT vec_id AS message_id, label, {_COSINE} AS cosine FROM embeddings, (SELECT {_VECTOR_SQL} AS q))"


@query(f"WITH {_SIMILAR} SELECT message_id, round(cosine, 6) AS cosine FROM sim ORDER BY sim.cosine DESC, message_id LIMIT 10")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.nearest(tables.vectors(spark, d), VECTOR, 10).select("message_id", six("cosine"))


@query(f"WITH {_SIMILAR} SELECT message_id, round(cosine, 6) AS cosine FROM sim WHERE label % 2 = 1 ORDER BY sim.cosine DESC, message_id LIMIT 10")
def vector_topk_version(spark: SparkSession, d: str) -> DataFrame:
    return search.nearest(tables.vectors(spark, d), VECTOR, 10, "v1").select("message_id", six("cosine"))


@query(
    """WITH s AS (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) / 127 AS scale FROM embeddings),
c AS (SELECT vec_id, embedding, scale, list_transform(embedding, lambda x: sign(x) * floor(abs(x::DOUBLE / scale) + 0.5)) AS codes FROM s)
SELECT vec_id, round(scale, 9) AS scale, CAST(list_sum(codes) AS BIGINT) AS code_sum,
       round(list_max(list_transform(range(1, len(codes) + 1), lambda i: abs(codes[i] * scale - embedding[i]::DOUBLE))), 6) AS worst FROM c"""
)
def int8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    own = tables.read(spark, d, "embeddings").select("vec_id", "embedding", numbers.int8_scale(F.col("embedding")).alias("step"), numbers.int8_codes(F.col("embedding")).alias("codes"))
    lost = F.zip_with(numbers.int8_decode(F.col("codes"), F.col("step")), F.col("embedding"), lambda a, b: F.abs(a - b.cast("double")))
    return own.select(
        "vec_id",
        F.round("step", 9).alias("scale"),
        F.aggregate("codes", F.lit(0).cast("long"), lambda a, b: a + b).alias("code_sum"),
        F.round(F.array_max(lost), 6).alias("worst"),
    )


@query(
    """WITH s AS (SELECT vec_id, embedding, CAST(list_max(list_transform(embedding, lambda x: abs(x))) AS FLOAT) / 7::FLOAT AS scale FROM embeddings),
c AS (SELECT vec_id, embedding, list_transform(embedding, lambda x: CAST(sign(x) * floor(abs(x / scale) + 0.5::FLOAT) AS FLOAT) * scale) AS back FROM s)
SELECT vec_id, 4 + CAST(ceil(len(embedding) / 2) AS INTEGER) AS blob_bytes, round(list_sum(list_transform(range(1, len(back) + 1), lambda i: embedding[i]::DOUBLE * back[i]::DOUBLE))
/ (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(back, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS cosine FROM c"""
)
def int4_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    own = tables.read(spark, d, "embeddings").select("vec_id", "embedding", numbers.encode_int4(F.col("embedding")).alias("blob"))
    back = own.withColumn("back", numbers.decode_int4(F.col("blob")))
    return back.select("vec_id", F.octet_length("blob").alias("blob_bytes"), F.round(numbers.cosine(F.col("embedding"), F.col("back")), 6).alias("cosine"))


_SMALL = "small AS (SELECT vec_id * 1000 AS message_id, cosine FROM (SELECT message_id AS vec_id, cosine FROM sim))"


def _message_vectors(spark: SparkSession, d: str) -> DataFrame:
    """A vector for the first message of a conversation."""
    return tables.vectors(spark, d).withColumn("message_id", F.col("message_id") * 1000)


@query(
    f"""WITH {MSG}, {_LEXICAL}, {_SIMILAR}, {_SMALL},
merged AS (
  SELECT msg.*, cosine, rank_score AS lexical FROM msg LEFT JOIN (SELECT * FROM small WHERE cosine > 0) USING (message_id)
  LEFT JOIN (SELECT message_id, rank_score FROM ranked) USING (message_id) WHERE cosine IS NOT NULL OR rank_score IS NOT NULL),
scored AS (
  SELECT *, CASE WHEN lexical IS NOT NULL THEN lexical + 1.5 * coalesce(cosine, 0)
    ELSE 1.5 * cosine * (0.5 + 0.5 * exp(-ln(2) * ((SELECT max(created_at_ms) FROM merged) - created_at_ms) / 86400000.0 / 30)) * CASE WHEN kind = 'media' THEN 0.8 ELSE 1.0 END
    END AS rank_score FROM merged)
SELECT message_id, round(rank_score, 6) AS rank_score FROM scored ORDER BY scored.rank_score DESC, created_at_ms DESC, message_id LIMIT 50"""
)
def semantic_merge(spark: SparkSession, d: str) -> DataFrame:
    messages = tables.messages(spark, d)
    hits = index.lexical(stored_index(spark, d), messages, "the thre")
    found = search.with_semantic(messages, _message_vectors(spark, d), search.SearchQuery("the thre"), VECTOR, 50, hits)
    return found.select("message_id", six("rank_score"))


@query(
    f"""WITH {MSG}, {_LEXICAL}, {_SIMILAR}, {_SMALL},
again AS (SELECT ranked.message_id, created_at_ms, rank_score + 1.5 * coalesce(cosine, 0) AS rank_score FROM ranked LEFT JOIN small USING (message_id))
SELECT message_id, round(rank_score, 6) AS rank_score FROM again ORDER BY again.rank_score DESC, created_at_ms DESC, message_id LIMIT 20"""
)
def rerank(spark: SparkSession, d: str) -> DataFrame:
    results = search.decayed(index.lexical(stored_index(spark, d), tables.messages(spark, d), "the thre"))
    return search.rerank(results, _message_vectors(spark, d), VECTOR, 20).select("message_id", six("rank_score"))


def _cold(spark: SparkSession, d: str) -> DataFrame:
    return tables.messages(spark, d).where("body_state = 'remote_archive_only'").withColumn("time_bucket", times.month_bucket(F.col("created_at_ms")))


@query(
    f"WITH {MSG} SELECT message_id, CAST(contains(lower(text), 'thre') AS INT) + CAST(contains(lower(text), 'ther') AS INT)::DOUBLE AS score FROM msg "
    "WHERE contains(lower(text), 'thre') OR contains(lower(text), 'ther')"
)
def cold_substring_score(spark: SparkSession, d: str) -> DataFrame:
    scored = tables.messages(spark, d).select("message_id", cold.substring_score(F.col("text"), "Thre, ther; thre").alias("score"))
    return scored.where("score > 0")


@query(
    f"WITH {MSG} SELECT message_id, strftime(make_timestamp(created_at_ms * 1000), '%Y-%m') AS time_bucket FROM msg "
    f"WHERE body_state = 'remote_archive_only' AND strftime(make_timestamp(created_at_ms * 1000), '%Y-%m') BETWEEN '2024-01' AND '2024-02'"
)
def cold_bucket_prune(spark: SparkSession, d: str) -> DataFrame:
    wanted = search.SearchQuery(date_from=DATES[0], date_to=DATES[0] + 40 * 86_400_000)
    return cold.pruned(_cold(spark, d), wanted).select("message_id", "time_bucket")


@query(
    f"WITH {MSG} SELECT message_id FROM msg WHERE body_state = 'remote_archive_only' AND list_contains({WORDS}, 'thtionea')"
)
def bloom_prune(spark: SparkSession, d: str) -> DataFrame:
    """Words found behind the bloom filters: the same rows as without them."""
    own = _cold(spark, d)
    blooms = cold.write_blooms(own, shared_path(spark, "blooms"))  # as when the tier is written
    kept = cold.bloom_prune(own, blooms, "thtionea", require=True).withColumn("words", text.words(F.col("text")))
    return kept.where(F.array_contains("words", "thtionea")).select("message_id")


_HOT_COLD = f"""WITH {MSG}, hot AS (SELECT * FROM msg WHERE body_state = 'local_plain_available'), cold AS (SELECT * FROM msg WHERE body_state = 'remote_archive_only'),
{_lexical('hot')}, {grams('cg', 'cold')}, {fuzzy('cf', 'cg', 'q')},
found AS (
  SELECT * FROM (
    SELECT cold.message_id, created_at_ms, CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'thre') AS INT) AS words, fuzzy
    FROM cold LEFT JOIN cf USING (message_id))
  WHERE words > 0 OR fuzzy IS NOT NULL),
merged AS (
  SELECT coalesce(r.message_id, c.message_id) AS message_id, coalesce(r.created_at_ms, c.created_at_ms) AS created_at_ms, r.rank_score AS hot_score,
         c.words + coalesce(c.fuzzy, 0) AS cold_score
  FROM ranked r FULL JOIN found c ON r.message_id = c.message_id),
scored AS (
  SELECT *, CASE WHEN hot_score IS NOT NULL THEN hot_score + coalesce(cold_score, 0)
    ELSE cold_score * (0.5 + 0.5 * exp(-ln(2) * ((SELECT max(created_at_ms) FROM merged) - created_at_ms) / 86400000.0 / 30)) END AS total
  FROM merged)
SELECT message_id, round(total, 6) AS rank_score, hot_score IS NULL AS is_cold FROM scored ORDER BY total DESC, created_at_ms DESC, message_id LIMIT 50"""


@query(_HOT_COLD)
def hot_cold_union(spark: SparkSession, d: str) -> DataFrame:
    hot = tables.messages(spark, d).where("body_state = 'local_plain_available'")
    found = cold.hot_and_cold(hot, _cold(spark, d), search.SearchQuery("the thre"), cold.Policy(most_buckets=10_000), 50)
    return found.select("message_id", "is_cold", six("rank_score"))


@query(_HOT_COLD)
def hot_cold_stopping(spark: SparkSession, d: str) -> DataFrame:
    """The same rows, month by month until no other can hold one of the best."""
    hot = tables.messages(spark, d).where("body_state = 'local_plain_available'")
    found, _ = cold.stopping(hot, _cold(spark, d), search.SearchQuery("the thre"), cold.Policy(most_buckets=10_000), 50)
    return found.select("message_id", "is_cold", six("rank_score"))


@query("SELECT page_id AS asset_id, 'caption' AS kind FROM pages WHERE contains(lower(html), '100%') OR contains(html, 'The</a>')")
def media_like(spark: SparkSession, d: str) -> DataFrame:
    index = tables.media_index(spark, d)
    either = text.like_literal(F.col("text"), "100%") | F.col("text").contains("The</a>")
    return index.where(either).select("asset_id", "kind")


@query(f"WITH {MSG} SELECT message_id, strftime(make_timestamp(created_at_ms * 1000), '%Y-%m') AS time_bucket FROM msg")
def bucket_calendar(spark: SparkSession, d: str) -> DataFrame:
    return tables.messages(spark, d).select("message_id", times.month_bucket(F.col("created_at_ms")).alias("time_bucket"))


@query(
    f"""WITH {MSG}, days AS (SELECT message_id, created_at_ms // 86400000 AS n FROM msg)
SELECT message_id, printf('%04d-%02d', 1970 + n // 365, 1 + least((n - (n // 365) * 365) // 30, 11)) AS time_bucket FROM days"""
)
def bucket_approx(spark: SparkSession, d: str) -> DataFrame:
    return tables.messages(spark, d).select("message_id", times.approximate_bucket(F.col("created_at_ms")).alias("time_bucket"))


_ALL_SIMILAR = """unit AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / n) AS u
  FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)),
pair AS (
  SELECT a.vec_id AS query, b.vec_id AS message_id, list_dot_product(a.u, b.u) AS similarity FROM unit a, unit b WHERE a.vec_id % 100 = 0),
best AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(similarity, 9) DESC, message_id) AS rank FROM pair)"""


@query(f"WITH {_ALL_SIMILAR} SELECT query, message_id, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM best WHERE rank <= 10")
def vector_search_exact(spark: SparkSession, d: str) -> DataFrame:
    """Every row whose id is divisible by 100 as a query, against all rows."""
    stored = tables.vectors(spark, d)
    return vectors.exact(stored, stored.where("message_id % 100 = 0"), 10).select("query", "message_id", six("similarity"), "rank")


@query()
def vector_search_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The same by the index of short codes; exactly where there are few rows."""
    stored = tables.vectors(spark, d)
    return vectors.indexed(stored, stored.where("message_id % 100 = 0"), 10).select("query", "message_id", six("similarity"), "rank")


@query()
def vector_index_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall against the exact result, and the share of the vectors' bytes that a query reads."""
    stored = tables.vectors(spark, d)
    asked = stored.where("message_id % 100 = 0")
    found = vectors.recall(vectors.indexed(stored, asked, 10), vectors.exact(stored, asked, 10))
    n = stored.count()
    return found.withColumn("share_read", F.lit(vectors.share_read(n, len(VECTOR), 10) if n >= vectors.EXACT_BELOW else 1.0))


@query()
def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The text blocks of every page, one row each."""
    return tables.media_index(spark, d).select("asset_id", F.posexplode(models.html_pages(F.col("text"))).alias("block", "body"))


@query(f"WITH {MSG} SELECT message_id, 'v1' AS model_version, 384 AS dimensions FROM msg")
def embedding_cache(spark: SparkSession, d: str) -> DataFrame:
    """Messages embedded where no vector of this version is stored."""
    messages = tables.messages(spark, d)
    cache = messages.where("message_id % 2 = 0").select("message_id", F.lit("v1").alias("model_version"), models.mock_embedder(F.col("text")).alias("embedding"))
    return models.embedded(messages, cache, "v1").select("message_id", "model_version", F.size("embedding").alias("dimensions"))


@query(
    f"""WITH {MSG}, g AS (
  SELECT DISTINCT conversation_id, strftime(make_timestamp(created_at_ms * 1000), '%Y-%m') AS time_bucket FROM msg WHERE body_state = 'remote_archive_only'),
ok AS (SELECT *, time_bucket BETWEEN '2024-01' AND '2024-06' AS meets FROM g),
newest AS (SELECT DISTINCT time_bucket FROM ok WHERE meets ORDER BY 1 DESC LIMIT 3)
SELECT time_bucket, CASE WHEN NOT meets THEN 'date' WHEN time_bucket NOT IN (SELECT time_bucket FROM newest) THEN 'cap' ELSE 'looked at' END AS outcome, count(*) AS groups FROM ok GROUP BY 1, 2"""
)
def cold_coverage(spark: SparkSession, d: str) -> DataFrame:
    """What a search of half a year and at most three months looks at; filters may only take away from that."""
    own = _cold(spark, d)
    wanted = search.SearchQuery("the", date_from=DATES[0], date_to=DATES[0] + 160 * 86_400_000)
    blooms = cold.write_blooms(own, shared_path(spark, "blooms"))
    found = cold.coverage(own, wanted, cold.Policy(most_buckets=3), blooms)
    outcome = F.when(F.col("outcome").isin("fetched", "filter"), "looked at").otherwise(F.col("outcome"))
    return found.groupBy("time_bucket", outcome.alias("outcome")).agg(F.sum("groups").alias("groups"))


@query(
    f"""WITH {MSG}, hot AS (SELECT * FROM msg WHERE body_state = 'local_plain_available'), cold AS (SELECT * FROM msg WHERE body_state = 'remote_archive_only'),
{_lexical('hot')}, {grams('cg', 'cold')}, {fuzzy('cf', 'cg', 'q')}, {_SIMILAR}, {_SMALL},
found AS (
  SELECT * FROM (
    SELECT cold.message_id, created_at_ms, CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'thre') AS INT) AS words, fuzzy
    FROM cold LEFT JOIN cf USING (message_id))
  WHERE words > 0 OR fuzzy IS NOT NULL),
both_ AS (
  SELECT coalesce(r.message_id, c.message_id) AS message_id, coalesce(r.created_at_ms, c.created_at_ms) AS created_at_ms, r.rank_score AS hot_score,
         c.words + coalesce(c.fuzzy, 0) AS cold_score
  FROM ranked r FULL JOIN found c ON r.message_id = c.message_id),
lexical AS (
  SELECT message_id, CASE WHEN hot_score IS NOT NULL THEN hot_score + coalesce(cold_score, 0)
    ELSE cold_score * (0.5 + 0.5 * exp(-ln(2) * ((SELECT max(created_at_ms) FROM both_) - created_at_ms) / 86400000.0 / 30)) END AS lexical FROM both_),
merged AS (
  SELECT msg.message_id, created_at_ms, kind, cosine, lexical FROM msg LEFT JOIN (SELECT * FROM small WHERE cosine > 0) USING (message_id)
  LEFT JOIN lexical USING (message_id) WHERE cosine IS NOT NULL OR lexical IS NOT NULL),
scored AS (
  SELECT *, CASE WHEN lexical IS NOT NULL THEN lexical + 1.5 * coalesce(cosine, 0)
    ELSE 1.5 * cosine * (0.5 + 0.5 * exp(-ln(2) * ((SELECT max(created_at_ms) FROM merged) - created_at_ms) / 86400000.0 / 30)) * CASE WHEN kind = 'media' THEN 0.8 ELSE 1.0 END
    END AS rank_score FROM merged)
SELECT message_id, round(rank_score, 6) AS rank_score FROM scored ORDER BY scored.rank_score DESC, created_at_ms DESC, message_id LIMIT 50"""
)
def semantic_cold(spark: SparkSession, d: str) -> DataFrame:
    """Words and meaning over both tiers."""
    hot = tables.messages(spark, d).where("body_state = 'local_plain_available'")
    found = cold.with_semantic(hot, _cold(spark, d), _message_vectors(spark, d), search.SearchQuery("the thre"), VECTOR, cold.Policy(most_buckets=10_000), 50)
    return found.select("message_id", six("rank_score"))
