"""Ranked search: filters, full text, n-gram overlap, vectors, and their merge.

Filters come before retrieval, so a selective filter never loses hits.  Corpus
statistics are aggregates of one scan; the few numbers and n-grams of a query are
broadcast, the corpus is not.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import numbers, text
from parley.operators import match

K1, B = 1.2, 0.75
BM25_WEIGHT, FUZZY_WEIGHT, SEMANTIC_WEIGHT = 2.0, 1.0, 1.5
RECENCY_FLOOR, HALF_LIFE_DAYS, MEDIA_WEIGHT = 0.5, 30, 0.8
DAY_MS = 86_400_000
#: Content kinds and the message kind they are stored as.
STORED_KIND = {"text": "text", "image": "media", "video": "media", "audio": "media", "document": "media", "any": None}


@dataclass(frozen=True)
class SearchQuery:
    """What to search; bounds are inclusive, and ``target`` is a (level, value) pair or None."""

    text: str = ""
    sender: object = None
    conversation: object = None
    date_from: int | None = None
    date_to: int | None = None
    kind: str | None = None
    target: tuple[str, object] | None = None


def filtered(messages: DataFrame, query: SearchQuery) -> DataFrame:
    """The messages that the query's structured filters leave."""
    tests = [
        (query.sender, F.col("sender_id") == F.lit(query.sender)),
        (query.conversation, F.col("conversation_id") == F.lit(query.conversation)),
        (query.date_from, F.col("created_at_ms") >= F.lit(query.date_from)),
        (query.date_to, F.col("created_at_ms") <= F.lit(query.date_to)),
        (STORED_KIND.get(query.kind or "any"), F.col("kind") == F.lit(STORED_KIND.get(query.kind or "any"))),
    ]
    return reduce(lambda df, t: df if t[0] is None else df.where(t[1]), tests, messages)


TARGET_COLUMNS = {"tenant": "tenant_id", "community": "community_id", "domain": "domain_id", "scope": "scope", "conversation": "conversation_id"}


def target_conversations(conversations: DataFrame, target: tuple[str, object] | None, resolver: dict[str, DataFrame] | None = None) -> DataFrame | None:
    """Conversation ids of a target, or None for all; levels other than columns come from ``resolver``."""
    if target is None or target[0] == "global":
        return None
    level, value = target
    if level in TARGET_COLUMNS:
        return conversations.where(F.col(TARGET_COLUMNS[level]) == F.lit(value)).select("conversation_id")
    if resolver and level in resolver:
        found = resolver[level]
        return (found if value is None else found.where(F.col("group") == F.lit(value))).select("conversation_id")
    if level == "channel":
        return conversations.where(F.col("conversation_id") == F.lit(value)).select("conversation_id")
    if level in ("starred", "unread"):
        return conversations.where(F.lit(False)).select("conversation_id")
    raise ValueError(f"no such target level: {level}")


def in_target(messages: DataFrame, allowed: DataFrame | None) -> DataFrame:
    return messages if allowed is None else messages.join(allowed.distinct(), "conversation_id", "left_semi")


def newest_first(messages: DataFrame, limit: int) -> DataFrame:
    return messages.orderBy(F.desc("created_at_ms"), "message_id").limit(limit)


# --- full text -------------------------------------------------------------------


def full_text(messages: DataFrame, query: str, split: Callable[[Column], Column] = text.words) -> DataFrame:
    """(message_id, bm25) of matching messages: Okapi BM25 with a non-negative idf.

    Statistics are those of ``messages``.  A prefix term counts all words it begins.
    ``split`` gives a text's words; a lexicon's knows scripts without spaces, for which
    the query must be cut by it too.
    """
    words = messages.select("message_id", split(F.col("text")).alias("words"))
    return scored_text(words.withColumn("len", F.size("words")), query)


def scored_text(words: DataFrame, query: str, stats: DataFrame | None = None) -> DataFrame:
    """(message_id, bm25) of those of ``words`` (message_id, words, len) that match.

    ``words`` must have every message with a word of the query.  ``stats`` is one row (n,
    avg_len) of the whole corpus; without it ``words`` is the corpus.
    """
    wanted = match.positive_words(query)

    def count(word: str) -> Column:
        if word.endswith("*"):
            return F.size(F.filter("words", lambda w: w.startswith(word[:-1])))
        return F.size(F.filter("words", lambda w: w == word))

    counted = words.select("message_id", "words", "len", *(count(w).alias(f"tf{k}") for k, w in enumerate(wanted)))
    seen = [F.sum((F.col(f"tf{k}") > 0).cast("long")).alias(f"df{k}") for k in range(len(wanted))]
    if stats is None:
        found = counted.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *seen)
    else:
        found = counted.agg(F.count("*").alias("held"), *seen).drop("held").crossJoin(F.broadcast(stats))  # one row each
    score = F.lit(0.0)
    for k in range(len(wanted)):
        tf, df = F.col(f"tf{k}"), F.col(f"df{k}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    matched = counted.where(match.predicate(F.col("words"), query))
    return matched.crossJoin(F.broadcast(found)).select("message_id", score.alias("bm25"))  # one row


def snippet(body: Column, query: str, width: int = 32) -> Column:
    """Up to ``width`` words around the first match, matches in <b></b>."""
    tokens = F.split(F.coalesce(body, F.lit("")), r"\s+", -1)
    wanted = match.positive_words(query)

    def hit(token: Column) -> Column:
        bare = F.regexp_replace(text.folded(token), r"[^\p{L}\p{N}]", "")
        return reduce(lambda a, b: a | b, (bare.startswith(w[:-1]) if w.endswith("*") else bare == w for w in wanted), F.lit(False))

    first = F.get(F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: hit(F.get(tokens, i))), F.lit(0))
    start = F.greatest(F.coalesce(first, F.lit(0)) - width // 4, F.lit(0)) + 1
    marked = F.transform(F.slice(tokens, start, F.lit(width)), lambda t: F.when(hit(t), F.concat(F.lit("<b>"), t, F.lit("</b>"))).otherwise(t))
    return F.array_join(marked, " ")


# --- fuzzy -----------------------------------------------------------------------


def _gram_keys(messages: DataFrame, body: str) -> DataFrame:
    """(message_id, keys): the distinct n-grams of each message, its script, a space and the n-gram each."""
    runs = F.transform(text.script_runs(F.col(body)), lambda r: F.struct(text.script_of(r).alias("script"), text.segments(r).alias("parts")))

    def tokens(run: Column) -> Column:
        own = F.flatten(F.transform(run["parts"], lambda part: text.grams(part, text.gram_length(run["script"]))))
        return F.transform(F.array_distinct(own), lambda token: F.concat(run["script"], F.lit(" "), token))

    split = messages.select("message_id", runs.alias("runs"))
    return split.select("message_id", F.array_distinct(F.flatten(F.transform("runs", tokens))).alias("keys"))


def fuzzy_grams(messages: DataFrame, body: str = "text") -> DataFrame:
    """The n-gram index: distinct (message_id, script, token) of each message, found within its row.

    Message ids are unique, so no shuffle is needed.
    """
    found = _gram_keys(messages, body).select("message_id", F.explode("keys").alias("key"))
    return found.select("message_id", F.substring_index("key", " ", 1).alias("script"), F.expr("substring(key, instr(key, ' ') + 1)").alias("token"))


def gram_bytes(messages: DataFrame, each: int, body: str = "text") -> DataFrame:
    """(message_id, bytes): the characters of each message's n-grams and ``each`` more for every one, added up in its row."""
    size = F.aggregate("keys", F.lit(0).cast("long"), lambda n, key: n + F.length(key) - F.locate(" ", key) + each)
    return _gram_keys(messages, body).select("message_id", size.alias("bytes"))


def fuzzy(grams: DataFrame, query: str) -> DataFrame:
    """(message_id, fuzzy): the share of the query's n-grams that a message has, by the n-gram index.

    A message is a hit if in some script it has at least that script's floor.
    """
    return fuzzy_of(grams, text.query_grams(query))


def fuzzy_of(grams: DataFrame, asked: dict[str, list[str]]) -> DataFrame:
    """:func:`fuzzy` for the n-grams ``asked`` of each script."""
    total = sum(map(len, asked.values()))
    if not total:
        return grams.where(F.lit(False)).select("message_id", F.lit(0.0).alias("fuzzy"))
    # a query's own n-grams are conditions, so they reach the scan
    held = {script: (F.col("script") == script) & F.col("token").isin(own) for script, own in asked.items()}
    matched = grams.where(reduce(lambda a, b: a | b, held.values())).groupBy("message_id")
    counts = matched.agg(*(F.count(F.when(held[s], 1)).alias(f"n{k}") for k, s in enumerate(asked)))
    return _overlap(counts, asked, total)


def _overlap(counts: DataFrame, asked: dict[str, list[str]], total: int) -> DataFrame:
    """Hits out of ``counts`` (message_id, n0, n1, ...), one number for each script asked for."""
    hit = reduce(lambda a, b: a | b, (F.col(f"n{k}") / len(own) >= text.least_overlap(F.lit(s)) for k, (s, own) in enumerate(asked.items())))
    share = reduce(lambda a, b: a + b, (F.col(f"n{k}") for k in range(len(asked)))) / total
    return counts.where(hit).select("message_id", share.alias("fuzzy"))


def fuzzy_scan(messages: DataFrame, query: str) -> DataFrame:
    """As :func:`fuzzy`, without an index and without a shuffle.

    An n-gram has no separator, so a message has it just if its runs of that script,
    in lower case, contain it.
    """
    asked = text.query_grams(query)
    total = sum(map(len, asked.values()))
    if not total:
        return messages.where(F.lit(False)).select("message_id", F.lit(0.0).alias("fuzzy"))
    split = messages.select("message_id", text.script_runs(F.col("text")).alias("runs"))
    by_script = split.select(
        "message_id",
        *(F.lower(F.array_join(F.filter("runs", lambda r: text.in_script(r, script)), " ")).alias(f"s{k}") for k, script in enumerate(asked)),  # noqa: B023
    )
    counts = by_script.select(
        "message_id", *(reduce(lambda a, b: a + b, (F.contains(F.col(f"s{k}"), F.lit(t)).cast("int") for t in own)).alias(f"n{k}") for k, own in enumerate(asked.values()))
    )
    return _overlap(counts, asked, total)


# --- vectors ---------------------------------------------------------------------


def _literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def similar(vectors: DataFrame, vector: list[float], model_version: str | None = None) -> DataFrame:
    """(message_id, cosine) of every stored vector of the query's length."""
    own = vectors if model_version is None else vectors.where(F.col("model_version") == model_version)
    sized = own.where(F.size("embedding") == len(vector))
    return sized.select("message_id", numbers.cosine(F.col("embedding"), _literal(vector)).alias("cosine"))


def nearest(vectors: DataFrame, vector: list[float], limit: int, model_version: str | None = None) -> DataFrame:
    return similar(vectors, vector, model_version).orderBy(F.desc("cosine"), "message_id").limit(limit)


# --- merge and rank --------------------------------------------------------------


def recency(created: Column, now: Column) -> Column:
    age_days = F.greatest(now - created, F.lit(0)) / DAY_MS
    return RECENCY_FLOOR + (1 - RECENCY_FLOOR) * F.exp(-F.log(F.lit(2.0)) * age_days / HALF_LIFE_DAYS)


def kind_weight(kind: Column) -> Column:
    return F.when(kind == "media", MEDIA_WEIGHT).otherwise(1.0)


def ranked(rows: DataFrame, limit: int) -> DataFrame:
    return rows.orderBy(F.desc("rank_score"), F.desc("created_at_ms"), "message_id").limit(limit)


def merged_hits(messages: DataFrame, by_text: DataFrame, by_grams: DataFrame) -> DataFrame:
    """``messages`` with ``base`` = 2 bm25 + fuzzy of those hit by either; each once."""
    hits = (
        by_text.select("message_id", (F.col("bm25") * BM25_WEIGHT).alias("part"))
        .unionByName(by_grams.select("message_id", (F.col("fuzzy") * FUZZY_WEIGHT).alias("part")))
        .groupBy("message_id")
        .agg(F.sum("part").alias("base"))
    )
    return messages.join(hits, "message_id")


def lexical(messages: DataFrame, query: str) -> DataFrame:
    """Messages hit by full text or n-grams, by a scan of all texts."""
    return merged_hits(messages, full_text(messages, query), fuzzy_scan(messages, query))


def decayed(hits: DataFrame) -> DataFrame:
    """``rank_score``: base by recency, counted from the newest hit, and kind."""
    newest = F.broadcast(hits.agg(F.max("created_at_ms").alias("now")))  # one row
    score = F.col("base") * recency(F.col("created_at_ms"), F.col("now")) * kind_weight(F.col("kind"))
    return hits.crossJoin(newest).withColumn("rank_score", score).drop("now")


def hybrid(messages: DataFrame, query: SearchQuery, limit: int = 200) -> DataFrame:
    """Filtered messages by rank; without text the newest, with score 0."""
    kept = filtered(messages, query)
    if not query.text.strip():
        return newest_first(kept.withColumn("rank_score", F.lit(0.0)), limit)
    return ranked(decayed(lexical(kept, query.text)), limit)


def with_semantic(
    messages: DataFrame, vectors: DataFrame, query: SearchQuery, vector: list[float], limit: int = 200, hits: DataFrame | None = None
) -> DataFrame:
    """Hybrid rank plus 1.5 cosine: undecayed for lexical hits, decayed for others.

    ``hits`` are the lexical ones (messages with ``base``), if an index has found them.
    """
    kept = filtered(messages, query)
    found = lexical(kept, query.text) if hits is None else hits
    lexically = decayed(found).select("message_id", F.col("rank_score").alias("lexical"))
    return ranked(semantic(kept, lexically, similar(vectors, vector)), limit)


def semantic(messages: DataFrame, lexically: DataFrame, meaning: DataFrame) -> DataFrame:
    """``messages`` with the rank_score of lexical scores (message_id, lexical) and cosines (message_id, cosine) together."""
    merged = messages.join(meaning.where("cosine > 0"), "message_id", "left").join(lexically, "message_id", "left").where("cosine is not null or lexical is not null")
    newest = F.broadcast(merged.agg(F.max("created_at_ms").alias("now")))
    added = F.coalesce(F.col("cosine"), F.lit(0.0)) * SEMANTIC_WEIGHT
    alone = added * recency(F.col("created_at_ms"), F.col("now")) * kind_weight(F.col("kind"))
    score = F.when(F.col("lexical").isNotNull(), F.col("lexical") + added).otherwise(alone)
    return merged.crossJoin(newest).withColumn("rank_score", score).drop("now")


def rerank(results: DataFrame, vectors: DataFrame, vector: list[float], limit: int) -> DataFrame:
    """Results with 1.5 cosine added where a vector is stored, sorted anew."""
    found = results.join(similar(vectors, vector), "message_id", "left")
    return ranked(found.withColumn("rank_score", F.col("rank_score") + F.coalesce(F.col("cosine"), F.lit(0.0)) * SEMANTIC_WEIGHT), limit)
