"""The stored index as messages come, change and go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import index, lexicon
from parley.plans.registry import query
from parley.plans.search import TYPO, six, stored_index
from parley.plans.sql import MSG, WORDS, bm25, fuzzy, grams
from parley.sources import tables
from parley.sources.shared import modified, shared_path

#: By application and files: the index that was built, added to, edited and deleted from.
_kept: dict[tuple, index.Index] = {}


def _edited() -> tuple:
    m = F.col("message_id")
    return m % 7 == 0, m % 11 == 0


def maintained(spark: SparkSession, d: str) -> index.Index:
    """An index of half of the messages, to which the others came; then some were edited and some deleted, edited ones too."""
    key = (spark.sparkContext.applicationId, modified(spark, f"{d}/conversations.parquet"))
    if key not in _kept:
        messages = tables.messages(spark, d).select("message_id", "text")
        edited, deleted = _edited()
        after = messages.where(edited).withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" thre the thtioned")))
        held = index.build(messages.where("message_id % 2 = 0"), shared_path(spark, "index-maintained"))
        held = index.added(held, messages.where("message_id % 2 = 1"))
        held = index.changed(held, messages.where(edited), after)
        now = messages.where(~edited).unionByName(after)
        gone = now.where(deleted)
        _kept[key] = index.changed(held, gone, gone.where(F.lit(False)))
    return _kept[key]


_NOW = f"""{MSG}, now AS (
  SELECT message_id, CASE WHEN message_id % 7 = 0 THEN coalesce(text, '') || ' thre the thtioned' ELSE text END AS text FROM msg WHERE message_id % 11 <> 0)"""
_MATCHES = "(list_contains(w, 'the') AND list_contains(w, 'thre')) OR contains(' ' || array_to_string(w, ' ') || ' ', ' of the ')"
_FOUND = f"WITH {_NOW}, {bm25('b', 'now', ['the', 'thre', 'of'], _MATCHES)} SELECT message_id, round(bm25, 6) AS bm25 FROM b"
_QUERY = 'the thre OR "of the"'


@query(_FOUND)
def index_maintained(spark: SparkSession, d: str) -> DataFrame:
    """Matches by an index that was added to, edited and deleted from: those of the messages as they are now."""
    return index.full_text(maintained(spark, d), _QUERY).select("message_id", six("bm25"))


@query(_FOUND)
def index_compacted(spark: SparkSession, d: str) -> DataFrame:
    """The same after its generations were made one."""
    return index.full_text(index.compacted(maintained(spark, d)), _QUERY).select("message_id", six("bm25"))


@query(
    f"WITH {_NOW}, {grams('g', 'now')}, asked_text AS (SELECT 0 AS message_id, '{TYPO}' AS text), {grams('q', 'asked_text')}, {fuzzy('f', 'g', 'q')} "
    "SELECT message_id, round(fuzzy, 6) AS fuzzy FROM f"
)
def index_maintained_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return index.fuzzy(maintained(spark, d), TYPO).select("message_id", six("fuzzy"))


@query(
    f"WITH {_NOW}, w AS (SELECT message_id, unnest(list_distinct({WORDS})) AS word FROM now) "
    "SELECT word, count(*) AS df FROM w WHERE starts_with(word, 'thtion') OR word = 'the' GROUP BY word"
)
def term_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """What a prefix and a word stand for in the dictionary, after additions, edits and deletions."""
    return index.terms(maintained(spark, d), ["thtion*", "the"])


@query(f"WITH {_NOW}, w AS (SELECT {WORDS} AS w FROM now) SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS words FROM w")
def index_statistics(spark: SparkSession, d: str) -> DataFrame:
    held = maintained(spark, d)
    return held.stats.select("n", F.round(F.col("n") * F.col("avg_len")).cast("long").alias("words"))


_DOCS = "docs AS (SELECT doc_id AS message_id, text FROM documents)"
_EITHER = bm25("b", "docs", ["the", "for"], "(list_contains(w, 'the') OR list_contains(w, 'for'))")


@query(f"WITH {_DOCS}, {_EITHER} SELECT message_id, round(bm25, 6) AS bm25 FROM b ORDER BY round(bm25, 6) DESC, message_id LIMIT 50")
def bm25_topk_or(spark: SparkSession, d: str) -> DataFrame:
    """The best of alternatives, without the blocks that can't hold one."""
    found = index.best(stored_index(spark, d, "documents"), "the OR for", 50)
    return found.select("message_id", six("bm25")).orderBy(F.desc("bm25"), "message_id").limit(50)


#: Letters of the texts as characters of a script that is written without spaces.
_LETTERS, _CHARACTERS = "abcdefghijklmnopqrstuvwxyz", "".join(chr(0x4E00 + 97 * k) for k in range(26))


def _unspaced(spark: SparkSession, d: str) -> DataFrame:
    """The messages as if they were written without spaces: each letter a character."""
    bare = F.translate(F.lower(F.coalesce("text", F.lit(""))), _LETTERS + " ", _CHARACTERS)
    return tables.messages(spark, d).select("message_id", bare.alias("text"))


_KNOWN = "".join(rf"\p{{{s}}}" for s in lexicon.SCRIPTS)


@query(
    f"""WITH {MSG}, run AS (SELECT unnest(regexp_extract_all(translate(lower(coalesce(text, '')), '{_LETTERS} ', '{_CHARACTERS}'), '[{_KNOWN}]+')) AS run FROM msg),
r AS (SELECT run, count(*) AS n FROM run GROUP BY run),
s AS (SELECT run, n, unnest(range(1, length(run) + 1)) AS i FROM r),
c AS (
  SELECT word, sum(n) AS n FROM (SELECT n, substring(run, i, size) AS word FROM (SELECT *, unnest(range(1, least({lexicon.LONGEST}, length(run) - i + 1) + 1)) AS size FROM s))
  GROUP BY word HAVING sum(n) >= {lexicon.LEAST} OR length(word) = 1),
cut AS (SELECT word, n, unnest(range(1, length(word))) AS k FROM c WHERE length(word) > 1),
tie AS (
  SELECT cut.word, any_value(cut.n) AS n, min(cut.n / a.n * (SELECT sum(n) FROM c WHERE length(word) = 1) / b.n) AS tie
  FROM cut JOIN c a ON a.word = cut.word[1:k] JOIN c b ON b.word = cut.word[k + 1:] GROUP BY cut.word)
SELECT word, CAST(n AS BIGINT) AS n FROM c WHERE length(word) = 1 UNION ALL SELECT word, CAST(n AS BIGINT) FROM tie WHERE tie >= {lexicon.COHESION}"""
)
def word_table(spark: SparkSession, d: str) -> DataFrame:
    """The words that texts without spaces teach."""
    return lexicon.learned(_unspaced(spark, d))


@query()
def unspaced_words(spark: SparkSession, d: str) -> DataFrame:
    """Texts without spaces, cut into words by the table that they teach."""
    messages = _unspaced(spark, d)
    words = lexicon.read(lexicon.learned(messages)).column()
    return messages.select("message_id", words(F.col("text")).alias("words"))
