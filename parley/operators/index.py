"""A stored search index that follows its messages: postings in blocks, a dictionary, deltas.

An index is a folder of generations.  The first has all messages; each change adds one with
the postings of what is new, the ids whose older postings are dead, and by how much the
dictionary and the statistics differ.  A reader merges them, and :func:`compacted` makes one
of them again, without the texts.  A manifest names the generations that count, so readers
see a change as a whole or not at all.

Postings lie in blocks: a word's postings in one bucket of some BLOCK messages of like
length.  Words, blocks and the dictionary are sorted and in ranges, whose bounds the driver
knows, so a word or all that a prefix begins read only the ranges that hold them.  Beside
each block its largest count and least length bound the scores in it: the best k are found
without the blocks that can't hold one.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text
from parley.operators import lexicon, match, search
from parley.sources.shared import exists, forget, modified, pieces, released, store

#: A range of the postings has about so many messages and words at most, and there are MOST_PARTS at most; messages in a bucket.
PART_MESSAGES, PART_WORDS, MOST_PARTS, BLOCK = 200_000, 1_000_000, 32_768, 128
#: Bytes of a stored table that a task shuffles at most: its rows are some fifteen times as much, and fit its memory.
PIECE = 16 << 20
#: How such tables are written; a piece has whole row groups.
_STORED = {"compression": "zstd", "parquet.block.size": str(PIECE), "maxRecordsPerFile": "50000"}
#: Bytes of stored words whose postings are on disk at a time: shuffled, they are some four times as much.
ROUND = 160 << 20
#: Buckets that give the first threshold of a search for the best.
FIRST = 16
#: After every word that a prefix begins.
_LAST = "\U0010ffff"
#: Columns of the tables in ranges; {id} is the type of message_id.
_TABLES = {
    "blocks": "word string, bucket int, n long, max_tf int, min_len int, ids array<{id}>, lens array<int>, tfs array<int>, ats array<array<int>>, part int",
    "terms": "word string, df long, part int",
    "grams": "script string, token string, message_id {id}, part int",
}
#: The arrays of a block and what each has of a posting.
_ARRAYS = {"ids": "message_id", "lens": "len", "tfs": "tf", "ats": "places"}


@dataclass(frozen=True)
class Index:
    """An index in a folder, as of one of its manifests."""

    spark: SparkSession
    path: str
    version: int

    @cached_property
    def generations(self) -> list:
        """Rows (gen, parts, n, words): messages and words that each adds, less than none if it takes some."""
        return sorted(self.spark.read.parquet(f"{self.path}/manifest-{self.version}").collect())

    @cached_property
    def lexicon(self) -> lexicon.Lexicon | None:
        """The words of unspaced scripts that were learned when the index was built; none if there were none."""
        known = lexicon.read(self.spark.read.schema("word string, n long").parquet(f"{self.path}/lexicon"))
        return known if known.rows else None

    def words_of(self, body: Column) -> Column:
        """A text's words as they are indexed."""
        return self.lexicon.column()(body) if self.lexicon else text.words(body)

    @cached_property
    def fences(self) -> list:
        """Rows (gen, name, part, low, high): the terms of each range of each table, some MOST_PARTS a table at most."""
        return [(g.gen, *r) for g in self.generations for r in self.spark.read.parquet(f"{self.path}/gen-{g.gen}/fences").collect()]

    def table(self, name: str, wanted: list[tuple[str, str]] | None = None) -> DataFrame:
        """A table of all generations with ``gen``; with ``wanted``, pairs of bounds of terms, only ranges that overlap one."""
        if name == "grams" and not self.has_grams:
            raise ValueError(f"{self.path} is an index of words alone")
        out = None
        for g in self.generations:
            own = _table(self.spark, f"{self.path}/gen-{g.gen}", name)
            if wanted is not None:
                parts = sorted({p for gen, n, p, lo, hi in self.fences if gen == g.gen and n == name and any(lo <= b and a <= hi for a, b in wanted)})
                own = own.where(F.col("part").isin(parts) if parts else F.lit(False))
            own = own.withColumn("gen", F.lit(g.gen))
            out = own if out is None else out.unionByName(own)
        return out

    def live(self, postings: DataFrame) -> DataFrame:
        """Those of ``postings`` (message_id, gen, ...) that no later generation has taken away."""
        if len(self.generations) == 1:
            return postings.drop("gen")
        gone = self.table("gone").groupBy("message_id").agg(F.max("gen").alias("until"))
        return postings.join(gone, "message_id", "left").where("until is null or gen >= until").drop("until", "gen")

    @property
    def n(self) -> int:
        return sum(g.n for g in self.generations)

    @property
    def average(self) -> float | None:
        return sum(g.words for g in self.generations) / self.n if self.n else None

    @property
    def stats(self) -> DataFrame:
        """One row: n and avg_len of all indexed messages."""
        return self.spark.createDataFrame([(self.n, self.average)], "n long, avg_len double")

    @property
    def words(self) -> DataFrame:
        """(word, message_id, positions, len): all postings that hold."""
        return self.live(_posted(self.table("blocks"), places=True)).withColumnRenamed("places", "positions").drop("tf")

    @cached_property
    def has_grams(self) -> bool:
        """Whether n-grams are stored, which is told when it is built."""
        return exists(self.spark, f"{self.path}/gen-{self.generations[0].gen}/grams")

    @property
    def grams(self) -> DataFrame:
        """(script, token, message_id): all n-grams that hold."""
        return self.live(self.table("grams").drop("part"))


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A generation's table, which may be empty."""
    gone = spark.read.parquet(f"{path}/gone")
    if name == "gone":
        return gone
    return spark.read.schema(_TABLES[name].format(id=gone.schema["message_id"].dataType.simpleString())).parquet(f"{path}/{name}")


def _posted(blocks: DataFrame, places: bool) -> DataFrame:
    """(word, message_id, len, tf[, places], gen) of blocks; places are read only if asked for."""
    own = {many: one for many, one in _ARRAYS.items() if places or one != "places"}
    zipped = F.arrays_zip(*(F.col(many).alias(one) for many, one in own.items()))
    return blocks.select("word", "gen", F.explode(zipped).alias("p")).select("word", "gen", *(f"p.{one}" for one in own.values()))


def _bounds(keys: list[str]) -> list[tuple[str, str]]:
    return [(k[:-1], k[:-1] + _LAST) if k.endswith("*") else (k, k) for k in keys]


def _is(key: str) -> Column:
    """Whether the column ``word`` is a key's."""
    return F.col("word").between(key[:-1], key[:-1] + _LAST) if key.endswith("*") else F.col("word") == key


def _any(keys: list[str]) -> Column:
    return reduce(lambda a, b: a | b, map(_is, keys), F.lit(False))


# --- writing ---------------------------------------------------------------------


def _split(index: Index, messages: DataFrame) -> tuple[DataFrame, str]:
    """((message_id, len, posts), path): texts are split once, and a message's words are put together in its row."""
    words = messages.select("message_id", index.words_of(F.col("text")).alias("words"))
    return store(words.select("message_id", F.size("words").alias("len"), text.word_places(F.col("words")).alias("posts")), "index-words", **_STORED)


def _sums(sized: DataFrame) -> tuple[int, int]:
    """Messages and words of ``sized`` (len)."""
    found = sized.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("words")).first()
    return found.n, found.words


def _bucket(sized: DataFrame, first: int = 0) -> tuple[Column, int, int, int]:
    """The bucket of a row of ``sized`` (message_id, len): its class of lengths, dealt to as many buckets as that has room for.

    Buckets are numbered from ``first``; beside them sums of messages and words, and the number after the last one.
    """
    size_class = F.floor(4 * F.log2(F.col("len") + 1)).cast("int")
    # a class for each quarter of a power of two: some hundred
    classes = sorted(sized.groupBy(size_class.alias("c")).agg(F.count("*").alias("n"), F.sum("len").alias("words")).collect())
    starts, many = [], []
    for r in classes:
        room = -(-r.n // BLOCK)
        starts += [F.lit(r.c), F.lit(first)]
        many += [F.lit(r.c), F.lit(room)]
        first += room
    if not classes:
        return F.lit(first), 0, 0, first
    start, room = (F.element_at(F.create_map(*pairs), size_class) for pairs in (starts, many))
    return start + F.pmod(F.xxhash64("message_id"), room).cast("int"), sum(r.n for r in classes), sum(r.words for r in classes), first


def word_postings(split: DataFrame, bucket: Column) -> DataFrame:
    """(word, bucket, message_id, len, places): where each word is in each message."""
    each = split.withColumn("bucket", bucket).select("message_id", "len", "bucket", F.explode("posts").alias("p"))
    return each.select("p.word", "bucket", "message_id", "len", "p.places")


def _blocks(postings: DataFrame, parts: int) -> DataFrame:
    """(word, bucket, n, max_tf, min_len, and arrays by posting) of ``postings`` in ranges, each block in the order of ids.

    The ranges are those of the postings, so blocks are made where they stay: no posting is shuffled twice.
    """
    ranges = postings.repartitionByRange(parts, "word", "bucket").withColumn("tf", F.size("places"))
    held = F.sort_array(F.collect_list(F.struct("message_id", "len", "tf", "places")))
    own = ranges.groupBy("word", "bucket").agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"), held.alias("p"))
    return own.select("word", "bucket", "n", "max_tf", "min_len", *(F.col(f"p.{one}").alias(many) for many, one in _ARRAYS.items()))


def _rounds(split: DataFrame, path: str) -> Iterator[tuple[DataFrame, int]]:
    """(postings, ranges) of the stored words, some ROUND bytes of files at a time.

    Each round has buckets and ranges of its own, and what it read and shuffled goes before the next.
    """
    spark, rounds, size = split.sparkSession, [], ROUND
    for name, length, _ in modified(spark, path):
        if name.endswith(".parquet"):
            if size + length > ROUND:
                rounds.append([])
                size = 0
            rounds[-1].append(name)
            size += length
    first = 0
    for names in rounds:
        own = spark.read.schema(split.schema).parquet(*names)
        bucket, n, words, first = _bucket(own, first)
        yield word_postings(own, bucket), _parts(n, words)
        for name in names:
            forget(spark, name)
        released(spark)


def _write(ranges: DataFrame, path: str, *order: str, first: int = 0) -> None:
    """``ranges`` sorted, a folder each, numbered from ``first``; beside those that are there if that isn't 0."""
    own = ranges.withColumn("part", F.spark_partition_id() + first).sortWithinPartitions("part", *order)
    own.write.mode("append" if first else "overwrite").partitionBy("part").parquet(path, compression="zstd")


def _written(spark: SparkSession, path: str, rounds: Iterable[tuple[DataFrame, int]], grams: DataFrame | None, lost: DataFrame | None, gone: DataFrame, parts: int) -> None:
    """The tables of one generation in ``path``: blocks of the postings of each of ``rounds``, ``grams`` if there are any; ``lost`` are words (word, df) of what it takes away."""
    gone.select("message_id").distinct().write.mode("overwrite").parquet(f"{path}/gone")
    first = 0
    for postings, many in rounds:
        with pieces(spark, PIECE):
            _write(_blocks(postings, many), f"{path}/blocks", "word", "bucket", first=first)
        first += many
    held = _table(spark, path, "blocks").select("word", F.col("n").alias("df"))
    terms = held if lost is None else held.unionByName(lost.select("word", (-F.col("df")).alias("df")))
    _write(terms.groupBy("word").agg(F.sum("df").alias("df")).repartitionByRange(parts, "word"), f"{path}/terms", "word")
    named = [("blocks", "word"), ("terms", "word")]
    if grams is None:
        forget(spark, f"{path}/grams")  # of another index that was here
    else:
        # stored, for the ranges' bounds take a pass of their own over what is cut from the texts
        cut, at = store(grams.select("script", "token", "message_id"), "index-grams", **_STORED)
        order = ("token", "script", "message_id")
        with pieces(spark, PIECE):
            _write(cut.repartitionByRange(parts, *order), f"{path}/grams", *order)
        forget(spark, at)
        named.append(("grams", "token"))
    fences = None
    for name, term in named:
        # a term may have very many rows of a range
        each = _table(spark, path, name).select("part", F.col(term).alias("term")).distinct()
        own = each.groupBy(F.lit(name).alias("name"), "part").agg(F.min("term").alias("low"), F.max("term").alias("high"))
        fences = own if fences is None else fences.unionByName(own)
    fences.coalesce(1).write.mode("overwrite").parquet(f"{path}/fences")


def _parts(n: int, words: int) -> int:
    """Ranges of a generation with so many messages and words: texts may be long, so messages alone don't tell."""
    return max(4, min(MOST_PARTS, max(-(-n // PART_MESSAGES), -(-words // PART_WORDS))))


def _named(spark: SparkSession, path: str, version: int, generations: list[tuple]) -> Index:
    spark.createDataFrame(generations, "gen int, parts int, n long, words long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest-{version}")
    return Index(spark, path, version)


def build(messages: DataFrame, path: str, grams: bool = True) -> Index:
    """Write the index of ``messages`` (message_id, text) to ``path``, with the words of unspaced scripts that they teach.

    Without ``grams`` it is one of words alone, as whatever is added to it later: all full-text
    searches find the same, n-grams aren't stored and :func:`fuzzy` says so.
    """
    spark = messages.sparkSession
    lexicon.learned(messages).coalesce(1).write.mode("overwrite").parquet(f"{path}/lexicon")
    split, at = _split(Index(spark, path, 0), messages)
    n, words = _sums(split)
    parts = _parts(n, words)
    cut = search.fuzzy_grams(messages) if grams else None
    _written(spark, f"{path}/gen-0", _rounds(split, at), cut, None, messages.where(F.lit(False)), parts)
    forget(spark, at)
    return _named(spark, path, 0, [(0, parts, n, words)])


def changed(index: Index, before: DataFrame, after: DataFrame) -> Index:
    """The index after the rows (message_id, text) ``before`` a change became those ``after`` it.

    An addition is a row of ``after`` alone, a deletion one of ``before`` alone, an edit one of both; ``before`` has the
    texts that are indexed.  Work and what is written grow with the change alone.
    """
    spark, gen = index.spark, index.generations[-1].gen + 1
    old = before.select("message_id", index.words_of(F.col("text")).alias("words")).withColumn("len", F.size("words"))
    split, at = _split(index, after)
    n, words = _sums(split)
    less_n, less_words = _sums(old)
    lost = old.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    # the words that it takes are in its dictionary too
    parts = _parts(max(n, less_n), max(words, less_words))
    cut = search.fuzzy_grams(after) if index.has_grams else None
    _written(spark, f"{index.path}/gen-{gen}", _rounds(split, at), cut, lost, before, parts)
    forget(spark, at)
    held = [tuple(g) for g in index.generations]
    return _named(spark, index.path, index.version + 1, [*held, (gen, parts, n - less_n, words - less_words)])


def added(index: Index, messages: DataFrame) -> Index:
    """The index with further ``messages``, none of which is indexed yet."""
    return changed(index, messages.where(F.lit(False)), messages)


def compacted(index: Index) -> Index:
    """The index with all generations made one, by its postings alone; the older folders may go once nobody reads them."""
    spark, gen = index.spark, index.generations[-1].gen + 1
    held = index.live(_posted(index.table("blocks"), places=True))
    sized = held.groupBy("message_id").agg(F.first("len").alias("len"))
    # buckets by what is left: messages without words have no posting and need none
    own = held.withColumn("bucket", _bucket(sized)[0]).select("word", "bucket", "message_id", "len", "places")
    words = sum(g.words for g in index.generations)
    parts = _parts(index.n, words)
    _written(spark, f"{index.path}/gen-{gen}", [(own, parts)], index.grams if index.has_grams else None, None, held.where(F.lit(False)), parts)
    return _named(spark, index.path, index.version + 1, [(gen, parts, index.n, words)])


# --- reading ---------------------------------------------------------------------


def terms(index: Index, keys: list[str]) -> DataFrame:
    """(word, df): the dictionary's words that are one of ``keys``, or that one with a star begins, and how many messages have each."""
    own = index.table("terms", wanted=_bounds(keys)).where(_any(keys))
    return own.groupBy("word").agg(F.sum("df").alias("df")).where("df > 0")


def _postings(index: Index, keys: list[str], places: bool, buckets: DataFrame | None = None) -> DataFrame:
    """(word, message_id, len, tf[, places]) of the words of ``keys``; of ``buckets`` (gen, bucket) alone, if given."""
    blocks = index.table("blocks", wanted=_bounds(keys)).where(_any(keys))
    if buckets is not None:
        blocks = blocks.join(buckets, ["gen", "bucket"], "left_semi")
    return index.live(_posted(blocks, places))


def _idf(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def _saturated(tf: Column, length: Column, average: float) -> Column:
    return tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * length / average))


def full_text(index: Index, query: str, buckets: DataFrame | None = None) -> DataFrame:
    """(message_id, bm25) as :func:`parley.operators.search.full_text` gives it, by the postings of the query's words.

    What matches is decided on which words a message has, and on their places for phrases
    and NEAR; no text is put together.  Words of unspaced scripts are those of the index.
    """
    query = _cut(index, query)
    wanted, words = match.positive_words(query), match.all_words(query)
    if not wanted or not index.n:
        return index.table("gone").where(F.lit(False)).select("message_id", F.lit(0.0).alias("bm25"))
    places = match.needs_places(query)
    # NEAR looks for the first word of a prefix itself too
    keys = list(dict.fromkeys([*words, *(w.rstrip("*") for w in words if places)]))
    every = [F.sum(F.when(_is(k), F.col("tf")).otherwise(0)).alias(f"tf{j}") for j, k in enumerate(keys)]
    if places:
        every += [F.flatten(F.collect_list(F.when(_is(k), F.col("places")))).alias(f"at{j}") for j, k in enumerate(keys)]
    held = _postings(index, words, places, buckets).groupBy("message_id").agg(F.first("len").alias("len"), *every)
    at = {k: j for j, k in enumerate(keys)}
    matched = held.where(match.by_places(query, lambda k: F.col(f"tf{at[k]}") > 0, lambda k: F.col(f"at{at[k]}")))
    known = {r["word"]: r["df"] for r in terms(index, [w for w in wanted if not w.endswith("*")]).collect()} if any(not w.endswith("*") for w in wanted) else {}
    score, prefixes = F.lit(0.0), [w for w in wanted if w.endswith("*")]
    for w in wanted:
        if w.endswith("*"):
            idf = F.log(1 + (F.lit(index.n) - F.col(f"df{at[w]}") + 0.5) / (F.col(f"df{at[w]}") + 0.5))
        else:
            idf = F.lit(_idf(index.n, known.get(w, 0)))
        score = score + idf * _saturated(F.col(f"tf{at[w]}"), F.col("len"), index.average)
    if prefixes:
        counts = held.agg(*(F.count(F.when(F.col(f"tf{at[w]}") > 0, 1)).alias(f"df{at[w]}") for w in prefixes))
        matched = matched.crossJoin(F.broadcast(counts))  # one row
    return matched.select("message_id", score.alias("bm25"))


def _cut(index: Index, query: str) -> str:
    return index.lexicon.query(query) if index.lexicon else query


#: Scores closer than this count as equal where blocks are left out.
SLACK = 1e-6


def bucket_bounds(index: Index, query: str) -> DataFrame:
    """(gen, bucket, bound, postings): buckets that may hold a match of a query without prefixes, and a score that none in it exceeds."""
    query = _cut(index, query)
    wanted = match.positive_words(query)
    known = {r["word"]: r["df"] for r in terms(index, wanted).collect()}
    # the arrays of the blocks aren't read
    own = index.table("blocks", wanted=_bounds(wanted)).where(_any(wanted))
    idf = reduce(lambda c, w: F.when(F.col("word") == w, _idf(index.n, known.get(w, 0))).otherwise(c), wanted, F.lit(0.0))
    best = idf * _saturated(F.col("max_tf"), F.col("min_len"), index.average)
    found = own.groupBy("gen", "bucket").agg(F.sum(best).alias("bound"), F.sum("n").alias("postings"), F.collect_set("word").alias("words"))
    needed = [w for w in match.needed(query) if w in wanted]
    return found.where(reduce(lambda a, b: a & b, (F.array_contains("words", w) for w in needed), F.lit(True))).drop("words")


def best(index: Index, query: str, k: int) -> DataFrame:
    """(message_id, bm25) of all messages that may be among the ``k`` best, and few others: blocks that can't hold one aren't read.

    The buckets of the highest bounds give a threshold, their k-th score; then buckets
    whose bound reaches it are read.  A query with a prefix, whose weight only all its
    postings tell, is scored whole.
    """
    query = _cut(index, query)
    wanted = match.positive_words(query)
    if not wanted or not index.n or any(w.endswith("*") for w in wanted):
        return full_text(index, query)
    bounds = bucket_bounds(index, query)
    first = bounds.orderBy(F.desc("bound"), "gen", "bucket").limit(FIRST)
    scores = full_text(index, query, first).orderBy(F.desc("bm25")).limit(k).collect()  # k numbers
    least = scores[-1]["bm25"] - SLACK if len(scores) == k else 0.0
    return full_text(index, query, bounds.where(F.col("bound") >= least))


def fuzzy(index: Index, query: str) -> DataFrame:
    """(message_id, fuzzy) as :func:`parley.operators.search.fuzzy` gives it, by the postings of the query's n-grams."""
    asked = text.query_grams(query)
    tokens = sorted({token for own in asked.values() for token in own})
    if not tokens:
        return index.table("gone").where(F.lit(False)).select("message_id", F.lit(0.0).alias("fuzzy"))
    own = index.table("grams", wanted=[(t, t) for t in tokens]).where(F.col("token").isin(tokens))
    return search.fuzzy_of(index.live(own), asked)


def lexical(index: Index, messages: DataFrame, query: str) -> DataFrame:
    """Messages hit by full text or n-grams, with ``base`` = 2 bm25 + fuzzy; each once."""
    return search.merged_hits(messages, full_text(index, query), fuzzy(index, query))


def hybrid(index: Index, messages: DataFrame, query: search.SearchQuery, limit: int = 200) -> DataFrame:
    """As :func:`parley.operators.search.hybrid`; statistics are those of all indexed messages, whatever the filters."""
    kept = search.filtered(messages, query)
    if not query.text.strip():
        return search.newest_first(kept.withColumn("rank_score", F.lit(0.0)), limit)
    return search.ranked(search.decayed(lexical(index, kept, query.text)), limit)
