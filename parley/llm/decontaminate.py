"""Benchmark decontamination by a prefix-filtered containment join of shingles.

A benchmark item is a set of windows of 13 consecutive words, and a document is
contaminated by windows that it contains whole.  A window is a set of four-word
shingles; for whole containment its necessary prefix, when they are ordered by rarity
over all documents, is its rarest shingle alone: only where a document has that shingle
can the window be.  The shingle's place in the window then fixes where the window would
begin (the positional bound) and end (the length bound), and the document's words there
are compared with the window's.  DataFrame and SQL functions only.

A map of hashes, one byte a slot, tells which places may have a wanted shingle, in the task
that reads the text; only these places, with the words around them, are stored and joined.
The map grows with the benchmark up to MOST_SLOTS; beyond, more places are joined in vain,
by the same plan and with the same result.  It is the value of a stored table that plans
refer to: as a literal it would be written out, two digits a slot, wherever the driver
describes a plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, released, stored

WINDOW, SHINGLE = 13, 4
#: A document is contaminated if hit words are at least this part of its words.
SHARE = 20
#: Slots of the map of wanted shingles: so many for each, and at most so many.
SLOTS_EACH, MOST_SLOTS = 64, 1 << 23

#: Fixed value: what separates words, after A-Z are lower-cased.
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text, a null one as an empty one; only A-Z are lower-cased."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, _BREAKS, -1), "")


def _shingle(words: Column | str, at: Column, size: int) -> Column:
    """The hash of the ``size`` words from ``at`` (from 0) on."""
    return F.xxhash64(F.lit(size), *(F.get(words, at + k) for k in range(size)))


def _windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored tables (window, m, run) of the different windows, and (window, item_id) of the items that have them.

    An item of fewer than WINDOW words, but not none, is one window.
    """
    own = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w"))
    kept = own.where(F.size("w") > 0).distinct().withColumn("m", F.least(F.lit(WINDOW), F.size("w")))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)
    parts = kept.select("item_id", "m", "w", F.explode(starts).alias("s")).select("item_id", "m", F.slice("w", F.col("s"), F.col("m")).alias("run"))
    parts = stored(parts.distinct(), "benchmark-parts")
    windows = stored(parts.select("m", "run").distinct().select(F.monotonically_increasing_id().alias("window"), "m", "run"), "benchmark-windows")
    return windows, stored(parts.join(windows, ["m", "run"]).select("window", "item_id"), "benchmark-window-items")


def _shingles(windows: DataFrame, sizes: list[int]) -> DataFrame:
    """(window, m, run, k, h, offset): every shingle of ``k`` words of each window; ``k`` is SHINGLE or, in shorter windows, all."""
    out = None
    for k in sizes:
        own = windows.where(F.least(F.col("m"), F.lit(SHINGLE)) == k)
        places = own.select("window", "m", "run", F.explode(F.sequence(F.lit(0), F.col("m") - k)).alias("offset"))
        part = places.select("window", "m", "run", F.lit(k).alias("k"), _shingle("run", F.col("offset"), k).alias("h"), "offset")
        out = part if out is None else out.unionByName(part)
    return out


def _slots(wanted: DataFrame) -> tuple[DataFrame, int]:
    """A map of the hashes ``h`` of ``wanted``: a stored value with a byte for each slot, 1 if taken, and the number of slots, at most MOST_SLOTS."""
    n = wanted.count()
    slots = 1 << 10
    while slots < min(MOST_SLOTS, SLOTS_EACH * n):
        slots *= 2
    taken = bytearray(slots)
    slot = F.col("h").bitwiseAND(F.lit(slots - 1)).cast("int")
    held = wanted.select(slot.alias("slot")).distinct().groupBy(F.floor(F.col("slot") / 4096)).agg(F.collect_list("slot").alias("held"))
    for row in held.collect():  # at most MOST_SLOTS numbers
        for at in row["held"]:
            taken[at] = 1
    return stored(wanted.sparkSession.createDataFrame([(bytes(taken),)], "held binary"), "benchmark-map"), slots


def _places(own: DataFrame, wanted: DataFrame, sizes: list[int]) -> DataFrame:
    """A row (all columns of ``own``, k, pos, h) for each place of the array ``words`` that may have a shingle ``h`` of ``wanted``."""
    held, slots = _slots(wanted)
    n, k, pos = F.size("words"), F.col("k"), F.col("pos")
    starts = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
    # outer: else Spark asks for an array that isn't empty first, and cuts each text again for that
    placed = own.withColumn("k", F.explode(F.array(*map(F.lit, sizes)))).withColumn("pos", F.explode_outer(starts))
    h = F.lit(None).cast("long")
    for size in sizes:
        h = F.when(k == size, _shingle("words", pos, size)).otherwise(h)
    slot = F.col("h").bitwiseAND(F.lit(slots - 1)).cast("int") + 1
    return placed.withColumn("h", h).where(pos.isNotNull() & (F.substring(held.scalar(), slot, F.lit(1)) == F.lit(b"\x01")))


def _prefixes(own: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """A stored table (k, h, window, m, run, offset): the rarest shingle of each window that all words of ``own`` may hold.

    Rarity is the number of occurrences in all texts.  A window with a shingle that no
    text has is left out.
    """
    shingles = stored(_shingles(windows, sizes), "benchmark-shingles")
    wanted = stored(shingles.select("k", "h").distinct(), "benchmark-wanted")
    places = _places(own.select(words_of(F.col("text")).alias("words")), wanted, sizes)
    seen = places.groupBy("k", "h").agg(F.count("*").alias("seen"))
    ranked = shingles.join(seen, ["k", "h"], "left")
    rarest = F.min_by(F.struct("k", "h", "offset"), F.struct("seen", "h", "offset"))
    by_window = ranked.groupBy("window").agg(rarest.alias("first"), (F.count("*") == F.count("seen")).alias("whole"))
    chosen = by_window.where("whole").select("window", "first.*")
    return stored(chosen.join(windows, "window"), "benchmark-prefixes")


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: row, doc_id, n_words, n_hit, items.

    ``row`` numbers the rows; ``items`` has the ids, as strings, of items with an
    occurring window.  Null and empty texts have no words and no hits; whole texts and
    items count, however long.  Repeated rows give a row each.  Items without words are
    left out; an item without an id hits words but isn't listed; repeated items count
    once.  An empty benchmark hits nothing, and an empty table gives no rows.
    """
    own, row = numbered(docs, "decontaminate-rows")
    return _hits(own.select(F.col(row).alias("row"), "doc_id", "text"), benchmark)


def _hits(own: DataFrame, benchmark: DataFrame) -> DataFrame:
    occurring, window_items = _occurring(own, benchmark)
    none = F.expr("cast(array() as array<string>)")
    named = window_items.where("item_id is not null")
    listed = occurring.select("row", "window").distinct().join(named, "window").groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    every = own.select("row", "doc_id", F.size(words_of(F.col("text"))).alias("n_words"))
    every = every.join(_counted(occurring).drop("n_words").join(listed, "row", "left"), "row", "left")
    return every.select("row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"))


def _counted(occurring: DataFrame) -> DataFrame:
    """(row, n_words, n_hit) for each row with a hit."""
    spans = F.transform(F.collect_set(F.struct("start", "m")), lambda x: F.sequence(x["start"], x["start"] + x["m"] - 1))
    return occurring.groupBy("row").agg(F.first("n_words").alias("n_words"), F.size(F.array_distinct(F.flatten(spans))).alias("n_hit"))


def _occurring(own: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored tables (row, n_words, window, start, m) of the windows where they occur in ``own``, and (window, item_id)."""
    windows, window_items = _windows(benchmark)
    sizes = sorted(r["k"] for r in windows.select(F.least(F.col("m"), F.lit(SHINGLE)).alias("k")).distinct().collect())  # at most SHINGLE numbers
    if not sizes:
        nothing = own.sparkSession.createDataFrame([], "row long, n_words int, window long, start int, m int")
        return nothing, window_items
    prefixes = _prefixes(own, windows, sizes)
    around = WINDOW - 1
    words = own.select("row", words_of(F.col("text")).alias("words"))
    near = F.expr(f"slice(words, greatest(pos - {around}, 0) + 1, least(pos, {around}) + {WINDOW})")
    found = _places(words, prefixes, sizes).select("row", F.size("words").alias("n_words"), "k", "h", "pos", near.alias("near"))
    found = stored(found, "decontaminate-places")

    begin = F.col("pos") - F.col("offset")
    met = found.join(prefixes, ["k", "h"]).where((begin >= 0) & (begin + F.col("m") <= F.col("n_words")))
    base = F.greatest(F.col("pos") - around, F.lit(0))
    same = F.slice("near", begin - base + 1, F.col("m")) == F.col("run")
    whole = met.where(same).select("row", "n_words", "window", begin.alias("start"), "m").distinct()
    whole = stored(whole, "decontaminate-hits")
    released(own.sparkSession)
    return whole, window_items


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (SHARE * n_hit >= n_words)


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_hit, items, contaminated."""
    return hits(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", "items", contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated")
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns."""
    own, row = numbered(docs, "decontaminate-rows")
    occurring, _ = _occurring(own.select(F.col(row).alias("row"), "text"), benchmark)
    bad = _counted(occurring).where(contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("row").alias("bad_row"))
    bad = stored(bad, "contaminated")
    return own.join(bad, own[row] == bad["bad_row"], "left_anti").drop(row)
