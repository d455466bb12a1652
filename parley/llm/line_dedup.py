"""Line deduplication by overlapping windows of three lines.

Every window of three consecutive lines is hashed (128 bits).  The first occurrence
of a window, by doc_id, row and position, stays; the positions that later ones cover
are merged and removed.  A removed line always has an earlier equal one, so every
line of the input stays at least once.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, numbered, stored

LINES = 3


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _windows(own: DataFrame, row: str) -> DataFrame:
    """(h1, h2, doc_id, row, pos) of every window of LINES lines."""
    split = own.select(F.col(row).alias("row"), "doc_id", lines_of(F.col("text")).alias("lines")).where(F.size("lines") >= LINES)
    starts = F.sequence(F.lit(0), F.size("lines") - LINES)

    def hashed(i: Column) -> Column:
        own = [F.get("lines", i + k) for k in range(LINES)]
        return F.struct(F.xxhash64(*own).alias("h1"), F.xxhash64(F.lit(LINES), *own).alias("h2"))

    return split.select("doc_id", "row", F.posexplode(F.transform(starts, hashed)).alias("pos", "h")).select(
        "h.h1", "h.h2", "doc_id", "row", "pos"
    )


def covered_lines(own: DataFrame, row: str) -> DataFrame:
    """(row, covered): for each row with any, the positions of its lines that go.

    ``own`` is numbered by its column ``row``.  Windows are counted before the shuffle, and
    the repeated ones stored, so that a window that very many rows share meets its first
    occurrence in a join of two plain exchanges, which Spark splits where one is skewed.
    """
    windows = _windows(own, row)
    place = F.struct("doc_id", "row", "pos")
    repeated = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = stored(repeated, "lines-repeated")
    later = windows.join(repeated.hint("merge"), ["h1", "h2"]).where(place > F.col("first"))
    merged = F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("pos"), F.col("pos") + LINES - 1))))
    return later.groupBy("row").agg(merged.alias("covered"))


def dedup_lines(docs: DataFrame, removed: str | None = None) -> DataFrame:
    """``docs`` with the covered lines taken out of ``text``; other columns, whatever their names, stay.

    Texts of fewer than three lines and null texts stay as they are, and whole texts
    count, however long; a text all of whose lines are covered becomes empty; rows with a
    null doc_id come before all others, and of rows with equal doc_id the one scanned
    first.  Of a repeated row all windows but the first row's go.  An empty table stays
    empty.  With ``removed``, a column of that name has the number of lines taken out.
    """
    own, row = numbered(docs, "line-rows")
    gone = fresh(own, "covered")
    # a stored table: small beside the texts, of which only those with covered lines are joined
    covered = stored(covered_lines(own, row).select(F.col("row").alias(row), F.col("covered").alias(gone)), "lines-covered")
    lines = lines_of(F.col("text"))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    text = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    # it may be of any size, so it is never broadcast
    joined = own.join(covered.hint("merge"), row, "left")
    out = joined.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(text))
    if removed:
        out = out.withColumn(removed, F.coalesce(F.array_size(gone), F.lit(0)))
    return out.select(*docs.columns, *([removed] if removed and removed not in docs.columns else []))
