"""Repeated spans of words, by a compacted de Bruijn graph.

Every WINDOW consecutive words are an edge from the node of its first WINDOW - 1 words
to that of its last; two 64-bit hashes of nodes tell an edge.  Only edges that several
documents may share are ever shuffled: each window names its GRAM words of the least hash,
equal windows name equal ones, and windows that follow each other and name the same place
are one segment.  Segments whose place's words occur once are let go by a join; of the
others, equal ones become one before their edges meet.

An edge that starts in several documents is repeated and has a source: its place in the
document of the least doc_id.  Joins with the nodes' degrees compact repeated edges that
follow each other in their source, with no branch between, into paths.  A document's
windows on a path, joined back segment by segment, are spans with the coordinates of their
source, and no word goes before a span's words were found equal to its source's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import word_hashes
from .common import bounded_batches, forget, numbered, released, store, stored

#: Words of a window, words that name its place, and edges of a source that are compared at once.
WINDOW, GRAM, CELL = 13, 5, 64


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The segments (m, row, pos, n) of rows (row, text): hash of the naming words, row, first window, windows."""
    offsets = WINDOW - GRAM + 1
    for batch in batches:
        for own in word_hashes.bounded(batch, "text"):
            hashes, doc = word_hashes.words(own["text"])
            rows = own["row"].to_numpy()
            firsts = np.searchsorted(doc, np.arange(len(rows)))
            for lo in range(0, len(hashes) - WINDOW + 1, word_hashes.WORDS):
                here = hashes[lo : lo + word_hashes.WORDS + WINDOW - 1]
                grams = word_hashes.runs(here, GRAM)
                n = len(here) - WINDOW + 1
                least, place = grams[:n].copy(), np.zeros(n, np.int8)
                for k in range(1, offsets):
                    other = grams[k : k + n]
                    less = other < least
                    least[less] = other[less]
                    place[less] = k
                at = doc[lo : lo + n]
                window = np.flatnonzero(at == doc[lo + WINDOW - 1 : lo + n + WINDOW - 1])
                if not len(window):
                    continue
                named = window + place[window]
                new = np.concatenate(([True], (named[1:] != named[:-1]) | (at[window[1:]] != at[window[:-1]])))
                begin = np.flatnonzero(new)
                first = window[begin]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(least[first].view(np.int64)),
                        pa.array(rows[at[first]]),
                        pa.array((lo + first - firsts[at[first]]).astype(np.int32)),
                        pa.array(np.diff(np.append(begin, len(window))).astype(np.int32)),
                    ],
                    names=["m", "row", "pos", "n"],
                )


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The segments of rows (row, doc_id, text, pos, n) with their first and last node and the nodes of all their edges."""
    for batch in batches:
        for own in word_hashes.bounded(batch, "text"):
            hashes, doc = word_hashes.words(own["text"])
            nodes = np.concatenate(
                [word_hashes.runs(hashes[lo : lo + word_hashes.WORDS + WINDOW - 2], WINDOW - 1) for lo in range(0, max(1, len(hashes)), word_hashes.WORDS)]
            ).view(np.int64)
            firsts = np.searchsorted(doc, np.arange(own.num_rows))
            segments = np.diff(own["pos"].offsets.to_numpy())
            of = np.repeat(np.arange(own.num_rows), segments)
            pos, n = own["pos"].flatten().to_numpy(), own["n"].flatten().to_numpy()
            at = firsts[of] + pos
            size = n.astype(np.int64) + 1
            ends = np.cumsum(size)
            each = np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - (ends - size), size)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(nodes[each]))
            arrays = [nodes[at], nodes[at + n], n, own["doc_id"].to_numpy()[of], own["row"].to_numpy()[of], pos]
            yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), lists], names=["u0", "v0", "n", "doc_id", "row", "pos", "nodes"])


def _segments(own: DataFrame) -> tuple[DataFrame, str]:
    """A stored table of the segments of ``own`` (row, doc_id, text) whose naming words are not once in all, and its path: u0, v0, n, doc_id, row, pos, nodes."""
    spark = own.sparkSession
    anchors, path = store(own.select("row", "text").mapInArrow(_anchored, "m long, row long, pos int, n int"), "spans-anchors")
    common, common_path = store(anchors.groupBy("m").count().where("count > 1").select("m"), "spans-common")
    spots = anchors.join(common, "m", "left_semi").groupBy("row").agg(F.collect_list(F.struct("pos", "n")).alias("s"))
    wanted, wanted_path = store(spots.select("row", "s.pos", "s.n"), "spans-wanted")
    for old in (path, common_path):
        forget(spark, old)
    del anchors, common, spots
    released(spark)
    given = own.join(wanted, "row").select("row", "doc_id", "text", "pos", "n")
    out = store(given.mapInArrow(_edges, "u0 long, v0 long, n int, doc_id long, row long, pos int, nodes array<long>"), "spans-segments")
    forget(spark, wanted_path)
    return out


def _distinct(own: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """(places, distinct, path of distinct), stored tables: where each segment is (segment, doc_id, row, pos), and the different ones with a source."""
    segments, path = _segments(own)
    released(own.sparkSession)
    heads = segments.groupBy("u0", "v0", "n").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.min_by(F.struct("row", "pos", "nodes"), "doc_id").alias("src")
    )
    distinct, distinct_path = store(heads.withColumn("segment", F.monotonically_increasing_id()), "spans-distinct")
    names = distinct.select("u0", "v0", "n", "segment")
    places = stored(segments.join(names, ["u0", "v0", "n"]).select("segment", "doc_id", "row", "pos"), "spans-places")
    forget(own.sparkSession, path)
    return places, distinct, distinct_path


def paths(windows: DataFrame) -> DataFrame:
    """A stored table (u, v, least, src_row, src_pos, path): the repeated edges of ``windows`` with their source, and where in it their compacted path begins.

    ``windows`` (u, v, least, most, src_row, src_pos) may have an edge many times.  A node
    with one repeated edge in and one out is inside a path.
    """
    every = windows.groupBy("u", "v").agg(
        F.min("least").alias("least"), F.max("most").alias("most"), F.min_by("src_row", "least").alias("src_row"), F.min_by("src_pos", "least").alias("src_pos")
    )
    repeated, path = store(every.where("least < most").drop("most"), "spans-repeated")
    released(windows.sparkSession)
    ends = repeated.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        repeated.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    )
    inner = ends.groupBy("u").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).where("out = 1 and into = 1").select("u", F.lit(True).alias("inner"))
    linked = repeated.join(inner, "u", "left")
    in_source = Window.partitionBy("src_row").orderBy("src_pos")
    follows = F.coalesce("inner", F.lit(False)) & (F.lag("src_pos").over(in_source) == F.col("src_pos") - 1)
    begun = linked.withColumn("begin", F.when(~F.coalesce(follows, F.lit(False)), F.col("src_pos")))
    first = F.max("begin").over(in_source.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = stored(begun.select("u", "v", "least", "src_row", "src_pos", first.alias("path")), "spans-paths")
    forget(windows.sparkSession, path)
    return out


def _verdicts(distinct: DataFrame) -> DataFrame:
    """A stored table (segment, pieces): which windows of each different segment are on which path."""
    edges = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(i.alias("i"), F.get("src.nodes", i).alias("u"), F.get("src.nodes", i + 1).alias("v")))
    each = distinct.select("segment", "least", "most", F.col("src.row").alias("row"), F.col("src.pos").alias("pos"), F.explode(edges).alias("e"))
    windows = each.select("segment", "e.i", "e.u", "e.v", "least", "most", F.col("row").alias("src_row"), (F.col("pos") + F.col("e.i")).alias("src_pos"))
    graph = paths(windows.drop("segment", "i"))
    released(distinct.sparkSession)
    placed = windows.select("segment", "i", "u", "v").join(graph, ["u", "v"])
    places = ["segment", "src_row", "path", F.floor(F.col("src_pos") / CELL).alias("cell"), (F.col("src_pos") - F.col("i")).alias("shift")]
    pieces = placed.groupBy(*places).agg(F.min("i").alias("i"), F.count("*").cast("int").alias("n"), F.min("least").alias("least"))
    return stored(pieces.groupBy("segment").agg(F.collect_list(F.struct("src_row", "path", "cell", "shift", "i", "n", "least")).alias("pieces")), "spans-verdicts")


def spans(own: DataFrame) -> DataFrame:
    """A stored table of the spans of ``own`` (row, doc_id, text) that start in a document with a smaller doc_id too.

    (row, start, n, src_row, src_start): n windows from word ``start`` on are those of the
    source from ``src_start`` on.  Long spans come in pieces of CELL edges of their source.
    """
    spark = own.sparkSession
    places, distinct, path = _distinct(own)
    released(spark)
    verdicts = _verdicts(distinct)
    forget(spark, path)
    released(spark)
    later = places.join(verdicts, "segment").select("doc_id", "row", "pos", F.explode("pieces").alias("p")).where("p.least < doc_id")
    at = F.col("pos") + F.col("p.i")
    moved = later.select("row", "p.src_row", "p.path", "p.cell", (at - (F.col("p.shift") + F.col("p.i"))).alias("by"), at.alias("start"), F.col("p.n").alias("n"))
    # a document that differs from its source in the middle of a path has two spans on it
    on_path = ["row", "src_row", "path", "cell", "by"]
    in_order = Window.partitionBy(*on_path).orderBy("start")
    broken = F.coalesce(F.lag(F.col("start") + F.col("n")).over(in_order) != F.col("start"), F.lit(True))
    parts = moved.withColumn("broken", broken.cast("int")).withColumn("part", F.sum("broken").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = parts.groupBy(*on_path, "part").agg(F.min("start").alias("start"), F.sum("n").cast("int").alias("n"))
    out = stored(merged.select("row", "start", "n", "src_row", (F.col("start") - F.col("by")).alias("src_start")), "spans")
    del places, distinct, verdicts, later, moved, parts, merged
    released(spark)
    return out


_CUT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("kept", T.StringType()),
        T.StructField("own", T.ArrayType(T.BinaryType())),
        T.StructField("given", T.ArrayType(T.BinaryType())),
    ]
)


@F.arrow_udf(_CUT)
def _cut(text: pa.Array, cuts: pa.Array, sources: pa.Array) -> pa.Array:
    """Every text without the words of ``cuts`` (start, n), and digests of the words of its cuts and of what others have from it."""
    out = []
    for t, gone, asked in zip(text, cuts.to_pylist(), sources.to_pylist()):
        own = (t.as_py() or "").encode().split()  # bytes: only ASCII white space
        digests = [[hashlib.sha256(b" ".join(own[s["start"] : s["start"] + s["n"] + WINDOW - 1])).digest() for s in some or ()] for some in (gone, asked)]
        kept = np.ones(len(own), bool)
        for s in gone or ():
            kept[s["start"] : s["start"] + s["n"] + WINDOW - 1] = False
        left = own if kept.all() else [own[k] for k in np.flatnonzero(kept).tolist()]
        out.append((len(own), len(own) - len(left), b" ".join(left).decode(), *digests))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.binary())]
    columns = zip(*out) if out else [[]] * len(kinds)
    return pa.StructArray.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["n_words", "n_removed", "kept", "own", "given"])


def _with_cuts(own: DataFrame, found: DataFrame, columns: dict) -> DataFrame:
    """A stored table of ``columns``, as ``out``, of all rows of ``own`` and their ``cut``, with what verifies it."""
    cuts = found.groupBy("row").agg(F.collect_list(F.struct("start", "n", "src_row", "src_start")).alias("cuts"))
    asked = found.select(F.col("src_row").alias("row"), F.col("src_start").alias("start"), "n").distinct()
    sources = asked.groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("sources"))
    joined = own.join(cuts, "row", "left").join(sources, "row", "left")
    spots = F.transform("cuts", lambda s: F.struct(s["start"].alias("start"), s["n"].alias("n")))
    cut = joined.withColumn("cut", _cut("doc.text", spots, "sources"))
    return stored(cut.select("row", "cuts", "sources", F.col("cut.own").alias("own"), F.col("cut.given").alias("given"), F.struct(*(c.alias(n) for n, c in columns.items())).alias("out")), "spans-cut")


def _wrong(cut: DataFrame) -> DataFrame:
    """The spans (row, start) of ``cut`` whose words are not those of their source."""
    own = cut.select("row", F.explode(F.arrays_zip("cuts", "own")).alias("c")).select("row", "c.cuts.*", F.col("c.own").alias("words"))
    given = cut.select(F.col("row").alias("src_row"), F.explode(F.arrays_zip("sources", "given")).alias("c"))
    given = given.select("src_row", F.col("c.sources.start").alias("src_start"), "c.sources.n", F.col("c.given").alias("src_words"))
    joined = own.join(given, ["src_row", "src_start", "n"], "left")
    return joined.where(~F.col("words").eqNullSafe(F.col("src_words"))).select("row", "start", "n", "src_row", "src_start")


def cut_spans(docs: DataFrame, columns: dict) -> DataFrame:
    """``columns`` (by name) of every row of ``docs``, which may use its columns and ``cut``: n_words, n_removed and kept, the words that stay joined by spaces.

    A word goes if a window of WINDOW words over it starts in a document with a smaller
    doc_id too; windows are those of the input.  Rows with equal doc_id don't take words
    from each other; rows without one lose nothing and take nothing.  Null, empty and
    blank texts have no words, and texts of fewer than WINDOW words stay whole.  Whole
    texts count, however long; repeated rows give a row each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    own, row = numbered(bounded_batches(docs), "span-rows")
    named = own.select(F.col(row).alias("row"), F.struct(*docs.columns).alias("doc"))
    found = spans(own.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null"))
    while True:
        cut = _with_cuts(named, found, columns)
        wrong = _wrong(cut)
        if wrong.isEmpty():
            return cut.select("out.*")
        # two runs of words with one hash: these spans are none
        found = stored(found.join(stored(wrong, "spans-wrong"), found.columns, "left_anti"), "spans")


def dedup_spans(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, without repeated spans; what loses words has the others joined by single spaces; see :func:`cut_spans`."""
    own = {c: F.col("doc")[c] for c in docs.columns}
    changed = F.when(F.col("cut.n_removed") > 0, F.col("cut.kept")).otherwise(own["text"])
    return cut_spans(docs, own | {"text": changed})
