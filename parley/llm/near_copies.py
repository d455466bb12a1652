"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

The document form of operator 6.  Bits of a SimHash can't tell a similarity of 0.8 by a
covering: such pairs differ in about 10 and up to 20 of 64 bits, and covering a radius
of 20 takes 2**21 - 1 tables.  So what is covered here are the sets themselves, by
necessary shared shingles, and every pair of 0.8 or more collides by construction.

A set's shingles are ordered by rarity, and its first fifth are its keys: two near sets
share a key, for else they would differ in too much.  Passages that many documents share
come last in the order and make no keys.  Under the first key that a near pair shares,
their places in the order bound what they can have in common; who can have no partner
there leaves the key.

Where a key is shared by many, pairs aren't listed: each member is compared with a few
leaders of its key, drawn by hash.  What is near one leaves the key.  By the triangle
inequality of the Jaccard distance, it can't be a near copy of a document that is more
than twice the distance away from its leader; what lies between is compared in full unless
it is already linked.  Each round has four times the leaders of the one before, and a key
with no more members than that has its pairs compared, so rounds grow with the logarithm
of the number of documents that share a key, near or not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, forget, numbered, released, store, stored
from .components import components

SHINGLE, SEED = 5, 42
#: Jaccard similarity of near copies, as a fraction.
NEAR = (4, 5)
#: A key of at most so many members has its pairs compared; leaders of a fuller one, and how many times as many each round.
PAIRS, LEADERS, TIMES = 16, 2, 4
#: Shingles are counted in so many classes of their hashes (their low bits).  Any order that all sets agree
#: on gives the same groups; more classes part frequent shingles better from others.
CLASSES = 1 << 17


def shingles(text: str) -> np.ndarray:
    """The different shingles' hashes in order; a shorter text is one shingle, one without words has none."""
    words = text.encode().lower().split()  # as for fingerprints: only A-Z and ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    n = len(words) - SHINGLE + 1
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())], np.uint64))


def class_counts(docs: DataFrame) -> np.ndarray:
    """How many shingles of all ``docs`` fall into each class of their hashes: CLASSES numbers, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            loads = np.zeros(CLASSES, np.int64)
            for text in batch.column(0):
                loads += np.bincount((shingles(text.as_py() or "") & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES)
            held = np.flatnonzero(loads)
            yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(loads[held])], names=["c", "n"])

    loads = np.zeros(CLASSES, np.int64)
    found = docs.select("text").mapInArrow(count, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).toArrow()
    loads[found["c"].to_numpy()] = found["n"].to_numpy()
    return loads


def marks(loads: np.ndarray, docs: DataFrame):
    """A UDF of texts: the set's digest, alike for equal sets only, its size, its rarest shingles in order, and 32 bits of each shingle.

    The rarest are as many as two sets of the threshold must share one of: all but four
    fifths, and one.  A null text is an empty set.
    """
    sent = docs.sparkSession.sparkContext.broadcast(loads)  # CLASSES numbers
    top, bottom = NEAR
    kind = T.StructType(
        [
            T.StructField("digest", T.BinaryType()),
            T.StructField("n", T.IntegerType()),
            T.StructField("keys", T.ArrayType(T.LongType())),
            T.StructField("shingles", T.ArrayType(T.IntegerType())),
        ]
    )

    @F.arrow_udf(kind)
    def marked(text: pa.Array) -> pa.Array:
        digests, sizes, keys, sets = [], [], [], []
        for t in text:
            own = shingles(t.as_py() or "")
            n = len(own)
            digests.append(xxhash.xxh3_128_digest(own.tobytes()))
            sizes.append(n)
            first = np.lexsort((own, sent.value[(own & np.uint64(CLASSES - 1)).astype(np.int64)]))[: n - -(-n * top // bottom) + 1]
            keys.append(own[first].view(np.int64))
            sets.append((own >> np.uint64(32)).astype(np.uint32).view(np.int32))
        lists = [pa.array(x, pa.list_(kind)) for x, kind in ((keys, pa.int64()), (sets, pa.int32()))]
        return pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), *lists], ["digest", "n", "keys", "shingles"])

    return marked


def _with_partners(members: DataFrame, name: str) -> DataFrame:
    """A stored table of those ``members`` (key, node, n, pos) that may have a near copy under their key.

    Two sets whose first common key is at places p and q have at most the lesser of
    n - p and m - q in common, and must have four ninths of n + m.
    """
    top, bottom = NEAR
    # the largest partner that what is left from the key on allows
    most = F.floor(((F.col("n") - F.col("pos")) * (top + bottom) - F.col("n") * top) / top)
    sized = members.withColumn("most", most)
    bounds = sized.groupBy("key").agg(F.count("*").alias("members"), F.min("n").alias("least_n"), F.max("most").alias("most_most")).where("members > 1")
    open_ones = sized.join(bounds, "key").where((F.col("most") >= F.col("least_n")) & (F.col("n") <= F.col("most_most")))
    return stored(open_ones.select("key", "node", "n", "pos", "most"), name)


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``common`` and ``either``, the sizes of intersection and union.

    By 32 bits of each hash: of sets of n shingles one pair in 2**32 / n**2 is taken to
    have one more in common than it has.
    """
    own, other = sets.toDF("a", "set_a"), sets.toDF("b", "set_b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    joined = pairs.join(own, "a").join(other, "b").select("a", "b", common.alias("common"), (F.size("set_a") + F.size("set_b")).alias("total"))
    return joined.select("a", "b", "common", (F.col("total") - F.col("common")).alias("either"))


def _near(top: int, bottom: int) -> Column:
    return F.col("common") * bottom >= F.col("either") * top


def links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of all near pairs among ``members``, which :func:`_with_partners` gives.

    ``sets`` (node, shingles) must be a stored table.
    """
    found, rounds, leaders = [], [], LEADERS
    while True:
        counts = stored(members.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "near-shared")
        at = members.join(counts, "key")
        few = at.where(F.col("members") <= max(PAIRS, leaders))
        sides = (few.select("key", *(F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "most"))) for side in "ab")
        fit = (F.col("node_a") > F.col("node_b")) & (F.col("n_a") <= F.col("most_b")) & (F.col("n_b") <= F.col("most_a"))
        pairs = next(sides).join(next(sides), "key").where(fit).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
        found.append(stored(compared(pairs, sets).where(_near(*NEAR)).select("a", "b"), "near-links"))
        full = stored(at.where(F.col("members") > max(PAIRS, leaders)), "near-full")
        if full.isEmpty():
            break
        links_found, judged, members = _led(full, sets, leaders)
        found.append(links_found)
        rounds.append(judged)
        leaders *= TIMES
    every = found[0]
    for each in found[1:]:
        every = every.unionByName(each)
    return every.unionByName(crossings(rounds, every, sets)) if rounds else every


def _led(full: DataFrame, sets: DataFrame, leaders: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round over the stored ``full`` keys: (near links to leaders, who is how far from them, members that stay).

    About ``leaders`` members of each key are drawn, the same nodes in all their keys.
    Only distances up to twice that of near copies matter; sizes and places bound them.
    """
    top, bottom = NEAR
    drawn = F.pmod(F.xxhash64("node", F.lit(leaders)), F.lit(1 << 30)) * F.col("members") < leaders * (1 << 30)
    heads = full.where(drawn).select("key", F.col("node").alias("leader"), F.col("n").alias("n_l"), F.col("pos").alias("pos_l"))
    shared = F.least("pos", "pos_l") + F.least(F.col("n") - F.col("pos"), F.col("n_l") - F.col("pos_l"))
    open_ones = shared * 2 * top >= (2 * top - bottom) * (F.col("n") + F.col("n_l"))
    led = stored(full.join(heads, "key").where((F.col("node") != F.col("leader")) & open_ones).select("key", "node", "n", "most", "leader"), "near-led")
    seen = compared(led.select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), sets)
    seen = stored(seen.where(_near(2 * top - bottom, bottom)).withColumn("near", _near(top, bottom)), "near-compared")
    judged = stored(led.join(seen.withColumnsRenamed({"a": "node", "b": "leader"}), ["node", "leader"]), "near-judged")
    gone = judged.where("near").select("key", "node").distinct()
    left = full.where(~drawn).select("key", "node", "n", "pos").join(gone, ["key", "node"], "left_anti")
    return seen.where("near").select("a", "b"), judged, _with_partners(left, "near-members")


def crossings(rounds: list[DataFrame], every: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the near copies of a leader and what is up to twice as far from it, if not linked yet."""
    top, bottom = NEAR
    roots = stored(components(every), "near-reached")
    out = None
    for judged in rounds:
        between = judged.where("not near")
        between = between.join(roots.toDF("node", "root"), "node", "left").join(roots.toDF("leader", "leader_root"), "leader", "left")
        open_ones = between.where(F.coalesce("root", "node") != F.coalesce("leader_root", "leader"))
        ratio = F.col("common") / F.col("either")
        far = open_ones.select("key", "leader", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("most").alias("most_a"), ratio.alias("far"))
        close = judged.where("near").select("key", "leader", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("most").alias("most_b"), ratio.alias("close"))
        # a pair within the distance can't differ by more than it in their distances from the leader
        fit = (F.col("close") - F.col("far") <= 1 - top / bottom + 1e-9) & (F.col("n_a") <= F.col("most_b")) & (F.col("n_b") <= F.col("most_a"))
        pairs = far.join(close, ["key", "leader"]).where(fit).select("a", "b").distinct()
        own = compared(pairs, sets).where(_near(top, bottom)).select("a", "b")
        out = own if out is None else out.unionByName(own)
    return stored(out, "near-crossings")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one of each group of near copies stays.

    A group is what near pairs connect; its row with the least doc_id stays, the first
    one of several; rows without a doc_id come last.  Null, empty and blank texts are
    one group of exact copies; a text of fewer than five words is near only to its
    copies.  Whole texts are compared, however long.  An empty table stays empty, and
    other columns may have any names.
    """
    # tables that grow with the documents are always merged, never broadcast
    numbered_docs, row = numbered(bounded_batches(docs), "near-rows")
    mark = marks(class_counts(docs), docs)
    signed = numbered_docs.select(F.col(row).alias("row"), "doc_id", mark(F.col("text")).alias("s"))
    marked, path = store(signed.select("row", "doc_id", "s.*"), "near-marked")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    head = F.min_by(F.struct("doc_id", "row"), order)
    heads = stored(marked.groupBy("digest").agg(head.alias("head")).select("head.doc_id", "head.row"), "near-distinct")

    # keys are a fifth of a set, so they and not the sets are joined with what is different
    nodes = heads.select(F.col("row").alias("node"))
    keys, keys_path = store(marked.select(F.col("row").alias("node"), "n", "keys").join(nodes.hint("merge"), "node", "left_semi"), "near-keys")
    # most keys are of one set; a count of the keys alone is all that is shuffled of those
    shared = stored(keys.select(F.explode("keys").alias("key")).groupBy("key").count().where("count > 1").select("key"), "near-common")
    collided = stored(keys.select("node", "n", F.posexplode("keys").alias("pos", "key")).join(shared.hint("merge"), "key"), "near-collided")
    forget(docs.sparkSession, keys_path)
    members = _with_partners(collided, "near-members")
    # only what may have a partner is ever compared
    wanted = stored(members.select("node").distinct(), "near-nodes")
    sets = stored(marked.select(F.col("row").alias("node"), "shingles").join(wanted.hint("merge"), "node", "left_semi"), "near-sets")
    forget(docs.sparkSession, path)
    roots = stored(components(links(members, sets)), "near-roots")
    released(docs.sparkSession)

    grouped = heads.join(roots.hint("merge"), heads["row"] == roots["node"], "left").select("doc_id", "row", F.coalesce("root", "row").alias("root"))
    kept = grouped.groupBy("root").agg(F.min_by("row", order).alias("kept_row")).select("kept_row")
    return numbered_docs.join(kept.hint("merge"), numbered_docs[row] == kept["kept_row"], "left_semi").drop(row)
