"""Near copies by SimHash: covering hashing finds what its fingerprints can tell, an exact form finds the rest.

The document form of operator 6, by its own steps: SimHash fingerprints (here of the set
of five-word shingles), the seven tables of its covering hashing, in which every pair
within two bits collides, and a check of what collides, here by the sets themselves.

Sets of a Jaccard similarity of 0.8 differ in about 10 and up to 20 of 64 bits, which no
few tables cover, so what the tables can't tell is completed without a loss.  Two near
sets share one of their rarest shingles (:mod:`.near_copies`); who shares one is a group.
In a group only texts that nothing links yet are compared, first by parities: a set's
shingles are dealt to K classes, bit i is 1 if class i has an odd number of them, and two
sets differ in no fewer shingles than their bits do.  Near sets differ in at most a ninth
of their total, so what differs in more bits isn't near, for sure.  What is left is
proposed as a forest, a few links for a group's texts however large it is, and checked by
the sets.  A proposal that the sets refuse isn't made again; rounds go on, with more
proposals for two classes each time, until no group has one.  So copies are never
expanded into all pairs, and no link between classes is lost.

A group of more than BLOCK texts is dealt to blocks.  These are first looked at one by
one; then those that may still hold links between classes by twos, in which the key's
largest class isn't compared with itself.  No task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import near_copies, simhash
from .common import bounded_batches, forget, give_back, numbered, released, store, stored
from .components import components
from .near_copies import CLASSES, NEAR, shingles

#: Texts of a key that are compared at once, and how many times as many proposals for two classes each round has.
BLOCK, TIMES = 1_000, 64
#: Least and most parities of a set; it has at least one for each shingle, up to the most.
LEAST_BITS, MOST_BITS = 256, 1 << 16

_MARKS = T.StructType(
    [
        T.StructField("digest", T.BinaryType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("fp", T.LongType()),
        T.StructField("bits", T.BinaryType()),
        T.StructField("keys", T.ArrayType(T.LongType())),
        T.StructField("shingles", T.ArrayType(T.IntegerType())),
    ]
)


def parities(own: np.ndarray) -> bytes:
    """A power of two of bits: of each class of the different hashes ``own``, whether it has an odd number of them."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << max(0, len(own) - 1).bit_length()))
    odd = np.bincount(((own >> np.uint64(20)) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def marks(loads: np.ndarray, docs: DataFrame):
    """A UDF of texts: the set's digest, size, SimHash fingerprint, parities, rarest shingles in order, and 32 bits of each shingle."""
    sent = docs.sparkSession.sparkContext.broadcast(loads)  # CLASSES numbers
    top, bottom = NEAR

    @F.arrow_udf(_MARKS)
    def marked(text: pa.Array) -> pa.Array:
        rows = []
        for t in text:
            own = shingles(t.as_py() or "")
            n = len(own)
            first = np.lexsort((own, sent.value[(own & np.uint64(CLASSES - 1)).astype(np.int64)]))[: n - -(-n * top // bottom) + 1]
            sets = (own >> np.uint64(32)).astype(np.uint32).view(np.int32)
            rows.append((xxhash.xxh3_128_digest(own.tobytes()), n, simhash.majority(own), parities(own), own[first].view(np.int64), sets))
        columns = zip(*rows) if rows else [()] * 6
        kinds = (pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
        return pa.StructArray.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds)], [f.name for f in _MARKS])

    return marked


def covered(signs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that operator 6's covering hashing finds and the sets confirm.

    ``signs`` (node, fp) must be a stored table.  Of equal fingerprints each is compared
    with the first, of those within two bits the first ones.
    """
    first = stored(signs.groupBy("fp").agg(F.min("node").alias("first")), "near-prints")
    equal = signs.join(first.hint("merge"), "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    apart = simhash.links(first.select("fp")).join(first.toDF("a", "first_a").hint("merge"), "a").join(first.toDF("b", "first_b").hint("merge"), "b")
    pairs = stored(equal.unionByName(apart.select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))), "near-collisions")
    found = stored(checked(pairs, sets).where("near").select("a", "b"), "near-covered")
    released(signs.sparkSession)
    return found


def checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``near``: whether the sets of both are."""
    top, bottom = NEAR
    return near_copies.compared(pairs, sets).select("a", "b", (F.col("common") * bottom >= F.col("either") * top).alias("near"))


def _folded(bits: np.ndarray) -> np.ndarray:
    """Rows of words as rows of half as many parities."""
    half = bits.shape[1] // 2
    return bits[:, :half] ^ bits[:, half:]


def proposals(node: np.ndarray, root: np.ndarray, n: np.ndarray, bits: list[bytes], refused: list[set[int]], tries: int) -> list[tuple[int, int]]:
    """Pairs of different classes (roots) in a group that may be near and weren't refused; ``refused`` has for each row lesser nodes.

    The first try gives a forest of classes; later ones give up to ``tries`` for two
    classes.  A group without proposals has no near pair of different classes.
    """
    top, bottom = NEAR
    words = np.array([len(b) // 8 for b in bits])
    own = {w: np.flatnonzero(words == w) for w in np.unique(words).tolist()}
    rows = {w: np.frombuffer(b"".join(bits[i] for i in at), "<u8").reshape(-1, w) for w, at in own.items()}
    out: list[tuple[int, int]] = []
    label = np.unique(root, return_inverse=True)[1]
    used: dict[tuple[int, int], int] = {}
    for w, at in own.items():
        # sizes of near sets differ by a quarter at most, so their parities are as many, or twice as many
        others, against = at, rows[w]
        if 2 * w in own:
            others, against = np.concatenate([at, own[2 * w]]), np.concatenate([against, _folded(rows[2 * w])])
        for k, i in enumerate(at.tolist()):
            rest = others[k + 1 :]
            open_ones = np.flatnonzero((label[rest] != label[i]) & (n[rest] * bottom >= n[i] * top) & (n[i] * bottom >= n[rest] * top))
            if not len(open_ones):
                continue
            apart = np.bitwise_count(against[k + 1 + open_ones] ^ rows[w][k]).sum(axis=1, dtype=np.int64)
            total = n[i] + n[rest[open_ones]]
            # common >= 4/5 of either: (total - apart) * 5 >= (total + apart) * 4
            may = np.flatnonzero((total - apart) * bottom >= (total + apart) * top)
            may = may[np.argsort(apart[may] / total[may], kind="stable")]
            js = rest[open_ones[may]]
            for j in js.tolist():
                if label[i] == label[j]:
                    continue
                a, b = (i, j) if node[i] > node[j] else (j, i)
                if node[b] in refused[a]:
                    continue
                if tries == 1:
                    label[label == label[j]] = label[i]
                else:
                    two = (min(int(label[i]), int(label[j])), max(int(label[i]), int(label[j])))
                    if used.get(two, 0) >= tries:
                        continue
                    used[two] = used.get(two, 0) + 1
                out.append((int(node[a]), int(node[b])))
    return out


def _proposed(dealt: DataFrame, tries: int) -> DataFrame:
    """(team, a, b) for the proposals of all groups of ``dealt`` (team, node, root, n, bits, refused); team names a group."""

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def ended(at: pa.Table) -> Iterator[pa.RecordBatch]:
            teams = at.column("team").to_numpy()
            node, root, n = (at.column(c).to_numpy() for c in ("node", "root", "n"))
            bits, refused = at.column("bits").to_pylist(), [set(x or ()) for x in at.column("refused").to_pylist()]
            edges = [0, *(np.flatnonzero(teams[1:] != teams[:-1]) + 1).tolist(), len(teams)]
            found: list[tuple[str, int, int]] = []
            for a, b in zip(edges, edges[1:]):
                if b - a > 1 and (root[a:b] != root[a]).any():
                    found += [(teams[a], *pair) for pair in proposals(node[a:b], root[a:b], n[a:b].astype(np.int64), bits[a:b], refused[a:b], tries)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int64(), pa.int64()))], names=["team", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(batch)
            last = batch.column(0)[batch.num_rows - 1].as_py()
            if kept[0].column(0)[0].as_py() == last:
                continue  # they are sorted, so this is one group, which may go on
            rows = pa.Table.from_batches(kept)
            teams = rows.column("team").to_numpy()
            start = int(np.flatnonzero(teams != last)[-1]) + 1
            yield from ended(rows.slice(0, start))
            kept = rows.slice(start).to_batches()
        if kept:
            yield from ended(pa.Table.from_batches(kept))
        give_back()

    rows = dealt.select("team", "node", "root", F.col("n").cast("long").alias("n"), "bits", "refused").repartition("team").sortWithinPartitions("team")
    return rows.mapInArrow(propose, "team string, a long, b long")


def _first_teams(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (team, node) to look at first, equal ones once, and the members (key, node, count) of keys that have more than a block."""
    counts = members.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    counted = members.select("key", "node").join(counts.hint("merge"), "key")
    block = F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / BLOCK))
    same = counted.groupBy("key", block.alias("block")).agg(F.sort_array(F.collect_list("node")).alias("nodes")).where(F.size("nodes") > 1)
    # copies share many keys, and most groups are those of other keys again
    teams = stored(same.select("nodes").distinct().select(F.monotonically_increasing_id().cast("string").alias("team"), "nodes"), "near-teams")
    return teams.select("team", F.explode("nodes").alias("node")), counted.where(F.col("members") > BLOCK)


def _second_teams(large: DataFrame, roots: DataFrame) -> DataFrame:
    """Groups (team, node) of two blocks each for keys of more than a block, whose largest class isn't compared with itself."""
    own = large.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    sizes = own.groupBy("key", "root").agg(F.count("*").alias("size"))
    tops = sizes.groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("top"), F.max("size").alias("in_top"), F.sum("size").alias("all")).where("in_top < all")
    dealt = own.join(tops.hint("merge"), "key")
    blocks = {True: F.ceil(F.col("in_top") / BLOCK), False: F.ceil((F.col("all") - F.col("in_top")) / BLOCK)}
    is_top = F.col("root") == F.col("top")
    at = F.pmod(F.xxhash64("node"), F.when(is_top, blocks[True]).otherwise(blocks[False]))
    upto = {top: F.sequence(F.lit(0).cast("long"), n - 1) for top, n in blocks.items()}
    name = lambda kind, i, j: F.concat_ws("_", F.col("key").cast("string"), F.lit(kind), i.cast("string"), j.cast("string"))
    block = F.col("block")
    with_top = F.when(F.col("is_top"), F.transform(upto[False], lambda i: name("t", i, block))).otherwise(F.transform(upto[True], lambda j: name("t", block, j)))
    with_rest = F.when(F.col("is_top"), F.array().cast("array<string>")).otherwise(F.transform(upto[False], lambda j: name("r", F.least(block, j), F.greatest(block, j))))
    named = dealt.withColumns({"block": at, "is_top": is_top}).select("node", F.concat(with_top, with_rest).alias("teams"))
    return named.select(F.explode("teams").alias("team"), "node")


def links(members: DataFrame, signs: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, root) of all texts that near pairs connect.

    ``members`` (key, node, ...), ``signs`` (node, n, fp, bits) and ``sets`` (node,
    shingles) must be stored tables.
    """
    spark = members.sparkSession
    roots = stored(components(covered(signs.select("node", "fp"), sets)), "near-roots")
    teams, large = _first_teams(members)
    second, refused, tries = False, None, 1
    while True:
        dealt = teams.join(signs.select("node", "n", "bits").hint("merge"), "node").join(roots.hint("merge"), "node", "left")
        if refused is None:
            dealt = dealt.withColumn("refused", F.array().cast("array<long>"))
        else:
            dealt = dealt.join(refused.groupBy(F.col("a").alias("node")).agg(F.collect_set("b").alias("refused")).hint("merge"), "node", "left")
        proposed = stored(_proposed(dealt.withColumn("root", F.coalesce("root", "node")), tries), "near-proposed")
        seen = stored(checked(proposed.select("a", "b").distinct(), sets), "near-checked")
        no = seen.where("not near").select("a", "b")
        refused = no if refused is None else refused.unionByName(no)
        if not seen.where("near").isEmpty():
            # what was linked before is stars by now, so only these and the new links are contracted
            every = roots.toDF("a", "b").unionByName(seen.where("near").select("a", "b"))
            roots = stored(components(every), "near-roots")
        released(spark)
        if proposed.isEmpty() or seen.where("not near").isEmpty():
            # what was proposed is linked, and a forest of it links all else
            if second:
                return roots
            teams, second, tries = stored(_second_teams(large, roots), "near-teams"), True, 1
            if teams.isEmpty():
                return roots
        else:
            # only what had proposals may have others
            teams = stored(teams.join(proposed.select("team").distinct().hint("merge"), "team", "left_semi"), "near-teams")
            tries *= TIMES


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one of each group of near copies stays.

    A group is what pairs of a Jaccard similarity of 0.8 or more connect; its row with the
    least doc_id stays, the first one of several; rows without a doc_id come last.  Null,
    empty and blank texts are one group of exact copies; a text of fewer than five words
    is near only to its copies.  Whole texts are compared, however long.  An empty table
    stays empty, and other columns may have any names.
    """
    spark = docs.sparkSession
    # tables that grow with the documents are always merged, never broadcast
    numbered_docs, row = numbered(bounded_batches(docs), "near-rows")
    mark = marks(near_copies.class_counts(docs), docs)
    signed = numbered_docs.select(F.col(row).alias("node"), "doc_id", mark(F.col("text")).alias("s"))
    marked, path = store(signed.select("node", "doc_id", "s.*"), "near-marked")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("node"))
    heads = stored(marked.groupBy("digest").agg(F.min_by(F.struct("doc_id", "node"), order).alias("head")).select("head.doc_id", "head.node"), "near-distinct")

    # keys are a fifth of a set, so they and not the sets are joined with what is different
    nodes = heads.select("node")
    keys, keys_path = store(marked.select("node", "n", "keys").join(nodes.hint("merge"), "node", "left_semi"), "near-keys")
    # most keys are of one set; a count of the keys alone is all that is shuffled of those
    shared = stored(keys.select(F.explode("keys").alias("key")).groupBy("key").count().where("count > 1").select("key"), "near-common")
    collided = stored(keys.select("node", "n", F.posexplode("keys").alias("pos", "key")).join(shared.hint("merge"), "key"), "near-collided")
    forget(spark, keys_path)
    members = near_copies._with_partners(collided, "near-members")
    # only what may have a partner is ever compared
    wanted = stored(members.select("node").distinct(), "near-nodes")
    found = stored(marked.select("node", "n", "fp", "bits", "shingles").join(wanted.hint("merge"), "node", "left_semi"), "near-sets")
    forget(spark, path)
    released(spark)
    roots = links(members, found.select("node", "n", "fp", "bits"), found.select("node", "shingles"))

    grouped = heads.join(roots.hint("merge"), "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))
    kept = grouped.groupBy("root").agg(F.min_by("node", order).alias("kept_row")).select("kept_row")
    return numbered_docs.join(kept.hint("merge"), numbered_docs[row] == kept["kept_row"], "left_semi").drop(row)
