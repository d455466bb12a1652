"""The trie of conversation prefixes, built as a Patricia trie.

A conversation's turns are numbered, and the prefix that ends at a turn is known by two
64-bit sums (exclusive or) of hashes of its turns with their places.  Paths are cut into blocks of BLOCK
turns, so a row never holds more of a conversation, however long it is; a block begins
at the point where the one before it ended.  Equal blocks are counted before they meet.

The different blocks are sorted by where they begin and their prefixes.  In that order
all that pass a node are neighbours, so one pass over each sorted range with a stack as
deep as a block finds the points: branches, ends and leaves, and the edges between them.
What two ranges share lies on the last path of one and the first of the next, so all
nodes of these paths are made points, and points of several ranges are added up.

What a point sums over its subtree is summed over the sorted blocks from its first to
its last: each node belongs to its least member, so totals of members say what lies
below.  Nodes between points get what their point has, plus the suffix sum of their edge.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stored
from .ranged import ranged, running

#: Turns in a block; conversations that share their first turns; ids joined at once.
BLOCK, FAMILY, CHUNK = 64, 20, 1024
#: Of a conversation's turns fewer than so many are its family's.
HEADS = 4


def _key(seed: int) -> Column:
    """64 bits of a turn at its place in a rebuilt conversation."""
    return F.xxhash64(F.lit(seed), F.col("at"), F.col("turn_id"))


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, k, turn_id, words): the original turns, numbered from 1, with ``part`` and ``spot``."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    own = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        # md5 of both, with the first one's length, for no two turns may read alike
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("turn_id"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    placed = ranged(own, ["conv_id"], ["turn", "turn_id"], "trie-turns")
    return stored(running(placed, ["conv_id"], {"k": ("sum", F.lit(1).cast("long"))}), "trie-numbered")


def _rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stored table (conv_id, at, turn_id, words, x, y) of the rebuilt conversations' turns and prefixes, stored table of all conv_ids)."""
    least = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    first = F.filter(F.sort_array(F.collect_list(F.when(F.col("k") < HEADS, F.struct("k", "turn_id", "words")))), lambda t: t.isNotNull())
    own = turns.groupBy("conv_id").agg(first.alias("first"))
    all_ids = stored(own.select("conv_id", "first", least.cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("head")), "trie-convs")
    heads = all_ids.select(F.col("conv_id").alias("head"), F.col("first").alias("given"))
    given = F.coalesce(F.slice("given", F.lit(1), F.col("h")), F.array())
    convs = stored(all_ids.join(heads, "head", "left").select("conv_id", "h", given.alias("given")), "trie-heads")
    shared = convs.select("conv_id", F.posexplode("given").alias("p", "t")).select("conv_id", (F.col("p") + 1).cast("long").alias("at"), "t.turn_id", "t.words")
    later = turns.join(convs.select("conv_id", "h", F.size("given").alias("n")), "conv_id").where("k > h")
    kept = later.select("conv_id", (F.col("k") - F.col("h") + F.col("n")).alias("at"), "turn_id", "words")
    placed = ranged(shared.unionByName(kept), ["conv_id"], ["at"], "trie-rebuilt")
    prefixes = running(placed, ["conv_id"], {"x": ("xor", _key(1)), "y": ("xor", _key(2))})
    return stored(prefixes.select("conv_id", "at", "turn_id", "words", "x", "y"), "trie-prefixes"), convs.select("conv_id")


def _blocks(prefixes: DataFrame) -> DataFrame:
    """A stored table of each conversation's blocks: conv_id, base (turns before), x0, y0 (where it begins), path (x, y, words), x, y, ends."""
    nodes = F.sort_array(F.collect_list(F.struct("at", "x", "y", "words", _key(1).alias("a"), _key(2).alias("b"))))
    cut = prefixes.groupBy("conv_id", F.floor((F.col("at") - 1) / BLOCK).alias("block")).agg(nodes.alias("nodes"))
    begin, end = F.col("nodes")[0], F.element_at("nodes", -1)
    return stored(
        cut.select(
            "conv_id",
            (F.col("block") * BLOCK).alias("base"),
            begin["x"].bitwiseXOR(begin["a"]).alias("x0"),
            begin["y"].bitwiseXOR(begin["b"]).alias("y0"),
            F.transform("nodes", lambda t: F.struct(t["x"].alias("x"), t["y"].alias("y"), t["words"].alias("words"))).alias("path"),
            end["x"].alias("x"),
            end["y"].alias("y"),
        ),
        "trie-blocks",
    )


_POINT = "x long, y long, depth long, px long, py long, part int, first long, last long, n long, conv_id long, is_block boolean, edge array<long>"


class _Range:
    """The points of one sorted range of blocks; what is still open is the last block's path."""

    def __init__(self, part: int) -> None:
        self.part, self.row, self.start, self.found = part, -1, None, []
        #: By depth: [x, y, words, whether it's a point, conversations, the least one, first block, whether a block ends here].
        self.path: list[list] = []

    def add(self, start: tuple[int, int, int], nodes: list[tuple[int, int, int]], n: int, conv_id: int) -> None:
        """The next block in order: where it begins (x, y, turns before), its nodes, how many conversations have it, and the least one."""
        shared = 0
        if start == self.start:
            while shared < len(self.path) and shared < len(nodes) and self.path[shared][:2] == list(nodes[shared][:2]):
                shared += 1
        if self.start is not None:
            self._close(shared)
        self.row += 1
        self.start = start
        every = self.row == 0  # the range before may share any node of the first path
        for x, y, words in nodes[shared:]:
            self.path.append([x, y, words, every, 0, None, self.row, False])
        end = self.path[-1]
        end[3], end[4], end[5], end[7] = True, n, conv_id, True

    def end(self) -> None:
        """No block comes any more; the range after may share any node of the last path."""
        for node in self.path:
            node[3] = True
        if self.path:
            self._close(0)

    def _close(self, shared: int) -> None:
        """The nodes below depth ``shared`` have all their blocks; the node there is a point."""
        path, (x0, y0, base) = self.path, self.start
        if shared:
            path[shared - 1][3] = True
        for depth in range(len(path), max(shared, 1), -1):
            node, above = path[depth - 1], path[depth - 2]
            above[4] += node[4]
            above[5] = node[5] if above[5] is None else min(above[5], node[5])
        last = shared
        for depth in range(shared + 1, len(path) + 1):
            x, y, _, is_point, n, conv_id, first, is_block = path[depth - 1]
            if is_point:
                px, py = path[last - 1][:2] if last else (x0, y0)
                edge = [node[2] for node in path[last:depth]]
                self.found.append((x, y, base + depth, px, py, self.part, first, self.row, n, conv_id, is_block, edge))
                last = depth
        del path[shared:]


def _find_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = _Range(TaskContext.get().partitionId())
    kinds = [*[pa.int64()] * 5, pa.int32(), *[pa.int64()] * 4, pa.bool_(), pa.list_(pa.int64())]
    names = [c.split()[0] for c in _POINT.split(", ")]

    def given() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*own.found), kinds)], names=names)
        own.found = []
        return out

    for batch in batches:
        nodes = batch["path"].flatten()
        x, y, words = (nodes.field(c).to_pylist() for c in ("x", "y", "words"))
        at = 0
        for x0, y0, base, size, n, conv_id in zip(*(batch[c].to_pylist() for c in ("x0", "y0", "base", "size", "n", "conv_id"))):
            own.add((x0, y0, base), list(zip(x[at : at + size], y[at : at + size], words[at : at + size])), n, conv_id)
            at += size
        if own.found:
            yield given()
    own.end()
    if own.found:
        yield given()


def _points(blocks: DataFrame) -> DataFrame:
    """A stored table of the points of each sorted range, which _POINT describes; numbers are those of the range alone."""
    distinct = blocks.groupBy("base", "x0", "y0", "x", "y").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.first("path").alias("path"))
    different = stored(distinct.withColumn("size", F.size("path")), "trie-different")
    order = ["x0", "y0", "path"]
    return stored(bounded_batches(different).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_find_points, _POINT), "trie-points")


def _ends(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """(x, y, ends_sha256): digests of the ids of the conversations that end at a node, in order.

    Ids are joined CHUNK values at a time; a digest is taken chunk by chunk, so a task holds
    one chunk, however many conversations are alike.
    """
    last = prefixes.groupBy("conv_id").agg(F.max_by(F.struct("x", "y"), "at").alias("end"))
    zero = F.lit(0).cast("long")
    ended = convs.join(last, "conv_id", "left").select("conv_id", F.coalesce("end.x", zero).alias("x"), F.coalesce("end.y", zero).alias("y"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunks = ended.groupBy("x", "y", F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(ids.alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, None
        for batch in batches:
            out = []
            for x, y, own in zip(*(batch[c].to_pylist() for c in ("x", "y", "ids"))):
                if (x, y) == at:
                    sha.update(b",")
                elif at is not None:
                    out.append((*at, sha.hexdigest()))
                if (x, y) != at:
                    at, sha = (x, y), hashlib.sha256()
                sha.update(own.encode())
            yield _digests(out)
        yield _digests([(*at, sha.hexdigest())] if at is not None else [])

    return chunks.repartition("x", "y").sortWithinPartitions("x", "y", "chunk").mapInArrow(digest, "x long, y long, ends_sha256 string")


def _digests(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.string()))], names=["x", "y", "ends_sha256"])


def _below(found: DataFrame, blocks: DataFrame, totals: DataFrame) -> DataFrame:
    """(x, y, saved, leaves): the sums over all conversations that pass each point of what ``totals`` (conv_id, saved, leaves) has for them."""
    own = blocks.select("conv_id", "x", "y").join(totals, "conv_id", "left").groupBy("x", "y").agg(*(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("saved", "leaves")))
    rows = found.where("is_block").select("part", F.col("first").alias("row"), "x", "y").join(own, ["x", "y"])
    # numbered rows of a range are bounded by it
    up_to = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = stored(rows.select("part", "row", *(F.sum(c).over(up_to).alias(f"{c}_to") for c in ("saved", "leaves")), "saved", "leaves"), "trie-sums")
    lasts = sums.select("part", F.col("row").alias("last"), F.col("saved_to").alias("s1"), F.col("leaves_to").alias("l1"))
    firsts = sums.select("part", F.col("row").alias("first"), (F.col("saved_to") - F.col("saved")).alias("s0"), (F.col("leaves_to") - F.col("leaves")).alias("l0"))
    spans = found.select("x", "y", "part", "first", "last").join(firsts, ["part", "first"]).join(lasts, ["part", "last"])
    return spans.groupBy("x", "y").agg(F.sum(F.col("s1") - F.col("s0")).alias("saved"), F.sum(F.col("l1") - F.col("l0")).alias("leaves"))


def nodes(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of the rebuilt ``conversations``.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.  A conversation's turns are ordered by turn, null first;
    of equal ones (repeated rows too, which all count) the one with the lesser md5 of its
    length of role, role and text comes first.  A null role or text is an empty one.
    Rows without a conv_id are left out; without any conversation there is no node, the
    root neither.  Whole texts count, however long, and other columns may have any names.
    """
    prefixes, convs = _rebuilt(_turns(conversations))
    blocks = _blocks(prefixes)
    found = _points(blocks)
    root = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")).where("n > 0")
    zero = F.lit(0).cast("long")
    tops = root.select(zero.alias("x"), zero.alias("y"), zero.alias("depth"), *(F.lit(None).cast("long").alias(c) for c in ("px", "py")), "n", "conv_id", F.array(zero).alias("edge"))
    first = (F.first(c).alias(c) for c in ("depth", "px", "py"))
    points = found.groupBy("x", "y").agg(*first, F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.first("edge").alias("edge"))
    points = stored(points.select(tops.columns).unionByName(tops), "trie-merged")

    children = stored(points.where("px is not null").groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("n_children")), "trie-children")
    saves = F.expr("(n - 1) * aggregate(edge, 0L, (a, b) -> a + b)")
    known = points.join(children, ["x", "y"], "left").withColumns({"n_children": F.coalesce("n_children", zero), "saves": saves})
    placed = ranged(known, ["conv_id"], ["depth"], "trie-owned")
    totals = stored(placed.groupBy("conv_id").agg(F.sum("saves").alias("saved"), F.sum(F.expr("cast(n_children = 0 as long)")).alias("leaves")), "trie-totals")
    whole = totals.agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")).select(zero.alias("x"), zero.alias("y"), "saved", "leaves")
    below = _below(found, blocks, totals).unionByName(whole)

    owned = running(placed, ["conv_id"], {"so_far": ("sum", F.col("saves"))}).drop("part", "spot")
    above = points.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent"))
    full = stored(owned.join(below, ["x", "y"], "left").join(_ends(prefixes, convs), ["x", "y"], "left"), "trie-full")
    full = full.join(above, ["px", "py"], "left")
    return _expanded(full)


def _expanded(full: DataFrame) -> DataFrame:
    """The nodes of every edge, from its point: what the point has, and the suffix sum of the edge."""
    size = F.size("edge")
    # the point's own total: all members' less what its least member saves above it
    saved = F.col("saved") - F.col("so_far") + (F.col("n") - 1) * F.element_at("edge", -1)
    rows = full.select("*", saved.alias("own"), F.posexplode(F.sequence(F.lit(1), size)).alias("p", "t"))
    rest = F.expr("aggregate(slice(edge, t, size(edge) - t), 0L, (a, b) -> a + b)")
    is_point = F.col("t") == size
    return rows.select(
        "conv_id",
        (F.col("depth") - size + F.col("t")).cast("long").alias("depth"),
        F.when(F.col("t") > 1, F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(is_point, F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("own") + (F.col("n") - 1) * rest).alias("saved_tokens"),
        F.coalesce(F.when(is_point, F.col("ends_sha256")), F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
