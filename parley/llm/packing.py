"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

Bulk-synchronous best fit over size classes.  Pieces of equal length and gaps of equal
size are interchangeable, so what a round of best fit has to know is how many there are
of each size: at most as many numbers as the capacity, whatever the input.  A round
takes the pieces of one length, longest first: a sweep over the sorted gaps gives them
to the smallest that hold them (the successors), conflicts are resolved by rank (the
k-th piece of a length goes to the k-th gap), the gaps are updated, and the next round
follows.  The rounds' counts are a plan of a few thousand rows, made on the driver;
what grows with the input, ranks and placements, is computed by Spark.  The result is
exactly that of best-fit decreasing.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, stored

CAPACITY = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"
#: A size class is dealt out to groups of about so many pieces, each ranked by one task.
GROUP_PIECES = 100_000
#: A worker remembers so many encoded words in each of three tables.
CACHED_WORDS = 300_000

#: The tokenizer file's own split pattern, with its white space written out.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r \x85\xa0\p{L}\p{N}]+"

#: UTF-8 bytes of ASCII text and of U+00C0 to U+023F.
_PLAIN = bytes([*range(9, 14), *range(32, 127), *range(0x80, 0xC0), *range(0xC3, 0xC9)])


class _Words(dict):
    """Ids of white-space separated, lower-case words as little-endian bytes.

    Memory is bounded: beyond CACHED_WORDS entries, what was met since becomes the
    older generation, from which a word that is met again comes back.
    """

    def __init__(self, tokenizer) -> None:
        import regex

        self._split = regex.compile(_SPLIT).findall
        self._tokens = tokenizer.model.tokenize
        self._older: dict[str, bytes] = {}
        self._parts: dict[str, bytes] = {}
        # byte-level alphabet: printable bytes stand for themselves, others follow from 256 on
        same = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in same]
        self._chars = {b: chr(b) for b in same} | {b: chr(256 + i) for i, b in enumerate(other)}

    def __missing__(self, word: str) -> bytes:
        ids = self._older.get(word)
        if ids is None:
            if word.isalpha():
                ids = self._part(word)
            elif word[:-1].isalpha() and word[-1] in ".,":
                ids = self._part(word[:-1]) + self._part(word[-1])
            else:
                ids = b"".join(map(self._part, self._split(word)))
        if len(self) >= CACHED_WORDS:
            self._older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def _part(self, part: str) -> bytes:
        ids = self._parts.get(part)
        if ids is None:
            if len(self._parts) >= CACHED_WORDS:
                self._parts.clear()
            chars = part if part.isascii() and part.isprintable() else "".join(self._chars[b] for b in part.encode())
            ids = self._parts[part] = struct.pack(f"<{len(found)}I", *found) if (found := [t.id for t in self._tokens(chars)]) else b""
        return ids


class Encoder:
    """Whole texts to ids, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    Texts of Latin letters (below U+0250) are encoded word by word with a memory of
    earlier words; there, neither normalisation nor the split pattern crosses white
    space.  Any other text, or one that may hold a special token, is encoded by the
    tokenizer as a whole.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.words = _Words(self.whole)
        self._odd = regex.compile(r"[^\x00-ɏ]|<\||[\x00\x1c-\x1f\x7f-\x9fİ]").search

    def __call__(self, text: str) -> bytes:
        # bytes of no other than plain characters spare the slower search
        if text.encode().translate(None, _PLAIN) and self._odd(text) or "<|" in text or "İ" in text:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.words.__getitem__, text.lower().split()))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pieces(
    docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True
) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32[, ids]) of all ``docs``.

    A document is its text's ids and then ``end_id``; a null text is empty.  Only
    documents longer than ``capacity`` are cut.  Every row of ``docs`` counts, so
    repeated rows give repeated pieces.
    """
    path = path or tokenizer_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            rows, start, length, crc, ids = [], [], [], [], []
            for row, text in enumerate(batch.column("text")):
                encoded = encoder(text.as_py() or "") + end
                for at in range(0, len(encoded), step):
                    part = encoded[at : at + step]
                    rows.append(row)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        ids.append(np.frombuffer(part, "<u4").astype("i4"))
            start = np.array(start, "i8")
            out = {
                "doc_id": batch.column("doc_id").take(pa.array(rows, pa.int64())),
                "piece": pa.array((start // capacity).astype("i4")),
                "start": pa.array(start),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
            }
            if keep_ids:
                out["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)
        del encoder
        give_back()

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return bounded_batches(docs).select("doc_id", "text").mapInArrow(encode, schema)


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rounds of best fit over size classes: (length, first rank, pieces, first sequence, offset).

    The pieces of that length with ranks from ``first rank`` on go, one each, to the
    sequences from ``first sequence`` on.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: runs (first sequence, how many)
    opened, plan = 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens doesn't fit in {capacity}")

        def place(first: int, bins: int, gap: int, each: int) -> None:
            """Put ``each`` pieces into every one of ``bins`` sequences."""
            nonlocal rank, left
            for k in range(each):
                plan.append((length, rank, bins, first, capacity - gap + k * length))
                rank, left = rank + bins, left - bins
            if gap > each * length:
                gaps[gap - each * length].append((first, bins))

        for gap in sorted(g for g, runs in gaps.items() if g >= length and runs):
            runs, each = gaps.pop(gap), gap // length
            while runs and left:
                first, bins = runs.pop()
                full = min(bins, left // each)
                if full:
                    place(first, full, gap, each)
                rest, used = left, full
                if used < bins and left:  # fewer than a sequence can hold
                    place(first + used, 1, gap, rest)
                    used += 1
                if used < bins:
                    runs.append((first + used, bins - used))
            gaps[gap] += runs
            if not left:
                break
        each = capacity // length
        if full := left // each:
            place(opened, full, capacity, each)
            opened += full
        if left:
            place(opened, 1, capacity, left)
            opened += 1
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``, gapless from 0 in each sequence.

    ``pieces`` must be a stored table: it is read three times.  Full pieces are sequences
    of their own and need no rank, so they are not shuffled; a size class of the others
    is dealt to as many groups as its count needs, so that no task ranks more than about
    GROUP_PIECES however many pieces have one length.
    """
    spark = pieces.sparkSession
    # at most capacity rows, whatever the input
    sums = {r["length"]: r["n"] for r in pieces.where(F.col("length") != capacity).groupBy("length").agg(F.count("*").alias("n")).collect()}
    groups = spark.createDataFrame([(length, -(-n // GROUP_PIECES)) for length, n in sums.items()], "length long, groups long")
    salted = pieces.where(F.col("length") != capacity).join(F.broadcast(groups), "length")
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), "groups").cast("int")).drop("groups")
    # a row for each length and GROUP_PIECES pieces of it
    classes = stored(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "pack-classes")
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = classes.select("length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy(*(c for c in ("doc_id", "piece", "ids_crc32") if c in pieces.columns))
    ranked = (
        salted.withColumn("nth", F.row_number().over(own))
        .join(before, ["length", "salt"])
        .withColumn("rank", F.col("before") + F.col("nth") - 1)
    )
    # a few rows for each pair of a length and a gap: bounded by the capacity
    plan = spark.createDataFrame(
        best_fit_plan(sums, capacity), "length long, first_rank long, pieces long, first_sequence long, offset long"
    )
    here = (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("pieces"))
    placed = (
        ranked.join(F.broadcast(plan.withColumnRenamed("length", "of")), (F.col("length") == F.col("of")) & here)
        .withColumn("sequence_id", F.col("first_sequence") + F.col("rank") - F.col("first_rank"))
        .select(*pieces.columns, "sequence_id", "offset")
    )
    # negative numbers, so that they are none of the plan's
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id())
    return placed.unionByName(full.withColumn("offset", F.lit(0).cast("long")))


def pack_documents(
    docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False
) -> DataFrame:
    """Tokenize ``docs`` and pack the pieces; with ``keep_ids`` each row has its ids.

    Null texts and texts without tokens are documents of the end id alone; texts of any
    length are cut into whole pieces and a last one.  Repeated rows are packed once each,
    and rows without a doc_id like others.  An empty table gives no rows; columns other
    than doc_id and text, whatever their names, are not looked at.
    """
    return pack(stored(token_pieces(docs, path, capacity, end_id, keep_ids), "pack-pieces"), capacity)
