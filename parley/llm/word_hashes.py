"""64-bit hashes of words and of runs of words, an Arrow column of texts at a time.

Words are what ``[^\\x20\\x09-\\x0D]+`` matches.  A word's hash is a polynomial of its bytes,
a run's one of its words' hashes, both modulo 2**64 and mixed; all words of a column are
hashed in a few passes over arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once, and words.
BYTES, WORDS = 1 << 22, 1 << 18
_U = np.uint64
#: Odd, so they have inverses modulo 2**64.
_BYTE, _WORD = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64 bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1) at least."""
    if len(_powers.get(str(base), ())) < n:
        steps = np.full(max(n, BYTES + 1), base, np.uint64)
        steps[0] = 1
        _powers[str(base)] = np.cumprod(steps)
    return _powers[str(base)]


def bounded(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about BYTES bytes of ``text``, a row at least."""
    sizes = np.asarray(pc.binary_length(batch[text]).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    lo, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if held and held + size > BYTES:
            yield batch.slice(lo, k - lo)
            lo, held = k, 0
        held += size
    if len(sizes) > lo:
        yield batch.slice(lo)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of its text) of every word of ``texts`` in order; a null has none."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    every = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    space = (every == 32) | ((every >= 9) & (every <= 13))
    cut = space.copy()  # a word may not go on here
    first = np.zeros(len(every) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(~space & (first[:-1] | np.concatenate(([True], cut[:-1]))))
    ends = np.flatnonzero(~space & (first[1:] | np.concatenate((cut[1:], [True])))) + 1
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # as many words as BYTES hold, one at least
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BYTES, "right")))
        lo, hi = starts[at], ends[to - 1]
        power, inverse = _power(_BYTE, hi - lo + 1), _power(pow(_BYTE, -1, 1 << 64), hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((every[lo:hi].astype(np.uint64) + _U(1)) * power[: hi - lo], out=sums[1:])
        own, size = starts[at:to] - lo, ends[at:to] - starts[at:to]
        hashes[at:to] = mixed((sums[own + size] - sums[own]) * inverse[own] + size.astype(np.uint64) * _U(_WORD))
        at = to
    return hashes, (np.searchsorted(offsets, starts, "right") - 1).astype(np.int32)


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """The hash of every run of ``length`` words, whatever the texts' bounds."""
    n = max(0, len(hashes) - length + 1)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = out * _U(_WORD) + hashes[k : k + n]
    return mixed(out)
