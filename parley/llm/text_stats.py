"""Counts over whole texts that quality rules and classifiers build on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the base statistics: word characters are all but these.
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 3

#: name: what it counts
COUNTS = {
    "n_words": "maximal runs of characters other than white space",
    "word_chars": "code points in words",
    "n_symbols": "characters of SYMBOLS",
    "n_dup_lines": "lines with a word that are equal to an earlier line",
    "n_repeat_words": "words in three-word windows that the text has twice or more",
    "n_lines": "lines with a word",
    "n_distinct": "different words",
    "n_upper": "ASCII capitals",
    "n_letters": "ASCII letters",
    "n_digits": "ASCII digits",
    "n_marks": "characters of !?",
    "n_stops": "characters of .,;:",
    "n_wide": "code points beyond ASCII",
}

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_HIGH = bytes(range(128, 256))


def repeat_words(words: list[bytes]) -> int:
    """How many words are in a window of three that occurs twice or more."""
    n = len(words)
    if n <= WINDOW:
        return 0
    first = np.fromiter(map({}.setdefault, words, range(n)), np.int64, n)
    key = first[:-2]
    for part in (first[1:-1], first[2:]):
        if n > 2_000_000:  # else the product stays below 2**63
            key = np.unique(key, return_inverse=True)[1]
        key = key * n + part
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not twice.size:
        return 0
    again = np.isin(key, twice)
    covered = np.zeros(n, bool)
    for k in range(WINDOW):
        covered[k : n - WINDOW + 1 + k] |= again
    return int(covered.sum())


def measure(text: str) -> tuple[int, ...]:
    """The COUNTS of one text."""
    raw = text.encode()
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    inner = raw.translate(None, SPACES)
    size = len(raw)

    def count(chars: bytes) -> int:
        return len(inner) - len(inner.translate(None, chars))

    return (
        len(words),
        len(text) - (size - len(inner)),
        count(SYMBOLS),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        len(set(words)),
        count(_UPPER),
        count(_LETTERS),
        count(_DIGITS),
        count(b"!?"),
        count(b".,;:"),
        len(text) - len(raw.translate(None, _HIGH)),
    )


_SCHEMA = T.StructType([T.StructField(name, T.LongType()) for name in COUNTS])


@F.arrow_udf(_SCHEMA)
def text_counts(text: pa.Array) -> pa.Array:
    """The COUNTS of each text, a null one as an empty one."""
    rows = np.array([measure(t.as_py() or "") for t in text], np.int64).reshape(-1, len(COUNTS))
    return pa.StructArray.from_arrays([pa.array(rows[:, k].copy()) for k in range(len(COUNTS))], names=list(COUNTS))


def with_counts(docs: DataFrame, column: str, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``column`` of the COUNTS of each text."""
    return docs.withColumn(column, text_counts(F.col(text)))


def ratio(top: Column, bottom: Column) -> Column:
    return top.cast("double") / F.greatest(bottom, F.lit(1))


def features(counts: Column | str = "counts") -> dict[str, Column]:
    """Length-free statistics, by name, of a struct of COUNTS."""
    c = {name: (F.col(counts) if isinstance(counts, str) else counts)[name] for name in COUNTS}
    return {
        "log_words": F.log1p(c["n_words"].cast("double")),
        "word_length": ratio(c["word_chars"], c["n_words"]),
        "symbol_share": ratio(c["n_symbols"], c["word_chars"]),
        "repeat_share": ratio(c["n_repeat_words"], c["n_words"]),
        "dup_line_share": ratio(c["n_dup_lines"], c["n_lines"]),
        "distinct_share": ratio(c["n_distinct"], c["n_words"]),
        "upper_share": ratio(c["n_upper"], c["n_letters"]),
        "digit_share": ratio(c["n_digits"], c["word_chars"]),
        "mark_share": ratio(c["n_marks"], c["word_chars"]),
        "stop_share": ratio(c["n_stops"], c["word_chars"]),
        "wide_share": ratio(c["n_wide"], c["word_chars"]),
        "line_words": ratio(c["n_words"], c["n_lines"]),
    }
