"""Words of scripts that put no spaces between them, by a table of words learned from the corpus.

A piece of such a script is cut where the sum of its words' costs is least, a word's cost
being minus the log of its share of the corpus.  The words are pieces of up to LONGEST
characters that occur often enough, and more often than their parts would meet by chance.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import text

#: Scripts written without spaces, as Unicode script names and as ranges of characters.
SCRIPTS = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")
_RANGES = "฀-໿က-႟ក-៿々぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_PIECES = re.compile(f"[{_RANGES}]+|[^{_RANGES}]+")
UNSPACED = re.compile(f"[{_RANGES}]+")
#: All of their characters, and some others: looked for first, for a script is told by a search for each character.
_FAR = "[\u0e00-\U0010ffff]"
#: Characters of a word at most, its least occurrences, how many times likelier than chance, and words of a table at most.
LONGEST, LEAST, COHESION, WORDS = 4, 2, 4.0, 200_000
#: Marks that belong to the letter before them.
_WORD = re.compile(r"(?:[^\W_]|[ัิ-ฺ็-๎])+")


def normal(body: str) -> str:
    """Compatibility forms as plain ones, lower case, without accents on Latin letters."""
    return text.fold_query(unicodedata.normalize("NFKC", body))


def pieces(body: Column) -> Column:
    """The runs of unspaced scripts in a text."""
    known = "".join(rf"\p{{Is{s}}}" for s in SCRIPTS)
    found = F.regexp_extract_all(body, F.lit(f"([{known}]+)"), F.lit(1))
    return F.when(body.rlike(_FAR), found).otherwise(F.array().cast("array<string>"))


def learned(messages: DataFrame, least: int = LEAST, cohesion: float = COHESION, size: int = WORDS) -> DataFrame:
    """(word, n): the words of all ``messages`` (text), and all single characters; of more than ``size`` the most frequent.

    A piece of several characters is a word if it occurs ``least`` times and, wherever it
    is cut in two, ``cohesion`` times as often as its parts would meet by chance.  Copies
    of a run of characters are counted before its pieces are taken.
    """
    runs = messages.select(F.explode(pieces(F.col("text"))).alias("run")).groupBy("run").agg(F.count("*").alias("n"))
    starts = runs.select("run", "n", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("at"))
    sizes = F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("run") - F.col("at") + 1))
    cut = starts.select("n", "run", "at", F.explode(sizes).alias("size")).select("n", F.expr("substring(run, at, size)").alias("word"))
    counts = cut.groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.length("word") == 1))
    total = F.broadcast(counts.where(F.length("word") == 1).agg(F.sum("n").alias("total")))  # one row
    parts = counts.where(F.length("word") > 1).select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("cut"))
    split = parts.select("word", "n", F.expr("substring(word, 1, cut)").alias("a"), F.expr("substring(word, cut + 1)").alias("b"))
    # a part of a frequent piece is at least as frequent, so both are found
    joined = split.join(counts.toDF("a", "n_a"), "a").join(counts.toDF("b", "n_b"), "b").crossJoin(total)
    tied = joined.groupBy("word", "n").agg(F.min(F.col("n") / F.col("n_a") * F.col("total") / F.col("n_b")).alias("tie")).where(F.col("tie") >= cohesion)
    return counts.where(F.length("word") == 1).unionByName(tied.select("word", "n")).orderBy(F.desc("n"), "word").limit(size)


class Lexicon:
    """A learned table as costs; at most WORDS rows, which every task holds."""

    def __init__(self, rows: list[tuple[str, int]]) -> None:
        self.rows = rows
        total = sum(n for w, n in rows if len(w) == 1) or 1
        self.costs = {w: math.log(total / n) for w, n in rows}
        self.unknown = math.log(2 * total) + 1
        self.longest = max((len(w) for w, _ in rows), default=1)

    def cut(self, run: str) -> list[str]:
        """The words of least cost; of equal paths the one whose last words are longest."""
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(run) + 1):
            ways = []
            for size in range(1, min(self.longest, end) + 1):
                cost = self.costs.get(run[end - size : end], self.unknown if size == 1 else None)
                if cost is not None:
                    ways.append((best[end - size][0] + cost, -size))
            cost, size = min(ways)
            best.append((cost, -size))
        out, end = [], len(run)
        while end:
            size = best[end][1]
            out.append(run[end - size : end])
            end -= size
        return out[::-1]

    def words(self, body: str | None) -> list[str]:
        out = []
        for word in _WORD.findall(normal(body or "")):
            for piece in _PIECES.findall(word):
                out += self.cut(piece) if UNSPACED.match(piece) else [piece]
        return out

    def query(self, query: str) -> str:
        """``query`` with what is written without spaces as a phrase of its words."""

        def phrase(found: re.Match) -> str:
            own = self.cut(found.group())
            return " ".join(own) if quoted else f'"{" ".join(own)}"' if len(own) > 1 else own[0]

        out = []
        for k, part in enumerate(query.split('"')):
            quoted = bool(k % 2)
            out.append(UNSPACED.sub(phrase, unicodedata.normalize("NFKC", part)))
        return '"'.join(out)

    def column(self) -> Callable[[Column], Column]:
        """A function of a text's column that gives its words; texts in other scripts alone don't leave the JVM."""

        @F.arrow_udf(T.ArrayType(T.StringType()))
        def cut(bodies: pa.Array) -> pa.Array:
            return pa.array([self.words(b.as_py()) for b in bodies], pa.list_(pa.string()))

        known = "".join(rf"\p{{Is{s}}}" for s in SCRIPTS)

        def unspaced(body: Column) -> Column:
            return body.rlike(_FAR) & body.rlike(f"[{known}]")

        return lambda body: F.when(unspaced(body), cut(F.when(unspaced(body), body))).otherwise(text.words(body))


def read(table: DataFrame) -> Lexicon:
    """The lexicon of a :func:`learned` table."""
    return Lexicon([(r["word"], r["n"]) for r in table.collect()])
