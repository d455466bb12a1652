from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = ("row", "counts", "covered", "fp", "score", "words", "n_words", "h1", "label", "salt", "length", "kept_row", "bad_row", "spot", "p")


def syllables(rng: random.Random, n: int, parts: str = "an the er ion to re at ing ou sh") -> str:
    own = parts.split()
    return " ".join("".join(rng.choice(own) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark, tmp_path_factory):
    """Rows (doc_id, text[, lang]) as a Parquet scan of ``documents``' columns, with clashing ones if asked."""

    def make(rows, clash: bool = False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if clash:
            from pyspark.sql import functions as F

            df = df.select("*", *(F.lit("clash").alias(c) for c in CLASHES))
        path = str(tmp_path_factory.mktemp("docs") / "t")
        df.write.parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty, blank, long and repeated texts, ties, a row without an id."""
    rng = random.Random(3)
    long = "\n".join(syllables(rng, 40) for _ in range(1500))
    passage = "\n".join(syllables(rng, 20) for _ in range(6))
    return [
        (1, None),
        (2, ""),
        (3, " \t\n\x0b "),
        (4, "One two THREE"),
        (5, "One two THREE"),
        (5, "One two THREE"),
        (None, passage),
        (6, passage),
        (7, passage + "\n" + syllables(rng, 60)),
        (8, long),
        (9, "a a a a a a\na a a a a a\na a a a a a\na a a a a a"),
        (10, "Ünïcode Straße\x85İstanbul ΣΑΣ — 日本語 <|endoftext|> 'tis it's 42"),
        (11, "#*$ %&| <> #*$ %&| <>"),
    ]


@pytest.fixture(scope="session")
def rng():
    return random.Random(11)
