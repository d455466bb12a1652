"""Language identification: the family first, then one-versus-one support vector machines within it.

Features are hashed character n-grams (1 to 3 bytes of lower-case text, anything but
letters as a space) of the whole text.  A multinomial logistic regression gives the
family; inside a family of several languages, a linear support vector machine for each
pair votes, and summed margins decide ties.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, drawn, held_out
from .linear import fit_softmax, fit_svm, logistic, softmax

#: Closely related languages; one of no family is a family by itself.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "mr", "ne", "bn", "gu", "pa"),
}
UNKNOWN = "und"
#: About so many labelled rows at most are learned from, dealt evenly to the languages.
TRAIN_ROWS = 4_000
BUCKETS = 2048

#: ASCII letters and all bytes beyond ASCII stay; the rest is a space.
_KEEP = np.array([b if chr(b).isalpha() and b < 128 or b >= 128 else 32 for b in range(256)], np.uint32)


def _lettered(text: str) -> bool:
    """Whether any character is a letter; signs like ``²`` or ``Ⅷ`` are none."""
    return any(map(str.isalpha, text))


def ngram_counts(text: str) -> np.ndarray:
    """Hashed counts of the n-grams of one text, damped and of unit length."""
    raw = _KEEP[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    total = np.bincount(raw * np.uint32(2654435761) >> np.uint32(21), minlength=BUCKETS)
    if len(raw) > 1:
        pair = raw[:-1] * np.uint32(257) + raw[1:]
        total += np.bincount((pair + np.uint32(77)) * np.uint32(2246822519) >> np.uint32(21), minlength=BUCKETS)
    if len(raw) > 2:
        triple = pair[:-1] * np.uint32(263) + raw[2:]
        total += np.bincount((triple + np.uint32(99)) * np.uint32(3266489917) >> np.uint32(21), minlength=BUCKETS)
    damped = np.sqrt(total.astype(np.float32))
    return damped / max(1e-6, float(np.linalg.norm(damped)))


@dataclass
class Hierarchy:
    """families: the languages of each, in order; pairs: by (language, language) weights for the first."""

    families: list[tuple[str, ...]]
    to_family: np.ndarray
    pairs: dict[tuple[str, str], np.ndarray]

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        ones = np.hstack([x, np.ones((len(x), 1), x.dtype)])
        family = softmax(ones @ self.to_family)
        chosen = family.argmax(axis=1)
        out: list[tuple[str, float]] = [("", 0.0)] * len(x)
        for k in np.unique(chosen):
            rows, languages = np.flatnonzero(chosen == k), self.families[k]
            votes = np.zeros((len(rows), len(languages)))
            margins = np.zeros_like(votes)
            for a, b in combinations(range(len(languages)), 2):
                margin = ones[rows] @ self.pairs[languages[a], languages[b]]
                votes[:, a] += margin >= 0
                votes[:, b] += margin < 0
                margins[:, a] += margin
                margins[:, b] -= margin
            best = (votes + 1e-3 * np.tanh(margins)).argmax(axis=1)
            sure = logistic(2 * margins[np.arange(len(rows)), best] / max(1, len(languages) - 1)) if len(languages) > 1 else 1.0
            for row, at, score in zip(rows, best, np.broadcast_to(family[rows, k] * sure, len(rows))):
                out[row] = (languages[at], float(min(1.0, max(0.0, score))))
        return out


def fit(x: np.ndarray, languages: list[str]) -> Hierarchy:
    """Learn from rows of :func:`ngram_counts` and their languages."""
    known = sorted(set(languages))
    of = {lang: name for name, members in FAMILIES.items() for lang in members}
    names = sorted({of.get(lang, f"only {lang}") for lang in known})
    families = [tuple(lang for lang in known if of.get(lang, f"only {lang}") == name) for name in names]
    ones = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    said = np.array(languages)
    family = np.array([next(k for k, members in enumerate(families) if lang in members) for lang in languages])
    pairs = {}
    for members in families:
        for a, b in combinations(members, 2):
            rows = (said == a) | (said == b)
            pairs[a, b] = fit_svm(ones[rows], np.where(said[rows] == a, 1, -1).astype(x.dtype))
    return Hierarchy(families, fit_softmax(ones, family, len(families)), pairs)


@F.arrow_udf(T.BinaryType())
def _packed(text: pa.Array) -> pa.Array:
    return pa.array([ngram_counts(t.as_py() or "").astype(np.float16).tobytes() for t in text], pa.binary())


def training_sample(docs: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, list[str]]:
    """Features of fixed size and languages of about ``rows`` documents at most, none of the held-out fold."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    wanted = F.lit(False)
    for lang, n in sizes.items():
        share = min(1.0, rows / len(sizes) / n)
        wanted = wanted | ((F.col("lang") == lang) & drawn(share, "doc_id", "text"))
    sample = known.where(wanted).select("lang", _packed(F.col("text")).alias("x")).toArrow()
    x = np.frombuffer(b"".join(sample["x"].to_pylist()), np.float16).astype(np.float32).reshape(-1, BUCKETS)
    return x, sample["lang"].to_pylist()


def identify(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, lang_pred, score.

    Only the whole text is looked at to predict, however long; one that is null or has
    no letter is ``und`` with score 0, and so is every text if there is nothing to learn
    from.  Repeated rows are predicted alike.  Ties go to the family and then to the
    language that is first by name.  An empty table gives no rows; columns other than
    doc_id, text and lang may have any names.
    """
    x, languages = training_sample(bounded_batches(docs), rows)
    model = fit(x, languages) if languages else None
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS by the number of language pairs

    @F.arrow_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predict(text: pa.Array) -> pa.Array:
        found, hierarchy = [], sent.value
        for at in range(0, len(text), 512):
            part = [t.as_py() for t in text[at : at + 512]]
            told = [bool(hierarchy and t and _lettered(t)) for t in part]
            lettered = [ngram_counts(t) for t, ok in zip(part, told) if ok]
            guesses = iter(hierarchy.predict(np.stack(lettered)) if lettered else ())
            found += [next(guesses) if ok else (UNKNOWN, 0.0) for ok in told]
        names, scores = zip(*found) if found else ((), ())
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text")).alias("guess"))
    return out.select("doc_id", "held_out", "guess.lang_pred", "guess.score")
