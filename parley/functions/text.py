"""Column functions over text: words, script runs, n-grams, names and media types."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Scripts that n-grams tell apart, as Unicode script names.
SCRIPTS = (
    "Latin", "Han", "Hiragana", "Katakana", "Hangul", "Cyrillic", "Arabic", "Hebrew", "Greek",
    "Thai", "Devanagari", "Bengali", "Tamil", "Armenian", "Georgian",
)
BIGRAM_SCRIPTS = ("Han", "Hiragana", "Katakana")
#: Least share of a query's n-grams that must match, by their length.
LEAST_OVERLAP = {2: 0.5, 3: 1 / 3}

#: Characters beyond which a segment is split before its n-grams are taken.
LONG_SEGMENT = 64

_SEPARATORS = r"[\x09-\x0D\x20-\x40\x5B-\x60\x7B-\x7E]+"


def _plain_letters() -> dict[str, str]:
    """Accented Latin letters and full-width forms, each with the ASCII letter or digit it comes down to."""
    found = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and base.isalnum():
            found[chr(code)] = base
    return found


_PLAIN = _plain_letters()
#: Accents that are characters of their own.
_ACCENTS = "".join(map(chr, range(0x300, 0x370)))


def folded(text: Column) -> Column:
    """Lower case without accents on Latin letters; full-width letters and digits as plain ones."""
    low = F.lower(F.coalesce(text, F.lit("")))
    # what has no pair in the second list goes
    plain = F.lower(F.translate(low, "".join(_PLAIN) + _ACCENTS, "".join(_PLAIN.values())))
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(plain)


def fold_query(query: str) -> str:
    """:func:`folded` of one string."""
    table = str.maketrans(_PLAIN) | dict.fromkeys(map(ord, _ACCENTS))
    return query.lower().translate(table).lower()


def words(text: Column) -> Column:
    """Runs of letters and digits, :func:`folded`, in order."""
    return F.regexp_extract_all(folded(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` worked out once a row however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_places(words: Column) -> Column:
    """(word, places) of the distinct words of an array: where in it each is, from 0."""
    numbered = F.sort_array(F.transform(words, lambda word, at: F.struct(word.alias("word"), at.alias("at"))))

    def grouped(sorted_words: Column, at: Column) -> Column:
        count = F.size(sorted_words)
        changes = F.filter(F.sequence(F.lit(0), count - 1), lambda i: (i == 0) | (F.get(sorted_words, i) != F.get(sorted_words, i - 1)))

        def cut(first: Column, k: Column, firsts: Column) -> Column:
            places = F.slice(at, first + 1, F.coalesce(F.get(firsts, k + 1), count) - first)
            return F.struct(F.get(sorted_words, first).alias("word"), places.alias("places"))

        return once(changes, lambda firsts: F.transform(firsts, lambda first, k: cut(first, k, firsts)))

    held = once(numbered, lambda rows: once(rows["word"], lambda own: once(rows["at"], lambda at: grouped(own, at))))
    return F.when(F.size(words) > 0, held).otherwise(F.array().cast("array<struct<word:string,places:array<int>>>"))


def script_runs(text: Column) -> Column:
    """Runs of one script each; other characters stay with the run before, leading ones with the first."""
    known = "".join(rf"\p{{Is{s}}}" for s in SCRIPTS)
    # one possessive class a script, so that a match takes no stack for each character
    runs = "|".join(rf"[^{known}]*+\p{{Is{s}}}[\p{{Is{s}}}[^{known}]]*+" for s in SCRIPTS)
    text = F.coalesce(text, F.lit(""))
    # ASCII text is one Latin run if it has a letter at all
    latin = F.when(text.rlike("[A-Za-z]"), F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.when(F.octet_length(text) == F.length(text), latin).otherwise(F.regexp_extract_all(text, F.lit(f"({runs})"), F.lit(1)))


def in_script(run: Column, name: str) -> Column:
    return run.rlike(rf"\p{{Is{name}}}")


def script_of(run: Column) -> Column:
    """The script of a run."""
    found = F.lit("Unknown")
    for name in reversed(SCRIPTS):
        found = F.when(in_script(run, name), F.lit(name)).otherwise(found)
    return found


def gram_length(script: Column) -> Column:
    return F.when(script.isin(*BIGRAM_SCRIPTS), 2).otherwise(3)


def least_overlap(script: Column) -> Column:
    return F.when(script.isin(*BIGRAM_SCRIPTS), F.lit(LEAST_OVERLAP[2])).otherwise(F.lit(LEAST_OVERLAP[3]))


def segments(run: Column) -> Column:
    """Lower-case parts of a run between ASCII white space, punctuation and digits."""
    return F.array_remove(F.split(F.lower(run), _SEPARATORS, -1), "")


def grams(segment: Column, n: Column) -> Column:
    """The sliding windows of ``n`` (2 or 3) characters of a segment; none if it is shorter.

    Windows of a long segment are put together of its characters, split once: cutting
    each one out would look for its start from the segment's beginning.
    """
    count = F.greatest(F.length(segment) - n + 1, F.lit(0))
    starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))

    def joined(chars: Column) -> Column:
        shifted = F.arrays_zip(F.slice(chars, F.lit(1), count).alias("a"), F.slice(chars, F.lit(2), count).alias("b"), F.slice(chars, F.lit(3), count).alias("c"))
        return F.transform(shifted, lambda w: F.concat(w["a"], w["b"], F.when(n == 3, w["c"]).otherwise("")))

    long = F.get(F.transform(F.array(F.split(segment, "", -1)), joined), F.lit(0))
    return F.when(F.length(segment) <= LONG_SEGMENT, F.transform(starts, lambda i: F.substring(segment, i, n))).otherwise(long)


def query_grams(query: str) -> dict[str, list[str]]:
    """The distinct n-grams of one query by script, as the Column functions cut them; no job is run."""
    import regex

    known = "".join(rf"\p{{Script={s}}}" for s in SCRIPTS)
    found: dict[str, set[str]] = {}
    runs = "|".join(rf"[^{known}]*+\p{{Script={s}}}[\p{{Script={s}}}[^{known}]]*+" for s in SCRIPTS)
    for run in regex.findall(runs, query or "", regex.VERSION1):
        script = next(s for s in SCRIPTS if regex.search(rf"\p{{Script={s}}}", run))
        n = 2 if script in BIGRAM_SCRIPTS else 3
        for part in regex.split(r"[\x09-\x0D\x20-\x40\x5B-\x60\x7B-\x7E]+", run.lower()):
            found.setdefault(script, set()).update(part[i : i + n] for i in range(len(part) - n + 1))
    return {s: sorted(own) for s, own in sorted(found.items()) if own}


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def like_literal(text: Column, query: str) -> Column:
    """Whether ``query`` is in ``text``, ASCII case apart; no character of it is special."""
    return ascii_lower(text).contains(ascii_lower(F.lit(query)))


def content_kind(mime: Column) -> Column:
    """Image, video or audio by prefix; everything else is a document."""
    return (
        F.when(mime.startswith("image/"), "image").when(mime.startswith("video/"), "video").when(mime.startswith("audio/"), "audio").otherwise("document")
    )


#: Documents whose text can be taken out.
DOCUMENT_MIMES = ("application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document")


def supported_document(mime: Column) -> Column:
    return mime.isin(*DOCUMENT_MIMES)


def valid_mime(mime: Column) -> Column:
    return mime.rlike(r"^[A-Za-z0-9+\-._]+/[A-Za-z0-9+\-._]+$")


def base64_url(data: Column) -> Column:
    """Base64 with the URL alphabet and without padding."""
    return F.rtrim(F.translate(F.base64(data), "+/=\r\n", "-_"))


@F.arrow_udf(T.StringType())
def _composed(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in text.to_pylist()], pa.string())


def normalize_caption(text: Column) -> Column:
    """Composed form (NFC), white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(_composed(text), r"(?U)\s+", " "))


@F.arrow_udf(T.StringType())
def sanitize_filename(name: pa.Array) -> pa.Array:
    """Composed, without control and path characters, at most 255 bytes with the extension kept, never empty."""

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        kept = "".join(c for c in unicodedata.normalize("NFC", text) if c not in '/\\:*?"<>|' and unicodedata.category(c) != "Cc")
        kept = kept.strip().strip(".").strip()
        if len(kept.encode()) > 255:
            stem, dot, extension = kept.rpartition(".")
            tail = dot + extension if dot and len(extension.encode()) < 32 else ""
            stem = stem if tail else kept
            kept = stem.encode()[: 255 - len(tail.encode())].decode(errors="ignore") + tail
        return kept or "unnamed"

    return pa.array([clean(t) for t in name.to_pylist()], pa.string())
