"""Full-text match expressions compiled to predicates over a message's words.

``"a phrase"`` matches consecutive words, ``pre*`` a word's beginning; other terms
match a word.  Terms side by side are all needed.  AND, OR, NOT and NEAR are operators
only between two terms and are ordinary words elsewhere; NOT binds closest, then AND,
then OR.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.text import fold_query

OPERATORS = ("AND", "OR", "NOT", "NEAR")
#: Words that two terms joined by NEAR may be apart.
NEAR_DISTANCE = 10


@dataclass(frozen=True)
class Term:
    words: tuple[str, ...]
    prefix: bool = False


def _words(text: str) -> tuple[str, ...]:
    return tuple(re.findall(r"[^\W_]+", fold_query(text)))


def tokenize(query: str) -> list[Term | str]:
    """Terms and the operators between them; an operator without a term on either side is a term."""
    found: list[Term | str] = []
    for phrase, bare in re.findall(r'"([^"]*)"|(\S+)', query):
        if bare in OPERATORS:
            found.append(bare)
            continue
        words = _words(phrase or bare)
        if words:
            found.append(Term(words, bool(bare) and bare.endswith("*")))
    out: list[Term | str] = []
    for k, item in enumerate(found):
        between = isinstance(item, str) and out and isinstance(out[-1], Term) and k + 1 < len(found) and isinstance(found[k + 1], Term)
        out.append(item if isinstance(item, Term) or between else Term(_words(item)))
    return out


def positive_words(query: str) -> list[str]:
    """The distinct words of terms that aren't negated, in order; prefixes keep their star."""
    out, negated = [], False
    for item in tokenize(query):
        if isinstance(item, str):
            negated = item == "NOT"
            continue
        if not negated:
            out += [w + "*" * (item.prefix and k == len(item.words) - 1) for k, w in enumerate(item.words)]
        negated = False
    return list(dict.fromkeys(out))


def all_words(query: str) -> list[str]:
    """The distinct words of all terms, negated ones too; prefixes keep their star."""
    terms = (item for item in tokenize(query) if isinstance(item, Term))
    return list(dict.fromkeys(w + "*" * (t.prefix and k == len(t.words) - 1) for t in terms for k, w in enumerate(t.words)))


def _term(words: Column, term: Term) -> Column:
    if len(term.words) == 1:
        word = term.words[0]
        return F.exists(words, lambda w: w.startswith(word)) if term.prefix else F.array_contains(words, word)
    padded = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    return padded.contains(" " + " ".join(term.words) + ("" if term.prefix else " "))


def _near(words: Column, a: Term, b: Term) -> Column:
    """Whether first words of both terms are at most NEAR_DISTANCE + 1 places apart."""

    def places(word: str) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i) == word)

    close = F.exists(places(a.words[0]), lambda i: F.exists(places(b.words[0]), lambda j: F.abs(i - j) <= NEAR_DISTANCE + 1))
    return (F.size(words) > 0) & _term(words, a) & _term(words, b) & close


def combined(query: str, term: Callable[[Term], Column], near: Callable[[Term, Term], Column]) -> Column:
    """The match expression of ``query`` over what ``term`` and ``near`` say of its terms; a query without words matches nothing."""
    items = tokenize(query)
    if not items:
        return F.lit(False)
    either: list[list[Column]] = [[]]
    k = 0
    while k < len(items):
        item = items[k]
        if item == "OR":
            either.append([])
        elif item == "NOT":
            k += 1
            either[-1].append(~term(items[k]))
        elif item == "NEAR":
            k += 1
            either[-1][-1] = near(items[k - 2], items[k])
        elif isinstance(item, Term):
            either[-1].append(term(item))
        k += 1
    return reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, group) for group in either))


def predicate(words: Column, query: str) -> Column:
    """Whether the array ``words`` matches."""
    return combined(query, lambda t: _term(words, t), lambda a, b: _near(words, a, b))


def keys(term: Term) -> list[str]:
    """The words of a term, the last one with a star if it stands for all that it begins."""
    return [w + "*" * (term.prefix and k == len(term.words) - 1) for k, w in enumerate(term.words)]


def needs_places(query: str) -> bool:
    """Whether it matters where a message's words are: for phrases and NEAR."""
    items = tokenize(query)
    return "NEAR" in items or any(isinstance(t, Term) and len(t.words) > 1 for t in items)


def by_places(query: str, has: Callable[[str], Column], places: Callable[[str], Column]) -> Column:
    """The match expression over postings: whether a message has a key's words, and at which places (sorted or not, never null)."""

    def term(t: Term) -> Column:
        first, *rest = keys(t)
        if not rest:
            return has(first)
        return F.exists(places(first), lambda at: reduce(lambda a, b: a & b, (F.array_contains(places(w), at + k) for k, w in enumerate(rest, 1))))

    def near(a: Term, b: Term) -> Column:
        close = F.exists(places(a.words[0]), lambda i: F.exists(places(b.words[0]), lambda j: F.abs(i - j) <= NEAR_DISTANCE + 1))
        return term(a) & term(b) & close

    return combined(query, term, near)


def needed(query: str) -> list[str]:
    """Keys that every match has; none if terms are alternatives."""
    items = tokenize(query)
    if "OR" in items:
        return []
    return list(dict.fromkeys(k for n, t in enumerate(items) if isinstance(t, Term) and (n == 0 or items[n - 1] != "NOT") for k in keys(t)))
