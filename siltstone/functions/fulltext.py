"""Full-text expressions: tokens, web-style queries, a frequency score."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def parse(query: str) -> list[list[tuple[bool, list[str]]]]:
    """A web-style query: alternatives (or) of terms that all hold; a term is (wanted, words), quoted words a phrase."""
    out: list[list[tuple[bool, list[str]]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if word.lower() == "or" and not minus:
            out.append([])
            continue
        words = re.findall(r"[a-z0-9]+", (phrase or word).lower())
        if words:
            out[-1].append((not minus, words))
    return [terms for terms in out if terms]


def terms_of(query: str) -> list[str]:
    """The wanted words, each once."""
    return list(dict.fromkeys(w for terms in parse(query) for wanted, words in terms if wanted for w in words))


def _stands(tokens_: Column, words: list[str]) -> Column:
    if len(words) == 1:
        return F.array_contains(tokens_, words[0])
    # A phrase: the joined tokens hold the joined words at token edges.
    return F.concat(F.lit(" "), F.array_join(tokens_, " "), F.lit(" ")).contains(f" {' '.join(words)} ")


def matches(tokens_: Column, query: str) -> Column:
    """Whether a token array satisfies a web-style query; an empty query matches nothing."""
    alternatives = []
    for terms in parse(query):
        held = [_stands(tokens_, words) if wanted else ~_stands(tokens_, words) for wanted, words in terms]
        alternatives.append(reduce(Column.__and__, held))
    return reduce(Column.__or__, alternatives) if alternatives else F.lit(False)


def could_match(text: Column, query: str) -> Column:
    """Whether a text holds all wanted words of an alternative as stretches: a cheap look that passes every text that matches, before it is cut into tokens."""
    low = F.lower(text)
    alternatives = [[F.contains(low, F.lit(w)) for wanted, words in terms if wanted for w in words] for terms in parse(query)]
    return reduce(Column.__or__, [reduce(Column.__and__, some, text.isNotNull()) for some in alternatives]) if alternatives else F.lit(False)


def score(tokens_: Column, query: str) -> Column:
    """Occurrences of the query's words per token."""
    hits = reduce(Column.__add__, [F.size(tokens_) - F.size(F.array_remove(tokens_, w)) for w in terms_of(query)], F.lit(0))
    return F.coalesce(F.try_divide(hits.cast("double"), F.size(tokens_).cast("double")), F.lit(0.0))
