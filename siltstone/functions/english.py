"""English full-text search: stop words, Snowball stems, positions, and a cover-density rank.

Stems come from an Arrow-batched function with a memory of words; what works on a column of them is built in. A
search keeps no stems: one function goes through a text and keeps the places of the stems that the query names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fulltext import parse

# English function words that aren't indexed.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom "
    "this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into "
    "through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such "
    "no nor not only own same so than too very s t can will just don should now".split()
)
# The English Snowball stemmer's exceptions, endings by step and what takes their place.
WHOLE = (
    "skis:ski skies:sky dying:die lying:lie tying:tie idly:idl gently:gentl ugly:ugli early:earli only:onli singly:singl "
    "sky:sky news:news howe:howe atlas:atlas cosmos:cosmos bias:bias andes:andes"
)
LEFT_BY_STEP_1 = "inning outing canning herring earring proceed exceed succeed"
STEP_2 = (
    "tional:tion enci:ence anci:ance abli:able entli:ent izer:ize ization:ize ational:ate ation:ate ator:ate alism:al aliti:al alli:al fulness:ful ousli:ous ousness:ous iveness:ive iviti:ive "
    "biliti:ble bli:ble fulli:ful lessli:less"
)
STEP_3 = "tional:tion ational:ate alize:al icate:ic iciti:ic ical:ic ful: ness:"
STEP_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize"
#: How much of a text is cut into words at a time.
STRETCH = 1 << 16
DOUBLES, BEFORE_LI = "bb dd ff gg mm nn pp rr tt".split(), "cdeghkmnrt"
#: The weight of an unlabelled word in the cover-density rank.
WEIGHT = 0.1


_VOWELS = "aeiouy"


def _regions(word: str) -> tuple[int, int]:
    """Where the regions after the first, and then the second, consonant that follows a vowel begin."""
    def after(start: int) -> int:
        for k in range(start + 1, len(word)):
            if word[k] not in _VOWELS and word[k - 1] in _VOWELS:
                return k + 1
        return len(word)

    first = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    one = after(0) if first is None else first
    return one, after(one)


def _short_syllable(word: str) -> bool:
    """The word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return len(word) > 2 and word[-1] not in _VOWELS and word[-1] not in "wxY" and word[-2] in _VOWELS and word[-3] not in _VOWELS


def _has_vowel(part: str) -> bool:
    return any(c in _VOWELS for c in part)


def _longest(word: str, table: str) -> tuple[str, str] | None:
    rules = [r.partition(":")[::2] for r in table.split()]
    return max((r for r in rules if word.endswith(r[0])), key=lambda r: len(r[0]), default=None)


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith(("us", "ss")) or not w.endswith("s"):
        return w
    return w[:-1] if _has_vowel(w[:-2]) else w


def _past(w: str, one: int) -> str:
    for ending in ("eedly", "eed"):
        if w.endswith(ending):
            return w[: -len(ending)] + "ee" if len(w) - len(ending) >= one else w
    for ending in ("ingly", "edly", "ing", "ed"):
        if w.endswith(ending):
            rest = w[: -len(ending)]
            if not _has_vowel(rest):
                return w
            if rest.endswith(("at", "bl", "iz")):
                return rest + "e"
            if rest[-2:] in DOUBLES:
                return rest[:-1]
            return rest + "e" if one >= len(rest) and _short_syllable(rest) else rest
    return w


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The English Snowball stem of a lower-case word."""
    if len(word) <= 2 or not word.isalpha():
        return word
    whole = dict(r.split(":") for r in WHOLE.split())
    if word in whole:
        return whole[word]
    # A y that is a consonant, at the start or after a vowel, is written Y.
    w = "".join("Y" if c == "y" and (k == 0 or word[k - 1] in _VOWELS) else c for k, c in enumerate(word))
    one, two = _regions(w)
    w = _plural(w)
    if w in LEFT_BY_STEP_1.split():
        return w
    w = _past(w, one)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    if found := _longest(w, STEP_2 + " ogi:og li:"):
        ending, new = found
        rest = w[: -len(ending)]
        if len(rest) >= one and (ending != "ogi" or rest.endswith("l")) and (ending != "li" or rest[-1:] in BEFORE_LI):
            w = rest + new
    if found := _longest(w, STEP_3 + " ative:"):
        ending, new = found
        rest = w[: -len(ending)]
        if len(rest) >= (two if ending == "ative" else one):
            w = rest + new
    if found := _longest(w, STEP_4 + " ion"):
        rest = w[: -len(found[0])]
        if len(rest) >= two and (found[0] != "ion" or rest[-1:] in "st"):
            w = rest
    if w.endswith("e"):
        rest = w[:-1]
        if len(rest) >= two or (len(rest) >= one and not _short_syllable(rest)):
            w = rest
    elif w.endswith("ll") and len(w) - 1 >= two:
        w = w[:-1]
    return w.lower()


def could_begin(stem_: str) -> str:
    """What all words of a stem begin with: a stem is its word's beginning but for two letters at most (ble for bility, ie for ying)."""
    return stem_[:-2]


def words_of(text: str) -> Iterator[str]:
    """Lower-case runs of a-z and 0-9, in order; a stretch of the text at a time, which ends where a word does."""
    for part in re.finditer(rf"(?s).{{1,{STRETCH}}}[a-z0-9]*", text.lower()):
        yield from re.findall("[a-z0-9]+", part.group())


@F.pandas_udf(T.ArrayType(T.StringType()))
def lexemes(texts: pd.Series) -> pd.Series:
    """The stem at each word's position; an empty string where a stop word stands."""
    return texts.map(lambda t: [] if t is None else ["" if w in STOP_WORDS else stem(w) for w in re.findall("[a-z0-9]+", t.lower())])


#: Not to be folded into the expressions that use its column: those may sit in array functions, where Python can't run.
lexemes = lexemes.asNondeterministic()


def terms(query: str) -> list[list[tuple[bool, list[str]]]]:
    """A web-style query in stems; stop words hold a phrase's places but ask for nothing alone."""
    out = []
    for alternative in parse(query):
        some = [(wanted, ["" if w in STOP_WORDS else stem(w) for w in words]) for wanted, words in alternative]
        some = [(wanted, words) for wanted, words in some if any(words)]
        if some:
            out.append(some)
    return out


def matches(stems: Column, query: str) -> Column:
    def stands(words: list[str]) -> Column:
        if len(words) == 1:
            return F.array_contains(stems, words[0])
        places = F.sequence(F.lit(1), F.greatest(F.size(stems), F.lit(1)))
        return F.exists(places, lambda i: reduce(Column.__and__, [F.coalesce(F.get(stems, i - 1 + k) == w, F.lit(False)) for k, w in enumerate(words) if w]))

    alternatives = [reduce(Column.__and__, [stands(words) if wanted else ~stands(words) for wanted, words in some]) for some in terms(query)]
    return reduce(Column.__or__, alternatives) if alternatives else F.lit(False)


def covers(stems: list[str], wanted: list[str]) -> float:
    """The sum over minimal stretches that hold every wanted stem of WEIGHT over 1 plus the other words inside."""
    return covers_at([(k, s) for k, s in enumerate(stems) if s in wanted], wanted)


def covers_at(places: list[tuple[int, str]], wanted: list[str]) -> float:
    """covers, of the wanted stems' places in order."""
    need, held, low, total = set(wanted), {}, 0, 0.0
    for high, (at, s) in enumerate(places):
        held[s] = held.get(s, 0) + 1
        if len(held) < len(need):
            continue
        while held[places[low][1]] > 1:
            held[places[low][1]] -= 1
            low += 1
        total += WEIGHT / (1 + (at - places[low][0]) - (high - low))
        del held[places[low][1]]
        low += 1
    return total


def _stands(where: dict[str, list[int]], words: list[str]) -> bool:
    """Whether a phrase, or a word, stands among the stems' places."""
    asked = [(k, w) for k, w in enumerate(words) if w]
    if any(w not in where for _, w in asked):
        return False
    if len(words) == 1:
        return True
    others = [(k - asked[0][0], set(where[w])) for k, w in asked[1:]]
    # Stop words before the first stem need their places too.
    return any(at >= asked[0][0] and all(at + k in places for k, places in others) for at in where[asked[0][1]])


def density(text: str | None, terms_: list[list[tuple[bool, list[str]]]]) -> float | None:
    """The best alternative's covers in a text that matches the terms, else null; only the terms' stems are kept."""
    named, where = {w for some in terms_ for _, words in some for w in words if w}, {}
    begins = tuple(could_begin(w) for w in named)
    for k, word in enumerate(words_of(text or "")):
        if not word.startswith(begins):
            continue
        s = stem(word)
        if s in named and word not in STOP_WORDS:
            where.setdefault(s, []).append(k)
    if not any(all(_stands(where, words) == wanted for wanted, words in some) for some in terms_):
        return None
    wanted = [list(dict.fromkeys(w for ok, words in some if ok for w in words if w)) for some in terms_]
    return max((covers_at(sorted((at, w) for w in some for at in where.get(w, [])), some) for some in wanted if some), default=0.0)


def cover_density(text: Column, query: str) -> Column:
    """density of a query, text by text. Not deterministic to the planner, as it is to run once where its column is filtered."""
    asked = terms(query)

    @F.arrow_udf(T.DoubleType())
    def rank(texts: pa.Array) -> pa.Array:
        return pa.array((density(t.as_py(), asked) for t in texts), pa.float64())

    return rank.asNondeterministic()(text)
