"""Text expressions: cleaning, scrubbing, truncating, snippets, headings, line scans."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import AFTER, BLANKS, EDGE, SPACE, SPACES

# Limits and markers of stored and shown text.
DOCUMENT_CHARS, DOCUMENT_CUT = 400_000, "\n\n[...session truncated for context...]\n\n"
SNIPPET_CHARS, CITED_CHARS, PROMPT_CHARS = 300, 200, 1500


def trim(text: Column) -> Column:
    """Without white space at the ends; the characters are compared, as a pattern tries every place of a text."""
    return F.btrim(text, F.lit(BLANKS))


def is_blank(text: Column) -> Column:
    """Nothing but white space: what trim leaves empty."""
    return ~text.rlike(f"[^{SPACES}]")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return trim(F.regexp_replace(text, rf"{SPACE}+", " "))


def sanitize(text: Column) -> Column:
    """Without control characters (tab, line feed, carriage return stay) and replacement characters."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F�]", "")


def truncate_document(text: Column, most: int = DOCUMENT_CHARS) -> Column:
    """Both ends of a text that is too long, the cut marked."""
    half = most // 2
    cut = F.concat(F.substring(text, 1, half), F.lit(DOCUMENT_CUT), F.right(text, F.lit(half)))
    return F.when(F.length(text) <= most, text).otherwise(cut)


def with_prefix(prefix: Column, text: Column) -> Column:
    return F.when(F.coalesce(prefix, F.lit("")) == "", text).otherwise(F.concat(prefix, F.lit("\n\n"), text))


def snippet(text: Column, chars: int = SNIPPET_CHARS) -> Column:
    return F.substring(text, 1, chars)


def shown_snippet(text: Column, chars: int = SNIPPET_CHARS) -> Column:
    """For the terminal: white space collapsed, then cut."""
    return F.substring(F.regexp_replace(text, rf"{SPACE}+", " "), 1, chars)


def first_heading(text: Column) -> Column:
    """The first markdown heading's text, at most 200 characters, or null."""
    found = trim(F.regexp_extract(text, r"(?m)^#+[ \t]+([^\n]+)$", 1))
    return F.nullif(F.substring(found, 1, 200), F.lit(""))


def literal(term: str) -> str:
    """term as a pattern for itself."""
    return re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", term)


def scrub_identity(text: Column, usernames: Sequence[str] = (), project_refs: Sequence[str] = (), names: Sequence[str] = ()) -> Column:
    """Secret references, project references, home folders, user names and names as neutral marks, in this order."""
    word = lambda t: rf"{EDGE}{literal(t)}{AFTER}"
    out = F.regexp_replace(text, r"op://\S+", "<secret-ref>")
    for ref in filter(None, project_refs):
        out = F.replace(out, F.lit(ref), F.lit("<project-ref>"))
    for user in filter(None, usernames):
        out = F.regexp_replace(out, rf"/home/{literal(user)}(?=/|\z)", r"\$HOME")
        out = F.regexp_replace(out, word(user), "<user>")
    for name in filter(None, names):
        out = F.regexp_replace(out, word(name), "<name>")
    return out


def leak_hits(text: Column, extra_terms: Sequence[str] = ()) -> Column:
    """array<struct<term, line>>: each line's built-in and extra terms; a line that ends in the allow mark has none."""
    def of_line(line: Column, at: Column) -> Column:
        number = (at + 1).cast("int")
        terms = [F.when(line.rlike("op://[A-Za-z0-9]"), F.lit("op://"))]
        terms += [F.when(line.contains(t), F.lit(t)) for t in extra_terms if t]
        hits = F.filter(F.array(*terms), lambda t: t.isNotNull())
        return F.transform(F.when(line.rlike(r"//\s*pickaxe-allow\s*\z"), F.array().cast("array<string>")).otherwise(hits), lambda t: F.struct(t.alias("term"), number.alias("line")))

    return F.flatten(F.transform(F.split(text, "\n"), of_line))


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / F.lit(3.5)).cast("long")


def search_mode(query: Column) -> Column:
    """'current' for a question about the present state, else 'balanced'."""
    found = [query.rlike(f"(?i){EDGE}(?:{p}){AFTER}") for p in CURRENT_STATE]
    out = found[0]
    for f in found[1:]:
        out = out | f
    return F.when(out, "current").otherwise("balanced")


# What marks a question about the present state.
CURRENT_STATE = [
    "current(?:ly)?|now|today|latest|recent(?:ly)?|ongoing|still",
    "where (?:are we|do we stand|am i)",
    "what'?s? (?:left|next|the (?:current|latest) (?:state|status))",
    "(?:status|state) (?:of|on)",
    "right now",
    "as of (?:now|today)",
]
