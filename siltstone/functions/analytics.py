"""Analytics kernels as column expressions: error signatures and buckets, fingerprint scores, project paths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import AFTER, EDGE
from .text import collapse

UNMATCHED, UNSCOPED = "UNMATCHED", "unscoped"
# What is taken out of an error text, in this order.
VOLATILE = [
    (r"\"[^\"]*\"|'[^']*'", "<STR>"),
    (rf"(?i){EDGE}[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}{AFTER}", "<ID>"),
    (rf"(?i){EDGE}[0-9a-f]{{16,}}{AFTER}", "<ID>"),
    (r"/[^\s'\"]+", "<PATH>"),
    (r"[0-9]+", "<NUM>"),
]


def error_signature(raw: Column) -> Column:
    """The error's class: quoted text, ids, paths and numbers as marks, white space collapsed."""
    for pattern, mark in VOLATILE:
        raw = F.regexp_replace(raw, pattern, mark)
    return collapse(raw)


def error_bucket(signature: Column, seeds: Mapping[str, Sequence[str]]) -> Column:
    """The first seed one of whose patterns the signature holds, letter case aside."""
    low, out = F.lower(signature), None
    for key, patterns in seeds.items():
        hit = F.lit(False)
        for p in patterns:
            hit = hit | low.contains(p.lower())
        out = F.when(hit, key) if out is None else out.when(hit, key)
    return F.lit(UNMATCHED) if out is None else out.otherwise(UNMATCHED)


def fingerprint_score(affected: Column, total: Column, fixability: Column, days_since_last: Column, monthly_slope: Column) -> Column:
    """Share of sessions, times fixability, times recency."""
    share = F.when(total > 0, affected.cast("double") / F.when(total > 0, total)).otherwise(0.0)
    slope = F.least(F.lit(1.0), F.greatest(F.lit(0.0), monthly_slope.cast("double")))
    return share * fixability * (0.6 * F.exp(-days_since_last / F.lit(30.0)) + 0.4 * slope)


def canonical_project(path: Column, home: str) -> Column:
    """One path for a project's many: worktrees fold into their parent; home and scratch have none."""
    at = F.regexp_instr(path, F.lit(r"/\.[^/]+-worktrees/"))
    return (
        F.when(path.isNull() | (path == home) | (path == "/tmp") | path.startswith("/tmp/"), UNSCOPED)
        .when(at > 0, F.substring(path, F.lit(1), at - 1))
        .otherwise(path)
    )


def hour_age(at: Column, now: Column) -> Column:
    """Hours from one time to another, to two digits, rounded down."""
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(at)) / F.lit(36.0)) / F.lit(100.0)
