"""Connected components of a graph of links, by alternating large-star and small-star steps.

Every step is a few shuffles of the links that are left; each round is written to the shared folder, which cuts
the lineage, and the round before it is deleted. Links never reach the driver: only their number and a checksum do.

A component ends as a star, so its centre may hold most of all links. The links of a centre are dealt over SALTS
parts by their other end: each part finds its own least, the parts' leasts (at most SALTS rows a centre) meet,
and the answer goes back to the parts. No task has to take a whole star.

Defined results: links of a node with itself, repeated links and links in both directions change nothing; links with a
null end are left out; nodes without links have no row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Parts that the rows of one key are dealt over.
SALTS = 32


def salt(*columns: str) -> Column:
    """The part of a row of a possibly hot key, from other columns of the row."""
    return F.pmod(F.xxhash64(*columns, F.lit("salt")), F.lit(SALTS)).cast("int")


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Tie each node's larger (large) or smaller neighbours, and itself, to its least neighbour."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    both = both.withColumn("part", salt("b"))
    parts = both.groupBy("a", "part").agg(F.min("b").alias("m"))
    least = parts.groupBy(F.col("a").alias("node")).agg(F.min("m").alias("m")).select("node", F.least("node", "m").alias("m"))
    told = parts.select("a", "part").join(least, F.col("a") == F.col("node")).select("a", "part", "m")
    tied = both.join(told, ["a", "part"])
    if large:
        out = tied.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that the links (a, b) name; the component is its least node."""
    now = written(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        last, now = now, written(_star(_star(now, True), False), "links")
        discard(last)
        mark, before = _mark(now), mark
        if mark == before:
            break
    # Stars are left: every other node is tied to its component's least.
    tied = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return tied.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
