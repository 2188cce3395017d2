"""Idempotent writes: inserts that ignore what is there, upserts, patches, quarantine, run records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of_each(rows: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def new_rows(incoming: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What an insert that ignores duplicates adds: one row of each key that isn't stored."""
    return incoming.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti")


def upsert(stored: DataFrame, incoming: DataFrame, key: str, order: Column, supplied: Sequence[str]) -> DataFrame:
    """stored after incoming: the last row of a key wins, on the supplied columns only; other columns stay."""
    last = first_of_each(incoming, [key], [order.desc()]).select(key, *[F.col(c).alias(f"_new_{c}") for c in supplied], F.lit(True).alias("_in"))
    both = stored.join(last, key, "full_outer")
    pick = lambda c: F.when(F.col("_in"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
    return both.select(key, *[pick(c) if c in supplied else F.col(c) for c in stored.columns if c != key])


def patch(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """stored with the columns of changes replaced where its key is named."""
    columns = [c for c in changes.columns if c != key]
    marked = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_in"))
    both = stored.join(marked, key, "left")
    return both.select(*[F.when(F.col("_in"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in stored.columns])


def without(stored: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """A deletion, or its cascade to a table that refers to it."""
    return stored.join(gone.select(key), key, "left_anti")


def quarantine_distinct(rows: DataFrame, path: str = "source_path", content: str = "content", order: Sequence[str] = ("created_at", "quarantine_id")) -> DataFrame:
    """The earliest row of each (path, md5 of content)."""
    return first_of_each(rows, [path, F.md5(F.col(content))], [F.col(c).asc() for c in order])
