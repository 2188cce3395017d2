"""Note files, logs, term lists, and the registry of sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trim


def notes(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, source_type, text, last_modified) of a folder's own .md files; the index file isn't a note."""
    files = spark.read.option("pathGlobFilter", "*.md").format("binaryFile").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.filter(name != "MEMORY.md").select(
        F.col("path").alias("source_path"), F.when(name.rlike("(?i)handoff"), "handoff").otherwise("memory").alias("source_type"),
        F.col("content").cast("string").alias("text"), F.col("modificationTime").alias("last_modified"),
    )


def log_files(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """(path, name, text, modified) of a folder's .log files."""
    reader = spark.read.option("pathGlobFilter", "*.log")
    files = (reader.option("modifiedAfter", since) if since else reader).format("binaryFile").load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("content").cast("string").alias("text"), F.col("modificationTime").alias("modified"))


def log_health(logs: DataFrame) -> DataFrame:
    """One row of totals over ingest logs (name, text, modified)."""
    note = F.col("name").startswith("memory-refresh-")
    failures = F.when(~note, F.regexp_count("text", F.lit("CR failed for "))).otherwise(0)
    done = lambda k: F.coalesce(F.expr(f"try_cast(nullif(regexp_extract(text, 'Done: ([0-9]+) inserted, ([0-9]+) quarantined', {k}), '') as bigint)"), F.lit(0))
    unpaid = ~note & (F.col("text").contains("Insufficient Balance") | F.col("text").contains("402"))
    total = lambda c: F.coalesce(F.sum(F.when(~note, c)), F.lit(0)).cast("long")
    return logs.agg(
        F.count_if(~note).alias("sessions_ingested"), F.count_if(note).alias("memory_refreshes"), total(done(1)).alias("chunks_inserted"), total(done(2)).alias("chunks_quarantined"),
        total(failures).alias("cr_failures"), F.coalesce(F.max(failures), F.lit(0)).cast("long").alias("worst_run"), F.max(F.when(unpaid, F.col("modified"))).alias("latest_unpaid"),
    )


def term_list(spark: SparkSession, path: str) -> list[str]:
    """A list of terms, one a line; blank lines and comments left out. Written by hand, so small enough for the driver."""
    line = trim(F.col("value"))
    return [r[0] for r in spark.read.text(path).select(line.alias("t")).filter("length(t) > 0 and not startswith(t, '#')").collect()]


@dataclass(frozen=True)
class Source:
    label: str
    kind: str
    root: str
    machine: str


KINDS = {"transcripts", "transcripts-flat", "web-export", "graph-export", "messenger-export", "notes"}


def sources(defaults: list[Source], override: list[Source] | None = None, label: str | None = None) -> list[Source]:
    """The sources to read: the override in place of the defaults, only one label's if asked for."""
    found = defaults if override is None else override
    if unknown := {s.kind for s in found} - KINDS:
        raise ValueError(f"unknown kinds of source: {sorted(unknown)}")
    if label is not None:
        found = [s for s in found if s.label == label]
        if not found:
            raise ValueError(f"no source is labelled {label}")
    return found


def machine_of(path: Column, local_prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in local_prefixes:
        out = out | path.startswith(p)
    return F.when(out, "local").otherwise("unknown")
