"""Version history as text: which lines of it are content, file names or people, and where terms occur in them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import leak_hits, trim


def patch_lines(lines: DataFrame, by: Sequence[str] = (), order: str = "line_no", line: str = "line") -> DataFrame:
    """(by, surface content, location commit:file, line) of the added and removed lines of a log with patches.

    A line's commit and file are the last ones named before it; `by` names what parts the log (one file, one
    repository), inside which lines are in order.
    """
    raw = F.col(line)
    marked = lines.select(
        *by, order, raw.alias("_raw"), F.when(raw.rlike(r"\A[0-9a-f]{40}\z"), raw).alias("_commit"), F.nullif(F.regexp_extract(raw, r"\A\+\+\+ b/(.+)\z", 1), F.lit("")).alias("_file"))
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    told = marked.withColumns({"_commit": F.last("_commit", True).over(before), "_file": F.last("_file", True).over(before)})
    r = F.col("_raw")
    inside = r.rlike(r"\A[+-]") & ~r.startswith("+++ ") & ~r.startswith("--- ")
    where = F.concat(F.substring(F.coalesce("_commit", F.lit("")), 1, 8), F.lit(":"), F.coalesce("_file", F.lit("")))
    return told.filter(inside).select(*by, F.lit("content").alias("surface"), where.alias("location"), F.substring(r, F.lit(2), F.length(r)).alias("line"))


def plain_lines(lines: DataFrame, surface: str, line: str = "line") -> DataFrame:
    """(surface, location, line) of file names or of people's names and addresses, each once."""
    one = lines.select(trim(F.col(line)).alias("line")).filter(F.length("line") > 0).distinct()
    return one.select(F.lit(surface).alias("surface"), F.col("line").alias("location"), "line")


def history_hits(rows: DataFrame, terms: Sequence[str] = ()) -> DataFrame:
    """(term, surface, location), each once, of rows (surface, location, line)."""
    found = rows.select("surface", "location", F.explode(leak_hits(F.col("line"), terms)).alias("_h"))
    return found.select("_h.term", "surface", "location").distinct()
