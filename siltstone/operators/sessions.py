"""Sessions: roll-ups, listing, replay, corpus statistics, sampling for summaries, cost estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import AFTER, EDGE

# The sampler's defaults and marks, and the prompt's length.
SAMPLE_CHUNKS, SAMPLE_ALL, PROMPT_CHARS = 12, 40, 24_000
MARKERS = rf"(?i)\[Tool error\]|{EDGE}(?:decided|decision){AFTER}"


def rollup(entries: DataFrame, session: str, order: str, timestamp: str, cwd: str | None = None, title: str | None = None) -> DataFrame:
    """One row per session: first and last timestamp (as text), messages, first cwd, last title."""
    columns = [F.min(timestamp).alias("started_at"), F.max(timestamp).alias("ended_at"), F.count(F.lit(1)).alias("message_count")]
    if cwd:
        columns.append(F.min_by(cwd, F.when(F.col(cwd).isNotNull(), F.col(order))).alias("project_path"))
    if title:
        columns.append(F.max_by(title, F.when(F.col(title).isNotNull(), F.col(order))).alias("summary"))
    return entries.groupBy(session).agg(*columns)


def list_sessions(sessions: DataFrame, limit: int = 25, offset: int = 0, since: str | None = None, project: str | None = None, key: str = "session_id") -> DataFrame:
    """Newest first, sessions without a start before all others; ties by key."""
    if since is not None:
        sessions = sessions.filter(F.col("started_at") >= F.lit(since).cast(sessions.schema["started_at"].dataType))
    if project is not None:
        sessions = sessions.filter(F.col("project_path") == project)
    return sessions.orderBy(F.desc_nulls_first("started_at"), key).offset(offset).limit(limit)


def replay(turns: DataFrame, session_id: object, around: int, window: int = 5, session: str = "session_id", index: str = "turn_index") -> DataFrame:
    """The turns within window of one."""
    return turns.filter((F.col(session) == session_id) & F.col(index).between(max(0, around - window), around + window)).orderBy(index)


def coverage(flag: Column) -> list[Column]:
    """Counts of a three-valued flag, and the percentage that is true, to one decimal."""
    total, yes = F.count(F.lit(1)), F.count_if(F.coalesce(flag, F.lit(False)))
    return [
        total.alias("total"), yes.alias("with_prefix"), F.count_if(F.coalesce(~flag, F.lit(False))).alias("failed"), F.count_if(flag.isNull()).alias("opted_out"),
        F.round(F.coalesce(F.try_divide(yes * 100.0, total), F.lit(0.0)), 1).alias("percent"),
    ]


def distill_sample(chunks: DataFrame, session: str = "session_id", index: str = "turn_index", content: str = "content", most: int = SAMPLE_CHUNKS, threshold: int = SAMPLE_ALL, markers: str = MARKERS) -> DataFrame:
    """The chunks to summarise: all of a short session; of a long one an even grid, both ends, and every marked chunk."""
    one = Window.partitionBy(session)
    placed = chunks.withColumns({"_p": F.row_number().over(one.orderBy(index)) - 1, "_n": F.count(F.lit(1)).over(one)})
    slots = F.greatest(F.lit(2), F.least(F.lit(most), F.col("_n")))
    # Slot i lands on round(i (n - 1) / (slots - 1)): p is on the grid if the nearest slot does.
    near = F.round(F.col("_p") * (slots - 1) / F.greatest(F.col("_n") - 1, F.lit(1)).cast("double"))
    lands = lambda i: F.floor(i * (F.col("_n") - 1) / (slots - 1).cast("double") + 0.5) == F.col("_p")
    on_grid = lands(near) | lands(near - 1) | lands(near + 1)
    return placed.filter((F.col("_n") <= threshold) | on_grid | F.col(content).rlike(markers)).drop("_p", "_n")


def distill_prompt(sample: DataFrame, session: str = "session_id", index: str = "turn_index", content: str = "content", chars: int = PROMPT_CHARS) -> DataFrame:
    """(session, prompt) of a sample, in order, cut to its length."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(content).alias("c"))))
    lines = F.transform(rows, lambda r: F.concat(F.lit("[turn "), r["i"].cast("string"), F.lit("] "), r["c"]))
    return sample.groupBy(session).agg(F.substring(F.array_join(lines, "\n\n"), 1, chars).alias("prompt"))


def cost(tokens_in: Column, tokens_out: Column, rate_in: float, rate_out: float, cache_read: Column | None = None, cache_write: Column | None = None) -> Column:
    """Dollars at rates a million tokens: a cache's reads at a tenth, its writes at five quarters."""
    read, write = cache_read if cache_read is not None else F.lit(0), cache_write if cache_write is not None else F.lit(0)
    plain = F.greatest(F.lit(0), tokens_in - read - write)
    return (plain * rate_in + read * (rate_in * 0.1) + write * (rate_in * 1.25) + tokens_out * rate_out) / 1e6
