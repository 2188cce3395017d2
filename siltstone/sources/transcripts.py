"""Transcript files: JSON lines, listing and caps, entries to turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import projection
from ..operators import sessions

#: Fixed value: longer lines are skipped.
LINE_CHARS = 2_000_000
#: Chosen files that a filter names, at most; more are joined.
NAMED = 1000
_ENTRY = projection.ENTRY


def listing(spark: SparkSession, path: str, recursive: bool = True, most_bytes: int | None = None, most_files: int | None = None) -> DataFrame:
    """(source_path, byte_size) of the .jsonl files under a folder, or of one file; no content is read."""
    files = spark.read.option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", str(recursive).lower()).format("binaryFile").load(path)
    named = files.select(F.col("path").alias("source_path"), F.col("length").alias("byte_size"))
    if most_bytes is not None:
        named = named.filter(F.col("byte_size") <= most_bytes)
    return named if most_files is None else named.orderBy("source_path").limit(most_files)


def lines(spark: SparkSession, path: str, recursive: bool = True, most_bytes: int | None = None, most_files: int | None = None) -> DataFrame:
    """(source_path, session_id, byte_size, line_no, line) of the .jsonl files under a folder, blank and overlong lines left out.

    Files are read line by line, large ones by several tasks. line_no is (where the task's part of the file begins,
    place in it): it grows with the line's place in its file, and that is all it is for.
    """
    read = spark.read.option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", str(recursive).lower()).text(path)
    cut = read.select(
        F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_size").alias("byte_size"),
        F.struct(F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("at")).alias("line_no"), F.col("value").alias("line"),
    )
    if most_bytes is not None:
        cut = cut.filter(F.col("byte_size") <= most_bytes)
    if most_files is not None:
        # The chosen paths are the listing's first ones; a listing writes file:/x where a row has file:///x.
        plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
        chosen = listing(spark, path, recursive, most_bytes, most_files).select(plain(F.col("source_path")).alias("_chosen"))
        if most_files <= NAMED:
            # Named in the filter, so that no other file is opened.
            cut = cut.filter(plain(F.col("source_path")).isin([r[0] for r in chosen.collect()]))
        else:
            cut = cut.join(chosen, plain(F.col("source_path")) == F.col("_chosen"), "left_semi")
    return cut.filter((F.length(F.trim("line")) > 0) & (F.length("line") <= LINE_CHARS)).withColumn("session_id", session_of("source_path"))


def session_of(path: str):
    return F.regexp_extract(path, r"([^/]+?)(?:\.jsonl)?$", 1)


def parse(rows: DataFrame, line: str = "line") -> DataFrame:
    """rows with the entry's fields; lines that aren't JSON objects with a type have entry null (see bad_lines)."""
    entry = F.from_json(F.col(line), _ENTRY, {"mode": "PERMISSIVE"})
    return rows.withColumn("entry", normalize(entry))


def normalize(entry):
    """The older envelope (type message, the role inside) as the newer; null without a type."""
    old = (entry["type"] == "message") & entry["message"]["role"].isNotNull()
    fields = {
        "type": F.when(old, entry["message"]["role"]).otherwise(entry["type"]),
        "uuid": F.when(old, F.coalesce(entry["uuid"], entry["id"], F.lit(""))).otherwise(entry["uuid"]),
        "parentUuid": F.when(old, F.coalesce(entry["parentUuid"], entry["parentId"])).otherwise(entry["parentUuid"]),
    }
    out = F.struct(*[c.alias(k) for k, c in fields.items()], *[entry[k].alias(k) for k in ("timestamp", "sessionId", "cwd", "gitBranch", "isSidechain", "isMeta", "summary", "aiTitle", "message")])
    return F.when(entry["type"].isNotNull(), out)


def bad_lines(parsed: DataFrame) -> DataFrame:
    """The side output: lines that were skipped."""
    return parsed.filter(F.col("entry").isNull())


def session_facts(parsed: DataFrame, session: str = "session_id", order: str = "line_no") -> DataFrame:
    """(session, started_at, ended_at, message_count, project_path, summary) of all entries: first working folder, last title."""
    e = F.col("entry")
    entries = parsed.filter(e.isNotNull()).select(session, order, e["timestamp"].alias("at"), e["cwd"].alias("cwd"), F.when(e["type"] == "ai-title", e["aiTitle"]).alias("title"))
    return sessions.rollup(entries, session, order, "at", "cwd", "title")


def to_turns(parsed: DataFrame, product: str, session: str = "session_id", order: str = "line_no") -> DataFrame:
    """Content-bearing entries as turns, numbered from 0 in each session: role, text, occurred_at, tools_called, is_meta_message."""
    e, content = F.col("entry"), F.col("entry.message.content")
    turns = parsed.filter(e["type"].isin("user", "assistant", "summary")).select(
        session, order, projection.entry_role(e["type"]).alias("role"), projection.entry_text(e["type"], content, e["summary"]).alias("text"), e["timestamp"].alias("occurred_at"),
        F.when(e["type"] == "assistant", projection.tools_called(content)).otherwise(F.array().cast("array<string>")).alias("tools_called"),
        F.coalesce(projection.is_meta_message(e["type"], content, product), F.lit(False)).alias("is_meta_message"),
    )
    index = F.row_number().over(Window.partitionBy(session).orderBy(order)) - 1
    return turns.filter(F.length("text") > 0).withColumn("turn_index", index)


def meta_sessions(parsed: DataFrame, product: str, session: str = "session_id") -> DataFrame:
    """(session, tool_calls, user_messages, on_topic, is_meta, is_meta_by_topic): the ingest rule and the wider one."""
    e, content = F.col("entry"), F.col("entry.message.content")
    own = F.coalesce(projection.uses_own_tool(e["type"], content, product), F.lit(False))
    user = e["type"] == "user"
    counts = parsed.groupBy(session).agg(
        F.count_if(own).alias("tool_calls"), F.count_if(user).alias("user_messages"), F.count_if(user & projection.names_product(projection.message_text(content), product)).alias("on_topic"))
    calls = F.col("tool_calls") >= 3
    return counts.withColumns({"is_meta": calls, "is_meta_by_topic": calls | ((F.col("user_messages") >= 5) & (F.col("on_topic") * 2 >= F.col("user_messages")))})
