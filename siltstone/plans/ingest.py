"""Ingest: turns to windows, scanned, deduplicated, split into stored chunks and quarantine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import privacy, text as texts
from ..operators import store, windowing
from .providers import Embedder, HashEmbedder, Prefixer

#: What a window carries of its turns.
CARRIED = ("role", "occurred_at", "tools_called", "is_meta_message")
#: An ingest run's sums, in the order in which they are reported.
TOTALS = ("windows_total", "windows_new", "windows_quarantined", "windows_inserted", "chars_embedded", "embed_tokens", "prefix_input_tokens", "prefix_cache_read", "prefix_cache_create", "prefix_output_tokens")


@dataclass
class Ingested:
    """What one batch adds: rows for chunks and quarantine, one row per session, and the documents' texts."""

    chunks: DataFrame
    quarantine: DataFrame
    sessions: DataFrame
    documents: DataFrame
    scanned: DataFrame
    fresh: DataFrame


def scanned_windows(turns: DataFrame, session: str = "session_id") -> DataFrame:
    """Windows with their members, content_hash (of the raw text), reason and matched; oversized turns as sub-chunks."""
    windows = windowing.turn_windows(turns, session, carry=CARRIED)
    plain = windows.filter(~F.col("oversized")).withColumns({"chunk_no": F.lit(0), "is_sub_chunk": F.lit(False)})
    cut = windowing.sub_chunks(windows.filter("oversized")).withColumn("is_sub_chunk", F.lit(True)).drop("start_char", "end_char")
    both = plain.unionByName(cut.select(plain.columns))
    verdict = privacy.scan(F.col("text"))
    return both.withColumns({"content_hash": F.sha2("text", 256), "_v": verdict}).withColumns({"reason": F.col("_v.reason"), "matched": F.col("_v.matched")}).drop("_v")


def documents(scanned: DataFrame, session: str = "session_id") -> DataFrame:
    """Each session's text: its windows without secrets, in order."""
    order = F.array_sort(F.collect_list(F.struct("first_turn", "last_turn", "chunk_no", "text")))
    joined = F.array_join(F.transform(order, lambda w: w["text"]), "\n\n")
    return scanned.filter("reason is null").groupBy(session).agg(texts.truncate_document(joined).alias("document"))


def chunk_role(roles: Column) -> Column:
    """The only turn's role, or mixed."""
    return F.when(F.size(roles) == 1, F.get(roles, F.lit(0))).otherwise("mixed")


def quarantine_rows(secret: DataFrame, table: str, path: Column, session: Column, batch: str) -> DataFrame:
    """Fingerprints of rows with reason and matched; one of each (path, content)."""
    rows = secret.select(
        F.lit(table).alias("source_table"), path.alias("source_path"), session.alias("session_id"), privacy.quarantined_content(F.col("reason"), F.col("matched")).alias("content"), "reason",
        privacy.matched_prefix(F.col("matched")).alias("matched_pattern"), F.lit(batch).alias("ingest_batch"),
    )
    return store.first_of_each(rows, ["source_path", F.md5("content")], [F.col("content").asc()])


def ingest(
    turns: DataFrame, stored: DataFrame | None, batch: str, session: str = "session_id", embedder: Embedder | None = None, prefixer: Prefixer | None = None, owner: str = "owner",
    facts: DataFrame | None = None, meta: DataFrame | None = None, scanned: DataFrame | None = None,
) -> Ingested:
    """turns (session, turn_index, role, text, occurred_at, tools_called, is_meta_message) against the stored (session, content_hash).

    prefixer: none says that prefixes weren't wanted (the flag stays null); one that returns null failed (false).
    facts, meta: what is known of each session beside its turns (started_at, ended_at, message_count, project_path,
    summary, ...; is_meta). scanned: the windows, where they have been made before.
    """
    embedder = embedder or HashEmbedder()
    scanned = scanned_windows(turns, session) if scanned is None else scanned
    # Of equal windows of a session the first is kept; a session may repeat one thousands of times.
    first = F.struct("first_turn", "last_turn", "chunk_no")
    others = [c for c in scanned.columns if c not in (session, "content_hash")]
    fresh = scanned.groupBy(session, "content_hash").agg(F.min_by(F.struct(*others), first).alias("_w")).select(session, "content_hash", "_w.*")
    if stored is not None:
        fresh = fresh.join(stored.select(session, "content_hash"), [session, "content_hash"], "left_anti")
    quarantine = quarantine_rows(fresh.filter("reason is not null"), "session_chunks", F.col(session).cast("string"), F.col(session), batch)
    kept, text = fresh.filter("reason is null"), documents(scanned, session)
    if prefixer is not None:
        kept = kept.join(text.select(session, prefixer.context(F.col("document")).alias("_context")), session, "left")
    prefix = F.lit(None).cast("string") if prefixer is None else prefixer.prefix(F.col("_context"), F.col("text"))
    kept = kept.withColumn("_prefix", prefix)
    if meta is not None:
        kept = kept.join(meta.select(session, F.col("is_meta").alias("_meta")), session, "left")
    members = lambda field: F.transform("members", lambda m: m[field])
    embedded = texts.sanitize(texts.with_prefix(F.col("_prefix"), F.col("text")))
    chunks = kept.withColumn("_embedded", embedded).select(
        F.sha2(F.concat_ws("|", F.col(session).cast("string"), "content_hash"), 256).alias("chunk_id"), session, F.col("first_turn").alias("turn_index"), chunk_role(members("role")).alias("role"),
        texts.sanitize(F.col("text")).alias("content"), "content_hash", embedder.embed(F.col("_embedded")).alias("embedding"), F.lit(batch).alias("ingest_batch"),
        F.get(members("occurred_at"), F.lit(0)).alias("occurred_at"), F.lit(owner).alias("owner"),
        F.struct(
            F.col("last_turn").alias("end_turn_index"), "window_size", F.flatten(members("tools_called")).alias("tools_called"), "is_sub_chunk", F.when(F.col("is_sub_chunk"), F.col("first_turn")).alias("parent_turn_index"),
            (F.coalesce("_meta", F.lit(False)) if meta is not None else F.lit(False)).alias("is_meta_file"), F.exists("members", lambda m: F.coalesce(m["is_meta_message"], F.lit(False))).alias("is_meta_message"),
        ).alias("metadata"),
        F.when(F.lit(prefixer is not None), F.col("_prefix").isNotNull()).alias("has_cr_prefix"), F.length("_embedded").cast("long").alias("embedded_chars"),
        F.when(F.col("_prefix").isNotNull(), texts.estimated_tokens(F.col("_prefix"))).otherwise(0).alias("prefix_tokens"),
    )
    if facts is None:
        facts = turns.groupBy(session).agg(F.min("occurred_at").alias("started_at"), F.max("occurred_at").alias("ended_at"), F.count(F.lit(1)).alias("message_count"))
    return Ingested(chunks, quarantine, facts.join(fresh.select(session).distinct(), session, "left_semi"), text, scanned, fresh)


def scanned_notes(notes: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Note chunks that aren't stored, with content_hash, reason and matched."""
    cut = windowing.markdown_chunks(notes).withColumn("content_hash", F.sha2("content", 256)).dropDuplicates(["source_path", "content_hash"])
    if stored is not None:
        cut = cut.join(stored.select("source_path", "content_hash"), ["source_path", "content_hash"], "left_anti")
    cut = cut.withColumn("_v", privacy.scan(F.col("content"))).withColumns({"reason": F.col("_v.reason"), "matched": F.col("_v.matched")})
    return cut.select("source_path", "source_type", "section_title", "content", "content_hash", "last_modified", "reason", "matched")


def split_notes(scanned: DataFrame, batch: str, embedder: Embedder | None = None) -> tuple[DataFrame, DataFrame]:
    """Scanned chunks as those without a secret (source_path, source_type, section_title, content, content_hash, embedding, last_modified), and the quarantine's rows of the others."""
    embedder = embedder or HashEmbedder()
    content = texts.sanitize(F.col("content"))
    kept = scanned.filter("reason is null").select("source_path", "source_type", "section_title", content.alias("content"), "content_hash", embedder.embed(F.col("content")).alias("embedding"), "last_modified", F.lit(batch).alias("ingest_batch"))
    return kept, quarantine_rows(scanned.filter("reason is not null"), "note_chunks", F.col("source_path"), F.lit(None).cast("string"), batch)


def ingest_notes(notes: DataFrame, stored: DataFrame | None, batch: str, embedder: Embedder | None = None) -> tuple[DataFrame, DataFrame]:
    """What a batch of notes adds: see split_notes."""
    return split_notes(scanned_notes(notes, stored), batch, embedder)
