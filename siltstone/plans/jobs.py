"""Jobs over a store folder: ingest a source or one file, distil summaries, load the demo corpus.

A store holds sessions.parquet, session_chunks.parquet, note_chunks.parquet, quarantine.parquet and
ingest_runs.parquet. Chunks, quarantine and the states of runs are appended, rows whose key is there are left out; the few
session rows are rewritten. A job that runs again adds nothing. Windows are written once to a work folder of the store,
which every later step reads; what a write added is counted while it is written.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as texts
from ..operators import sessions as session_ops
from ..operators import store
from ..sources import exports, files, transcripts
from . import ingest
from .providers import CutSummary, Embedder, HashEmbedder, Prefixer, Summarizer


def stored(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A table of the store, or nothing before its first write."""
    path = f"{folder}/{name}.parquet"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at) else None


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _rewrite(spark: SparkSession, folder: str, name: str, rows: DataFrame) -> None:
    """Replace a small table that rows are made from: written beside it first."""
    rows.write.mode("overwrite").parquet(f"{folder}/.{name}.parquet")
    spark.read.parquet(f"{folder}/.{name}.parquet").write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


@dataclass
class Read:
    """What a source holds: its turns, and of transcripts also the facts and flags of each session and the lines that were skipped."""

    turns: DataFrame
    facts: DataFrame | None = None
    meta: DataFrame | None = None
    bad: DataFrame | None = None


def _written(rows: DataFrame, path: str) -> DataFrame:
    """rows, worked out once."""
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def read_source(spark: SparkSession, source: files.Source, product: str, most_bytes: int | None = None, most_files: int | None = None, work: str | None = None) -> Read:
    """A source's turns: session_id, turn_index, role, text, occurred_at, tools_called, is_meta_message. Of transcripts, the entries and turns are kept in the work folder, if there is one: each file is then read once."""
    if source.kind in {"transcripts", "transcripts-flat"}:
        parsed = transcripts.parse(transcripts.lines(spark, source.root, source.kind == "transcripts", most_bytes, most_files))
        if work is not None:
            parsed = _written(parsed.withColumn("line", F.when(F.col("entry").isNull(), F.col("line"))), f"{work}/parsed.parquet")
        sizes = parsed.groupBy("session_id").agg(F.min("source_path").alias("source_path"), F.max("byte_size").alias("byte_size"))
        facts = transcripts.session_facts(parsed).join(sizes, "session_id")
        meta = transcripts.meta_sessions(parsed.filter("entry is not null"), product)
        turns = transcripts.to_turns(parsed, product)
        return Read(turns if work is None else _written(turns, f"{work}/turns.parquet"), facts, meta, transcripts.bad_lines(parsed))
    whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(source.root, wholetext=True)
    rows = whole.select(F.col("value").alias("json"), F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("folder"))
    read: dict[str, Callable[[], DataFrame]] = {
        "web-export": lambda: exports.web_chats(rows), "graph-export": lambda: exports.graph_chats(rows), "messenger-export": lambda: exports.messenger_chats(rows, folder="folder"),
    }
    turns = read[source.kind]().withColumns({"tools_called": F.array().cast("array<string>"), "is_meta_message": F.lit(False)})
    facts = turns.groupBy("session_id").agg(F.min("occurred_at").alias("started_at"), F.max("occurred_at").alias("ended_at"), F.count(F.lit(1)).alias("message_count"), F.first("title", True).alias("summary"))
    return Read(turns.drop("title"), facts)


RUN = (
    "run_id string, ingest_batch string, source_label string, status string, started_at string, updated_at string, files_total long, files_done long, files_failed long, bad_lines long, sessions long, "
    + ", ".join(f"{t} long" for t in ingest.TOTALS) + ", error_summary string"
)


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


class Run:
    """One ingest run: every state is appended, with its time; the last one of a run counts (see runs)."""

    def __init__(self, spark: SparkSession, folder: str, batch: str, label: str, silent: bool):
        self.spark, self.path, self.silent = spark, f"{folder}/ingest_runs.parquet", silent
        self.record = {"run_id": uuid.uuid4().hex, "ingest_batch": batch, "source_label": label, "started_at": _now(), "files_total": 0, "files_done": 0, "files_failed": 0, "bad_lines": 0, "sessions": 0, **dict.fromkeys(ingest.TOTALS, 0)}

    def tell(self, status: str, **known: int | str | None) -> dict:
        if status not in {"running", "completed", "failed", "partial"}:
            raise ValueError(f"unknown status {status}")
        self.record |= {**known, "status": status, "updated_at": _now()}
        if not self.silent:
            self.spark.createDataFrame([self.record], RUN).coalesce(1).write.mode("append").parquet(self.path)
        return dict(self.record)


def runs(states: DataFrame) -> DataFrame:
    """The last state of each run."""
    last = states.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in states.columns if c != "run_id"]), "updated_at").alias("s"))
    return last.select("run_id", "s.*")


def _append(rows: DataFrame, path: str, keep: bool, **sums: Column) -> dict:
    """Append rows, and what was written: their number and sums, observed on the way. Without keep nothing is written."""
    seen = Observation()
    watched = rows.observe(seen, F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in sums.items()])
    if keep:
        watched.write.mode("append").parquet(path)
    else:
        watched.write.format("noop").mode("overwrite").save()
    return seen.get


def ingest_source(
    spark: SparkSession, source: files.Source, folder: str, batch: str, product: str, embedder: Embedder | None = None, prefixer: Prefixer | None = None, dry_run: bool = False, **caps: int | None,
) -> dict:
    """Ingest one source into the store; returns the run's record, whose states the store keeps too. Without a prefixer, prefixes are skipped."""
    run = Run(spark, folder, batch, source.label, dry_run)
    work = f"{folder}/.work/{run.record['run_id']}"
    run.tell("running")
    try:
        found = _ingest_notes if source.kind == "notes" else _ingest_turns
        known = found(spark, source, folder, work, batch, product, embedder or HashEmbedder(), None if dry_run else prefixer, dry_run, run, **caps)
    except Exception as e:
        run.tell("failed", error_summary=str(e)[:500])
        raise
    finally:
        _remove(spark, work)
    return run.tell("partial" if known["bad_lines"] else "completed", **known)


def _ingest_notes(spark, source, folder, work, batch, product, embedder, prefixer, dry_run, run, **caps) -> dict:
    seen = Observation()
    notes = files.notes(spark, source.root).observe(seen, F.count(F.lit(1)).alias("n"))
    scanned = _written(ingest.scanned_notes(notes, stored(spark, folder, "note_chunks")), f"{work}/scanned.parquet")
    total = seen.get["n"]
    run.tell("running", files_total=total)
    rows, secret = ingest.split_notes(scanned, batch, embedder)
    rows = rows.select(F.xxhash64("source_path", "content_hash").alias("chunk_id"), "*", F.lit("owner").alias("owner"), F.lit(source.machine).alias("source_machine"), F.current_timestamp().alias("updated_at"))
    # The quarantine first: its plan reads the chunks as they were.
    secret = _append(_unseen_secrets(spark, folder, secret), f"{folder}/quarantine.parquet", not dry_run)
    added = _append(rows, f"{folder}/note_chunks.parquet", not dry_run, chars=F.length("content"), tokens=texts.estimated_tokens(F.col("content")))
    new = added["n"] + secret["n"]
    return {
        "files_total": total, "files_done": total, "bad_lines": 0, "windows_total": new, "windows_new": new, "windows_quarantined": secret["n"], "windows_inserted": added["n"],
        "chars_embedded": added["chars"], "embed_tokens": added["tokens"],
    }


def _unseen_secrets(spark: SparkSession, folder: str, secret: DataFrame) -> DataFrame:
    held = stored(spark, folder, "quarantine")
    return secret if held is None else store.new_rows(secret, held, ["source_path", "content"])


def _ingest_turns(spark, source, folder, work, batch, product, embedder, prefixer, dry_run, run, **caps) -> dict:
    read = read_source(spark, source, product, work=work, **caps)
    scanned_at = f"{work}/scanned.parquet"
    total = _append(ingest.scanned_windows(read.turns), scanned_at, True)["n"]
    sessions_seen = read.facts.count()
    bad = 0 if read.bad is None else read.bad.count()
    run.tell("running", files_total=sessions_seen, windows_total=total, bad_lines=bad)
    scanned = spark.read.parquet(scanned_at)
    added = ingest.ingest(read.turns, stored(spark, folder, "session_chunks"), batch, embedder=embedder, prefixer=prefixer, facts=read.facts, meta=read.meta, scanned=scanned)
    new = added.fresh.count()
    stamp = {"source_machine": F.lit(source.machine), "updated_at": F.current_timestamp()}
    if not dry_run:
        fresh = added.sessions.withColumns({**stamp, "ingest_batch": F.lit(batch), "owner": F.lit("owner")})
        for name in ("project_path", "summary", "source_path"):
            fresh = fresh if name in fresh.columns else fresh.withColumn(name, F.lit(None).cast("string"))
        fresh = fresh if "byte_size" in fresh.columns else fresh.withColumn("byte_size", F.lit(None).cast("long"))
        known = stored(spark, folder, "sessions")
        # A summary that is there stays: only the facts of the new files are supplied.
        facts = ["started_at", "ended_at", "message_count", "project_path", "source_path", "byte_size", "source_machine", "ingest_batch", "updated_at"]
        # Sessions and quarantine come first: their plans read the chunks as they were.
        _rewrite(spark, folder, "sessions", fresh if known is None else store.upsert(known, fresh, "session_id", F.col("ended_at"), facts))
    secret = _append(_unseen_secrets(spark, folder, added.quarantine), f"{folder}/quarantine.parquet", not dry_run)
    chunks = added.chunks.withColumns({"is_meta_message": F.col("metadata.is_meta_message"), "is_meta_file": F.col("metadata.is_meta_file"), **stamp})
    sums = _append(
        chunks, f"{folder}/session_chunks.parquet", not dry_run, chars=F.col("embedded_chars"), tokens=F.ceil(F.col("embedded_chars") / F.lit(3.5)).cast("long"), told=F.col("prefix_tokens"),
        asked=F.when(F.coalesce("has_cr_prefix", F.lit(False)), texts.estimated_tokens(F.col("content"))).otherwise(0),
    )
    return {
        "files_total": sessions_seen, "files_done": sessions_seen, "sessions": sessions_seen, "bad_lines": bad, "windows_total": total, "windows_new": new, "windows_quarantined": secret["n"], "windows_inserted": sums["n"],
        "chars_embedded": sums["chars"], "embed_tokens": sums["tokens"], "prefix_input_tokens": sums["asked"], "prefix_output_tokens": sums["told"],
    }


def ingest_sources(spark: SparkSession, sources: list[files.Source], folder: str, batch: str, product: str, **options) -> list[dict]:
    """All sources; one that fails is recorded, in the store too, and doesn't stop the others."""
    records = []
    for source in sources:
        try:
            records.append(ingest_source(spark, source, folder, batch, product, **options))
        except Exception as e:
            records.append({"ingest_batch": batch, "source_label": source.label, "status": "failed", "error_summary": str(e)[:500]})
    return records


def ingest_file(spark: SparkSession, path: str, folder: str, batch: str, product: str, local_prefixes: list[str] | None = None, **options) -> dict:
    """Ingest one transcript file, as a hook at a session's end does."""
    machine = "local" if any(path.startswith(p) for p in local_prefixes or []) else "unknown"
    return ingest_source(spark, files.Source(f"incremental-{machine}", "transcripts-flat", path, machine), folder, batch, product, **options)


def grand_totals(records: list[dict]) -> dict:
    """The ten sums over runs."""
    return {t: sum(r.get(t) or 0 for r in records) for t in ingest.TOTALS}


#: Fixed value: a session's first chunks that a summary is made from.
DISTILLED = 2000


def summaries(sessions: DataFrame, chunks: DataFrame, summarizer: Summarizer, embedder: Embedder, limit: int | None = None) -> DataFrame:
    """(session_id, prompt, summary, summary_embedding) of the sessions without a summary's embedding, newest first where there is a limit."""
    missing = sessions.filter(F.col("summary_embedding").isNull())
    if limit is not None:
        missing = missing.orderBy(F.desc_nulls_last("started_at"), "session_id").limit(limit)
    own = chunks.join(missing.select("session_id"), "session_id", "left_semi")
    first = own.withColumn("_rn", F.row_number().over(Window.partitionBy("session_id").orderBy("turn_index", "chunk_id"))).filter(F.col("_rn") <= DISTILLED).drop("_rn")
    prompts = session_ops.distill_prompt(session_ops.distill_sample(first))
    return prompts.withColumn("summary", summarizer.summary(F.col("prompt"))).withColumn("summary_embedding", embedder.embed(F.col("summary")))


def distil(spark: SparkSession, folder: str, embedder: Embedder | None = None, summarizer: Summarizer | None = None, limit: int | None = None, dry_run: bool = False) -> int:
    """Summaries for the sessions whose summary has no embedding; a dry run only counts them."""
    sessions, chunks = stored(spark, folder, "sessions"), stored(spark, folder, "session_chunks")
    if "summary_embedding" not in sessions.columns:
        sessions = sessions.withColumn("summary_embedding", F.lit(None).cast("array<float>"))
    made = summaries(sessions, chunks, summarizer or CutSummary(), embedder or HashEmbedder(), limit).select("session_id", "summary", "summary_embedding")
    if dry_run:
        return made.count()
    work = f"{folder}/.work/{uuid.uuid4().hex}"
    n = _append(made, work, True)["n"]
    _rewrite(spark, folder, "sessions", store.patch(sessions, spark.read.parquet(work), "session_id"))
    _remove(spark, work)
    return n


def demo_corpus(spark: SparkSession, path: str, vectors: dict[str, list[float]] | None = None) -> DataFrame:
    """A demo corpus file's chunks, with the vector of each content's sha256 where the map has one."""
    rows = spark.read.option("multiLine", "true").json(path)
    s = rows.select("owner", F.explode("sessions").alias("s")).select("owner", "s.session_id", "s.started_at", F.explode("s.chunks").alias("c"))
    chunks = s.select("owner", "session_id", "c.turn_index", "c.role", "c.occurred_at", "c.content", F.sha2("c.content", 256).alias("content_hash"))
    known = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in (vectors or {}).items()], "content_hash string, embedding array<float>")
    return chunks.join(known, "content_hash", "left")


def sources_from(path: str) -> list[files.Source]:
    """Sources from a JSON list of {label, kind, root, machine}."""
    with open(path) as f:
        return [files.Source(**x) for x in json.load(f)]
