"""Command line over stored tables: python -m siltstone.cli STORE COMMAND [arguments] [--flags].

STORE is a folder with sessions.parquet, session_chunks.parquet and note_chunks.parquet. Commands: search,
answer, list, get, replay, stats (--health --logs=FOLDER --days=N: totals of the ingest logs), ingest (SOURCES.json or
--file=PATH, --batch, --source, --dry-run, --skip-contextual, --max-files, --max-file-bytes), distil (--dry-run, --sample,
--apply, --limit), pickaxe (--out=FOLDER; exit code 1 where a text holds a listed term). search and answer: --english for stems.
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .functions.analytics import hour_age
from .functions.arguments import parse_flags
from .functions.text import leak_hits
from .plans.providers import HashEmbedder, OverlapReranker, TemplatePrefix
from .plans.search import resolve_mode
from .sources.files import log_files, log_health, term_list


def open_store(spark: SparkSession, folder: str) -> api.Engine:
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    return api.Engine(read("sessions"), read("session_chunks"), read("note_chunks"), HashEmbedder(), OverlapReranker())


def pickaxe(texts: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """(every column but the text, term, line) of each hit."""
    return texts.select("*", F.explode(leak_hits(F.col(text), terms)).alias("_h")).select(*[c for c in texts.columns if c != text], "_h.term", "_h.line")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    positional, flags = parse_flags(sys.argv[1:] if argv is None else argv)
    if len(positional) < 2:
        print(__doc__)
        return 2
    folder, command, *rest = positional
    spark = spark or SparkSession.builder.appName("siltstone").getOrCreate()
    if command == "pickaxe":
        terms = term_list(spark, str(flags["denylist"])) if "denylist" in flags else []
        hits = pickaxe(spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")), terms)
        lines = hits.select(F.to_json(F.struct("*")).alias("value"))
        if "out" in flags:
            lines.write.mode("overwrite").text(str(flags["out"]))
            return int(bool(spark.read.text(str(flags["out"])).take(1)))
        any_ = 0
        for r in lines.toLocalIterator():  # a partition at a time
            print(json.dumps(json.loads(r[0]), ensure_ascii=False))
            any_ = 1
        return any_
    if command in {"ingest", "distil"}:
        from .plans import jobs
        from .sources.files import sources

        if command == "distil":
            # A sample is a few of the newest; nothing is written but where it is asked for or no flag is given.
            limit = int(flags["limit"]) if "limit" in flags else 5 if "sample" in flags else None
            dry = bool(flags.get("dry-run")) or ("sample" in flags and "apply" not in flags)
            print(json.dumps({"summaries": jobs.distil(spark, folder, limit=limit, dry_run=dry), "written": not dry}))
            return 0
        caps = {name: int(flags[flag]) for name, flag in (("most_files", "max-files"), ("most_bytes", "max-file-bytes")) if flag in flags}
        batch, product = str(flags.get("batch", "batch")), str(flags.get("product", "siltstone"))
        options = {"dry_run": bool(flags.get("dry-run")), "prefixer": None if "skip-contextual" in flags else TemplatePrefix()}
        if "file" in flags:
            records = [jobs.ingest_file(spark, str(flags["file"]), folder, batch, product, **options)]
        else:
            records = jobs.ingest_sources(spark, sources(jobs.sources_from(rest[0]), label=flags.get("source")), folder, batch, product, **options, **caps)
        print(json.dumps({"runs": records, "totals": jobs.grand_totals(records)}, indent=2))
        return int(any(r["status"] == "failed" for r in records))
    if command == "stats" and "health" in flags:
        from datetime import datetime, timedelta, timezone

        since = datetime.now(timezone.utc) - timedelta(days=int(flags.get("days", 7)))
        health = log_health(log_files(spark, str(flags["logs"]), since.strftime("%Y-%m-%dT%H:%M:%S")))
        print(api.envelope(health.withColumn("unpaid_hours_ago", hour_age(F.col("latest_unpaid"), F.current_timestamp())), "stats"))
        return 0
    engine = open_store(spark, folder)
    engine.config = "english" if flags.get("english") else "simple"
    number = lambda key: int(flags[key]) if key in flags else None
    mode = "current" if flags.get("current") else "balanced" if flags.get("balanced") else "auto"
    if command == "search":
        hits = engine.search_sessions(rest[0], number("limit"), bool(flags.get("rerank")), bool(flags.get("hide-meta")), mode)
        print(api.envelope(hits, resolve_mode(mode, rest[0])))
    elif command == "answer":
        print(json.dumps(engine.answer(rest[0], match_count=number("limit"), search_mode=mode), indent=2, ensure_ascii=False, default=str))
    elif command in {"list", "get", "replay", "stats"}:
        since, project = flags.get("since"), flags.get("project")
        rows = {
            "list": lambda: engine.list_sessions(since, project, number("limit"), number("offset")), "get": lambda: engine.get_session(rest[0]),
            "replay": lambda: engine.replay_session(rest[0], int(rest[1]), number("window")), "stats": engine.stats,
        }[command]()
        print(api.envelope(rows, mode))
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
