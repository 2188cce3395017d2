"""Ingest jobs over a store folder: twice the same source, secrets, failures, summaries."""

import json

from pyspark.sql import functions as F

from siltstone.plans import jobs
from siltstone.plans.providers import CutSummary, Extractive, FallbackAnswer, FallbackPrefix, FallbackSummary, TemplatePrefix
from siltstone.sources.files import Source


def test_ingest_and_distil(spark, tmp_path):
    root, folder = tmp_path / "in", str(tmp_path / "store")
    root.mkdir()
    entries = [{"type": "user" if k % 2 == 0 else "assistant", "timestamp": f"2024-01-01T00:00:{k:02d}Z", "message": {"role": "x", "content": f"turn number {k}" if k % 2 == 0 else [{"type": "text", "text": f"answer {k}"}]}} for k in range(10)]
    (root / "s1.jsonl").write_text("\n".join(map(json.dumps, entries)))
    (root / "s2.jsonl").write_text(json.dumps({"type": "user", "timestamp": "2024-01-02T00:00:00Z", "message": {"role": "user", "content": "passwd: s3cr3t-value-99"}}))
    notes = tmp_path / "notes"
    notes.mkdir()
    (notes / "a.md").write_text("# A note\nwith words")
    (notes / "b.md").write_text("# Another\npasswd: s3cr3t-value-77")
    sources = [Source("t", "transcripts", str(root), "box"), Source("n", "notes", str(notes), "box"), Source("bad", "transcripts", str(tmp_path / "none"), "box")]
    first = jobs.ingest_sources(spark, sources, folder, "b1", "siltstone")
    assert [r["status"] for r in first] == ["completed", "completed", "failed"]
    assert first[0]["windows_inserted"] == 3 and first[0]["windows_quarantined"] == 1 and first[0]["sessions"] == 2 and first[1]["windows_inserted"] == 1 and first[1]["windows_quarantined"] == 1
    again = jobs.ingest_sources(spark, sources[:2], folder, "b2", "siltstone")
    assert [r["windows_inserted"] for r in again] == [0, 0] and [r["windows_quarantined"] for r in again] == [0, 0]
    chunks = jobs.stored(spark, folder, "session_chunks")
    assert chunks.count() == 3 and chunks.filter("content like '%s3cr3t%'").count() == 0 and {r.role for r in chunks.collect()} == {"mixed", "assistant"}
    held = {(r.source_table, r.session_id) for r in jobs.stored(spark, folder, "quarantine").collect()}
    assert held == {("session_chunks", "s2"), ("note_chunks", None)} and jobs.stored(spark, folder, "note_chunks").filter("content like '%s3cr3t%'").count() == 0
    states = jobs.runs(jobs.stored(spark, folder, "ingest_runs")).collect()
    assert sorted(r.status for r in states) == ["completed"] * 4 + ["failed"] and all(r.error_summary for r in states if r.status == "failed")
    assert jobs.stored(spark, folder, "ingest_runs").filter("status = 'running'").count() >= 5
    assert jobs.grand_totals(first)["windows_inserted"] == 4 and jobs.grand_totals(first)["chars_embedded"] > 0
    assert jobs.distil(spark, folder) == 1 and jobs.distil(spark, folder) == 0
    s = {r.session_id: r.summary for r in jobs.stored(spark, folder, "sessions").collect()}
    assert set(s) == {"s1", "s2"} and s["s1"].startswith("[turn 0]") and s["s2"] is None


def test_one_file_with_facts_flags_and_prefixes(spark, tmp_path):
    folder, path = str(tmp_path / "store"), tmp_path / "deep" / "s9.jsonl"
    path.parent.mkdir()
    tool = [{"type": "text", "text": "looking"}, {"type": "tool_use", "id": "1", "name": "search_all", "input": {"query": "x"}}]
    entries = [{"type": "user", "timestamp": f"2024-03-01T00:00:0{k}Z", "cwd": None if k == 0 else f"/work/p{k}", "message": {"role": "user", "content": f"question {k}"}} for k in range(4)]
    entries += [{"type": "assistant", "timestamp": f"2024-03-01T00:01:0{k}Z", "message": {"role": "assistant", "content": tool}} for k in range(3)]
    entries += [{"type": "ai-title", "aiTitle": "first title"}, {"type": "ai-title", "aiTitle": "Last title"}]
    path.write_text("\n".join([*map(json.dumps, entries), "no json"]))
    dry = jobs.ingest_file(spark, str(path), folder, "b0", "siltstone", dry_run=True)
    assert dry["windows_inserted"] > 0 and jobs.stored(spark, folder, "session_chunks") is None and jobs.stored(spark, folder, "ingest_runs") is None
    got = jobs.ingest_file(spark, str(path), folder, "b1", "siltstone", local_prefixes=[str(tmp_path)], prefixer=TemplatePrefix())
    assert got["source_label"] == "incremental-local" and got["status"] == "partial" and got["bad_lines"] == 1 and got["prefix_output_tokens"] > 0
    s = jobs.stored(spark, folder, "sessions").first()
    assert (s.project_path, s.summary, s.message_count, s.started_at, s.ended_at) == ("/work/p1", "Last title", 9, "2024-03-01T00:00:00Z", "2024-03-01T00:01:02Z") and s.byte_size > 0
    chunks = jobs.stored(spark, folder, "session_chunks").collect()
    assert all(c.is_meta_file and c.has_cr_prefix and c.updated_at is not None for c in chunks) and any("search_all" in c.metadata.tools_called for c in chunks)
    # The summary stands, but it has no embedding yet.
    assert jobs.distil(spark, folder, dry_run=True) == 1 and jobs.distil(spark, folder, limit=1) == 1 and jobs.distil(spark, folder) == 0


def test_providers_fall_back(spark):
    class Failing:
        def context(self, document):
            return F.lit(None).cast("string")

        def prefix(self, context, chunk):
            return F.lit(None).cast("string")

        def summary(self, prompt):
            return F.lit(None).cast("string")

        def answer(self, hits):
            return hits.agg(F.lit(None).cast("string").alias("answer"))

    hits = spark.createDataFrame([(1, "one"), (2, "two")], "n int, content string")
    assert FallbackAnswer(Failing(), Extractive()).answer(hits).first()["answer"] == "one [1]\ntwo [2]"
    p = FallbackPrefix(Failing(), TemplatePrefix())
    row = hits.select(p.prefix(p.context(F.col("content")), F.col("content")).alias("a"), FallbackSummary(Failing(), CutSummary()).summary(F.col("content")).alias("b")).first()
    assert (row.a, row.b) == ("From a conversation that begins: one", "one")


def test_demo_corpus(spark, tmp_path):
    import hashlib

    path = tmp_path / "corpus.json"
    path.write_text(json.dumps({"owner": "demo", "sessions": [{"session_id": "s", "summary": "x", "started_at": "2024", "chunks": [{"turn_index": 0, "role": "user", "occurred_at": "2024", "content": "hello"}, {"turn_index": 1, "role": "user", "occurred_at": "2024", "content": "bye"}]}]}))
    got = jobs.demo_corpus(spark, str(path), {hashlib.sha256(b"hello").hexdigest(): [1.0, 0.0]}).orderBy("turn_index").collect()
    assert [(r.content, r.embedding) for r in got] == [("hello", [1.0, 0.0]), ("bye", None)]
