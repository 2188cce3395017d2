"""Windows, ranking, stores, sampling, sources and streams on small inputs with known results."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import rank, sessions, store, windowing
from siltstone.plans import ingest, search
from siltstone.sources import exports, files, transcripts
from siltstone.streaming import ingest as streaming


def bounds(spark, lengths):
    got = spark.createDataFrame([(lengths,)], "n array<int>").select(windowing.window_bounds(F.col("n"))).first()[0]
    return [f"{w['first']}-{w['last']}" + ("S" if w["oversized"] else "") for w in got]


@pytest.mark.parametrize(
    ("lengths", "want"),
    [
        ([100], "0-0"), ([100] * 3, "0-2 2-2"), ([100] * 5, "0-4 4-4"), ([100] * 8, "0-7 7-7"), ([100] * 10, "0-7 7-9 9-9"), ([100] * 16, "0-7 7-14 14-15 15-15"), ([1200] * 6, "0-2 2-4 4-5 5-5"),
        ([1600] * 6, "0-2 2-4 4-5 5-5"), ([100, 4000, 100], "0-0 1-1S 2-2"), ([100, 100, 4000], "0-1 1-1 2-2S"), ([3100, 3100, 3100, 50], "0-2 2-3 3-3"), ([], ""),
    ],
)
def test_window_bounds(spark, lengths, want):
    assert " ".join(bounds(spark, lengths)) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a" * 4000, [(0, 3200), (3000, 4000)]), ("x" * 7000, [(0, 3200), (3000, 6200), (6000, 7000)]), ("a" * 2000 + "\n\n" + "b" * 2000, [(0, 2002), (1802, 4002)]),
        ("a" * 1000 + "\n\n" + "b" * 3000, [(0, 3200), (3000, 4002)]), ("a" * 3200 + "\n\n" + "b" * 100, [(0, 3202), (3002, 3302)]), ("", []),
    ],
)
def test_sub_chunks(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(windowing.sub_chunk_bounds(windowing.pages(F.col("t")), F.length("t"))).first()[0]
    assert [(b["start"], b["end"]) for b in got] == want


def test_long_texts_are_cut_page_by_page(spark):
    rnd = random.Random(4)
    text = "".join(rnd.choice(["word ", "é漢🙂", "\n", "\n\n", "x" * 700]) for _ in range(4000))
    rows = windowing.sub_chunks(spark.createDataFrame([(7, text, "kept")], "k int, t string, other string"), "t").orderBy("chunk_no").collect()
    start, want = 0, []
    while start < len(text):
        hard = min(start + 3200, len(text))
        end = hard
        if hard < len(text):
            at = text.rfind("\n\n", start, hard + 2)
            line = text.rfind("\n", start, hard + 1)
            end = at + 2 if at > start + 1600 else line + 1 if line > start + 1600 else hard
        want.append((start, min(end, len(text))))
        start = len(text) if end >= len(text) else end - 200 if end - 200 > start else end
    assert [(r.start_char, r.end_char) for r in rows] == want
    assert all(r.t == text[r.start_char : r.end_char] and r.other == "kept" for r in rows)


def test_windows_of_a_long_session(spark):
    """Ten thousand turns of one session, beside a session whose turns share an index."""
    long = [(1, k, f"turn {k} " + "y" * (k % 97) * 20, "user") for k in range(10_000)]
    odd = [(2, 0, "b", "user"), (2, 0, "a", "assistant"), (2, 1, "c", "user")]
    turns = spark.createDataFrame(long + odd, "session_id int, turn_index int, text string, role string").repartition(4)
    got = windowing.turn_windows(turns, carry=("role",))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    found = got.collect()
    texts = [t for _, _, t, _ in long]
    one = [r for r in found if r.session_id == 1]
    assert all(r.text == "\n\n".join(texts[r.first_turn : r.last_turn + 1]) and len(r.members) == r.window_size for r in one)
    assert {k for r in one for k in range(r.first_turn, r.last_turn + 1)} == set(range(10_000))
    assert {(r.text, tuple(m.role for m in r.members)) for r in found if r.session_id == 2 and r.first_turn == 0} == {("a\n\nb\n\nc", ("assistant", "user", "user"))}


def test_fusion(spark):
    lex = spark.createDataFrame([(1, 1), (2, 2)], "chunk_id long, rank long")
    sem = spark.createDataFrame([(1, 1), (3, 2)], "chunk_id long, rank long")
    fused = rank.fuse(lex, sem)
    got = {r.chunk_id: r.score for r in fused.collect()}
    assert abs(got[1] - 2 / 61) < 1e-12 and abs(got[2] - 1 / 62) < 1e-12 and abs(got[3] - 1 / 62) < 1e-12
    dates = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-03"), (3, None), (9, "2025-01-01")], "chunk_id long, d string")
    got = {r.chunk_id: (r.rc_rank, r.score) for r in rank.add_recency(fused, dates, F.col("d"), 1.0).collect()}
    assert {k: v[0] for k, v in got.items()} == {2: 1, 1: 2, 3: 3} and abs(got[1][1] - (2 / 61 + 1 / 62)) < 1e-12
    assert [r.chunk_id for r in rank.best(fused, 2).orderBy("place").collect()] == [1, 2]


def test_zero_weights_still_return_rows(spark):
    chunks = spark.createDataFrame([(1, "alpha beta", [1.0, 0.0]), (2, "beta", [0.0, 1.0]), (3, "gamma", None)], "chunk_id long, content string, embedding array<float>")
    got = search.hybrid_search(chunks, "beta", [1.0, 0.0], full_text_weight=0, semantic_weight=0).collect()
    assert {r.chunk_id for r in got} == {1, 2} and all(r.score == 0 for r in got)


def test_modes():
    assert search.resolve_mode("auto", "what is the current state") == "current" and search.resolve_mode("auto", "how it works") == "balanced" and search.resolve_mode("balanced", "now") == "balanced"
    with pytest.raises(ValueError):
        search.resolve_mode("fast", "x")


def test_top_k_is_pushed_below_the_rank(spark):
    rows = spark.range(1000).select(F.col("id").alias("chunk_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    plan = rank.semantic_topk(rows, [1.0, 0.0], 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Cartesian" not in plan


def test_store(spark):
    stored = spark.createDataFrame([("s", "h1", "old")], "session string, hash string, v string")
    new = spark.createDataFrame([("s", "h1", "x"), ("s", "h2", "y"), ("s", "h2", "y")], stored.schema)
    assert [(r.hash, r.v) for r in store.new_rows(new, stored, ["session", "hash"]).collect()] == [("h2", "y")]
    rows = spark.createDataFrame([(1, "a", "k1"), (2, "b", "k2")], "id int, v string, other string")
    change = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, v string, at int")
    assert {(r.id, r.v, r.other) for r in store.upsert(rows, change, "id", F.col("at"), ["v"]).collect()} == {(1, "a", "k1"), (2, "d", "k2"), (3, "e", None)}
    q = spark.createDataFrame([("p", "c", 2, 7), ("p", "c", 1, 9), ("p", "d", 1, 1)], "source_path string, content string, created_at int, quarantine_id int")
    assert {r.quarantine_id for r in store.quarantine_distinct(q).collect()} == {9, 1}


def test_sampling(spark):
    rows = lambda n: spark.createDataFrame([("s", k, "decided" if k == 50 else f"turn {k}") for k in range(n)], "session_id string, turn_index int, content string")
    assert sessions.distill_sample(rows(30)).count() == 30
    got = {r.turn_index for r in sessions.distill_sample(rows(100), most=8).collect()}
    assert {0, 99, 50} <= got and len(got) <= 10
    grid = {int(i * 99 / 11 + 0.5) for i in range(12)} | {50}
    assert {r.turn_index for r in sessions.distill_sample(rows(100)).collect()} == grid


def test_listing_puts_unknown_starts_first(spark):
    rows = spark.createDataFrame([(1, "2024-01-01"), (2, None), (3, "2024-02-01")], "session_id int, started_at string")
    assert [r.session_id for r in sessions.list_sessions(rows).collect()] == [2, 3, 1]


def test_transcript_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    lines = [
        {"type": "user", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "user", "content": "hello"}}, {"type": "message", "id": "x", "message": {"role": "assistant", "content": [{"type": "text", "text": "hi"}]}},
        {"type": "summary", "summary": "so far"}, {"type": "system"}, {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "image"}]}},
    ]
    (tmp_path / "deep" / "s1.jsonl").write_text("\n".join([*map(json.dumps, lines), "", "not json", '{"no":"type"}']))
    (tmp_path / "note.txt").write_text("no")
    parsed = transcripts.parse(transcripts.lines(spark, str(tmp_path)))
    assert transcripts.bad_lines(parsed).count() == 2
    got = [(r.session_id, r.turn_index, r.role, r.text) for r in transcripts.to_turns(parsed, "siltstone").orderBy("turn_index").collect()]
    assert got == [("s1", 0, "user", "hello"), ("s1", 1, "assistant", "hi"), ("s1", 2, "compaction", "[Compaction Summary] so far")]
    assert transcripts.lines(spark, str(tmp_path), most_bytes=10).count() == 0


def test_graph_falls_back_to_time(spark):
    node = lambda i, t, role="user": {"id": i, "message": {"author": {"role": role}, "create_time": t, "content": {"parts": [f"text {i}", {"image": 1}]}}}
    conversation = {"id": "c", "title": "t", "current_node": "gone", "mapping": {"b": node("b", 2.0), "a": node("a", 1.0), "s": node("s", 0.0, "system"), "root": {"id": "root"}}}
    loop = {"id": "d", "current_node": "x", "mapping": {"x": {**node("x", 1.0), "parent": "y"}, "y": {**node("y", 2.0), "parent": "x"}}}
    rows = spark.createDataFrame([(json.dumps([conversation, loop]),)], "json string")
    got = [(r.session_id, r.turn_index, r.text) for r in exports.graph_chats(rows).orderBy("session_id", "turn_index").collect()]
    assert got == [("c", 0, "text a"), ("c", 1, "text b"), ("d", 0, "text y"), ("d", 1, "text x")]


def test_notes_and_lists(spark, tmp_path):
    for name, body in [("a.md", "# Title\nbody"), ("MEMORY.md", "no"), ("handoff-1.md", "x" * 30), ("b.txt", "no")]:
        (tmp_path / name).write_text(body)
    got = files.notes(spark, str(tmp_path))
    assert {r.source_type for r in got.collect()} == {"memory", "handoff"} and got.count() == 2
    cut = windowing.markdown_chunks(got).collect()
    assert {r.section_title for r in cut} == {"Title", None}
    (tmp_path / "terms").write_text("# comment\n\n one \ntwo\n")
    assert files.term_list(spark, str(tmp_path / "terms")) == ["one", "two"]
    some = [files.Source("a", "notes", "/x", "m")]
    assert files.sources(some, label="a") == some
    with pytest.raises(ValueError):
        files.sources(some, label="b")


def test_ingest_twice_adds_nothing(spark):
    rows = [("s", k, "user", f"turn {k} " + ("password=hunter2abc" if k == 9 else ""), f"2024-01-0{k % 9 + 1}", [], False) for k in range(12)]
    turns = spark.createDataFrame(rows, "session_id string, turn_index int, role string, text string, occurred_at string, tools_called array<string>, is_meta_message boolean")
    one = ingest.ingest(turns, None, "b1")
    chunks = one.chunks.collect()
    assert chunks and one.quarantine.count() >= 1 and all("hunter2" not in r.content for r in chunks) and one.sessions.count() == 1
    assert "hunter2" not in one.documents.first()["document"]
    stored = one.chunks.select("session_id", "content_hash")
    assert ingest.ingest(turns, stored, "b2").chunks.count() == 0
    assert {r.role for r in chunks} == {"mixed", "user"} or {r.role for r in chunks} == {"mixed"}


def test_stream_appends_each_key_once(spark, tmp_path):
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "k long, v string"
    for batch in ([(1, "a"), (1, "b")], [(1, "c"), (2, "d")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        streaming.append_new(streaming.new_files(spark, source, schema), target, ["k"], check).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(target).collect()) == [1, 2]


def test_interleave_and_split(spark):
    lists = [spark.createDataFrame([(f"{n}{k}", k) for k in range(1, 4)], "id string, place long") for n in "ab"]
    assert [r.id for r in rank.interleave(lists).orderBy("at").collect()] == ["a1", "b1", "a2", "b2", "a3", "b3"]
    assert [r.id for r in search.search_all(*lists, limit=4).orderBy("at").collect()] == ["a1", "a2", "b1", "b2"]
    assert search.overfetch(10, True) == 20 and search.overfetch(20, True) == 30 and search.overfetch(10, False) == 10


def test_embed_batches_run_on_over_blocks_of_ids(spark, tmp_path):
    from siltstone.plans import catalog

    rnd = random.Random(3)
    ids = [*range(99_900, 100_150), 200_001, 200_002, *range(300_000, 300_040), *range(400_000, 400_003), *range(500_000, 500_100)]
    rows = [(k, f"s{k % 2}", None if k % 41 == 0 else "x" * rnd.choice([0, 10, 3_000, 9_000, 30_000, 80_000])) for k in ids]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want, open_ = [], {}
    for k, source, text in rows:
        n = math.ceil(len(text or "") / 3.5)
        batch, items, tokens = open_.get(source, (0, 0, 0))
        full = items > 0 and (items >= 16 or tokens + n > 20_000)
        open_[source] = (batch + 1, 1, n) if full else (batch, items + 1, tokens + n)
        want.append((source, k, open_[source][0]))
    assert sorted(map(tuple, catalog.embed_batches(spark, str(tmp_path)).collect())) == sorted(want)
