"""The tools and the command line over a small store; the registered queries against their SQL."""

import json
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from siltstone import api, cli
from siltstone.plans import catalog, catalog_jobs  # noqa: F401 - registers its queries
from siltstone.plans.providers import HashEmbedder, OverlapReranker

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("store"))
    embed = HashEmbedder().embed(F.col("content"))
    texts = ["we moved the cache to redis", "the cache was slow", "deploy on friday", "redis cache eviction policy", "unrelated talk"]
    chunks = spark.createDataFrame([(k, k % 2, k, "user", t, f"2024-01-0{k + 1}", False, k == 1, "owner") for k, t in enumerate(texts)], "chunk_id long, session_id int, turn_index int, role string, content string, occurred_at string, is_meta_file boolean, is_meta_message boolean, owner string")
    chunks.withColumn("embedding", embed).write.parquet(f"{folder}/session_chunks.parquet")
    notes = spark.createDataFrame([(9, "n.md", "memory", "T", "notes on redis cache", "2024-02-01", "owner"), (8, "h.md", "handoff", None, "handoff of the deploy", "2024-02-02", "owner")], "chunk_id long, source_path string, source_type string, section_title string, content string, last_modified string, owner string")
    notes.withColumn("embedding", embed).write.parquet(f"{folder}/note_chunks.parquet")
    spark.createDataFrame([(0, "2024-01-01", "/p"), (1, "2024-01-02", "/q")], "session_id int, started_at string, project_path string").write.parquet(f"{folder}/sessions.parquet")
    return folder


def test_tools(spark, store):
    e = cli.open_store(spark, store)
    hits = [r.chunk_id for r in e.search_sessions("redis cache", limit=3).collect()]
    assert len(hits) == 3 and set(hits[:2]) == {0, 3}
    assert 1 not in [r.chunk_id for r in e.search_sessions("cache", limit=5, hide_meta=True).collect()]
    # Both texts hold both words, so the reranker ties; ties go by the place before it, and the shorter text 3 was first.
    assert [r.chunk_id for r in e.search_sessions("redis cache", limit=2, rerank=True).orderBy("place").collect()] == [3, 0]
    assert [r.source_path for r in e.search_memory("redis", source_type="handoff").collect()] == ["h.md"]
    assert {r.kind for r in e.search_all("redis cache", limit=4).collect()} == {"session", "memory"}
    assert [r.turn_index for r in e.replay_session(0, 2, 1).collect()] == [2] and e.get_session(1).count() == 1
    assert [r.session_id for r in e.list_sessions(limit=1).collect()] == [1] and e.list_sessions(project_path="/p").count() == 1
    said = e.answer("redis cache", match_count=3)
    assert [c["n"] for c in said["citations"]] == [1, 2, 3] and "[1]" in said["answer"] and said["search_mode"] == "balanced"
    assert e.answer("what is the latest on redis")["search_mode"] == "current"
    with pytest.raises(ValueError):
        e.replay_session(0, -1)


def test_command_line(spark, store, tmp_path, capsys):
    assert cli.main([store, "search", "redis cache", "--limit=2"], spark) == 0
    assert len(json.loads(capsys.readouterr().out)["hits"]) == 2
    assert cli.main([store, "stats"], spark) == 0 and '"session_chunks"' in capsys.readouterr().out
    (tmp_path / "a.txt").write_text("ok\nwith secretword\n")
    (tmp_path / "terms").write_text("secretword\n")
    assert cli.main([str(tmp_path / "a.txt"), "pickaxe", f"--denylist={tmp_path}/terms"], spark) == 1 and '"line": 2' in capsys.readouterr().out
    assert cli.main([store, "nothing"], spark) == 2


def test_sql_functions(spark):
    api.register_sql(spark)
    row = spark.sql("SELECT cosine_distance(array(float(1), float(0)), array(float(0), float(2))) d, fts_match_all('The quick fox', 'fox the') m, fts_tokens('A b') t").first()
    assert (row.d, row.m, row.t) == (1.0, True, ["a", "b"])


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, DATA)
    want = db.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=repr)
    at = [want.columns.index(c) for c in order]
    assert rows == sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
