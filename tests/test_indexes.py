"""Stored indexes against exact search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import english, fulltext
from siltstone.operators import indexes, rank
from siltstone.plans import search


@pytest.fixture(scope="module")
def chunks(spark):
    rnd = random.Random(6)
    centres = [[rnd.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    words = "cache redis the of and slow deploy friday policy eviction caching team notes 7".split()
    rows = []
    for k in range(900):
        v = [x + rnd.gauss(0, 0.35) for x in centres[rnd.randrange(12)]]
        rows.append((k, None if k % 50 == 3 else " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 25))), None if k % 40 == 1 else [0.0] * 16 if k % 40 == 2 else v, "a" if k % 3 else "b"))
    return spark.createDataFrame(rows, "chunk_id long, content string, embedding array<float>, owner string").cache()


def test_vector_index(spark, chunks, tmp_path):
    index = indexes.vector_index(chunks, str(tmp_path / "v"), cells=24, keep=("owner",))
    assert spark.read.parquet(index.path).count() == chunks.filter("embedding is not null and exists(embedding, x -> x != 0)").count()
    queries = [list(r[0]) for r in chunks.filter("chunk_id % 100 = 0").select("embedding").collect()]
    for q in queries[:4]:
        assert [tuple(r) for r in index.search(q, 15).orderBy("rank").collect()] == [tuple(r) for r in rank.semantic_topk(chunks, q, 15).orderBy("rank").collect()]
    assert index.recall(queries, 10, probes=4) >= 0.9
    within = chunks.filter("owner = 'b'")
    assert [tuple(r) for r in index.search(queries[1], 5, within=within.select("chunk_id")).orderBy("rank").collect()] == [tuple(r) for r in rank.semantic_topk(within, queries[1], 5).orderBy("rank").collect()]
    plan = index.rows([3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell#", "[cell") or "PartitionFilters: [isnotnull(cell" in plan
    empty = indexes.vector_index(chunks.filter("chunk_id < 0"), str(tmp_path / "none"))
    assert empty.search(queries[0], 5).count() == 0 and index.search([0.0] * 16, 5).count() == 0


@pytest.mark.parametrize("query", ["cache", "redis cache", '"cache redis"', "cache -slow", "friday or policy", '"the of" -redis or team', "nowhere", "", "-cache"])
def test_lexical_index(spark, chunks, tmp_path, query):
    path = str(tmp_path / "w")
    index = indexes.lexical_index(chunks, path)
    want = chunks.select("chunk_id", fulltext.tokens(F.col("content")).alias("t")).filter(fulltext.matches(F.col("t"), query)).select("chunk_id", fulltext.score(F.col("t"), query).alias("s"))
    assert index.answers(query) == (query != "-cache")
    if not index.answers(query):  # a scan answers it
        return
    got = {(r[0], round(r[1], 9)) for r in index.hits(query).collect()}
    assert got == {(r[0], round(r[1], 9)) for r in want.collect()}
    assert [tuple(r) for r in index.search(query, 7).orderBy("rank").collect()] == [tuple(r) for r in rank.lexical_topk(chunks, query, 7).orderBy("rank").collect()]


def test_english_index_and_hybrid_search(spark, chunks, tmp_path):
    stems = indexes.lexical_index(chunks, str(tmp_path / "e"), config="english")
    for q in ("caches", "cached policies", '"redis caching"', "evictions -teams"):
        assert [tuple(r) for r in stems.search(q, 9).orderBy("rank").collect()] == [tuple(r) for r in rank.english_topk(chunks, q, 9).orderBy("rank").collect()]
    words, vectors = indexes.lexical_index(chunks, str(tmp_path / "w")), indexes.vector_index(chunks, str(tmp_path / "v"), cells=10)
    q = list(np.linspace(-1, 1, 16))
    for owner in (None, "b"):
        plain = search.hybrid_search(chunks, "redis cache", q, 10, owner=owner).orderBy("place").collect()
        assert plain == search.hybrid_search(chunks, "redis cache", q, 10, owner=owner, words=words, vectors=vectors).orderBy("place").collect()


def test_buckets_agree(spark):
    words = ["a", "cache", "zzz9", "0", "x" * 300]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(indexes.bucket_column(F.col("w"))).collect()
    assert [r[0] for r in got] == [indexes.bucket_of(w) for w in words] and english.stem("caching") == "cach"
