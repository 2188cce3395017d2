"""The query surface: the tools of the engine over stored tables, checked arguments in, DataFrames or JSON out."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as texts
from .functions.arguments import clamp_int, replay_arguments
from .operators import indexes
from .operators import sessions as session_ops
from .plans import providers, search


@dataclass
class Engine:
    """Stored tables: sessions (session_id, started_at, ...), chunks of sessions and of notes, each with content and embedding."""

    sessions: DataFrame
    session_chunks: DataFrame
    note_chunks: DataFrame
    embedder: providers.Embedder
    reranker: providers.Reranker
    owner: str | None = None
    answerer: providers.Answerer = field(default_factory=lambda: providers.Extractive())
    #: simple tokens, or english stems.
    config: str = "simple"
    #: Stored indexes of session chunks and of notes, in place of scans; and the cells that an approximate search reads (none: exact).
    words: dict[str, indexes.LexicalIndex] = field(default_factory=dict)
    vectors: dict[str, indexes.VectorIndex] = field(default_factory=dict)
    probes: int | None = None

    def embed_query(self, query: str) -> list[float]:
        """The query's vector, once for all surfaces."""
        spark = self.session_chunks.sparkSession
        return list(spark.range(1).select(self.embedder.embed(F.lit(query)).alias("v")).first()["v"])

    def _hits(self, chunks: DataFrame, query: str, vector_: list[float], limit: int, mode: str, date: str, columns: list[str], source_type: str | None = None) -> DataFrame:
        recency = 1.0 if mode == "current" else 0.0
        of = "sessions" if chunks is self.session_chunks else "memory"
        found = search.hybrid_search(
            chunks, query, vector_, limit, recency_weight=recency, owner=self.owner, source_type=source_type, date=F.col(date), config=self.config, words=self.words.get(of), vectors=self.vectors.get(of), probes=self.probes)
        return search.fetch(chunks, found.select("chunk_id", "score", "place"), ["content", *columns])

    def search_sessions(self, query: str, limit: Any = None, rerank: bool = False, hide_meta: bool = False, search_mode: str = "auto") -> DataFrame:
        limit, mode = clamp_int(limit, 1, 100, "limit", 10), search.resolve_mode(search_mode, query)
        hits = self._hits(self.session_chunks, query, self.embed_query(query), search.overfetch(limit, rerank), mode, "occurred_at", ["session_id", "turn_index", "role", "occurred_at", "is_meta_file", "is_meta_message"])
        hits = search.hide_meta(hits) if hide_meta else hits
        hits = self._reranked(hits, query, rerank, mode, limit)
        meta = F.coalesce("is_meta_file", F.lit(False)) | F.coalesce("is_meta_message", F.lit(False))
        return hits.orderBy("place").limit(limit).select("chunk_id", "session_id", "turn_index", "role", "occurred_at", texts.snippet(F.col("content")).alias("snippet"), meta.alias("is_meta"), "place")

    def search_memory(self, query: str, limit: Any = None, source_type: str | None = None, rerank: bool = False, search_mode: str = "auto") -> DataFrame:
        limit, mode = clamp_int(limit, 1, 100, "limit", 10), search.resolve_mode(search_mode, query)
        hits = self._hits(self.note_chunks, query, self.embed_query(query), search.overfetch(limit, rerank), mode, "last_modified", ["source_path", "source_type", "section_title", "last_modified"], source_type)
        hits = self._reranked(hits, query, rerank, mode, limit)
        return hits.orderBy("place").limit(limit).select("chunk_id", "source_path", "source_type", "section_title", "last_modified", texts.snippet(F.col("content")).alias("snippet"), "place")

    def _reranked(self, hits: DataFrame, query: str, rerank: bool, mode: str, limit: int) -> DataFrame:
        return providers.rerank(hits, query, self.reranker, limit) if rerank and mode != "current" else hits

    def _surfaces(self, query: str, fetch: int, mode: str, kinds: list[str], hide_meta: bool) -> list[DataFrame]:
        vector_, out = self.embed_query(query), []
        if "sessions" in kinds:
            s = self._hits(self.session_chunks, query, vector_, fetch, mode, "occurred_at", ["session_id", "turn_index", "role", "occurred_at", "is_meta_file", "is_meta_message"])
            s = search.hide_meta(s) if hide_meta else s
            out.append(s.select("chunk_id", "content", "place", F.lit("session").alias("kind"), F.col("session_id").cast("string").alias("session_id"), F.lit(None).cast("string").alias("source_path"), F.col("turn_index").cast("long").alias("turn_index"), F.col("occurred_at").cast("string").alias("occurred_at")))
        if "memory" in kinds:
            m = self._hits(self.note_chunks, query, vector_, fetch, mode, "last_modified", ["source_path", "source_type", "last_modified"])
            out.append(m.select("chunk_id", "content", "place", F.lit("memory").alias("kind"), F.lit(None).cast("string").alias("session_id"), F.col("source_path").cast("string").alias("source_path"), F.lit(None).cast("long").alias("turn_index"), F.col("last_modified").cast("string").alias("occurred_at")))
        if not out:
            raise ValueError("sources must name sessions, memory or both")
        return out

    def search_all(self, query: str, limit: Any = None, rerank: bool = False, search_mode: str = "auto", round_robin: bool = False) -> DataFrame:
        limit, mode = clamp_int(limit, 1, 100, "limit", 15), search.resolve_mode(search_mode, query)
        half = -(-limit // 2)
        both = search.search_all(*self._surfaces(query, search.overfetch(half, rerank), mode, ["sessions", "memory"], False), limit=limit, round_robin=round_robin)
        if rerank and mode != "current":
            both = providers.rerank(both.drop("place"), query, self.reranker, limit, place="at")
        return both.select("kind", "chunk_id", "session_id", "source_path", "turn_index", "occurred_at", texts.snippet(F.col("content")).alias("snippet"), "at")

    def get_session(self, session_id: Any) -> DataFrame:
        return self.sessions.filter(F.col("session_id") == session_id)

    def replay_session(self, session_id: Any, around: Any, window: Any = None) -> DataFrame:
        around, window = replay_arguments(around, window)
        return session_ops.replay(self.session_chunks, session_id, around, min(window, 50)).select("session_id", "turn_index", "role", "content", "occurred_at")

    def list_sessions(self, since: str | None = None, project_path: str | None = None, limit: Any = None, offset: Any = None) -> DataFrame:
        return session_ops.list_sessions(self.sessions, clamp_int(limit, 1, 100, "limit", 25), clamp_int(offset, 0, 2**31 - 1, "offset", 0), since, project_path)

    def answer_rows(self, question: str, sources: list[str] | None = None, match_count: Any = None, rerank: bool = True, hide_meta: bool = True, search_mode: str = "auto") -> DataFrame:
        """The numbered hits that an answer is made from."""
        count, mode = clamp_int(match_count, 1, 30, "match_count", 10), search.resolve_mode(search_mode, question)
        lists = self._surfaces(question, search.overfetch(count, rerank), mode, sources or ["sessions", "memory"], hide_meta)
        return search.answer_hits(lists, question, count, mode, self.reranker if rerank else None)

    def answer(self, question: str, sources: list[str] | None = None, match_count: Any = None, rerank: bool = True, hide_meta: bool = True, search_mode: str = "auto") -> dict:
        """{question, answer, citations, search_mode}: the answer is the provider's, made of the cited chunks."""
        hits = self.answer_rows(question, sources, match_count, rerank, hide_meta, search_mode)
        rows = hits.select("n", "kind", "session_id", "source_path", "turn_index", "occurred_at", "content").orderBy("n").collect()  # at most 30
        citations = [{**{k: r[k] for k in ("n", "kind", "session_id", "source_path", "turn_index", "occurred_at") if r[k] is not None}, "snippet": r["content"][: texts.CITED_CHARS]} for r in rows]
        found = self.session_chunks.sparkSession.createDataFrame([(r["n"], r["content"]) for r in rows], "n long, content string")
        said = self.answerer.answer(found).first()["answer"]
        return {"question": question, "answer": said, "citations": citations, "search_mode": search.resolve_mode(search_mode, question)}

    def stats(self) -> DataFrame:
        """Rows of each table, and how many session chunks have a context prefix."""
        out = None
        for name in ("sessions", "session_chunks", "note_chunks"):
            one = getattr(self, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
            out = one if out is None else out.union(one)
        return out


def envelope(hits: DataFrame, mode: str) -> str:
    """Hits as the tools return them: JSON with the search mode."""
    return json.dumps({"search_mode": mode, "hits": [json.loads(r[0]) for r in hits.select(F.to_json(F.struct("*"))).collect()]}, indent=2, ensure_ascii=False)


#: SQL functions: name, arguments, result, expression. They run on the JVM.
SQL_FUNCTIONS = [
    (
        "cosine_distance", "a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE",
        "1 - try_divide(aggregate(zip_with(a, b, (x, y) -> double(x) * double(y)), 0D, (s, v) -> s + v), "
        "sqrt(aggregate(a, 0D, (s, v) -> s + double(v) * double(v))) * sqrt(aggregate(b, 0D, (s, v) -> s + double(v) * double(v))))",
    ),
    ("fts_tokens", "t STRING", "ARRAY<STRING>", "filter(split(lower(t), '[^a-z0-9]+'), w -> w != '')"),
    ("fts_match_all", "t STRING, q STRING", "BOOLEAN", "size(array_except(filter(split(lower(q), '[^a-z0-9]+'), w -> w != ''), filter(split(lower(t), '[^a-z0-9]+'), w -> w != ''))) = 0"),
]


def register_sql(spark: SparkSession) -> None:
    """The SQL functions, for spark.sql in this session."""
    for name, arguments, kind, expression in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {expression}")
