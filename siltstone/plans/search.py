"""The query surface: hybrid search over sessions and notes, combined search, cited answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as texts
from ..functions.patterns import AFTER, EDGE
from ..operators import indexes, rank
from .providers import OverlapReranker, Reranker, rerank as reranked


def resolve_mode(mode: str, query: str) -> str:
    """The mode asked for; auto looks at the query."""
    if mode not in {"auto", "balanced", "current"}:
        raise ValueError(f"unknown search mode {mode}")
    if mode != "auto":
        return mode
    import re

    return "current" if any(re.search(rf"(?i){EDGE}(?:{p}){AFTER}", query) for p in texts.CURRENT_STATE) else "balanced"


def hybrid_search(
    chunks: DataFrame, query: str, embedding: Sequence[float], match_count: int = 10, full_text_weight: float = 1.0, semantic_weight: float = 1.0,
    recency_weight: float = 0.0, rrf_k: float = rank.RRF_K, owner: str | None = None, source_type: str | None = None, date: Column | None = None, unit: bool = False, config: str = "simple",
    words: indexes.LexicalIndex | None = None, vectors: indexes.VectorIndex | None = None, probes: int | None = None,
) -> DataFrame:
    """The n best chunk ids with ft_rank, sm_rank, rc_rank, score and place.

    Filters come before the lists are cut; a chunk in neither list is never returned, whatever its date; one
    whose lists have weight 0 still is. Ids and scores travel; rows are fetched last (fetch). config: simple
    tokens, or english stems ranked by cover density. words, vectors: stored indexes in place of scans of the
    chunks, the second read in `probes` cells, or exactly where that is None.
    """
    n = min(match_count, rank.MOST)
    base = chunks
    if owner is not None:
        base = base.filter(F.col("owner") == owner)
    if source_type is not None:
        base = base.filter(F.col("source_type") == source_type)
    lexical = {"simple": rank.lexical_topk, "english": rank.english_topk}[config]
    within = None if base is chunks else base.select("chunk_id")
    found = lexical(base, query, 2 * n) if words is None or not words.answers(query) else words.search(query, 2 * n, within)
    near = rank.semantic_topk(base, embedding, 2 * n, unit=unit) if vectors is None else vectors.search(embedding, 2 * n, probes, within)
    fused = rank.fuse(found, near, k=rrf_k, full_text_weight=full_text_weight, semantic_weight=semantic_weight)
    if date is not None:
        fused = rank.add_recency(fused, chunks, date, recency_weight, k=rrf_k)
    return rank.best(fused, n)


def fetch(chunks: DataFrame, hits: DataFrame, columns: Sequence[str], id_col: str = "chunk_id") -> DataFrame:
    """The hits' rows; at most a few dozen hits are broadcast."""
    return chunks.select(id_col, *columns).join(F.broadcast(hits), id_col)


def hide_meta(hits: DataFrame) -> DataFrame:
    """Hits that aren't about the engine itself: after the limit, so fewer may be left."""
    return hits.filter(~(F.coalesce("is_meta_file", F.lit(False)) | F.coalesce("is_meta_message", F.lit(False))))


def overfetch(limit: int, rerank: bool) -> int:
    return min(2 * limit, rank.MOST) if rerank else limit


def search_all(sessions: DataFrame, notes: DataFrame, limit: int = 15, round_robin: bool = False) -> DataFrame:
    """Half from each surface: all sessions first, or in turn."""
    half = -(-limit // 2)
    lists = [sessions.filter(F.col("place") <= half), notes.filter(F.col("place") <= half)]
    both = rank.interleave(lists) if round_robin else rank.concatenate(lists)
    return both.filter(F.col("at") <= limit)


def answer_hits(lists: Sequence[DataFrame], question: str, match_count: int = 10, mode: str = "balanced", reranker: Reranker | None = None) -> DataFrame:
    """The numbered hits that an answer is made from: in turn from each surface, reranked unless recency decides."""
    found = rank.interleave(lists)
    if reranker is not None and mode != "current":
        found = reranked(found.drop("place"), question, reranker or OverlapReranker(), match_count, place="at")
    return found.filter(F.col("at") <= match_count).withColumn("n", F.col("at"))


def citation(hit: dict[str, Column]) -> Column:
    """A citation of numbered columns kind, session_id, source_path, turn_index, occurred_at and content."""
    return F.struct(*[hit[k].alias(k) for k in ("n", "kind", "session_id", "source_path", "turn_index", "occurred_at")], F.substring(hit["content"], 1, texts.CITED_CHARS).alias("snippet"))


def prompt_line(n: Column, session: Column, turn: Column, role: Column, date: Column, content: Column) -> Column:
    """A session chunk as the answering prompt shows it."""
    head = [F.lit("["), n.cast("string"), F.lit("] session="), F.substring(session, 1, 8), F.lit(" turn="), turn.cast("string"), F.lit(" role="), role, F.lit(" date="), F.coalesce(F.substring(date, 1, 10), F.lit("unknown-date"))]
    return F.concat(*head, F.lit("\n"), F.substring(content, 1, texts.PROMPT_CHARS))


def note_line(n: Column, path: Column, kind: Column, modified: Column, content: Column) -> Column:
    head = [F.lit("["), n.cast("string"), F.lit("] memory source="), path, F.lit(" type="), kind, F.lit(" mtime="), F.coalesce(F.substring(modified, 1, 10), F.lit("unknown-mtime"))]
    return F.concat(*head, F.lit("\n"), F.substring(content, 1, texts.PROMPT_CHARS))
