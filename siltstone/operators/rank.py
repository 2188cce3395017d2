"""Ranked retrieval: top-k lists, Reciprocal Rank Fusion, recency, interleaving."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import english, fulltext, vector

# The search functions' caps and defaults.
MOST, RRF_K, RRF_K_PLAIN = 30, 60, 50


def top_ranked(rows: DataFrame, order: Sequence[Column], k: int, id_col: str, rank: str) -> DataFrame:
    """The first k ids and their ranks. The limit comes first, so only k rows meet in one task."""
    top = rows.orderBy(*order, F.col(id_col).asc()).limit(k)
    return top.select(id_col, F.row_number().over(Window.orderBy(*order, F.col(id_col).asc())).cast("long").alias(rank))


def semantic_topk(chunks: DataFrame, query: Sequence[float], k: int, id_col: str = "chunk_id", embedding: str = "embedding", unit: bool = False) -> DataFrame:
    """(id, distance, rank) of the k nearest rows that have an embedding. Distances are taken to 9 digits, ties go by id."""
    near = chunks.select(id_col, F.round(vector.cosine_distance_to(F.col(embedding), query, unit), 9).alias("distance")).filter(F.col("distance").isNotNull())
    top = near.orderBy("distance", id_col).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("distance", id_col)).cast("long"))


def lexical_topk(chunks: DataFrame, query: str, k: int, id_col: str = "chunk_id", content: str = "content") -> DataFrame:
    """(id, score, rank) of the k best rows that match the query's words."""
    some = chunks.filter(fulltext.could_match(F.col(content), query))
    hits = some.select(id_col, fulltext.tokens(F.col(content)).alias("_tokens")).filter(fulltext.matches(F.col("_tokens"), query))
    top = hits.select(id_col, fulltext.score(F.col("_tokens"), query).alias("score")).orderBy(F.desc("score"), id_col).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)).cast("long"))


def english_topk(chunks: DataFrame, query: str, k: int, id_col: str = "chunk_id", content: str = "content") -> DataFrame:
    """(id, score, rank) of the k best rows that match the query's English stems, by cover density."""
    hits = chunks.select(id_col, english.cover_density(F.col(content), query).alias("score")).filter("score is not null")
    top = hits.orderBy(F.desc("score"), id_col).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)).cast("long"))


def reciprocal(rank: str, k: float, weight: float) -> Column:
    return F.coalesce(F.lit(float(weight)) / (F.lit(float(k)) + F.col(rank)), F.lit(0.0))


def fuse(lexical: DataFrame, semantic: DataFrame, id_col: str = "chunk_id", k: float = RRF_K, full_text_weight: float = 1.0, semantic_weight: float = 1.0) -> DataFrame:
    """Full outer join of two ranked lists: (id, ft_rank, sm_rank, score)."""
    ft = lexical.select(id_col, F.col("rank").alias("ft_rank"))
    sm = semantic.select(id_col, F.col("rank").alias("sm_rank"))
    both = ft.join(sm, id_col, "full_outer")
    return both.withColumn("score", reciprocal("ft_rank", k, full_text_weight) + reciprocal("sm_rank", k, semantic_weight))


def add_recency(fused: DataFrame, dates: DataFrame, date: Column, weight: float, id_col: str = "chunk_id", k: float = RRF_K) -> DataFrame:
    """fused with rc_rank, the place of each candidate by date, newest first and nulls last, added to the score.

    Only the candidates (a few dozen) are ranked; they are what is broadcast to the table of dates.
    """
    dated = dates.join(F.broadcast(fused), id_col).select(fused.columns + [date.alias("_date")])
    ranked = dated.withColumn("rc_rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("_date"), id_col)).cast("long"))
    return ranked.drop("_date").withColumn("score", F.col("score") + reciprocal("rc_rank", k, weight))


def best(fused: DataFrame, n: int, id_col: str = "chunk_id") -> DataFrame:
    """The n best by score, ties by id, with their place."""
    top = fused.orderBy(F.desc("score"), id_col).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), id_col)).cast("long"))


def interleave(lists: Sequence[DataFrame], place: str = "place") -> DataFrame:
    """Ranked lists one after the other in turn: all first places, all second places, ...; adds list and at."""
    out = None
    for k, one in enumerate(lists):
        one = one.withColumn("list", F.lit(k))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out.withColumn("at", F.row_number().over(Window.orderBy(place, "list")).cast("long"))


def concatenate(lists: Sequence[DataFrame], place: str = "place") -> DataFrame:
    """Ranked lists one after the other; adds list and at."""
    out = None
    for k, one in enumerate(lists):
        one = one.withColumn("list", F.lit(k))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out.withColumn("at", F.row_number().over(Window.orderBy("list", place)).cast("long"))
