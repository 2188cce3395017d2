"""What the engine asks of outside services, and deterministic local stand-ins."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fulltext, text as texts, vector


class Embedder(Protocol):
    dimensions: int

    def embed(self, text: Column) -> Column: ...


class Reranker(Protocol):
    def score(self, query: str, content: Column) -> Column: ...


class HashEmbedder:
    """Signed feature hashing of the tokens."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, text: Column) -> Column:
        return vector.hashed_embedding(fulltext.tokens(text), self.dimensions)


class FixedEmbedder:
    """One vector for every text: a query's vector that is known already."""

    def __init__(self, vector_: list[float]):
        self.vector, self.dimensions = vector_, len(vector_)

    def embed(self, text: Column) -> Column:
        return F.array(*[F.lit(float(x)).cast("float") for x in self.vector])


class OverlapReranker:
    """The share of the query's words that a text holds."""

    def score(self, query: str, content: Column) -> Column:
        words = fulltext.terms_of(query)
        held = F.size(F.array_intersect(fulltext.tokens(content), F.array(*map(F.lit, words)).cast("array<string>")))
        return F.try_divide(held.cast("double"), F.lit(float(max(1, len(words)))))


class Prefixer(Protocol):
    """Context prefixes: context is taken of a document once, and a chunk's prefix made from it; null where the call failed."""

    def context(self, document: Column) -> Column: ...

    def prefix(self, context: Column, chunk: Column) -> Column: ...


class TemplatePrefix:
    """The document's beginning, named as such."""

    def __init__(self, chars: int = 120):
        self.chars = chars

    def context(self, document: Column) -> Column:
        return F.substring(texts.collapse(F.substring(document, 1, 4 * self.chars)), 1, self.chars)

    def prefix(self, context: Column, chunk: Column) -> Column:
        return F.when(F.length(context) > 0, F.concat(F.lit("From a conversation that begins: "), context))


class FallbackPrefix:
    """The first provider's prefix, or the second's where the first failed."""

    def __init__(self, first: Prefixer, second: Prefixer):
        self.first, self.second = first, second

    def context(self, document: Column) -> Column:
        return F.struct(self.first.context(document).alias("a"), self.second.context(document).alias("b"))

    def prefix(self, context: Column, chunk: Column) -> Column:
        return F.coalesce(self.first.prefix(context["a"], chunk), self.second.prefix(context["b"], chunk))


class Summarizer(Protocol):
    def summary(self, prompt: Column) -> Column: ...


class CutSummary:
    """The prompt's beginning in one line."""

    def __init__(self, chars: int = 600):
        self.chars = chars

    def summary(self, prompt: Column) -> Column:
        return texts.collapse(F.substring(prompt, 1, self.chars))


class FallbackSummary:
    def __init__(self, first: Summarizer, second: Summarizer):
        self.first, self.second = first, second

    def summary(self, prompt: Column) -> Column:
        return F.coalesce(self.first.summary(prompt), self.second.summary(prompt))


class Answerer(Protocol):
    def answer(self, hits: DataFrame) -> DataFrame: ...


class FallbackAnswer:
    """The first provider's answer; where it is null (the call failed), the second's."""

    def __init__(self, first: Answerer, second: Answerer):
        self.first, self.second = first, second

    def answer(self, hits: DataFrame) -> DataFrame:
        both = self.first.answer(hits).withColumn("at", F.lit(0)).unionByName(self.second.answer(hits).withColumn("at", F.lit(1)))
        return both.agg(F.min_by("answer", F.when(F.col("answer").isNotNull(), F.col("at"))).alias("answer"))


class Extractive:
    """An answer made of the cited chunks' beginnings."""

    def answer(self, hits: DataFrame, content: str = "content", at: str = "n", chars: int = 200) -> DataFrame:
        lines = F.array_sort(F.collect_list(F.struct(F.col(at).alias("n"), F.substring(F.col(content), 1, chars).alias("t"))))
        text = F.array_join(F.transform(lines, lambda x: F.concat(x["t"], F.lit(" ["), x["n"].cast("string"), F.lit("]"))), "\n")
        return hits.agg(F.when(F.count(F.lit(1)) == 0, "No relevant chunks found in your corpus for this question.").otherwise(text).alias("answer"))


def rerank(hits: DataFrame, query: str, reranker: Reranker, k: int, content: str = "content", place: str = "place") -> DataFrame:
    """The k best by the reranker's score, ties by the place they had; the new place replaces it."""
    scored = hits.withColumn("rerank_score", reranker.score(query, F.col(content))).orderBy(F.desc("rerank_score"), place).limit(k)
    return scored.withColumn(place, F.row_number().over(Window.orderBy(F.desc("rerank_score"), place)).cast("long"))
