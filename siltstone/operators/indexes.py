"""Stored indexes for search: vectors in cells, words in postings. Exact search (rank.py) stays beside them.

VectorIndex: unit vectors are dealt to the nearest of some centroids, fitted by spherical k-means on a bounded sample
(SAMPLE rows, the least hashes of the id), and every row that has an embedding is written, one folder a cell. A query
reads the folders of the `probes` nearest centroids and computes exact distances in them; with probes=None it reads
further cells, nearest first, until no other can hold a better row, which is exact: a cell's rows lie within
its stored angle of its centroid. recall() measures the first against the second.

LexicalIndex: one row for each word of each text, with its positions, in BUCKETS folders by a hash of the word. A query
reads its own words' rows only; phrases, exclusions and alternatives are decided on positions, so texts aren't read and
the result is that of rank.lexical_topk (or english_topk, where it was built over stems).

Defined results: rows with a null or zero vector are in no cell and never found by vector; null texts have no words;
repeated ids are rows of their own in the vector index and one text in the lexical one; an empty table makes an empty index.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import english, fulltext, vector

#: Vectors that centroids are fitted on, at most; rounds of fitting; folders of postings.
SAMPLE, ROUNDS, BUCKETS = 20_000, 12, 64
#: Queries that a task takes against a batch of rows at once.
ASKED = 256


def fit_centroids(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means of unit vectors: evenly spaced rows to begin with; an empty cell takes the farthest row."""
    cells = min(cells, len(sample))
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(ROUNDS):
        near = sample @ centres.T
        of = near.argmax(1)
        for c in range(cells):
            own = sample[of == c]
            mean = own.sum(0) if len(own) else sample[near.max(1).argmin()]
            centres[c] = mean / (np.linalg.norm(mean) or 1.0)
    return centres


@dataclass
class VectorIndex:
    spark: SparkSession
    path: str
    id_col: str
    centres: np.ndarray
    #: The largest angle between a cell's rows and its centroid.
    angles: np.ndarray
    schema: T.StructType

    def rows(self, cells: Sequence[int], within: DataFrame | None = None) -> DataFrame:
        """The rows of some cells, and of the ids in `within`; other folders aren't read."""
        found = self.spark.read.schema(self.schema).parquet(self.path).filter(F.col("cell").isin([int(c) for c in cells]))
        return found if within is None else found.join(within, self.id_col, "left_semi")

    def search(self, query: Sequence[float], k: int, probes: int | None = None, within: DataFrame | None = None) -> DataFrame:
        """(id, distance, rank) like rank.semantic_topk, of the rows in the `probes` nearest cells; None: of all rows."""
        unit = np.asarray(query, float)
        if not len(self.centres) or not np.linalg.norm(unit):
            return self._ranked(self.rows([], within), query, k)
        unit /= np.linalg.norm(unit)
        apart = np.arccos(np.clip(self.centres @ unit, -1, 1))
        order = np.argsort(apart, kind="stable")
        if probes is not None:
            return self._ranked(self.rows(order[:probes], within), query, k)
        # No row of a cell is nearer than its centroid less its angle.
        least = np.maximum(apart - self.angles, 0)
        read = 1
        while read < len(order):
            kept = self._ranked(self.rows(order[:read], within), query, k).collect()  # at most k rows
            bound = math.acos(max(-1.0, min(1.0, 1 - kept[-1]["distance"]))) + 1e-6 if len(kept) == k else math.inf
            if least[order[read:]].min() > bound:
                break
            wanted = [c for c in order[read:] if least[c] <= bound]
            order = np.array([*order[:read], *wanted, *[c for c in order[read:] if least[c] > bound]])
            read = max(read + 1, read + len(wanted) if math.isfinite(bound) else 2 * read)
        return self._ranked(self.rows(order[:read], within), query, k)

    def _ranked(self, rows: DataFrame, query: Sequence[float], k: int) -> DataFrame:
        from .rank import semantic_topk

        return semantic_topk(rows, query, k, self.id_col)

    def recall(self, queries: Sequence[Sequence[float]], k: int, probes: int) -> float:
        """The share of the k nearest rows that `probes` cells hold, over the queries. One pass over the rows takes every query against every row; a task keeps each query's k nearest."""
        asked = np.array([q for q in queries if np.linalg.norm(q)], float)
        if not len(asked) or not len(self.centres):
            return 1.0
        asked /= np.linalg.norm(asked, axis=1, keepdims=True)
        read = np.zeros((len(asked), len(self.centres)), bool)
        np.put_along_axis(read, np.argsort(np.arccos(np.clip(asked @ self.centres.T, -1, 1)), axis=1, kind="stable")[:, :probes], True, axis=1)
        sent, id_col, block = self.spark.sparkContext.broadcast((asked, read)), self.id_col, ASKED

        def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            asked, read = sent.value
            near: tuple[dict, dict] = ({}, {})
            for pdf in batches:
                # By id, so that a stable sort by distance leaves ties in the order of ids.
                pdf = pdf.sort_values(id_col, kind="stable", na_position="first")
                ids, cells, own = pdf[id_col].tolist(), pdf["cell"].to_numpy(), np.stack(pdf["embedding"].to_list()).astype(float)
                own /= np.linalg.norm(own, axis=1, keepdims=True)
                for at in range(0, len(asked), block):
                    apart = np.round(1 - asked[at : at + block] @ own.T, 9)
                    for some, found in zip((apart, np.where(read[at : at + block][:, cells], apart, np.inf)), near):
                        most = np.partition(some, k - 1, axis=1)[:, k - 1] if k < len(ids) else some.max(1)
                        for q, row in enumerate(some):
                            best = np.flatnonzero((row <= most[q]) & np.isfinite(row))
                            best = best[np.argsort(row[best], kind="stable")[:k]]
                            both = [*found.get(at + q, []), *((float(row[x]), ids[x]) for x in best)]
                            found[at + q] = sorted(both, key=lambda x: (x[0], x[1] is not None, x[1] if x[1] is not None else 0))[:k]
            for q, want in near[0].items():
                yield pd.DataFrame({"q": [q], "want": [[{"d": d, "id": i} for d, i in want]], "got": [[{"d": d, "id": i} for d, i in near[1][q]]]})

        listed = f"array<struct<d:double,id:{self.schema[id_col].dataType.simpleString()}>>"
        found = self.spark.read.schema(self.schema).parquet(self.path).select(id_col, "cell", "embedding").mapInPandas(nearest, f"q long, want {listed}, got {listed}")
        first = lambda c: F.array_distinct(F.transform(F.slice(F.array_sort(F.flatten(F.collect_list(c))), 1, k), lambda x: x["id"]))
        hit, total = found.groupBy("q").agg(first("want").alias("want"), first("got").alias("got")).agg(F.sum(F.size(F.array_intersect("want", "got"))), F.sum(F.size("want"))).first()
        return hit / total if total else 1.0


def vector_index(rows: DataFrame, path: str, cells: int = 64, id_col: str = "chunk_id", embedding: str = "embedding", keep: Sequence[str] = ()) -> VectorIndex:
    """Write the index of all rows that have a direction, with the columns to keep beside the id."""
    spark = rows.sparkSession
    usable = rows.filter(F.col(embedding).isNotNull() & (vector.norm(F.col(embedding)) > 0)).select(id_col, F.col(embedding).alias("embedding"), *keep)
    some = usable.select("embedding", F.xxhash64(F.col(id_col)).alias("_h")).orderBy("_h").limit(SAMPLE).select("embedding").collect()
    sample = np.array([r[0] for r in some], float) if some else np.zeros((0, 1))
    centres = fit_centroids(sample / np.linalg.norm(sample, axis=1, keepdims=True), cells) if some else np.zeros((0, 1))

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = np.stack(pdf["embedding"].to_list()).astype(float) if len(pdf) else np.zeros((0, centres.shape[1]))
            near = own @ centres.T / np.linalg.norm(own, axis=1, keepdims=True) if len(pdf) else np.zeros((0, 1))
            yield pdf.assign(cell=near.argmax(1).astype(np.int32), angle=np.arccos(np.clip(near.max(1, initial=-1), -1, 1)))

    schema = T.StructType([*usable.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    placed = usable.mapInPandas(dealt, schema) if len(sample) else usable.withColumns({"cell": F.lit(0), "angle": F.lit(0.0)})
    # A few files a cell, however many tasks; a cell may hold most rows.
    placed.repartition(F.col("cell"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(4))).write.partitionBy("cell").parquet(path)
    told = spark.read.schema(schema).parquet(path).groupBy("cell").agg(F.max("angle").alias("angle")).collect()  # one row a cell
    angles = np.zeros(len(centres))
    for r in told:
        if r["cell"] < len(angles):
            angles[r["cell"]] = r["angle"]
    return VectorIndex(spark, path, id_col, centres, angles, schema)


@dataclass
class LexicalIndex:
    spark: SparkSession
    path: str
    id_col: str
    config: str
    schema: T.StructType

    def postings(self, words: Sequence[str]) -> DataFrame:
        """The rows of some words; other folders aren't read."""
        found = self.spark.read.schema(self.schema).parquet(self.path).filter(F.col("word").isin(list(words)))
        return found.filter(F.col("bucket").isin(sorted({bucket_of(w) for w in words})))

    def _terms(self, query: str) -> list[list[tuple[bool, list[str]]]]:
        return fulltext.parse(query) if self.config == "simple" else english.terms(query)

    def answers(self, query: str) -> bool:
        """Whether every alternative of the query wants a word: postings can't name the texts that merely lack one."""
        return all(any(wanted for wanted, _ in alternative) for alternative in self._terms(query))

    def hits(self, query: str) -> DataFrame:
        """(id, score) of the texts that match a web-style query."""
        terms = self._terms(query)
        words = sorted({w for alternative in terms for _, some in alternative for w in some if w})
        scored = list(dict.fromkeys(w for alternative in terms for wanted, some in alternative if wanted for w in some if w))
        rows = self.postings(words)
        listed = rows.groupBy(self.id_col).agg(F.collect_list(F.struct("word", "positions")).alias("_l"), F.first("n_tokens").alias("n"))
        # A repeated id has several rows of a word.
        of = lambda w: F.array_sort(F.flatten(F.transform(F.filter("_l", lambda x: x["word"] == w), lambda x: x["positions"])))
        places = [of(w) for w in words]
        texts = listed.select(self.id_col, "n", (F.map_from_arrays(F.array(*map(F.lit, words)), F.array(*places)) if words else F.create_map()).alias("at"))
        at = lambda w: F.coalesce(F.element_at("at", F.lit(w)), F.array().cast("array<int>"))

        def stands(some: list[str]) -> Column:
            first = next(k for k, w in enumerate(some) if w)
            return F.exists(at(some[first]), lambda p: reduce(Column.__and__, [F.array_contains(at(w), p + (k - first)) for k, w in enumerate(some) if w and k > first], F.lit(True)))

        if not terms:
            return texts.select(self.id_col, F.lit(0.0).alias("score"))
        matches = reduce(Column.__or__, [reduce(Column.__and__, [stands(some) if wanted else ~stands(some) for wanted, some in alternative]) for alternative in terms])
        held = texts.filter(matches)
        if self.config == "simple":
            times = reduce(Column.__add__, [F.size(at(w)) for w in scored], F.lit(0))
            return held.select(self.id_col, F.coalesce(F.try_divide(times.cast("double"), F.col("n").cast("double")), F.lit(0.0)).alias("score"))
        wanted = [list(dict.fromkeys(w for ok, some in alternative if ok for w in some if w)) for alternative in terms]

        @F.pandas_udf(T.DoubleType())
        def density(places: pd.Series) -> pd.Series:
            def one(found) -> float:
                where = {r["word"]: list(r["positions"]) for r in found}
                return max((english.covers_at(sorted((int(p), w) for w in some for p in where.get(w, [])), some) for some in wanted if some), default=0.0)

            return places.map(one)

        listed = F.transform(F.map_entries("at"), lambda e: F.struct(e["key"].alias("word"), e["value"].alias("positions")))
        return held.select(self.id_col, density(listed).alias("score"))

    def search(self, query: str, k: int, within: DataFrame | None = None) -> DataFrame:
        """(id, score, rank) like rank.lexical_topk, of the ids in `within`."""
        hits = self.hits(query)
        hits = hits if within is None else hits.join(within, self.id_col, "left_semi")
        top = hits.orderBy(F.desc("score"), self.id_col).limit(k)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), self.id_col)).cast("long"))


def bucket_of(word: str) -> int:
    """The folder of a word: the same sum of its bytes here and in bucket_column."""
    return zlib.crc32(word.encode()) % BUCKETS


def bucket_column(word: Column) -> Column:
    return F.pmod(F.crc32(word.cast("binary")), F.lit(BUCKETS)).cast("int")


def word_places(tokens: Column) -> Column:
    """array<struct<word, positions>> of a text's tokens: sorted with their places, then cut where the word changes, so all in the row."""
    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    word = lambda s, k: F.get(s, k)["word"]
    placed = F.array_sort(F.filter(F.transform(tokens, lambda w, k: F.struct(w.alias("word"), k.alias("at"))), lambda x: x["word"] != ""))

    def listed(s: Column, starts: Column) -> Column:
        return F.transform(starts, lambda first, n: F.struct(
            word(s, first).alias("word"), F.transform(F.slice(s, first + 1, F.coalesce(F.get(starts, n + 1), F.size(s)) - first), lambda x: x["at"]).alias("positions")))

    def cut(s: Column) -> Column:
        places = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        return bound(F.filter(places, lambda k: (k == 0) | (word(s, k) != word(s, k - 1))), lambda starts: listed(s, starts))

    return bound(placed, cut)


def lexical_index(rows: DataFrame, path: str, id_col: str = "chunk_id", content: str = "content", config: str = "simple") -> LexicalIndex:
    """Write the postings of all texts. config: simple tokens, or english stems without stop words."""
    found = rows.select(id_col, (fulltext.tokens(F.col(content)) if config == "simple" else english.lexemes(F.col(content))).alias("_t"))
    # A text's postings are made in its row and written by its task, as many files a folder as the table has parts: nothing is exchanged.
    listed = found.select(id_col, F.size("_t").alias("n_tokens"), F.explode(word_places(F.col("_t"))).alias("_w")).select(id_col, "_w.word", "_w.positions", "n_tokens")
    listed = listed.withColumn("bucket", bucket_column(F.col("word")))
    listed.sortWithinPartitions("bucket", "word").write.partitionBy("bucket").parquet(path)
    return LexicalIndex(rows.sparkSession, path, id_col, config, listed.schema)
