"""The corpus pipeline: documents of good quality, without copies, without near copies, packed into batches.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return
the columns of documents. run() writes each stage's rows as Parquet in the shared folder and reads them again.

Defined results: a null text counts as empty in every stage, and texts of any length are taken whole; null and repeated
ids are allowed: every stage decides row by row, by the text; of equal texts exactly one row stays, of near copies exactly
one (of texts without words, which are all alike, one); rows tied in every order are interchangeable; an empty table
gives an empty result; other columns pass through unread, whatever their names, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import exact_dedup, near_join, packing, quality, queries
from siltstone.llm.common import fresh_name, table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, learned from the labelled rows of docs, doesn't reject."""
    mark = fresh_name(docs, "score")
    scored = quality.score(docs, queries.quality_model(spark, sf_dir, docs), name=mark)
    return scored.filter(F.col(mark) >= queries.GOOD).drop(mark)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: the one of the largest id."""
    return exact_dedup.exact_distinct(docs, keep="largest")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: the one of the least id."""
    return near_join.near_distinct(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each row in length buckets and token-budget batches; lengths in tokens."""
    return packing.pack(packing.token_lengths(docs, queries.tokenizer(queries.PIECES)), F.col("length"))


STAGES = [("quality", good_quality), ("exact_dedup", without_copies), ("near_dedup", without_near_copies), ("packing", packed)]

#: SQL can't express the classifier's fit; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
