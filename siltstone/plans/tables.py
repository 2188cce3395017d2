"""The engine's logical tables over the Parquet tables of an input folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """session_id, turn_index, role, text, occurred_at of conversations."""
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(conv_id as int), cast(turn as int), 0)")
    return read(spark, folder, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_index"), "role", "text", at.alias("occurred_at"))


def session_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as stored chunks; chunk_id = session * 1000000 + turn."""
    t = turns(spark, folder)
    return t.select(
        (F.col("session_id") * 1_000_000 + F.col("turn_index")).alias("chunk_id"), "session_id", "turn_index", "role", F.col("text").alias("content"), F.sha2("text", 256).alias("content_hash"),
        "occurred_at", F.lit("owner").alias("owner"), (F.col("turn_index") % 5 == 4).alias("is_meta_message"), F.when(F.col("turn_index") % 3 == 0, True).when(F.col("turn_index") % 3 == 1, False).alias("has_cr_prefix"),
    )


def note_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as note chunks, with the embedding of the same id where there is one."""
    d = read(spark, folder, "documents")
    e = read(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int), 0)")
    return d.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_type"), F.col("text").alias("content"), at.alias("last_modified"), F.lit("owner").alias("owner")).join(e, "chunk_id", "left")


def query_vector(spark: SparkSession, folder: str, vec_id: int = 0) -> list[float]:
    """One stored vector, as the query's."""
    row = read(spark, folder, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row[0]]
