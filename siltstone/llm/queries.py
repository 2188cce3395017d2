"""The registered queries of this subpackage, opN_<name>, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, fingerprints, kneser_ney, licenses, near_join, packing, quality, sharding, token_counts
from .common import table

#: Tokens of the context that op2's over_limit is about.
CONTEXT = 4096
PIECES = "piece_bpe_32k.model"


def tokenizer(name: str) -> str:
    """Where a public vocabulary file is; the package that knows is asked for only by the queries that need it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode(docs, tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts.count_tokens(docs, tokenizer(PIECES), budget=CONTEXT)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > CONTEXT).alias("over_limit"), "fits_chars")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths in tokens: those that op2 counts, and one end."""
    return packing.pack(packing.token_lengths(table(spark, sf_dir, "documents"), tokenizer(PIECES)), F.col("length"))


def op4_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_classes(table(spark, sf_dir, "documents"))


def held_out(parts: int):
    """Rows that aren't learned from: the id's checksum is divisible by parts."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == 0, F.lit(False))


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> quality.Model:
    return quality.fit(docs, table(spark, sf_dir, "labels").filter(~held_out(5)))


#: Scores from which a document is taken to be of quality 1.
GOOD = 0.3


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.score(docs, quality_model(spark, sf_dir, docs))
    return out.select("doc_id", held_out(5).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Words of the longest n-grams of op8's model.
ORDER = 3


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = kneser_ney.train(docs.filter(~held_out(10)), order=ORDER)
    out = kneser_ney.score(docs, model)
    return out.select("doc_id", held_out(10).alias("held_out"), "n_tokens", "n_known", F.lit(model.train).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_rows(table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def queries():
    return {"op1_byte_bpe": op1_byte_bpe, "op2_token_counts": op2_token_counts, "op3_packing": op3_packing, "op4_near_join": op4_near_join, "op5_quality": op5_quality, "op6_fingerprints": op6_fingerprints, "op7_license_scan": op7_license_scan, "op8_lm_scoring": op8_lm_scoring, "op9_sharding": op9_sharding, "op10_exact_dedup": op10_exact_dedup}


def oracle_sql():
    return {
        "op10_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
                   sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    }
