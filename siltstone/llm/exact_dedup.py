"""Exact deduplication by content sort.

Sampled splitters range-partition the texts by their leading bytes, a hash of the whole and a salt;
each partition is sorted (externally, spilling), so equal texts stand side by side, and a run ends
where the full text differs from its neighbour's. Only built-in DataFrame operations run.

Hot groups: a text that is repeated more often than a fair share of a partition gets several salts,
each a run of its own; the runs' sums, one row each, are put together afterwards. So no group, not
even one with a third of all rows, has to pass through one task.

Defined results: a null text equals the empty text; texts of any length are compared whole; null identifiers rank lowest; of
repeated rows with the same identifier exactly one stays, whichever; an empty table gives an empty result; columns
of any name pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_name, shuffle_partitions, whole_text, written

#: Leading characters in the splitters: the sample that Spark draws to place them stays small.
PREFIX_CHARS = 64
#: A text is hot when it has more rows than 1/SHARE of an even partition's.
SHARE = 4


def content_runs(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: str = "smallest") -> tuple[DataFrame, dict[str, str]]:
    """docs, range-partitioned and sorted by content, with each run's figures.

    Adds columns (names in the second result): rank in the run (1 stays), rows of the run, the id that
    stays, and whether the text is split over several runs.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    n = {k: fresh_name(docs, f"run_{k}") for k in ("prefix", "hash", "salts", "salt", "rank", "rows", "keep", "split", "hot")}
    text = whole_text(text_col)
    fair = max(64, docs.count() // (SHARE * parts))
    hot = docs.groupBy(F.xxhash64(text).alias(n["hot"])).agg(F.count(F.lit(1)).alias(n["salts"])).filter(F.col(n["salts"]) > fair)
    hot = hot.select(n["hot"], F.ceil(F.col(n["salts"]) / F.lit(fair)).cast("int").alias(n["salts"]))
    # At most SHARE * parts texts can have that many rows: the broadcast is bounded.
    keyed = docs.withColumns({n["prefix"]: F.substring(text, 1, PREFIX_CHARS), n["hash"]: F.xxhash64(text)})
    keyed = keyed.join(F.broadcast(hot), F.col(n["hash"]) == F.col(n["hot"]), "left").withColumns({
        n["split"]: F.col(n["salts"]).isNotNull(),
        n["salt"]: F.coalesce(F.pmod(F.xxhash64(F.col(id_col)), F.col(n["salts"])), F.lit(0)).cast("int"),
    }).drop(n["salts"], n["hot"])
    spread = keyed.repartitionByRange(n["prefix"], n["hash"], n["salt"])
    order = F.col(id_col).desc_nulls_last() if keep == "largest" else F.col(id_col).asc_nulls_last()
    run = Window.partitionBy(n["prefix"], n["hash"], n["salt"], text).orderBy(order)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = spread.withColumns({
        n["rank"]: F.row_number().over(run),
        n["rows"]: F.count(F.lit(1)).over(whole),
        n["keep"]: F.first(F.col(id_col)).over(whole),
    })
    return out.drop(n["prefix"], n["salt"]), {k: n[k] for k in ("rank", "rows", "keep", "split", "hash")}


def _best(col: str, keep: str):
    return F.max(col) if keep == "largest" else F.min(col)


def exact_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: str = "smallest") -> DataFrame:
    """One row per input row: the id, keep_id, group_size, kept and text_sha256. keep: smallest or largest id."""
    runs, n = content_runs(docs, text_col, id_col, keep)
    lean = written(runs.select(
        F.col(id_col).alias("doc_id"), F.col(n["keep"]).alias("run_keep"), F.col(n["rows"]).alias("run_rows"), F.col(n["rank"]).alias("run_rank"),
        F.col(n["split"]).alias("split"), F.sha2(whole_text(text_col).cast("binary"), 256).alias("text_sha256"),
    ), "exact-runs")
    joined = lean.filter("split and run_rank = 1").groupBy(F.col("text_sha256").alias("of_sha256")).agg(_best("run_keep", keep).alias("all_keep"), F.sum("run_rows").alias("all_rows"))
    # One row for each hot text: as bounded as the hot texts themselves.
    out = lean.join(F.broadcast(joined), F.col("split") & (F.col("text_sha256") == F.col("of_sha256")), "left")
    keep_id = F.coalesce("all_keep", "run_keep")
    return out.select(
        "doc_id", keep_id.alias("keep_id"), F.coalesce("all_rows", "run_rows").cast("long").alias("group_size"),
        ((F.col("run_rank") == 1) & F.col("run_keep").eqNullSafe(keep_id)).alias("kept"), "text_sha256",
    )


def exact_distinct(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: str = "smallest") -> DataFrame:
    """docs without the rows whose text another row keeps; same columns."""
    runs, n = content_runs(docs, text_col, id_col, keep)
    own = [F.col(f"`{c}`") for c in docs.columns]
    heads = written(runs.filter(F.col(n["rank"]) == 1).drop(n["rank"], n["rows"], n["keep"]), "exact-heads")
    order = F.col(id_col).desc_nulls_last() if keep == "largest" else F.col(id_col).asc_nulls_last()
    rank = fresh_name(heads, "rank")
    # The heads of hot texts' runs: a few rows for each, however many rows the text had.
    again = heads.filter(n["split"]).withColumn(rank, F.row_number().over(Window.partitionBy(n["hash"], whole_text(text_col)).orderBy(order)))
    return heads.filter(~F.col(n["split"])).select(own).unionByName(again.filter(F.col(rank) == 1).select(own))
