"""Packing: optimal length buckets and token-budget batches.

The lengths of all documents are counted on a grid (every length up to EXACT, then steps of 1/STEPS of an
octave: a few thousand cells, whatever the input), with the largest length in each cell. Dynamic programming over
that histogram chooses, among those largest lengths, the bucket boundaries that minimise padding; every document is
padded to its bucket's boundary, which is the length of its longest document. A boundary inside a cell isn't tried:
raising each boundary of the best choice to its cell's largest length makes it at most 1/STEPS longer, so the padded
total is at most (1 + 1/STEPS) times the least possible one. Inside each bucket, batches take documents up to the token budget.

A bucket may hold most documents, so batches are formed in shards of a bucket, dealt by a hash of the id and a
checksum of the row's length and sized by the histogram; each shard leaves at most one batch part-filled. Only ids and
lengths are shuffled.

Defined results: a null length is 0 (token_lengths gives a null text 1, its end); a document longer than the budget is a
batch of its own, whole; repeated rows and null ids are packed as rows of their own; an empty table gives an empty
result; only the id and the length are read, so other columns' names don't matter.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

EXACT, STEPS = 512, 128
BUCKETS, BUDGET, SHARD_ROWS = 16, 65_536, 20_000


def grid(length: Column) -> Column:
    """The grid cell's upper end: the length itself up to EXACT, else rounded up to a step of its octave."""
    octave = F.floor(F.log2(length.cast("double") - 0.5))
    step = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), octave) / STEPS)
    return F.when(length <= EXACT, length).otherwise((F.ceil(length / step) * step).cast("long"))


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Boundaries, the last the largest length, that minimise the sum of boundary times documents."""
    m = len(lengths)
    if not m:
        return []
    before = np.concatenate(([0], np.cumsum(counts))).astype(np.float64)
    upper = lengths.astype(np.float64)
    cost = upper * before[1:]  # one bucket for the first j cells
    choice = []
    for _ in range(min(buckets, m) - 1):
        new, at = cost.copy(), np.full(m, -1)
        for low in range(0, m, 256):  # a slab of the matrix of all pairs at a time
            j = np.arange(low, min(low + 256, m))
            total = cost[None, :] + upper[j][:, None] * (before[j + 1][:, None] - before[1:][None, :])
            total[np.arange(m)[None, :] >= j[:, None]] = np.inf
            k = total.argmin(1)
            better = total[np.arange(len(j)), k] < new[j]
            new[j[better]], at[j[better]] = total[np.arange(len(j)), k][better], k[better]
        cost = new
        choice.append(at)
    out, j = [], m - 1
    for at in reversed(choice):
        out.append(int(lengths[j]))
        j = at[j]
        if j < 0:
            break
    else:
        out.append(int(lengths[j]))
    return sorted(set(out))


def pack(docs: DataFrame, length: Column, id_col: str = "doc_id", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """One row per input row: doc_id, length, bucket, padded_length, batch, slot (place in the batch)."""
    counted = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(length, F.lit(0)).cast("long").alias("length")).withColumn("cell", grid(F.col("length")))
    histogram = sorted((r[0], r[1]) for r in counted.groupBy("cell").agg(F.max("length").alias("longest"), F.count(F.lit(1)).alias("n")).select("longest", "n").collect())  # a few thousand cells at most
    longest, counts = (np.array([h[k] for h in histogram], np.int64) for k in (0, 1))
    bounds = best_boundaries(longest, counts, buckets)
    if not bounds:
        bounds = [0]
    held = np.bincount(np.searchsorted(bounds, longest), counts, len(bounds)).astype(np.int64)
    bucket = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("length")))
    of = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("bucket") + 1)
    shards = [max(1, math.ceil(h / SHARD_ROWS)) for h in held]
    placed = counted.withColumn("bucket", bucket).withColumns({"padded_length": of(bounds).cast("long"), "shard": F.pmod(F.xxhash64("doc_id", "length", F.lit("shard")), of(shards))})
    rank = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("length", "doc_id")) - 1
    room = of([max(1, budget // max(1, b)) for b in bounds])
    batch = F.concat_ws("-", "bucket", "shard", F.floor(F.col("rank") / F.col("room")))
    return placed.withColumns({"rank": rank, "room": room}).select("doc_id", "length", "bucket", "padded_length", batch.alias("batch"), (F.col("rank") % F.col("room")).cast("int").alias("slot"))


def token_lengths(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, length): the tokens of each whole text under the piece model at path, and one end; written, as both of pack's passes read them."""
    from . import token_counts

    counted = token_counts.count_tokens(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), path)
    return written(counted.select("doc_id", (F.col("n_tokens") + 1).alias("length")), "lengths")
