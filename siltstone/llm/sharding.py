"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has PLACES places. A row's place comes from its text alone, so equal texts share a place and lie side by
side in it. Each shard owns VNODES virtual nodes; a row belongs to the next virtual node clockwise. A shard that has
its share is full, and rows that reach a full shard go on clockwise to the next shard with room: the loads are bounded,
and only rows past a full shard move. With slack 0 every shard takes floor or ceil of rows / shards: counts at
most one apart, but most shards fill up, so rows near a shard's end overflow and adding a shard moves more rows
than with slack; the texts at an end may be parted, and a text of more rows than a shard's room has to be.

Only the rows of each place are counted (at most PLACES numbers reach the driver, whatever the input). Places of more
than HOT times the mean are few (under PLACES / HOT) and are ranked in CELLS cells by a hash of the id, so that no task
ranks a hot text alone; rows are mapped by a broadcast of at most PLACES + PLACES / HOT * CELLS rows plus a few.
No Python runs on executors.

Defined results: a null text has size 1 and the empty text's checksum; texts of any length are read whole; null ids
hash as a value of their own; repeated rows get slots of their own; ties inside a place go by checksum, size and id; an
empty table gives an empty result; only the id and the text are read, so other columns' names don't matter.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import whole_text

PLACES = 1 << 16
HOT, CELLS = 256, 256
VNODES = 64


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node in clockwise order."""
    spread = lambda s, v: zlib.crc32(f"node {s} {v}".encode()) * 2654435761 % 2**32 % PLACES
    return sorted((spread(s, v), s) for s in range(shards) for v in range(vnodes))


def place(counts: dict[tuple[int, int], int], shards: int, slack: float = 0.0, vnodes: int = VNODES) -> list[tuple[int, int, int, int, int, int]]:
    """(place, cell, first rank, end rank, shard, slot of the first rank) for the rows counted in each cell of a place."""
    total = sum(counts.values())
    low, more = divmod(total, shards)
    room = [low + (s < more) for s in range(shards)] if slack == 0 else [max(1, -int(-(1 + slack) * total // shards))] * shards
    nodes = ring(shards, vnodes)
    onward = list(range(len(nodes)))  # the next node with room, found with shortened paths

    def with_room(k: int) -> int:
        path = []
        while room[nodes[k][1]] == 0:
            path.append(k)
            onward[k] = (k + 1) % len(nodes) if onward[k] == k else onward[k]
            k = onward[k]
        for x in path:
            onward[x] = k
        return k

    used, out, at = [0] * shards, [], 0
    for unit in sorted(counts):
        while at < len(nodes) and nodes[at][0] < unit[0]:
            at += 1
        first, left = 0, counts[unit]
        while left:
            shard = nodes[with_room(at % len(nodes))][1]
            take = min(left, room[shard])
            out.append((*unit, first, first + take, shard, used[shard]))
            room[shard] -= take
            used[shard] += take
            first += take
            left -= take
    return out


def shard_rows(docs: DataFrame, shards: int = 16, text_col: str = "text", id_col: str = "doc_id", slack: float = 0.0, vnodes: int = VNODES) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    text = whole_text(text_col)
    where_of = F.pmod(F.xxhash64(text), F.lit(PLACES)).cast("int")
    counts = {r[0]: r[1] for r in docs.groupBy(where_of.alias("place")).count().collect()}  # at most PLACES rows
    total = sum(counts.values())
    hot = sorted(p for p, n in counts.items() if n * PLACES > HOT * total)  # under PLACES / HOT of them
    apart = set(hot)
    cells = {(p, 0): n for p, n in counts.items() if p not in apart}
    cell_of = F.lit(0)
    if hot:
        own_cell = F.pmod(F.xxhash64(F.col(id_col), F.lit("cell")), F.lit(CELLS)).cast("int")
        cell_of = F.when(where_of.isin(hot), own_cell).otherwise(0)
        cells |= {(r[0], r[1]): r[2] for r in docs.filter(where_of.isin(hot)).groupBy(where_of.alias("place"), own_cell.alias("cell")).count().collect()}
    schema = T.StructType([*(T.StructField(c, T.IntegerType()) for c in ("_place", "_cell")), *(T.StructField(c, T.LongType()) for c in ("low", "high")), T.StructField("shard", T.IntegerType()), T.StructField("base", T.LongType())])
    where = spark.createDataFrame(place(cells, shards, slack, vnodes), schema)
    lean = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), where_of.alias("place"), cell_of.alias("cell"))
    rank = Window.partitionBy("place", "cell").orderBy("text_crc32", "size", F.col("doc_id").asc_nulls_first())
    ranked = lean.withColumn("rank", F.row_number().over(rank).cast("long") - 1)
    here = (F.col("place") == F.col("_place")) & (F.col("cell") == F.col("_cell")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    return ranked.join(F.broadcast(where), here).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("low")).alias("slot"))
