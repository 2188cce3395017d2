"""Document fingerprints: threshold-scaled sketches of word shingles.

A fingerprint holds every shingle hash below a fixed fraction of the hash range, so it grows with its
document and two documents' fingerprints merge by union. A short document would keep almost nothing; so
the FLOOR smallest hashes are kept in any case, which decides for documents of fewer than FLOOR / FRACTION (128)
shingles, and makes those of up to FLOOR complete. Two fingerprints are compared below the smaller of their
thresholds, where both are complete: the share of common hashes there estimates resemblance, and over the
smaller of the two sides, containment, also between very unequal documents. With k hashes in the smaller side an
estimate of p has a standard error of sqrt(p (1 - p) / k); k is FRACTION of the shingles, or about FLOOR.

A fingerprint is a string: the retained 32-bit hashes in ascending order, 8 hexadecimal digits each.

Defined results: a null text is the empty text; texts of any length are read whole; a text without words has the empty
fingerprint, equal to another empty one (likeness 1) and unlike any other (0); repeated rows have equal
fingerprints; an empty table gives an empty result. compare_with_next: ids of any type that sorts; of rows with the
same id the text decides the order; null ids come first, in the order of their texts' hashes; only the id and the text
are read. fingerprint: other columns pass through, and the operator's own takes the place of one of the same name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import making_room, ship, shuffle_partitions, whole_text
from .kernels import WordHasher, edges_of, shingle_hashes

SHINGLE, FRACTION, FLOOR = 5, 1 / 4, 32
#: White space parts words.
SPACES = b" \t\n\x0b\x0c\r"
_hashers: dict[bytes, WordHasher] = {}


def hasher(separators: bytes) -> WordHasher:
    if separators not in _hashers:
        _hashers[separators] = WordHasher(separators)
    return _hashers[separators]


def sketches(texts: list[bytes], fraction: float = FRACTION, floor: int = FLOOR) -> list[np.ndarray]:
    """The retained hashes of each text, ascending."""
    edges = edges_of(np.fromiter(map(len, texts), np.int64, len(texts)))
    words, parts = hasher(SPACES)(np.frombuffer(b"".join(texts), np.uint8), edges, lower=True)
    hashes, parts = shingle_hashes(words, parts, SHINGLE)
    hashes = (hashes >> np.uint64(32)).astype(np.uint32)
    most, out = int(fraction * 2**32), []
    low = hashes < most
    few = np.add.reduceat(np.concatenate((low, [False])), parts[:-1]) if len(texts) else []
    for k, (a, b) in enumerate(zip(parts[:-1].tolist(), parts[1:].tolist(), strict=True)):
        own = hashes[a:b]
        kept = np.unique(own[low[a:b]]) if b > a and few[k] >= floor else own[:0]
        out.append(kept if len(kept) >= floor else np.unique(own)[: max(floor, len(kept))])
    return out


def to_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def _threshold(sketch: np.ndarray, fraction: float, floor: int) -> int:
    if len(sketch) < floor:
        return 2**32  # complete
    return max(int(fraction * 2**32), int(sketch[-1]) + 1)


def likeness(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION, floor: int = FLOOR) -> tuple[float, float]:
    """Estimated (containment of the smaller in the larger, resemblance), each 0 to 1."""
    if not len(a) or not len(b):
        same = float(len(a) == len(b))
        return same, same
    upto = min(_threshold(a, fraction, floor), _threshold(b, fraction, floor))
    x, y = set(a[a < upto].tolist()), set(b[b < upto].tolist())
    both = len(x & y)
    return both / max(1, min(len(x), len(y))), both / max(1, len(x | y))


def merge(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION, floor: int = FLOOR) -> np.ndarray:
    """The sketch of the union of two documents' shingles."""
    both = np.union1d(a, b)
    upto = min(_threshold(a, fraction, floor), _threshold(b, fraction, floor))
    both = both[both < upto]
    return both[: max(floor, int((both < int(fraction * 2**32)).sum()))]


def fingerprint(df: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """df with each whole text's fingerprint in the column name."""
    ship(df.sparkSession)
    df = making_room(df, [name], keep=(text_col,))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [(t or "").encode() for t in part.column(part.schema.get_field_index(text_col)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(map(to_text, sketches(texts)), pa.string())], [*part.schema.names, name])

    return df.mapInArrow(kernel, T.StructType([*df.schema.fields, T.StructField(name, T.StringType())]))


def _part_of(key: Column, splitters: list[Column]) -> Column:
    """How many splitters are <= key, found in two steps of about the square root of their number."""
    if not splitters:
        return F.lit(0)
    step = math.isqrt(len(splitters)) + 1
    fine = [splitters[k : k + step] for k in range(0, len(splitters), step)]
    upto = lambda xs: F.size(F.filter(xs, lambda s: s <= key))
    block = upto(F.array(*[xs[0] for xs in fine]))
    held = F.array(*[F.array(*xs) for xs in fine])
    return F.when(block == 0, 0).otherwise((block - 1) * step + upto(F.element_at(held, F.greatest(block, F.lit(1))))).cast("int")


#: Ids in the sample that splitters are taken from, for each partition, where quantiles of the ids can't be had.
SAMPLED = 100


def _splitters(rows: DataFrame, parts: int) -> tuple[list[Column], int]:
    """(splitters of the ids that aren't null, partitions for those that are), shares of `parts` by number of rows."""
    kind = rows.schema["doc_id"].dataType
    whole = isinstance(kind, T.IntegralType)
    shares = [k / parts for k in range(1, parts)]
    asked = [F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("known")]
    told = rows.agg(*asked, *[F.percentile_approx("doc_id", shares, 100 * parts).alias("q")] * (whole and bool(shares))).first()
    empty = -(-parts * (told["n"] - told["known"]) // max(1, told["n"]))
    if whole:
        found = sorted(set(told["q"] or [])) if shares else []
    else:  # a sample by hash, sorted as Spark sorts
        some = rows.filter(F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLED * parts).orderBy("doc_id").collect()
        found = [*dict.fromkeys(some[len(some) * k // parts][0] for k in range(1, parts))] if some else []
    return [F.lit(x).cast(kind) for x in found], empty


def with_next(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text, halo) in range partitions by id, sorted; each partition ends with a copy (halo 1) of the row that follows its last.

    Splitters are quantiles of the ids, one partition each, and null ids have partitions by their texts' hashes, so
    the rows pass through one shuffle and no task sees more than its share; after the last row comes the first.
    """
    parts = shuffle_partitions(docs.sparkSession)
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.when(F.col(id_col).isNull(), F.xxhash64(text)).alias("hash"), text.alias("text"))
    splitters, empty = _splitters(rows, parts)
    # Hashes in equal ranges: the sign bit moves the least to 0.
    by_hash = F.floor((F.col("hash").cast("double") / 2.0**64 + 0.5) * max(1, empty))
    by_hash = F.least(by_hash.cast("int"), F.lit(max(1, empty) - 1))
    rows = rows.withColumn("part", F.when(F.col("doc_id").isNull(), by_hash).otherwise(_part_of(F.col("doc_id"), splitters) + empty))
    heads = rows.groupBy("part").agg(F.min("doc_id").alias("id"), F.min("hash").alias("hash")).orderBy("part").collect()  # one row a partition
    if not heads:
        return rows.select("doc_id", "text", F.lit(0).alias("halo"))
    used = [r["part"] for r in heads]
    before = {p: used[k - 1] for k, p in enumerate(used)}
    back = F.element_at(F.array(*[F.lit(before.get(p, 0)) for p in range(max(used) + 1)]), F.col("part") + 1)
    kind = docs.schema[id_col].dataType
    first = F.col("doc_id").isin([F.lit(r["id"]).cast(kind) for r in heads if r["id"] is not None]) | F.coalesce(F.col("hash").isin([r["hash"] for r in heads if r["hash"] is not None]), F.lit(False))
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("halo"))
    copies = F.when(F.coalesce(first, F.lit(False)), F.array(own, F.struct(back.alias("part"), F.lit(1).alias("halo")))).otherwise(F.array(own))
    spread = rows.withColumn("to", F.explode(copies)).select(F.col("to.part").alias("part"), F.col("to.halo").alias("halo"), "doc_id", "hash", "text")
    return spread.repartitionById(max(used) + 1, F.col("part")).sortWithinPartitions("part", "halo", "doc_id", "hash", "text").select("doc_id", "text", "halo")


def _head_bytes(text: bytes, chars: int) -> int:
    """Bytes of the first so many code points."""
    if chars <= 0:
        return 0
    starts = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return len(text) if chars >= len(starts) else int(starts[chars])


def edited(own: bytes, chars: int, following: bytes) -> bytes:
    """own with its last half (rounded down) replaced by as much of the beginning of the following text."""
    half = chars // 2
    return own[: _head_bytes(own, chars - half)] + following[: _head_bytes(following, half)]


def compare_with_next(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Fingerprints of each text and of the text edited with the next document's beginning, and their likenesses."""
    ship(docs.sparkSession)
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
        *(T.StructField(f"{k}_{of}", T.DoubleType()) for k in ("near", "resemblance") for of in ("edited", "next")),
    ])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows: list[tuple], texts: list[bytes], own: list[np.ndarray]) -> pa.RecordBatch:
            """Of all rows but the last."""
            chars = [len(t.decode()) for t in texts[:-1]]
            changed = [edited(t, n, f) for t, n, f in zip(texts, chars, texts[1:])]  # noqa: B905
            marks = sketches(changed)
            near = [[*likeness(a, e), *likeness(a, b)] for a, e, b in zip(own, marks, own[1:])]  # noqa: B905
            columns = [
                [r[0] for r in rows[:-1]], chars, [hashlib.sha256(t).hexdigest() for t in changed], [*map(to_text, own[:-1])], [*map(to_text, marks)],
                *([x[k] for x in near] for k in (0, 2, 1, 3)),
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow, strict=True)], schema.names)

        from pyspark.sql.pandas.types import to_arrow_type

        arrow = [to_arrow_type(f.dataType) for f in schema.fields]
        held: tuple | None = None  # the last row seen, with its text and sketch
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, texts, halo = (c.to_pylist() for c in batch.slice(at, 256).columns)
                n = halo.index(1) + 1 if 1 in halo else len(ids)
                rows, raw = [(i,) for i in ids[:n]], [t.encode() for t in texts[:n]]
                marks = sketches(raw)
                if held:
                    rows, raw, marks = [held[0], *rows], [held[1], *raw], [held[2], *marks]
                if len(rows) > 1:
                    yield told(rows, raw, marks)
                held = rows[-1], raw[-1], marks[-1]
                if n < len(ids) or 1 in halo:
                    return

    return with_next(docs, text_col, id_col).mapInArrow(kernel, schema)
