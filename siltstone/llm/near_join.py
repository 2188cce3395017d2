"""N-gram Jaccard join by MinHash banding.

Each document's set of five-word shingles gets a MinHash signature; rows of it make bands, and documents
that agree in a whole band are candidates. The numbers of bands and rows follow from the similarity and the
recall asked for. Candidates are verified on their full shingle sets, in integers, never on signatures.

Equal sets are one node from the start, so copies cost nothing further. A bucket of up to SMALL nodes gives
its pairs. Larger buckets are not cut off: nodes that large buckets tie together form a group. A group is parted by
set size into levels, of which only a level and the next can reach the threshold, and levels into blocks
of at most BLOCK nodes and BYTES of sets; every pair of blocks is verified in a task of its own, which
returns a sum for each node and a spanning set of links, not the pairs. So no pair that shares a band is
lost, and rows written grow with the nodes.

Classes are the connected components of the verified links.

Defined results: a null text is the empty text; texts without words have equal (empty) sets and make one
class; a text of fewer than five words is one shingle, and texts of any length are taken whole; repeated rows are
copies of each other; ids may be null or repeat: every row is told apart by its own set, class_id is the least id
of the class that isn't null, and near_distinct keeps exactly one row of each class; an empty table gives an empty
result; columns of any name pass through near_distinct untouched, and near_classes reads the id and the text only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, fresh_name, ship, written
from .components import components, salt
from .fingerprints import SPACES, hasher
from .kernels import edges_of, mix, shingle_hashes

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.9995
SMALL, BLOCK, BYTES = 8, 1024, 8 << 20
#: Bits of the filter of wanted ids for each of them, the bits of one of its rows, and the bytes up to which it is broadcast.
FILTER_BITS, FILTER_ROW, FILTER_MOST = 16, 1 << 15, 64 << 20


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, stray: float = 0.2, most_rows: int = 12) -> tuple[int, int]:
    """(bands, rows): the fewest hashes that find a pair at the threshold with the recall, and one at half of it with at most stray."""
    found = []
    for rows in range(1, most_rows + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if 1 - (1 - (threshold / 2) ** rows) ** bands <= stray:
            found.append((bands * rows, bands, rows))
    return min(found)[1:]


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, edges): each text's distinct shingle hashes, ascending."""
    edges = edges_of(np.fromiter(map(len, texts), np.int64, len(texts)))
    words, parts = hasher(SPACES)(np.frombuffer(b"".join(texts), np.uint8), edges, lower=True)
    hashes, parts = shingle_hashes(words, parts, SHINGLE)
    own = [np.unique(hashes[a:b]) for a, b in zip(parts[:-1].tolist(), parts[1:].tolist(), strict=True)]
    return np.concatenate(own) if own else hashes, edges_of(np.fromiter(map(len, own), np.int64, len(own)))


def set_keys(hashes: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """16 bytes that name each set."""
    sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(s))))) for s in (0x51ED270B, 0xC2B2AE3D27D4EB4F)]
    both = np.stack([mix(s[edges[1:]] - s[edges[:-1]] + np.diff(edges).astype(np.uint64)) for s in sums], 1)
    return [row.tobytes() for row in both]


def minhash(hashes: np.ndarray, edges: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash of each band of each non-empty set: (sets, bands)."""
    full = np.flatnonzero(np.diff(edges))
    starts = edges[:-1][full]
    out = np.zeros((len(full), bands), np.uint64)
    if not len(full):
        return out
    seed = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64)).reshape(-1, 2)
    for k in range(bands * rows):
        least = np.minimum.reduceat(hashes * (seed[k, 0] | np.uint64(1)) + seed[k, 1], starts)
        out[:, k // rows] = mix(out[:, k // rows] * np.uint64(0x9E3779B97F4A7C15) + least + np.uint64(k // rows + 1))
    return out


def _slices(batch: pa.RecordBatch, rows: int = 128) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _raw(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [(t or "").encode() for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def signatures(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """(doc_id, node, n, bands) of every document; bands is empty for the empty set."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole):
                hashes, edges = shingle_sets(_raw(batch, "text"))
                sizes = np.diff(edges)
                marks = minhash(hashes, edges, bands, rows).view(np.int64).ravel()
                at = edges_of((sizes > 0).astype(np.int64) * bands).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(set_keys(hashes, edges), pa.binary()), pa.array(sizes), pa.ListArray.from_arrays(pa.array(at), pa.array(marks))],
                    ["doc_id", "node", "n", "bands"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(kernel, f"doc_id {kind}, node binary, n long, bands array<long>")


def _ratio(threshold: float) -> tuple[int, int]:
    exact = Fraction(str(threshold))
    return exact.numerator, exact.denominator


def among(docs: DataFrame, ids: DataFrame, id_col: str, most: int = FILTER_MOST) -> DataFrame:
    """The rows of docs whose id is one of ids (doc_id), and perhaps a few others.

    A filter of two bits an id, FILTER_BITS for each of them, grows with the ids and is broadcast while it takes
    at most `most` bytes; beyond that the rows are shuffled and joined with the ids.
    """
    rows = max(1, -(-ids.count() * FILTER_BITS // FILTER_ROW))
    if rows * FILTER_ROW // 8 > most:
        own = ids.select(F.col("doc_id").alias("_wanted")).distinct()
        return docs.join(own, docs[id_col].eqNullSafe(own["_wanted"]), "left_semi")
    row = lambda c: F.pmod(F.xxhash64(c), F.lit(rows)).cast("int")
    bits = lambda c: [F.pmod(F.xxhash64(c, F.lit(k)), F.lit(FILTER_ROW)) for k in "ab"]
    at, held, of = (fresh_name(docs, k) for k in ("row", "held", "of"))
    filled = ids.select(row("doc_id").alias(of), F.explode(F.array(*bits("doc_id"))).alias("bit")).groupBy(of).agg(F.bitmap_construct_agg("bit").alias(held))
    byte = lambda b: F.conv(F.hex(F.substring(F.col(held), (F.shiftright(b, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = lambda b: F.getbit(byte(b), (b % 8).cast("int")) == 1
    first, second = bits(id_col)
    joined = docs.withColumn(at, row(id_col)).join(F.broadcast(filled), F.col(at) == F.col(of))
    return joined.filter(is_set(first) & is_set(second)).drop(at, held, of)


def with_nodes(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """docs with the key of each text's shingle set."""
    at = docs.columns.index(text_col)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole):
                raw = [(t or "").encode() for t in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(set_keys(*shingle_sets(raw)), pa.binary())], [*batch.schema.names, name])

    return docs.mapInArrow(kernel, T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())]))


def sets_of(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, most: int = FILTER_MOST) -> DataFrame:
    """(node, hashes) of the nodes (node, doc_id): the shingle sets, packed, of the documents whose ids are wanted; the join on the set's own key decides."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole):
                hashes, edges = shingle_sets(_raw(batch, "text"))
                packed = [hashes[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(hashes, edges), pa.binary()), pa.array(packed, pa.binary())], ["node", "hashes"])

    some = among(docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id")), nodes, "id", most)
    made = some.select("text").mapInArrow(kernel, "node binary, hashes binary")
    return made.join(nodes.select("node"), "node", "left_semi").groupBy("node").agg(F.first("hashes").alias("hashes"))


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    p, q = _ratio(threshold)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if min(len(x), len(y)) * q < p * max(len(x), len(y)):
                    ok.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both * q >= p * (len(x) + len(y) - both))
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(kernel, "a binary, b binary")


def _common(sets: list[np.ndarray], columns: int = 1 << 12) -> np.ndarray:
    """Sizes of all intersections of the sets, a slice of the shared elements at a time."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, element, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    some = times[element] > 1
    row, element = row[some], shared[element[some]]
    out = np.zeros((n, n), np.int32)
    order = np.argsort(element, kind="stable")
    row, element = row[order], element[order]
    for low in range(0, int(element[-1]) + 1 if len(element) else 0, columns):
        a, b = np.searchsorted(element, (low, low + columns))
        held = np.zeros((n, columns), np.float32)
        held[row[a:b], element[a:b] - low] = 1
        out += (held @ held.T).astype(np.int32)  # whole numbers of at most `columns`, exact in float32
    return out


def level_width(threshold: float) -> float:
    """Logarithm of the sizes' ratio inside a level: two sets that reach the threshold are at most one level apart."""
    return -math.log(threshold) * 1.0001


def verify_blocks(members: DataFrame, sets: DataFrame, threshold: float, block: int, most_bytes: int = BYTES) -> DataFrame:
    """(a, b, n_links) from groups (node, grp, n_docs, n): a links to n_links documents in a pair of blocks; b: its spanning link there."""
    width, (p, q) = level_width(threshold), _ratio(threshold)
    members = members.withColumns({"level": F.floor(F.log(F.col("n").cast("double")) / width).cast("int"), "part": salt("node")})
    parts = members.groupBy("grp", "level", "part").agg(F.count(F.lit(1)).alias("held"))
    capacity = F.greatest(F.lit(1.0), F.least(F.lit(float(block)), F.lit(float(most_bytes)) / (8 * F.exp((F.col("level") + 1) * width))))
    own = parts.groupBy("grp", "level").agg(F.ceil(F.sum("held") / capacity).cast("int").alias("blocks"))
    beside = lambda step, name: own.select("grp", (F.col("level") + step).alias("level"), F.col("blocks").alias(name))
    sized = own.join(beside(1, "lower"), ["grp", "level"], "left").join(beside(-1, "upper"), ["grp", "level"], "left")
    # A group may hold most nodes: what is known of it goes to its parts, and the members join by part.
    told = parts.select("grp", "level", "part").join(sized, ["grp", "level"])
    placed = members.join(told, ["grp", "level", "part"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    upto = lambda n: F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: k < n)
    meet = lambda la, i, lb, j, side: F.struct(la.alias("la"), i.alias("i"), lb.alias("lb"), j.alias("j"), F.lit(side).alias("side"))
    level, mine = F.col("level"), F.col("own")
    # A node meets each block of its level and of the levels beside it once.
    meetings = F.concat(
        F.transform(upto(F.col("blocks")), lambda k: F.when(k >= mine, meet(level, mine, level, k, 0)).otherwise(meet(level, k, level, mine, 1))),
        F.transform(upto(F.coalesce("upper", F.lit(0))), lambda k: meet(level, mine, level + 1, k, 0)),
        F.transform(upto(F.coalesce("lower", F.lit(0))), lambda k: meet(level - 1, k, level, mine, 1)),
    )
    dealt = placed.withColumn("m", F.explode(meetings)).select("grp", "m.*", "node", "n_docs")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        sets_ = [np.frombuffer(x, np.uint64) for x in pdf["hashes"]]
        size = np.fromiter(map(len, sets_), np.int64, len(sets_))
        both = _common(sets_).astype(np.int64)
        linked = both * (p + q) >= p * (size[:, None] + size)
        del both
        np.fill_diagonal(linked, False)
        side = pdf["side"].to_numpy()
        if (pdf["la"].iat[0], pdf["i"].iat[0]) != (pdf["lb"].iat[0], pdf["j"].iat[0]):  # pairs within a block are another task's
            linked &= side[:, None] != side
        weight = linked.astype(np.int64) @ pdf["n_docs"].to_numpy()
        root = np.arange(len(pdf))
        while True:  # least linked node, until nothing moves
            least = np.where(linked, root, len(root)).min(1)
            new = np.minimum(root, least)
            new = np.minimum(new, new[new])
            if (new == root).all():
                break
            root = new
        some = weight > 0
        return pd.DataFrame({"a": pdf["node"][some], "b": pdf["node"].to_numpy()[root[some]], "n_links": weight[some]})

    return dealt.join(sets, "node").groupBy("grp", "la", "i", "lb", "j").applyInPandas(kernel, "a binary, b binary, n_links long")


def _solved(docs: DataFrame, text_col: str, id_col: str, threshold: float, recall: float, small: int, block: int, filter_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, n) of every row, and what is known of the nodes with copies or links: node, class_id, component, links, n_docs."""
    ship(docs.sparkSession)
    bands, rows = choose_bands(threshold, recall)
    marked = written(signatures(docs, id_col, text_col, bands, rows), "signatures")
    nodes = written(marked.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_docs"), F.first("n").alias("n"), F.first("bands").alias("bands")), "nodes")
    dealt = nodes.select("node", F.explode("bands").alias("bucket")).withColumn("part", salt("node"))
    # A bucket may hold most nodes: it is counted by parts, and its star is tied part by part.
    parts = written(dealt.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("low"), F.max("node").alias("high")), "bucket-parts")
    buckets = written(parts.groupBy("bucket").agg(F.sum("size").alias("size"), F.min("low").alias("low"), F.max("high").alias("high")).filter("size > 1"), "buckets")
    two = buckets.filter("size = 2").select(F.col("low").alias("a"), F.col("high").alias("b"))
    some = dealt.join(buckets.filter(F.col("size").between(3, small)).select("bucket"), "bucket").groupBy("bucket").agg(F.sort_array(F.collect_list("node")).alias("all"))
    rest = some.select(F.posexplode("all").alias("at", "a"), "all").select("a", F.explode(F.slice("all", F.col("at") + 2, small)).alias("b"))
    pairs = two.union(rest).distinct()
    # Large buckets: groups of what they tie together. A star for each part of a bucket, and one of the parts; not its pairs.
    heads = parts.join(buckets.filter(F.col("size") > small).select("bucket", F.col("low").alias("root")), "bucket").select("bucket", "part", "low", "root")
    stars = dealt.join(heads, ["bucket", "part"]).select(F.col("node").alias("a"), F.col("low").alias("b")).union(heads.select("low", "root"))
    grouped = components(stars)
    groups = written(grouped.join(nodes.select("node", "n_docs", "n"), "node").select("node", F.col("component").alias("grp"), "n_docs", "n"), "groups")
    # A pair inside one group is verified with the group.
    ga, gb = (groups.select(F.col("node").alias(x), F.col("grp").alias(f"g{x}")) for x in "ab")
    pairs = written(pairs.join(ga, "a", "left").join(gb, "b", "left").filter("ga is null or gb is null or ga != gb").select("a", "b"), "pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).union(groups.select("node")).distinct()
    wanted = written(wanted.join(nodes.select("node", "doc_id", "n_docs"), "node"), "wanted")
    sets = written(sets_of(docs, wanted, id_col, text_col, filter_bytes), "sets")
    links = written(verify(pairs, sets, threshold), "verified")
    blocks = written(verify_blocks(groups, sets, threshold, block), "blocks")
    discard(parts, buckets, groups, pairs, wanted, sets)
    joined = components(links.union(blocks.select("a", "b")))
    weight = nodes.select("node", "n_docs")
    one = links.join(weight, links["b"] == weight["node"]).select("a", F.col("n_docs").alias("n_links"))
    other = links.join(weight, links["a"] == weight["node"]).select(F.col("b").alias("a"), F.col("n_docs").alias("n_links"))
    degree = one.union(other).union(blocks.select("a", "n_links")).groupBy("a").agg(F.sum("n_links").alias("near"))
    # Only nodes with copies or links need a look-up; all others are classes of their own.
    known = nodes.filter("n_docs > 1").select("node").union(joined.select("node")).distinct().join(nodes.select("node", "doc_id", "n_docs"), "node")
    known = known.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = written(known.join(degree, F.col("node") == F.col("a"), "left").select("node", "component", "doc_id", "n_docs", (F.coalesce("near", F.lit(0)) + F.col("n_docs") - 1).alias("n_links")), "known")
    discard(links, blocks, nodes)
    return marked, known


def near_classes(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, recall: float = RECALL, small: int = SMALL, block: int = BLOCK, filter_bytes: int = FILTER_MOST
) -> DataFrame:
    """One row per input row: doc_id, class_id (least id of its class), n_links, set_size.

    n_links: other documents whose shingle sets reach the threshold with this one's, copies included.
    """
    marked, known = _solved(docs, text_col, id_col, threshold, recall, small, block, filter_bytes)
    classes = known.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    known = written(known.join(classes, "component").select("node", "class_id", "n_links"), "classes")
    out = marked.select("doc_id", "node", F.col("n").alias("set_size")).join(known.withColumn("found", F.lit(True)), "node", "left")
    return out.select("doc_id", F.when(F.col("found"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "set_size")


def near_distinct(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, recall: float = RECALL, small: int = SMALL, block: int = BLOCK, filter_bytes: int = FILTER_MOST
) -> DataFrame:
    """docs with exactly one row of each class: that of the least id (null ids last), then of the least set key, then of the least text; same columns.

    Rows are told apart by (id, set): the texts of ids that have both rows that stay and rows that go, or repeated
    rows, are looked at once more; all other rows are decided by their id.
    """
    marked, known = _solved(docs, text_col, id_col, threshold, recall, small, block, filter_bytes)
    rows = marked.groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("rows"))
    rows = rows.join(known.select("node", "component"), "node", "left").withColumn("order", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node"))
    # Hot classes: a row for each (id, set), and their leasts put together by a combining aggregate.
    best = rows.filter("component is not null").groupBy("component").agg(F.min("order").alias("best"))
    stays = F.col("component").isNull() | (F.col("order") == F.col("best"))
    rows = written(rows.join(best, "component", "left").select("doc_id", "node", "rows", stays.alias("stays")), "rows")
    ids = rows.groupBy("doc_id").agg(F.min(F.col("stays") & (F.col("rows") == 1)).alias("clear"), F.max("stays").alias("some"))
    ids = written(ids.filter(~F.col("clear")).select(F.col("doc_id").alias("_touched"), "some"), "touched")
    gone, some, node = (fresh_name(docs, k) for k in ("gone", "some", "node"))
    told = ids.select(F.col("_touched").alias(gone), F.col("some").alias(some))
    plain = docs.join(told, docs[id_col].eqNullSafe(told[gone]), "left_anti")
    mixed = told.filter(F.col(some)).select(gone)
    again = with_nodes(docs.join(mixed, docs[id_col].eqNullSafe(mixed[gone]), "left_semi"), text_col, node)
    keep = rows.filter("stays").select(F.col("doc_id").alias(gone), F.col("node").alias(some))
    again = again.join(keep, again[id_col].eqNullSafe(keep[gone]) & (again[node] == keep[some]), "left_semi")
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)])
    one = again.groupBy(F.col(id_col).alias(gone), node).agg(F.min_by(whole, F.coalesce(F.col(text_col), F.lit(""))).alias(some))
    return plain.union(one.select(*[F.col(some)[f"c{k}"].alias(c) for k, c in enumerate(docs.columns)]))
