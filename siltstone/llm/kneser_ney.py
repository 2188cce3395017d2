"""Language-model scoring with an interpolated modified Kneser-Ney model of any order from 2.

Counting. Words are hashed to 64 bits (among 10^9 distinct words the odds of one collision are about 1 in 40). One job lists the words, so that an n-gram travels as
its words' numbers. The n-grams of the highest order are then counted in PASSES jobs over the whole text, each for its own part of the shards; when a pass has
ended its shuffle files are deleted, so the disk holds the model and one pass. In its pass an n-gram goes, from order 3 on, to two shards: that of its context
(its own count, and the context's followers by count) and that of its end (the words before it), so that both kinds of numbers of a shorter n-gram meet in one shard
without another exchange. All n-grams of one such context are in one shard; contexts of one word are spread by a part of the last word. One
more exchange for each lower order, and the last one for words, bring the rest together.

Model. Every shard is sorted hash arrays (words; n-grams of each order) in files of the shared folder. Workers map them
into memory and look up whole batches of distinct hashes at once; pages are shared and evicted by the
system, so a worker's own memory stays small however large the model is. The shared folder must be mounted
as files on all workers (its address starts with file: or is a path). There are at least as many shards as shuffle
partitions, or more where the text has more than SHARD_BYTES for each, so a shard's n-grams fit one task's memory.
Counts take a byte each; those of 255 and more stand beside them, whole, with their places.

Counts. The highest order has plain counts; lower ones count the distinct words before, but n-grams that begin with
the start context, which nothing precedes, keep their plain counts.

Discounts are those of Chen and Goodman: D1, D2, D3+ from the numbers of n-grams of count 1 to 4, for
each order by its own counts and for words by the numbers of their contexts; in an order where one of those four
numbers is 0 (small or odd corpora), they are undefined, and 0.5, 1 and 1.5 stand in. Words interpolate with an even
share for each known word and one for all unknown ones.

Tokens: with A-Z lower-cased, words are runs of other than space and \\t to \\r; each text ends with one end token
and starts in a start context. Defined results: a null text is the empty text, of one token; without
training text every probability is 1; texts of any length are counted and scored whole, and a slice's arrays grow
with its longest text; repeated rows and null ids count as often as they stand there; an empty table gives an empty
result; other columns pass through, and the operator's own take the place of columns of the same name.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, making_room, shared_dir, ship, shuffle_partitions, whole_text, written
from .fingerprints import SPACES, hasher
from .kernels import edges_of, give_back, mix, raw_slices

END, START = np.uint64(0x5B1E3C7D2A01), np.uint64(0xFFEE12345677)
#: Stands before the start, where a context is shorter than the order asks for.
PAD = np.uint64(0xFFEE12345678)
#: Parts that the followers of one word are split into.
SPLIT = 16
#: Tokens that a task counts before it sends blocks, and bytes of text for each shard at most.
HELD, SHARD_BYTES = 4_000_000, 16 << 20
#: Passes over the text, each for its own part of the shards, and the text below which fewer do.
PASSES, PASS_BYTES = 3, 32 << 20
#: Bytes of text that are scored at a time.
SLICE = 4 << 20


def tokens(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, edges): each text's words and its end token; texts are raw[edges[k] : edges[k + 1]]."""
    words, parts = hasher(SPACES)(raw, edges, lower=True)
    out = np.full(len(words) + len(edges) - 1, END)
    out_edges = parts + np.arange(len(edges))
    inside = np.ones(len(out), bool)
    inside[out_edges[1:] - 1] = False
    out[inside] = words
    return out, out_edges


def grams(words: np.ndarray, edges: np.ndarray, order: int, start: int = START, pad: int = PAD) -> list[np.ndarray]:
    """The order - 1 tokens before each token, the farthest first, and the token; the start where a text begins."""
    at = np.arange(len(words)) - np.repeat(edges[:-1], np.diff(edges))
    out = [words]
    for back in range(1, order):
        before = np.full(len(words), pad, words.dtype)
        before[back:] = words[: max(0, len(words) - back)]
        before[at < back] = pad
        before[at == back - 1] = start
        out.insert(0, before)
    return out


def pair_key(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mix(u * np.uint64(0x9E3779B97F4A7C15) + mix(v + np.uint64(0x632BE59BD9B4E019)))


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    return ((key >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int64)


def pair_shard(u: np.ndarray, v: np.ndarray, shards: int) -> np.ndarray:
    return shard_of(mix(u + (v >> np.uint64(60)) * np.uint64(0xA24BAED4963EE407)), shards)


def gram_key(words: list[np.ndarray]) -> np.ndarray:
    key = pair_key(words[-2], words[-1])
    for w in words[-3::-1]:
        key = pair_key(w, key)
    return key


def gram_shard(words: list[np.ndarray], shards: int) -> np.ndarray:
    return pair_shard(words[0] if len(words) == 2 else gram_key(words[:-1]), words[-1], shards)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes; all first bytes of an array's numbers, then all second ones and so on, so that a codec finds the zeros."""
    head = np.array([len(arrays), *[x for a in arrays for x in (len(a), np.dtype(a.dtype).num)]], np.int64)
    return head.tobytes() + b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"" for a in arrays)


_TYPES = {np.dtype(t).num: np.dtype(t) for t in (np.uint64, np.uint32, np.uint16, np.uint8, np.int64, np.float64)}


def unpack(block: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(block, np.int64, 1)[0])
    head = np.frombuffer(block, np.int64, 2 * n, 8)
    at, out = 8 + 16 * n, []
    for k in range(n):
        kind, size = _TYPES[int(head[2 * k + 1])], int(head[2 * k])
        planes = np.frombuffer(block, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += size * kind.itemsize
    return out


def _summed(keys: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys ascending, and each value's sums."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate((np.ones(1, bool), keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], [np.add.reduceat(v[order].astype(np.int64), first) if len(first) else v.astype(np.int64) for v in values]


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """One file, whole or not at all, however often the task runs."""
    fd, path = tempfile.mkstemp(dir=folder, prefix=f".{name}-")
    with os.fdopen(fd, "wb") as f:
        np.save(f, array)
    os.replace(path, os.path.join(folder, f"{name}.npy"))


def _save_numbers(folder: str, name: str, numbers: np.ndarray) -> None:
    """Counts (rows, columns): a byte each, and the places and values of those of 255 and more."""
    flat = numbers.ravel()
    places = np.flatnonzero(flat >= 255)
    _save(folder, f"more{name}", np.stack((places, flat[places]), 0).astype(np.int64))
    _save(folder, f"counts{name}", np.minimum(numbers, 255).astype(np.uint8))


def _by_shard(shard: np.ndarray, shards: int, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    shard = shard.astype(np.uint16) if shards <= 2**16 else shard
    order = np.argsort(shard, kind="stable")
    at = np.searchsorted(shard[order], np.arange(shards + 1))
    for k in np.flatnonzero(np.diff(at)).tolist():
        yield k, [a[order[at[k] : at[k + 1]]] for a in arrays]


class NGrams:
    """A trained model: where its arrays are, and its few global numbers; discounts are those of each order from 2."""

    def __init__(self, folder: str, shards: int, order: int, words: int, train: int, pairs: int, discounts: list[list[float]], word_discounts: list[float], share: float):
        self.folder, self.shards, self.order, self.words, self.train, self.pairs = folder, shards, order, words, train, pairs
        self.discounts, self.word_discounts, self.share = discounts, word_discounts, share


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """D1, D2, D3+ (place 0 is for counts of 0)."""
    if min(n1, n2, n3, n4) <= 0:
        return [0.0, 0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [0.0, *(max(0.0, d) for d in (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3))]


def local_folder(spark) -> str:
    where = shared_dir(spark)
    if "://" in where and not where.startswith("file://") or where.startswith(("hdfs:", "s3")):
        raise ValueError(f"the model's arrays are mapped into memory: {where} must be mounted as files")
    folder = f"{where.removeprefix('file://').removeprefix('file:')}/siltstone/lm-{uuid.uuid4().hex}"
    os.makedirs(folder, exist_ok=True)
    atexit.register(shutil.rmtree, folder, True)
    return folder


_BLOCKS = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("block", T.BinaryType())])


def _batch(rows: list[tuple[int, str, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.binary())], _BLOCKS.names)


def _gathered(batches: Iterator[pa.RecordBatch]) -> dict[int, list[tuple[str, bytes]]]:
    """(kind, block) of each shard that a task was given."""
    out: dict[int, list[tuple[str, bytes]]] = {}
    for batch in batches:
        for k, kind, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out.setdefault(k, []).append((kind, block))
    return out


def _tight(a: np.ndarray) -> np.ndarray:
    """Numbers in as few bytes as the largest needs."""
    most = int(a.max()) if a.size else 0
    return a.astype(np.uint8 if most < 2**8 else np.uint16 if most < 2**16 else np.uint32 if most < 2**32 else np.uint64)


def _counts(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts in a byte each, and those that don't fit."""
    return np.minimum(n, 255).astype(np.uint8), n[n >= 255].astype(np.int64)


def _counted(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    n = small.astype(np.int64)
    n[n == 255] = large
    return n


def _pack_grams(words: list[np.ndarray], n: np.ndarray) -> bytes:
    """N-grams in runs of one first word, and their counts: each run's word, how many it holds, the other words."""
    starts = np.flatnonzero(np.concatenate((np.ones(1, bool), words[0][1:] != words[0][:-1])))
    return pack(_tight(words[0][starts]), _tight(np.diff(np.concatenate((starts, [len(n)])))), *map(_tight, words[1:]), *_counts(n))


def _unpack_grams(blocks: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    parts = [unpack(b) for b in blocks]
    rows = [[np.repeat(p[0].astype(np.uint64), p[1]), *p[2:-2]] for p in parts]
    return [np.concatenate(x).astype(np.uint64) for x in zip(*rows, strict=True)], np.concatenate([_counted(*p[-2:]) for p in parts])


def _distinct(words: list[np.ndarray], size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct n-grams of numbers below size, in order, and how often each occurs."""
    code, parts, digits, most = words[0].astype(np.uint64), [np.arange(size, dtype=np.uint64)], 0, size
    for w in words[1:]:
        if most * size >= 2**64:  # the beginnings found so far are numbered anew
            code, again = np.unique(code, return_inverse=True)
            parts, digits, most, code = _spelt(code, parts, digits, size), 0, len(code), again.astype(np.uint64)
        code, digits, most = code * np.uint64(size) + w.astype(np.uint64), digits + 1, most * size
    code, n = np.unique(code, return_counts=True)
    return _spelt(code, parts, digits, size), n


def _spelt(code: np.ndarray, parts: list[np.ndarray], digits: int, size: int) -> list[np.ndarray]:
    """The words of coded n-grams: a place in parts, which spell a beginning, and so many digits, each a word."""
    tail: list[np.ndarray] = []
    for _ in range(digits):
        tail.insert(0, code % np.uint64(size))
        code = code // np.uint64(size)
    return [*(p[code.astype(np.int64)] for p in parts), *tail]


def _first(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate((np.ones(1, bool), keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)


class _Vocabulary:
    """The words' files of a model that is being trained: a word's number is its place among all shards' words."""

    def __init__(self, folder: str, sizes: np.ndarray):
        self.arrays, self.edges = _Arrays(folder), edges_of(sizes)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of distinct words, each of which is known."""
        out, shards = np.zeros(len(hashes), np.uint64), len(self.edges) - 1
        for k, (rows,) in _by_shard(shard_of(mix(hashes), shards), shards, np.arange(len(hashes))):
            out[rows] = np.searchsorted(self.arrays.get("word", k), hashes[rows]) + self.edges[k]
        return out

    def hashes(self, words: list[np.ndarray]) -> list[np.ndarray]:
        """The hashes of numbered words."""
        if self.edges[-1] <= sum(map(len, words)):
            every = np.concatenate([x for k in range(len(self.edges) - 1) if (x := self.arrays.get("word", k)) is not None])
            return [every[w.astype(np.int64)] for w in words]
        number, at = np.unique(np.concatenate(words), return_inverse=True)
        number, out = number.astype(np.int64), np.zeros(len(number), np.uint64)
        cuts = np.searchsorted(number, self.edges)
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            out[cuts[k] : cuts[k + 1]] = self.arrays.get("word", k)[number[cuts[k] : cuts[k + 1]] - self.edges[k]]
        return [*out[at].reshape(len(words), -1)]


@contextmanager
def _freed_shuffles(spark) -> Iterator[None]:
    """Spark deletes each job's shuffle files when the job has ended, so that passes take their disk one after another."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def home(words: list[np.ndarray], shards: int, top: bool) -> np.ndarray:
    """The shard of an n-gram: of the highest order (3 and up), that of its context, whose numbers are then at hand there."""
    return gram_shard(words[:-1] if top and len(words) > 2 else words, shards)


def train(docs: DataFrame, text_col: str = "text", order: int = 2) -> NGrams:
    """Count all of docs and write the model."""
    if order < 2:
        raise ValueError("order must be at least 2")
    spark = docs.sparkSession
    ship(spark)
    size = docs.select(F.octet_length(whole_text(text_col)).alias("n")).agg(F.sum("n")).first()[0] or 0
    passes = min(PASSES, max(1, -(-size // PASS_BYTES)))
    partitions = shuffle_partitions(spark)
    own = max(-(-max(partitions, -(-size // SHARD_BYTES)) // passes), min(partitions, spark.sparkContext.defaultParallelism))  # shards of a pass
    shards, folder = passes * own, local_folder(spark)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(hashes, tokens of each text) of about HELD tokens at a time."""
        some, size = [], 0
        for batch in batches:
            for raw, cuts in raw_slices(batch.column(0)):
                hashes, edges = tokens(raw, cuts)
                some.append((hashes, np.diff(edges)))
                size += len(hashes)
                if size >= HELD:
                    yield tuple(np.concatenate(x) for x in zip(*some, strict=True))
                    some, size = [], 0
        if some:
            yield tuple(np.concatenate(x) for x in zip(*some, strict=True))

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, _ in held(batches):
            h, n = np.unique(hashes, return_counts=True)
            # What stands before a text gets a number too; it doesn't occur.
            h, n = np.concatenate((h, np.array([START, PAD]))), np.concatenate((n, np.zeros(2, np.int64)))
            for k, (x, c) in _by_shard(shard_of(mix(h), shards), shards, h, n):
                yield _batch([(k, "v", pack(x, _tight(c)))])
        give_back()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, blocks in _gathered(batches).items():
            parts = [unpack(b) for _, b in blocks]
            h, (n,) = _summed(np.concatenate([p[0] for p in parts]), [np.concatenate([p[1] for p in parts])])
            _save(folder, f"word-{k}", h)
            _save(folder, f"plain-{k}", _tight(n))
            yield _batch([(k, "v", np.array([len(h)], np.int64).tobytes())])

    def count(at_pass: int):
        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _Vocabulary(folder, sizes)
            for hashes, lengths in held(batches):
                vocabulary, at = np.unique(hashes, return_inverse=True)
                wide = np.concatenate((vocabulary, np.array([START, PAD])))
                numbers = known.numbers(wide)
                at = grams(at.astype(np.uint32), edges_of(lengths), order, np.uint32(len(vocabulary)), np.uint32(len(vocabulary) + 1))
                # An n-gram goes where its context is counted and, once more, where its end is.
                ends = [("g", lambda w: home(w, shards, True))] + [("s", lambda w: gram_shard(w[1:], shards))] * (order > 2)
                for kind, where in ends:
                    mine = where([wide[w] for w in at]) // own == at_pass
                    words, n = _distinct([w[mine] for w in (at if kind == "g" else [*at[1:], at[0]])], len(wide))
                    if not len(n):
                        continue
                    shard = where([wide[w.astype(np.int64)] for w in (words if kind == "g" else [words[-1], *words[:-1]])])
                    for k, (*w, c) in _by_shard(shard, shards, *words, n):
                        yield _batch([(k, kind, _pack_grams([numbers[x.astype(np.int64)] for x in w], c))])
            give_back()

        return counted

    def summed(blocks: list[bytes], known: _Vocabulary, turned: bool) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Distinct n-grams by key: (key, count, hashes, numbers); turned: their first word was sent last."""
        numbers, n = _unpack_grams(blocks)
        if turned:
            numbers = [numbers[-1], *numbers[:-1]]
        words = known.hashes(numbers)
        key = gram_key(words)
        by = np.argsort(key)
        first = _first(key[by])
        n = np.add.reduceat(n[by], first)
        by, key = by[first], key[by[first]]
        return key, n, [w[by] for w in words], [w[by] for w in numbers]

    def saved(level: int, shard: int, key: np.ndarray, whole: np.ndarray, numbers: list[np.ndarray]) -> pa.RecordBatch:
        _save(folder, f"gram{level}-{shard}", key[whole])
        _save_numbers(folder, f"{level}-{shard}", np.stack(numbers, 1)[whole])
        return _batch([(0, f"n{level}", np.bincount(np.minimum(numbers[0][whole], 5), minlength=6).astype(np.int64).tobytes())])

    def following(key: np.ndarray, contexts: np.ndarray, sums: list[np.ndarray]) -> list[np.ndarray]:
        """The contexts' sums at the places of their keys."""
        at, out = np.searchsorted(key, contexts), []
        for x in sums:
            out.append(np.zeros(len(key), np.int64))
            out[-1][at] = x
        return out

    def told(level: int, n: np.ndarray, whole: np.ndarray, words: list[np.ndarray], numbers: list[np.ndarray], sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        """What a shard's n-grams say of shorter ones."""
        values = (n == 1, n == 2, n > 2, n)
        if level == 2:
            # Of each word: contexts it follows; its followers of count 1, 2 and more, and tokens.
            zero, edges = 0 * n, edges_of(sizes)
            number, (after, *follow) = _summed(np.concatenate((numbers[1], numbers[0])), [np.concatenate((zero + 1, zero)), *(np.concatenate((zero, x)) for x in values)])
            cuts = np.searchsorted(number.astype(np.int64), edges)
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                place, *rest = (x[cuts[k] : cuts[k + 1]] for x in (number.astype(np.int64) - edges[k], after, *follow))
                yield _batch([(k, "w", pack(_tight(np.diff(place, prepend=0)), *map(_tight, rest)))])
            return
        # Of each n-gram without its last word: followers; without its first one: words before it.
        before = [w[whole] for w in words[:-1]]
        where = gram_shard(before, shards)
        c, follow = _summed(gram_key(before), [x[whole] for x in values])
        place = np.zeros(len(c), np.int64)
        place[np.searchsorted(c, gram_key(before))] = where
        for k, (x, *rest) in _by_shard(place, shards, c, *follow):
            yield _batch([(k, "c", pack(x, *(y for r in rest for y in _counts(r))))])
        rest = gram_key(words[1:])
        by = np.argsort(rest)
        first = _first(rest[by])
        after = np.add.reduceat(np.where(whole, 1, n)[by], first)
        by, after = (by[first])[order_of := np.argsort(numbers[1][by[first]])], after[order_of]
        for k, (*w, a) in _by_shard(gram_shard([w[by] for w in words[1:]], shards), shards, *(w[by] for w in numbers[1:]), after):
            yield _batch([(k, "g", _pack_grams(w, a))])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The highest order, and the next from it: all n-grams that begin or end with one of this shard's are here."""
        known = _Vocabulary(folder, sizes)
        for shard, blocks in _gathered(batches).items():
            contexts, follow = np.zeros(0, np.uint64), [np.zeros(0, np.int64)] * 4
            if top := [b for kind, b in blocks if kind == "g"]:
                key, n, words, numbers = summed(top, known, False)
                # What begins before the start is a shorter n-gram with its plain count.
                whole = words[0] != PAD
                yield saved(order, shard, key, whole, [n])
                if order == 2:
                    yield from told(2, n, whole, words, numbers, sizes)
                    continue
                n = n[whole]
                contexts, follow = _summed(gram_key([w[whole] for w in words[:-1]]), [n == 1, n == 2, n > 2, n])
                del key, n, words, numbers, whole
            if not (ends := [b for kind, b in blocks if kind == "s"]):  # no n-gram ends with what stands before a text
                continue
            key, n, words, numbers = summed(ends, known, True)
            key = gram_key(words[1:])
            by = np.argsort(key)
            first = _first(key[by])
            n = np.add.reduceat(np.where(words[0] != PAD, 1, n)[by], first)
            by, key = by[first], key[by[first]]
            words, numbers = [w[by] for w in words[1:]], [w[by] for w in numbers[1:]]
            whole = words[0] != PAD
            yield saved(order - 1, shard, key, whole, [n, *following(key, contexts, follow)])
            yield from told(order - 1, n, whole, words, numbers, sizes)
        give_back()

    def lower(level: int):
        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _Vocabulary(folder, sizes)
            for shard, blocks in _gathered(batches).items():
                key, n, words, numbers = summed([b for kind, b in blocks if kind == "g"], known, False)
                whole = words[0] != PAD
                parts = [unpack(b) for kind, b in blocks if kind == "c"]
                c, sums = _summed(np.concatenate([t[0] for t in parts]), [np.concatenate([_counted(*t[j : j + 2]) for t in parts]) for j in range(1, 9, 2)]) if parts else (key[:0], [n[:0]] * 4)
                yield saved(level, shard, key, whole, [n, *following(key, c, sums)])
                yield from told(level, n, whole, words, numbers, sizes)
            give_back()

        return merged

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = _Arrays(folder)
        for shard, blocks in _gathered(batches).items():
            plain = arrays.get("plain", shard)
            sums = np.zeros((len(plain), 6), np.int64)
            sums[:, 0] = plain
            for kind, b in blocks:
                if kind == "w":
                    place, *rest = unpack(b)
                    sums[np.cumsum(place, dtype=np.int64), 1:] += np.stack(rest, 1).astype(np.int64)
            _save_numbers(folder, f"1-{shard}", sums)
            after = sums[:, 1]
            yield _batch([(0, "v", np.array([(plain > 0).sum(), plain.sum(), after.sum(), *np.bincount(np.minimum(after, 5), minlength=6)[1:5]], np.int64).tobytes())])

    texts = docs.select(whole_text(text_col).alias("text"))
    dealt = lambda df, n: df.repartitionById(n, F.col("shard") % n)
    with _freed_shuffles(spark):
        listing = written(dealt(texts.mapInArrow(vocabulary, _BLOCKS), shards).mapInArrow(listed, _BLOCKS), "lm-vocabulary")
        sizes = np.zeros(shards, np.int64)
        for r in listing.select("shard", "block").collect():  # one number a shard
            sizes[r[0]] = np.frombuffer(r[1], np.int64)[0]
        found = [written(dealt(texts.mapInArrow(count(k), _BLOCKS), own).mapInArrow(merged, _BLOCKS), f"lm-blocks-{k}") for k in range(passes)]
        add = lambda tables, kind, n: np.sum([np.frombuffer(r[0], np.int64) for t in tables for r in t.filter(F.col("kind") == kind).select("block").collect()] or [np.zeros(n, np.int64)], 0)
        counts = {k: add(found, f"n{k}", 6) for k in range(max(2, order - 1), order + 1)}  # a few numbers a shard
        for level in range(order - 2, 1, -1):
            blocks = reduce(DataFrame.unionAll, [t.filter("kind in ('c', 'g')") for t in found])
            below = written(dealt(blocks, shards).mapInArrow(lower(level), _BLOCKS), f"lm-blocks-of-{level}")
            discard(*found)
            found, counts[level] = [below], add([below], f"n{level}", 6)
        # Every shard of words has a row, as words that no n-gram ends or begins with have numbers too.
        blocks = reduce(DataFrame.unionAll, [t.filter("kind = 'w'") for t in found], listing)
        gathered = written(dealt(blocks, shards).mapInArrow(words, _BLOCKS), "lm-words")
    numbers = add([gathered], "v", 7)
    discard(listing, *found, gathered)
    by_count = [counts[k] for k in range(2, order + 1)]
    v, n, pairs = (int(x) for x in numbers[:3])
    d, dw = [discounts(*map(int, c[1:5])) for c in by_count], discounts(*map(int, numbers[3:7]))
    t1, t2 = int(numbers[3]), int(numbers[4])
    rest = dw[1] * t1 + dw[2] * t2 + dw[3] * max(0, v - t1 - t2)
    return NGrams(folder, shards, order, v, n, pairs, d, dw, rest / pairs if pairs else 1.0)


class _Arrays:
    """A worker's view of the model's files."""

    def __init__(self, folder: str):
        self.folder, self.open = folder, {}

    def get(self, name: str, shard: int) -> np.ndarray | None:
        key = f"{name}-{shard}"
        if key not in self.open:
            path = os.path.join(self.folder, f"{key}.npy")
            self.open[key] = np.asarray(np.load(path, mmap_mode="r")) if os.path.exists(path) else None
        return self.open[key]

    def find(self, keys: np.ndarray, shard: np.ndarray, shards: int, name: str, level: int, width: int) -> np.ndarray:
        """Values of ascending keys; zeros where a key is missing."""
        out = np.zeros((len(keys), width), np.int64)
        for k, (rows,) in _by_shard(shard, shards, np.arange(len(keys))):
            held = self.get(name, k)
            if held is None or not len(held):
                continue
            own = keys[rows]
            at = np.minimum(np.searchsorted(held, own), len(held) - 1)
            ok = held[at] == own
            found = np.asarray(self.get(f"counts{level}", k)[at[ok]]).reshape(-1, width).astype(np.int64)
            row, column = np.nonzero(found == 255)
            if len(row):
                places, values = self.get(f"more{level}", k)
                found[row, column] = values[np.searchsorted(places, at[ok][row] * width + column)]
            out[rows[ok]] = found
        return out


_open: dict[str, _Arrays] = {}


def token_scores(model: NGrams, hashes: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count in training, add-0.1 log10 probability, model log10 probability) of each token."""
    if model.folder not in _open:
        _open.clear()
        _open[model.folder] = _Arrays(model.folder)
    arrays = _open[model.folder]
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    words = grams(hashes, edges, model.order)
    known, at = np.unique(np.concatenate((hashes, np.array([START]))), return_inverse=True)
    numbers = arrays.find(known, shard_of(mix(known), model.shards), model.shards, "word", 1, 6)
    count, after = numbers[:, 0], numbers[:, 1]
    base = np.log10((count + 0.1) / (model.train + 0.1 * (model.words + 1)))
    own = (np.maximum(after - np.array(model.word_discounts)[np.minimum(after, 3)], 0) / max(1, model.pairs)) + model.share / (model.words + 1)
    v_at = at[:-1]
    u_at = np.concatenate((at[-1:], v_at[:-1]))
    u_at[edges[:-1]] = at[-1]
    p, context = own[v_at], numbers[u_at, 2:]
    for level, d in enumerate(map(np.array, model.discounts), 2):
        f1, f2, f3, total = context.T
        back = np.where(total > 0, (d[1] * f1 + d[2] * f2 + d[3] * f3) / np.maximum(total, 1), 1.0)
        key, shard = gram_key(words[-level:]), home(words[-level:], model.shards, level == model.order)
        by = np.argsort(key)
        found = np.empty((len(key), 1 if level == model.order else 5), np.int64)
        found[by] = arrays.find(key[by], shard[by], model.shards, f"gram{level}", level, found.shape[1])
        n = found[:, 0]
        p = np.maximum(n - d[np.minimum(n, 3)], 0) / np.maximum(total, 1) + back * p
        # The next order's context of a token is this order's n-gram that ends at the token before.
        context = np.concatenate((np.zeros((1, found.shape[1] - 1), np.int64), found[:-1, 1:]))
        context[edges[:-1]] = 0
    return count[v_at], base[v_at], np.log10(p)


def _slices(column: pa.Array) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """(hashes, tokens of each text) of short runs of texts, SLICE bytes together."""
    some, size = [], 0
    for raw, cuts in raw_slices(column):
        hashes, edges = tokens(raw, cuts)
        some.append((hashes, np.diff(edges)))
        size += len(raw)
        if size >= SLICE:
            yield some
            some, size = [], 0
    if some:
        yield some


def score(docs: DataFrame, model: NGrams, text_col: str = "text") -> DataFrame:
    """docs without the text, with n_tokens, n_known, base_score, score and perplexity of each whole text."""
    ship(docs.sparkSession)
    docs = making_room(docs, ["n_tokens", "n_known", "base_score", "score", "perplexity"], keep=(text_col,))
    kept = [f for f in docs.schema.fields if f.name != text_col]
    added = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()), ("perplexity", T.DoubleType())]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rest = 0, batch.drop_columns([text_col])
            for some in _slices(batch.column(batch.schema.get_field_index(text_col))):
                hashes, edges = (np.concatenate(x) for x in zip(*some, strict=True))
                edges = edges_of(edges)
                count, base, own = token_scores(model, hashes, edges)
                sizes, starts = np.diff(edges), edges[:-1]
                total = np.add.reduceat(own, starts)
                columns = [sizes, np.add.reduceat((count > 0).astype(np.int64), starts), np.add.reduceat(base, starts), total, 10 ** np.minimum(300, -total / sizes)]
                yield pa.RecordBatch.from_arrays([*rest.slice(at, len(sizes)).columns, *map(pa.array, columns)], [*rest.schema.names, *(n for n, _ in added)])
                at += len(sizes)
        give_back()

    return docs.mapInArrow(kernel, T.StructType([*kept, *(T.StructField(n, t) for n, t in added)]))
